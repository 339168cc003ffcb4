"""Queries on hierarchies, rank correlations, imputation by neighbours, neighbour runs with ties and stages of preprocessing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.operators import distance, gram, hierarchy, latent, neighbours, preprocess, qc, stages

from .queries import FEATURES, OBJECT_FEATURES, PROFILES, object_profiles, query, r, rounded, table
from .queries_analysis import COSINE, REPLICATES, UNIT, VECTORS, _flat, vectors

# ---------------------------------------------------------------- hierarchies

#: Cosine distance below which single linkage joins vectors.
HEIGHT = 0.58


@query("single_linkage_cut", f"""WITH RECURSIVE {UNIT}, l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE round({COSINE}, 12) <= {HEIGHT}),
w AS (SELECT vec_id AS id, vec_id AS root FROM u UNION SELECT l.b, w.root FROM w JOIN l ON w.id = l.a), c AS (SELECT id, min(root) AS least FROM w GROUP BY 1),
n AS (SELECT least, row_number() OVER (ORDER BY least) - 1 AS cluster FROM (SELECT DISTINCT least FROM c)) SELECT id AS vec_id, cluster FROM c JOIN n USING (least)""")
def single_linkage_cut(spark, sf):
    v = vectors(spark, sf)
    return hierarchy.cut_tree(hierarchy.spanning_tree(v, "vec_id", "embedding"), v, "vec_id", height=HEIGHT).withColumnRenamed("id", "vec_id")


@query("agglomerative_single")
def agglomerative_single(spark, sf):
    df, names = _flat(spark, sf)
    return hierarchy.agglomerative(df, "vec_id", names, 10, "single", "cosine").withColumnRenamed("id", "vec_id")


@query("agglomerative_ward")
def agglomerative_ward(spark, sf):
    df, names = _flat(spark, sf)
    return hierarchy.agglomerative(df, "vec_id", names, 10, "ward").withColumnRenamed("id", "vec_id")


@query("clustered_order")
def clustered_order(spark, sf):
    return hierarchy.clustered_rows(vectors(spark, sf), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


@query("clustered_columns")
def clustered_columns(spark, sf):
    df, names = _flat(spark, sf)
    return hierarchy.clustered_columns(df, names)


@query("zscore_rows", f"""WITH t AS (SELECT p_partkey, [p_size::DOUBLE, p_retailprice, (p_partkey % 97)::DOUBLE] AS e FROM part), s AS (SELECT p_partkey, e, list_avg(e) AS m, list_stddev_pop(e) AS d FROM t)
SELECT p_partkey, {', '.join(r(f'(e[{i + 1}] - m) / CASE WHEN d > 0 THEN d ELSE 1 END') + f' AS {c}' for i, c in enumerate('abc'))} FROM s""")
def zscore_rows(spark, sf):
    k = F.col("p_partkey")
    t = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (k % 97).cast("double").alias("c"))
    return rounded(hierarchy.zscore(t, ["a", "b", "c"], "row"))


# ---------------------------------------------------------------- correlations and imputation

KENDALL = ["a", "b", "c"]


@query("corr_matrix_kendall", "WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 > 0 THEN p_size::DOUBLE END AS a, p_retailprice AS b, (p_partkey % 5)::DOUBLE AS c FROM part), "
       + ", ".join(f"s_{x}{y} AS (SELECT sign(p.{x} - q.{x}) AS s, sign(p.{y} - q.{y}) AS t FROM t p JOIN t q ON p.id < q.id WHERE p.{x} IS NOT NULL AND q.{x} IS NOT NULL)" for x, y in ("ab", "ac", "bc"))
       + " " + " UNION ALL ".join(f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, {r('sum(s * t) / (sqrt(sum(s * s)) * sqrt(sum(t * t)))')} AS correlation FROM s_{x}{y}" for x, y in ("ab", "ac", "bc")))
def corr_matrix_kendall(spark, sf):
    k = F.col("p_partkey")
    t = table(spark, sf, "part").select(F.when(k % 11 > 0, F.col("p_size").cast("double")).alias("a"), F.col("p_retailprice").alias("b"), (k % 5).cast("double").alias("c"))
    return rounded(preprocess.correlation_pairs(t, KENDALL, "kendall"))


@query("corr_wide_summary")
def corr_wide_summary(spark, sf):
    """Products of all pairs of components: some two thousand features, each with its number of close ones and its mean |r|."""
    v = vectors(spark, sf)
    n = v.agg(F.max(F.size("embedding"))).first()[0]
    made = v.select(*[(F.get("embedding", F.lit(i)) * F.get("embedding", F.lit(j))).alias(f"p{i}_{j}") for i in range(n) for j in range(i, n)])
    pairs = gram.correlations(made, made.columns).select("feature_a", "feature_b", F.abs("correlation").alias("r"))
    both = pairs.select(F.col("feature_a").alias("feature"), "r").union(pairs.select("feature_b", "r"))
    return rounded(both.groupBy("feature").agg(F.count_if(F.col("r") >= 0.5).alias("n_close"), F.avg("r").alias("mean_r")))


_WIDE_PRICE = "t AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * 2 + l_tax AS double_price FROM lineitem)"
_NEAR = "abs(corr(l_extendedprice, double_price))"


@query("corr_filter", f"WITH {_WIDE_PRICE} SELECT 'l_extendedprice' AS feature, 'double_price' AS retained_feature, {r(_NEAR)} AS correlation FROM t HAVING {_NEAR} >= 0.95 AND var_samp(double_price) > var_samp(l_extendedprice)")
def corr_filter(spark, sf):
    t = table(spark, sf, "lineitem").select(*OBJECT_FEATURES).withColumn("double_price", F.col("l_extendedprice") * 2 + F.col("l_tax"))
    return rounded(preprocess.correlation_filter(t, [*OBJECT_FEATURES, "double_price"], 0.95, "pearson")[1])


_BOTH = [f"(q.{f} IS NOT NULL AND b.{f} IS NOT NULL)" for f in FEATURES]
_SHARED = " + ".join(f"{c}::INT" for c in _BOTH)
_SQUARE = " + ".join(f"CASE WHEN {c} THEN (q.{f} - b.{f}) * (q.{f} - b.{f}) ELSE 0 END" for c, f in zip(_BOTH, FEATURES))


@query("impute_knn", f"""WITH {PROFILES}, q AS (SELECT * FROM profiles WHERE quantity IS NULL OR price IS NULL OR discount IS NULL OR tax IS NULL),
d AS (SELECT q.image, b.image AS other, round(sqrt(({_SQUARE}) * {len(FEATURES)} / nullif({_SHARED}, 0)), 12) AS d, {', '.join(f'q.{f} AS q_{f}, b.{f} AS b_{f}' for f in FEATURES)} FROM q JOIN profiles b ON q.plate = b.plate AND q.image <> b.image),
n AS ({' UNION ALL '.join(f"SELECT image, '{f}' AS f, avg(v) AS m FROM (SELECT image, b_{f} AS v FROM d WHERE q_{f} IS NULL AND b_{f} IS NOT NULL AND d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY image ORDER BY d, other) <= 5) GROUP BY 1" for f in FEATURES)}),
m AS (SELECT {', '.join(f'median({f}) AS {f}' for f in FEATURES)} FROM profiles)
SELECT p.image, {', '.join(r(f"coalesce(p.{f}, (SELECT n.m FROM n WHERE n.image = p.image AND n.f = '{f}'), m.{f})") + f' AS {f}' for f in FEATURES)} FROM profiles p, m""")
def impute_knn(spark, sf):
    p = object_profiles(spark, sf)
    return rounded(preprocess.impute_knn(p, FEATURES, "image", 5, ["plate"]).select("image", *FEATURES))


# ---------------------------------------------------------------- neighbour runs with ties

TIES = 8


def _runs(spark, sf) -> dict[str, DataFrame]:
    """Lists of 20 neighbours of every row whose id is divisible by 100, with distances rounded so that many tie."""
    v = vectors(spark, sf)
    asked = v.where("vec_id % 100 = 0")
    near = {m: distance.nearest(asked, "vec_id", "embedding", 20, m, base=v) for m in ("cosine", "cityblock")}
    digits = {"cosine": 2, "cityblock": 0}
    return {m: t.withColumn("distance", F.round("distance", digits[m])) for m, t in near.items()}


RUNS = f"""{UNIT}, far AS (SELECT a.vec_id AS q, b.vec_id AS n, round({COSINE}, 12) AS x, round(list_sum(list_transform(list_zip(w.e, z.e), lambda y: abs(y[1] - y[2]))), 12) AS y
FROM u a JOIN u b ON a.vec_id <> b.vec_id JOIN v w ON w.vec_id = a.vec_id JOIN v z ON z.vec_id = b.vec_id WHERE a.vec_id % 100 = 0),
a AS (SELECT q, n, row_number() OVER (PARTITION BY q ORDER BY x, n) AS p, round(x, 2) AS d FROM far QUALIFY p <= 20), b AS (SELECT q, n, row_number() OVER (PARTITION BY q ORDER BY y, n) AS p, round(y, 0) AS d FROM far QUALIFY p <= 20),
ka AS (SELECT q, n FROM (SELECT q, n, d, max(d) FILTER (p = {TIES}) OVER (PARTITION BY q) AS k FROM a) WHERE d <= k), kb AS (SELECT q, n FROM (SELECT q, n, d, max(d) FILTER (p = {TIES}) OVER (PARTITION BY q) AS k FROM b) WHERE d <= k),
sa AS (SELECT q, count(*) AS n FROM ka GROUP BY 1), sb AS (SELECT q, count(*) AS n FROM kb GROUP BY 1), c AS (SELECT ka.q, count(*) AS n FROM ka JOIN kb ON ka.q = kb.q AND ka.n = kb.n GROUP BY 1),
o AS (SELECT a.q, greatest(a.p, b.p) AS seen FROM a JOIN b ON a.q = b.q AND a.n = b.n WHERE greatest(a.p, b.p) <= {TIES}),
rb AS (SELECT q, sum(0.1 * list_sum(list_transform(range(seen, {TIES + 1}), lambda d: pow(0.9, d - 1) / d))) AS rbo FROM o GROUP BY 1),
t AS (SELECT sa.q::VARCHAR AS query_id, 'cityblock' AS run, {TIES} AS k, coalesce(c.n, 0) / (sa.n + sb.n - coalesce(c.n, 0)) AS jaccard, coalesce(rbo, 0) AS rbo, sa.n AS baseline_size, sb.n AS run_size FROM sa JOIN sb ON sa.q = sb.q LEFT JOIN c ON c.q = sa.q LEFT JOIN rb ON rb.q = sa.q)"""


@query("neighbour_overlap_ties", f"WITH {RUNS} SELECT query_id, run, k, {r('jaccard')} AS jaccard, {r('rbo')} AS rbo, baseline_size, run_size FROM t")
def neighbour_overlap_ties(spark, sf):
    return rounded(neighbours.overlap(_runs(spark, sf), "cosine", TIES, ties=True)[0])


@query("neighbour_overlap_summary", f"""WITH {RUNS} SELECT run, k, count(*) AS n_queries, {r('avg(jaccard)')} AS mean_jaccard, {r('median(jaccard)')} AS median_jaccard, {r('quantile_cont(jaccard, 0.25)')} AS q25_jaccard,
{r('quantile_cont(jaccard, 0.75)')} AS q75_jaccard, {r('avg(rbo)')} AS mean_rbo, {r('median(rbo)')} AS median_rbo FROM t GROUP BY 1, 2""")
def neighbour_overlap_summary(spark, sf):
    return rounded(neighbours.overlap(_runs(spark, sf), "cosine", TIES, ties=True)[1])


# ---------------------------------------------------------------- stages of preprocessing, balanced batches

TWO = "s AS (SELECT p_partkey AS id, p_type, p_brand, p_size::DOUBLE AS a, p_retailprice / 100 AS b FROM part)"


def _two(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_brand", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100).alias("b"))


def _stages(spark, sf) -> dict[str, DataFrame]:
    t = _two(spark, sf)
    return {"before": t, "after": preprocess.batch_centre(t, ["a", "b"], ["p_type"], "mean")}


#: The axes of two features have a closed form; a component and its negative have one eta squared.
AXES = f"""{TWO}, f AS (SELECT 'before' AS stage, * FROM s UNION ALL SELECT 'after', id, p_type, p_brand, a - avg(a) OVER (PARTITION BY p_type), b - avg(b) OVER (PARTITION BY p_type) FROM s),
x AS (SELECT stage, 0.5 * atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)) AS t FROM f GROUP BY 1),
c AS (SELECT stage, 'PC1' AS component, p_type, p_brand, a * cos(t) + b * sin(t) AS y FROM f JOIN x USING (stage) UNION ALL SELECT stage, 'PC2', p_type, p_brand, b * cos(t) - a * sin(t) FROM f JOIN x USING (stage)),
l AS (SELECT stage, component, 'p_type' AS metadata_column, p_type AS label, y FROM c UNION ALL SELECT stage, component, 'p_brand', p_brand, y FROM c),
g AS (SELECT stage, component, metadata_column, label, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS w FROM l GROUP BY 1, 2, 3, 4), h AS (SELECT stage, component, metadata_column, avg(y) AS grand FROM l GROUP BY 1, 2, 3)"""


@query("stage_batch_association", f"WITH {AXES} SELECT stage, metadata_column, component, 'tested' AS status, {r('sum(n * (m - grand) ** 2) / (sum(n * (m - grand) ** 2) + sum(w))')} AS eta_squared, count(*) AS n_groups, sum(n) AS n_profiles FROM g JOIN h USING (stage, component, metadata_column) GROUP BY 1, 2, 3")
def stage_batch_association(spark, sf):
    return rounded(stages.stage_batches(_stages(spark, sf), ["p_type", "p_brand"], ["a", "b"]))


_SECOND = REPLICATES.replace("s AS", "s2 AS").replace("k AS", "k2 AS").replace("z AS", "z2 AS").replace("p AS", "p2 AS").replace("FROM s)", "FROM s2)").replace("FROM k)", "FROM k2)").replace("FROM z a JOIN z b", "FROM z2 a JOIN z2 b").replace("p_retailprice, (", "-p_retailprice, (")


@query("stage_replicate_summary", f"WITH {REPLICATES}, {_SECOND}, b AS (SELECT 'before' AS stage, * FROM p UNION ALL SELECT 'after', * FROM p2) "
       f"SELECT stage, p_brand, count(c) AS n_pairs, {r('median(c)')} AS median_correlation, {r('avg(c)')} AS mean_correlation, {r('stddev_samp(c)')} AS sd_correlation FROM b GROUP BY 1, 2")  # fmt: skip
def stage_replicate_summary(spark, sf):
    k = F.col("p_partkey")
    t = table(spark, sf, "part").select("p_partkey", "p_brand", (F.col("p_size").cast("double") * 30).alias("a"), F.col("p_retailprice").alias("b"), ((k % 97).cast("double") * 9).alias("c"), ((k % 31).cast("double") * 40).alias("d"))
    return rounded(stages.stage_replicates({"before": t, "after": t.withColumn("b", -F.col("b"))}, "p_partkey", ["p_brand"], ["a", "b", "c", "d"])[1])


@query("feature_selection_report", f"""WITH {_WIDE_PRICE} SELECT feature, feature NOT IN ('constant', 'l_extendedprice') AS retained, feature = 'l_tax' AS protected,
CASE feature WHEN 'constant' THEN 'low_variance' WHEN 'l_extendedprice' THEN 'correlated' ELSE 'retained' END AS reason, CASE WHEN feature = 'l_extendedprice' THEN 'double_price ' || (SELECT printf('%.4f', {_NEAR}) FROM t) END AS detail
FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax'), ('double_price'), ('constant')) x (feature)""")
def feature_selection_report(spark, sf):
    t = table(spark, sf, "lineitem").select(*OBJECT_FEATURES).withColumn("double_price", F.col("l_extendedprice") * 2 + F.col("l_tax")).withColumn("constant", F.lit(1.0))
    names = [*OBJECT_FEATURES, "double_price", "constant"]
    chosen = qc.select_features(qc.feature_qc(t, names))
    good = [x["feature"] for x in chosen.where("keep").collect()]  # a row a feature
    final, dropped = preprocess.correlation_filter(t, [f for f in names if f in good], 0.95, "pearson")
    return preprocess.selection_report(spark, names, chosen, dropped, final, ["l_tax"])


@query("balanced_batches")
def balanced_batches(spark, sf):
    v = vectors(spark, sf)
    many = v.agg(F.count(F.lit(1))).first()[0] // 64 + 1  # as many batches of 64 as the table has
    return latent.balanced_batches(v, "vec_id", "label", range(many), 64, 4)


@query("positive_groups", "SELECT p_brand AS label, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def positive_groups(spark, sf):
    return latent.positive_groups(table(spark, sf, "part"), "p_brand")
