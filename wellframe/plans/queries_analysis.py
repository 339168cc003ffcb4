"""Queries on distances, diagnostics, mechanisms, clusters and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellframe.functions import stats, text
from wellframe.operators import anchors, diagnostics, distance, holdout, latent, models, moa, preprocess, repeats, synthetic

from .queries import DIGITS, FEATURES, each, object_profiles, query, r, rounded, table, with_profiles

ENTIRE = "CAST(embedding AS DOUBLE[])"
VECTORS = f"v AS (SELECT vec_id, label, {ENTIRE} AS e, sqrt(list_sum(list_transform({ENTIRE}, lambda x: x * x))) AS len FROM embeddings)"
UNIT = f"{VECTORS}, u AS (SELECT vec_id, label, list_transform(e, lambda x: x / len) AS e FROM v)"
COSINE = "1 - list_dot_product(a.e, b.e)"
NEAR = f"""{UNIT}, d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, {COSINE} AS distance FROM u a JOIN u b ON a.vec_id <> b.vec_id),
nn AS (SELECT query_id, neighbour_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank, distance FROM d QUALIFY rank <= 5)"""


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


def five_nearest(spark, sf) -> DataFrame:
    return distance.nearest(vectors(spark, sf), "vec_id", "embedding", 5)


# ---------------------------------------------------------------- distances and neighbours


ASKED = "a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id"


def _asked(spark, sf, metric: str) -> DataFrame:
    """Every row whose id is divisible by 100 against all rows."""
    v = vectors(spark, sf)
    return rounded(distance.distances_from(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding", metric))


@query("pairwise_cosine", f"WITH {UNIT} SELECT a.vec_id AS id_a, b.vec_id AS id_b, {r(COSINE)} AS distance FROM u a JOIN u b ON {ASKED}")
def pairwise_cosine(spark, sf):
    return _asked(spark, sf, "cosine")


@query("pairwise_euclidean", f"WITH {VECTORS} SELECT a.vec_id AS id_a, b.vec_id AS id_b, {r('list_distance(a.e, b.e)')} AS distance FROM v a JOIN v b ON {ASKED}")
def pairwise_euclidean(spark, sf):
    return _asked(spark, sf, "euclidean")


@query("pairwise_correlation", f"""WITH {VECTORS}, c AS (SELECT vec_id, list_transform(e, lambda x: x - list_avg(e)) AS e FROM v)
SELECT a.vec_id AS id_a, b.vec_id AS id_b, {r('1 - list_cosine_similarity(a.e, b.e)')} AS distance FROM c a JOIN c b ON {ASKED}""")
def pairwise_correlation(spark, sf):
    return _asked(spark, sf, "correlation")


@query("pairwise_cityblock", f"WITH {VECTORS} SELECT a.vec_id AS id_a, b.vec_id AS id_b, {r('list_sum(list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2])))')} AS distance FROM v a JOIN v b ON {ASKED}")
def pairwise_cityblock(spark, sf):
    return _asked(spark, sf, "cityblock")


# the four above take every hundredth row as a query against all rows; these take all pairs of the table


@query("pairwise_cosine_all")
def pairwise_cosine_all(spark, sf):
    return distance.pairwise(vectors(spark, sf), "vec_id", "embedding", "cosine", digits=DIGITS)


@query("pairwise_euclidean_all")
def pairwise_euclidean_all(spark, sf):
    return distance.pairwise(vectors(spark, sf), "vec_id", "embedding", "euclidean", digits=DIGITS)


@query("pairwise_correlation_all")
def pairwise_correlation_all(spark, sf):
    return distance.pairwise(vectors(spark, sf), "vec_id", "embedding", "correlation", digits=DIGITS)


@query("pairwise_cityblock_all")
def pairwise_cityblock_all(spark, sf):
    return distance.pairwise(vectors(spark, sf), "vec_id", "embedding", "cityblock", digits=DIGITS)


@query("knn_topk", f"WITH {NEAR} SELECT query_id, neighbour_id, rank::INTEGER AS rank, {r('distance')} AS distance FROM nn")
def knn_topk(spark, sf):
    return rounded(five_nearest(spark, sf))


@query("knn_class_summary", f"WITH {NEAR}, c AS (SELECT query_id, label::VARCHAR AS neighbour_class, count(*) AS n FROM nn JOIN embeddings ON neighbour_id = vec_id GROUP BY 1, 2) SELECT query_id, neighbour_class, n, {r('n / sum(n) OVER (PARTITION BY query_id)')} AS fraction FROM c")
def knn_class_summary(spark, sf):
    return rounded(distance.neighbour_classes(five_nearest(spark, sf), vectors(spark, sf), "vec_id", "label"))


@query("knn_edges", f"WITH {NEAR} SELECT least(query_id, neighbour_id) AS source, greatest(query_id, neighbour_id) AS target, {r('min(distance)')} AS distance FROM nn GROUP BY 1, 2")
def knn_edges(spark, sf):
    return rounded(distance.topology_edges(five_nearest(spark, sf)))


@query("shared_neighbours", f"""WITH {UNIT}, t AS (SELECT a.vec_id AS q, b.vec_id AS n, {COSINE} AS d FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (0, 1) QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE}, b.vec_id) <= 60)
SELECT x.n AS neighbour_id, {r('x.d')} AS first_distance, {r('y.d')} AS second_distance, {r('1 - x.d')} AS first_similarity, {r('1 - y.d')} AS second_similarity FROM t x JOIN t y ON x.n = y.n WHERE x.q = 0 AND y.q = 1""")
def shared_neighbours(spark, sf):
    v = vectors(spark, sf)
    near = distance.nearest(v.where("vec_id IN (0, 1)"), "vec_id", "embedding", 60, base=v)
    return rounded(distance.shared_neighbours(near, 0, 1))


def _overlap(spark, sf) -> DataFrame:
    near = five_nearest(spark, sf)
    other = distance.nearest(vectors(spark, sf), "vec_id", "embedding", 5, "euclidean")
    return distance.neighbour_overlap(near, other, 5)


OVERLAP = f"""{NEAR}, d2 AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id),
n2 AS (SELECT query_id, neighbour_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d2 QUALIFY rank <= 5),
la AS (SELECT query_id, list(neighbour_id ORDER BY rank) AS a FROM nn GROUP BY 1), lb AS (SELECT query_id, list(neighbour_id ORDER BY rank) AS b FROM n2 GROUP BY 1)"""


@query("neighbour_jaccard", f"WITH {OVERLAP} SELECT query_id, {r('len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))')} AS jaccard FROM la JOIN lb USING (query_id)")
def neighbour_jaccard(spark, sf):
    return rounded(_overlap(spark, sf).select("query_id", "jaccard"))


@query("neighbour_rbo", f"WITH {OVERLAP} SELECT query_id, {r('0.1 * list_sum(list_transform(range(1, 6), lambda i: len(list_intersect(a[1:i], b[1:i])) / i * pow(0.9, i - 1)))')} AS rbo FROM la JOIN lb USING (query_id)")
def neighbour_rbo(spark, sf):
    return rounded(_overlap(spark, sf).select("query_id", "rbo"))


@query("retrieval_rates", f"""WITH {NEAR}, s AS (SELECT query_id, max((rank = 1 AND q.label = n.label)::INT) AS t1, max((q.label = n.label)::INT) AS tk FROM nn JOIN embeddings q ON query_id = q.vec_id JOIN embeddings n ON neighbour_id = n.vec_id GROUP BY 1)
SELECT count(*) AS n_queries, {r('avg(t1)')} AS top1_same_label, {r('avg(tk)')} AS topk_same_label FROM s""")
def retrieval_rates(spark, sf):
    return rounded(distance.retrieval_rates(five_nearest(spark, sf), vectors(spark, sf), "vec_id", ["label"]))


@query("silhouette_exact", f"""WITH {UNIT}, p AS (SELECT a.vec_id AS id, a.label AS c, b.label AS k, avg({COSINE}) AS m FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
ab AS (SELECT id, c, max(m) FILTER (c = k) AS a, min(m) FILTER (c <> k) AS b FROM p GROUP BY 1, 2)
SELECT id, c::VARCHAR AS cluster, {r('a')} AS a, {r('b')} AS b, {r('(b - a) / greatest(a, b)')} AS silhouette FROM ab""")
def silhouette_exact(spark, sf):
    return rounded(distance.silhouette(vectors(spark, sf), "vec_id", "embedding", "label", "cosine"))


@query("l2_norm_summary", f"WITH {VECTORS} SELECT {r('min(len)')} AS min, {r('max(len)')} AS max, {r('avg(len)')} AS mean, {r('median(len)')} AS median, {r('stddev_pop(len)')} AS std, count(*) FILTER (len = 0) AS n_zero FROM v")
def l2_norm_summary(spark, sf):
    n = vectors(spark, sf).select(stats.norm(F.col("embedding")).alias("n"))
    return rounded(n.agg(F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), stats.median(F.col("n")).alias("median"), F.stddev_pop("n").alias("std"), F.count_if(F.col("n") == 0).alias("n_zero")))


# ---------------------------------------------------------------- diagnostics


REPLICATES = """s AS (SELECT p_partkey AS id, p_brand AS g, [p_size::DOUBLE * 30, p_retailprice, (p_partkey % 97)::DOUBLE * 9, (p_partkey % 31)::DOUBLE * 40] AS e FROM part),
k AS (SELECT id, g, list_transform(e, lambda x: len(list_filter(e, lambda y: y < x)) + (len(list_filter(e, lambda y: y = x)) + 1) / 2) AS e FROM s),
z AS (SELECT id, g, list_transform(e, lambda x: x - list_avg(e)) AS e FROM k),
p AS (SELECT a.g AS p_brand, a.id AS id_a, b.id AS id_b, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS c FROM z a JOIN z b ON a.g = b.g AND a.id < b.id)"""


def _replicates(spark, sf) -> tuple[DataFrame, str, list[str], list[str]]:
    k = F.col("p_partkey")
    t = table(spark, sf, "part").select("p_partkey", "p_brand", (F.col("p_size") * 30.0).alias("a"), F.col("p_retailprice").alias("b"), ((k % 97) * 9.0).alias("c"), ((k % 31) * 40.0).alias("d"))
    return t, "p_partkey", ["p_brand"], ["a", "b", "c", "d"]


@query("replicate_pairs", f"WITH {REPLICATES} SELECT p_brand, id_a, id_b, {r('c')} AS correlation FROM p")
def replicate_pairs(spark, sf):
    return diagnostics.replicate_pairs(*_replicates(spark, sf), digits=DIGITS)


@query("replicate_summary", f"WITH {REPLICATES} SELECT p_brand, count(c) AS n_pairs, {r('median(c)')} AS median_correlation, {r('avg(c)')} AS mean_correlation, {r('stddev_samp(c)')} AS sd_correlation FROM p GROUP BY 1")
def replicate_summary(spark, sf):
    return rounded(diagnostics.summary_of_counts(diagnostics.replicate_counts(*_replicates(spark, sf)), ["p_brand"]))


@query("layout_matrix", "WITH t AS (SELECT chr(65 + (p_size % 8)::INT) AS plate_row, p_size, p_retailprice FROM part) SELECT plate_row, "
       + ", ".join(f"{r(f'median(p_retailprice) FILTER (p_size = {c})')} AS \"{c:02d}\"" for c in range(1, 51)) + " FROM t GROUP BY 1")
def layout_matrix(spark, sf):
    t = table(spark, sf, "part").withColumn("well", F.concat(F.char((F.col("p_size") % 8 + 65).cast("int")), F.col("p_size").cast("string")))
    return rounded(diagnostics.plate_matrix(diagnostics.plate_positions(t, "well"), "p_retailprice", range(1, 51)))


@query("layout_axis_summary", with_profiles("\n, " + f"l2 AS (SELECT * FROM long WHERE feature IN ('price', 'quantity')) " + " UNION ALL ".join(
    f"SELECT '{a}' AS axis, {a} AS value, feature AS metric, count(value) AS n, {r('median(l2.value)')} AS median, {r('avg(l2.value)')} AS mean, {r('stddev_samp(l2.value)')} AS sd FROM l2 GROUP BY {a}, feature" for a in ("plate", "batch"))))
def layout_axis_summary(spark, sf):
    return rounded(diagnostics.axis_summary(object_profiles(spark, sf), ["price", "quantity"], ["plate", "batch"]))


DRIFT = """t AS (SELECT floor(event_id / 20)::BIGINT AS image, value FROM events), m AS (SELECT image, median(value) AS m, count(value) AS n FROM t WHERE value IS NOT NULL GROUP BY 1),
q AS (SELECT quantile_cont(image::DOUBLE, 0.2) AS lo, quantile_cont(image::DOUBLE, 0.8) AS hi FROM t),
rk AS (SELECT *, rank() OVER (ORDER BY image) + (count(*) OVER (PARTITION BY image) - 1) / 2 AS rx, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS ry FROM m),
g AS (SELECT sum(n)::BIGINT AS n, count(*) AS n_images, corr(rx, ry) AS rho, covar_pop(m, image) / var_pop(image) AS slope FROM rk),
e AS (SELECT median(value) AS a FROM t, q WHERE image <= lo), l AS (SELECT median(value) AS b FROM t, q WHERE image >= hi),
ev AS (SELECT value FROM t, q WHERE image <= lo AND value IS NOT NULL), lv AS (SELECT value FROM t, q WHERE image >= hi AND value IS NOT NULL),
cd AS (SELECT sum(sign(ev.value - lv.value)) / count(*) AS delta FROM ev, lv)"""


def _drift(spark, sf) -> DataFrame:
    t = table(spark, sf, "events").select(F.floor(F.col("event_id") / 20).cast("bigint").alias("image"), "value")
    return diagnostics.drift_statistics(t, "image", ["value"], least=10)


@query("drift_statistics", f"""WITH {DRIFT} SELECT 'value' AS feature, n, n_images, {r('rho')} AS spearman_rho, {r('slope')} AS slope, {r('a')} AS early_median, {r('b')} AS late_median, {r('delta')} AS cliffs_delta, {r('b - a')} AS late_minus_early FROM g, e, l, cd""")
def drift_statistics(spark, sf):
    return rounded(_drift(spark, sf).drop("p_value", "q_value", "drift_flag"))


@query("drift_p_values")
def drift_p_values(spark, sf):
    return _drift(spark, sf).select("feature", "p_value", "q_value", "drift_flag")


@query("rolling_median", f"SELECT event_id, {r('quantile_cont(value, 0.5) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS rolling_median FROM events")
def rolling_median(spark, sf):
    return rounded(diagnostics.rolling_median(table(spark, sf, "events"), "event_id", "value", 5, ["event_type"]).select("event_id", "rolling_median"))


@query("cliffs_delta", f"""SELECT {r("(SELECT sum(sign(a.value - b.value)) / count(*) FROM events a, events b WHERE a.event_type = 'click' AND b.event_type = 'view')")} AS cliffs_delta,
(SELECT count(value) FROM events WHERE event_type = 'click') AS n_early, (SELECT count(value) FROM events WHERE event_type = 'view') AS n_late""")
def cliffs_delta(spark, sf):
    kind = F.col("event_type")
    return rounded(diagnostics.cliffs_delta(table(spark, sf, "events"), "value", F.when(kind == "click", True).when(kind == "view", False)))


@query("bh_qvalues", f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN ((p_partkey * 7919) % 10007) / 10007.0 END::DOUBLE AS p FROM part),
k AS (SELECT p_partkey, p, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM p WHERE p IS NOT NULL),
q AS (SELECT p_partkey, p, least(min(raw) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS q FROM k)
SELECT p_partkey, {r('p')} AS p, {r('q')} AS q_value FROM q UNION ALL SELECT p_partkey, p, NULL FROM p WHERE p IS NULL""")
def bh_qvalues(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select("p_partkey", F.when(k % 10 != 0, ((k * 7919) % 10007) / 10007.0).alias("p"))
    return rounded(stats.benjamini_hochberg(p, "p"))


TWO = """t AS (SELECT o_totalprice AS v, o_orderstatus = 'F' AS a FROM orders WHERE o_orderstatus IN ('F', 'O')),
n AS (SELECT count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb, median(v) FILTER (a) AS ma, median(v) FILTER (NOT a) AS mb FROM t),
s AS (SELECT v, count(*) FILTER (a) AS ca, count(*) FILTER (NOT a) AS cb FROM t GROUP BY v),
w AS (SELECT v, ca, cb, sum(ca) OVER o AS fa, sum(cb) OVER o AS fb, lead(v) OVER o - v AS width FROM s WINDOW o AS (ORDER BY v))"""


@query("two_sample_statistics", f"""WITH {TWO} SELECT 'o_totalprice' AS feature, na AS n_a, nb AS n_b, {r('ma')} AS median_a, {r('mb')} AS median_b, {r('sum(abs(fa / na - fb / nb) * coalesce(width, 0))')} AS wasserstein,
{r('max(abs(fa / na - fb / nb))')} AS ks, {r('ma - mb')} AS median_difference, {r('sum(ca * (fa + fb - ca - cb + (ca + cb + 1) / 2.0)) - na * (na + 1) / 2')} AS u_statistic FROM w, n GROUP BY na, nb, ma, mb""")
def two_sample_statistics(spark, sf):
    return rounded(_two_samples(spark, sf).drop("p_value", "q_value"))


@query("two_sample_p_values")
def two_sample_p_values(spark, sf):
    return _two_samples(spark, sf).select("feature", "p_value", "q_value")


def _two_samples(spark, sf) -> DataFrame:
    t = table(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return diagnostics.two_sample_statistics(t, ["o_totalprice"], F.col("o_orderstatus") == "F")


@query("batch_centroid_distance", with_profiles(f"""
, c AS (SELECT batch, [{each('coalesce(median($), 0)')}] AS e FROM profiles GROUP BY 1) SELECT a.batch AS batch_a, b.batch AS batch_b, {r('list_distance(a.e, b.e)')} AS distance FROM c a, c b"""))
def batch_centroid_distance(spark, sf):
    return rounded(diagnostics.batch_centroid_distances(object_profiles(spark, sf), "batch", FEATURES))


@query("eta_squared", with_profiles(f"""
, g AS (SELECT feature, plate, count(value) AS n, avg(value) AS m FROM long GROUP BY 1, 2), t AS (SELECT feature, avg(value) AS grand, var_pop(value) * count(value) AS total FROM long GROUP BY 1)
SELECT feature AS component, count(*) AS n_groups, {r('sum(n * (m - grand) * (m - grand)) / any_value(total)')} AS eta2 FROM g JOIN t USING (feature) GROUP BY feature"""))
def eta_squared(spark, sf):
    return rounded(diagnostics.eta_squared(object_profiles(spark, sf), FEATURES, "plate"))


@query("feature_family_counts", """SELECT CASE WHEN f LIKE '%Intensity%' THEN 'Intensity' WHEN f LIKE '%Texture%' THEN 'Texture' ELSE 'Other' END AS family, count(*) AS n
FROM (SELECT CASE p_partkey % 3 WHEN 0 THEN 'Cells_Intensity_' WHEN 1 THEN 'Nuclei_Texture_' ELSE 'Misc_' END || p_partkey::VARCHAR AS f FROM part) GROUP BY 1""")
def feature_family_counts(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 3 == 0, "Cells_Intensity_").when(k % 3 == 1, "Nuclei_Texture_").otherwise("Misc_"), k.cast("string"))
    return table(spark, sf, "part").groupBy(text.family_of(name, preprocess.FAMILIES).alias("family")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- mechanisms


CENTRES = f"""{VECTORS}, x AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v), ci AS (SELECT label, i, median(x) AS m FROM x GROUP BY 1, 2),
c AS (SELECT label::VARCHAR AS label, list(m ORDER BY i) AS e FROM ci GROUP BY 1)"""
SCORES = f"{CENTRES}, s AS (SELECT vec_id AS id, c.label, list_cosine_similarity(v.e, c.e) AS sim FROM v, c)"


def centres(spark, sf) -> DataFrame:
    return moa.vector_centroids(vectors(spark, sf), "label", "embedding")


@query("class_centroids", with_profiles(f"\n, k AS (SELECT plate AS label, count(*) AS n, {each(r('median($)') + ' AS $')} FROM profiles GROUP BY 1) SELECT * FROM k WHERE n >= 2"))
def class_centroids(spark, sf):
    return rounded(moa.class_centroids(object_profiles(spark, sf), "plate", FEATURES))


@query("centroid_scores", f"""WITH {SCORES} SELECT id, label, row_number() OVER w AS rank, {r('1 - sim')} AS distance, {r('sim')} AS similarity,
{r('exp((sim - max(sim) OVER p) / 0.1) / sum(exp(sim / 0.1)) OVER p * exp(max(sim) OVER p / 0.1)')} AS confidence, {r('max(sim) OVER p - nth_value(sim, 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)')} AS margin
FROM s WINDOW w AS (PARTITION BY id ORDER BY sim DESC, label), p AS (PARTITION BY id) QUALIFY rank <= 5""")
def centroid_scores(spark, sf):
    return rounded(moa.centroid_scores(vectors(spark, sf), "vec_id", "embedding", centres(spark, sf)))


@query("csls_scores", f"""WITH {SCORES}, a AS (SELECT id, avg(sim) AS ra FROM (SELECT id, sim FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, label) <= 5) GROUP BY 1),
b AS (SELECT label, avg(sim) AS rb FROM (SELECT label, sim FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY sim DESC, id) <= 5) GROUP BY 1)
SELECT id, label, {r('sim')} AS cosine, {r('2 * sim - ra - rb')} AS csls FROM s JOIN a USING (id) JOIN b USING (label)""")
def csls_scores(spark, sf):
    return rounded(moa.csls_scores(vectors(spark, sf), "vec_id", "embedding", centres(spark, sf), 5))


@query("score_matrix", f"WITH {SCORES} SELECT id, {', '.join(r(f'max(sim) FILTER (label = $${k}$$)'.replace('$$', chr(39))) + f' AS {chr(34)}{k}{chr(34)}' for k in range(10))} FROM s GROUP BY 1")
def score_matrix(spark, sf):
    scored = moa.centroid_scores(vectors(spark, sf), "vec_id", "embedding", centres(spark, sf), top=100)
    return rounded(moa.score_matrix(scored, [str(k) for k in range(10)]))


@query("collapsed_scores", f"WITH {SCORES} SELECT id, (label::INT % 3)::VARCHAR AS label, {r('max(sim)')} AS similarity FROM s GROUP BY 1, 2")
def collapsed_scores(spark, sf):
    scored = moa.centroid_scores(vectors(spark, sf), "vec_id", "embedding", centres(spark, sf), top=100)
    scored = scored.withColumn("moa", (F.col("label").cast("int") % 3).cast("string"))
    return rounded(moa.collapse_scores(scored, "moa", "similarity"))


@query("shrunk_centroids", f"""WITH {UNIT}, x AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM u), ci AS (SELECT label, i, median(x) AS m FROM x GROUP BY 1, 2), gi AS (SELECT i, avg(x) AS m FROM x GROUP BY 1),
n AS (SELECT label, count(*) AS n FROM u GROUP BY 1), cl AS (SELECT label, sqrt(sum(m * m)) AS l FROM ci GROUP BY 1), gl AS (SELECT sqrt(sum(m * m)) AS l FROM gi),
s AS (SELECT ci.label, ci.i, n.n, 0.1 + least(0.3, 0.5 / n.n) AS alpha, (1 - (0.1 + least(0.3, 0.5 / n.n))) * ci.m / cl.l + (0.1 + least(0.3, 0.5 / n.n)) * gi.m / gl.l AS v FROM ci JOIN gi USING (i) JOIN n USING (label) JOIN cl USING (label), gl)
SELECT label::VARCHAR AS label, any_value(n) AS n, {r('any_value(alpha)')} AS alpha, {r('max(v) FILTER (i = 1) / sqrt(sum(v * v))')} AS first, {r('sum(v) / sqrt(sum(v * v))')} AS total FROM s GROUP BY 1""")
def shrunk_centroids(spark, sf):
    c = moa.shrunk_centroids(vectors(spark, sf), "label", "embedding", 0.1, True)
    return rounded(c.select("label", "n", "alpha", F.col("centroid")[0].alias("first"), F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("knn_classify", f"""WITH {VECTORS}, d AS (SELECT a.vec_id AS id, b.label::VARCHAR AS label, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0
 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) <= 5), w AS (SELECT id, label, sum(1 / d) AS w FROM d GROUP BY 1, 2),
p AS (SELECT id, label, w / sum(w) OVER (PARTITION BY id) AS p FROM w)
SELECT id, label, {r('p')} AS probability, row_number() OVER (PARTITION BY id ORDER BY p DESC, label) AS rank FROM p""")
def knn_classify(spark, sf):
    v = vectors(spark, sf)
    return rounded(moa.knn_classify(v.where("vec_id % 5 <> 0"), v.where("vec_id % 5 = 0"), "vec_id", "embedding", "label"))


@query("moa_enrichment", f"""WITH {NEAR}, o AS (SELECT query_id, label::VARCHAR AS neighbour_class, count(*) AS observed FROM nn JOIN embeddings ON neighbour_id = vec_id GROUP BY 1, 2),
k AS (SELECT label::VARCHAR AS neighbour_class, count(*) AS class_size FROM embeddings GROUP BY 1), n AS (SELECT count(*) AS total FROM embeddings),
f AS (SELECT query_id, neighbour_class, observed, 5::BIGINT AS drawn, class_size, total, list_sum(list_transform(range(observed, 6), lambda x:
 exp(lgamma(class_size + 1) - lgamma(x + 1) - lgamma(class_size - x + 1) + lgamma(total - class_size + 1) - lgamma(5 - x + 1) - lgamma(total - class_size - 5 + x + 1) - lgamma(total + 1) + lgamma(6) + lgamma(total - 4)))) AS p FROM o JOIN k USING (neighbour_class), n)
SELECT query_id, neighbour_class, observed, drawn, class_size, total, {r('p')} AS p_value FROM f""")
def moa_enrichment(spark, sf):
    return rounded(moa.enrichment(five_nearest(spark, sf), vectors(spark, sf), "vec_id", "label"))


@query("loo_centroid", f"""WITH {CENTRES}, xs AS (SELECT vec_id, label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
x2 AS (SELECT label, i, median(x) AS m FROM xs GROUP BY 1, 2), c2 AS (SELECT label, list(m ORDER BY i) AS e FROM x2 GROUP BY 1),
far AS (SELECT v.vec_id AS id, v.label, c2.label AS k, 1 - list_cosine_similarity(v.e, c2.e) AS d FROM v JOIN c2 ON v.label <> c2.label),
oi AS (SELECT a.vec_id AS id, a.label, b.i, median(b.x) AS m FROM v a JOIN xs b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
oc AS (SELECT id, label, list(m ORDER BY i) AS e FROM oi GROUP BY 1, 2), own AS (SELECT id, oc.label, oc.label AS k, 1 - list_cosine_similarity(v.e, oc.e) AS d FROM oc JOIN v ON id = vec_id),
best AS (SELECT * FROM (SELECT * FROM far UNION ALL SELECT * FROM own) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, k) = 1)
SELECT id, label::VARCHAR AS label, k::VARCHAR AS predicted, k = label AS correct FROM best""")
def loo_centroid(spark, sf):
    return moa.leave_one_out(vectors(spark, sf), "vec_id", "embedding", "label")


@query("loo_centroid_all")
def loo_centroid_all(spark, sf):
    return moa.leave_one_out(vectors(spark, sf), "vec_id", "embedding", "label")


@query("moa_separability", f"""WITH {UNIT}, d AS (SELECT a.label = b.label AS same, {COSINE} AS d FROM u a JOIN u b ON a.vec_id < b.vec_id)
SELECT {r('median(d) FILTER (same)')} AS median_within, {r('median(d) FILTER (NOT same)')} AS median_between, {r('median(d) FILTER (NOT same) - median(d) FILTER (same)')} AS separability FROM d""")
def moa_separability(spark, sf):
    v = vectors(spark, sf)
    return rounded(moa.separability_of_vectors(v, "vec_id", "embedding", "label"))


@query("anchor_permutation")
def anchor_permutation(spark, sf):
    return rounded(moa.anchor_permutation(vectors(spark, sf), "vec_id", "embedding", "label"))


@query("phenotype_label_audit", """WITH t AS (SELECT doc_id::VARCHAR AS id, CASE quality WHEN 1 THEN ' good ' WHEN 0 THEN 'na' END AS label FROM labels), g AS (SELECT id, trim(label) AS label FROM t WHERE label IS NOT NULL AND trim(label) NOT IN ('', 'nan', 'none', 'na'))
SELECT 'rows_in' AS metric, count(*) AS value FROM t UNION ALL SELECT 'rows_split', count(*) FROM t UNION ALL SELECT 'rows_usable', count(*) FROM g UNION ALL SELECT 'rows_out', count(*) FROM (SELECT DISTINCT * FROM g)
UNION ALL SELECT 'ids_out', count(DISTINCT id) FROM g UNION ALL SELECT 'labels_out', count(DISTINCT label) FROM g""")
def phenotype_label_audit(spark, sf):
    q = F.col("quality")
    t = table(spark, sf, "labels").select("doc_id", F.when(q == 1, " good ").when(q == 0, "na").alias("label"))
    return moa.clean_labels(t, "doc_id", "label")[1]


@query("pseudo_anchor_labels", f"""WITH k AS (SELECT source AS cluster, doc_id::VARCHAR AS id FROM documents), l AS (SELECT DISTINCT doc_id::VARCHAR AS id, CASE quality WHEN 1 THEN 'good' ELSE 'junk' END || CASE toxic WHEN 1 THEN '_toxic' ELSE '' END AS label FROM labels),
s AS (SELECT cluster, count(DISTINCT id) AS n_members FROM k GROUP BY 1), m AS (SELECT cluster, count(DISTINCT id) AS n_labelled FROM k JOIN l USING (id) GROUP BY 1),
c AS (SELECT cluster, label, count(DISTINCT id) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(DISTINCT id) DESC, label) AS p FROM k JOIN l USING (id) GROUP BY 1, 2),
t AS (SELECT cluster, string_agg(label || ':' || n::VARCHAR, ';' ORDER BY p) FILTER (p <= 3) AS top_labels, max(label) FILTER (p = 1) AS dominant_label, max(n) FILTER (p = 1) AS n_dominant FROM c GROUP BY 1),
z AS (SELECT cluster, n_members, coalesce(n_labelled, 0) AS n_labelled, dominant_label, coalesce(n_dominant, 0) AS n_dominant, top_labels, coalesce(n_labelled, 0) / n_members AS lf, n_dominant / n_labelled AS df FROM s LEFT JOIN m USING (cluster) LEFT JOIN t USING (cluster)),
y AS (SELECT *, CASE WHEN n_labelled = 0 THEN 'unlabelled' WHEN lf >= 0.2 AND coalesce(df, 0) >= 0.5 THEN 'phenotype_labelled' ELSE 'weak_or_mixed_label' END AS status FROM z)
SELECT cluster, n_members, n_labelled, dominant_label, n_dominant, top_labels, {r('lf')} AS labelled_fraction, {r('df')} AS dominant_fraction, status, CASE WHEN status = 'phenotype_labelled' THEN dominant_label ELSE cluster END AS final_label FROM y""")
def pseudo_anchor_labels(spark, sf):
    clusters = table(spark, sf, "documents").select(F.col("source").alias("cluster"), F.col("doc_id").cast("string").alias("id"))
    t = table(spark, sf, "labels")
    label = F.concat(F.when(F.col("quality") == 1, "good").otherwise("junk"), F.when(F.col("toxic") == 1, "_toxic").otherwise(""))
    return rounded(moa.label_clusters(clusters, t.select(F.col("doc_id").cast("string").alias("id"), label.alias("label")).distinct()))


@query("prediction_summary", f"WITH {SCORES}, t AS (SELECT id, label FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, label) = 1) SELECT label, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()')} AS fraction FROM t GROUP BY 1")
def prediction_summary(spark, sf):
    return rounded(moa.prediction_summary(moa.centroid_scores(vectors(spark, sf), "vec_id", "embedding", centres(spark, sf), top=1)))


CONFUSED = "t AS (SELECT p_type AS label, CASE WHEN p_partkey % 4 = 0 THEN 'PROMO' ELSE p_type END AS predicted FROM part)"


def _confused(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_type").alias("label"), F.when(F.col("p_partkey") % 4 == 0, "PROMO").otherwise(F.col("p_type")).alias("predicted"))


@query("confusion_table", f"WITH {CONFUSED} SELECT label, predicted, count(*) AS n FROM t GROUP BY 1, 2")
def confusion_table(spark, sf):
    return moa.confusion(_confused(spark, sf))


@query("classification_summary", f"""WITH {CONFUSED}, a AS (SELECT label, count(*) AS t, count(*) FILTER (label = predicted) AS h FROM t GROUP BY 1), b AS (SELECT predicted AS label, count(*) AS s FROM t GROUP BY 1),
e AS (SELECT coalesce(t, 0) AS t, coalesce(h, 0) AS h, coalesce(s, 0) AS s FROM a FULL JOIN b USING (label)) SELECT {r('sum(h) / sum(t)')} AS accuracy, {r('avg(h / nullif(t, 0))')} AS balanced_accuracy, {r('avg(coalesce(2 * h / nullif(t + s, 0), 0))')} AS macro_f1 FROM e""")
def classification_summary(spark, sf):
    return rounded(moa.classification_summary(moa.confusion(_confused(spark, sf))))


@query("ari_from_contingency", f"""WITH c AS (SELECT p_type AS a, p_brand AS b, count(*) AS n FROM part GROUP BY 1, 2), x AS (SELECT sum(n * (n - 1) / 2) AS sab, sum(n) AS t FROM c),
y AS (SELECT sum(n * (n - 1) / 2) AS sa FROM (SELECT sum(n) AS n FROM c GROUP BY a)), z AS (SELECT sum(n * (n - 1) / 2) AS sb FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT {r('(sab - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2))')} AS ari FROM x, y, z""")
def ari_from_contingency(spark, sf):
    return rounded(moa.adjusted_rand(table(spark, sf, "part"), "p_type", "p_brand"))


@query("label_encode", "SELECT p_type AS label, (row_number() OVER (ORDER BY p_type) - 1)::INTEGER AS code FROM (SELECT DISTINCT p_type FROM part)")
def label_encode(spark, sf):
    return moa.label_codes(table(spark, sf, "part"), "p_type")


@query("positive_label_report", "SELECT p_brand AS label, count(*) AS n, count(*) >= 2 AS usable, count(*) = 1 AS singleton, (row_number() OVER (ORDER BY p_brand) - 1)::INTEGER AS code FROM part GROUP BY 1")
def positive_label_report(spark, sf):
    return moa.positive_labels(table(spark, sf, "part"), "p_brand")


# ---------------------------------------------------------------- models, latent workflow


def _flat(spark, sf) -> tuple[DataFrame, list[str]]:
    """All components of the embeddings as columns."""
    v = vectors(spark, sf)
    names = [f"f{i}" for i in range(v.agg(F.max(F.size("embedding"))).first()[0])]
    return v.select("vec_id", F.col("label").cast("string").alias("label"), *[F.col("embedding")[i].alias(n) for i, n in enumerate(names)]), names


@query("pca_scores")
def pca_scores(spark, sf):
    df, names = _flat(spark, sf)
    return models.run_pca(df, names, 2)[0].select("vec_id", "PC1", "PC2")


@query("kmeans")
def kmeans(spark, sf):
    df, names = _flat(spark, sf)
    return models.run_kmeans(df, names, 5).select("vec_id", "cluster")


@query("dbscan")
def dbscan(spark, sf):
    return models.dbscan(vectors(spark, sf), "vec_id", "embedding", 0.75, 4, "cosine")


@query("rf_cv")
def rf_cv(spark, sf):
    df, names = _flat(spark, sf)
    return models.cross_validate(df, "vec_id", names, "label", "random_forest", 5)[1]


@query("bootstrap_neighbour_stability")
def bootstrap_neighbour_stability(spark, sf):
    df, names = _flat(spark, sf)
    return models.neighbour_stability(df, "vec_id", names, 5)


@query("consensus_pairs")
def consensus_pairs(spark, sf):
    df, names = _flat(spark, sf)
    return repeats.consensus_pairs(df, "vec_id", names, 3)


@query("validation_split", """SELECT label, count(*) AS n, CASE WHEN count(*) < 4 THEN 0 ELSE least(greatest(2, round_even(count(*) * 0.15, 0)), count(*) - 2) END::BIGINT AS n_validation FROM embeddings GROUP BY 1""")
def validation_split(spark, sf):
    dealt = latent.validation_split(vectors(spark, sf), "vec_id", "label", 0.15)
    return dealt.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "validation").alias("n_validation"))


@query("latent_alignment", """SELECT 'f_balance' AS feature, 2 AS n_datasets, true AS shared UNION ALL SELECT 'f_nation', 1, false UNION ALL SELECT 'f_name', 1, false""")
def latent_alignment(spark, sf):
    from .queries import _two_tables

    return latent.align_features(spark, _two_tables(spark, sf)[1])[1]


@query("latent_clean", f"""WITH t AS (SELECT c_mktsegment AS Dataset, c_custkey AS Sample, c_acctbal AS a, CASE WHEN c_custkey % 4 <> 0 THEN length(c_name)::DOUBLE + c_custkey % 7 END AS b FROM customer),
m AS (SELECT Dataset, median(a) AS ma, median(b) AS mb FROM t GROUP BY 1), f AS (SELECT Dataset, Sample, coalesce(a, ma) AS a, coalesce(b, mb) AS b FROM t JOIN m USING (Dataset)),
q AS (SELECT median(a) AS ca, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS wa, median(b) AS cb, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS wb FROM f)
SELECT Dataset, Sample, {r('(a - ca) / CASE WHEN wa = 0 THEN 1 ELSE wa END')} AS a, {r('(b - cb) / CASE WHEN wb = 0 THEN 1 ELSE wb END')} AS b FROM f, q""")
def latent_clean(spark, sf):
    k = F.col("c_custkey")
    t = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("Dataset"), k.alias("Sample"), F.col("c_acctbal").alias("a"), F.when(k % 4 != 0, F.length("c_name").cast("double") + k % 7).alias("b"))
    return rounded(latent.clean_and_scale(t, ["a", "b"]).data.select("Dataset", "Sample", "a", "b"))


@query("synthetic_profiles")
def synthetic_profiles(spark, sf):
    return synthetic.synthetic_profiles(spark, synthetic.SyntheticConfig(n_compounds=table(spark, sf, "supplier").count()))


@query("strategy_ranking")
def strategy_ranking(spark, sf):
    """Strategies of scaling parts, by how well replicates of a brand agree and how far type and brand explain the first axis."""
    from wellframe.operators import stages

    k, names = F.col("p_partkey"), ["a", "b", "c", "d"]
    t = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"), (k % 97).cast("double").alias("c"), (k % 31).cast("double").alias("d"))
    made = {m: preprocess.scale(t, names, m) for m in ("none", "robust", "standard", "minmax")}
    made["centred"] = preprocess.batch_centre(made["standard"], names, ["p_type"], "mean")
    counts = stages.stage_replicate_counts(made, "p_partkey", ["p_brand"], names)
    agree = diagnostics.summary_of_counts(counts, ["stage"]).select("stage", F.col("median_correlation").alias("replicate_correlation"))
    eta = stages.stage_batches(made, ["p_type", "p_brand"], names, 1).groupBy("stage").pivot("metadata_column", ["p_type", "p_brand"]).agg(F.first("eta_squared"))
    reports = agree.join(eta, "stage").select(F.col("stage").alias("strategy"), F.lit(True).alias("matrix_ok"), F.lit("ok").alias("control_status"), "replicate_correlation", F.col("p_type").alias("batch_eta2"), F.col("p_brand").alias("compound_eta2"))
    return rounded(latent.rank_strategies(reports))


# ---------------------------------------------------------------- pseudo-anchors, neighbour runs


@query("pseudo_anchors")
def pseudo_anchors(spark, sf):
    v = vectors(spark, sf)
    known = v.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"))
    return anchors.make_pseudo_anchors(v, "vec_id", "embedding", (5, 10), known)[0]


@query("anchor_silhouettes")
def anchor_silhouettes(spark, sf):
    return anchors.silhouette_by_k(vectors(spark, sf), "vec_id", "embedding", (5, 10))


@query("cluster_bootstrap")
def cluster_bootstrap(spark, sf):
    return repeats.cluster_bootstrap(vectors(spark, sf), "vec_id", "embedding", 10)


@query("sub_centroids")
def sub_centroids(spark, sf):
    return anchors.sub_centroids(vectors(spark, sf), "vec_id", "embedding", "label")


@query("cluster_permutation")
def cluster_permutation(spark, sf):
    return repeats.cluster_permutation(vectors(spark, sf), "vec_id", "embedding", "label")


@query("neighbour_runs", f"""WITH {UNIT}, d AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, {COSINE} AS cosine, list_distance(a.e, b.e) AS unit_distance FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
x AS (SELECT query_id, neighbour_id FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cosine, neighbour_id) <= 10),
w AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) <= 10)
SELECT x.query_id, 'euclidean' AS run, count(w.neighbour_id) AS shared, {r('count(w.neighbour_id) / (20 - count(w.neighbour_id))')} AS jaccard FROM x LEFT JOIN w ON x.query_id = w.query_id AND x.neighbour_id = w.neighbour_id GROUP BY 1""")
def neighbour_runs(spark, sf):
    v = vectors(spark, sf)
    asked = v.where("vec_id % 100 = 0")
    lists = {m: distance.nearest(asked, "vec_id", "embedding", 10, m, base=v) for m in ("cosine", "euclidean")}
    return rounded(distance.overlap_of_runs(lists, "cosine"))


# ---------------------------------------------------------------- held-out retrieval, synthetic scenarios


@query("validation_retrieval", f"""WITH {UNIT}, d AS (SELECT a.vec_id AS q, a.label = b.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({COSINE}, 12), b.vec_id) AS rank FROM u a JOIN u b ON b.vec_id % 100 <> 0 WHERE a.vec_id % 100 = 0),
n AS (SELECT count(*) FILTER (vec_id % 100 <> 0) AS train, count(*) FILTER (vec_id % 100 = 0) AS held FROM embeddings)
SELECT 'validation_to_train_top1_same_label_rate' AS metric, {r('avg(same::INTEGER)')} AS value FROM d WHERE rank = 1 UNION ALL SELECT 'validation_to_train_mean_topk_same_label_rate', {r('avg(same::INTEGER)')} FROM d WHERE rank <= 5
UNION ALL SELECT 'validation_to_train_n_train_rows', train::DOUBLE FROM n UNION ALL SELECT 'validation_to_train_n_validation_rows', held::DOUBLE FROM n""")
def validation_retrieval(spark, sf):
    return rounded(holdout.validation_retrieval(vectors(spark, sf), "vec_id", "embedding", {"label": "label"}, F.col("vec_id") % 100 == 0)[0])


@query("compound_holdout")
def compound_holdout(spark, sf):
    v = vectors(spark, sf)
    named = v.withColumn("compound", F.concat_ws("_", F.col("label").cast("string"), (F.col("vec_id") % 3).cast("string")))
    return holdout.compound_holdout(named, "vec_id", "embedding", "compound", ["1_0", "2_1"], {"label": "label"})[0]


@query("scenario_summary")
def scenario_summary(spark, sf):
    from . import workflows

    compounds = table(spark, sf, "supplier").count()
    return workflows.synthetic_benchmark(spark, base=synthetic.SyntheticConfig(n_compounds=compounds)).data


@query("tree_importance")
def tree_importance(spark, sf):
    df, names = _flat(spark, sf)
    return models.tree_importance(df, names, "label")


@query("importance_by_family", f"""SELECT CASE WHEN lower(p_name) LIKE '%intensity%' THEN 'Intensity' WHEN lower(p_name) LIKE '%texture%' THEN 'Texture' ELSE 'Other' END AS family, count(*) AS n_features, {r('sum(p_retailprice)')} AS total_importance, {r('avg(p_retailprice)')} AS mean_importance FROM
(SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Cells_Intensity_' WHEN p_partkey % 3 = 1 THEN 'Cells_Texture_' ELSE 'Cells_' END || p_partkey AS p_name, p_retailprice FROM part) GROUP BY 1""")
def importance_by_family(spark, sf):
    key = F.col("p_partkey")
    kind = F.when(key % 3 == 0, "Cells_Intensity_").when(key % 3 == 1, "Cells_Texture_").otherwise("Cells_")
    return rounded(models.importance_by_family(table(spark, sf, "part").select(F.concat(kind, key.cast("string")).alias("feature"), F.col("p_retailprice").cast("double").alias("importance"))))
