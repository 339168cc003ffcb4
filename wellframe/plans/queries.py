"""Queries by name over the fixed tables, each with the SQL that says the same.

The tables stand in for profiling data: ``lineitem`` for objects (image number
l_orderkey), ``orders`` for images (plate o_orderpriority, batch o_orderstatus),
``part`` for compounds, ``events`` for acquisition order, ``embeddings`` for latent
vectors. Floating results are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wellframe.functions import stats, text
from wellframe.operators import diagnostics, distance, keys, moa, models, preprocess, profiles, qc
from wellframe.sources import tables as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

OBJECT_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FEATURES = ["quantity", "price", "discount", "tax"]
DIGITS = 6


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; minus zero becomes zero."""
    return df.select(*[(F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def r(expression: str) -> str:
    return f"round({expression}, {DIGITS}) + 0.0"


def object_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """image, plate, batch, the four medians (0 discount and tax as missing) and n_objects."""
    objects = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.nullif("l_tax", F.lit(0.0)).alias("tax")
    )
    images = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderpriority").alias("plate"), F.col("o_orderstatus").alias("batch"))
    made = profiles.aggregate(objects, ["image"], FEATURES)
    return images.join(made, "image", "left")


PROFILES = """
objects AS (SELECT l_orderkey AS image, l_quantity AS quantity, l_extendedprice AS price, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax FROM lineitem),
made AS (SELECT image, median(quantity) AS quantity, median(price) AS price, median(discount) AS discount, median(tax) AS tax, count(*) AS n_objects FROM objects GROUP BY image),
profiles AS (SELECT o_orderkey AS image, o_orderpriority AS plate, o_orderstatus AS batch, quantity, price, discount, tax, n_objects FROM orders LEFT JOIN made ON o_orderkey = image),
long AS (SELECT image, plate, batch, feature, value FROM (
  SELECT image, plate, batch, 'quantity' AS feature, quantity AS value FROM profiles UNION ALL SELECT image, plate, batch, 'price', price FROM profiles
  UNION ALL SELECT image, plate, batch, 'discount', discount FROM profiles UNION ALL SELECT image, plate, batch, 'tax', tax FROM profiles))
"""


def with_profiles(body: str) -> str:
    return f"WITH {PROFILES} {body}"


def each(template: str, names: list[str] = FEATURES, sep: str = ", ") -> str:
    return sep.join(template.replace("$", f) for f in names)


# ---------------------------------------------------------------- profiles and joins


@query("profile_build_median", with_profiles(f"SELECT image, plate, batch, {each(r('$') + ' AS $')}, n_objects FROM profiles"))
def profile_build_median(spark, sf):
    return rounded(object_profiles(spark, sf))


@query("profile_build_mean", f"SELECT l_orderkey AS ImageNumber, {each(r('avg($)') + ' AS cells__$', OBJECT_FEATURES)}, count(*) AS cells__n_objects FROM lineitem GROUP BY l_orderkey")
def profile_build_mean(spark, sf):
    objects = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "ImageNumber")
    return rounded(profiles.aggregate_objects(objects, "cells", ["ImageNumber"], OBJECT_FEATURES, "mean"))


@query("profile_object_join", f"""
WITH a AS (SELECT l_orderkey, {each('median($) AS $', OBJECT_FEATURES)}, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS ImageNumber, o_orderpriority AS Metadata_Plate, {each(r('$') + ' AS cells__$', OBJECT_FEATURES)}, n AS cells__n_objects FROM orders LEFT JOIN a ON o_orderkey = l_orderkey""")
def profile_object_join(spark, sf):
    images = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ImageNumber"), F.col("o_orderpriority").alias("Metadata_Plate"))
    objects = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "ImageNumber")
    return rounded(profiles.build_profiles(images, {"cells": (objects, OBJECT_FEATURES)}, ["ImageNumber"]))


@query("profile_by_compound", """
WITH p AS (SELECT p_brand, p_size, p_retailprice, p_type FROM part),
m AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS k FROM p GROUP BY 1, 2)
SELECT p.p_brand, round(median(p_size::DOUBLE), 6) + 0.0 AS p_size, round(median(p_retailprice), 6) + 0.0 AS p_retailprice, any_value(m.p_type) AS p_type, count(*) AS n_replicates
FROM p JOIN m ON p.p_brand = m.p_brand AND k = 1 GROUP BY 1""")
def profile_by_compound(spark, sf):
    return rounded(profiles.aggregate_by_id(table(spark, sf, "part"), "p_brand", ["p_size", "p_retailprice"], ["p_type"]))


@query("key_propagation", "SELECT l_orderkey, l_linenumber, l_quantity, o_orderpriority AS Metadata_Plate FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def key_propagation(spark, sf):
    objects = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    images = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("Metadata_Plate"))
    stamped, _ = keys.propagate_keys(objects, images, "l_orderkey", ["Metadata_Plate"])
    return stamped


@query("key_ambiguity_report", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_values, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def key_ambiguity_report(spark, sf):
    return keys.key_mapping(table(spark, sf, "orders"), "o_custkey", ["o_orderpriority"]).where("n_values > 1")


@query("metadata_left_join", """
SELECT o_orderkey, o_custkey, c_mktsegment, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def metadata_left_join(spark, sf):
    out = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey")
    region = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    out = keys.join_checked(out, customer, ["o_custkey"], "customer")
    out = keys.join_checked(out, nation, ["c_nationkey"], "nation")
    return keys.join_checked(out, region, ["n_regionkey"], "region").drop("c_nationkey", "n_regionkey")


@query("annotation_merge_unmatched", "SELECT count(*) AS n_unmatched FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def annotation_merge_unmatched(spark, sf):
    some = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return keys.unmatched_count(table(spark, sf, "orders"), some, ["o_custkey"])


@query("duplicate_key_report", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem)
SELECT l_orderkey, l_linenumber, count(*) AS n_rows,
 concat_ws(',', CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'l_returnflag' END, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'l_linestatus' END) AS conflicting_columns
FROM t GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_key_report(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return keys.duplicate_key_report(t, ["l_orderkey", "l_linenumber"])


@query("duplicate_totals", "SELECT sum(n)::BIGINT AS n_duplicate_rows, count(*) AS n_duplicate_keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicate_totals(spark, sf):
    return keys.duplicate_totals(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("collapse_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (
 SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) AS k FROM lineitem) WHERE k = 1""")
def collapse_first(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return keys.collapse_duplicates(t, ["l_orderkey", "l_linenumber"], "first", ["l_partkey", "l_quantity"])


@query("collapse_identical", "SELECT DISTINCT l_returnflag, l_linestatus, l_returnflag || l_linestatus AS both_flags FROM lineitem")
def collapse_identical(spark, sf):
    t = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", F.concat("l_returnflag", "l_linestatus").alias("both_flags"))
    return keys.collapse_duplicates(t, ["l_returnflag", "l_linestatus"], "identical")


@query("key_validation", """
WITH a AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber), b AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey)
SELECT 'line' AS family, CASE WHEN max(n) > 1 THEN 'review' ELSE 'ok' END AS status, count(*) AS n_keys, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_duplicate_rows, 0::BIGINT AS n_incomplete_rows FROM a
UNION ALL SELECT 'part', CASE WHEN max(n) > 1 THEN 'review' ELSE 'ok' END, count(*), coalesce(sum(n) FILTER (n > 1), 0)::BIGINT, 0 FROM b UNION ALL SELECT 'well', 'missing', 0, 0, 0""")
def key_validation(spark, sf):
    return keys.validate_keys(table(spark, sf, "lineitem"), {"line": ["l_orderkey", "l_linenumber"], "part": ["l_orderkey", "l_partkey", "l_suppkey"], "well": ["Metadata_Well"]})


@query("key_candidate_report", " UNION ALL ".join(
    f"SELECT '{','.join(c)}' AS key_columns, {len(c)} AS n_columns, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_duplicate_rows, count(*) FILTER (n > 1) AS n_duplicate_keys, coalesce(max(n), 0) <= 1 AS is_unique "
    f"FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(c)})"
    for c in (["l_orderkey"], ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_partkey"], ["l_orderkey", "l_linenumber", "l_partkey"])))
def key_candidate_report(spark, sf):
    return keys.key_candidates(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"])


def _two_tables(spark, sf) -> tuple[dict[str, DataFrame], dict[str, list[str]]]:
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("f_balance"), F.col("s_nationkey").cast("double").alias("f_nation"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("f_balance"), F.length("c_name").cast("double").alias("f_name"))
    return {"supplier": a, "customer": b}, {"supplier": ["f_balance", "f_nation"], "customer": ["f_balance", "f_name"]}


@query("combine_union", """
SELECT s_suppkey AS id, s_acctbal AS f_balance, s_nationkey::DOUBLE AS f_nation, NULL::DOUBLE AS f_name, 'supplier' AS Metadata_Profile_Source FROM supplier
UNION ALL SELECT c_custkey, c_acctbal, NULL, length(c_name)::DOUBLE, 'customer' FROM customer""")
def combine_union(spark, sf):
    return keys.combine_tables(*_two_tables(spark, sf))


@query("combine_intersection", """
SELECT s_suppkey AS id, s_acctbal AS f_balance, 'supplier' AS Metadata_Profile_Source FROM supplier UNION ALL SELECT c_custkey, c_acctbal, 'customer' FROM customer""")
def combine_intersection(spark, sf):
    return keys.combine_tables(*_two_tables(spark, sf), how="intersection")


# ---------------------------------------------------------------- roles, names, wells


def _inventory_sql() -> str:
    kinds = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"}
    numeric = lambda k: str(k in ("bigint", "double")).lower()
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS dtype, (count(*) - count({c})) AS n_missing, 1 - count({c}) / count(*) AS missing_fraction, count(DISTINCT {c}) AS n_unique, {numeric(k)} AS is_numeric FROM orders"
        for c, k in kinds.items()
    )


@query("column_inventory", _inventory_sql())
def column_inventory(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return qc.column_inventory(t.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")))


@query("column_roles")
def column_roles(spark, sf):
    t = table(spark, sf, "lineitem").withColumnsRenamed({"l_orderkey": "ImageNumber", "l_linenumber": "ObjectNumber", "l_quantity": "Cells_Intensity_Quantity", "l_tax": "Nuclei_Texture_Tax", "l_discount": "Count_Discount"})
    return spark.createDataFrame(sources.column_roles(t), "column string, role string")


@query("table_roles")
def table_roles(spark, sf):
    names = ("lineitem", "orders", "customer", "part", "events", "embeddings")
    return spark.createDataFrame([(n, *sources.table_role(n, table(spark, sf, n).columns)) for n in names], "table string, role string, reason string")


WELL_TEXT = "chr(65 + (p_size % 8)::INT) || p_size::VARCHAR"


def _wells(spark, sf) -> DataFrame:
    t = table(spark, sf, "part")
    return t.select("p_partkey", "p_size", F.concat(F.char((F.col("p_size") % 8 + 65).cast("int")), F.col("p_size").cast("string")).alias("well"))


@query("well_canonical", f"""
WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN lower({WELL_TEXT}) WHEN p_partkey % 7 = 0 THEN ' ' || {WELL_TEXT} || ' ' WHEN p_partkey % 11 = 0 THEN 'control' ELSE {WELL_TEXT} END AS raw FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(trim(raw), '^[A-Za-z]0*[0-9]{{1,2}}$') THEN upper(substr(trim(raw), 1, 1)) || lpad(regexp_extract(trim(raw), '^[A-Za-z]0*([0-9]{{1,2}})$', 1), 2, '0') ELSE trim(raw) END AS well FROM t""")
def well_canonical(spark, sf):
    w, k = F.col("well"), F.col("p_partkey")
    raw = F.when(k % 5 == 0, F.lower(w)).when(k % 7 == 0, F.concat(F.lit(" "), w, F.lit(" "))).when(k % 11 == 0, "control").otherwise(w)
    return _wells(spark, sf).select("p_partkey", text.canonical_well(raw).alias("well"))


@query("plate_position", f"SELECT p_partkey, chr(65 + (p_size % 8)::INT) AS plate_row, p_size::INTEGER AS plate_column, chr(65 + (p_size % 8)::INT) || lpad(p_size::VARCHAR, 2, '0') AS well FROM part")
def plate_position(spark, sf):
    return diagnostics.plate_positions(_wells(spark, sf).drop("p_size"), "well").select("p_partkey", "plate_row", "plate_column", "well")


@query("derive_well", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Z9' ELSE chr(65 + (p_size % 8)::INT) || lpad(p_size::VARCHAR, 2, '0') END AS well FROM part")
def derive_well(spark, sf):
    t = table(spark, sf, "part")
    known = F.when(F.col("p_partkey") % 3 == 0, "Z9").when(F.col("p_partkey") % 3 == 1, " ")
    row = F.lower(F.char((F.col("p_size") % 8 + 65).cast("int")))
    return t.select("p_partkey", text.derived_well(known, row, F.col("p_size")).alias("well"))


@query("well_of_index", "SELECT p_partkey, chr(65 + ((p_partkey % 384) // 24)::INT) || lpad((p_partkey % 24 + 1)::VARCHAR, 2, '0') AS well FROM part")
def well_of_index(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.well_of_index(F.col("p_partkey")).alias("well"))


# ---------------------------------------------------------------- quality control


@query("feature_qc", with_profiles(f"""
, c AS (SELECT feature, median(value) AS m FROM long GROUP BY 1),
d AS (SELECT feature, median(abs(value - m)) AS mad FROM long JOIN c USING (feature) GROUP BY 1)
SELECT feature, count(*) AS n, {r('1 - count(value) / count(*)')} AS missing_fraction, {r('var_samp(value)')} AS variance, {r('stddev_samp(value)')} AS sd, {r('median(value)')} AS median,
 count(DISTINCT value) AS n_unique, {r('count(*) FILTER (value = 0) / count(*)')} AS zero_fraction, {r('count(value) / count(*)')} AS finite_fraction, {r('any_value(mad)')} AS mad,
 coalesce(var_samp(value), 0) <= 1e-12 AS near_zero_variance, count(value) = 0 AS all_missing FROM long JOIN d USING (feature) GROUP BY feature"""))
def feature_qc(spark, sf):
    return rounded(qc.feature_qc(object_profiles(spark, sf), FEATURES))


@query("feature_selection", with_profiles("""
SELECT feature, 1 - count(value) / count(*) <= 0.1 AS keep_missing, var_samp(value) > 1e-12 AS keep_variance, count(DISTINCT value) >= 2 AS keep_unique, true AS keep_zero,
 1 - count(value) / count(*) <= 0.1 AND var_samp(value) > 1e-12 AND count(DISTINCT value) >= 2 AS keep FROM long GROUP BY feature"""))
def feature_selection(spark, sf):
    chosen = qc.select_features(qc.feature_qc(object_profiles(spark, sf), FEATURES), max_missing=0.1)
    return chosen.select("feature", "keep_missing", "keep_variance", "keep_unique", "keep_zero", "keep")


MISSING = "(" + each("($ IS NULL)::INT", sep=" + ") + ")"


@query("sample_qc", with_profiles(f"SELECT image, {MISSING} AS n_missing, {MISSING} / 4 AS missing_fraction, {MISSING} / 4 <= 0.5 AS keep_sample FROM profiles"))
def sample_qc(spark, sf):
    return qc.sample_qc(object_profiles(spark, sf), FEATURES).select("image", "n_missing", "missing_fraction", "keep_sample")


@query("all_zero_rows", """
SELECT l_orderkey, l_linenumber, l_discount, l_tax, 2 AS n_observed, (l_discount = 0)::INT + (l_tax = 0)::INT AS n_zero, 2 - (l_discount = 0)::INT - (l_tax = 0)::INT AS n_nonzero, l_discount = 0 AND l_tax = 0 AS all_zero FROM lineitem""")
def all_zero_rows(spark, sf):
    return qc.zero_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_discount", "l_tax"])


@query("nonfinite_report", "SELECT 'l_quantity' AS feature, count(*) FILTER (l_quantity = 1) AS n_infinite, count(*) FILTER (l_quantity = 2) AS n_too_large FROM lineitem")
def nonfinite_report(spark, sf):
    q = F.col("l_quantity")
    t = table(spark, sf, "lineitem").select(F.when(q == 1, float("-inf")).when(q == 2, 2e10).when(q == 3, float("nan")).otherwise(q).alias("l_quantity"))
    return qc.nonfinite_report(t, ["l_quantity"])


@query("robust_z_outliers", with_profiles(f"""
, c AS (SELECT plate, median(price) AS m FROM profiles GROUP BY 1), d AS (SELECT plate, any_value(m) AS m, median(abs(price - m)) AS mad FROM profiles JOIN c USING (plate) GROUP BY plate)
SELECT image, {r('0.6745 * (price - m) / greatest(mad, 1e-12)')} AS price_robust_z, coalesce(abs(0.6745 * (price - m) / greatest(mad, 1e-12)) > 2, false) AS price_outlier FROM profiles JOIN d USING (plate)"""))
def robust_z_outliers(spark, sf):
    found = qc.outliers(object_profiles(spark, sf), ["price"], ["plate"], 2.0)
    return rounded(found.select("image", "price_robust_z", "price_outlier"))


@query("per_image_summary", f"""
SELECT l_orderkey, 'l_quantity' AS feature, {r('quantile_cont(l_quantity, 0.25)')} AS q1, {r('median(l_quantity)')} AS median, {r('quantile_cont(l_quantity, 0.75)')} AS q3, count(*) AS n FROM lineitem GROUP BY 1""")
def per_image_summary(spark, sf):
    return rounded(qc.image_summary(table(spark, sf, "lineitem"), "l_orderkey", ["l_quantity"]))


@query("qc_summary", with_profiles(f"""
SELECT 'n_features' AS metric, 4::BIGINT AS value UNION ALL SELECT 'n_near_zero_variance', 0 UNION ALL SELECT 'n_samples', count(*) FROM profiles UNION ALL SELECT 'n_samples_with_missing', count(*) FROM profiles WHERE {MISSING} > 0"""))
def qc_summary(spark, sf):
    p = object_profiles(spark, sf)
    return qc.qc_summary(qc.feature_qc(p, FEATURES), qc.sample_qc(p, FEATURES))


# ---------------------------------------------------------------- preprocessing


@query("winsorise", with_profiles(f"""
, q AS (SELECT quantile_cont(price, 0.05) AS a, quantile_cont(price, 0.95) AS b FROM profiles)
SELECT image, {r('CASE WHEN price IS NOT NULL THEN least(greatest(price, a), b) END')} AS price FROM profiles, q"""))
def winsorise(spark, sf):
    return rounded(preprocess.winsorise(object_profiles(spark, sf).select("image", "price"), ["price"], 0.05, 0.95))


@query("winsorise_report", with_profiles(f"""
, q AS (SELECT feature, quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM long GROUP BY 1)
SELECT feature, {r('a')} AS low, {r('b')} AS high, count(*) FILTER (value < a) AS n_low, count(*) FILTER (value > b) AS n_high FROM long JOIN q USING (feature) GROUP BY 1, a, b"""))
def winsorise_report(spark, sf):
    return rounded(preprocess.winsorise_report(object_profiles(spark, sf), FEATURES, 0.05, 0.95))


@query("impute_median", with_profiles(f"""
, m AS (SELECT {each('median($) AS m_$')} FROM profiles) SELECT image, {each(r('coalesce($, m_$)') + ' AS $')} FROM profiles, m"""))
def impute_median(spark, sf):
    return rounded(preprocess.impute(object_profiles(spark, sf), FEATURES).select("image", *FEATURES))


@query("impute_group_median", with_profiles(f"""
, g AS (SELECT plate, {each('median($) AS g_$')} FROM profiles GROUP BY 1), m AS (SELECT {each('median($) AS m_$')} FROM profiles)
SELECT image, {each(r('coalesce($, g_$, m_$)') + ' AS $')} FROM profiles JOIN g USING (plate), m"""))
def impute_group_median(spark, sf):
    return rounded(preprocess.impute(object_profiles(spark, sf), FEATURES, "group_median", ["plate"]).select("image", *FEATURES))


@query("imputation_summary", with_profiles(f"""
, m AS (SELECT feature, median(value) AS m FROM long GROUP BY 1)
SELECT feature, count(*) FILTER (value IS NULL) AS before_missing, {r('median(value)')} AS before_median, {r('stddev_samp(value)')} AS before_sd, 0::BIGINT AS after_missing,
 {r('median(coalesce(value, m))')} AS after_median, {r('stddev_samp(coalesce(value, m))')} AS after_sd FROM long JOIN m USING (feature) GROUP BY feature"""))
def imputation_summary(spark, sf):
    p = object_profiles(spark, sf)
    return rounded(preprocess.imputation_summary(p, preprocess.impute(p, FEATURES), FEATURES))


@query("missing_indicators", with_profiles("SELECT image, (discount IS NULL)::INT AS MissingIndicator__discount, (tax IS NULL)::INT AS MissingIndicator__tax FROM profiles"))
def missing_indicators(spark, sf):
    p = object_profiles(spark, sf).select("image", "discount", "tax")
    return preprocess.missing_indicators(p, ["discount", "tax"]).select("image", "MissingIndicator__discount", "MissingIndicator__tax")


def _reference(method: str, scale: str) -> str:
    centre = "avg" if method == "zscore" else "median"
    return with_profiles(f"""
, ref AS (SELECT * FROM profiles WHERE batch = 'F'),
c AS (SELECT plate, count(*) AS n, {each(f'{centre}($) AS c_$')} FROM ref GROUP BY 1),
s AS (SELECT plate, {each(scale + ' AS s_$')} FROM ref JOIN c USING (plate) GROUP BY plate)
SELECT image, plate, {each(r('CASE WHEN n >= 2 AND c_$ IS NOT NULL THEN ' + ('$ - c_$' if method == 'median_center' else '($ - c_$) / CASE WHEN abs(s_$) >= 1e-9 THEN s_$ ELSE 1 END') + ' ELSE $ END') + ' AS $')}
FROM profiles LEFT JOIN c USING (plate) LEFT JOIN s USING (plate)""")


def _referenced(spark, sf, method: str) -> DataFrame:
    out = preprocess.reference_normalise(object_profiles(spark, sf), FEATURES, F.col("batch") == "F", ["plate"], method)
    return rounded(out.select("image", "plate", *FEATURES))


@query("reference_robust_z", _reference("robust_z", "median(abs($ - c_$))"))
def reference_robust_z(spark, sf):
    return _referenced(spark, sf, "robust_z")


@query("reference_zscore", _reference("zscore", "stddev_samp($)"))
def reference_zscore(spark, sf):
    return _referenced(spark, sf, "zscore")


@query("reference_median_center", _reference("median_center", "median($)"))
def reference_median_center(spark, sf):
    return _referenced(spark, sf, "median_center")


@query("reference_control_qc", with_profiles(f"""
, ref AS (SELECT * FROM long WHERE batch = 'F'), c AS (SELECT plate, feature, median(value) AS m, avg((value IS NULL)::INT) AS missing FROM ref GROUP BY 1, 2),
d AS (SELECT plate, feature, any_value(missing) AS missing, median(abs(value - m)) AS mad FROM ref JOIN c USING (plate, feature) GROUP BY plate, feature),
g AS (SELECT plate, count(*) FILTER (mad <= 1e-8) AS n_flat_features, median(missing) AS missing FROM d GROUP BY 1),
n AS (SELECT plate, count(*) AS n_profiles, count(*) FILTER (batch = 'F') AS n_reference FROM profiles GROUP BY 1)
SELECT plate, n_profiles, n_reference, n_flat_features, {r('missing')} AS median_missing_fraction, {r('n_reference / n_profiles')} AS reference_fraction,
 CASE WHEN n_reference = 0 THEN 'no_reference' WHEN n_reference < 2 THEN 'too_few' WHEN n_flat_features > 0 THEN 'review' ELSE 'ok' END AS status FROM n LEFT JOIN g USING (plate)"""))
def reference_control_qc(spark, sf):
    return rounded(preprocess.reference_qc(object_profiles(spark, sf), FEATURES, F.col("batch") == "F", ["plate"]))


@query("batch_median_center", with_profiles(f"""
, m AS (SELECT batch, {each('median($) AS m_$')} FROM profiles GROUP BY 1) SELECT image, {each(r('$ - m_$') + ' AS $')} FROM profiles JOIN m USING (batch)"""))
def batch_median_center(spark, sf):
    return rounded(preprocess.batch_centre(object_profiles(spark, sf), FEATURES, ["batch"]).select("image", *FEATURES))


@query("location_scale_correction", with_profiles(f"""
, b AS (SELECT batch, count(*) AS n, {each('avg($) AS m_$, stddev_samp($) AS s_$')} FROM profiles GROUP BY 1), g AS (SELECT {each('avg($) AS gm_$, stddev_samp($) AS gs_$')} FROM profiles)
SELECT image, {each(r('CASE WHEN n >= 3 THEN ($ - m_$) / CASE WHEN s_$ > 1e-8 THEN s_$ ELSE 1 END * gs_$ + gm_$ ELSE $ END') + ' AS $')} FROM profiles JOIN b USING (batch), g"""))
def location_scale_correction(spark, sf):
    return rounded(preprocess.location_scale(object_profiles(spark, sf), FEATURES, "batch").select("image", *FEATURES))


@query("batch_confounding", with_profiles("""
, p AS (SELECT DISTINCT batch AS b, plate AS v FROM profiles), l AS (SELECT count(*) AS n_labels, count(*) FILTER (n = 1) AS n_labels_in_one_batch FROM (SELECT count(*) AS n FROM p GROUP BY v)),
k AS (SELECT count(*) AS n_batches, count(*) FILTER (n = 1) AS n_batches_of_one_label FROM (SELECT count(*) AS n FROM p GROUP BY b))
SELECT 'plate' AS protected_column, n_labels, n_batches, n_labels_in_one_batch, n_batches_of_one_label,
 CASE WHEN (n_labels_in_one_batch = n_labels OR n_batches_of_one_label = n_batches) AND n_batches > 1 THEN 'high_risk' WHEN (n_labels_in_one_batch > 0 OR n_batches_of_one_label > 0) AND n_batches > 1 THEN 'review' ELSE 'ok' END AS status FROM l, k"""))
def batch_confounding(spark, sf):
    return preprocess.batch_confounding(object_profiles(spark, sf), "batch", ["plate"])


def _scaled(centre: str, width: str) -> str:
    return with_profiles(f"""
, m AS (SELECT {each(centre + ' AS c_$, ' + width + ' AS w_$')} FROM profiles) SELECT image, {each(r('($ - c_$) / CASE WHEN w_$ = 0 THEN 1 ELSE w_$ END') + ' AS $')} FROM profiles, m""")


@query("scale_robust", _scaled("median($)", "quantile_cont($, 0.75) - quantile_cont($, 0.25)"))
def scale_robust(spark, sf):
    return rounded(preprocess.scale(object_profiles(spark, sf), FEATURES, "robust").select("image", *FEATURES))


@query("scale_standard", _scaled("avg($)", "stddev_pop($)"))
def scale_standard(spark, sf):
    return rounded(preprocess.scale(object_profiles(spark, sf), FEATURES, "standard").select("image", *FEATURES))


@query("scale_minmax", _scaled("min($)", "max($) - min($)"))
def scale_minmax(spark, sf):
    return rounded(preprocess.scale(object_profiles(spark, sf), FEATURES, "minmax").select("image", *FEATURES))


PAIRS = [(a, b) for i, a in enumerate(OBJECT_FEATURES) for b in OBJECT_FEATURES[i + 1 :]]


@query("corr_matrix_pearson", " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({a}, {b})')} AS correlation FROM lineitem" for a, b in PAIRS))
def corr_matrix_pearson(spark, sf):
    return rounded(preprocess.correlation_pairs(table(spark, sf, "lineitem"), OBJECT_FEATURES))


@query("corr_matrix_spearman", "WITH t AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2 AS {f}" for f in OBJECT_FEATURES) + " FROM lineitem) "
       + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r(f'corr({a}, {b})')} AS correlation FROM t" for a, b in PAIRS))
def corr_matrix_spearman(spark, sf):
    return rounded(preprocess.correlation_pairs(table(spark, sf, "lineitem").select(*OBJECT_FEATURES), OBJECT_FEATURES, "spearman"))


@query("object_trim_q95", f"""
WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS g, o_totalprice AS a, o_custkey::DOUBLE AS b FROM orders),
l AS (SELECT id, g, 'a' AS f, a AS v FROM o UNION ALL SELECT id, g, 'b', b FROM o), c AS (SELECT g, f, median(v) AS m FROM l GROUP BY 1, 2),
d AS (SELECT g, f, any_value(m) AS m, median(abs(v - m)) AS mad FROM l JOIN c USING (g, f) GROUP BY g, f),
s AS (SELECT id, g, quantile_cont(abs((v - m) / mad), 0.95) AS score FROM l JOIN d USING (g, f) GROUP BY id, g), t AS (SELECT g, quantile_cont(score, 0.9) AS threshold FROM s GROUP BY g)
SELECT id, g, {r('score')} AS score, {r('threshold')} AS threshold, score <= threshold AS keep_object FROM s JOIN t USING (g)""")
def object_trim_q95(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b"))
    return rounded(profiles.trim_objects(o, "id", ["g"], ["a", "b"]).select("id", "g", "score", "threshold", "keep_object"))


@query("object_trim_l2", f"""
WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS g, o_totalprice AS a, o_custkey::DOUBLE AS b FROM orders),
l AS (SELECT id, g, 'a' AS f, a AS v FROM o UNION ALL SELECT id, g, 'b', b FROM o), c AS (SELECT g, f, median(v) AS m FROM l GROUP BY 1, 2),
d AS (SELECT g, f, any_value(m) AS m, median(abs(v - m)) AS mad FROM l JOIN c USING (g, f) GROUP BY g, f),
s AS (SELECT id, g, sqrt(avg(pow((v - m) / mad, 2))) AS score FROM l JOIN d USING (g, f) GROUP BY id, g), t AS (SELECT g, quantile_cont(score, 0.9) AS threshold FROM s GROUP BY g)
SELECT id, g, {r('score')} AS score, {r('threshold')} AS threshold, score <= threshold AS keep_object FROM s JOIN t USING (g)""")
def object_trim_l2(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("a"), F.col("o_custkey").cast("double").alias("b"))
    return rounded(profiles.trim_objects(o, "id", ["g"], ["a", "b"], metric="l2").select("id", "g", "score", "threshold", "keep_object"))


def queries() -> dict[str, Query]:
    from . import queries_analysis, queries_classes, queries_stages  # noqa: F401  register their queries

    return QUERIES


def oracle_sql() -> dict[str, str]:
    from . import queries_analysis, queries_classes, queries_stages  # noqa: F401

    return {k: fixed(v) for k, v in SQL.items()}


def fixed(sql: str) -> str:
    """WITH lists that go on behind the shared part begin with a comma there."""
    import re

    return re.sub(r"\)\)\s*\n\s*,\s*", ")),\n", sql)
