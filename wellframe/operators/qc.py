"""Quality control of features and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellframe.functions.shapes import to_long
from wellframe.functions.stats import clean, median, quantile, robust_z


def column_inventory(df: DataFrame) -> DataFrame:
    """column, dtype, n_missing, missing_fraction, n_unique, is_numeric: one pass over the table."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    facts = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        missing = c.isNull() | F.isnan(c) if kind in ("float", "double") else c.isNull()
        facts.append(
            F.struct(
                F.lit(name).alias("column"), F.lit(kind).alias("dtype"), F.sum(missing.cast("bigint")).alias("n_missing"),
                F.avg(missing.cast("double")).alias("missing_fraction"), F.count_distinct(F.when(~missing, c)).alias("n_unique"),
                F.lit(kind in numeric or kind.startswith("decimal")).alias("is_numeric"),
            )
        )
    return df.agg(F.array(*facts).alias("facts")).select(F.explode("facts").alias("x")).select("x.*")


def feature_qc(df: DataFrame, features: Sequence[str], near_zero: float = 1e-12) -> DataFrame:
    """A row for each feature: missing, zero and finite fractions, variance (n-1), sd, median, MAD, n_unique, flags."""
    long = to_long(df, [], features)
    x = F.col("value")
    facts = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg(x.isNull().cast("double")).alias("missing_fraction"), F.var_samp(x).alias("variance"),
        F.stddev_samp(x).alias("sd"), median(x).alias("median"), F.count_distinct(x).alias("n_unique"),
        F.avg(F.coalesce((x == 0).cast("double"), F.lit(0.0))).alias("zero_fraction"),
        F.avg(F.coalesce((F.abs(x) < float("inf")).cast("double"), F.lit(0.0))).alias("finite_fraction"),
    )
    off = long.join(F.broadcast(facts.select("feature", F.col("median").alias("centre"))), "feature")
    mad = off.groupBy("feature").agg(median(F.abs(x - F.col("centre"))).alias("mad"))
    return facts.join(F.broadcast(mad), "feature").withColumn("near_zero_variance", F.coalesce(F.col("variance"), F.lit(0.0)) <= near_zero).withColumn(
        "all_missing", F.col("missing_fraction") >= 1
    )


def feature_summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """n, missing fraction, mean, median, sd, variance, MAD, min and max of each feature."""
    x = F.col("value")
    more = to_long(df, [], features).groupBy("feature").agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    return feature_qc(df, features).select("feature", "n", "missing_fraction", "median", "sd", "variance", "mad").join(more, "feature")


def select_features(qc: DataFrame, max_missing: float = 0.2, min_variance: float = 1e-12, min_unique: int = 2, max_zero: float = 1.0) -> DataFrame:
    """Adds four tests and ``keep``, their conjunction. The variance test is strict, the others are not."""
    return (
        qc.withColumn("keep_missing", F.col("missing_fraction") <= max_missing)
        .withColumn("keep_variance", F.coalesce(F.col("variance"), F.lit(0.0)) > min_variance)
        .withColumn("keep_unique", F.col("n_unique") >= min_unique)
        .withColumn("keep_zero", F.col("zero_fraction") <= max_zero)
        .withColumn("keep", F.col("keep_missing") & F.col("keep_variance") & F.col("keep_unique") & F.col("keep_zero"))
    )


def n_missing(features: Sequence[str]) -> Column:
    return sum((clean(F.col(f), float("inf")).isNull().cast("int") for f in features), F.lit(0))


def sample_qc(df: DataFrame, features: Sequence[str], max_missing: float = 0.5) -> DataFrame:
    """Adds n_missing, missing_fraction and keep_sample to each row; no shuffle."""
    n = n_missing(features)
    return df.withColumn("n_missing", n).withColumn("missing_fraction", F.col("n_missing") / len(features)).withColumn("keep_sample", F.col("missing_fraction") <= max_missing)


def zero_rows(df: DataFrame, features: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Adds n_observed, n_zero, n_nonzero and all_zero (something observed, nothing beyond the tolerance)."""
    values = [clean(F.col(f), float("inf")) for f in features]
    observed = sum((v.isNotNull().cast("int") for v in values), F.lit(0))
    zero = sum((F.coalesce((F.abs(v) <= tolerance).cast("int"), F.lit(0)) for v in values), F.lit(0))
    df = df.withColumn("n_observed", observed).withColumn("n_zero", zero).withColumn("n_nonzero", observed - zero)
    return df.withColumn("all_zero", (F.col("n_observed") > 0) & (F.col("n_nonzero") == 0))


def nonfinite_report(df: DataFrame, features: Sequence[str], largest: float = 1e10) -> DataFrame:
    """How many infinite and how many too large values of each feature become missing."""
    facts = []
    for f in features:
        x = F.col(f).cast("double")
        infinite = F.coalesce((F.abs(x) == float("inf")).cast("bigint"), F.lit(0))
        large = F.coalesce(((F.abs(x) > largest) & (F.abs(x) < float("inf")) & ~F.isnan(x)).cast("bigint"), F.lit(0))
        facts.append(F.struct(F.lit(f).alias("feature"), F.sum(infinite).alias("n_infinite"), F.sum(large).alias("n_too_large")))
    return df.agg(F.array(*facts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def replace_nonfinite(df: DataFrame, features: Sequence[str], largest: float = 1e10) -> DataFrame:
    return df.withColumns({f: clean(F.col(f), largest) for f in features})


def outliers(df: DataFrame, metrics: Sequence[str], groups: Sequence[str] = (), threshold: float = 5.0) -> DataFrame:
    """Adds ``METRIC_robust_z`` and ``METRIC_outlier`` for each metric, within the groups.

    Medians and MADs are small tables by group that are joined back, so a group is
    never gathered in one window task.
    """
    for m in metrics:
        df = with_centre(df, m, groups, "__c", "__mad")
        z = robust_z(F.col(m).cast("double"), F.col("__c"), F.col("__mad"))
        df = df.withColumn(f"{m}_robust_z", z).withColumn(f"{m}_outlier", F.coalesce(F.abs(z) > threshold, F.lit(False))).drop("__c", "__mad")
    return df


def with_centre(df: DataFrame, metric: str, groups: Sequence[str], centre: str, mad: str) -> DataFrame:
    x = F.col(metric).cast("double")
    df = join_groups(df, df.groupBy(*groups).agg(median(x).alias(centre)), groups)
    spread = df.groupBy(*groups).agg(median(F.abs(x - F.col(centre))).alias(mad))
    return join_groups(df, spread, groups)


def join_groups(df: DataFrame, small: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Joins a table of one row a group back; NULL groups match each other."""
    if not groups:
        return df.crossJoin(F.broadcast(small))
    renamed = small.withColumnsRenamed({g: f"__g_{g}" for g in groups})
    on = None
    for g in groups:
        c = F.col(g).eqNullSafe(F.col(f"__g_{g}"))
        on = c if on is None else on & c
    return df.join(renamed, on, "left").drop(*[f"__g_{g}" for g in groups])


def qc_summary(feature_table: DataFrame, sample_table: DataFrame) -> DataFrame:
    """Four counts: features, near-constant features, rows, rows with something missing."""
    f = feature_table.agg(F.count(F.lit(1)).alias("n_features"), F.sum(F.col("near_zero_variance").cast("bigint")).alias("n_near_zero_variance"))
    s = sample_table.agg(F.count(F.lit(1)).alias("n_samples"), F.sum((F.col("n_missing") > 0).cast("bigint")).alias("n_samples_with_missing"))
    return f.crossJoin(s).unpivot([], ["n_features", "n_near_zero_variance", "n_samples", "n_samples_with_missing"], "metric", "value")


def image_summary(df: DataFrame, image: str, features: Sequence[str]) -> DataFrame:
    """image, feature, q1, median, q3 and count, over objects."""
    x = F.col("value")
    long = to_long(df, [image], features)
    return long.groupBy(image, "feature").agg(quantile(x, 0.25).alias("q1"), median(x).alias("median"), quantile(x, 0.75).alias("q3"), F.count(x).alias("n"))


def row_number_over(part: Sequence[str], order: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*part).orderBy(*order))
