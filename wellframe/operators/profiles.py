"""From object tables to profiles: trimming, aggregation, joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.functions.shapes import to_long
from wellframe.functions.stats import median, quantile

from .keys import same_keys
from .qc import join_groups


def aggregate(df: DataFrame, groups: Sequence[str], features: Sequence[str], statistic: str = "median", count: str = "n_objects", prefix: str = "") -> DataFrame:
    """Median or mean of each feature and the number of rows by group; NULL groups are kept, missing values skipped."""
    make = {"median": median, "mean": F.avg}[statistic]
    return df.groupBy(*groups).agg(*[make(F.col(f).cast("double")).alias(prefix + f) for f in features], F.count(F.lit(1)).alias(prefix + count))


def aggregate_objects(df: DataFrame, label: str, groups: Sequence[str], features: Sequence[str], statistic: str = "median") -> DataFrame:
    """As ``aggregate``, with columns label__feature and label__n_objects."""
    return aggregate(df, groups, features, statistic, prefix=f"{label}__")


def aggregate_by_id(df: DataFrame, id_col: str, features: Sequence[str], metadata: Sequence[str] = (), method: str = "median", keep: str = "mode", order: str | None = None) -> DataFrame:
    """One row an id: features as median or mean, n_replicates, and metadata as mode (least on ties) or first known in ``order``."""
    make = {"median": median, "mean": F.avg}[method]
    if keep == "mode":
        meta = [F.mode(F.col(m), True).alias(m) for m in metadata]
    else:
        meta = [F.min_by(F.col(m), F.when(F.col(m).isNotNull(), F.struct(F.col(order or m), F.col(m)))).alias(m) for m in metadata]
    ids = F.coalesce(F.col(id_col).cast("string"), F.lit("nan"))
    return df.groupBy(ids.alias(id_col)).agg(*[make(F.col(f).cast("double")).alias(f) for f in features], *meta, F.count(F.lit(1)).alias("n_replicates"))


def build_profiles(images: DataFrame, objects: dict[str, tuple[DataFrame, Sequence[str]]], keys: Sequence[str], statistic: str = "median") -> DataFrame:
    """LEFT joins each object table's aggregate onto the images; images keep their rows.

    Aggregates are unique on the key by construction, so no check and no second
    shuffle on the object side is needed.
    """
    out = images
    for label, (table, features) in objects.items():
        made = aggregate_objects(table, label, keys, features, statistic)
        joined = out.alias("l").join(made.alias("r"), same_keys(keys), "left")
        out = joined.select("l.*", *[F.col(f"r.`{c}`") for c in made.columns if c not in keys])
    return out


def trim_objects(
    df: DataFrame, row_id: str, groups: Sequence[str], features: Sequence[str], keep: float = 0.9, metric: str = "q95", q: float = 0.95,
    most_missing: float = 0.7, least_valid: float = 0.25,
) -> DataFrame:
    """Adds score, threshold, n_used and keep_object: the central share of each group's objects by robust distance.

    A feature counts in a group if at most ``most_missing`` is missing and its MAD is
    not 0. An object's z-values are (x - median)/MAD; its score is their absolute
    95 % quantile (q95), root mean square (l2) or maximum (max); it needs values for
    ``least_valid`` of the group's features. Objects up to the ``keep`` quantile of
    scores stay. A group without any usable feature keeps all.
    """
    x = F.col("value")
    long = to_long(df, [row_id, *groups], features)
    by = [*groups, "feature"]
    centre = long.groupBy(*by).agg(median(x).alias("__c"), F.avg(x.isNull().cast("double")).alias("__missing"))
    off = join_groups(long, centre, by).withColumn("__off", x - F.col("__c"))
    spread = off.groupBy(*by).agg(median(F.abs("__off")).alias("__mad"))
    usable = join_groups(off, spread, by).where((F.col("__missing") <= most_missing) & (F.col("__mad") > 0)).withColumn("__z", F.abs(F.col("__off") / F.col("__mad")))
    z = F.col("__z")
    make = {"q95": quantile(z, q), "l2": F.sqrt(F.avg(z * z)), "max": F.max(z)}[metric]
    count = join_groups(centre, spread, by).where((F.col("__missing") <= most_missing) & (F.col("__mad") > 0)).groupBy(*groups).agg(F.count(F.lit(1)).alias("__features"))
    scored = usable.groupBy(row_id, *groups).agg(make.alias("score"), F.count(z).alias("n_used"))
    scored = join_groups(scored, count, groups)
    scored = scored.withColumn("score", F.when(F.col("n_used") >= least_valid * F.col("__features"), F.col("score")))
    limit = scored.groupBy(*groups).agg(quantile(F.col("score"), keep).alias("threshold"))
    out = df.alias("l").join(scored.alias("r"), same_keys([row_id, *groups]), "left").select("l.*", "r.score", "r.n_used")
    out = join_groups(out, limit, groups)
    return out.withColumn("keep_object", F.when(F.col("threshold").isNull(), True).otherwise(F.coalesce(F.col("score") <= F.col("threshold"), F.lit(False))))
