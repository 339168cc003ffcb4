"""Reports that follow a matrix through the stages of its preprocessing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import diagnostics
from .gram import gram
from .preprocess import impute


def stage_replicates(stages: dict[str, DataFrame], id_col: str, groups: Sequence[str], features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(pairs of replicates with their correlation, summary by group), each with its stage."""
    pairs = None
    for name, df in stages.items():
        one = diagnostics.replicate_pairs(df, id_col, groups, features).select(F.lit(name).alias("stage"), "*")
        pairs = one if pairs is None else pairs.union(one)
    return pairs, diagnostics.summary_of_counts(stage_replicate_counts(stages, id_col, groups, features), ["stage", *groups])


def stage_replicate_counts(stages: dict[str, DataFrame], id_col: str, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    """stage, the groups, correlation and how many pairs of replicates have it."""
    counts = None
    for name, df in stages.items():
        one = diagnostics.replicate_counts(df, id_col, groups, features).select(F.lit(name).alias("stage"), "*")
        counts = one if counts is None else counts.union(one)
    return counts


def component_scores(df: DataFrame, features: Sequence[str], keep: Sequence[str], components: int = 2) -> DataFrame:
    """keep, component (PC1, ...) and score of each row: principal components of the centred features, from one matrix of products.

    Missing values are filled by the median. The matrix is the features' and comes to the driver; rows don't.
    """
    filled = impute(df, features, "median")
    g = gram(filled, features)
    n = np.maximum(g["n"], 1)
    _, v = np.linalg.eigh(g["xy"] - g["x"] * g["y"] / n)
    v = v[:, ::-1][:, :components]
    v = v * np.where(np.take_along_axis(v, np.abs(v).argmax(0)[None, :], 0) < 0, -1.0, 1.0)
    # scores differ from centred ones by a constant, which no later step sees
    value = F.array(*[F.col(f).cast("double") for f in features])
    dot = lambda w: F.aggregate(F.zip_with(value, F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    made = F.array(*[F.struct(F.lit(f"PC{i + 1}").alias("component"), dot(v[:, i]).alias("score")) for i in range(v.shape[1])])
    return filled.select(*keep, F.explode(made).alias("x")).select(*keep, "x.*")


def stage_batches(stages: dict[str, DataFrame], columns: Sequence[str], features: Sequence[str], components: int = 2) -> DataFrame:
    """stage, metadata_column, component, status, eta_squared, n_groups and n_profiles: how far a column's groups explain the leading components.

    All stages, columns and components go through one aggregation by group and one over
    groups; sums are taken around each stage's mean score.
    """
    known = [c for c in columns if all(c in df.columns for df in stages.values())]
    spark = next(iter(stages.values())).sparkSession
    schema = "stage string, metadata_column string, component string, status string, eta_squared double, n_groups bigint, n_profiles bigint"
    if not known:
        return spark.createDataFrame([(s, None, None, "not_tested_no_valid_batch_report_columns", None, None, None) for s in stages], schema)
    long = None
    for name, df in stages.items():
        one = component_scores(df, features, known, components).select(F.lit(name).alias("stage"), *[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in known], "component", "score")
        long = one if long is None else long.union(one)
    spread = long.unpivot(["stage", "component", "score"], known, "metadata_column", "label")
    by = ["stage", "metadata_column", "component"]
    groups = spread.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("m"), (F.var_pop("score") * F.count(F.lit(1))).alias("within"))
    sums = groups.groupBy(*by).agg(F.sum("n").alias("n_profiles"), F.count(F.lit(1)).alias("n_groups"), F.sum("within").alias("within"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"))
    between = groups.join(sums.select(*by, "grand"), by).groupBy(*by).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"))
    total = F.col("between") + F.col("within")
    tested = F.col("n_groups") > 1
    eta = F.when(tested & (total > 0), F.col("between") / F.when(total > 0, total))
    return sums.join(between, by).select(*by, F.when(tested, "tested").otherwise("not_testable_single_group").alias("status"), eta.alias("eta_squared"), "n_groups", "n_profiles")


def before_after(stages: dict[str, DataFrame], id_col: str, features: Sequence[str], replicates: Sequence[str] = (), batches: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The reports of ``stage_replicates`` and ``stage_batches`` by name; those without columns to go by are left out."""
    groups = [c for c in replicates if all(c in df.columns for df in stages.values())]
    out = {}
    if groups:
        pairs, summary = stage_replicates(stages, id_col, groups, features)
        out |= {"before_after_replicate_correlations": pairs, "before_after_replicate_summary": summary}
    out["before_after_batch_pc_association"] = stage_batches(stages, batches, features)
    return out


def decision_log(spark, decisions: Sequence[tuple[str, str, object, str]]) -> DataFrame:
    """step (from 1), stage, decision, value and reason of what a preprocessing chose, in order."""
    rows = [(i, stage, decision, None if value is None else str(value), reason) for i, (stage, decision, value, reason) in enumerate(decisions, 1)]
    return spark.createDataFrame(rows, "step int, stage string, decision string, value string, reason string")
