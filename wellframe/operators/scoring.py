"""Scores of rows against any number of classes: blocks of rows meet blocks of centroids, and a few labels a row and block are kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .distance import block_distances, block_rows, blocks, prepared
from .graph import stored

COLLAPSE = ("max", "mean", "median")


def numbered_centroids(centroids: DataFrame, metric: str) -> DataFrame:
    """label, sub (from 1 within a label, in the order of vectors) and v, prepared; rows without label or vector are left out."""
    c = centroids.select(F.col("label").cast("string").alias("label"), prepared(F.col("centroid"), metric).alias("v")).where("label IS NOT NULL AND v IS NOT NULL")
    return c.withColumn("sub", F.row_number().over(Window.partitionBy("label").orderBy("v")))


def class_blocks(centroids: DataFrame, block: int) -> DataFrame:
    """c_labels, c_subs, c_less and c (vectors, one after another): all centroids of a label are in one block, the labels dealt by a hash."""
    n = max(1, -(-centroids.count() // block))
    less = F.col("less") if "less" in centroids.columns else F.lit(0.0)
    rows = centroids.select("label", "sub", less.alias("less"), "v").groupBy(F.pmod(F.xxhash64("label"), F.lit(n)).alias("__k"))
    whole = rows.agg(F.sort_array(F.collect_list(F.struct("label", "sub", "less", "v"))).alias("s"))
    return whole.select(F.col("s.label").alias("c_labels"), F.col("s.sub").alias("c_subs"), F.col("s.less").alias("c_less"), F.flatten("s.v").alias("c"))


def similarity(d: np.ndarray, metric: str) -> np.ndarray:
    return 1 - d if metric in ("cosine", "correlation") else 1 / (1 + d)


def _collapsed(s: np.ndarray, first: np.ndarray, how: str) -> np.ndarray:
    """Columns from each of ``first`` to the next as one."""
    if how == "max":
        return np.maximum.reduceat(s, first, axis=1)
    if how == "mean":
        return np.add.reduceat(s, first, axis=1) / np.diff([*first, s.shape[1]])
    return np.stack([np.median(s[:, a:b], axis=1) for a, b in zip(first, [*first[1:], s.shape[1]])], axis=1)


def _block_labels(metric: str, csls: bool, how: str | None, keep: int, k: int, temperature: float):
    """Of each row of a block and one block of classes: the best labels, the sum for the softmax and, for csls, the best cosines."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for q_ids, q, labels, less, c in zip(f["q_ids"], f["q"], f["c_labels"], f["c_less"], f["c"]):
                names = np.asarray(labels, object)
                # rounded, so that equal centroids tie in whatever block they are
                d = np.round(block_distances(block_rows(q, len(q_ids)), block_rows(c, len(names)), metric), 12)
                near = -np.sort(d, axis=1)[:, :k] + 1 if csls else np.empty((len(q_ids), 0))
                s = 2 * (1 - d) - np.asarray(less) if csls else similarity(d, metric)
                if how:
                    first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
                    names, s, d = names[first], _collapsed(s, first, how), np.minimum.reduceat(d, first, axis=1)
                top = np.argsort(-s, axis=1, kind="stable")[:, :keep]
                high = s.max(1)
                yield pd.DataFrame({
                    "id": list(q_ids), "labels": [names[t].tolist() for t in top], "distances": list(np.take_along_axis(d, top, 1)), "scores": list(np.take_along_axis(s, top, 1)),
                    "high": high, "mass": np.exp((s - high[:, None]) / temperature).sum(1), "near": list(near),
                })

    return run


def _block_columns(k: int):
    """The best k cosines of each centroid among the rows of a block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for q_ids, q, labels, subs, c in zip(f["q_ids"], f["q"], f["c_labels"], f["c_subs"], f["c"]):
                d = np.round(block_distances(block_rows(q, len(q_ids)), block_rows(c, len(labels)), "cosine"), 12)
                best = np.sort(d, axis=0)[:k]
                yield pd.DataFrame({"label": np.repeat(np.asarray(labels, object), len(best)), "sub": np.repeat(np.asarray(subs), len(best)), "cosine": 1 - best.T.ravel()})

    return run


def _mean_of_best(rows: DataFrame, by: list[str], k: int, out: str) -> DataFrame:
    best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("cosine")))
    return rows.withColumn("__r", best).where(F.col("__r") <= k).groupBy(*by).agg(F.avg("cosine").alias(out))


def score_classes(
    queries: DataFrame, id_col: str, vector: str, centroids: DataFrame, metric: str = "cosine", top: int = 5, temperature: float = 0.1,
    scoring: str = "distance", collapse: str | None = None, k: int = 10, block: int = 512,
) -> DataFrame:
    """id, label, rank, distance, similarity, confidence and margin of the best ``top`` labels of each row.

    Centroids (label, centroid) may be of any number and a label may have several; ``collapse``
    (max, mean or median) makes one score a label of them, else each is ranked by itself.
    ``scoring`` csls takes as similarity 2 cosine - mean of the row's best k - mean of the
    centroid's best k, which needs a second pass. Confidence is a softmax over all classes,
    margin best minus second best (0 with one class); ties go to the smaller label.
    distance is that of a label's nearest centroid.

    Blocks of rows meet blocks of classes. A block gives max(top, 2) labels, the largest score
    and the sum of the softmax against it, and these merge: nothing that grows with the
    classes is broadcast or collected, and a label's centroids alone must fit a task. Ids
    are unique; rows without id or vector have no scores. Empty tables give no rows.
    """
    if collapse is not None and collapse not in COLLAPSE:
        raise ValueError(f"collapse must be one of {COLLAPSE}")
    if scoring not in ("distance", "csls"):
        raise ValueError("scoring must be distance or csls")
    csls = scoring == "csls"
    if csls and metric != "cosine":
        raise ValueError("csls is for cosines")
    heat, keep = max(temperature, 1e-12), max(top, 2)
    rows = blocks(queries, id_col, vector, metric, "q", block)
    classes = numbered_centroids(centroids, metric)
    if csls:
        rows, classes = stored(rows, "rows"), stored(classes, "classes")
        columns = rows.crossJoin(class_blocks(classes, block)).mapInPandas(_block_columns(k), "label string, sub int, cosine double")
        classes = classes.join(_mean_of_best(columns, ["label", "sub"], k, "less"), ["label", "sub"])
    doubles = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        T.StructField("id", queries.schema[id_col].dataType), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("distances", doubles),
        T.StructField("scores", doubles), T.StructField("high", T.DoubleType()), T.StructField("mass", T.DoubleType()), T.StructField("near", doubles),
    ])
    parts = rows.crossJoin(class_blocks(classes, block)).mapInPandas(_block_labels(metric, csls, collapse, keep, k, heat), schema)
    if csls:
        parts = stored(parts, "parts")
        own = _mean_of_best(parts.select("id", F.explode("near").alias("cosine")), ["id"], k, "__own")
        parts = parts.join(own, "id")
    of_row = Window.partitionBy("id")
    merged = parts.withColumn("__high", F.max("high").over(of_row))
    merged = merged.withColumn("__mass", F.sum(F.col("mass") * F.exp((F.col("high") - F.col("__high")) / heat)).over(of_row))
    long = merged.withColumn("c", F.explode(F.arrays_zip("labels", "distances", "scores")))
    order = of_row.orderBy(F.desc("c.scores"), "c.labels")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = long.withColumn("rank", F.row_number().over(order)).withColumn("__second", F.nth_value("c.scores", 2).over(whole))
    own = F.col("__own") if csls else F.lit(0.0)
    return ranked.where(F.col("rank") <= top).select(
        "id", F.col("c.labels").alias("label"), "rank", F.col("c.distances").alias("distance"), (F.col("c.scores") - own).alias("similarity"),
        (F.exp((F.col("c.scores") - F.col("__high")) / heat) / F.col("__mass")).alias("confidence"), F.coalesce(F.col("__high") - F.col("__second"), F.lit(0.0)).alias("margin"),
    )
