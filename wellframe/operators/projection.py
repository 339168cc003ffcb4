"""Principal components of wide vectors by a randomised Krylov space: no matrix of features by features anywhere."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellframe.functions import stats

from .gram import PART, added_up, column_means
from .graph import stored
from .preprocess import facts

#: Rows of a product that travel together when partial sums are added.
SPAN = 4096


def _image(rows: DataFrame, means: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, float]:
    """X'X block of the centred rows (one array column), and the sum of all squares; NULLs count as the mean."""
    width, many = block.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, squares = np.zeros((width, many)), 0.0
        for batch in batches:
            x = np.nan_to_num(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) - means, nan=0.0)
            total += x.T @ (x @ block)
            squares += float((x * x).sum())
        part = TaskContext.get().partitionId()
        for i, sums in [(-1, np.array([squares])), *((at // SPAN, total[at : at + SPAN]) for at in range(0, width, SPAN))]:
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([0], pa.int32()), pa.array([part], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["i", "j", "part", "sums"])

    out, squares = np.zeros((width, many)), 0.0
    for r in added_up(rows.mapInArrow(run, PART)).toLocalIterator():  # the product itself: width by the columns of the block
        values = np.frombuffer(r["sums"])
        if r["i"] < 0:
            squares = float(values[0])
        else:
            out[r["i"] * SPAN : (r["i"] + 1) * SPAN] = values.reshape(-1, many)
    return out, squares


def leading_axes(rows: DataFrame, width: int, means: np.ndarray, k: int, extra: int = 8, rounds: int = 30, tolerance: float = 1e-10, seed: int = 42):
    """(axes: width by k, their sums of squares, residuals against the first, the sum of all squares).

    A random block of k + ``extra`` directions is multiplied by X'X again and again; all
    blocks together, made orthogonal, are the space in which the axes are sought. A round is
    one pass over the rows. The residual |X'X v - e v| needs no pass of its own; rounds end
    when it is at most ``tolerance`` of the first, or when the space is the whole. The driver
    holds width times the directions found, never width squared while width is larger.
    """
    k = max(1, min(k, width))
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, min(width, k + extra))))[0]
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    for at in range(rounds):
        made, squares = _image(rows, means, block)
        basis, image = np.hstack([basis, block]), np.hstack([image, made])
        t = basis.T @ image
        e, s = np.linalg.eigh((t + t.T) / 2)
        e, s = np.maximum(e[::-1][:k], 0.0), s[:, ::-1][:, :k]
        axes = basis @ s
        residual = np.linalg.norm(image @ s - axes * e, axis=0) / max(e[0], 1e-300)
        if residual.max() <= tolerance or basis.shape[1] >= width:
            break
        fresh = made
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        u, size, _ = np.linalg.svd(fresh, full_matrices=False)
        block = u[:, size > 1e-10 * max(e[0], 1e-300)][:, : width - basis.shape[1]]
        if not block.shape[1]:
            break
    sign = np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return axes * sign, e, residual, squares


def project(vector, means: np.ndarray, axes: np.ndarray):
    """A column of scores from a column of vectors; NULL stays NULL."""

    @F.pandas_udf("array<double>")
    def scores(v: pd.Series) -> pd.Series:
        known = np.flatnonzero(v.notna())
        out = np.full(len(v), None, object)
        if len(known):
            x = np.nan_to_num(np.stack([np.asarray(a, float) for a in v.iloc[known]]) - means, nan=0.0) @ axes
            for at, row in zip(known, x):
                out[at] = row
        return pd.Series(out)

    return scores(vector)


def randomised_pca(df: DataFrame, vector: str, k: int = 2, prefix: str = "PC", extra: int = 8, tolerance: float = 1e-10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(df with PC1..PCk; component, variance, explained and residual), from a column of vectors of one length.

    Variances have divisor n. An axis points to where its largest loading is positive.
    Missing entries count as their column's mean; rows without a vector keep NULL scores
    and are not fitted to. Without any vector the scores are NULL and there are no components.
    """
    spark = df.sparkSession
    rows = stored(df.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda x: stats.clean(x, float("inf"))).alias("v")), "vectors")
    shape = rows.agg(F.min(F.size("v")), F.max(F.size("v")), F.count(F.lit(1))).first()
    names = [f"{prefix}{i + 1}" for i in range(k)]
    if not shape[2] or not shape[1]:
        return df.withColumns({n: F.lit(None).cast("double") for n in names}), spark.createDataFrame([], "component string, variance double, explained double, residual double")
    if shape[0] != shape[1]:
        raise ValueError(f"vectors are of {shape[0]} to {shape[1]} entries")
    width = shape[1]
    means = column_means(rows, width)
    axes, squares, residual, total = leading_axes(rows, width, means, k, extra, tolerance=tolerance, seed=seed)
    table = [(names[i], float(squares[i] / shape[2]), float(squares[i] / total) if total else 0.0, float(residual[i])) for i in range(axes.shape[1])]
    scored = df.withColumn("__s", project(F.transform(vector, lambda x: stats.clean(x, float("inf"))), means, axes))
    out = scored.select(*df.columns, *[F.get("__s", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return out, spark.createDataFrame(table, "component string, variance double, explained double, residual double")


def embedding_with_centroids(df: DataFrame, id_col: str, vector: str, centroids: DataFrame, k: int = 2) -> tuple[DataFrame, DataFrame]:
    """(id, label, point_type, PC1..PCk; the components) of unit rows and unit centroids (label, centroid) in one space, fitted to both.

    point_type is row or centroid; a row has no label and a centroid no id.
    """
    unit = lambda c: stats.unit(F.transform(c, lambda x: x.cast("double")))
    own = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("label"), F.lit("row").alias("point_type"), unit(F.col(vector)).alias("__u"))
    nobody = F.lit(None).cast(df.schema[id_col].dataType).alias("id")
    other = centroids.where("centroid IS NOT NULL").select(nobody, F.col("label").cast("string").alias("label"), F.lit("centroid").alias("point_type"), unit(F.col("centroid")).alias("__u"))
    scored, components = randomised_pca(stored(own.unionByName(other), "points"), "__u", k)
    return scored.drop("__u"), components


def pca_embedding(df: DataFrame, features: Sequence[str], dims: int = 20, prefix: str = "latent_") -> tuple[DataFrame, DataFrame]:
    """(metadata columns and latent_1..; the components): medians in gaps, columns of mean 0 and deviation 1, then their components."""
    dims = max(1, min(dims, len(features)))
    clean = df.withColumns({f: stats.clean(F.col(f), float("inf")) for f in features})
    middle = facts(clean, features, median=stats.median)
    filled = stored(clean.withColumns({f: F.coalesce(F.col(f), F.lit(middle[f]["median"] or 0.0)) for f in features}), "filled")
    known = facts(filled, features, mean=F.avg, sd=F.stddev_pop)
    scaled = F.array(*[(F.col(f) - F.lit(known[f]["mean"] or 0.0)) / F.lit(known[f]["sd"] or 1.0) for f in features])
    scored, components = randomised_pca(filled.withColumn("__v", scaled), "__v", dims, prefix)
    return scored.drop("__v", *features), components
