"""Whitening of embeddings by a QR of tall, thin blocks.

Components become whole numbers, so sums over all rows are exact. Rows are centred by
these sums; each partition's rows are reduced to a triangular factor block by block,
factors are merged as a tree, and the singular vectors of the last one turn and scale
the centred rows to unit covariance, which itself is never formed on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, pick, written

UNIT, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Factors that one task merges, and rows that are taken into a factor at once.
FAN_IN, ROWS = 16, 4096
#: Whole numbers up to this size are longs even when SHIFT is added.
_MOST = float(1 << 62)


def whole_vectors(batch: pa.RecordBatch, dim: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, lengths, components) of the usable vectors in the batch's second column.

    Usable: not null or empty, all components known and finite, and floor(64 c) within
    2**62. The components, floor(64 c) + 1000000 as longs, stand in one array after
    another; with ``dim`` only vectors of that length are taken, as rows of a matrix.
    """
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    length = np.diff(offsets)
    with np.errstate(invalid="ignore"):
        x = np.floor(flat * float(UNIT))
        bad = np.concatenate([[0], np.cumsum(~(np.abs(x) <= _MOST))])
    good = (bad[offsets[1:]] == bad[offsets[:-1]]) & (length > 0) & lists.is_valid().to_numpy(zero_copy_only=False)
    if dim is not None:
        good &= length == dim
    at = np.flatnonzero(good)
    if dim is None:
        taken = np.repeat(good, length)
        inside = x[offsets[0] : offsets[-1]][taken]
    else:
        inside = x[(offsets[at][:, None] + np.arange(dim)[None, :])] if len(at) else np.empty((0, dim))
    return at, length[at], inside.astype(np.int64) + SHIFT


def exact_totals(rows: DataFrame) -> DataFrame:
    """length, i, n and s: of the usable vectors of each length, their number and the exact sum of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            _, length, x = whole_vectors(batch)
            starts = np.cumsum(length) - length
            for d in np.unique(length).tolist():
                own = x[starts[length == d][:, None] + np.arange(d)[None, :]]
                # halves of 26 bits: neither sum can overflow
                low, high = (own & ((1 << 26) - 1)).sum(0), (own >> 26).sum(0)
                n, s = total.get(d, (0, [0] * d))
                total[d] = (n + len(own), [a + int(b) + (int(c) << 26) for a, b, c in zip(s, low, high)])
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(s, pa.decimal128(38, 0))], ["length", "i", "n", "s"])

    parts = rows.mapInArrow(run, "length int, i int, n bigint, s decimal(38,0)")
    return parts.groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))


def differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: 64-bit where it is sure to fit, else whole numbers of Python."""
    top = max(int(np.abs(x).max(initial=0)) * n, max((abs(s) for s in sums), default=0))
    if top < 1 << 61:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n in double precision: the exact difference is divided, so nothing cancels."""
    return differences(x, n, sums).astype(np.float64) / n


def factors(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """part and r: the triangular factor of the centred rows of each partition."""
    dim = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.empty((0, dim))
        for batch in batches:
            _, _, x = whole_vectors(batch, dim)
            for at in range(0, len(x), ROWS):
                r = np.linalg.qr(np.concatenate([r, centred(x[at : at + ROWS], n, sums)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["part", "r"])

    return rows.mapInArrow(run, "part bigint, r binary")


def merged(parts: DataFrame, dim: int) -> np.ndarray:
    """The triangular factor of all rows: FAN_IN factors of neighbouring parts become one, level by level."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        stacked = np.concatenate([np.frombuffer(b, np.float64).reshape(-1, dim) for b in table.column("r").to_pylist()])
        r = np.linalg.qr(stacked, mode="r")
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    level = written(parts, "factors")
    while level.count() > 1:
        above = written(level.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(run, level.schema), "factors")
        discard(level)
        level = above
    last = level.first()
    discard(level)
    return np.frombuffer(last["r"], np.float64).reshape(-1, dim) if last else np.empty((0, dim))


def directions(r: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors as columns, sqrt of eigenvalues, shares of the trace) of the covariance whose factor is r.

    A direction's sign makes its largest entry positive. Directions without variance
    (to the precision of doubles) have a root of 0.
    """
    _, sigma, right = np.linalg.svd(r, full_matrices=True) if len(r) else (None, np.zeros(0), np.eye(r.shape[1]))
    sigma = np.concatenate([sigma, np.zeros(r.shape[1] - len(sigma))])
    total = float((sigma**2).sum())
    v = right.T * np.where(np.take_along_axis(right, np.abs(right).argmax(1)[:, None], 1)[:, 0] < 0, -1.0, 1.0)
    root = np.where(sigma > sigma.max(initial=0.0) * max(r.shape) * np.finfo(float).eps, sigma / np.sqrt(max(n, 1)), 0.0)
    share = sigma**2 / total if total else np.zeros(len(sigma))
    k = min(components, r.shape[1])
    return v[:, :k], root[:k], share[:k]


def whitened_rows(x: np.ndarray, n: int, sums: list[int], v: np.ndarray, root: np.ndarray) -> np.ndarray:
    out = centred(x, n, sums) @ v
    return np.divide(out, root, out=np.zeros_like(out), where=root > 0)


def identity_error(rows: DataFrame, n: int, sums: list[int], v: np.ndarray, root: np.ndarray) -> float:
    """The largest entry, by size, of the whitened rows' covariance less the identity.

    Rows are centred before they are multiplied: those of exact sums project on means
    of 0. Directions without variance don't count. A task sends one small matrix.
    """
    dim, k = v.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            _, _, x = whole_vectors(batch, dim)
            for at in range(0, len(x), ROWS):
                w = whitened_rows(x[at : at + ROWS], n, sums, v, root)
                total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(total.ravel())], ["at", "s"])

    found = np.zeros(k * k)
    for r in rows.mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():  # k * k rows
        found[r["at"]] = r["s"]
    alive = root > 0
    off = np.abs(found.reshape(k, k) / max(n, 1) - np.eye(k))[np.ix_(alive, alive)]
    return float(off.max(initial=0.0))


def whiten(df: DataFrame, id_col: str, vector_col: str, components: int = COMPONENTS) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error: a row for each usable vector and component.

    Vectors that are null or empty or hold null or non-finite entries have no rows.
    Entries c become floor(64 c) + 1000000; a vector with an entry beyond 2**56,
    which is no long then, counts as not finite. All vectors have one length: where
    lengths differ, the most frequent one (of several the shortest) is whitened and the
    others have no rows. deviation: the exact sum of (n x - S)**2, a decimal of 38
    digits (null beyond). Of n rows at most n - 1 components have variance; one without
    has whitened and explained 0. Equal eigenvalues: any directions that span them.
    Rows that repeat count and stand in the result as often as they are there; null ids
    are kept; an empty table gives no rows; extra columns, whatever their names, are
    not read. On the driver: sums, factor and directions, which grow with the square
    of a vector's length only. ``df`` is read four times, so it should be a table.
    """
    rows = pick(df, id=id_col, vector=vector_col)
    rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    totals = exact_totals(rows).collect()  # a row for each length and place in it
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")])
    if not totals:
        return df.sparkSession.createDataFrame([], schema)
    n, dim = max(((r["n"], -r["length"]) for r in totals))
    dim = -dim
    sums = [int(r["s"]) for r in sorted((r for r in totals if r["length"] == dim), key=lambda r: r["i"])]
    v, root, share = directions(merged(factors(rows, n, sums), dim), n, components)
    error = identity_error(rows, n, sums, v, root)
    k = len(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, _, x = whole_vectors(batch, dim)
            if not len(at):
                continue
            d = differences(x, n, sums)
            exact = d.dtype == object or dim * float(np.abs(d).max(initial=0)) ** 2 >= float(1 << 62)
            square = (d.astype(object) ** 2).sum(1) if exact else (d * d).sum(1)
            if exact:
                deviation = pa.array([s if s < 10**38 else None for s in square.tolist()], pa.decimal128(38, 0))
            else:
                deviation = pa.array(square).cast(pa.decimal128(38, 0))
            again = pa.array(np.repeat(np.arange(len(at)), k))
            m = len(at) * k
            columns = [
                batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(m, n, np.int64)), deviation.take(again),
                pa.array(whitened_rows(x, n, sums, v, root).ravel()), pa.array(np.tile(share, len(at))), pa.array(np.full(m, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)
