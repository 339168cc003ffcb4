"""Packing of documents into sequences of fixed length by column generation.

Documents are cut where they pass the sequence length; what remains of each is a
length between 1 and that length. A linear program over the histogram of lengths
(in units) chooses patterns, that is, sets of lengths that fit one sequence; a
knapsack dynamic program prices new patterns. Whole parts of the solution are
taken, the rest goes first-fit decreasing, and the pieces of each length, ranked
by id, fill the places of the patterns one after another.

Only the histogram (at most ``length / unit`` rows) comes to the driver.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import local_table, map_arrow, pick, written
from .tokens import arrow_blocks, library_encoder


def price(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of (ascending) sizes within the capacity: unbounded knapsack."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = fitting[c]
        if n:
            value = best[c - sizes[:n]] + duals[:n]
            k = value.argmax()
            if value[k] > best[c] + 1e-12:
                best[c], last[c] = value[k], k
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[capacity]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, most_columns: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, uses): columns of a basic solution of the linear program and how often each is used.

    Starts with one pattern for each size and exchanges columns while the priced
    pattern is worth more than ``1 + gap`` sequences; then the solution is within
    that share of the optimum, as objective / worth bounds the optimum from below.
    Any stop leaves a feasible solution.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    uses = inverse @ demand
    for _ in range(most_columns):
        value, pattern = price(inverse.sum(0), sizes, capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ pattern
        able = direction > 1e-9
        ratio = np.where(able, uses / np.where(able, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = pattern
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        amount = max(0.0, ratio[out])
        uses = np.maximum(uses - amount * direction, 0)
        uses[out] = amount
    return basis.astype(np.int64), uses


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """[(uses, {size: copies})]: patterns whose places number exactly the histogram's counts."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    patterns, uses = solve_patterns(sizes, left.astype(float), capacity)
    out = []
    for k in np.argsort(-uses, kind="stable"):
        whole = int(min(np.floor(uses[k] + 1e-6), min((left[i] // patterns[i, k] for i in np.flatnonzero(patterns[:, k])), default=0)))
        if whole > 0:
            left = left - whole * patterns[:, k]
            out.append((whole, {int(sizes[i]): int(patterns[i, k]) for i in np.flatnonzero(patterns[:, k])}))
    while left.any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        for i in reversed(range(len(sizes))):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        times = int(min(left[i] // pattern[i] for i in np.flatnonzero(pattern)))
        left = left - times * pattern
        out.append((times, {int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}))
    return out


def cut_documents(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, length: int, spaced: bool = False) -> DataFrame:
    """Pieces of at most ``length`` ids: id, start, length, ids_crc32, doc_tokens."""
    rows = pick(df, id=id_col, text=text_col)
    schema = rows.select("id").schema
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(name, "long")
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> dict:
        encoder = library_encoder(tokenizer, spaced)
        took: list[int] = []
        out: dict[str, list[int]] = {"start": [], "length": [], "ids_crc32": [], "doc_tokens": []}
        for first, block in arrow_blocks(batch.column(1)):
            for i, ids in enumerate(encoder.encode(block), first):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    took.append(i)
                    out["start"].append(start)
                    out["length"].append(len(piece) // 4)
                    out["ids_crc32"].append(zlib.crc32(piece))
                    out["doc_tokens"].append(total)
        return {"id": batch.column(0).take(pa.array(took, pa.int64()))} | out

    return map_arrow(rows, run, schema)


def ranked(pieces: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds ``rank``, from 0 within each value of ``by``, without bringing a value's rows into one task.

    Rows of a value are dealt into about the square root of their number of parts
    (at least one for each 512 rows up to 2**18 rows), ranked there, and moved by
    the sizes of the parts before.
    """
    totals = pieces.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    salted = pieces.join(F.broadcast(totals), by).withColumn(
        "__part", F.pmod(F.xxhash64(*order), F.ceil(F.col("__n") / F.greatest(F.lit(512.0), F.sqrt("__n"))))
    ).drop("__n")
    parts = salted.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    moved = parts.select(by, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = Window.partitionBy(by, "__part").orderBy(*order)
    return (
        salted.withColumn("__own", F.row_number().over(own) - 1)
        .join(moved, [by, "__part"])
        .withColumn("rank", F.col("__own") + F.col("__before"))
        .drop("__own", "__before", "__part")
    )


def pack_pieces(pieces: DataFrame, length: int = 4096, unit: int = 16) -> DataFrame:
    """Adds sequence_id and offset to pieces (id, start, length, ids_crc32, doc_tokens)."""
    spark = pieces.sparkSession
    sized = pieces.withColumn("size", F.ceil(F.col("length") / unit).cast("int"))
    histogram = {r["size"]: r["n"] for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    places, sequences, taken = [], 0, dict.fromkeys(histogram, 0)
    for uses, pattern in plan(histogram, length // unit):
        for size, copies in pattern.items():
            places.append((size, taken[size], taken[size] + uses * copies, copies, sequences))
            taken[size] += uses * copies
        sequences += uses
    table = local_table(spark, places, "size int, low bigint, high bigint, copies bigint, first bigint")
    filled = (
        ranked(sized, "size", ["id", "start", "ids_crc32"])
        .join(F.broadcast(table), "size")
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumn("sequence_id", F.col("first") + F.expr("(rank - low) div copies"))
    )
    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    return filled.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*pieces.columns, "sequence_id", "offset")


def pack(df: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int, length: int = 4096, unit: int = 16) -> DataFrame:
    """Sequences of at most ``length`` ids that hold all documents, little of each left empty.

    Returns a row for each piece: id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset. A null or empty text is its end id alone. Rows that
    repeat are packed as often as they stand there; an empty table gives none. A text
    of any length is cut into pieces of ``length`` and a rest. Null ids are packed like
    others; extra columns, whatever their names, are not read. Pieces of equal length
    are ranked by id, start and checksum, so ties don't change a sequence's lengths.
    unit: lengths are planned in such units, so a piece wastes less than one unit.
    """
    pieces = written(cut_documents(df, id_col, text_col, tokenizer, end_id, length), "pieces")
    return pack_pieces(pieces, length, unit)
