"""Importance resampling of documents towards the distribution of a target corpus.

Texts become sparse rows of counts over hashed n-grams. The matrix is kept as blocks
of compressed sparse rows in the shared folder; its column sums are the corpus's
distribution, and its product with the gains of all buckets the documents' weights.
Gumbel noise from a hash of the id turns the highest scores into a draw without
replacement.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, pick, written

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_NO_WORD = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes of a text whose words are listed at once, and words whose buckets a worker remembers.
SLICE, REMEMBERED = 1 << 20, 1 << 18
#: Entries of one block of rows.
BLOCK_ENTRIES = 1 << 20


def sliced_words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text (A-Z in lower case), listed slice by slice; a slice ends where no word goes on."""
    at = 0
    while at < len(text):
        end = _NO_WORD.search(text, at + SLICE)
        end = end.start() if end else len(text)
        yield _WORDS.findall(text[at:end].lower())
        at = end


def counted_features(text: bytes, longest: int = LONGEST) -> tuple[int, Counter]:
    """The number of words, and how often each run of 1 to ``longest`` of them stands in the text."""
    counts: Counter = Counter()
    words, tail = 0, []
    for part in sliced_words(text):
        words += len(part)
        counts.update(part)
        if longest > 1:
            known = len(tail)
            both = tail + part
            for n in range(2, longest + 1):
                counts.update(b" ".join(both[i : i + n]) for i in range(max(0, known - n + 1), len(both) - n + 1))
            tail = both[-(longest - 1) :]
    return words, counts


class Bucketed:
    """The bucket of a feature; some words are remembered, which changes nothing but the time."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def of(self, feature: bytes) -> int:
        found = self.known.get(feature)
        if found is None:
            found = zlib.crc32(feature) % self.buckets
            if len(self.known) < REMEMBERED and len(feature) < 40:
                self.known[feature] = found
        return found

    def row(self, counts: Counter) -> dict[int, int]:
        out: dict[int, int] = {}
        of = self.of
        for feature, n in counts.items():
            b = of(feature)
            out[b] = out.get(b, 0) + n
        return out


def count_matrix(df: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """The document-by-bucket counts as blocks of compressed sparse rows.

    A row is a block: ids and words (arrays, a value a document), starts (<i8, one
    more than documents), columns (<u4) and counts (<u4) as binary. Every document is
    in one block; a null or empty text has an empty row. A block holds the documents
    of an Arrow batch, or fewer where these have many entries.
    """
    rows = pick(df, id=id_col, text=text_col)
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        hashed = Bucketed(buckets)
        texts = batch.column(1).cast(pa.binary())
        cuts, words = [0], []
        columns, counts, starts = [np.empty(0, "<u4")], [np.empty(0, "<u4")], [0]
        out: dict[str, list] = {"words": [], "starts": [], "columns": [], "counts": []}

        def close(end: int) -> None:
            out["words"].append(words[cuts[-1] : end])
            for name, parts in (("columns", columns), ("counts", counts)):
                out[name].append(np.concatenate(parts).tobytes())
                parts[1:] = []
            out["starts"].append(np.array(starts, "<i8").tobytes())
            starts[1:] = []
            cuts.append(end)

        for i in range(batch.num_rows):
            n, found = counted_features(texts[i].as_py() or b"", longest)
            row = hashed.row(found)
            words.append(n)
            columns.append(np.fromiter(row.keys(), "<u4", len(row)))
            counts.append(np.fromiter(row.values(), "<u4", len(row)))
            starts.append(starts[-1] + len(row))
            if starts[-1] >= BLOCK_ENTRIES or i == batch.num_rows - 1:
                close(i + 1)
        out["ids"] = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), batch.column(0))
        return out

    return map_arrow(rows, run, f"ids array<{id_type}>, words array<bigint>, starts binary, columns binary, counts binary")


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n: the sums of the matrix's columns, without those that are 0; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for columns, counts in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                total += np.bincount(np.frombuffer(columns, "<u4"), np.frombuffer(counts, "<u4"), buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    parts = matrix.select("columns", "counts").mapInArrow(run, "bucket int, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares of target and corpus, by bucket."""
    size = len(corpus)
    s_all, t_all = float(int(corpus.sum()) + size), float(int(target.sum()) + size)
    return np.array([math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(id_text: str, seed: int = SEED) -> int:
    """floor of 1000 times a Gumbel variate that follows from sha256 of the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{id_text}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(matrix: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """id, n_words, n_features, weight and score of each document: the product of the matrix and the gains."""
    schema = f"id {matrix.schema['ids'].dataType.elementType.simpleString()}, n_words bigint, n_features bigint, weight bigint, score bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, starts, columns, counts = (batch.column(k)[i] for k in range(5))
                starts = np.frombuffer(starts.as_py(), "<i8")
                n = np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
                by_row = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
                weight = by_row(gain[np.frombuffer(columns.as_py(), "<u4")] * n)
                drawn = np.array([noise("" if x is None else str(x), seed) for x in ids.as_py()], np.int64)
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(by_row(n)), pa.array(weight), pa.array(weight + drawn)], ["id", "n_words", "n_features", "weight", "score"])

    return matrix.select("ids", "words", "starts", "columns", "counts").mapInArrow(run, schema)


def in_order(rows: DataFrame, *order) -> DataFrame:
    """Adds ``rank``, from 1 in the order given: ranges are sorted each in a task and moved by the sizes of those before."""
    spark = rows.sparkSession
    held = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    sizes = sorted(map(tuple, held.groupBy(part.alias("p")).count().collect()))  # a row for each partition
    before = np.cumsum([0, *[n for _, n in sizes]])
    starts = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before)], "__p bigint, __start bigint")
    placed = held.join(F.broadcast(starts), part == F.col("__p"))
    return placed.withColumn("rank", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start") + 1).drop("__at", "__p", "__start")


def resample(
    df: DataFrame, id_col: str, text_col: str, target: DataFrame, target_text: str,
    buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """id, n_words, n_features, weight, score and rank of every document; rank is null where it isn't drawn.

    Of the documents with ``least_words`` words or more, ``percent`` in 100 (rounded
    down) of highest score are drawn; ranks count from 1 in falling order of score,
    ties going to the smaller id. Null and empty texts have no features, weight 0, and
    aren't drawn unless ``least_words`` is 0. Rows that repeat count each in the
    corpus's sums and each have a row (and ranks that follow one another, if drawn); a
    null id is hashed like an empty one and comes first among ties. Texts of any length
    are read whole, slice by slice. An empty corpus gives no rows; an empty target or
    one without words has the even distribution. Extra columns, whatever their names,
    are not read. On the driver: two numbers a bucket and a number a partition.
    """
    matrix = written(count_matrix(df, id_col, text_col, buckets, longest), "counts")
    wanted = pick(target, text=target_text).withColumn("id", F.lit(0))

    def sums(m: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for r in column_sums(m, buckets).collect():  # a row a bucket
            out[r["bucket"]] = r["n"]
        return out

    rows = written(weighed(matrix, gains(sums(matrix), sums(count_matrix(wanted, "id", "text", buckets, longest))), seed), "weights")
    discard(matrix)
    able = F.col("n_words") >= least_words
    most = rows.where(able).count() * percent // 100
    ranked = in_order(rows.where(able), F.desc("score"), F.asc("id"))
    drawn = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return drawn.union(rows.where(~able).withColumn("rank", F.lit(None).cast("bigint")))
