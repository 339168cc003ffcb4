"""Join of texts by Jaccard similarity of word n-grams along chosen paths.

Texts of equal words form a class with one representative. A class's set of
five-word shingles is embedded as 64 minhash values, whose agreement estimates the
Jaccard similarity. A run samples a place and puts each set into the bucket of its
value there; a bucket too large is split again by a newly sampled place, which its
sets choose alike, and small ones are compared pair by pair. Runs repeat until a
pair at the threshold is missed with less than the allowed chance. Linked sets form
groups, and in each group all sets of sizes that allow a link are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_links, compare_groups
from .common import discard, map_arrow, numbered, pick, place_of, text_blocks, written
from .components import connected_components
from .subwords import mixed, powers

WORDS, SIMILARITY, PLACES, LEVELS = 5, 0.8, 64, 3
#: Share of equal minhashes from which sets are tied into a group, and from which a set tied to a pivot is done with:
#: shares of unequal places obey the triangle inequality, so a set that agrees in 1 - (CORE - TIED) = 0.65 or more with
#: one that is done is tied to the pivot itself, and a pair at 0.8 falls below 0.65 with a chance of about 1 in 500.
TIED, CORE = 0.4, 0.75
_R, _Q = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1
#: Most bits of the filter of members of groups that is sent to the scan of the texts, and bits a member.
FILTER_BITS, BITS_EACH = 1 << 26, 8


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, texts' ends as word numbers); words are lower case, parted by ASCII white space."""
    joined = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(b) + 1 for b in joined])
    byte = np.frombuffer(b"\n".join(joined) + b"\n", np.uint8)
    space = (byte == 32) | ((byte >= 9) & (byte <= 13))
    before = np.concatenate([[True], space[:-1]])
    start = np.flatnonzero(~space & before)
    stop = np.flatnonzero(space & ~before)
    base = 1_000_003
    total = np.concatenate([[np.uint64(0)], np.cumsum((byte.astype(np.uint64) + np.uint64(1)) * powers(base, len(byte)), dtype=np.uint64)])
    words = (total[stop] - total[start]) * powers(pow(base, -1, 2**64), len(byte) + 1)[start]
    return mixed(words), np.searchsorted(start, ends)


def shingle_hashes(words: np.ndarray, ends: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words of one text, texts' ends); a text of fewer words is one shingle, none has none."""
    begins = np.concatenate([[0], ends[:-1]])
    count = ends - begins
    number = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out = np.zeros(int(number.sum()), np.uint64)
    bounds = np.cumsum(number)
    owner = np.repeat(np.arange(len(ends)), number)
    first = begins[owner] + np.arange(len(out)) - (bounds - number)[owner]
    for k in range(n):
        inside = first + k < ends[owner]
        out[inside] += mixed(words[first[inside] + k] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
    return mixed(out), bounds


def class_hashes(words: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """128 bits of each text's sequence of words."""
    begins = np.concatenate([[0], ends[:-1]])
    halves = []
    for base in (_R, _Q):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(words ^ np.uint64(base)) * powers(base, len(words)), dtype=np.uint64)])
        back = powers(pow(base, -1, 2**64), len(words) + 1)
        halves.append(mixed((total[ends] - total[begins]) * back[begins] + (ends - begins).astype(np.uint64)))
    return [h.tobytes() for h in np.stack(halves, 1)]


def minhashes(shingles: np.ndarray, bounds: np.ndarray, places: int = PLACES) -> np.ndarray:
    """The least 32-bit value of each set of shingles under each of ``places`` hash functions; the sets aren't empty."""
    begins = np.concatenate([[0], bounds[:-1]])
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 2**63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 2**63, places, dtype=np.uint64)
    least = np.empty((len(bounds), places), "<u4")
    for p in range(places):
        if len(bounds):
            least[:, p] = np.minimum.reduceat((shingles * factors[p] + terms[p]) >> np.uint64(32), begins)
    return least


def sketches(df: DataFrame, id_col: str, text_col: str, chosen: list[int]) -> DataFrame:
    """id, text_hash, class (128 bits of the words), tokens and values of every row.

    tokens: the minhashes at the chosen places, which name buckets. values: the low
    half of all minhashes, whose agreement is enough to compare two sets of one
    bucket. Both are null without words.
    """
    rows = pick(df, id=id_col, text=text_col)
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    schema = rows.select("id", "text_hash").schema.add("class", "binary").add("tokens", "binary").add("values", "binary")

    def run(batch: pa.RecordBatch) -> dict:
        classes, tokens, values = [], [], []
        for _, block in text_blocks(batch.column(2)):
            words, ends = word_hashes(block)
            classes += class_hashes(words, ends)
            shingles, bounds = shingle_hashes(words, ends)
            full = np.diff(bounds, prepend=0) > 0
            least = minhashes(shingles, bounds[full])
            at = np.cumsum(full) - 1
            tokens += [least[i, chosen].tobytes() if f else None for i, f in zip(at.tolist(), full.tolist())]
            values += [least[i].astype("<u2").tobytes() if f else None for i, f in zip(at.tolist(), full.tolist())]
        return {"id": batch.column(0), "text_hash": batch.column(1), "class": classes, "tokens": tokens, "values": values}

    return map_arrow(rows, run, schema)


def runs_for(recall: float, levels: int = LEVELS, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair at the threshold is missed with a chance of at most 1 - recall, if all its buckets are split ``levels`` times.

    A pair follows the same path through a place with the chance of its similarity.
    """
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** (levels + 1)))


def chosen_places(runs: int, places: int = PLACES, seed: int = 5) -> list[int]:
    """A place for each run, all of them different."""
    if runs > places:
        raise ValueError(f"{runs} runs need as many places; there are {places}")
    return np.random.default_rng(seed).permutation(places)[:runs].tolist()


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def first_buckets(sets: DataFrame, chosen: list[int]) -> DataFrame:
    """bucket and key of each set (key, tokens) and run."""
    names = mixed(np.array(chosen, np.uint64) + np.uint64(1))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                v = np.frombuffer(b"".join(frame["tokens"]), "<u4").reshape(len(frame), -1)
                bucket = mixed(v.astype(np.uint64) ^ names).view(np.int64)
                yield pd.DataFrame({"bucket": bucket.ravel(), "key": np.repeat(frame["key"].to_numpy(), len(chosen))})

    return sets.select("key", "tokens").mapInPandas(run, "bucket bigint, key bigint")


def split_bucket(buckets: np.ndarray, values: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket samples a place, and its rows go on by their values there."""
    name = mixed(buckets.view(np.uint64) ^ np.uint64(_R))
    place = (name >> np.uint64(11)) % np.uint64(values.shape[1])
    at = np.arange(len(buckets))
    return at, mixed(name ^ (values[at, place.astype(np.int64)].astype(np.uint64) + np.uint64(1))).view(np.int64)


def similar_sets(full: list[bytes]) -> np.ndarray:
    """Which pairs of sets (sorted distinct 64-bit values) have a Jaccard similarity of SIMILARITY or more."""
    sets = [np.frombuffer(b, "<u8") for b in full]
    size = np.array([len(s) for s in sets])
    value, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = np.cumsum(times > 1) - 1
    some = times[code] > 1
    owner, code = owner[some], shared[code[some]]
    number = int(shared[-1]) + 1 if len(shared) else 0
    common = np.zeros((len(sets), len(sets)))
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    width = 20_000  # shingles at a time, which bounds the dense part
    for low in range(0, number, width):
        part = slice(*np.searchsorted(code, [low, low + width]))
        dense = np.zeros((len(sets), min(width, number - low)), np.float32)
        dense[owner[part], code[part] - low] = 1
        common += dense @ dense.T
    # |a and b| / |a or b| >= 4/5, in whole numbers
    return 9 * common >= 4 * (size[:, None] + size[None, :])


def shingled(rows: DataFrame) -> DataFrame:
    """key, full (sorted distinct shingle hashes) and size of each row (key, text)."""
    schema = rows.select("key").schema.add("full", "binary").add("size", "long")

    def run(batch: pa.RecordBatch) -> dict:
        full = []
        for _, block in text_blocks(batch.column(1)):
            hashes, bounds = shingle_hashes(*word_hashes(block))
            full += [np.unique(s).tobytes() for s in np.split(hashes, bounds[:-1])]
        return {"key": batch.column(0), "full": full, "size": [len(b) // 8 for b in full]}

    return map_arrow(rows.select("key", "text"), run, schema)


def filtered(rows: DataFrame, keys: DataFrame, number: int, names: list[str]) -> DataFrame:
    """``rows`` with ``likely``: false where (id, text hash), the columns ``names`` of rows, surely is none of the keys (id, text_hash).

    One hash and BITS_EACH bits for each of the ``number`` keys, broadcast as words of
    64 bits; beyond FILTER_BITS bits all rows are likely.
    """
    bits = 1 << max(16, (number * BITS_EACH - 1).bit_length())
    if bits > FILTER_BITS:
        return rows.withColumn("likely", F.lit(True))
    slot = lambda *of: F.pmod(F.xxhash64(*of), F.lit(bits))
    words = keys.select(slot("id", "text_hash").alias("slot")).groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
    placed = rows.withColumn("slot", slot(*names)).withColumn("word", F.expr("slot div 64")).join(F.broadcast(words), "word", "left")
    return placed.withColumn("likely", F.coalesce(F.expr("(bits & shiftleft(1L, cast(slot % 64 as int))) <> 0"), F.lit(False))).drop("slot", "word", "bits")


def texts_of(df: DataFrame, id_col: str, text_col: str, keys: DataFrame, number: int) -> DataFrame:
    """key and text of the rows whose id and text hash are those of a key (key, id, text_hash).

    A filter keeps most other texts out of the shuffle; the join behind it is exact.
    """
    rows = pick(df, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    return filtered(rows, keys, number, ["id", "text_hash"]).where("likely").join(keys, ["id", "text_hash"]).select("key", "text")


def judged(df: DataFrame, id_col: str, text_col: str, recall: float) -> DataFrame:
    """id, text_hash, class, n_links, component_id and first of every row.

    first: (id, text_hash) of the least row of the component, null for rows that can't be linked.
    """
    chosen = chosen_places(runs_for(recall))
    rows = written(sketches(df, id_col, text_col, chosen), "sketches")
    able = rows.where("id IS NOT NULL AND values IS NOT NULL")
    one = able.groupBy("class").agg(F.min(F.struct("id", "text_hash")).alias("one"), F.count(F.lit(1)).alias("weight"), F.min("tokens").alias("tokens"), F.min("values").alias("values"))
    classes = written(one.withColumn("key", F.monotonically_increasing_id()), "classes")
    edges = bucket_links(first_buckets(classes, chosen), classes.select("key", "values"), "<u2", agreement, TIED, CORE, split_bucket, LEVELS)
    facts = classes.select("key", "one", "weight")
    groups = written(connected_components(edges).withColumnRenamed("node", "key").join(facts, "key"), "groups")
    full = shingled(texts_of(df, id_col, text_col, groups.select("key", "one.id", "one.text_hash"), groups.count()))
    full = full.groupBy("key").agg(F.min("full").alias("full"), F.min("size").alias("size"))
    # a link needs sizes within the threshold, so logarithms to its base differ by one at most
    sized = groups.select("key", "component", "weight").join(full, "key").withColumn("bin", F.floor(F.log("size") / F.lit(-math.log(SIMILARITY - 1e-9))))
    compared = written(compare_groups(sized, similar_sets), "compared")
    linked = compared.groupBy(F.col("node").alias("key")).agg(F.sum("links").alias("links"))
    exact = written(connected_components(compared.select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "key"), "exact")
    tops = exact.join(facts, "key").groupBy("component").agg(F.min("one").alias("first"))
    verdict = facts.join(linked, "key", "left").join(exact.join(tops, "component").select("key", "first"), "key", "left")
    verdict = classes.select("class", "key").join(
        verdict.select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("first", "one").alias("first")), "key"
    )
    found = able.select("id", "text_hash", "class").join(verdict.select("class", "n_links", F.col("first.id").alias("component_id"), "first"), "class")
    lone = rows.where("id IS NULL OR values IS NULL").select("class", "id", "text_hash", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = written(found.unionByName(lone, allowMissingColumns=True), "judged")
    discard(rows, classes, groups, compared, exact, edges)
    return out


def near_copies(df: DataFrame, id_col: str, text_col: str, recall: float = 0.9999) -> DataFrame:
    """id, class, n_links, component_id and kept of every row.

    Two documents are linked if their sets of five-word shingles (lower-case words
    between ASCII white space) have a Jaccard similarity of 0.8 or more; documents
    of equal words are, too. n_links: other documents linked directly. component_id:
    the least id reached by links, the own one included. kept: id = component_id.
    A text of one to four words is one shingle; a null or blank text is linked with
    nothing, and so is a row with a null id, which is kept. Each row counts as a
    document of its own: rows that repeat are linked with one another, and rows of
    one id but of different words each have the links of their own text. Texts are
    read whole, whatever their length; ties go to the least id. An empty table gives
    no rows; extra columns, whatever their names, are not read. Each link is found
    with a chance of ``recall`` or more at the threshold, even where every bucket of
    the two is split to the last level, and far more above it; none is false.
    """
    rows = judged(df, id_col, text_col, recall)
    return rows.select("id", "class", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_copies(df: DataFrame, id_col: str, text_col: str, recall: float = 0.9999) -> DataFrame:
    """``df`` with one row of each group of near copies: that of the least id (and, where the id repeats, text hash).

    Rows that can't be linked (null id, null or blank text) all stay; of rows that
    repeat in id and text one stays, whatever their other columns hold.
    """
    rows = judged(df, id_col, text_col, recall)
    each = rows.where("first IS NOT NULL").groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("times"), F.min("first").alias("first"))
    each = each.withColumn("stays", (F.col("first.id") == F.col("id")) & (F.col("first.text_hash") == F.col("text_hash")))
    apart = written(each.where("NOT stays OR times > 1").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "stays"), "apart")
    plain = numbered(df).withColumn("__own", F.col(f"_{place_of(df, id_col)}").cast("bigint")).withColumn("__mark", F.xxhash64(f"_{place_of(df, text_col)}"))
    # most rows stay, and the filter tells so without a shuffle; a null id is never set apart
    keys = apart.select(F.col("__id").alias("id"), F.col("__hash").alias("text_hash"))
    marked = filtered(plain, keys, apart.count(), ["__own", "__mark"])
    own = (F.col("__own") == F.col("__id")) & (F.col("__mark") == F.col("__hash"))
    columns = numbered(df).columns
    out = marked.where("NOT likely").select(*columns).union(marked.where("likely").join(apart, own, "left_anti").select(*columns))
    twice = apart.where("stays")
    if not twice.isEmpty():
        again = plain.join(twice, own).dropDuplicates(["__id", "__hash"])
        out = out.union(again.select(*columns))
    return out.toDF(*df.columns)
