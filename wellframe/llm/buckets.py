"""Links between members of shared buckets, and exact comparison inside groups.

``bucket_links`` gets (bucket, key) rows from a locality-sensitive scheme and finds
likely links; ``compare_groups`` compares exactly the members of each linked group.
Both keep a bucket or group of any size out of a single task: large buckets are
swept by a pivot and split again; groups are dealt into bins of members that may be
linked at all, and large bins are compared block by block. Neither emits pairs; each
gives a star (a member, the least it is tied to) a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .components import contracted

#: Members up to which a bucket is compared in one go, and members of a block of a bucket that stays larger.
SMALL, LAST_BLOCK = 48, 256
#: Members and values of one block of a group that is compared exactly.
BLOCK_MEMBERS, BLOCK_VALUES = 512, 400_000

Score = Callable[[np.ndarray, np.ndarray], np.ndarray]
Split = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def matrix(values: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least place that each of n places is tied to by the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def whole_groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that end with a group's last row; rows come sorted by the group."""
    held = None
    for frame in frames:
        if held is not None and len(held):
            frame = pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        last = (frame[by] == frame[by].iloc[-1]).all(axis=1).to_numpy()
        first = len(frame) - int(np.argmin(last[::-1])) if not last.all() else 0
        if first:
            yield frame.iloc[:first]
        held = frame.iloc[first:]
    if held is not None and len(held):
        yield held.reset_index(drop=True)


def by_length(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a frame whose ``values`` are of one length; rows of one bucket are, and stay together in order."""
    length = frame["values"].str.len().to_numpy()
    for n in np.unique(length):
        yield frame[length == n] if (length != n).any() else frame


def bucket_links(members: DataFrame, payload: DataFrame, kind: str, score: Score, link: float, core: float, split: Split, levels: int, alone: float | None = None) -> DataFrame:
    """Edges (a, b), contracted, that tie all members of a bucket whose score is ``link`` or more.

    members: bucket (long), key (long). payload: key, values (binary array of numpy
    type ``kind``, of one length in a bucket). split(buckets, values, level) gives for
    each row its children: (row numbers, child buckets). A bucket of at most SMALL
    members is compared pair by pair. A larger one is held against one pivot: members
    that score ``core`` or more are tied to it and done, all others go on to the
    bucket's children; a key that meets a pivot in several buckets is scored once.
    Pairs that are compared without a pivot between them need only score ``alone``.
    What is still large after ``levels`` levels is compared in blocks.
    """
    found, used = None, []
    for level in range(levels + 1):
        sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("pivot")).where("n > 1")
        placed = written(members.join(sizes, "bucket"), "buckets")
        small = placed.where(F.col("n") <= SMALL).select("bucket", "key")
        large = placed.where(F.col("n") > SMALL)
        last = large.isEmpty()
        if not last and level == levels:
            many = F.ceil(F.col("n") / LAST_BLOCK)
            own = F.pmod(F.xxhash64("key"), many)
            blocks = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (many - 1).cast("int"))))
            blocks = blocks.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "key")
            small, last = small.union(blocks), True
        links = compare_small(small.join(payload, "key"), kind, score, link if alone is None else alone)
        if not last:
            asked = large.where("key <> pivot").groupBy("key", "pivot").agg(F.collect_list("bucket").alias("buckets")).join(payload, "key")
            asked = asked.join(payload.select(F.col("key").alias("pivot"), F.col("values").alias("pivot_values")), "pivot")
            held = written(against_pivots(asked, kind, score), "pivots")
            links = links.union(held.where(F.col("score") >= link).select(F.col("key").alias("a"), F.col("pivot").alias("b")))
            rest = held.where(F.col("score") < core).select("key", F.explode("buckets").alias("bucket")).join(payload, "key")
            members = written(children(rest, kind, split, level), "members")
            used += [held, members]
        links = written(links.distinct(), "links")
        found = links if found is None else found.union(links)
        discard(placed)
        used.append(links)
        if last:
            break
    edges = contracted(found)
    discard(*used)
    return edges


def compare_small(rows: DataFrame, kind: str, score: Score, link: float) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in whole_groups(frames, ["bucket"]):
            for frame in by_length(whole):
                bucket, key, values = frame["bucket"].to_numpy(), frame["key"].to_numpy(), matrix(frame["values"], kind)
                n, at, shift, a, b = len(frame), np.arange(len(frame)), 1, [], []
                while True:
                    at = at[at + shift < n]
                    at = at[bucket[at] == bucket[at + shift]]
                    if not len(at):
                        break
                    for part in np.array_split(at, max(1, len(at) // 20_000)):
                        like = part[score(values[part], values[part + shift]) >= link]
                        a.append(like)
                        b.append(like + shift)
                    shift += 1
                low = stars(np.concatenate(a), np.concatenate(b), n) if a else np.arange(n)
                tied = np.flatnonzero(low != np.arange(n))
                yield pd.DataFrame({"a": key[tied], "b": key[low[tied]]})

    return rows.select("bucket", "key", "values").repartition("bucket").sortWithinPartitions("bucket", "key").mapInPandas(run, "a bigint, b bigint")


def against_pivots(rows: DataFrame, kind: str, score: Score) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for frame in by_length(whole):
                s = score(matrix(frame["values"], kind), matrix(frame["pivot_values"], kind))
                yield frame[["key", "pivot", "buckets"]].assign(score=s)

    return rows.select("key", "pivot", "buckets", "values", "pivot_values").mapInPandas(run, "key bigint, pivot bigint, buckets array<bigint>, score double")


def children(rows: DataFrame, kind: str, split: Split, level: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for frame in by_length(whole):
                at, child = split(frame["bucket"].to_numpy(), matrix(frame["values"], kind), level)
                yield pd.DataFrame({"bucket": child, "key": frame["key"].to_numpy()[at]})

    return rows.select("bucket", "key", "values").mapInPandas(run, "bucket bigint, key bigint").distinct()


Compare = Callable[[list[bytes]], np.ndarray]


def blocks_of(grouped: DataFrame, by: list[str]) -> DataFrame:
    """The number of blocks that the members of each group or bin are dealt into."""
    stats = grouped.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("values"))
    return stats.select(*by, F.greatest(F.ceil(F.col("n") / BLOCK_MEMBERS), F.ceil(F.col("values") / BLOCK_VALUES), F.lit(1)).cast("int").alias("blocks"))


def dealt_blocks(grouped: DataFrame) -> DataFrame:
    """Members for each task's group (component, bin, i, j): a pair of blocks of a bin, or of a bin and the next.

    side: where i and j differ, members of equal side aren't compared.
    """
    counts = written(blocks_of(grouped, ["component", "bin"]), "blocks")
    dealt = grouped.join(counts, ["component", "bin"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    rest = ["key", "weight", "full"]
    inside = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    inside = inside.select("component", "bin", i.alias("i"), j.alias("j"), F.col("own").alias("side"), *rest)
    above = counts.select("component", (F.col("bin") - 1).alias("bin"), F.col("blocks").alias("others"))
    below = counts.select("component", (F.col("bin") + 1).alias("bin"), F.col("blocks").alias("others"))
    many = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    lower = dealt.join(above, ["component", "bin"]).withColumn("other", many)
    lower = lower.select("component", "bin", F.col("own").alias("i"), (-1 - F.col("other")).alias("j"), F.lit(0).alias("side"), *rest)
    upper = dealt.join(below, ["component", "bin"]).withColumn("other", many)
    upper = upper.select("component", F.col("bin") - 1, F.col("other").alias("i"), (-1 - F.col("own")).alias("j"), F.lit(1).alias("side"), *rest)
    return inside.union(lower).union(upper)


def compare_groups(grouped: DataFrame, compare: Compare) -> DataFrame:
    """Exact links inside groups: a row for each member and task that links it, with node, links and low.

    grouped: component, bin (long), key, weight (documents that the member stands
    for), full (binary), size (values in ``full``). Only members of one bin or of two
    that follow each other may be linked. ``compare(list of full)`` gives the boolean
    matrix of linked pairs. A bin is dealt into blocks by a hash of its members and
    each pair of blocks is a task's group, so each pair of members meets once.
    links: weights of the linked members; low: the least key the member is tied to.
    """
    by = ["component", "bin", "i", "j"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, by):
            out = []
            ids = frame[by].to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(frame)]
            key, weight, side = frame["key"].to_numpy(), frame["weight"].to_numpy(), frame["side"].to_numpy()
            full = frame["full"].tolist()
            for low, high in zip(cuts[:-1], cuts[1:]):
                if high - low < 2:
                    continue
                linked = compare(full[low:high])
                np.fill_diagonal(linked, False)
                if ids[low, 2] != ids[low, 3]:
                    linked &= side[low:high, None] != side[None, low:high]
                a, b = np.nonzero(np.triu(linked))
                if len(a):
                    root, tied = stars(a, b, high - low), linked.any(1)
                    out.append(pd.DataFrame({"node": key[low:high], "links": linked @ weight[low:high], "low": key[low:high][root]})[tied])
            if out:
                yield pd.concat(out)

    dealt = dealt_blocks(grouped)
    return dealt.repartition(*by).sortWithinPartitions(*by, "key").mapInPandas(run, "node bigint, links bigint, low bigint")
