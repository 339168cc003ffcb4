"""Many clusterings of one table at once: bootstraps, subsamples and permutations.

Each round weighs the rows by a hash of their id, so no round has a table of its own.
All rounds' centres are moved together, one pass over the rows an iteration; what is
gathered is a centre a round and cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellframe.functions import stats

from .graph import numbered_by, stored
from .moa import dealt, permutation_p

#: Rows that the first centres are chosen from, and numbers that one pass over the rows may gather.
SEEN_FIRST, GATHERED = 4096, 1 << 22
#: Rows of a part of a table that each iteration reads.
ROWS_A_PART = 4096
#: Chances of at most 0, 1, ... of a Poisson variate of mean 1.
_POISSON = np.cumsum([np.exp(-1) / np.prod(np.arange(1, i + 1)) for i in range(12)])

Weight = Callable[[np.ndarray, int], np.ndarray]


def uniform(marks: np.ndarray, seed: int, r: int) -> np.ndarray:
    """A number from 0 to 1 for each row and round, from the row's hash."""
    with np.errstate(over="ignore"):
        x = marks.astype(np.int64).view(np.uint64) ^ (np.uint64(seed & 0xFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1) * np.uint64(0xD1B54A32D192ED03))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def bootstrap_weight(seed: int) -> Weight:
    """Round 0 takes every row once, others each row a Poisson(1) number of times."""
    return lambda marks, r: np.ones(len(marks), np.int64) if r == 0 else np.searchsorted(_POISSON, uniform(marks, seed, r), "right")


def share_weight(seed: int, share: float) -> Weight:
    """Round 0 takes every row, others each row with chance ``share``."""
    return lambda marks, r: np.ones(len(marks), np.int64) if r == 0 else (uniform(marks, seed, r) < share).astype(np.int64)


def marked_rows(df: DataFrame, id_col: str, vector: str, unit: bool) -> DataFrame:
    """id, mark (a hash of the id) and v of the rows that have a vector, stored in parts of some ROWS_A_PART, as they are read many times."""
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.coalesce(rows.count() // ROWS_A_PART + 1)
    return stored(rows.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string")).alias("mark"), (stats.unit(v) if unit else v).alias("v")), "marked")


def first_centres(x: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows, each with a chance that grows with its squared distance to those before."""
    p = weight / weight.sum()
    chosen = [x[rng.choice(len(x), p=p)]]
    far = ((x - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        p = weight * far
        p = p / p.sum() if p.sum() > 0 else weight / weight.sum()
        chosen.append(x[rng.choice(len(x), p=p)])
        far = np.minimum(far, ((x - chosen[-1]) ** 2).sum(1))
    return np.stack(chosen)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest of the centres (k, d) to each row, the first of those that tie."""
    return ((centres * centres).sum(1)[None] - 2 * x @ centres.T).argmin(1)


def many_kmeans(rows: DataFrame, rounds: int, k: int, weight: Weight, seed: int = 42, iterations: int = 30, tolerance: float = 1e-6) -> np.ndarray:
    """Centres (rounds, k, d) of k-means on the rows (see ``marked_rows``) as each round weighs them.

    First centres come from the SEEN_FIRST rows of least hash, moves from all rows; a
    cluster without rows keeps its centre. Rounds stop moving together.
    """
    head = rows.orderBy("mark", "id").limit(SEEN_FIRST).collect()  # SEEN_FIRST rows
    x, marks = np.array([r["v"] for r in head], float), np.array([r["mark"] for r in head], np.int64)
    if len(x) < k:
        raise ValueError(f"{k} clusters of {len(x)} rows")
    start = []
    for r in range(rounds):
        w = weight(marks, r).astype(float)
        start.append(first_centres(x, w if np.count_nonzero(w) >= k else np.ones(len(x)), k, np.random.default_rng([seed, r])))
    centres = np.stack(start)
    dim = centres.shape[2]
    step = max(1, GATHERED // (k * (dim + 1)))
    for _ in range(iterations):
        moved = centres.copy()
        for low in range(0, rounds, step):
            here = centres[low : low + step]

            def sums(frames: Iterator[pd.DataFrame], here=here, low=low) -> Iterator[pd.DataFrame]:
                n, s = np.zeros(len(here) * k), np.zeros((len(here) * k, dim))
                for f in frames:
                    if f.empty:
                        continue
                    v, mark = np.stack(f["v"]).astype(float), f["mark"].to_numpy()
                    for i, c in enumerate(here):
                        w = weight(mark, low + i)
                        own = nearest_centre(v, c)
                        one = np.zeros((k, len(v)))
                        one[own, np.arange(len(v))] = w
                        n[i * k : (i + 1) * k] += one.sum(1)
                        s[i * k : (i + 1) * k] += one @ v
                at = np.flatnonzero(n)
                if len(at):  # a part of a file may hold no rows, and no lists can't be told from numbers
                    yield pd.DataFrame({"at": at, "n": n[at], "s": list(s[at])})

            def added(frames: Iterator[pd.DataFrame], size=len(here) * k) -> Iterator[pd.DataFrame]:
                n, s = np.zeros(size), np.zeros((size, dim))
                for f in frames:
                    if len(f):
                        np.add.at(n, f["at"].to_numpy(), f["n"].to_numpy())
                        np.add.at(s, f["at"].to_numpy(), np.stack(f["s"]))
                at = np.flatnonzero(n)
                if len(at):  # a part of a file may hold no rows, and no lists can't be told from numbers
                    yield pd.DataFrame({"at": at, "n": n[at], "s": list(s[at])})

            schema = "at bigint, n double, s array<double>"
            table = rows.select("mark", "v").mapInPandas(sums, schema).repartition(2, "at").mapInPandas(added, schema).toArrow()  # a row a round and cluster
            at = table["at"].to_numpy()
            moved[low + at // k, at % k] = table["s"].combine_chunks().flatten().to_numpy().reshape(-1, dim) / table["n"].to_numpy()[:, None]
        shift = np.abs(moved - centres).max()
        centres = moved
        if shift <= tolerance:
            break
    return centres


def rand_of_counts(table: np.ndarray) -> float:
    """The adjusted Rand index of a contingency table; 1 where both sides are one group."""
    pairs = lambda n: (n * (n - 1) / 2).sum()
    both, a, b, n = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), table.sum()
    expected = a * b / (n * (n - 1) / 2) if n > 1 else 0.0
    top = (a + b) / 2
    return float((both - expected) / (top - expected)) if top != expected else 1.0


def agreement(rows: DataFrame, centres: np.ndarray, weight: Weight) -> list[float]:
    """The adjusted Rand index of each round's clusters with those of round 0, over the rows of the round, as often as it takes them."""
    rounds, k = centres.shape[:2]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((rounds, k * k), np.int64)
        for f in frames:
            if f.empty:
                continue
            v, mark = np.stack(f["v"]).astype(float), f["mark"].to_numpy()
            full = nearest_centre(v, centres[0])
            for r in range(1, rounds):
                total[r] += np.bincount(full * k + nearest_centre(v, centres[r]), weight(mark, r), k * k).astype(np.int64)
        r, at = np.nonzero(total)
        yield pd.DataFrame({"r": r, "at": at, "n": total[r, at]})

    tables = np.zeros((rounds, k * k), np.int64)
    for row in rows.select("mark", "v").mapInPandas(count, "r bigint, at bigint, n bigint").groupBy("r", "at").agg(F.sum("n").alias("n")).collect():  # a row a round and pair of clusters
        tables[row["r"], row["at"]] = row["n"]
    return [rand_of_counts(t.reshape(k, k)) for t in tables[1:]]


def cluster_bootstrap(df: DataFrame, id_col: str, vector: str, k: int, rounds: int = 50, seed: int = 0) -> DataFrame:
    """round and the adjusted Rand index of the clusters of a bootstrap sample of unit vectors with those of all rows, for the sampled rows.

    A sample takes each row a Poisson(1) number of times, drawn by a hash of the id; a
    row counts as often as it was drawn.
    """
    rows, weight = marked_rows(df, id_col, vector, unit=True), bootstrap_weight(seed)
    found = agreement(rows, many_kmeans(rows, rounds + 1, k, weight, seed), weight)
    return df.sparkSession.createDataFrame(list(enumerate(found)), "round int, ari double")


def cluster_stability(df: DataFrame, id_col: str, features: Sequence[str], k: int, rounds: int = 50, share: float = 0.8, seed: int = 42) -> list[float]:
    """The adjusted Rand index of k-means on hashed subsamples with that on all rows, a number a round."""
    ready = df.withColumn("__a", F.array(*[F.col(f).cast("double") for f in features]))
    rows, weight = marked_rows(ready, id_col, "__a", unit=False), share_weight(seed, share)
    return agreement(rows, many_kmeans(rows, rounds + 1, k, weight, seed), weight)


def round_labels(rows: DataFrame, centres: np.ndarray, weight: Weight) -> DataFrame:
    """id and labels: a row's cluster in rounds 1, 2, ..., -1 in those that don't take it."""

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if f.empty:
                continue
            v, mark = np.stack(f["v"]).astype(float), f["mark"].to_numpy()
            out = np.stack([np.where(weight(mark, r) > 0, nearest_centre(v, centres[r]), -1) for r in range(1, len(centres))], 1)
            yield pd.DataFrame({"id": f["id"], "labels": list(out.astype(np.int32))})

    schema = rows.select("id").schema.add("labels", T.ArrayType(T.IntegerType()))
    return rows.mapInPandas(label, schema)


def consensus_of(labels: DataFrame, block: int = 512) -> DataFrame:
    """id_a < id_b, co_observed, co_cluster and consensus of all pairs that a round observed, from id and labels.

    Rows are dealt into blocks that meet each other once; the counts of a pair of blocks
    are two products of matrices. All pairs are the result, so it grows with the square of the rows.
    """
    n = max(1, -(-labels.count() // block))
    dealt_rows = labels.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block")).agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("labels")).alias("labels"))
    held = stored(dealt_rows, "blocks")
    side = lambda s: held.select(*[F.col(c).alias(f"{s}_{c}") for c in held.columns])
    met = side("a").repartition(n, "a_block").join(side("b"), F.col("a_block") <= F.col("b_block"))  # blocks, not rows

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(len(f)):
                r = f.iloc[at]
                a, b = np.asarray(r["a_ids"]), np.asarray(r["b_ids"])
                x, y = (np.asarray(r[f"{s}_labels"]).reshape(len(i), -1) for s, i in (("a", a), ("b", b)))
                observed = (x >= 0).astype(float) @ (y >= 0).T.astype(float)
                same = sum((x == c).astype(float) @ (y == c).T.astype(float) for c in range(max(x.max(initial=-1), y.max(initial=-1)) + 1)) + np.zeros_like(observed)
                keep = observed > 0
                keep &= a[:, None] < b[None, :] if r["a_block"] == r["b_block"] else True
                i, j = np.nonzero(keep)
                yield pd.DataFrame({"id_a": np.minimum(a[i], b[j]), "id_b": np.maximum(a[i], b[j]), "co_observed": observed[i, j].astype(np.int64), "co_cluster": same[i, j].astype(np.int64)})

    kind = labels.schema["id"].dataType.simpleString()
    found = met.mapInPandas(compare, f"id_a {kind}, id_b {kind}, co_observed bigint, co_cluster bigint")
    return found.withColumn("consensus", F.col("co_cluster") / F.col("co_observed"))


def consensus_pairs(df: DataFrame, id_col: str, features: Sequence[str], k: int, rounds: int = 50, share: float = 0.8, seed: int = 42) -> DataFrame:
    """id_a < id_b, co_observed, co_cluster and consensus over subsampled clusterings, for all pairs that any round observed."""
    ready = df.withColumn("__a", F.array(*[F.col(f).cast("double") for f in features]))
    rows, weight = marked_rows(ready, id_col, "__a", unit=False), share_weight(seed, share)
    return consensus_of(stored(round_labels(rows, many_kmeans(rows, rounds + 1, k, weight, seed), weight), "labels"))


def cluster_permutation(df: DataFrame, id_col: str, vector: str, cluster: str, permutations: int = 100, seed: int = 0) -> DataFrame:
    """observed, mean and sd of the null, z, p_value and permutations: is the mean cosine silhouette more than chance?

    A row's place in order of ids is permuted by arithmetic, so a task knows the labels
    of all permutations and no row is moved. Silhouettes follow from the sums of unit
    vectors by cluster: one pass sums them for as many permutations as GATHERED numbers
    hold, a second one scores the rows.
    """
    known = df.where(F.col(cluster).isNotNull() & F.col(vector).isNotNull())
    rows = known.select(F.col(id_col).alias("id"), F.col(cluster).cast("string").alias("cluster"), stats.unit(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    sizes = sorted((r["cluster"], r["n"]) for r in rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a cluster
    if not sizes:
        raise ValueError("no row has a cluster and a vector")
    spark, of, classes = df.sparkSession, np.array([n for _, n in sizes]), len(sizes)
    ends, n = np.cumsum(of), int(sum(n for _, n in sizes))
    codes = spark.createDataFrame([(name, i) for i, (name, _) in enumerate(sizes)], "cluster string, code int")
    placed = stored(numbered_by(rows.join(codes, "cluster").select("id", "code", "v"), F.col("id"), "k").select("k", "code", "v"), "placed")
    dim = placed.select(F.size("v")).first()[0]
    step = max(1, GATHERED // (classes * dim))

    def labels(f: pd.DataFrame, p: int) -> np.ndarray:
        return f["code"].to_numpy() if p == 0 else np.searchsorted(ends, dealt(f["k"].to_numpy(), n, seed, p), "right")

    means = np.zeros(permutations + 1)
    for low in range(0, permutations + 1, step):
        some = range(low, min(low + step, permutations + 1))

        def sums(frames: Iterator[pd.DataFrame], some=some) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(some) * classes, dim))
            for f in frames:
                x = np.stack(f["v"])
                for i, p in enumerate(some):
                    c = labels(f, p)
                    order = np.argsort(c, kind="stable")
                    found, first = np.unique(c[order], return_index=True)
                    total[i * classes + found] += np.add.reduceat(x[order], first, axis=0)
            yield pd.DataFrame({"at": np.arange(len(total)), "s": list(total)})

        def added(f: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"at": [f["at"].iat[0]], "s": [np.stack(f["s"]).sum(0)]})

        held = np.zeros((len(some) * classes, dim))
        for row in placed.mapInPandas(sums, "at bigint, s array<double>").groupBy("at").applyInPandas(added, "at bigint, s array<double>").toLocalIterator():  # GATHERED numbers at most
            held[row["at"]] = row["s"]

        def score(frames: Iterator[pd.DataFrame], some=some, held=held) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(some))
            for f in frames:
                x = np.stack(f["v"])
                at = np.arange(len(x))
                for i, p in enumerate(some):
                    c = labels(f, p)
                    far = of[None, :] - x @ held[i * classes : (i + 1) * classes].T
                    alone = of[c] < 2
                    a = far[at, c] / np.maximum(of[c] - 1, 1)
                    far = far / of[None, :]
                    far[at, c] = np.inf
                    b = far.min(1)
                    top = np.maximum(a, b)
                    ok = ~alone & np.isfinite(b) & (top != 0)
                    total[i] += np.divide(b - a, top, out=np.zeros(len(x)), where=ok)[ok].sum()
            yield pd.DataFrame({"p": np.array(some), "s": total})

        for row in placed.mapInPandas(score, "p bigint, s double").groupBy("p").agg(F.sum("s").alias("s")).toLocalIterator():
            means[row["p"]] = row["s"] / n
    observed, null = float(means[0]), means[1:].tolist()
    mean, sd = float(np.mean(null)) if null else None, float(np.std(null, ddof=1)) if len(null) > 1 else None
    z = (observed - mean) / sd if sd else None
    return spark.createDataFrame([(observed, mean, sd, z, permutation_p(observed, null), permutations)], "observed double, null_mean double, null_sd double, z double, p_value double, permutations int")
