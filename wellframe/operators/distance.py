"""Distances, neighbours and what follows from neighbour lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wellframe.functions import stats

from .graph import stored

METRICS = ("cosine", "euclidean", "cityblock", "correlation", "spearman")


def prepared(v: Column, metric: str) -> Column:
    """The vector whose dot product or difference gives the metric."""
    v = F.transform(v, lambda x: x.cast("double"))
    if metric == "cosine":
        return stats.unit(v)
    if metric == "correlation":
        return stats.unit(stats.centred(v))
    if metric == "spearman":
        return stats.unit(stats.centred(stats.array_ranks(v)))
    if metric in ("euclidean", "cityblock"):
        return v
    raise ValueError(f"metric must be one of {METRICS}")


def distance(a: Column, b: Column, metric: str) -> Column:
    """Between prepared vectors."""
    return {"euclidean": stats.euclidean, "cityblock": stats.cityblock}.get(metric, lambda x, y: 1 - stats.dot(x, y))(a, b)


#: Rows of a block of which each two meet, at most, and pairs that are handed on together.
PAIR_BLOCK, PAIRS_A_BATCH = 2048, 1 << 19


def met_blocks(df: DataFrame, id_col: str, vector: str, metric: str, block: int | None = None) -> DataFrame:
    """a_ids, a, b_ids, b and same: blocks of prepared vectors, each two once and each with itself (``same``).

    Blocks are stored and dealt round a circle, each meeting the half that follows it, so
    that tasks are even. Small tables have some 24 blocks, so that there are tasks for all cores.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).count() if block is None else None
    block = block or min(PAIR_BLOCK, max(128, (rows or 0) // 24))
    held = stored(blocks(df, id_col, vector, metric, "x", block).withColumn("at", F.monotonically_increasing_id()), "blocks")
    numbers = [r["at"] for r in held.select("at").orderBy("at").collect()]  # a number a block
    n = len(numbers)
    places = df.sparkSession.createDataFrame([(at, i) for i, at in enumerate(numbers)], "at bigint, place int")
    placed = held.join(F.broadcast(places), "at")
    a = placed.select(F.col("place").alias("i"), F.col("x_ids").alias("a_ids"), F.col("x").alias("a")).repartition(max(1, n), "i")
    b = placed.select(F.col("place").alias("j"), F.col("x_ids").alias("b_ids"), F.col("x").alias("b"))
    apart = F.pmod(F.col("j") - F.col("i"), F.lit(max(1, n)))
    met = a.join(b, (2 * apart < n) | ((2 * apart == n) & (F.col("i") < F.col("j"))))  # blocks, not rows
    return met.select("a_ids", "a", "b_ids", "b", (F.col("i") == F.col("j")).alias("same"))


def arrow_blocks(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Of each row of a batch the lists called ``names`` as arrays, without copies where they are numbers without gaps."""
    lists = [batch.column(n) for n in names]
    for at in range(batch.num_rows):
        yield tuple(c[at].values.to_numpy(zero_copy_only=False) for c in lists)


def away_from_zero(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Rounded to so many places, halves away from zero; minus zero becomes zero."""
    return x if digits is None else np.copysign(np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits, x) + 0.0


def _block_pairs(metric: str, digits: int | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (a, x, b, y), same in zip(arrow_blocks(batch, "a_ids", "a", "b_ids", "b"), batch.column("same").to_pylist()):
                x, y = block_rows(x, len(a)), block_rows(y, len(b))
                step = max(1, PAIRS_A_BATCH // len(b))
                for low in range(0, len(a), step):
                    mine = a[low : low + step]
                    d = away_from_zero(block_distances(x[low : low + step], y, metric), digits)
                    keep = mine[:, None] < b[None, :] if same else mine[:, None] != b[None, :]
                    if keep.all():
                        p, q, d = np.repeat(mine, len(b)), np.tile(b, len(mine)), d.ravel()
                    else:
                        i, j = np.nonzero(keep)
                        p, q, d = mine[i], b[j], d[i, j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q), schema.field(0).type), pa.array(np.maximum(p, q), schema.field(1).type), pa.array(d)], schema=schema)

    return run


def pairwise(df: DataFrame, id_col: str, vector: str, metric: str = "cosine", digits: int | None = None) -> DataFrame:
    """id_a < id_b and their distance, NULL where a vector is: all pairs, so the result grows with the square of the rows.

    Each two blocks of rows meet in a task, which hands its pairs on in parts; ``digits``
    rounds them there.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id_a", kind), T.StructField("id_b", kind), T.StructField("distance", T.DoubleType())])
    found = met_blocks(df, id_col, vector, metric).mapInArrow(_block_pairs(metric, digits, to_arrow_schema(schema)), schema)
    ids = df.select(F.col(id_col).alias("id"), F.col(vector).isNull().alias("gap"))
    left, right = ids.where("gap").select(F.col("id").alias("l")), ids.select(F.col("id").alias("r"), "gap")
    gaps = left.join(right, (F.col("l") < F.col("r")) | ((F.col("l") > F.col("r")) & ~F.col("gap")))
    return found.union(gaps.select(F.least("l", "r"), F.greatest("l", "r"), F.lit(None).cast("double")))


def blocks(df: DataFrame, id_col: str, vector: str, metric: str, name: str, block: int | None = 512, within: Sequence[str] = ()) -> DataFrame:
    """name_ids and name (prepared vectors, one after another in one array): rows dealt into lists of about ``block`` by a hash; those without id or vector are left out.

    ``within``: columns whose values part the rows into sets, each dealt by itself. Without ``block`` it is 512, in large tables up to 4,096.
    """
    v = df.select(*within, F.col(id_col).alias("id"), prepared(F.col(vector), metric).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    largest = v.groupBy(*within).count().agg(F.max("count")).first()[0] if within else v.count()
    block = block or max(512, min(4096, (largest or 0) // 24))
    n = max(1, -(-(largest or 0) // block))
    dealt = v.groupBy(*within, F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"))
    # a product of p by q partitions has p q tasks: about eight blocks go to each partition
    made = dealt.agg(F.collect_list("id").alias(f"{name}_ids"), F.flatten(F.collect_list("v")).alias(name)).drop("block")
    return made if within else made.coalesce(-(-n // 8))


def block_rows(values, n: int) -> np.ndarray:
    """The n vectors of a block as rows."""
    return np.asarray(values, float).reshape(n, -1)


def prepared_rows(x: np.ndarray, metric: str) -> np.ndarray:
    """Of a matrix what ``prepared`` makes of a column."""
    if metric in ("euclidean", "cityblock"):
        return x
    if metric == "spearman":
        x = pd.DataFrame(x).rank(axis=1).to_numpy()
    if metric != "cosine":
        x = x - x.mean(1, keepdims=True)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def block_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Of all rows of x to all of y, prepared.

    Euclidean and city block take true differences, a slice of x at a time, so that
    copies are at 0 whatever the width and size of the blocks.
    """
    if metric not in ("euclidean", "cityblock"):
        return 1 - x @ y.T
    out = np.zeros((len(x), len(y)))
    step, columns = max(1, (1 << 15) // max(1, len(y))), np.ascontiguousarray(y.T)
    held = np.empty((min(step, len(x)), len(y)))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        t, total = held[: len(part)], out[at : at + step]
        for c in range(x.shape[1]):
            np.subtract(part[:, c, None], columns[c], out=t)
            np.abs(t, out=t) if metric == "cityblock" else np.multiply(t, t, out=t)
            total += t
    return out if metric == "cityblock" else np.sqrt(out, out=out)


#: Share of a product's pairs above which all its distances are taken in double precision at once.
MANY = 0.05


def first_of_rows(row: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least (d, id) of each row, in order of rows."""
    order = np.lexsort((ids if ids.dtype != object else np.unique(ids, return_inverse=True)[1].ravel(), d, row))
    sorted_rows = row[order]
    new = np.flatnonzero(np.r_[True, sorted_rows[1:] != sorted_rows[:-1]]) if len(row) else np.zeros(0, np.int64)
    return order[np.arange(len(row)) - np.repeat(new, np.diff(np.r_[new, len(row)])) < k]


class Best:
    """The k nearest of each query found so far, as blocks of the base come by; ties to the smaller id.

    Products in single precision tell which pairs may be among them, with a margin for
    their rounding; only those pairs' distances are taken in double precision, rounded to 12 places.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, metric: str, k: int):
        self.ids, self.x, self.metric, self.k = ids, x, metric, k
        self.row, self.d, self.near = np.zeros(0, np.int64), np.zeros(0), ids[:0]
        self.bound = np.full(len(ids), np.inf)
        self.square = (x * x).sum(1)
        self.single = x.astype(np.float32) if metric != "cityblock" else None

    def exact(self, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        x = self.x[rows]
        return np.round(np.sqrt(((x - y) ** 2).sum(1)) if self.metric == "euclidean" else 1 - np.einsum("ij,ij->i", x, y), 12)

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        n, k, euclidean = len(ids), self.k, self.metric == "euclidean"
        if not n or not len(self.ids):
            return
        length = np.sqrt(max((y * y).sum(1).max(), 0.0)), np.sqrt(self.square.max())
        usable = self.single is not None and n > k and all(1e-9 < v < 1e15 for v in length)
        if usable:
            other, half = y.astype(np.float32).T, ((y * y).sum(1) / 2).astype(np.float32)
            error = (y.shape[1] + 8) * 2.0**-23 * (length[0] * length[1] + (length[0] ** 2 if euclidean else 0))
        found = [(self.row, self.d, self.near)]
        step = max(16, (1 << 20) // n)
        for low in range(0, len(self.ids), step):
            bound, mine = self.bound[low : low + step], self.ids[low : low + step]
            pick = None
            if usable:
                s = self.single[low : low + step] @ other
                if euclidean:
                    s -= half
                limit = ((self.square[low : low + step] - (bound + 1e-11) ** 2) / 2 if euclidean else 1 - bound - 2e-12) - error
                if not np.isfinite(bound).all():
                    s[mine[:, None] == ids[None, :]] = -np.inf
                    limit = np.maximum(limit, np.partition(s, n - k, axis=1)[:, n - k].astype(float) - 2 * error)
                may = s >= limit.astype(np.float32)[:, None]
                if np.count_nonzero(may) <= max(4096, MANY * may.size):
                    pick = np.flatnonzero(may)
            if pick is None:
                d = np.round(block_distances(self.x[low : low + step], y, self.metric), 12)
                d[mine[:, None] == ids[None, :]] = np.inf
                most = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1]) if n > k else bound
                row, at = np.nonzero((d <= most[:, None]) & np.isfinite(d))
                d = d[row, at]
            else:
                row, at = np.divmod(pick, n)
                d = np.concatenate([self.exact(low + row[i : i + 65536], y[at[i : i + 65536]]) for i in range(0, max(1, len(row)), 65536)])
                keep = (d <= bound[row]) & (mine[row] != ids[at])
                row, at, d = row[keep], at[keep], d[keep]
            kept = first_of_rows(row, d, ids[at], k)
            found.append((low + row[kept], d[kept], ids[at[kept]]))
        row, d, near = (np.concatenate(c) for c in zip(*found))
        kept = first_of_rows(row, d, near, k)
        self.row, self.d, self.near = row[kept], d[kept], near[kept]
        last = np.searchsorted(self.row, np.arange(len(self.ids)), "right") - 1
        full = np.bincount(self.row, minlength=len(self.ids)) == k
        self.bound[full] = self.d[last[full]]


def _block_top(metric: str, k: int, schema: pa.Schema):
    """The k nearest of each query among the base blocks that follow each other in a task."""

    def rows(best: Best) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((best.ids[best.row], best.near, best.d), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for q_ids, q, b_ids, b in arrow_blocks(batch, "q_ids", "q", "b_ids", "b"):
                if best is None or len(best.ids) != len(q_ids) or (best.ids != q_ids).any():
                    if best is not None:
                        yield rows(best)
                    best = Best(q_ids.copy(), block_rows(q, len(q_ids)).copy(), metric, k)
                best.meet(b_ids, block_rows(b, len(b_ids)))
        if best is not None:
            yield rows(best)

    return run


def _block_all(metric: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for q_ids, q, b_ids, b in zip(f["q_ids"], f["q"], f["b_ids"], f["b"]):
                qi, bi = np.asarray(q_ids), np.asarray(b_ids)
                d = block_distances(block_rows(q, len(qi)), block_rows(b, len(bi)), metric)
                at, other = np.nonzero(qi[:, None] != bi[None, :])
                yield pd.DataFrame({"id_a": qi[at], "id_b": bi[other], "distance": d[at, other]})

    return run


def distances_from(queries: DataFrame, df: DataFrame, id_col: str, vector: str, metric: str = "cosine", block: int = 512) -> DataFrame:
    """id_a (of a query), id_b (of another row) and their distance: a set of queries against all rows, block by block."""
    id_type = df.schema[id_col].dataType
    pairs = blocks(queries, id_col, vector, metric, "q", block).crossJoin(blocks(df, id_col, vector, metric, "b", block))
    schema = T.StructType([T.StructField("id_a", id_type), T.StructField("id_b", id_type), T.StructField("distance", T.DoubleType())])
    return pairs.mapInPandas(_block_all(metric), schema)


def nearest(df: DataFrame, id_col: str, vector: str, k: int = 10, metric: str = "cosine", base: DataFrame | None = None, block: int | None = None, within: Sequence[str] = ()) -> DataFrame:
    """query_id, neighbour_id, rank (from 1) and distance of the k nearest other rows, exactly.

    Ties go to the smaller id. Rows are dealt into blocks of about ``block`` by a hash;
    a task compares blocks of queries with some blocks of the base and keeps k for
    each query (see ``Best``), so what is shuffled on is k rows for each query and task, never all
    distances. The work is quadratic, as exact neighbours are; ``base`` limits it to
    a set to search in. With ``within`` only rows of equal values there are compared, as
    many searches at once; ids are unique over all of them.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    id_type = df.schema[id_col].dataType

    # the blocks' product is the exact search itself: n/block rows on each side
    asked, base = blocks(df, id_col, vector, metric, "q", block, within), blocks(df if base is None else base, id_col, vector, metric, "b", block, within)
    if within:  # a set of many blocks is spread over tasks by its pairs
        pairs = asked.join(base, list(within)).drop(*within).repartition(F.col("q_ids")[0], F.col("b_ids")[0])
    else:
        pairs = asked.crossJoin(base)
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("neighbour_id", id_type), T.StructField("distance", T.DoubleType())])
    best = pairs.mapInArrow(_block_top(metric, k, to_arrow_schema(schema)), schema)
    w = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "neighbour_id", "rank", "distance")


def neighbour_classes(neighbours: DataFrame, labels: DataFrame, id_col: str, class_col: str) -> DataFrame:
    """query_id, neighbour_class, n and fraction of each class among a query's neighbours."""
    named = labels.select(F.col(id_col).alias("neighbour_id"), F.coalesce(F.col(class_col).cast("string"), F.lit("nan")).alias("neighbour_class"))
    counted = neighbours.join(named, "neighbour_id", "left").groupBy("query_id", "neighbour_class").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("query_id")))


def topology_edges(neighbours: DataFrame) -> DataFrame:
    """Undirected edges, once each, with the smaller distance."""
    low, high = F.least("query_id", "neighbour_id"), F.greatest("query_id", "neighbour_id")
    return neighbours.groupBy(low.alias("source"), high.alias("target")).agg(F.min("distance").alias("distance"))


def shared_neighbours(neighbours: DataFrame, first, second) -> DataFrame:
    """Neighbours of both queries, with both distances and similarities."""

    def of(query, name: str) -> DataFrame:
        mine = neighbours.where(F.col("query_id") == F.lit(query)).groupBy("neighbour_id")
        return mine.agg(F.min("distance").alias(f"{name}_distance"))

    both = of(first, "first").join(of(second, "second"), "neighbour_id")
    return both.withColumn("first_similarity", 1 - F.col("first_distance")).withColumn("second_similarity", 1 - F.col("second_distance"))


def neighbour_lists(neighbours: DataFrame) -> DataFrame:
    """query_id and its neighbours in order of rank, itself left out."""
    kept = neighbours.where(F.col("query_id") != F.col("neighbour_id"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "neighbour_id")))
    return kept.groupBy("query_id").agg(F.transform(ordered, lambda s: s["neighbour_id"]).alias("ids"))


def neighbour_overlap(baseline: DataFrame, run: DataFrame, k: int | str = "auto", p: float = 0.9) -> DataFrame:
    """query_id, k, jaccard and rbo of the two runs' lists; k auto is the lesser of their median lengths."""
    a, b = neighbour_lists(baseline), neighbour_lists(run)
    if k == "auto":
        half = lambda t: t.agg(F.floor(F.percentile(F.size("ids"), F.lit(0.5)))).first()[0] or 0
        k = int(min(half(a), half(b)))
    both = a.join(b.select("query_id", F.col("ids").alias("other")), "query_id")
    first, second = F.slice("ids", 1, k), F.slice("other", 1, k)
    return both.select("query_id", F.lit(k).alias("k"), stats.jaccard(first, second).alias("jaccard"), stats.rank_biased_overlap(first, second, p).alias("rbo"))


def overlap_of_runs(runs: dict[str, DataFrame], baseline: str) -> DataFrame:
    """query_id, run, shared and jaccard: neighbours that each other run's list of a query has in common with the baseline's."""
    base, out = neighbour_lists(runs[baseline]), None
    for name in sorted(set(runs) - {baseline}):
        both = base.join(neighbour_lists(runs[name]).select("query_id", F.col("ids").alias("other")), "query_id", "left")
        other = F.coalesce("other", F.slice("ids", 1, 0))
        one = both.select("query_id", F.lit(name).alias("run"), F.size(F.array_intersect("ids", other)).cast("bigint").alias("shared"), stats.jaccard(F.col("ids"), other).alias("jaccard"))
        out = one if out is None else out.union(one)
    if out is None:
        raise ValueError("there is no run beside the baseline")
    return out


def selected_queries(df: DataFrame, id_col: str, asked: Sequence, column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose id, or whose ``column``, is asked for; asked value, n_rows and found). Values are compared as trimmed text without regard to case."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(str(a),) for a in dict.fromkeys(asked)], "asked string").withColumn("__key", F.lower(F.trim("asked")))
    keyed = df.withColumn("__key", F.lower(F.trim(F.col(column or id_col).cast("string"))))
    rows = keyed.join(F.broadcast(wanted.select("__key").distinct()), "__key", "left_semi")  # the list that the caller gives
    counts = rows.groupBy("__key").agg(F.count(F.lit(1)).alias("n"))
    report = wanted.join(counts, "__key", "left").select("asked", F.coalesce("n", F.lit(0)).alias("n_rows"), F.col("n").isNotNull().alias("found"))
    return rows.drop("__key"), report


def overlap_summary(overlap: DataFrame) -> DataFrame:
    q = lambda c, x: F.percentile(c, F.lit(x))
    return overlap.agg(
        F.count(F.lit(1)).alias("n_queries"), *[f.alias(f"{c}_{n}") for c in ("jaccard", "rbo") for n, f in (("mean", F.avg(c)), ("median", q(c, 0.5)), ("q25", q(c, 0.25)), ("q75", q(c, 0.75)))]
    )


def retrieval_rates(neighbours: DataFrame, facts: DataFrame, id_col: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """For each column: the share of queries whose nearest, and any of whose k nearest, has the same value."""
    mine = facts.select(F.col(id_col).alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in columns])
    theirs = facts.select(F.col(id_col).alias("neighbour_id"), *[F.col(c).alias(f"n_{c}") for c in columns])
    seen = neighbours.where(F.col("rank") <= k).join(mine, "query_id").join(theirs, "neighbour_id")
    same = {c: F.coalesce(F.col(f"q_{c}") == F.col(f"n_{c}"), F.lit(False)) for c in columns}
    by = seen.groupBy("query_id").agg(*[F.max((s & (F.col("rank") == 1)).cast("double")).alias(f"top1_{c}") for c, s in same.items()], *[F.max(s.cast("double")).alias(f"topk_{c}") for c, s in same.items()])
    return by.agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(f"{t}_{c}").alias(f"{t}_same_{c}") for c in columns for t in ("top1", "topk")])


def silhouette(df: DataFrame, id_col: str, vector: str, cluster: str, metric: str = "euclidean") -> DataFrame:
    """id, a, b and silhouette of each row, exactly.

    For cosine the mean distance to a cluster follows from the cluster's sum of unit
    vectors, so no pairs are formed; other metrics compare all pairs, for tables of
    up to some ten thousand rows.
    """
    base = df.where(F.col(cluster).isNotNull()).select(F.col(id_col).alias("id"), F.col(cluster).cast("string").alias("c"), prepared(F.col(vector), metric).alias("v"))
    sizes = base.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    if metric in ("cosine", "correlation", "spearman"):
        sums = base.select("c", F.posexplode("v").alias("i", "x")).groupBy("c", "i").agg(F.sum("x").alias("s"))
        sums = sums.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("s"))
        # a row for each cluster, broadcast
        against = base.crossJoin(F.broadcast(sums.join(sizes, "c").withColumnsRenamed({"c": "k"})))
        by = against.select("id", "c", "k", "n", (F.col("n") - stats.dot(F.col("v"), F.col("s"))).alias("total"))
        own_self = F.lit(0.0)
    else:
        other = base.select(F.col("id").alias("o"), F.col("c").alias("k"), F.col("v").alias("w"))
        pairs = base.join(other, F.col("id") != F.col("o"))
        by = pairs.groupBy("id", "c", "k").agg(F.sum(distance(F.col("v"), F.col("w"), metric)).alias("total")).join(F.broadcast(sizes.withColumnRenamed("c", "k")), "k")
        own_self = F.lit(0.0)
    own = F.when(F.col("c") == F.col("k"), (F.col("total") - own_self) / F.when(F.col("n") > 1, F.col("n") - 1))
    far = F.when(F.col("c") != F.col("k"), F.col("total") / F.col("n"))
    ab = by.groupBy("id", "c").agg(F.max(own).alias("a"), F.min(far).alias("b"))
    top = F.greatest("a", "b")
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (top == 0), 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return ab.select("id", F.col("c").alias("cluster"), "a", "b", value.alias("silhouette"))
