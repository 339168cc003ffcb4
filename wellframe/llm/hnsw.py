"""Nearest neighbours by hierarchical navigable small-world graphs, one a shard.

Vectors that are equal are one node, so copies don't crowd a graph. Nodes are dealt to
shards by a hash; each shard's graph is built in a task, wave by wave (the nodes of a
wave are sought in the graph and compared with one another, then linked), and stored
as flat arrays of neighbours in rows of bounded size. Queries visit every shard of
their length; a shard answers with its nearest and these are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, pick, written

#: Links of a node on upper layers (twice as many on the lowest), and width of the search that finds them.
LINKS, BUILD_WIDTH = 16, 64
#: Least width of a search for queries; rows of a wave; nodes in one stored row.
WIDTH, WAVE, STORED = 96, 512, 16_384
#: Nodes of a shard at most; below that a table of n nodes has sqrt(n) / SPREAD shards.
SHARD_NODES, SPREAD = 1_000_000, 20
#: A shard's own vectors that are sought to set its width, and the share of their true neighbours that must be found.
PROBES, RECALL = 48, 0.97


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, length, class (128-bit hash of the components) and full (binary doubles) of the rows that take part."""
    rows = pick(df, id=id_col, vector=vector_col)
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")

    def run(batch: pa.RecordBatch) -> dict:
        lists, at, out = batch.column(1), [], {"length": [], "class": [], "full": []}
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)  # null components become NaN
        for i in range(batch.num_rows):
            x = flat[offsets[i] : offsets[i + 1]]
            if len(x) and np.isfinite(x).all() and x.any():
                raw = x.astype("<f8").tobytes()
                at.append(i)
                out["length"].append(len(x))
                out["class"].append(hashlib.blake2b(raw, digest_size=16).digest())
                out["full"].append(raw)
        return {"id": batch.column(0).take(pa.array(at, pa.int64()))} | out

    return map_arrow(rows, run, "id bigint, length int, class binary, full binary")


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of unit length; scaled by their largest entry first, so that lengths neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of unit vectors q (n, d) and x (n, m, d), in double precision; equal rows get equal values wherever they stand."""
    return np.einsum("nd,nmd->nm", q, x)


def layer_sizes(n: int, links: int = LINKS) -> list[int]:
    """Nodes of each layer, lowest first: each is ``links`` times smaller than the one below, the top one small."""
    out = [n]
    while out[-1] > 4 * links:
        out.append(-(-out[-1] // links))
    return out


def search_layer(x: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``width`` nodes found for each query from its start nodes: (nodes, -1 where fewer; similarities), falling.

    All queries move in step: each expands its best node that wasn't expanded, and
    stops when its best ``width`` nodes are.
    """
    b, n = len(q), len(x)
    nodes = np.full((b, width), -1, np.int32)
    sims = np.full((b, width), -np.inf, np.float32)
    done = np.ones((b, width), bool)
    seen = np.zeros((b, n), bool)
    first = start[:, :width]
    k = first.shape[1]
    sims[:, :k] = np.where(first >= 0, np.matmul(x[np.maximum(first, 0)], q[:, :, None])[:, :, 0], -np.inf)
    nodes[:, :k], done[:, :k] = first, first < 0
    order = np.argsort(-sims, axis=1, kind="stable")
    nodes, sims, done = (np.take_along_axis(a, order, 1) for a in (nodes, sims, done))
    has = nodes >= 0
    seen[np.nonzero(has)[0], nodes[has]] = True
    left = np.arange(b)
    while len(left):
        open_ = ~done[left]
        at = open_.argmax(1)
        go = open_[np.arange(len(left)), at]
        left, at = left[go], at[go]
        if not len(left):
            break
        done[left, at] = True
        near = links[nodes[left, at]]
        new = near >= 0
        rows = left[:, None]
        new &= ~seen[rows, np.maximum(near, 0)]
        # columns that no query needs are left out
        most = int(new.sum(1).max(initial=0))
        if not most:
            continue
        pick_ = np.argsort(~new, axis=1, kind="stable")[:, :most]
        near, new = np.take_along_axis(near, pick_, 1), np.take_along_axis(new, pick_, 1)
        seen[np.broadcast_to(rows, near.shape)[new], near[new]] = True
        s = np.matmul(x[np.maximum(near, 0)], q[left][:, :, None])[:, :, 0]
        s[~new] = -np.inf
        worth = np.flatnonzero((s > sims[left, -1:]).any(1))
        if not len(worth):
            continue
        who = left[worth]
        s, near = s[worth], near[worth]
        all_s = np.concatenate([sims[who], s], 1)
        order = np.argsort(-all_s, axis=1, kind="stable")[:, :width]
        sims[who] = np.take_along_axis(all_s, order, 1)
        nodes[who] = np.where(np.isneginf(sims[who]), -1, np.take_along_axis(np.concatenate([nodes[who], near], 1), order, 1))
        done[who] = np.take_along_axis(np.concatenate([done[who], np.isneginf(s)], 1), order, 1)
    return nodes, sims


def diverse(x: np.ndarray, nodes: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """``most`` of each row's candidates (falling similarity, -1 where none): those nearer to the row than to one taken before, then the nearest of the rest."""
    b, k = nodes.shape
    ok = nodes >= 0
    v = x[np.maximum(nodes, 0)]
    between = np.matmul(v, v.transpose(0, 2, 1))
    taken = np.zeros((b, k), bool)
    worst = np.full((b, k), -np.inf, np.float32)  # similarity to the nearest one taken
    count = np.zeros(b, np.int64)
    for j in range(k):
        take = ok[:, j] & (sims[:, j] > worst[:, j]) & (count < most)
        taken[:, j] = take
        count += take
        worst = np.where(take[:, None], np.maximum(worst, between[:, j]), worst)
    # taken ones first, then the others in order
    rank = np.where(taken, 0, np.where(ok, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(ok, order, 1), np.take_along_axis(nodes, order, 1), -1)
    if out.shape[1] < most:
        out = np.concatenate([out, np.full((b, most - out.shape[1]), -1, out.dtype)], 1)
    return out.astype(np.int32)


def add_back(x: np.ndarray, links: np.ndarray, who: np.ndarray, chosen: np.ndarray) -> None:
    """Lets each chosen node know of the new node that chose it; a node with too many keeps diverse ones."""
    most = links.shape[1]
    at = chosen >= 0
    new = np.broadcast_to(who[:, None], chosen.shape)[at]
    old = chosen[at]
    sim = np.einsum("ij,ij->i", x[old], x[new])
    order = np.lexsort((-sim, old))
    old, new = old[order], new[order]
    keys, first, count = np.unique(old, return_index=True, return_counts=True)
    place = np.arange(len(old)) - np.repeat(first, count)
    used = (links[keys] >= 0).sum(1)
    fits = used + count <= most
    row = np.repeat(np.arange(len(keys)), count)
    easy = fits[row]
    links[old[easy], (used[row] + place)[easy]] = new[easy]
    full = np.flatnonzero(~fits)
    for part in np.array_split(full, max(1, len(full) // WAVE)):
        if not len(part):
            continue
        # of very many newcomers to one node the nearest count, as many as it may keep
        wide = np.full((len(part), 2 * most), -1, np.int32)
        wide[:, :most] = links[keys[part]]
        for i, p in enumerate(part):
            few = new[first[p] : first[p] + min(count[p], most)]
            wide[i, most : most + len(few)] = few
        s = np.matmul(x[np.maximum(wide, 0)], x[keys[part]][:, :, None])[:, :, 0]
        s[wide < 0] = -np.inf
        by = np.argsort(-s, axis=1, kind="stable")
        links[keys[part]] = diverse(x, np.take_along_axis(wide, by, 1), np.take_along_axis(s, by, 1), most)


def build_graph(x: np.ndarray, links: int = LINKS, width: int = BUILD_WIDTH) -> list[np.ndarray]:
    """The layers' neighbour arrays, lowest first, -1 where a node has fewer.

    x: unit vectors in single precision in an order that has nothing to do with their
    places. The nodes of a layer are the first ones of x, so a node has one number on
    all layers. A wave is at most as large as what is linked already.
    """
    sizes = layer_sizes(len(x), links)
    graph = [np.full((n, links * (2 if level == 0 else 1)), -1, np.int32) for level, n in enumerate(sizes)]
    end = 0
    while end < len(x):
        begin, end = end, min(len(x), max(links, min(2 * end, end + wave_rows(len(x)))))
        wave = np.arange(begin, end, dtype=np.int32)
        q = x[wave]
        own = q @ q.T
        np.fill_diagonal(own, -np.inf)
        start = np.zeros((len(wave), 1), np.int32)
        for level in range(len(sizes) - 1, -1, -1):
            there = min(begin, sizes[level])
            inside = np.flatnonzero(wave < sizes[level])
            nodes, sims = np.empty((len(wave), 0), np.int32), np.empty((len(wave), 0), np.float32)
            if there:
                # a layer that the wave doesn't join is only passed
                nodes, sims = search_layer(x[:there], graph[level], q, np.where(start < there, start, 0), width if len(inside) else 4)
                start = nodes[:, :8]
            if not len(inside):
                continue
            others = own[np.ix_(inside, inside)]
            top = np.argsort(-others, axis=1, kind="stable")[:, : min(width, len(inside) - 1)]
            nodes = np.concatenate([nodes[inside], wave[inside][top]], 1)
            sims = np.concatenate([sims[inside], np.take_along_axis(others, top, 1)], 1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :width]
            if not order.shape[1]:
                continue
            chosen = diverse(x, np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1), links)
            graph[level][wave[inside], :links] = chosen
            add_back_new(x, graph[level], wave[inside], chosen)
    return graph


def add_back_new(x: np.ndarray, links: np.ndarray, who: np.ndarray, chosen: np.ndarray) -> None:
    """``add_back`` without links that a pair of one wave has chosen from both sides."""
    both = (links[np.maximum(chosen, 0)] == who[:, None, None]).any(2)
    add_back(x, links, who, np.where(both, -1, chosen))


def wave_rows(n: int) -> int:
    """So many that what a wave has seen takes 64 MB at most."""
    return max(16, min(WAVE, (1 << 26) // max(n, 1)))


def search_graph(x: np.ndarray, graph: list[np.ndarray], q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and similarities of the best ``width`` nodes for each query, through all layers."""
    start = np.zeros((len(q), 1), np.int32)
    for level in range(len(graph) - 1, 0, -1):
        start = search_layer(x[: len(graph[level])], graph[level], q, start, 16)[0][:, :8]
    return search_layer(x, graph[0], q, start, width)


def enough_width(x: np.ndarray, graph: list[np.ndarray], k: int) -> int:
    """The least of WIDTH, 2 WIDTH, ... that finds RECALL of the k nearest of some of the shard's own vectors."""
    n = len(x)
    at = np.unique(np.linspace(0, n - 1, min(PROBES, n)).astype(int))
    true = np.argsort(-(x[at] @ x.T), axis=1, kind="stable")[:, : k + 1]
    width = max(WIDTH, 2 * k)
    while width < n:
        found = search_graph(x, graph, x[at], width)[0]
        hits = sum(len(np.intersect1d(f, t)) for f, t in zip(found, true))
        if hits >= RECALL * true.size:
            break
        width *= 2
    return min(width, n)


def nodes_of(rows: DataFrame, k: int) -> DataFrame:
    """class, length, full and ids of each different vector; ids: its k + 1 smallest, which is all that k answers can name."""
    once = rows.groupBy("class", "id").agg(F.first("length").alias("length"), F.first("full").alias("full"))
    order = Window.partitionBy("class").orderBy("id")  # only the smallest leave a task
    few = once.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k + 1)
    return few.groupBy("class").agg(F.first("length").alias("length"), F.first("full").alias("full"), F.array_sort(F.collect_list("id")).alias("ids"))


def shards_for(n: Column) -> Column:
    """Shards for n nodes: their number and size both grow with the root, up to SHARD_NODES a shard."""
    return F.ceil(F.greatest(F.sqrt(n) / SPREAD, n / SHARD_NODES)).cast("int")


def build_index(df: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """The graphs of all shards, for searches of up to k answers, as rows of at most STORED nodes.

    length, shard, shards and part name a row. first: its first node; nodes: of the
    shard; ids (array of arrays) and full (binary) of its nodes; layers: for each layer
    the flat neighbour array (binary, <i4) of those of its nodes that are on it; width:
    of a search in this shard.
    """
    nodes = written(nodes_of(usable_vectors(df, id_col, vector_col), k), "nodes")
    counts = nodes.groupBy("length").agg(shards_for(F.count(F.lit(1))).alias("shards"))
    mark = F.xxhash64("class")
    dealt = nodes.join(counts, "length").withColumn("shard", F.pmod(mark, F.col("shards")).cast("int")).withColumn("order", F.xxhash64(mark))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("class", "ascending")]).combine_chunks()
        length, shard, shards = (table.column(c)[0].as_py() for c in ("length", "shard", "shards"))
        full = table.column("full")
        x = unit_rows(np.frombuffer(b"".join(full.to_pylist()), "<f8").reshape(-1, length)).astype(np.float32)
        graph = build_graph(x)
        width = enough_width(x, graph, k)
        out = {c: [] for c in INDEX.split(", ")}
        out = {c.split(" ")[0]: [] for c in out}
        for part, first in enumerate(range(0, len(x), STORED)):
            own = table.slice(first, STORED)
            values = (length, shard, shards, part, first, len(x), width, own.column("ids").to_pylist(), b"".join(own.column("full").to_pylist()), [g[first : first + STORED].astype("<i4").tobytes() for g in graph])
            for name, value in zip(out, values):
                out[name].append(value)
        return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), INDEX_TYPES)})

    return written(spread(dealt).groupBy("length", "shard").applyInArrow(run, INDEX), "graphs")


def spread(rows: DataFrame) -> DataFrame:
    """Shards dealt to as many tasks as the session shuffles into: the work is in the graphs, so small tasks aren't put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "length", "shard")


INDEX = "length int, shard int, shards int, part int, first int, nodes int, width int, ids array<array<bigint>>, full binary, layers array<binary>"
INDEX_TYPES = [*[pa.int32()] * 7, pa.list_(pa.list_(pa.int64())), pa.binary(), pa.list_(pa.binary())]


class Shard:
    """A shard's graph, put together from its stored rows."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: r["part"])
        d = rows[0]["length"]
        self.width = rows[0]["width"]
        self.ids = [i for r in rows for i in r["ids"]]
        self.unit = unit_rows(np.frombuffer(b"".join(r["full"] for r in rows), "<f8").reshape(-1, d))
        self.x = self.unit.astype(np.float32)
        self.graph = [np.frombuffer(b"".join(r["layers"][level] for r in rows), "<i4").reshape(-1, LINKS * (2 if level == 0 else 1)) for level in range(len(rows[0]["layers"]))]

    def nearest(self, ids: list[int], full: list[bytes], k: int) -> tuple[list[int], list[int], list[float]]:
        """(query, id, cosine) of each query's k nearest ids but its own; equal cosines go to the smaller id."""
        out: tuple[list[int], list[int], list[float]] = ([], [], [])
        q = unit_rows(np.frombuffer(b"".join(full), "<f8").reshape(len(ids), -1))
        step = wave_rows(len(self.x))
        for at in range(0, len(ids), step):
            some = q[at : at + step]
            nodes, sims = search_graph(self.x, self.graph, some.astype(np.float32), max(self.width, k + 1))
            # all that single precision can't part from the nearest k + 1 is compared in double precision
            edge = sims[:, min(k, sims.shape[1] - 1)]
            keep = (nodes >= 0) & (sims >= np.where(np.isfinite(edge), edge, -2.0)[:, None] - 1e-5)
            for i in range(len(some)):
                near = nodes[i][keep[i]]
                score = cosines(some[i : i + 1], self.unit[near][None])[0]
                best: dict[int, float] = {}
                for node, s in zip(near.tolist(), score.tolist()):
                    for other in self.ids[node]:
                        if other != ids[at + i] and s > best.get(other, -2.0):
                            best[other] = s
                for other, s in sorted(best.items(), key=lambda t: (-t[1], t[0]))[:k]:
                    out[0].append(ids[at + i])
                    out[1].append(other)
                    out[2].append(s)
        return out


def search_index(index: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """query_id, rank, id and score of each query's k nearest ids of the index but its own.

    Queries go to all shards of their length; a task holds one shard and reads its
    queries in batches. Several vectors of one query id count as one query: an id's
    score is its best one.
    """
    asked = usable_vectors(queries, id_col, vector_col).dropDuplicates(["id", "class"])
    shards = index.where("part = 0").select("length", "shard")
    stored = index.select("length", "shard", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("query_id"), *[c for c in index.columns if c not in ("length", "shard")])
    blank = [F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns if c not in ("length", "shard", "kind", "query_id", "full")]
    sent = asked.join(shards, "length").select("length", "shard", F.lit(1).alias("kind"), F.col("id").alias("query_id"), "full", *blank)
    both = spread(stored.unionByName(sent)).sortWithinPartitions("length", "shard", "kind", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, shard = None, [], None
        for batch in batches:
            name = list(zip(batch.column("length").to_pylist(), batch.column("shard").to_pylist(), batch.column("kind").to_pylist()))
            cuts = [0, *(i for i in range(1, len(name)) if name[i] != name[i - 1]), len(name)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if name[low][:2] != at:
                    at, parts, shard = name[low][:2], [], None
                own = batch.slice(low, high - low)
                if name[low][2] == 0:
                    parts += own.to_pylist()
                    continue
                if shard is None:
                    shard, parts = Shard(parts), []
                q, i, s = shard.nearest(own.column("query_id").to_pylist(), own.column("full").to_pylist(), k)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "id", "score"])

    answers = both.mapInArrow(run, "query_id bigint, id bigint, score double")
    best = answers.repartition("query_id").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest_neighbours(df: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), id and score (cosine in double precision) of the k nearest rows of ``df`` found for each query.

    Candidates are all rows but those of the query's own id; equal scores go to the
    smaller id, so copies of a vector are named in order of their ids. Rows whose id
    is null, or whose vector is null, empty or zero or holds null or non-finite
    components, take no part: as queries they have no rows. Vectors of unequal length
    are never compared. Rows that repeat count once; rows that share an id are one
    candidate by its best score. Empty tables give no rows; extra columns, whatever
    their names, are not read. Scores are exact; which rows are found is not certain,
    but each shard widens its searches until RECALL of the true neighbours of PROBES
    of its own vectors are found, compared with all of the shard.
    """
    return search_index(build_index(df, id_col, vector_col, k), queries, id_col, vector_col, k)
