"""Near copies among vectors by lattice hashing.

Vectors of unit length are projected at random to 16 dimensions and each half of
eight is decoded to the nearest point of the E8 lattice; both points name a cell.
There are several tables, each with a projection of its own. A vector goes to its
cell and to the cells where one half moves to a neighbouring lattice point, those
nearest to it. Vectors that meet in a small cell and may be linked form groups; where
a crowded cell is held against one member only, those that are tied to it form one, so
that by the angle's triangle inequality no link is lost; in each group cosines are taken in double precision, but for pairs whose angles
to one of the members differ too much for a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import blocks_of, bucket_links, by_length, compare_groups
from .common import discard, map_arrow, pick, written
from .components import connected_components
from .subwords import mixed

TABLES, PROBES, SCALE, LEVELS = 12, 3, 1.6, 3
COSINE, TIED, CORE = 0.93, 0.80, 0.97


def shortest_vectors() -> np.ndarray:
    """The 240 vectors of least length of E8: two ones of any sign, or halves with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if s.count(-1.0) % 2 == 0]
    return np.array(out)


NEIGHBOURS = shortest_vectors()


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest integer points of even sum: round, and where the sum is odd move the coordinate that was rounded most."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(1) % 2 != 0)
    if len(odd):
        off = x[odd] - point[odd]
        worst = np.abs(off).argmax(1)
        point[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return point


def nearest_lattice(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, the even integer points and the same moved by one half, to each row."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(nearer[:, None], half, whole)


def projection(table: int, dim: int) -> np.ndarray:
    """16 random directions, of a scale that keeps lengths in each half of eight on average."""
    return np.random.default_rng([23, table]).normal(0, SCALE / np.sqrt(8), (dim, 16))


def named(points: np.ndarray) -> np.ndarray:
    """A hash of each lattice point (doubled, so whole)."""
    whole = np.rint(2 * points).astype(np.int64).view(np.uint64)
    out = np.full(len(points), 17, np.uint64)
    for k in range(points.shape[1]):
        out = mixed(out ^ (whole[:, k] + np.uint64(0x9E37 * (k + 1))))
    return out


def cells(x: np.ndarray, table: int, probes: int = PROBES) -> np.ndarray:
    """Names of each row's cell and of its probed neighbours: one half moved at a time."""
    y = x @ projection(table, x.shape[1])
    names = []
    for half in (y[:, :8], y[:, 8:]):
        point = nearest_lattice(half)
        toward = (half - point) @ NEIGHBOURS.T
        best = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
        names.append(np.stack([named(point), *(named(point + NEIGHBOURS[best[:, p]]) for p in range(probes))], 1))
    left, right = names
    pairs = [(0, 0), *((p, 0) for p in range(1, probes + 1)), *((0, p) for p in range(1, probes + 1))]
    return np.stack([mixed(left[:, a] ^ mixed(right[:, b] + np.uint64(table + 1))) for a, b in pairs], 1)


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and the class, unit vector in single (values) and double (full) precision of every row.

    class and vectors are null where the row can't be linked: a null id or label, a
    vector that is null, zero or empty, or that holds null or non-finite components.
    """
    rows = pick(df, id=id_col, label=label_col, vector=vector_col)
    rows = rows.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("string").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    schema = rows.select("id", "label").schema.add("class", "binary").add("values", "binary").add("full", "binary")

    def run(batch: pa.RecordBatch) -> dict:
        out: dict = {"id": batch.column(0), "label": batch.column(1), "class": [], "values": [], "full": []}
        labels, ids = batch.column(1), batch.column(0)
        lists = batch.column(2)
        for i in range(batch.num_rows):
            unit = None
            if ids[i].is_valid and labels[i].is_valid and lists[i].is_valid and len(lists[i]):
                v = lists[i].values
                if v.null_count == 0:
                    x = v.to_numpy(zero_copy_only=False).astype(np.float64)
                    top = np.abs(x).max(initial=0.0)
                    if np.isfinite(top) and top > 0:
                        raw = x.tobytes()
                        x = x / top  # lengths neither overflow nor vanish
                        unit = x / np.sqrt(x @ x)
            if unit is None:
                out["class"].append(None)
                out["values"].append(None)
                out["full"].append(None)
            else:
                out["class"].append(hashlib.blake2b(labels[i].as_py().encode("utf-8", "surrogatepass") + b"\0" + raw, digest_size=16).digest())
                out["values"].append(unit.astype("<f4").tobytes())
                out["full"].append(unit.astype("<f8").tobytes())
        return out

    return map_arrow(rows, run, schema)


def first_cells(payload: DataFrame, tables: int = TABLES) -> DataFrame:
    """bucket and key for each table, cell and probed cell; vectors of unequal label or length never meet."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for frame in by_length(whole):
                x = np.frombuffer(b"".join(frame["values"]), "<f4").reshape(len(frame), -1).astype(np.float64)
                label = np.array([int.from_bytes(hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for v in frame["label"]], np.uint64)
                name = mixed(label ^ np.uint64(x.shape[1]))
                for t in range(tables):
                    bucket = mixed(cells(x, t) ^ mixed(name + np.uint64(t))[:, None]).view(np.int64)
                    yield pd.DataFrame({"bucket": bucket.ravel(), "key": np.repeat(frame["key"].to_numpy(), bucket.shape[1])})

    return payload.select("key", "label", "values").mapInPandas(run, "bucket bigint, key bigint").distinct()


def split_cells(buckets: np.ndarray, values: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """A crowded cell's members go on to cells of two further projections each."""
    x = values.astype(np.float64)
    out = [mixed(cells(x, TABLES + 2 * level + k) ^ mixed(buckets.view(np.uint64))[:, None]) for k in range(2)]
    child = np.concatenate(out, 1).view(np.int64)
    return np.repeat(np.arange(len(x)), child.shape[1]), child.ravel()


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def close(full: list[bytes]) -> np.ndarray:
    """Which pairs of unit vectors have a cosine of COSINE or more; those of unequal length have not."""
    out = np.zeros((len(full), len(full)), bool)
    length = np.array([len(b) for b in full])
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        x = np.frombuffer(b"".join([full[i] for i in at]), "<f8").reshape(len(at), -1)
        out[np.ix_(at, at)] = x @ x.T >= COSINE
    return out


def angle_bins(grouped: DataFrame) -> DataFrame:
    """Adds ``bin`` to members (component, key, full, size): the angle to the component's first member, in units of the widest link.

    Angles obey the triangle inequality, so linked members differ by one bin at
    most. Components that fit one block need no angles and have one bin.
    """
    large = blocks_of(grouped, ["component"]).where("blocks > 1").select("component")
    pivots = grouped.join(large, "component").groupBy("component").agg(F.min(F.struct("key", "full"))["full"].alias("pivot"))
    pivots = written(pivots, "pivots")
    reach = float(np.arccos(COSINE)) + 1e-6
    schema = grouped.select("*").schema.add("bin", "long")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bins = []
            for full, pivot in zip(frame["full"], frame["pivot"]):
                alike = len(full) == len(pivot)
                bins.append(int(np.arccos(np.clip(np.frombuffer(full, "<f8") @ np.frombuffer(pivot, "<f8"), -1, 1)) / reach) if alike else 0)
            yield frame.drop(columns="pivot").assign(bin=np.array(bins, np.int64))

    binned = grouped.join(pivots, "component").select(*grouped.columns, "pivot").mapInPandas(run, schema)
    return grouped.join(pivots, "component", "left_anti").withColumn("bin", F.lit(0).cast("bigint")).union(binned)


def near_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, n_links, component_id and kept of every row.

    Two vectors are linked if their labels and lengths are equal and their cosine is
    at least 0.93. n_links: other vectors linked directly. component_id: the least id
    reached by links, the own one included. kept: id = component_id. Rows that can't
    be linked (see ``usable``) have no links and are kept. Each row counts as a vector
    of its own: rows that repeat are linked with one another, rows of one id but of
    different vectors each have their own links. Ties go to the least id. An empty
    table gives no rows; extra columns, whatever their names, are not read. Every
    link given is exact; a pair at the threshold is missed by all tables with a
    chance of about 1 in 10,000.
    """
    rows = written(usable(df, id_col, vector_col, label_col), "vectors")
    able = rows.where("class IS NOT NULL")
    one = able.groupBy("class").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.min("label").alias("label"), F.min("values").alias("values"), F.min("full").alias("full"))
    classes = written(one.withColumn("key", F.monotonically_increasing_id()), "classes")
    cells_of = written(first_cells(classes), "cells")
    edges = bucket_links(cells_of, classes.select("key", "values"), "<f4", cosine, TIED, CORE, split_cells, LEVELS, COSINE - 1e-5)
    groups = connected_components(edges).withColumnRenamed("node", "key")
    keyed = groups.join(classes.select("key", "weight", "full"), "key").select("component", "key", "weight", "full", F.expr("octet_length(full) div 8").alias("size"))
    compared = written(compare_groups(angle_bins(written(keyed, "groups")), close), "compared")
    linked = compared.groupBy(F.col("node").alias("key")).agg(F.sum("links").alias("links"))
    exact = written(connected_components(compared.select(F.col("node").alias("a"), F.col("low").alias("b"))).withColumnRenamed("node", "key"), "exact")
    facts = classes.select("key", "class", "least", "weight")
    tops = exact.join(facts, "key").groupBy("component").agg(F.min("least").alias("first"))
    verdict = facts.join(linked, "key", "left").join(exact.join(tops, "component").select("key", "first"), "key", "left")
    verdict = verdict.select("class", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
    found = able.select("id", "class").join(verdict, "class").select("id", "n_links", "component_id")
    alone = rows.where("class IS NULL").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    discard(cells_of, edges)
    return found.union(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
