"""Lists of neighbours from any run in one long table, compared with those of a baseline."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellframe.functions.text import normal_id
from wellframe.sources.tables import neighbours_from_wide

#: Names of columns in tables of neighbours, the first that is there (fixed values).
QUERY_NAMES = ("query_id", "QueryID", "cpd_id", "Query", "source", "compound")
NEIGHBOUR_NAMES = ("neighbour_id", "NeighbourID", "neighbor_id", "Neighbour", "Neighbor", "target")
RANK_NAMES = ("rank", "Rank", "neighbour_rank", "nn_rank", "k")
DISTANCE_NAMES = ("distance", "Distance", "cosine_distance", "euclidean_distance")


def first_column(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def long_neighbours(df: DataFrame, prefix: str = "NN") -> DataFrame:
    """query_id, neighbour_id (text), place (from 1), distance (NULL where there is none) of a long or wide table.

    Wide: columns NN1, NN2, ... beside the query's, the first other column. Long: names
    as above; places follow the rank, else the distance. A query is no neighbour of its
    own. Rows without query or neighbour are left out; a neighbour that repeats has its first place.
    """
    wide = [c for c in df.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    if wide:
        others = [c for c in df.columns if c not in wide]
        if not others:
            raise ValueError("a wide table of neighbours needs a column of queries")
        long = neighbours_from_wide(df, others[0], prefix).withColumn("distance", F.lit(None).cast("double"))
    else:
        query, neighbour, rank, distance = (first_column(df, n) for n in (QUERY_NAMES, NEIGHBOUR_NAMES, RANK_NAMES, DISTANCE_NAMES))
        if query is None or neighbour is None or (rank is None and distance is None):
            raise ValueError(f"a table of neighbours needs columns of query, neighbour, and rank or distance; it has {df.columns}")
        far = F.col(distance).try_cast("double") if distance else F.lit(None).cast("double")
        long = df.select(F.col(query).alias("query_id"), F.col(neighbour).alias("neighbour_id"), (F.col(rank).cast("double") if rank else far).alias("rank"), F.nanvl(far, F.lit(None).cast("double")).alias("distance"))
    text = long.select(F.col("query_id").cast("string").alias("query_id"), F.col("neighbour_id").cast("string").alias("neighbour_id"), "rank", "distance").where("query_id <> neighbour_id")
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("rank"), F.asc_nulls_last("distance"), "neighbour_id")
    placed = text.withColumn("place", F.row_number().over(order))
    return placed.groupBy("query_id", "neighbour_id").agg(F.min("place").alias("place"), F.min_by("distance", "place").alias("distance"))


def with_ties(lists: DataFrame, by: Sequence[str], depth: int, ties: bool) -> DataFrame:
    """The rows of each list's first ``depth`` places and, with ``ties``, all others at most as far as the last of these.

    A list without distances has no ties; where only the last one's is unknown, its set is empty.
    """
    whole = Window.partitionBy(*by)
    if not ties:
        return lists.where(F.col("place") <= depth)
    limit = F.max_by("distance", F.when(F.col("place") <= depth, F.col("place"))).over(whole)
    held = lists.withColumn("__limit", limit).withColumn("__known", F.count("distance").over(whole) > 0)
    kept = F.when(F.col("__known"), F.coalesce(F.col("distance") <= F.col("__limit"), F.lit(False))).otherwise(F.col("place") <= depth)
    return held.where(kept & F.lit(depth > 0)).drop("__limit", "__known")


def median_length(lists: DataFrame) -> int:
    n = lists.groupBy("query_id").agg(F.max("place").alias("n")).agg(F.percentile("n", F.lit(0.5))).first()[0]
    return int(n or 0)


def overlap(runs: dict[str, DataFrame], baseline: str, k: int | str = "auto", ties: bool = False, p: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(by query: query_id, run, k, jaccard, rbo, baseline_size, run_size; by run: its summary).

    ``runs`` are tables for ``long_neighbours``; queries that both the run and the
    baseline have are compared. Jaccard is of the sets of ``with_ties``; k auto is the
    lesser of the two median lengths. Rank-biased overlap comes from the neighbours in
    common alone: one that both lists have seen at depth m counts p^(d-1) / d at every
    depth d from m on. Lists are never gathered; each run is one join with the baseline.
    """
    if baseline not in runs or len(runs) < 2:
        raise ValueError("overlap needs the baseline and at least one other run")
    base = long_neighbours(runs[baseline])
    base_k = median_length(base) if k == "auto" else None
    found = None
    for name in sorted(set(runs) - {baseline}):
        run = long_neighbours(runs[name])
        depth = min(base_k, median_length(run)) if k == "auto" else int(k)
        shared = base.select("query_id").distinct().join(run.select("query_id").distinct(), "query_id")
        a, b = base.join(shared, "query_id", "left_semi"), run.join(shared, "query_id", "left_semi")
        lengths = a.groupBy("query_id").agg(F.max("place").alias("la")).join(b.groupBy("query_id").agg(F.max("place").alias("lb")), "query_id")
        sets = [with_ties(t, ["query_id"], depth, ties) for t in (a, b)]
        sizes = [s.groupBy("query_id").agg(F.count(F.lit(1)).alias(f"{n}_size")) for s, n in zip(sets, ("baseline", "run"))]
        common = sets[0].select("query_id", "neighbour_id").join(sets[1].select("query_id", "neighbour_id"), ["query_id", "neighbour_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("common"))
        upto = F.array(*[F.lit(float(x)) for x in np.concatenate([[0.0], np.cumsum(p ** np.arange(depth) / np.arange(1, depth + 1))])])
        met = a.select("query_id", "neighbour_id", F.col("place").alias("pa")).join(b.select("query_id", "neighbour_id", F.col("place").alias("pb")), ["query_id", "neighbour_id"]).join(lengths, "query_id")
        end, seen = F.least(F.lit(depth), "la", "lb"), F.greatest("pa", "pb")
        rbo = met.where(seen <= end).groupBy("query_id").agg(((1 - p) * F.sum(F.get(upto, end) - F.get(upto, seen - 1))).alias("rbo"))
        joined = shared.join(sizes[0], "query_id", "left").join(sizes[1], "query_id", "left").join(common, "query_id", "left").join(rbo, "query_id", "left").na.fill(0).na.fill(0.0)
        union = F.col("baseline_size") + F.col("run_size") - F.col("common")
        one = joined.select("query_id", F.lit(name).alias("run"), F.lit(depth).alias("k"), F.when(union > 0, F.col("common") / union).otherwise(0.0).alias("jaccard"), "rbo", "baseline_size", "run_size")
        found = one if found is None else found.union(one)
    at = lambda c, q: F.percentile(c, F.lit(q))
    summary = found.groupBy("run", "k").agg(
        F.count(F.lit(1)).alias("n_queries"), F.avg("jaccard").alias("mean_jaccard"), at("jaccard", 0.5).alias("median_jaccard"), at("jaccard", 0.25).alias("q25_jaccard"),
        at("jaccard", 0.75).alias("q75_jaccard"), F.avg("rbo").alias("mean_rbo"), at("rbo", 0.5).alias("median_rbo"),
    )
    return found, summary


def neighbours_of(df: DataFrame, queries: Sequence[str], most: int = 5) -> DataFrame:
    """query_id, neighbour_id, place and distance of the nearest ``most`` different neighbours of each query asked for (compared without regard to case and blanks)."""
    long = long_neighbours(df).withColumn("__q", normal_id(F.col("query_id"))).withColumn("__n", normal_id(F.col("neighbour_id")))
    wanted = df.sparkSession.createDataFrame([(str(q),) for q in queries], "asked string").select(normal_id(F.col("asked")).alias("__q")).distinct()
    mine = long.join(F.broadcast(wanted), "__q").where("__q <> __n")  # the list that the caller gives
    once = mine.groupBy("__q", "__n").agg(F.min(F.struct("place", "query_id", "neighbour_id", "distance")).alias("s")).select("__q", "s.*")
    order = Window.partitionBy("__q").orderBy(F.asc_nulls_last("distance"), "place", "neighbour_id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "neighbour_id", "place", "distance")
