"""Connected components of a graph of long ids by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

MOST_ROUNDS = 60


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) with the same components, for edges of which no ``a`` has more than a bounded number.

    A node's edges become one to the least of its ends, and each other end is tied
    to that: most nodes share their ends, so these further edges are few.
    """
    proper = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    ends = written(proper.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("ends")), "ends")
    kinds = ends.where(F.size("ends") > 1).select("ends").distinct()
    ties = kinds.select(F.explode(F.expr("slice(ends, 2, size(ends) - 1)")).alias("a"), F.col("ends")[0].alias("b"))
    out = written(ends.select("a", F.col("ends")[0].alias("b")).union(ties.distinct()), "edges")
    discard(ends)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for each end of an edge (columns a, b).

    Each round, a node's label becomes the least among its own, its label's label
    and those of its neighbours' labels, and its label learns of that too; the
    number of rounds follows the logarithm of a component's diameter. Rounds are
    written to the shared folder. Only joins (which AQE splits where a node is hot)
    and minima (which are partly taken before the shuffle) are used. Null ends and
    loops are left out; repeated edges do no harm; without edges there are no rows.
    """
    proper = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = written(proper.union(proper.select("b", "a")).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("f"), F.lit(None).cast("bigint").alias("old"))
    labels = written(labels, "labels")
    for _ in range(MOST_ROUNDS):
        up = labels.select(F.col("node").alias("f"), F.col("f").alias("g"))
        lifted = labels.select("node", "f").join(up, "f")
        near = both.join(lifted.select(F.col("node").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m"))
        told = lifted.join(near.withColumnRenamed("a", "node"), "node").select("node", "f", F.least("f", "g", "m").alias("new"))
        hooks = told.select(F.explode(F.array(F.struct("node", "new", F.col("f").alias("old")), F.struct(F.col("f").alias("node"), "new", F.lit(None).cast("bigint").alias("old")))).alias("x")).select("x.*")
        before, labels = labels, written(hooks.groupBy("node").agg(F.min("new").alias("f"), F.max("old").alias("old")), "labels")
        discard(before)
        if labels.where("f <> old").isEmpty():
            discard(both)
            return labels.select("node", F.col("f").alias("component"))
    raise RuntimeError(f"labels still change after {MOST_ROUNDS} rounds")
