"""Tables that cut lineage, places in an order, and connected components by repeated joins."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
MOST_ROUNDS = 60


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only in local mode, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again, so that lost executors cost a task and not the job."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_by(rows: DataFrame, by, name: str) -> DataFrame:
    """Adds ``name``, the place from 0 in the order of ``by``: ranges are sorted each in a task and moved by the sizes of those before."""
    spark = rows.sparkSession
    ordered = stored(rows.withColumn("__by", by).repartitionByRange("__by").sortWithinPartitions("__by").withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33)
    counts = sorted(map(tuple, ordered.groupBy(part.alias("p")).count().collect()))  # a row for each partition
    starts = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(counts, np.cumsum([0, *[c for _, c in counts]]))] or [(0, 0)], "__p bigint, __start bigint")
    placed = ordered.join(F.broadcast(starts), part == F.col("__p"))
    return placed.withColumn(name, F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start")).drop("__by", "__at", "__p", "__start")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for each end of an edge (long columns a and b).

    A round takes the least among a node's label, its label's label and those of its
    neighbours' labels, and tells it to the label too, so that the number of rounds
    follows the logarithm of a component's diameter. NULL ends and loops are left out.
    """
    kept = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = stored(kept.union(kept.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(None).cast("bigint").alias("old")), "labels")
    for _ in range(MOST_ROUNDS):
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        raised = labels.select("node", "label").join(up, "label")
        told = both.join(raised.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("m"))
        new = raised.join(told, "node").select("node", "label", F.least("label", "top", "m").alias("new"))
        nothing = F.lit(None).cast("bigint")
        heard = new.select(F.explode(F.array(F.struct("node", "new", F.col("label").alias("old")), F.struct(F.col("label").alias("node"), "new", nothing.alias("old")))).alias("x")).select("x.*")
        labels = stored(heard.groupBy("node").agg(F.min("new").alias("label"), F.max("old").alias("old")), "labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"labels still change after {MOST_ROUNDS} rounds")
