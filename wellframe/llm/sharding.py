"""Sharding by a permutation-filled lookup table of prime size.

Every shard has its own order of preference over the slots of the table (a start
and a step, both from a hash of its name). Shards take turns, each claiming its
most preferred free slot, until all slots are taken; so shards get equal shares,
within one slot, and adding or removing one moves few slots. Rows find their shard
by ``hash(key) mod size`` in the broadcast table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

#: The most slots; it bounds what is broadcast.
MOST_SLOTS = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int) -> list[int]:
    """The index of the shard that holds each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards need distinct names, one at least")
    if not is_prime(size) or not len(shards) <= size <= MOST_SLOTS:
        raise ValueError(f"size must be a prime from the number of shards to {MOST_SLOTS}")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    step = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 if size > 2 else 1 for d in digests]
    table, free = [-1] * size, size
    while free:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % size
            table[at[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, size: int) -> Column:
    """A slot from the first 60 bits of the key's md5, as text; a null key counts as empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    """slot, shard, shard_name of every slot."""
    filled = F.split(F.lit(",".join(map(str, fill_table(shards, size)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    slots = spark.range(1).select(F.posexplode(filled).alias("slot", "shard"))
    slots = slots.select("slot", F.col("shard").cast("int").alias("shard"))
    return slots.withColumn("shard_name", F.element_at(names, F.col("shard") + 1))


def assign_shards(df: DataFrame, key_col: str, shards: list[str], size: int = 65_537) -> DataFrame:
    """key, slot, shard and shard_name of every row of ``df``; no shuffle, no Python on the executors.

    Rows with equal keys share a shard; null keys do too. An empty table gives an
    empty result. A key that holds a large part of all rows fills its shard
    accordingly: give a finer key (the document, not its source) where shards
    must be even.
    """
    rows = pick(df, key=key_col).withColumn("slot", slot_of(F.col("key"), size))
    return rows.join(F.broadcast(table_frame(df.sparkSession, shards, size)), "slot").select("key", "slot", "shard", "shard_name")


def shard_report(assigned: DataFrame) -> DataFrame:
    """Rows of each shard and their share of an even split."""
    n = assigned.groupBy("shard", "shard_name").agg(F.count(F.lit(1)).alias("n_rows"))
    total = n.agg(F.sum("n_rows").alias("__rows"), F.count(F.lit(1)).alias("__shards"))
    return n.crossJoin(F.broadcast(total)).select("shard", "shard_name", "n_rows", (F.col("n_rows") * F.col("__shards") / F.col("__rows")).alias("of_even"))


def write_shards(df: DataFrame, key_col: str, shards: list[str], path: str, size: int = 65_537, parts: int = 1) -> None:
    """Writes whole rows under one folder a shard; ``parts`` files a shard, dealt by a hash of the row."""
    if "__slot" in df.columns or "__shard" in df.columns:
        raise ValueError("columns __slot and __shard are used here")
    place = table_frame(df.sparkSession, shards, size).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    placed = df.withColumn("__slot", slot_of(F.col(key_col), size)).join(F.broadcast(place), "__slot").drop("__slot")
    deal = F.pmod(F.xxhash64(*[c for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(parts))
    placed.repartition(len(shards) * parts, "__shard", deal).write.partitionBy("__shard").parquet(path)
