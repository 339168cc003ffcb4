"""Token ids on disk: documents compressed one by one with a shared dictionary, and an index.

A folder holds three Parquet tables, so any store that Spark writes will do:

dictionary  one row: dict_hash, the zstandard dictionary, bytes an id
blocks      a row for each block of documents in ascending id order: part, block,
            dict_hash, low and high id, payload (the documents' frames one after
            another), start_in_part, and the index: ids, n_tokens, offsets of the frames
parts       ids before the first of each part

A document is read by its block (found by low and high, which Parquet prunes) and
its slice of the payload; nothing else of the block is decompressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick
from .tokens import arrow_blocks, id_width, library_encoder

BLOCK_BYTES = 1 << 20


def serialized(ids: bytes, width: int) -> bytes:
    """Little-endian ids of 32 bits, as ids of ``width`` bytes; an id that needs more is an error."""
    wide = np.frombuffer(ids, "<u4")
    if width < 4 and len(wide) and int(wide.max()) >> (8 * width):
        raise ValueError(f"id {int(wide.max())} doesn't fit {width} bytes")
    return wide.astype(f"<u{width}").tobytes()


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; where there is too little to train on, the samples' end as raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def sampled_texts(rows: DataFrame, most: int) -> list[str]:
    """About ``most`` texts at most, chosen by a hash of the whole row; their number does not grow with the table."""
    total = rows.count()
    kept = rows
    if total > most:
        kept = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int((1 << 30) * most / total))
    return [r[0] or "" for r in kept.select("text").limit(2 * most).collect()]


def write_token_files(
    df: DataFrame, id_col: str, text_col: str, tokenizer: str, path: str, end_id: int = 0, spaced: bool = True, width: int | None = None,
    level: int = 3, dictionary_bytes: int = 112_640, sample: int = 1000,
) -> None:
    """Writes ids of every whole text, in ascending id order (nulls first), to the folder ``path``.

    The dictionary is trained on about ``sample`` whole documents; that bound
    concerns training only. Rows that repeat are written as often as they stand there;
    rows of one id are ordered by a hash of their texts. A null or empty text is its end
    id alone, an empty table gives a folder without blocks, a text of any length is one
    frame, and extra columns, whatever their names, are not read. width: bytes an id,
    by the vocabulary if None.
    """
    spark = df.sparkSession
    rows = pick(df, id=id_col, text=text_col)
    encoder = library_encoder(tokenizer, spaced)
    end = np.array([end_id], "<u4").tobytes()
    texts = sampled_texts(rows, sample)
    width = width or max(id_width(tokenizer), 2 if end_id < 1 << 16 else 4)
    samples = [serialized(ids + end, width) for _, block in arrow_blocks(pa.array(texts, pa.string())) for ids in encoder.encode(block)]
    dictionary = train_dictionary(samples, dictionary_bytes)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary), width)], "dict_hash string, dictionary binary, width int").write.parquet(f"{path}/dictionary")
    id_type = rows.schema["id"].dataType
    blocks = T.StructType(
        [
            T.StructField("block", T.LongType()), T.StructField("dict_hash", T.StringType()),
            T.StructField("low", id_type), T.StructField("high", id_type), T.StructField("payload", T.BinaryType()),
            T.StructField("ids", T.ArrayType(id_type)), T.StructField("n_tokens", T.ArrayType(T.LongType())),
            T.StructField("offsets", T.ArrayType(T.LongType())), T.StructField("start_in_part", T.LongType()), T.StructField("tokens", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(tokenizer, spaced)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=True)
        held: list[tuple] = []
        size = number = before = 0

        def flush() -> pa.RecordBatch:
            offsets = np.cumsum([0, *(len(f) for _, _, f in held)]).tolist()
            known = [i for i, _, _ in held if i is not None]
            row = {
                "block": number, "dict_hash": digest, "low": min(known, default=None), "high": max(known, default=None),
                "payload": b"".join(f for _, _, f in held), "ids": [i for i, _, _ in held], "n_tokens": [n for _, n, _ in held],
                "offsets": offsets, "start_in_part": before, "tokens": sum(n for _, n, _ in held),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, block in arrow_blocks(batch.column(1)):
                for i, ids in enumerate(coder.encode(block), first):
                    frame = packer.compress(serialized(ids + end, width))
                    held.append((keys[i], len(ids) // 4 + 1, frame))
                    size += len(frame)
                    if size >= BLOCK_BYTES:
                        yield flush()
                        before += sum(n for _, n, _ in held)
                        held, size, number = [], 0, number + 1
        if held:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(blocks)
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(run, blocks).withColumn("part", F.spark_partition_id()).write.parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, that is, each task of the write
    totals.select("part", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start")).coalesce(1).write.parquet(f"{path}/parts")


def located(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the number of ids before each; ``parts`` has a row for each task of the write."""
    parts = spark.read.parquet(f"{path}/parts").select("part", "start")
    return spark.read.parquet(f"{path}/blocks").join(F.broadcast(parts), "part").withColumn("start", F.col("start") + F.col("start_in_part"))


def shared_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, int]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row["dict_hash"], bytes(row["dictionary"]), row["width"]


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """id, start, n_tokens, ids_crc32 and (with_ids) ids of each document, from the files alone."""
    digest, dictionary, width = shared_dictionary(spark, path)
    blocks = located(spark, path)
    fields = [T.StructField("id", blocks.schema["ids"].dataType.elementType), *(T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32"))]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for frame in frames:
            for b in frame.itertuples(index=False):
                yield unpacked(b, digest, reader, width, with_ids)

    return blocks.select("dict_hash", "payload", "ids", "n_tokens", "offsets", "start").mapInPandas(run, schema)


def unpacked(b, digest: str, reader: zstandard.ZstdDecompressor, width: int, with_ids: bool) -> pd.DataFrame:
    import zlib

    if b.dict_hash != digest:
        raise ValueError(f"block was written with dictionary {b.dict_hash}, the folder has {digest}")
    crcs, arrays = [], []
    for low, high in zip(b.offsets[:-1], b.offsets[1:]):
        ids = np.frombuffer(reader.decompress(b.payload[low:high]), f"<u{width}").astype("<u4")
        crcs.append(zlib.crc32(ids.tobytes()))
        if with_ids:
            arrays.append(ids.astype(np.int64))
    starts = b.start + np.cumsum([0, *b.n_tokens[:-1]])
    out = pd.DataFrame({"id": list(b.ids), "start": starts, "n_tokens": list(b.n_tokens), "ids_crc32": crcs})
    return out.assign(ids=arrays) if with_ids else out


def read_document(spark: SparkSession, path: str, doc_id) -> list[np.ndarray]:
    """Ids of the document (documents, where the id repeats): its frame only is decompressed."""
    digest, dictionary, width = shared_dictionary(spark, path)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    blocks = spark.read.parquet(f"{path}/blocks").where((F.col("low") <= F.lit(doc_id)) & (F.col("high") >= F.lit(doc_id)))
    at = F.posexplode("ids").alias("at", "id")
    slices = blocks.select("dict_hash", "payload", "offsets", at).where(F.col("id") == F.lit(doc_id)).select(
        "dict_hash", F.expr("substring(payload, cast(offsets[at] as int) + 1, cast(offsets[at + 1] - offsets[at] as int))").alias("frame"))
    out = []
    for r in slices.collect():
        if r["dict_hash"] != digest:
            raise ValueError("the dictionary is another one")
        out.append(np.frombuffer(reader.decompress(bytes(r["frame"])), f"<u{width}").astype(np.int64))
    return out
