"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_ROOTS: dict[str, str] = {}


def place_of(df: DataFrame, column: str) -> int:
    """Where a column stands: found by exact name first, then without regard to case; the first where names repeat."""
    exact = [i for i, c in enumerate(df.columns) if c == column]
    loose = [i for i, c in enumerate(df.columns) if c.lower() == column.lower()]
    if not (exact or loose):
        raise ValueError(f"no column {column!r} among {df.columns}")
    return (exact or loose)[0]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns called _0, _1 and so on, so that names that repeat or differ only in case do no harm."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed: ``pick(df, id="doc_id")`` has one column ``id``; see ``place_of``."""
    return numbered(df).select(*[F.col(f"_{place_of(df, old)}").alias(new) for new, old in columns.items()])


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; one of our own only in local mode, where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written``; nothing that still reads them may run afterwards."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def local_table(spark: SparkSession, rows: list[tuple], schema: T.StructType | str) -> DataFrame:
    """A small table of the driver's rows, handed over by Arrow.

    A list given to ``createDataFrame`` is an RDD, for which each executor starts a
    second set of Python workers beside those of the Arrow functions.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    target = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [()] * len(target)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target), schema)


def crc_of_id(column: Column) -> Column:
    """crc32 of an id as text; the folds of the learned operators come from it."""
    return F.crc32(column.cast("string").cast("binary"))


def text_blocks(texts: Iterable[str | None] | pa.Array, most: int = 100_000) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) blocks of about ``most`` characters; null is the empty text.

    An Arrow column becomes Python strings block by block, not at once.

    Numpy work on a block takes some 200 bytes a character, so the default keeps a
    worker's share small; only a longer single text takes more.
    """
    start, block, size = 0, [], 0
    if isinstance(texts, pa.Array):
        texts = (t.as_py() for t in texts)
    for i, text in enumerate(texts):
        block.append(text or "")
        size += len(block[-1])
        if size >= most:
            yield start, block
            start, block, size = i + 1, [], 0
    if block:
        yield start, block


def map_arrow(df: DataFrame, function, schema: T.StructType | str) -> DataFrame:
    """mapInArrow with ``function(batch) -> dict of columns``, one call a batch."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = function(batch)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for f in target for c in [columns[f.name]]],
                    schema=target,
                )

    return df.mapInArrow(run, schema)
