"""What an executor holds for the pipeline: bounded batches, and one set of Python workers."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wellframe.llm import common, packing

KEY, MOST = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@pytest.fixture
def unset(spark):
    spark.conf.unset(KEY)
    yield spark
    spark.conf.unset(KEY)


def test_packing_starts_no_python_workers_for_its_plan(spark):
    pieces = spark.range(20).select("id", *[F.lit(v).cast("long").alias(c) for c, v in (("start", 0), ("length", 100), ("ids_crc32", 1), ("doc_tokens", 100))])
    packed = packing.pack_pieces(pieces)
    assert sorted(r["id"] for r in packed.collect()) == list(range(20))
    assert "RDD" not in packed._jdf.queryExecution().optimizedPlan().toString()


def test_stages_hand_rows_to_python_in_small_batches(unset, tmp_path):
    spark, text = unset, "Words of a long text. " * 10_000
    rows = [(i, text, "en", "s", len(text)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(KEY)
        stage(spark, docs, str(tmp_path))
        batches = common.map_arrow(docs.select("text").coalesce(1), lambda batch: {"n": [batch.num_rows], "size": [batch.nbytes]}, "n long, size long").collect()
        assert sum(r["n"] for r in batches) == len(rows), name
        assert max(r["size"] for r in batches) <= MOST + 2 * len(text), name


@pytest.mark.parametrize("own, held", [("67108864b", MOST), ("64m", MOST), ("1m", 1 << 20), ("2048kb", 2 << 20)])
def test_smaller_batches_of_the_session_stay(unset, own, held):
    unset.conf.set(KEY, own)
    corpus_pipeline.in_small_batches(unset)
    now = unset.conf.get(KEY)
    assert now == (f"{MOST}b" if held == MOST else own)


def test_local_table(spark):
    rows = [("a", 1), (None, 2)]
    table = common.local_table(spark, rows, "name string, n bigint")
    assert table.dtypes == [("name", "string"), ("n", "bigint")]
    assert sorted(map(tuple, table.collect()), key=lambda r: r[1]) == rows
    assert common.local_table(spark, [], "name string").collect() == []
