"""From raw documents to packed sequences, in four stages."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wellframe.llm import classify, jaccard, packing
from wellframe.llm import queries as q
from wellframe.llm.common import pick, scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What goes past a model beside the text that it reads, and comes back as the documents' columns.
CARRIED = {("whole" if c == "text" else c): c for c in COLUMNS}
#: Bytes of rows that go to a Python worker at once; Spark's own default is 64 MB.
BATCH_BYTES = 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    """Lets the session hand rows to Python by BATCH_BYTES at most (or one longer row), or by less where it does so already.

    A worker and its executor each hold a batch, and the result with the texts that it
    carries; stages are lazy, so the setting stays. It changes no result.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier predicts to be of label 0.

    Null and empty texts have the score of a text without features. Rows that repeat,
    or share an id, are judged each by its text; a score of just 0.5 stays. An empty
    table gives none. Of columns whose names clash the one of the exact name counts,
    and only the columns of documents are returned. Texts of any length are read whole.
    """
    in_small_batches(spark)
    model = classify.quality_model(q.labelled_quality(docs, q.table(spark, sf_dir, "labels")))
    scored = classify.score_quality(docs, model, "text", **CARRIED)
    return scored.where("predicted = 1").select(*[F.col(name).alias(c) for name, c in CARRIED.items()])


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose language the model rejects.

    Texts that are null or have no letter go. Rows that repeat are judged each by its
    text; a score of just the limit stays. Empty tables, clashing columns and long
    texts as in ``drop_low_quality``.
    """
    in_small_batches(spark)
    model = classify.language_model(q.labelled_language(docs))
    found = classify.identify_language(docs, model, "text", **CARRIED)
    return found.where("NOT rejected").select(*[F.col(name).alias(c) for name, c in CARRIED.items()])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id.

    Null ids, null and blank texts are copies of nothing and stay. Of rows that repeat
    one stays; rows that share an id are judged each by its text. Empty tables,
    clashing columns and long texts as in ``drop_low_quality``.
    """
    in_small_batches(spark)
    return jaccard.without_near_copies(pick(docs, **{c: c for c in COLUMNS}), "doc_id", "text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences of at most 4096 tokens.

    A null or empty text is its end id alone; rows that repeat are packed as often as
    they stand there. Empty tables, clashing columns and long texts as before.
    """
    in_small_batches(spark)
    with open(q.vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return packing.pack(docs, "doc_id", "text", tokenizer, end_id=2).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("language ID", drop_unknown_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("packing", pack_sequences),
]

#: Trained models and token ids have no SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
