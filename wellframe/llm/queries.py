"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classify, hnsw, jaccard, lattice, licences, oracle, packing, resample, rules, sharding, tokenfile, whiten
from .common import pick, scratch_path

SHARDS = [f"shard-{i:03d}" for i in range(64)]
SLOTS = 65_537


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), "doc_id", SHARDS, SLOTS)
    return placed.select(F.col("key").alias("doc_id"), "slot", "shard", "shard_name")


def labelled_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, label and mark (hash of the text) of the documents that quality may be learned from.

    Ids that ``labels`` marks both 0 and 1 are left out; null ids have no label.
    """
    known = pick(labels, doc_id="doc_id", quality="quality").where(F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("label"), F.min("quality").alias("least")).where("label = least")
    free = pick(docs, doc_id="doc_id", text="text").where(classify.fold_of(F.col("doc_id"), 3) != 1).where("text IS NOT NULL")
    return free.withColumn("mark", F.xxhash64("text")).join(known, "doc_id").select("text", "label", "mark")


def labelled_language(docs: DataFrame) -> DataFrame:
    """text and label (lang) of the documents that language may be learned from."""
    return pick(docs, doc_id="doc_id", text="text", label="lang").where(classify.fold_of(F.col("doc_id"), 4) != 2).select("text", "label")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify.identify_language(docs, classify.language_model(labelled_language(docs)), "text", doc_id="doc_id")
    return found.select("doc_id", (classify.fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_copies(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "n_links", "component_id", "kept")


def op4_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").withColumnRenamed("id", "vec_id")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.withColumnRenamed("id", "doc_id").withColumn("score", F.round("score", 6))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.apply_rules(table(spark, sf_dir, "documents"), "doc_id", "text", "source").withColumnRenamed("id", "doc_id")
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c.startswith("rate_")})


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classify.quality_model(labelled_quality(docs, table(spark, sf_dir, "labels")))
    scored = classify.score_quality(docs, model, "text", doc_id="doc_id")
    return scored.select("doc_id", (classify.fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer, end_id=2).withColumnRenamed("id", "doc_id")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), "doc_id", "text", ranks, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(vocabulary("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    path = scratch_path(spark, "token-files")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer, path, end_id=0)
    return tokenfile.read_token_files(spark, path, with_ids=False).withColumnRenamed("id", "doc_id")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "text")
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return white.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hnsw.nearest_neighbours(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 5).withColumnRenamed("id", "vec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_language_id": op2_language_id,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_lattice_dedup": op4_lattice_dedup,
        "op5_licence_scan": op5_licence_scan,
        "op6_quality_rules": op6_quality_rules,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_packing": op8_packing,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_token_files": op10_token_files,
        "op11_resampling": op11_resampling,
        "op12_whitening": op12_whitening,
        "op13_nearest": op13_nearest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": oracle.sharding_sql(SHARDS, SLOTS),
        "op3_jaccard_join": oracle.jaccard_sql(),
        "op4_lattice_dedup": oracle.lattice_sql(),
        "op5_licence_scan": oracle.licences_sql(),
        "op6_quality_rules": oracle.rules_sql(),
        "op11_resampling": oracle.resampling_sql(),
    }
