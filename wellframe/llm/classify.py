"""Quality scores and languages of whole texts by the subword models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import local_table, map_arrow, pick, text_blocks
from .subwords import Features, Model, train

QUALITY_FEATURES = Features(bits=16, longest=4)
LANGUAGE_FEATURES = Features(bits=16, longest=3, fold=True)


def training_sample(labelled: DataFrame, most: int, least: int = 100) -> tuple[list[str], list]:
    """About ``most`` (text, label) rows, chosen by a hash of the text; a row that repeats counts once.

    ``labelled`` has columns text, label and mark (a hash of the text), and only rows
    that may be learned from; where it is a join, texts are counted by their marks, so
    only the sampled ones meet their labels. Rates follow the number of different texts, so repeats don't thin the sample, and a
    label gets ``least`` texts or all that it has, whatever its share. These bounds are
    the only limit on what is learned from; prediction covers all rows. On the driver:
    a number for each label, and the sample.
    """
    if "mark" not in labelled.columns:
        labelled = labelled.withColumn("mark", F.xxhash64("text"))
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.approx_count_distinct("mark", 0.02).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return [], []
    rates = {v: max(most / total, least / n) for v, n in counts.items()}
    if min(rates.values()) < 1:
        place = F.pmod("mark", F.lit(1 << 30))
        cut = lambda rate: int((1 << 30) * min(1.0, rate))
        labelled = labelled.where(place < cut(max(rates.values())))  # by the text alone, so that the filter reaches the scan
        table = local_table(labelled.sparkSession, [(v, cut(rate)) for v, rate in rates.items()], labelled.select("label").schema.add("cut", "long"))
        # a row a label, as the model has a column for each: no label's rows meet in one task
        labelled = labelled.join(F.broadcast(table), "label").where(place < F.col("cut"))
    once = labelled.groupBy("mark", "label").agg(F.first("text").alias("text"))
    rows = sorted((r["text"] or "", r["label"]) for r in once.orderBy("mark", "label").limit(2 * (most + least * len(counts))).collect())
    return [t for t, _ in rows], [v for _, v in rows]


def quality_model(labelled: DataFrame, most: int = 3000) -> Model:
    """Learns label 0 or 1 from ``labelled`` (text, label); ``most`` bounds the sample."""
    texts, labels = training_sample(labelled.where(F.col("label").isin(0, 1) & F.col("text").isNotNull()), most)
    if not texts:
        return Model(QUALITY_FEATURES, [0, 1], np.zeros((1 << QUALITY_FEATURES.bits, 2), np.float32), np.zeros(2))
    model = train(texts, labels, QUALITY_FEATURES, epochs=4)
    if len(model.classes) == 1:  # one label only: a constant that leans to it
        sure = np.array([1.0, -1.0]) if model.classes == [0] else np.array([-1.0, 1.0])
        model = Model(QUALITY_FEATURES, [0, 1], np.zeros((1 << QUALITY_FEATURES.bits, 2), np.float32), sure)
    return model


def score_quality(df: DataFrame, model: Model, text_col: str, **carried: str) -> DataFrame:
    """The columns ``carried``, score and predicted of every row.

    score: calibrated probability of label 1, from the whole text alone; null and
    empty texts get that of a text without features. predicted: 1 from 0.5 on, so a tie
    is 1. Texts are read whole, whatever their length. Rows that repeat get the same
    result each, an empty table gives no rows, and only the named columns are read, so
    others do no harm whatever their names.
    """
    rows = pick(df, **carried, text=text_col)
    schema = rows.drop("text").schema.add("score", "double").add("predicted", "integer")

    def run(batch: pa.RecordBatch) -> dict:
        scores = [s for _, block in text_blocks(batch.column(batch.num_columns - 1)) for s in model.probabilities(block)[:, 1].tolist()]
        own = {name: batch.column(i) for i, name in enumerate(schema.names[:-2])}
        return own | {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return map_arrow(rows, run, schema)


def language_model(labelled: DataFrame, most: int = 3000) -> Model:
    """Learns the label (a language) from ``labelled`` (text, label); null labels are left out."""
    texts, labels = training_sample(labelled.where(F.col("label").isNotNull() & F.col("text").isNotNull()), most)
    if not texts:
        return Model(LANGUAGE_FEATURES, ["und"], np.zeros((1 << LANGUAGE_FEATURES.bits, 1), np.float32), np.zeros(1))
    return train(texts, labels, LANGUAGE_FEATURES, epochs=4)


def identify_language(df: DataFrame, model: Model, text_col: str, **carried: str) -> DataFrame:
    """The columns ``carried``, lang_pred, score and rejected of every row.

    lang_pred: the likeliest language of the whole text, ``und`` for a text that is
    null or has no letter; of languages that are equally likely the first in order of
    name. score: its calibrated probability, 0 for ``und``. rejected: ``und``, or a
    score under the model's calibrated limit. Texts are read whole, whatever their
    length. Rows that repeat get the same result each, an empty table gives no rows,
    and only the named columns are read, so others do no harm whatever their names.
    """
    rows = pick(df, **carried, text=text_col)
    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    names, limit = [str(c) for c in model.classes], model.reject_below

    def run(batch: pa.RecordBatch) -> dict:
        langs, scores = [], []
        for _, block in text_blocks(batch.column(batch.num_columns - 1)):
            chances = model.probabilities(block)
            for text, best, score in zip(block, chances.argmax(1), chances.max(1).tolist()):
                lettered = any(map(str.isalpha, text))
                langs.append(names[best] if lettered else "und")
                scores.append(min(score, 1.0) if lettered else 0.0)
        own = {name: batch.column(i) for i, name in enumerate(schema.names[:-3])}
        return own | {"lang_pred": langs, "score": scores, "rejected": [g == "und" or s < limit for g, s in zip(langs, scores)]}

    return map_arrow(rows, run, schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    from .common import crc_of_id

    return F.pmod(crc_of_id(doc_id), F.lit(folds))
