"""Probabilities of classifiers set right by isotonic curves of out-of-fold scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import stored
from .models import fit, known_folds, with_features

#: Scores are told apart to this many steps between 0 and 1, which bounds a curve whatever the number of rows.
STEPS = 1000


def class_scores(index, model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """rows with ``scores``, a number from 0 to 1 a class in sorted order; margins go through the logistic function."""
    out = model.transform(with_features(rows, features))
    if "probability" in out.columns:
        return out.select(*rows.columns, vector_to_array("probability").alias("scores"))
    # a model of two classes by one against the rest has a margin for each class too
    return out.select(*rows.columns, F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-x))).alias("scores"))


def pooled(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shares of hits that never fall, nearest by weighted squares: neighbours that fall are pooled until none do."""
    runs: list[list[float]] = []
    for h, m in zip(hits, n):
        runs.append([h, m, 1])
        while len(runs) > 1 and runs[-2][0] * runs[-1][1] >= runs[-1][0] * runs[-2][1]:
            last = runs.pop()
            runs[-1] = [a + b for a, b in zip(runs[-1], last)]
    return np.repeat([h / m for h, m, _ in runs], [int(k) for _, _, k in runs])


def curves(scored: DataFrame, label: str, labels: Sequence[str]) -> DataFrame:
    """class (its place among ``labels``), score and probability: the isotonic curve of each class, of at most STEPS + 1 points.

    A hit is counted at the lowest score and a miss at the highest beside the rows, so
    that a class never gets 0 or 1 by few rows.
    """
    names = scored.sparkSession.createDataFrame(list(enumerate(labels)), "class int, name string")  # a row a class
    long = scored.select(F.col(label).cast("string").alias("label"), F.posexplode("scores").alias("class", "score"))
    known = long.join(names, "class").groupBy("class", F.round(F.col("score") * STEPS).cast("int").alias("step"))
    points = known.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("name")).alias("hits"), F.sum("score").alias("total"))

    def curve(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("step")
        hits, n = f["hits"].to_numpy(float), f["n"].to_numpy(float)
        # one hit more at the lowest score and one miss more at the highest: no probability is 0 or 1
        hits[0] += 1
        n[0] += 1
        n[-1] += 1
        p = pooled(hits, n)
        return pd.DataFrame({"class": f["class"].to_numpy(), "score": (f["total"] / f["n"]).to_numpy(), "probability": p})

    return points.groupBy("class").applyInPandas(curve, "class int, score double, probability double")


def calibrated(scores, table: DataFrame, classes: int):
    """A column of probabilities that sum to 1, from a column of scores: each class by its curve, linear between points. All 0 becomes equal shares."""
    lines = {}
    for c, rows in table.toPandas().sort_values("score").groupby("class"):  # at most STEPS + 1 points a class
        lines[int(c)] = (rows["score"].to_numpy(), rows["probability"].to_numpy())

    @F.pandas_udf("array<double>")
    def apply(s: pd.Series) -> pd.Series:
        if not len(s):
            return s
        x = np.stack([np.asarray(a, float) for a in s])
        p = np.stack([np.interp(x[:, c], *lines[c]) if c in lines else np.zeros(len(x)) for c in range(classes)], axis=1)
        total = p.sum(1, keepdims=True)
        p = np.where(total > 0, p / np.where(total > 0, total, 1), 1 / classes)
        return pd.Series([row for row in p])

    return apply(scores)


def train_predict_calibrated(train: DataFrame, queries: DataFrame, id_col: str, features: Sequence[str], label: str, name: str = "linear_svm", folds: int = 3, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """(the queries with predicted, probabilities and raw (normalised scores before); the classes in sorted order).

    Scores of the training rows come from models that have not seen them, over stratified
    folds; a class's curve is the isotonic regression of being of the class on its score.
    The model that meets the queries is fitted to all training rows. Rows without a label
    train nothing; two classes of two rows each are needed. Ties go to the class before.
    """
    folds, dealt = known_folds(train, id_col, label, folds, seed)
    scored = None
    for k in range(folds):
        index, model = fit(dealt.where(F.col("fold") != k), features, label, name, seed)
        one = class_scores(index, model, dealt.where(F.col("fold") == k), features).select(label, "scores")
        scored = one if scored is None else scored.union(one)
    index, model = fit(dealt, features, label, name, seed)
    labels = list(index.labels)
    table = curves(stored(scored, "scores"), label, labels)
    out = class_scores(index, model, queries, features)
    probabilities = calibrated(F.col("scores"), table, len(labels))
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    raw = F.when(total > 0, F.transform("scores", lambda x: x / total)).otherwise(F.transform("scores", lambda x: F.lit(1 / len(labels))))
    out = out.withColumn("probabilities", probabilities).withColumn("raw", raw)
    best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    named = F.element_at(F.array(*[F.lit(v) for v in labels]), best)
    return out.select(*queries.columns, named.alias("predicted"), "probabilities", "raw"), labels


def probability_losses(predictions: DataFrame, label: str, labels: Sequence[str], columns: Sequence[str] = ("raw", "probabilities")) -> DataFrame:
    """column, n, log_loss (probabilities of at least 1e-15) and brier (sum of squares over classes) of columns of probabilities."""
    at = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(label).cast("string")).cast("int")
    known = predictions.where(at > 0).withColumn("__at", at)
    out = None
    for c in columns:
        own = F.element_at(F.col(c), F.col("__at"))
        square = F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x * x) - own * own + (1 - own) * (1 - own)
        one = known.agg(F.count(F.lit(1)).alias("n"), F.avg(-F.log(F.greatest(own, F.lit(1e-15)))).alias("log_loss"), F.avg(square).alias("brier")).select(F.lit(c).alias("column"), "*")
        out = one if out is None else out.union(one)
    return out


def reliability(predictions: DataFrame, label: str, labels: Sequence[str], column: str = "probabilities", bins: int = 10) -> DataFrame:
    """bin (from 0), n, mean_probability and share: how often a class is right where its probability falls into the bin."""
    names = F.array(*[F.lit(v) for v in labels])
    long = predictions.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), F.posexplode(column).alias("at", "p"))
    slot = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return long.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_probability"), F.avg((F.get(names, F.col("at")) == F.col("label")).cast("double")).alias("share"))


def calibration_report(df: DataFrame, id_col: str, features: Sequence[str], label: str, name: str = "linear_svm", folds: int = 3, seed: int = 42) -> DataFrame:
    """model, column, n, log_loss and brier on the rows of one stratified fold, before and after calibration on the others."""
    _, dealt = known_folds(df, id_col, label, folds, seed)
    held = dealt.where("fold = 0").drop("fold")
    predictions, labels = train_predict_calibrated(dealt.where("fold <> 0").drop("fold"), held, id_col, features, label, name, folds, seed)
    return probability_losses(stored(predictions, "predictions"), label, labels).select(F.lit(name).alias("model"), "*")
