"""Pseudo-anchors: clusters of profiles that stand in for missing mechanism labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellframe.functions import stats

from .distance import silhouette
from .graph import numbered_by, stored
from .moa import label_clusters
from .repeats import cluster_bootstrap, first_centres


def unit_clusters(df: DataFrame, id_col: str, vector: str, k: int, seed: int = 0) -> DataFrame:
    """id and cluster of k-means on unit vectors; NULL vectors are left out."""
    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), array_to_vector(stats.unit(F.transform(vector, lambda x: x.cast("double")))).alias("__u"))
    model = KMeans(k=k, seed=seed, featuresCol="__u", predictionCol="cluster", initSteps=5, maxIter=50).fit(rows)
    return model.transform(rows).select("id", "cluster")


def silhouette_by_k(df: DataFrame, id_col: str, vector: str, ks: Sequence[int], seed: int = 0) -> DataFrame:
    """k and the mean cosine silhouette of its clusters; k must be at least 2 and below the number of rows."""
    n, rows = df.where(F.col(vector).isNotNull()).count(), []
    for k in ks:
        if 2 <= k < n:
            named = df.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).join(unit_clusters(df, id_col, vector, k, seed), "id")
            rows.append((k, float(silhouette(named, "id", "v", "cluster", "cosine").agg(F.avg("silhouette")).first()[0])))
    return df.sparkSession.createDataFrame(rows, "k int, mean_silhouette double")


def best_k(table: DataFrame, default: int = 2) -> int:
    """The k of the largest mean silhouette, the smallest of those that tie."""
    row = table.orderBy(F.desc("mean_silhouette"), "k").first()
    return row["k"] if row else default


def make_pseudo_anchors(
    df: DataFrame, id_col: str, vector: str, ks: Sequence[int] = (4, 8, 12), labels: DataFrame | None = None, least_size: int = 2, bootstraps: int = 0, seed: int = 0
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchors: id, cluster, anchor; clusters; k and its silhouette).

    Unit vectors are clustered by the k of the best silhouette. An anchor is named by
    its cluster, or, where ``labels`` (id, label) are given, by the cluster's dominant
    known label (see ``label_clusters``); rows of clusters of fewer than ``least_size``
    rows have none. With ``bootstraps`` the clusters' table carries the mean adjusted
    Rand index over bootstrap samples.
    """
    table = silhouette_by_k(df, id_col, vector, ks, seed)
    k = best_k(table)
    found = stored(unit_clusters(df, id_col, vector, k, seed), "anchors")
    sizes = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    clusters = sizes.withColumn("name", F.concat(F.lit("PSEUDO_"), F.col("cluster").cast("string")))
    if labels is not None:
        # ids of label tables are text
        as_text = found.select("cluster", F.col("id").cast("string").alias("id"))
        named = label_clusters(as_text, labels.select(F.col("id").cast("string").alias("id"), "label")).select("cluster", "status", "dominant_label", "labelled_fraction", "dominant_fraction")
        clusters = clusters.join(named, "cluster", "left").withColumn("name", F.when(F.col("status") == "phenotype_labelled", F.col("dominant_label")).otherwise(F.col("name")))
    if bootstraps:
        clusters = clusters.withColumn("bootstrap_ari", F.lit(cluster_bootstrap(df, id_col, vector, k, bootstraps, seed).agg(F.avg("ari")).first()[0]))
    anchors = found.join(clusters.where(F.col("n") >= least_size).select("cluster", F.col("name").alias("anchor")), "cluster", "left").select("id", "cluster", "anchor")
    return anchors, clusters, table


def sub_centroids(df: DataFrame, id_col: str, vector: str, label: str, most: int = 3, least: int = 5, seed: int = 0, rounds: int = 10, starts: int = 8, seen: int = 256) -> DataFrame:
    """label, sub, n and centroid (unit): each label's rows parted into up to ``most`` centroids by spherical k-means.

    A label of n rows has min(most, n // least) centroids, one at least. All labels are
    clustered together, from several starts at once; of each label the start of the
    largest sum of cosines is kept. First centroids are rows far from one another among
    the ``seen`` rows of least hash of the label; a round is one join and one sum. Empty
    sub-clusters end.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label).cast("string").alias("label"), stats.unit(F.transform(vector, lambda x: x.cast("double"))).alias("v")
    )
    rows = stored(rows, "rows")
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.withColumn("k", F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("rows") / least))).cast("int"))
    order = Window.partitionBy("label").orderBy(F.xxhash64(F.lit(seed), F.col("id").cast("string")), "id")  # only the first leave a task
    head = rows.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= seen).join(sizes, "label")

    def begin(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("__n")
        x, k, name = np.stack(f["v"]), int(f["k"].iat[0]), f["label"].iat[0]
        out = [(name, s, j, c) for s in range(starts) for j, c in enumerate(first_centres(x, np.ones(len(x)), k, np.random.default_rng([seed, s])))]
        return pd.DataFrame(out, columns=["label", "start", "sub", "centroid"])

    centres = stored(head.select("label", "v", "k", "__n").groupBy("label").applyInPandas(begin, "label string, start int, sub int, centroid array<double>"), "centres")
    for _ in range(rounds + 1):  # the last one only counts
        near = rows.join(centres, "label").groupBy("id", "label", "start").agg(F.max_by(F.struct("sub", "v", F.round(stats.dot(F.col("v"), F.col("centroid")), 12).alias("cos")), F.struct(F.round(stats.dot(F.col("v"), F.col("centroid")), 12), -F.col("sub"))).alias("s"))
        spread = near.select("label", "start", F.col("s.sub").alias("sub"), F.col("s.cos").alias("cos"), F.posexplode("s.v").alias("i", "x"))
        sums = spread.groupBy("label", "start", "sub", "i").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("cos").alias("cos"))
        made = sums.groupBy("label", "start", "sub").agg(F.max("n").alias("n"), F.max("cos").alias("cos"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s"))
        centres = stored(made.select("label", "start", "sub", "n", "cos", stats.unit(F.transform("s", lambda t: t["m"])).alias("centroid")), "centres")
    best = centres.groupBy("label", "start").agg(F.sum("cos").alias("cos")).groupBy("label").agg(F.max_by("start", F.struct(F.round("cos", 9), -F.col("start"))).alias("start"))
    return centres.join(best, ["label", "start"]).select("label", "sub", "n", "centroid")


def permuted(rows: DataFrame, id_col: str, label: str, seed: int) -> DataFrame:
    """``rows`` with the values of ``label`` dealt anew: those in one hashed order go to the places in another."""
    order = lambda s: F.struct(F.xxhash64(F.lit(s), F.col(id_col)), F.col(id_col))
    to = numbered_by(rows.drop(label), order(seed), "__n")
    what = numbered_by(rows.select(id_col, label), order(seed + 1_000_003), "__n").select("__n", label)
    return to.join(what, "__n").drop("__n").select(*rows.columns)
