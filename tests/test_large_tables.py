"""Operators whose work or memory once grew faster than their results: bounds on memory and on what is formed, and results against plain versions."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wellframe.operators import diagnostics, distance, hierarchy, moa, preprocess, repeats


def test_values_of_nearest_rows_in_bounded_memory():
    rng = np.random.default_rng(3)
    b = np.round(np.c_[rng.integers(0, 20, 60_000), rng.normal(0, 1e3, 60_000), rng.integers(0, 4, (60_000, 2))], 1)
    q = b[:1500].copy()
    q[:, 3], q[:500, 1] = np.nan, np.nan
    q[7] = np.nan
    ids, other = np.arange(1500) - 10_000, np.arange(60_000)
    frame = pd.DataFrame({"q_ids": [ids], "q": [q.ravel()], "b_ids": [other], "b": [b.ravel()]})
    tracemalloc.start()
    got = pd.concat(preprocess._nearest_values(5)([frame]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6  # all distances of the two blocks are 720 MB
    for i in (0, 7, 499, 500, 1499):
        mine = got[(got["q"] == ids[i]) & (got["f"] == 3)]
        have = ~np.isnan(q[i])
        if not have.any():
            assert mine.empty
            continue
        d = np.round(np.sqrt(((b[:, have] - q[i, have]) ** 2).sum(1) * 4 / have.sum()), 12)
        want = np.lexsort((other, d))[:5]
        assert mine["id"].tolist() == want.tolist() and np.allclose(mine["d"], d[want]) and mine["value"].tolist() == b[want, 3].tolist()


def plain_distances(x, metric):
    x = distance.prepared_rows(x, metric)
    return np.abs(x[:, None] - x[None]).sum(2) if metric == "cityblock" else np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if metric == "euclidean" else 1 - x @ x.T


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(8).normal(size=(900, 6))
    x[1::9] = x[::9]
    df = spark.createDataFrame([(i * 7 % 901, v.tolist(), i % 3 if i % 50 else None) for i, v in enumerate(x)], "id long, v array<double>, label int")
    return x, np.arange(900) * 7 % 901, df


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "cityblock", "correlation"])
def test_all_pairs_once_by_blocks(spark, points, metric):
    x, ids, df = points
    got = distance.pairwise(df.select("id", "v").union(spark.createDataFrame([(5000, None), (-5, None)], "id long, v array<double>")), "id", "v", metric, digits=6)
    assert "Join LeftOuter" not in got._jdf.queryExecution().toString() and "MapInArrow" in got._jdf.queryExecution().toString()  # pairs are no join of rows
    rows = got.toPandas()
    assert len(rows) == 902 * 901 // 2 and (rows["id_a"] < rows["id_b"]).all() and not rows.duplicated(["id_a", "id_b"]).any()
    assert rows["distance"].isna().sum() == 2 * 900 + 1
    known, place = rows.dropna(), np.argsort(ids)
    at = lambda c: place[np.searchsorted(ids[place], known[c])]
    assert np.abs(plain_distances(x, metric)[at("id_a"), at("id_b")] - known["distance"]).max() < 6e-7


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("last", [1 << 19, 100])
def test_medians_within_and_between_labels_without_a_table_of_pairs(spark, points, metric, last, monkeypatch):
    monkeypatch.setattr(moa, "LAST_DISTANCES", last)
    x, ids, df = points
    d, label = plain_distances(x, metric), np.array([i % 3 if i % 50 else -1 for i in range(900)])
    i, j = np.triu_indices(900, 1)
    known = (label[i] >= 0) & (label[j] >= 0)
    i, j = i[known], j[known]
    same = label[i] == label[j]
    got = moa.separability_of_vectors(df, "id", "v", "label", metric).first()
    assert abs(got["median_within"] - np.median(d[i, j][same])) < 1e-12 and abs(got["median_between"] - np.median(d[i, j][~same])) < 1e-12
    alone = moa.separability_of_vectors(df.where(F.col("label") == 1), "id", "v", "label", metric).first()
    assert alone["median_between"] is None and alone["separability"] is None


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_replicate_summary_without_a_table_of_pairs(spark, method):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        v = [None if rng.random() < 0.02 else float(x) for x in rng.integers(0, 5, 4)]
        rows.append((i, None if i % 11 == 0 else ("hot" if i % 4 else f"g{i % 3}"), *([3.0] * 4 if i % 97 == 0 else v)))
    df = spark.createDataFrame(rows, "id long, g string, a double, b double, c double, d double")
    counts = diagnostics.replicate_counts(df, "id", ["g"], list("abcd"), method)
    pairs = diagnostics.replicate_pairs(df, "id", ["g"], list("abcd"), method)
    got, want = ({r["g"]: r for r in t.collect()} for t in (diagnostics.summary_of_counts(counts, ["g"]), diagnostics.replicate_summary(pairs, ["g"])))
    assert got.keys() == want.keys() and counts.agg(F.sum("n")).first()[0] == pairs.count()
    for g in want:
        assert got[g]["n_pairs"] == want[g]["n_pairs"]
        assert all(abs(got[g][c] - want[g][c]) < 1e-9 for c in ("median_correlation", "mean_correlation", "sd_correlation"))
    if method == "spearman":  # kinds of rows: 4 ranks without gaps have 75 orders
        assert counts.where("g = 'hot'").count() < pairs.where("g = 'hot'").count() / 4


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "cityblock"])
@pytest.mark.parametrize("kind", ["spread", "copies", "far", "huge", "names"])
def test_nearest_through_single_precision(metric, kind):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(1500, 8))
    if kind == "copies":
        y[::3], y[1::3] = y[0], y[1] + rng.normal(size=(500, 8)) * 1e-9
    y = y + 1e4 if kind == "far" else y * 1e40 if kind == "huge" else y
    y = distance.prepared_rows(y, metric)
    ids = rng.permutation(1500)
    ids = np.array([f"n{i:04d}" for i in ids], object) if kind == "names" else ids
    best = distance.Best(ids[:300], y[:300], metric, 5)
    for low in range(0, 1500, 500):
        best.meet(ids[low : low + 500], y[low : low + 500])
    for i in range(300):
        d = np.round(np.abs(y - y[i]).sum(1) if metric == "cityblock" else np.sqrt(((y - y[i]) ** 2).sum(1)) if metric == "euclidean" else 1 - np.einsum("ij,j->i", y, y[i]), 12)
        d[i] = np.inf
        want = np.lexsort((np.unique(ids, return_inverse=True)[1], d))[:5]
        got = best.near[best.row == i]
        assert np.abs(best.d[best.row == i] - d[want]).max() <= 2e-12 * max(1, d[want].max())
        if kind != "copies":
            assert got.tolist() == ids[want].tolist()


def test_bootstrap_of_files_whose_parts_hold_no_rows(spark):
    x = np.random.default_rng(6).normal(size=(2000, 40))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").coalesce(1)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")  # splits of one row group
    try:
        assert repeats.cluster_bootstrap(df, "id", "v", 3, rounds=2).count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rows_of_the_largest_component_are_not_compared(monkeypatch):
    x = np.random.default_rng(7).normal(size=(200, 4))
    component = np.where(np.arange(200) % 40 == 0, np.arange(200), 1)
    side = lambda s, at: {f"{s}_ids": [at], s: [x[at].ravel()], f"{s}_components": [component[at]]}
    frame = pd.DataFrame(side("a", np.arange(100)) | side("b", np.arange(100, 200)))
    pairs, plain = [], hierarchy.block_distances
    monkeypatch.setattr(hierarchy, "block_distances", lambda p, q, metric: pairs.append(len(p) * len(q)) or plain(p, q, metric))
    skipped = pd.concat(hierarchy._shortest_ways_out("euclidean", 1)([frame])).reset_index(drop=True)
    assert sum(pairs) <= 3 * 100 + 97 * 2
    whole = pd.concat(hierarchy._shortest_ways_out("euclidean")([frame])).reset_index(drop=True)
    assert sum(pairs) > 10_000 and skipped.equals(whole)
