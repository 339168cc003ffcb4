"""Scores against classes by blocks, calibrated classifiers and projections against plain numpy."""

import numpy as np
import pytest

from wellframe.operators import moa


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def plain_scores(x, labels, c, scoring, collapse, k, top, heat):
    cos = np.round(unit(x) @ unit(c).T, 12)
    s = cos
    if scoring == "csls":
        best = lambda m: np.sort(m, axis=1)[:, -k:].mean(1)
        s = 2 * cos - best(cos)[:, None] - best(cos.T)[None, :]
    names = sorted(set(labels)) if collapse else list(labels)
    if collapse:
        make = {"max": np.max, "mean": np.mean, "median": np.median}[collapse]
        s = np.stack([make(s[:, [i for i, v in enumerate(labels) if v == n]], axis=1) for n in names], axis=1)
    e = np.exp((s - s.max(1, keepdims=True)) / heat)
    out = {}
    for i in range(len(x)):
        order = sorted(range(len(names)), key=lambda j: (-round(s[i, j], 10), names[j]))
        ranked = np.sort(s[i])[::-1]
        margin = ranked[0] - ranked[1] if len(ranked) > 1 else 0.0
        out[i] = [(names[j], s[i, j], e[i, j] / e[i].sum(), margin) for j in order[:top]]
    return out


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 6))
    c = rng.normal(size=(90, 6))
    c[40:] = c[:50] + rng.normal(size=(50, 6)) * 0.1
    labels = [f"m{i % 37:02d}" if i % 3 else "hot" for i in range(90)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>")
    return x, c, labels, rows


@pytest.mark.parametrize("scoring,collapse", [("distance", None), ("distance", "max"), ("csls", "max"), ("csls", "median"), ("distance", "mean")])
def test_blocks_of_classes_give_the_scores_of_the_whole(spark, many, scoring, collapse):
    from wellframe.operators.scoring import score_classes

    x, c, labels, rows = many
    names = labels if collapse else [f"c{i:02d}" for i in range(90)]
    classes = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, c)] + [(None, c[0].tolist()), ("empty", None)], "label string, centroid array<double>")
    got = {}
    for r in score_classes(rows, "id", "v", classes, "cosine", 4, 0.1, scoring, collapse, k=7, block=16).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["label"], r["similarity"], r["confidence"], r["margin"])
    want = plain_scores(x, names, c, scoring, collapse, 7, 4, 0.1)
    assert set(got) == set(want)
    for i, ranked in want.items():
        assert [got[i][k + 1][0] for k in range(4)] == [r[0] for r in ranked]
        assert np.allclose([got[i][k + 1][1:] for k in range(4)], [r[1:] for r in ranked], atol=1e-9)


def test_equal_centroids_tie_to_the_smaller_label_and_one_class_has_no_margin(spark, many):
    _, c, _, rows = many
    same = spark.createDataFrame([(f"l{i:02d}", c[0].tolist()) for i in range(40)], "label string, centroid array<double>")
    assert {r["label"] for r in moa.centroid_scores(rows, "id", "v", same, top=1).collect()} == {"l00"}
    one = moa.centroid_scores(rows, "id", "v", same.where("label = 'l03'")).collect()
    assert len(one) == 120 and {(r["label"], r["margin"], r["confidence"]) for r in one} == {("l03", 0.0, 1.0)}
    assert moa.centroid_scores(rows, "id", "v", same.where("label = 'x'")).count() == 0


@pytest.mark.parametrize("width,rank", [(30, 30), (700, 40)])
def test_krylov_components_are_those_of_the_svd(spark, width, rank):
    from wellframe.operators.projection import randomised_pca

    rng = np.random.default_rng(width)
    x = rng.normal(size=(300, rank)) * np.linspace(3, 1, rank) @ np.linalg.qr(rng.normal(size=(width, rank)))[0].T + 50
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<double>").repartition(5)
    scored, components = randomised_pca(df, "v", 4)
    got = {r["id"]: [r[f"PC{i + 1}"] for i in range(4)] for r in scored.collect()}
    assert got.pop(999) == [None] * 4
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    sign = np.sign(vt[np.arange(4), np.abs(vt[:4]).argmax(1)])
    assert np.abs(np.array([got[i] for i in range(300)]) - (u * s)[:, :4] * sign).max() < 1e-6
    facts = components.collect()
    assert np.allclose([r["explained"] for r in facts], (s**2 / (s**2).sum())[:4], rtol=1e-9)
    assert np.allclose([r["variance"] for r in facts], s[:4] ** 2 / 300, rtol=1e-9)
    assert max(r["residual"] for r in facts) < 1e-9


def test_components_of_gaps_of_constants_and_of_nothing(spark):
    from wellframe.operators.projection import pca_embedding, randomised_pca

    x = np.random.default_rng(1).normal(size=(60, 3))
    x[:, 2] = 4.0
    rows = [(i, *[None if (i + j) % 9 == 0 else float(v) for j, v in enumerate(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    scored, components = pca_embedding(df, ["a", "b", "c"], 5)
    assert scored.columns == ["id", "latent_1", "latent_2", "latent_3"]
    full = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    full = np.where(np.isnan(full), np.nanmedian(full, axis=0), full)
    z = (full - full.mean(0)) / np.where(full.std(0) > 0, full.std(0), 1)
    s = np.linalg.svd(z, compute_uv=False)
    got = sorted((r["id"], r["latent_1"], r["latent_2"], r["latent_3"]) for r in scored.collect())
    assert np.allclose(np.linalg.norm(np.array(got)[:, 1:], axis=0), s, atol=1e-9)
    assert abs(sum(r["explained"] for r in components.collect()) - 1) < 1e-9
    empty = spark.createDataFrame([(1, None)], "id long, v array<double>")
    scored, components = randomised_pca(empty, "v", 2)
    assert scored.collect()[0]["PC2"] is None and components.count() == 0
    with pytest.raises(ValueError):
        randomised_pca(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>"), "v", 1)


def test_rows_and_centroids_share_one_space(spark, many):
    from wellframe.operators.projection import embedding_with_centroids

    x, c, _, rows = many
    classes = spark.createDataFrame([(f"c{i}", v.tolist()) for i, v in enumerate(c[:10])], "label string, centroid array<double>")
    got, _ = embedding_with_centroids(rows, "id", "v", classes)
    got = got.collect()
    both = np.vstack([unit(x), unit(c[:10])])
    u, s, vt = np.linalg.svd(both - both.mean(0), full_matrices=False)
    want = (u * s)[:, :2] * np.sign(vt[np.arange(2), np.abs(vt[:2]).argmax(1)])
    for r in got:
        i = r["id"] if r["point_type"] == "row" else 120 + int(r["label"][1:])
        assert np.allclose([r["PC1"], r["PC2"]], want[i], atol=1e-6)
    assert len(got) == 130


def test_pooled_shares_are_the_isotonic_fit():
    from wellframe.operators.calibration import pooled

    rng = np.random.default_rng(3)
    n = rng.integers(1, 9, 40).astype(float)
    hits = np.minimum(n, rng.integers(0, 9, 40)).astype(float)
    # the max-min formula of isotonic regression
    mean = lambda a, b: hits[a : b + 1].sum() / n[a : b + 1].sum()
    want = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(pooled(hits, n), want)


@pytest.fixture(scope="module")
def blurred(spark):
    """Three classes in four features, of which only two tell; a few rows have no label."""
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 900)
    x = rng.normal(size=(900, 4)) + np.array([[0, 0, 0, 0], [1.2, 0, 0, 0], [0, 1.5, 0, 0]])[y]
    rows = [(i, *map(float, v), None if i % 100 == 0 else "abc"[c]) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, f0 double, f1 double, f2 double, f3 double, label string")


def test_calibration_of_distorted_scores_lowers_the_log_loss(spark):
    """Scores are cubes of the true chances; the curves come from half of the rows and are judged on the others."""
    from wellframe.operators.calibration import calibrated, curves, probability_losses, reliability
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    p = rng.dirichlet([1, 1, 1], 4000)
    y = [rng.choice(3, p=v) for v in p]
    df = spark.createDataFrame([(i, (v**3).tolist(), "abc"[c]) for i, (v, c) in enumerate(zip(p, y))], "id long, scores array<double>, label string")
    table = curves(df.where("id < 2000"), "label", ["a", "b", "c"])
    for c in range(3):
        line = [r["probability"] for r in sorted(table.where(f"class = {c}").collect(), key=lambda r: r["score"])]
        assert line == sorted(line) and 0 < line[0] and line[-1] < 1 and len(line) <= 1001
    total = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    out = df.where("id >= 2000").withColumn("raw", F.transform("scores", lambda x: x / total)).withColumn("probabilities", calibrated(F.col("scores"), table, 3))
    got = {r["column"]: r for r in probability_losses(out, "label", ["a", "b", "c"]).collect()}
    own = np.array([v[c] for v, c in zip(p, y)])[2000:]
    best = float(-np.log(own).mean())
    assert best - 0.02 < got["probabilities"]["log_loss"] < best + 0.06 < got["raw"]["log_loss"]
    assert got["probabilities"]["brier"] < got["raw"]["brier"]
    rows = out.collect()
    raw = np.array([r["raw"] for r in rows])
    at = np.array(["abc".index(r["label"]) for r in rows])
    assert abs(got["raw"]["log_loss"] + np.log(np.maximum(raw[np.arange(2000), at], 1e-15)).mean()) < 1e-9
    assert abs(got["raw"]["brier"] - ((raw - np.eye(3)[at]) ** 2).sum(1).mean()) < 1e-9
    assert np.allclose(np.array([r["probabilities"] for r in rows]).sum(1), 1)
    bins = reliability(out, "label", ["a", "b", "c"]).collect()
    assert sum(r["n"] for r in bins) == 6000 and all(abs(r["share"] - r["mean_probability"]) < 0.08 for r in bins)


def test_a_forest_of_true_shares_keeps_its_loss_and_its_rows_add_to_one(spark, blurred):
    from wellframe.operators.calibration import probability_losses, train_predict_calibrated

    train, held = blurred.where("id % 3 <> 1"), blurred.where("id % 3 = 1")
    out, labels = train_predict_calibrated(train, held, "id", ["f0", "f1", "f2", "f3"], "label", "random_forest", 2)
    rows = out.collect()
    assert labels == ["a", "b", "c"] and len(rows) == held.count()
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 and r["predicted"] == labels[int(np.argmax(r["probabilities"]))] for r in rows)
    loss = {r["column"]: r["log_loss"] for r in probability_losses(out, "label", labels).collect()}
    assert abs(loss["probabilities"] - loss["raw"]) < 0.03 and loss["probabilities"] < np.log(3) - 0.15
    assert np.mean([r["predicted"] == r["label"] for r in rows if r["label"]]) > 0.55
