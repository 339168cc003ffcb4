"""Pseudo-anchors, sub-centroids, permutations and neighbour runs against plain versions."""

from collections import Counter

import numpy as np
import pytest

from wellframe.operators import anchors, distance, moa, repeats


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    centres = np.eye(6)[:4] * 5
    x = np.concatenate([c + rng.normal(0, 0.2, (40, 6)) for c in centres])
    rows = [(i, f"c{i // 40}", v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, label string, v array<double>").persist(), x


def test_pseudo_anchors_find_the_clusters_and_their_names(spark, blobs):
    df, _ = blobs
    known = df.where("id % 3 = 0").selectExpr("id", "concat('m', label) AS label")
    found, clusters, table = anchors.make_pseudo_anchors(df, "id", "v", (2, 4, 9), known, bootstraps=2)
    assert anchors.best_k(table) == 4 and {r["k"] for r in table.collect()} == {2, 4, 9}
    assert {(r["id"] // 40, r["anchor"]) for r in found.collect()} == {(i, f"mc{i}") for i in range(4)}
    assert all(r["n"] == 40 and r["bootstrap_ari"] > 0.99 for r in clusters.collect())
    plain = anchors.make_pseudo_anchors(df, "id", "v", (4,), least_size=41)[0].collect()
    assert all(r["anchor"] is None for r in plain) and len(plain) == 160


def test_silhouettes_by_k(spark, blobs):
    df, x = blobs
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    labels = {r["id"]: r["cluster"] for r in anchors.unit_clusters(df, "id", "v", 4).collect()}
    c, d = np.array([labels[i] for i in range(160)]), 1 - u @ u.T
    s = []
    for i in range(160):
        means = {k: d[i][(c == k) & (np.arange(160) != i)].mean() for k in set(c)}
        own, far = means.pop(c[i]), min(means.values())
        s.append((far - own) / max(far, own))
    assert abs(anchors.silhouette_by_k(df, "id", "v", (4,)).first()["mean_silhouette"] - np.mean(s)) < 1e-9


def test_permuted_keeps_counts_and_moves_rows(spark, blobs):
    df, _ = blobs
    got = anchors.permuted(df, "id", "label", 3).collect()
    assert Counter(r["label"] for r in got) == Counter({f"c{i}": 40 for i in range(4)})
    assert sorted(r["id"] for r in got) == list(range(160))
    assert 0 < sum(r["label"] == f"c{r['id'] // 40}" for r in got) < 80
    dealt = moa.shuffled_labels(df, "id", "label", 5)
    assert dealt.columns == ["id", "label"] and dealt.count() == 160
    got = repeats.cluster_permutation(df, "id", "v", "label", 9).first()
    assert got["p_value"] == 0.1 and got["z"] > 3 and got["observed"] > 0.8 > 0.1 > got["null_mean"]


def test_sub_centroids_part_a_label(spark, blobs):
    df, x = blobs
    two = df.selectExpr("id", "if(id < 80, 'a', 'b') AS label", "v").union(spark.createDataFrame([(900, "single", [1.0] * 6), (901, None, [1.0] * 6)], "id long, label string, v array<double>"))
    got = {(r["label"], r["sub"]): r for r in anchors.sub_centroids(two, "id", "v", "label", 2, rounds=8).collect()}
    assert {k: r["n"] for k, r in got.items() if k[0] == "single"} == {("single", 0): 1}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for name, low in (("a", 0), ("b", 80)):
        rows = [got[name, j] for j in (0, 1)]  # two blobs each: the best of several starts parts them
        assert [r["n"] for r in rows] == [40, 40]
        want = [u[low + s : low + s + 40].mean(0) for s in (0, 40)]
        assert sorted(int(np.argmax([np.dot(r["centroid"], w) for w in want])) for r in rows) == [0, 1]
        assert all(max(np.dot(r["centroid"], w / np.linalg.norm(w)) for w in want) > 1 - 1e-9 for r in rows)


def test_queries_are_selected_and_runs_compared(spark, blobs):
    df, _ = blobs
    rows, report = distance.selected_queries(df, "id", [3, " 7", "nothing", 3])
    assert sorted(r["id"] for r in rows.collect()) == [3, 7]
    assert sorted((r["asked"], r["n_rows"], r["found"]) for r in report.collect()) == [(" 7", 1, True), ("3", 1, True), ("nothing", 0, False)]
    assert distance.selected_queries(df, "id", ["C1"], "label")[0].count() == 40
    near = distance.nearest(rows, "id", "v", 5, base=df)
    other = near.where("rank <= 3 AND query_id = 3")
    got = {r["query_id"]: (r["shared"], r["jaccard"]) for r in distance.overlap_of_runs({"all": near, "few": other}, "all").collect()}
    assert got == {3: (3, 0.6), 7: (0, 0.0)}
