"""Hierarchies, correlations, imputation, neighbour runs, repeated clusterings and stage reports against plain versions."""

from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wellframe.operators import distance, gram, hierarchy, latent, models, neighbours, preprocess, repeats, stages
from wellframe.plans import queries, workflows

SMALL = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- distances and hierarchies


@pytest.mark.parametrize("width", [255, 256, 600])
@pytest.mark.parametrize("metric", ["euclidean", "cityblock"])
def test_copies_are_at_no_distance_whatever_the_width(width, metric):
    x = np.random.default_rng(width).normal(size=(512, width)) * 100
    d = distance.block_distances(x, x[::-1].copy(), metric)
    assert (np.diag(d[:, ::-1]) == 0).all()
    i, j = 3, 200
    want = np.abs(x[i] - x[511 - j]).sum() if metric == "cityblock" else np.sqrt(((x[i] - x[511 - j]) ** 2).sum())
    assert abs(d[i, j] - want) < 1e-9 * want


def test_knn_finds_copies_at_no_distance_in_wide_tables(spark):
    x = np.repeat(np.random.default_rng(0).normal(size=(150, 300)), 2, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r["query_id"]: (r["neighbour_id"], r["distance"]) for r in distance.nearest(df, "id", "v", 1, "euclidean", block=64).collect()}
    assert got == {i: (i ^ 1, 0.0) for i in range(300)}


def plain_tree(x, metric):
    """Edges and merges (left, right, sizes) by sorting all pairs."""
    u = x if metric == "euclidean" else x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if metric == "euclidean" else 1 - u @ u.T
    top, size, edges, merges = list(range(len(x))), [1] * len(x), [], []

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for h, i, j in sorted((round(float(d[i, j]), 12), i, j) for i, j in combinations(range(len(x)), 2)):
        a, b = sorted((root(i), root(j)))
        if a != b:
            edges.append((i, j))
            merges.append((a, size[a], b, size[b]))
            top[b] = a
            size[a] += size[b]
    return edges, merges


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(4).normal(size=(150, 5))
    x[50] = x[70] = x[3]  # copies tie
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)


@pytest.mark.parametrize("metric,most", [("euclidean", 100_000), ("cosine", 40)])
def test_spanning_tree_merges_cuts_and_leaf_order(spark, points, metric, most):
    x, df = points
    edges, merges = plain_tree(x, metric)
    tree = hierarchy.spanning_tree(df, "id", "v", metric, block=40)
    assert [(r["low"], r["high"]) for r in tree.orderBy("d", "low", "high").collect()] == edges
    made = hierarchy.merge_tree(tree, most)  # 40: the tree is halved twice
    rows = {r["merge"]: r for r in made.collect()}
    assert [(rows[k]["left"], rows[k]["left_size"], rows[k]["right"], rows[k]["right_size"]) for k in range(149)] == merges

    def leaves(k):
        r = rows[k]
        return [i for side in ("left", "right") for i in ([r[side]] if r[f"{side}_merge"] < 0 else leaves(r[f"{side}_merge"]))]

    order = [(r["id"], r["position"]) for r in hierarchy.leaf_order(made).orderBy("position").collect()]
    assert order == [(i, p) for p, i in enumerate(leaves(148))]
    got = {r["id"]: r["cluster"] for r in hierarchy.cut_tree(tree, df, "id", 6).collect()}
    top = list(range(150))
    for a, _, b, _ in merges[: 150 - 6]:
        top = [a if t == b else t for t in top]
    number = {t: n for n, t in enumerate(sorted(set(top)))}
    assert got == {i: number[t] for i, t in enumerate(top)}


def test_trees_of_few_rows(spark):
    one = spark.createDataFrame([(7, [1.0, 2.0])], "id long, v array<double>")
    assert hierarchy.spanning_tree(one, "id", "v").collect() == []
    assert [tuple(r) for r in hierarchy.clustered_rows(one, "id", "v").collect()] == [(7, 0)]
    assert hierarchy.clustered_rows(one.limit(0), "id", "v").collect() == []
    with pytest.raises(ValueError):
        hierarchy.cut_tree(one, one, "id")


def plain_agglomerative(x, k, linkage):
    """Merging by the definitions, over all members."""
    groups = [[i] for i in range(len(x))]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))

    def apart(a, b):
        if linkage == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        between = d[np.ix_(a, b)]
        return between.mean() if linkage == "average" else between.max() if linkage == "complete" else between.min()

    while len(groups) > k:
        i, j = min(combinations(range(len(groups)), 2), key=lambda t: apart(groups[t[0]], groups[t[1]]))
        groups[i] += groups.pop(j)
    groups.sort(key=min)
    return {i: n for n, g in enumerate(groups) for i in g}


@pytest.mark.parametrize("linkage", ["ward", "average", "complete", "single"])
def test_agglomerative_like_its_definition(spark, linkage):
    x = np.random.default_rng(8).normal(size=(60, 3))
    df = spark.createDataFrame([(i, *v.tolist()) for i, v in enumerate(x)], "id long, a double, b double, c double")
    got = hierarchy.agglomerative(df, "id", ["a", "b", "c"], 5, linkage)
    assert {r["id"]: r["cluster"] for r in got.collect()} == plain_agglomerative(x, 5, linkage)


def test_agglomerative_over_centres_parts_blobs(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(10 * c, 0.5, (50, 2)) for c in range(4)])
    df = spark.createDataFrame([(i, *v.tolist()) for i, v in enumerate(x)], "id long, a double, b double")
    got = {r["id"]: r["cluster"] for r in hierarchy.agglomerative(df, "id", ["a", "b"], 4, "ward", centres=20).collect()}
    assert got == {i: i // 50 for i in range(200)}


def test_heatmap_table(spark, points):
    x, _ = points
    df = spark.createDataFrame([(i, *v.tolist()) for i, v in enumerate(x[:40])], "id long, a double, b double, c double, d double, e double")
    names = list("abcde")
    found = workflows.heatmap(df, "id", names)
    rows = found.data.orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(40)) and found.data.columns[:2] == ["id", "position"] and sorted(found.data.columns[2:]) == names
    z = (x[:40] - x[:40].mean(0)) / x[:40].std(0)
    assert all(abs(r[c] - z[r["id"], i]) < 1e-9 for r in rows for i, c in enumerate(names))
    columns = [r["feature"] for r in found.audits["columns"].orderBy("position").collect()]
    # the two columns of the first merge stand side by side
    u = x[:40] / np.linalg.norm(x[:40], axis=0)
    zu = z / np.linalg.norm(z, axis=0)
    s = zu.T @ zu - 2 * np.eye(5)
    a, b = np.unravel_index(s.argmax(), s.shape)
    assert abs(columns.index(names[a]) - columns.index(names[b])) == 1 and u.shape == (40, 5)


# ---------------------------------------------------------------- correlations


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    x[:, 1], x[:, 2], x[:, 4], x[:, 5] = np.round(x[:, 0]), -x[:, 0] + 0.1 * x[:, 3], 3.0, np.round(x[:, 5])
    rows = [[None if rng.random() < 0.1 and j != 4 else float(v) for j, v in enumerate(r)] for r in x]
    names = [f"f{i}" for i in range(6)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(20), pd.DataFrame(rows, columns=names, dtype=float), names


def plain_tau(p, a, b):
    v = p[[a, b]].dropna().to_numpy()
    s, t = (np.sign(v[:, None, k] - v[None, :, k]) for k in (0, 1))
    spread = np.sqrt((s * s).sum() * (t * t).sum())
    return (s * t).sum() / spread if spread else 0.0


def test_correlations_by_blocks_of_columns(gappy):
    df, p, names = gappy
    want = p.corr().fillna(0)
    for got in (gram.correlations(df, names, columns=2, most_pairs=2), gram.correlations(df, names), preprocess.correlation_pairs(df, names)):
        assert {(r[0], r[1]): pytest.approx(r[2], abs=1e-12) for r in got.collect()} == {(a, b): want.loc[a, b] for a, b in combinations(names, 2)}


def test_ranks_by_ranges(gappy):
    df, p, names = gappy
    got = gram.ranked(df, names).toPandas().sort_values(names).to_numpy()
    assert np.array_equal(got, p.rank().sort_values(names).to_numpy(), equal_nan=True)


def test_kendall_by_parts(gappy, monkeypatch):
    df, p, names = gappy
    monkeypatch.setattr(gram, "LEAST_PART", 16)
    got = {(r[0], r[1]): r[2] for r in preprocess.correlation_pairs(df, names, "kendall").collect()}
    assert got == {(a, b): pytest.approx(plain_tau(p, a, b), abs=1e-12) for a, b in combinations(names, 2)}


def test_inversions():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 333):
        x = rng.permutation(n)
        assert gram._inversions(x) == sum(x[i] > x[j] for i in range(n) for j in range(i + 1, n))


def test_filter_has_no_limit_on_features(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 300))
    x[:, 250] = x[:, 10] * 2
    x[:, 299] = -x[:, 0] * 0.5
    names = [f"c{i}" for i in range(300)]
    df = spark.createDataFrame([v.tolist() for v in x], ", ".join(f"{n} double" for n in names))
    kept, report = preprocess.correlation_filter(df, names, 0.99, "pearson")
    assert {(r["feature"], r["retained_feature"]) for r in report.collect()} == {("c10", "c250"), ("c299", "c0")}
    assert len(kept) == 298
    kept, _ = preprocess.correlation_filter(df, names, 0.99, "pearson", "order", protected=["c250"])
    assert set(names) - set(kept) == {"c10", "c299"}


def test_wide_summary_query_like_numpy(spark):
    v = np.array([r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()], float)
    names = [(i, j) for i in range(64) for j in range(i, 64)]
    r = np.abs(np.corrcoef(np.stack([v[:, i] * v[:, j] for i, j in names]))) - np.eye(len(names))
    got = {x["feature"]: x for x in queries.queries()["corr_wide_summary"](spark, SMALL).collect()}
    assert len(got) == 2080
    for k, (i, j) in enumerate(names):
        x = got[f"p{i}_{j}"]
        assert abs(x["mean_r"] - r[k].sum() / 2079) < 2e-6 and x["n_close"] == (r[k] >= 0.5).sum()


# ---------------------------------------------------------------- imputation


def test_imputation_by_neighbours_within_groups(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(120, 4)), 1)
    x[rng.random(x.shape) < 0.25] = np.nan
    x[5] = np.nan
    group = rng.integers(0, 3, 120)
    rows = [(i, int(g), *[None if np.isnan(v) else float(v) for v in r]) for i, (g, r) in enumerate(zip(group, x))]
    df = spark.createDataFrame([*rows, (None, 0, None, 1.0, None, 1.0)], "id int, g int, a double, b double, c double, d double")
    whole = np.vstack([x, [np.nan, 1.0, np.nan, 1.0]])
    middle = np.nanmedian(whole, axis=0)
    got = {r["id"]: [r[c] for c in "abcd"] for r in preprocess.impute_knn(df, list("abcd"), "id", 3, ["g"], block=16).collect()}
    for i in range(120):
        for j in range(4):
            want = x[i, j]
            if np.isnan(want):
                near = []
                for o in range(120):
                    both = ~np.isnan(x[i]) & ~np.isnan(x[o])
                    if o != i and group[o] == group[i] and both.any() and not np.isnan(x[o, j]):
                        near.append((round(float(np.sqrt(((x[i] - x[o])[both] ** 2).sum() * 4 / both.sum())), 12), o))
                want = np.mean([x[o, j] for _, o in sorted(near)[:3]]) if near else middle[j]
            assert abs(got[i][j] - want) < 1e-12
    assert got[None] == [middle[0], 1.0, middle[2], 1.0]


def test_indicators_name_what_they_leave_out(spark):
    df = spark.createDataFrame([(None, None, 1.0), (None, 2.0, 1.0), (1.0, 3.0, 1.0)], "a double, b double, c double")
    assert [c for c in preprocess.missing_indicators(df, ["a", "b", "c"]).columns if c.startswith("Missing")] == ["MissingIndicator__a", "MissingIndicator__b"]
    got = {r["feature"]: r["status"] for r in preprocess.indicator_report(df, ["a", "b", "c"], most=1).collect()}
    assert got == {"a": "indicated", "b": "left_out", "c": "below_limit"}


# ---------------------------------------------------------------- neighbour runs


def plain_overlap(a, b, depth, ties, p=0.9):
    """a, b: lists of (neighbour, distance)."""

    def chosen(x):
        d = min(depth, len(x))
        if not ties or all(v is None for _, v in x):
            return {n for n, _ in x[:d]}
        limit = x[d - 1][1]
        return {n for n, v in x if v is not None and limit is not None and v <= limit}

    sa, sb = chosen(a), chosen(b)
    n = min(depth, len(a), len(b))
    rbo = (1 - p) * sum(p ** (d - 1) * len({n for n, _ in a[:d]} & {n for n, _ in b[:d]}) / d for d in range(1, n + 1))
    return len(sa & sb) / len(sa | sb) if sa | sb else 0.0, rbo, len(sa), len(sb)


@pytest.mark.parametrize("ties", [False, True])
def test_overlap_of_long_and_wide_runs(spark, ties):
    rng = np.random.default_rng(9)
    lists = {run: {q: [(f"n{n}", round(float(d), 1)) for n, d in zip(rng.permutation(12)[: rng.integers(3, 9)], np.sort(rng.random(9)))] for q in ("a", "b", "c", f"only_{run}")} for run in ("base", "x")}
    rows = {run: [(q, n, k, d) for q, found in by.items() for k, (n, d) in enumerate(found)] for run, by in lists.items()}
    base = spark.createDataFrame(rows["base"], "cpd_id string, neighbor_id string, nn_rank int, cosine_distance double")
    run = spark.createDataFrame(rows["x"], "query_id string, neighbour_id string, rank int, distance double")
    wide = spark.createDataFrame([("a", "n1", "a", "n3"), ("b", "n2", None, "n4")], "compound string, NN1 string, NN2 string, NN10 string")
    by_query, summary = neighbours.overlap({"base": base, "x": run, "wide": wide}, "base", 4, ties)
    got = {(r["run"], r["query_id"]): tuple(r[c] for c in ("jaccard", "rbo", "baseline_size", "run_size")) for r in by_query.collect()}
    other = {"x": lists["x"], "wide": {"a": [("n1", None), ("n3", None)], "b": [("n2", None), ("n4", None)]}}
    want = {(r, q): plain_overlap(lists["base"][q], found, 4, ties) for r, by in other.items() for q, found in by.items() if q in lists["base"]}
    assert got == {k: (pytest.approx(v[0]), pytest.approx(v[1]), *v[2:]) for k, v in want.items()}
    rows = {r["run"]: r for r in summary.collect()}
    assert rows["x"]["n_queries"] == 3 and abs(rows["x"]["median_jaccard"] - np.median([v[0] for (r, _), v in want.items() if r == "x"])) < 1e-12
    auto = neighbours.overlap({"base": base, "wide": wide}, "base")[0].first()
    assert auto["k"] == 2
    with pytest.raises(ValueError):
        neighbours.overlap({"base": base}, "base")
    with pytest.raises(ValueError):
        neighbours.long_neighbours(base.select("cpd_id", "neighbor_id"))
    found = workflows.neighbour_analysis({"base": base, "x": run}, "base", [" A ", "b"], 2, 4, ties)
    top = found.audits["top_neighbours"].orderBy("query_id", "place").collect()
    assert [r["query_id"] for r in top] == ["a", "a", "b", "b"]


# ---------------------------------------------------------------- batches


def test_balanced_batches(spark):
    rows = [(i, f"l{i % 7}") for i in range(70)] + [(100, "alone"), (101, None), (102, "pair"), (103, "pair")]
    df = spark.createDataFrame(rows, "id long, label string").repartition(3)
    label = dict(rows)
    got = {}
    for r in latent.balanced_batches(df, "id", "label", range(6), 22, 4).collect():
        got.setdefault(r["batch"], {})[r["slot"]] = (r["label"], r["id"])
    assert sorted(got) == list(range(6))
    for slots in got.values():
        assert sorted(slots) == list(range(20))  # five labels of four rows
        assert all(label[i] == name != "alone" for name, i in slots.values())
        of = Counter(name for name, _ in slots.values())
        assert len(of) == 5 and set(of.values()) == {4}
        assert all(len({i for n, i in slots.values() if n == name}) == (2 if name == "pair" else 4) for name in of)
    assert len({tuple(sorted(s.values())) for s in got.values()}) == 6
    again = {r["slot"]: (r["label"], r["id"]) for r in latent.balanced_batches(df, "id", "label", [4], 22, 4).collect()}
    assert again == got[4]  # a batch is made without those before
    many = latent.balanced_batches(df, "id", "label", [0], 80, 4).collect()  # more turns than labels
    assert len(many) == 80 and max(Counter(r["label"] for r in many).values()) == 12
    assert {r["label"]: r["n"] for r in latent.positive_groups(df, "label").collect()} == {"pair": 2, **{f"l{i}": 10 for i in range(7)}}
    with pytest.raises(ValueError):
        latent.balanced_batches(df.where("id = 100"), "id", "label", [0])


def test_folds_and_splits_deal_every_class_evenly(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"c{i % 2}") for i in range(90)], "id long, y string").repartition(5)
    folds = Counter((r["y"], r["fold"]) for r in models.stratified_folds(df, "y", "id", 4).collect())
    assert all(abs(folds[y, k] - n / 4) < 1 for y, n in (("hot", 60), ("c0", 15), ("c1", 15)) for k in range(4))


# ---------------------------------------------------------------- repeated clusterings


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(0, 0.3, (50, 4)) for c in np.eye(4)[:3] * 6])
    return x, spark.createDataFrame([(i, *v.tolist()) for i, v in enumerate(x)], "id long, a double, b double, c double, d double").repartition(3)


def test_many_kmeans_reach_the_blobs(spark, blobs):
    x, df = blobs
    rows = repeats.marked_rows(df.withColumn("v", F.array(*"abcd")), "id", "v", unit=False)
    centres = repeats.many_kmeans(rows, 4, 3, repeats.bootstrap_weight(0))
    want = np.stack([x[k * 50 : k * 50 + 50].mean(0) for k in range(3)])
    assert np.allclose(sorted(centres[0].tolist()), sorted(want.tolist()))
    marks = {r["id"]: r["mark"] for r in rows.collect()}
    w = repeats.bootstrap_weight(0)(np.array([marks[i] for i in range(150)]), 2)
    weighted = np.stack([(x[s] * w[s, None]).sum(0) / w[s].sum() for s in (slice(0, 50), slice(50, 100), slice(100, 150))])
    assert np.allclose(sorted(centres[2].tolist()), sorted(weighted.tolist()))
    assert 0.8 < w.mean() < 1.2 and w.max() > 1 and w.min() == 0
    ari = [r["ari"] for r in repeats.cluster_bootstrap(df.withColumn("v", F.array(*"abcd")), "id", "v", 3, 5).collect()]
    assert len(ari) == 5 and min(ari) == 1.0
    assert repeats.cluster_stability(df, "id", list("abcd"), 3, 4) == [1.0] * 4


def test_adjusted_rand():
    assert repeats.rand_of_counts(np.array([[3, 0], [0, 4]])) == 1.0
    assert abs(repeats.rand_of_counts(np.array([[2, 1], [1, 2]])) - (2 - 36 / 15) / (6 - 36 / 15)) < 1e-12


def test_consensus_of_labels_like_counting(spark):
    rng = np.random.default_rng(2)
    labels = rng.integers(-1, 3, (30, 7))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(labels)], "id long, labels array<int>")
    got = {(r["id_a"], r["id_b"]): (r["co_observed"], r["co_cluster"]) for r in repeats.consensus_of(df, block=8).collect()}
    want = {}
    for a, b in combinations(range(30), 2):
        seen = (labels[a] >= 0) & (labels[b] >= 0)
        if seen.any():
            want[a, b] = (seen.sum(), (seen & (labels[a] == labels[b])).sum())
    assert got == want


def test_permutations_of_clusters_use_the_exact_silhouette(spark, blobs):
    x, df = blobs
    ready = df.select("id", (F.col("id") % 4).alias("c"), F.array(*"abcd").alias("v"))
    want = distance.silhouette(ready, "id", "v", "c", "cosine").agg(F.avg("silhouette")).first()[0]
    got = repeats.cluster_permutation(ready, "id", "v", "c", 20).first()
    assert abs(got["observed"] - want) < 1e-9 and got["permutations"] == 20 and 1 / 21 <= got["p_value"] <= 1


def test_neighbour_stability_like_counting(spark, blobs):
    x, df = blobs
    got = {r["id"]: r["mean"] for r in models.neighbour_stability(df, "id", list("abcd"), 5, rounds=3, block=32).collect()}
    rng = np.random.default_rng(42)
    parts = [np.arange(4), *(np.sort(rng.choice(4, 3, replace=False)) for _ in range(3))]

    def sets(at):
        u = x[:, at] / np.linalg.norm(x[:, at], axis=1, keepdims=True)
        d = np.round(1 - u @ u.T, 12)
        np.fill_diagonal(d, np.inf)
        return [set(row) for row in np.argsort(d, axis=1, kind="stable")[:, :5].tolist()]

    base, others = sets(parts[0]), [sets(p) for p in parts[1:]]
    off = [abs(got[i] - np.mean([len(base[i] & o[i]) / len(base[i] | o[i]) for o in others])) for i in range(150)]
    assert sum(o > 1e-9 for o in off) <= 3  # ties at the last place within rounding


# ---------------------------------------------------------------- stages


def test_stage_reports_on_odd_columns(spark):
    df = spark.createDataFrame([(i, "b", f"g{i % 2}", float(i), float(i * i % 7) if i else None) for i in range(12)], "id long, one string, two string, x double, y double")
    assert [r["status"] for r in stages.stage_batches({"s": df}, ["absent"], ["x", "y"]).collect()] == ["not_tested_no_valid_batch_report_columns"]
    got = {(r["metadata_column"], r["component"]): r for r in stages.stage_batches({"s": df}, ["one", "two"], ["x", "y"]).collect()}
    assert got["one", "PC1"]["status"] == "not_testable_single_group" and got["one", "PC1"]["eta_squared"] is None
    assert 0 <= got["two", "PC2"]["eta_squared"] <= 1 and got["two", "PC1"]["n_profiles"] == 12
    assert set(stages.before_after({"s": df}, "id", ["x", "y"], ["absent"], ["two"])) == {"before_after_batch_pc_association"}


def test_preprocessing_reports_every_feature_and_decision(spark):
    rng = np.random.default_rng(7)
    rows = [(f"P{i % 2}", f"c{i % 5}", i, float(a), float(2 * a + 1e-6 * b), float(b), 1.0, None if i % 2 else float(b)) for i, (a, b) in enumerate(rng.normal(size=(60, 2)))]
    names = ["Cells_Intensity_A", "Cells_Intensity_B", "Cells_Texture_C", "Cells_Texture_Constant", "Cells_Texture_Gaps"]
    df = spark.createDataFrame(rows, "Metadata_Plate string, Metadata_Compound string, Metadata_Id long, " + ", ".join(f"{n} double" for n in names))
    made = workflows.preprocess_profiles(df, workflows.Preprocessing(features=tuple(names), batch_columns=("Metadata_Plate",), batch_centering="median", id_column="Metadata_Id", replicate_columns=("Metadata_Compound",), batch_report_columns=("Metadata_Plate",)))
    got = {r["feature"]: (r["retained"], r["reason"]) for r in made.audits["feature_selection"].collect()}
    assert got["Cells_Texture_Constant"] == (False, "low_variance") and got["Cells_Texture_Gaps"] == (False, "too_missing") and got["Cells_Texture_C"] == (True, "retained")
    assert sorted([got["Cells_Intensity_A"], got["Cells_Intensity_B"]]) == [(False, "correlated"), (True, "retained")]
    eta = {(r["stage"], r["component"]): r["eta_squared"] for r in made.audits["before_after_batch_pc_association"].collect()}
    assert set(eta) == {(s, c) for s in ("before_batch_correction", "after_batch_correction") for c in ("PC1", "PC2")}
    assert made.audits["before_after_replicate_summary"].select("stage").distinct().count() == 2
    log = made.audits["decisions"].orderBy("step").collect()
    assert [r["stage"] for r in log][0] == "roles" and log[-1]["value"] == "2"


def test_classical_clusterings_and_pseudo_anchored_mechanisms(spark, blobs):
    _, df = blobs
    for how in ("kmeans", "agglomerative_average", "agglomerative_single", "dbscan"):
        found = workflows.classical(df, "id", list("abcd"), 3, 5, "euclidean", how, eps=1.5, least=4)
        kinds = {r["id"]: r["cluster"] for r in found.data.select("id", "cluster").collect()}
        assert len(kinds) == 150 and len({(i // 50, c) for i, c in kinds.items() if c >= 0}) == 3
    with pytest.raises(ValueError):
        workflows.classical(df, "id", list("abcd"), clustering="spectral")
    found = workflows.mechanisms(df, "id", list("abcd"), ks=(3, 5))
    best = {r["id"]: r["label"] for r in found.data.where("rank = 1").collect()}
    assert len({(i // 50, c) for i, c in best.items()}) == 3 and found.audits["anchor_clusters"].count() == 3


def test_hierarchy_queries_take_every_row(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    edges, merges = plain_tree(x, "cosine")
    top = list(range(len(ids)))
    for a, _, b, _ in merges[: len(ids) - 10]:
        top = [a if t == b else t for t in top]
    number = {t: n for n, t in enumerate(sorted(set(top)))}
    got = {r["vec_id"]: r["cluster"] for r in queries.queries()["agglomerative_single"](spark, SMALL).collect()}
    assert got == {ids[i]: number[t] for i, t in enumerate(top)}
    ward = Counter(r["cluster"] for r in queries.queries()["agglomerative_ward"](spark, SMALL).collect())
    assert len(ward) == 10 and sum(ward.values()) == len(ids)


def test_balanced_batches_query_covers_its_batches(spark):
    got = queries.queries()["balanced_batches"](spark, SMALL).collect()
    assert len(got) == 8 * 64 and all(v == 1 for v in Counter((r["batch"], r["slot"]) for r in got).values())
