"""Queries work on whole tables, with the results of plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellframe.operators import diagnostics, distance, graph, models, moa, repeats
from wellframe.plans import queries, queries_analysis

RUN = queries.queries()
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    t = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in t]), np.array([str(r["label"]) for r in t]), np.array([list(r["embedding"]) for r in t], float)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def plain_dbscan(ids, d, eps, least):
    near = (d <= eps) & ~np.eye(len(ids), dtype=bool)
    core, label = near.sum(1) + 1 >= least, np.full(len(ids), -1)
    for s in np.argsort(ids):
        if core[s] and label[s] < 0:
            todo, label[s] = [s], ids[s]
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = ids[s]
                    todo.append(j)
    for i in np.flatnonzero(~core):
        label[i] = min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1)
    return dict(zip(ids.tolist(), label.tolist()))


def test_dbscan_query_takes_every_row(spark, rows):
    ids, _, x = rows
    got = {r["id"]: r["cluster"] for r in RUN["dbscan"](spark, SMALL).collect()}
    assert got == plain_dbscan(ids, 1 - unit(x) @ unit(x).T, 0.75, 4)


@pytest.mark.parametrize("eps", [0.25, 0.4])
def test_dbscan_across_blocks(spark, eps):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.cumsum(rng.uniform(0.05, 0.3, 700)), rng.uniform(0, 200, 700)])[:, None] * [1.0, 0.0]
    ids = rng.permutation(len(x)) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id bigint, v array<double>")
    got = {r["id"]: r["cluster"] for r in models.dbscan(df, "id", "v", eps, 4).collect()}
    assert got == plain_dbscan(ids, np.abs(x[:, :1] - x[:, 0]), eps, 4)


def plain_leave_one_out(ids, y, x):
    out = {}
    for i in range(len(ids)):
        rest = np.arange(len(ids)) != i
        d = {}
        for k in sorted(set(y)):
            mine = x[rest & (y == k)]
            if len(mine) >= 2:
                d[k] = 1 - unit(np.median(mine, 0)) @ unit(x[i])
        out[int(ids[i])] = min(d, key=lambda k: (round(d[k], 12), k))
    return out


def test_leave_one_out_query_takes_every_row(spark, rows):
    got = {r["id"]: r["predicted"] for r in RUN["loo_centroid_all"](spark, SMALL).collect()}
    assert got == plain_leave_one_out(*rows)


def test_leave_one_out_with_ties_and_small_classes(spark):
    rng = np.random.default_rng(6)
    y = np.array(list("aaabbbbcccccdde") + ["f"] * 8)
    x = rng.integers(1, 4, (len(y), 5)).astype(float)
    df = spark.createDataFrame([(i, c, v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "id int, y string, v array<double>")
    got = {r["id"]: r["predicted"] for r in moa.leave_one_out(df, "id", "v", "y").collect()}
    assert got == plain_leave_one_out(np.arange(len(y)), y, x)
    classes = {f"{n}_{r}": rng.integers(0, 3, n).astype(float) for n in (3, 4, 5, 6) for r in range(5)}
    one = spark.createDataFrame([(c, [float(z)]) for c, v in classes.items() for z in v], "y string, v array<double>")
    found = one.join(moa.middle_values(one, "y", "v"), "y").select("y", F.col("v")[0].alias("x"), moa._median_without(F.col("middle")[0], F.col("v")[0]).alias("m"))
    want = sorted((c, float(z), float(np.median(np.delete(v, i)))) for c, v in classes.items() for i, z in enumerate(v))
    assert sorted(map(tuple, found.collect())) == want


def test_consensus_pairs_query_takes_every_row(spark, rows):
    ids = rows[0]
    got = RUN["consensus_pairs"](spark, SMALL)
    marks = spark.createDataFrame([(int(i),) for i in ids], "i bigint").select("i", F.xxhash64(F.col("i").cast("string")).alias("h")).collect()
    taken = np.stack([repeats.share_weight(42, 0.8)(np.array([m["h"] for m in marks]), r) for r in range(1, 51)])
    want = int(np.triu(taken.T @ taken > 0, 1).sum())
    assert got.count() == want
    assert got.where("id_a >= id_b OR co_cluster > co_observed OR consensus <> co_cluster / co_observed").isEmpty()


def ranks_of(v):
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


@pytest.mark.parametrize("method", ["spearman", "pearson"])
def test_replicate_pairs_of_small_and_large_groups_with_gaps(spark, method):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(700):
        v = [None if rng.random() < 0.02 else float(x) for x in rng.integers(0, 6, 6)]
        rows.append((i * 7 % 701, None if i % 11 == 0 else ("hot" if i % 2 else f"g{i % 7}"), *([3.0] * 6 if i % 97 == 0 else v)))
    df = spark.createDataFrame(rows, "id long, g string, a double, b double, c double, d double, e double, f double")
    got = {(r["id_a"], r["id_b"]): r for r in diagnostics.replicate_pairs(df, "id", ["g"], list("abcdef"), method).collect()}
    rows.sort(key=lambda r: r[0])
    n = 0
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[1] != b[1]:
                continue
            n += 1
            two = np.array([(x, y) for x, y in zip(a[2:], b[2:]) if x is not None and y is not None], float).reshape(-1, 2)
            x, y = (ranks_of(two[:, 0]), ranks_of(two[:, 1])) if method == "spearman" else two.T
            r = got[a[0], b[0]]
            assert r["g"] == a[1]
            if len(x) < 2 or x.std() == 0 or y.std() == 0:
                assert r["correlation"] is None
            else:
                assert abs(r["correlation"] - np.corrcoef(x, y)[0, 1]) < 1e-9
    assert len(got) == n


def test_components_of_long_chains_and_stars(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [tuple(map(int, rng.integers(2000, 2100, 2))) for _ in range(80)] + [(None, 1), (5, 5)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(parent)}


def test_nearest_gives_ties_to_the_smaller_id(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (900, 2)).astype(float) + 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    got = {}
    for r in distance.nearest(df, "id", "v", 7, "euclidean", block=128).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["neighbour_id"]
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 12)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1, kind="stable")[:, :7]
    assert got == {i: {k + 1: int(j) for k, j in enumerate(w)} for i, w in enumerate(want)}


def test_pca_query_is_the_singular_value_decomposition(spark, rows):
    ids, _, x = rows
    c = x - x.mean(0)
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    got = {r["vec_id"]: r for r in RUN["pca_scores"](spark, SMALL).collect()}
    for k, name in enumerate(("PC1", "PC2")):
        want = c @ vt[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert np.allclose([got[i][name] for i in ids.tolist()], want, atol=1e-6)


def test_kmeans_query_takes_every_row(spark, rows):
    ids, _, x = rows
    got = {r["vec_id"]: r["cluster"] for r in RUN["kmeans"](spark, SMALL).collect()}
    label = np.array([got[int(i)] for i in ids])
    assert len(got) == len(ids) and set(label) == set(range(5))
    centres = np.stack([x[label == k].mean(0) for k in range(5)])
    near = ((x[:, None] - centres[None]) ** 2).sum(2)
    inertia, total = near[np.arange(len(x)), label].sum(), ((x - x.mean(0)) ** 2).sum()
    # nearly all rows are at their nearest centre, and the clusters explain something
    assert (near.argmin(1) == label).mean() > 0.97 and inertia < 0.97 * total



@pytest.mark.parametrize("metric", ["cosine", "euclidean", "correlation", "cityblock"])
def test_pairwise_of_the_whole_table(spark, rows, metric):
    n = len(rows[0])
    assert RUN[f"pairwise_{metric}_all"](spark, SMALL).count() == n * (n - 1) // 2


def plain_tops(x, ids, y):
    """Best cosine of each row by permutation, the labels themselves first."""
    names, codes = np.unique(y, return_inverse=True)
    ends, k = np.cumsum(np.bincount(codes)), np.argsort(np.argsort(ids))
    out = []
    for p in range(101):
        c = np.searchsorted(ends, moa.dealt(k, len(ids), 0, p), "right") if p else codes
        out.append((x @ unit(np.stack([np.median(x[c == j], 0) for j in range(len(names))])).T).max(1))
    return np.array(out)


@pytest.mark.parametrize("part", [None, 90])
def test_anchor_permutation_scores_every_row_against_100_permutations(spark, rows, part):
    ids, y, x = rows
    tops = plain_tops(unit(x), ids, y)
    if part:
        got = moa.anchor_permutation(queries_analysis.vectors(spark, SMALL), "vec_id", "embedding", "label", part=part).collect()
    else:
        got = RUN["anchor_permutation"](spark, SMALL).collect()
    got = {r["id"]: r for r in got}
    assert sorted(got) == ids.tolist() and {r["n_permutations"] for r in got.values()} == {100}
    for i, t in zip(ids.tolist(), tops.T):
        assert abs(got[i]["observed_top_score"] - t[0]) < 1e-5
        assert got[i]["null_exceedances"] == (t[1:] >= t[0]).sum()
        assert abs(got[i]["empirical_p_value"] - (1 + (t[1:] >= t[0]).sum()) / 101) < 1e-5


def test_dealt_is_a_permutation():
    for n in (1, 2, 3, 17, 1000):
        for p in range(1, 4):
            assert sorted(moa.dealt(np.arange(n), n, 0, p).tolist()) == list(range(n))


def test_models_see_all_components_and_a_forest_of_five_folds(spark, monkeypatch):
    df, names = queries_analysis._flat(spark, SMALL)
    assert len(names) == 64 and set(names) < set(df.columns)
    asked = []
    monkeypatch.setattr(models, "cross_validate", lambda d, i, features, label, name="random_forest", folds=5: asked.append((d.count(), features, name, folds)) or (None, d))
    RUN["rf_cv"](spark, SMALL)
    assert asked == [(500, names, "random_forest", 5)]
