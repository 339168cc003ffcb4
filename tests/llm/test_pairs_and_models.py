"""The similarity joins against brute force, the classifiers by held-out accuracy, the pipeline stage by stage."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from wellframe.llm import buckets, classify, common, components, jaccard, lattice, queries, subwords
from wellframe.llm.subwords import Model

from ..compare import both

SF = "/root/testdata/sf0.001"


def least_reachable(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    w = [x for x in (text or "").lower().replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_links(rows):
    """{id: (links, component)} of (id, text) rows with distinct ids, sorted."""
    sets, holders, pairs = [shingles(t) for _, t in rows], {}, []
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j, k in Counter(j for g in s for j in holders[g] if j < i).items():
            if 5 * k >= 4 * (len(s) + len(sets[j]) - k):
                pairs.append((j, i))
    degree, root = Counter(x for p in pairs for x in p), least_reachable(len(rows), pairs)
    return {rows[i][0]: (degree[i], rows[root[i]][0]) for i in range(len(rows))}


def near_copy_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    r = random.Random(0)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    for i in range(120):  # more than one block and than one small bucket
        words = list(base)
        for _ in range(r.randrange(1, 5)):
            words[r.randrange(150)] = f"x{r.randrange(10**6)}"
        rows.append((10_000 + i, " ".join(words)))
    return rows + [(20_001, None), (20_002, ""), (20_003, " \n "), (20_004, "one two"), (20_005, "One  two"), (20_006, "one two three")]


def test_jaccard_join_against_brute_force(spark):
    rows = sorted(near_copy_rows(spark))
    df = spark.createDataFrame([*rows, (None, "one two")], "doc_id long, text string").toDF("doc_id", "text")
    got = jaccard.near_copies(df, "doc_id", "text").collect()
    assert len(got) == len(rows) + 1
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in got if r["id"] is not None} == brute_links(rows)
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)
    lone = [r for r in got if r["id"] is None]
    assert lone[0]["n_links"] == 0 and lone[0]["kept"]


def test_jaccard_empty_repeated_and_clashing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_copies(empty, "doc_id", "text").count() == 0
    twice = spark.createDataFrame([(1, "a b c d e f", 0), (1, "a b c d e f", 0), (2, "a b c d e f", 0), (3, "z", 0)], "doc_id long, text string, key int").toDF("doc_id", "text", "TEXT")
    got = sorted((r["id"], r["n_links"], r["component_id"]) for r in jaccard.near_copies(twice, "doc_id", "text").collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_jaccard_rows_of_one_id_keep_their_own_links(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(w + "x" for w in words)
    near_a, near_b = a + " more", b + " more"
    rows = [(1, a), (1, b), (2, a), (3, b), (4, near_b), (5, near_a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in jaccard.near_copies(df, "doc_id", "text").collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 2, 1, False)]
    # a column DOC_ID, a row repeated with another value beside it, and case and white space that make no other words
    more = [(1, a, 0), (1, a, 1), (1, " " + a.upper(), 2), (2, near_a, 3), (7, "else", 4), (None, a, 5), (8, None, 6), (8, " ", 7)]
    df = spark.createDataFrame(more, "doc_id long, text string, x int").toDF("doc_id", "text", "DOC_ID")
    out = jaccard.without_near_copies(df, "doc_id", "text")
    assert out.columns == ["doc_id", "text", "DOC_ID"]
    kept = [(r[0], r[1]) for r in out.collect()]
    assert sorted(kept, key=str) == sorted([next(k for k in kept if k[0] == 1), (7, "else"), (None, a), (8, None), (8, " ")], key=str)


def test_jaccard_recall_in_crowded_buckets(spark):
    """Texts that share two thirds of their words, in groups of which two are just above the threshold."""
    r = random.Random(3)
    common = [f"c{i}" for i in range(300)]
    rows = []
    for g in range(150):
        own = [f"g{g}w{i}" for i in range(150)]
        rows.append((2 * g, " ".join(common + own)))
        for _ in range(12):  # each change takes five shingles
            own[r.randrange(150)] = f"x{r.randrange(10**9)}"
        rows.append((2 * g + 1, " ".join(common + own)))
    got = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in got} == brute_links(rows)


def test_runs_cover_the_deepest_split():
    for levels in range(7):
        n = jaccard.runs_for(0.9999, levels)
        assert (1 - 0.8 ** (levels + 1)) ** n <= 1e-4 < (1 - 0.8 ** (levels + 1)) ** (n - 1)
    assert len(set(jaccard.chosen_places(18))) == 18


def test_groups_are_compared_as_wholes_across_blocks_and_bins(spark, monkeypatch):
    monkeypatch.setattr(buckets, "BLOCK_MEMBERS", 7)
    rng = np.random.default_rng(9)
    at = np.sort(rng.uniform(0, 30, 120))
    rows = [(0, int(x), i, int(rng.integers(1, 4)), np.float64(x).tobytes(), 1) for i, x in enumerate(at)] + [(1, 0, 500, 1, np.float64(0).tobytes(), 1)]
    df = spark.createDataFrame([(c, b, k, w, bytearray(f), n) for c, b, k, w, f, n in rows], "component long, bin long, key long, weight long, full binary, size long")

    def close(full):
        v = np.frombuffer(b"".join(full), float)
        return np.abs(v[:, None] - v[None]) <= 1.0

    got = {r["node"]: r["links"] for r in buckets.compare_groups(df, close).groupBy("node").sum("links").withColumnRenamed("sum(links)", "links").collect()}
    near = np.abs(at[:, None] - at[None]) <= 1.0
    np.fill_diagonal(near, False)
    weight = np.array([r[3] for r in rows[:-1]])
    assert got == {i: int(n) for i, n in enumerate((near @ weight).tolist()) if n}


def test_similar_sets_is_exact():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**62, 400, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[: len(base) - k], rng.integers(0, 2**62, k, dtype=np.uint64)])) for k in (0, 5, 30, 44, 45, 60, 200)]
    want = [[5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)) for b in sets] for a in sets]
    got = jaccard.similar_sets([s.tobytes() for s in sets])
    np.fill_diagonal(got, True)
    assert got.tolist() == want


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(1, 60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(500, x) for x in range(501, 600)] + [(None, 3), (7, 7)]
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    proper = [(a, b) for a, b in edges if a is not None and a != b]
    ids = sorted({x for e in proper for x in e})
    at = {v: i for i, v in enumerate(ids)}
    root = least_reachable(len(ids), [(at[a], at[b]) for a, b in proper])
    assert got == {v: ids[root[i]] for i, v in enumerate(ids)}


def test_nearest_lattice_point_is_nearest():
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(1), 2)
    x = np.random.default_rng(2).normal(0, 2, (300, 8))
    point = lattice.nearest_lattice(x)
    near = ((x - point) ** 2).sum(1)
    for v in lattice.NEIGHBOURS:
        assert (((x - point - v) ** 2).sum(1) >= near - 1e-9).all()
    assert near.max() <= 1 + 1e-9  # the lattice's covering radius is 1


def test_lattice_dedup_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=64)
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("label < 4").collect()]
    rows += [(100_000 + i, (centre + rng.normal(size=64) * 0.19).tolist(), 1) for i in range(110)]
    rows += [(150_000 + i, rows[0][1], 0) for i in range(5)]
    odd = [(200_001, None, 1), (200_002, [0.0] * 64, 1), (200_003, [float("nan")] * 64, 1), (200_004, [1.0] * 63, 1), (200_005, [1.0] * 64, None), (200_006, [1e300] * 64, 2), (200_007, [1e-300] * 64, 2), (200_008, [1.0] * 63 + [None], 2)]
    df = spark.createDataFrame([*rows, *odd, (None, [1.0] * 64, 1)], "vec_id long, embedding array<double>, label int")
    got = lattice.near_vectors(df, "vec_id", "embedding", "label").collect()
    assert len(got) == len(rows) + len(odd) + 1
    able = sorted(x for x in rows + odd if x[1] and len(x[1]) == 64 and x[2] is not None and all(v is not None and np.isfinite(v) for v in x[1]) and any(x[1]))
    x = np.array([r[1] for r in able])
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in able])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = least_reachable(len(able), np.argwhere(np.triu(near)).tolist())
    want = {r[0]: (int(near[i].sum()), able[root[i]][0]) for i, r in enumerate(able)}
    want |= {r[0]: (0, r[0]) for r in odd if r[0] not in want}
    assert {r["id"]: (r["n_links"], r["component_id"]) for r in got if r["id"] is not None} == want
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert lattice.near_vectors(none, "vec_id", "embedding", "label").count() == 0


def test_lattice_rows_of_one_id_and_unequal_lengths(spark):
    rng = np.random.default_rng(3)
    a, b, c = (rng.normal(size=8).tolist() for _ in range(3))
    near = lambda v: [x * 1.01 + 0.001 for x in v]
    rows = [(1, a, 0), (1, b, 0), (2, a, 0), (3, b, 0), (4, near(b), 0), (5, near(a), 0), (6, c[:2], 0), (7, near(c[:2]), 0), (8, [1.0] * 500, 0), (9, a, 1), (10, [], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, x int").toDF("vec_id", "embedding", "label", "VEC_ID")
    got = sorted((r["id"], r["n_links"], r["component_id"]) for r in lattice.near_vectors(df, "vec_id", "embedding", "label").collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1), (5, 2, 1), (6, 1, 6), (7, 1, 6), (8, 0, 8), (9, 0, 9), (10, 0, 10)]


def test_lattice_recall_at_the_threshold(spark):
    """Pairs of cosine 0.93 to 0.95, and a chain of one label whose angles span many bins."""
    rng = np.random.default_rng(4)
    rows = []
    for g in range(400):
        x, y = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y /= np.linalg.norm(y)
        cos = rng.uniform(0.93, 0.95)
        rows += [(2 * g, x.tolist(), g % 5), (2 * g + 1, (cos * x + np.sqrt(1 - cos * cos) * y).tolist(), g % 5)]
    turn = np.zeros((600, 64))
    turn[:, 0], turn[:, 1] = np.cos(np.linspace(0, 3, 600)), np.sin(np.linspace(0, 3, 600))
    rows += [(10_000 + i, v.tolist(), 9) for i, v in enumerate(turn)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in lattice.near_vectors(df, "vec_id", "embedding", "label").collect()}
    found = sum(got[2 * g + 1][0] >= 1 for g in range(400))
    assert found >= 399
    near = turn @ turn.T >= 0.93
    np.fill_diagonal(near, False)
    assert [got[10_000 + i] for i in range(600)] == [(int(n), 10_000) for n in near.sum(1)]


# ---- classifiers


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    held = [r for r in docs if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([r["rejected"] for r in got.values()]) <= 0.01


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op7_quality_classifier(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(got[d]["held_out"] for d in held)
    assert np.mean([got[d]["predicted"] == labels[d] for d in held]) >= 0.9
    clean, poor = ([d for d in held if labels[d] == v] for v in (1, 0))
    assert np.mean([got[d]["predicted"] for d in clean]) >= 0.97
    assert np.mean([got[d]["predicted"] == 0 for d in poor]) >= 0.6
    above = np.mean([(got[a]["score"] > got[b]["score"]) + (got[a]["score"] == got[b]["score"]) / 2 for a in clean for b in poor])
    assert above >= 0.85  # area under the curve


def odd_documents(spark, empty=False):
    """documents with nulls, repeated rows and ids, empty and long texts, and columns whose names clash."""
    text = "the word of the house and the tree " * 30
    rows = [(1, text, "en", "s", 5, 0), (1, text, "en", "s", 5, 0), (2, None, None, None, None, 0), (None, text, "en", "s", 5, 0), (3, "", "en", "s", 0, 0), (3, "!!! 12", "fr", "s", 0, 0), (4, text * 500, "en", "s", 9, 0), (5, "x" * 400_000, "de", "s", 9, 0)]
    return spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long, x int").toDF("doc_id", "text", "lang", "source", "n_chars", "TEXT")


def folder_of(spark, tmp_path, empty=False):
    common.pick(odd_documents(spark, empty), **{c: c for c in corpus_pipeline.COLUMNS}).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 0), (1, 0, 0), (3, 0, 0), (4, 1, 0), (5, 0, 0), (None, 1, 0), (2, None, 0)]
    spark.createDataFrame([] if empty else labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("empty", [False, True])
def test_classifier_queries_and_stages_on_odd_rows(spark, tmp_path, empty):
    sf, docs = folder_of(spark, tmp_path, empty), odd_documents(spark, empty)
    n = docs.count()
    two, seven = queries.op2_language_id(spark, sf).collect(), queries.op7_quality_classifier(spark, sf).collect()
    assert len(two) == len(seven) == n
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (2,) or (r["doc_id"] == 3)) for r in two)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in seven)
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        assert len(set(out.columns)) == len(out.columns)
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        if name == "n-gram Jaccard join" and not empty:
            rows = corpus_pipeline.drop_near_copies(spark, docs, sf).collect()
            # ids 1 and 4 have the same shingles; null ids and texts without words are copies of nothing
            assert sorted((r["doc_id"] for r in rows), key=str) == sorted([1, 2, 3, 3, 5, None], key=str)
        assert out.count() >= 0


def test_foreign_texts_are_rejected(spark):
    """Letters of held-out texts in another order are no text of a learned language; averaged n-grams tell a third of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = classify.language_model(queries.labelled_language(docs))
    held = [r["text"] for r in docs.where(classify.fold_of(docs["doc_id"], 4) == 2).select("text").collect() if r["text"] and len(r["text"]) > 200][:150]
    mixed = subwords.shuffled_letters(held, np.random.default_rng(1))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(held + mixed)], "doc_id long, text string")
    got = {r["doc_id"]: r["rejected"] for r in classify.identify_language(df, model, "text", doc_id="doc_id").collect()}
    assert np.mean([got[i] for i in range(len(held))]) <= 0.01
    assert np.mean([got[len(held) + i] for i in range(len(mixed))]) >= 0.25


def test_models_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "en"), (2, "", None), (3, "123 !!", "en"), (4, "the of and", "en"), (5, "le la les", "fr"), (None, "le de la", "fr")], "doc_id long, text string, lang string")
    model = classify.language_model(df.selectExpr("text", "lang AS label"))
    got = {r["doc_id"]: r for r in classify.identify_language(df, model, "text", doc_id="doc_id").collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and all(got[k]["rejected"] for k in (1, 2, 3))
    assert got[4]["lang_pred"] in ("en", "fr") and len(got) == 6
    empty = df.where("doc_id > 100")
    assert classify.identify_language(empty, classify.language_model(empty.selectExpr("text", "lang AS label")), "text", doc_id="doc_id").count() == 0
    quality = classify.quality_model(empty.selectExpr("text", "1 AS label"))
    assert [r["score"] for r in classify.score_quality(df, quality, "text", doc_id="doc_id").collect()] == [0.5] * 6


def test_mean_of_table_rows_is_the_embedding_score():
    f = subwords.Features(bits=10, longest=3)
    model = subwords.Model(f, ["a", "b"], np.random.default_rng(0).normal(size=(1024, 2)).astype(np.float32), np.array([0.1, -0.1]))
    texts = ["", "one two", "un  deux\ntrois", "x"]
    bags = subwords.bags(f, texts)
    want = [b[1] @ model.table[b[0]] + model.bias for b in bags]
    assert np.allclose(model.scores(texts), want, atol=1e-5)
    assert np.allclose(model.scores(texts[::-1])[::-1], want, atol=1e-5)


def test_features_are_words_and_their_ngrams():
    f = subwords.Features(bits=20, longest=4)
    n = lambda text: sum(map(len, f.hashed([text])[0]))
    # " ab ": a, b / _a, ab, b_ / _ab, ab_ / _ab_ / the word
    assert n("ab") == 2 + 3 + 2 + 1 + 1 and n("ab cd") == 2 * n("ab") and n("") == 0
    assert {x for k in f.hashed(["ab  cd"])[0] for x in k} == {x for t in ("ab", "cd") for k in f.hashed([t])[0] for x in k}


# ---- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "n-gram Jaccard join", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF).persist()
        assert out.columns == docs.columns
        before, after = {r["doc_id"] for r in now.collect()}, {r["doc_id"] for r in out.collect()}
        assert after <= before and len(after) == out.count()
        gone = before - after
        if name == "quality classifier":
            known = [labels[d] for d in before if labels.get(d) is not None]
            assert np.mean([labels[d] == 0 for d in gone if d in labels] or [1]) > 0.8
            assert sum(known) and np.mean([d in after for d in before if labels.get(d) == 1]) >= 0.97
        if name == "n-gram Jaccard join":
            want = brute_links(sorted((r["doc_id"], r["text"]) for r in now.collect()))
            assert after == {d for d, (_, c) in want.items() if d == c}
        now = out
    packed = corpus_pipeline.pack_sequences(spark, now, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in now.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    columns, names, got, want = both(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF)
    assert columns == names
    assert got == want


# ---- samples and long texts


def test_sample_of_few_texts_repeated_often_and_of_a_rare_label(spark):
    """100,000 rows of 40 texts, and a language with 30 rows of its own."""
    common = [(f"text number {i} of " + ("the and of" if i % 2 else "le la les") + f" word{i}", "en" if i % 2 else "fr") for i in range(40)]
    rows = spark.range(100_000).selectExpr("cast(id % 40 as int) AS i").join(spark.createDataFrame([(i, *r) for i, r in enumerate(common)], "i int, text string, label string"), "i").select("text", "label")
    rare = spark.createDataFrame([(f"der die das {i} und", "de") for i in range(30)], "text string, label string")
    texts, labels = classify.training_sample(rows.union(rare), 3000)
    assert len(texts) == 70 and set(zip(texts, labels)) >= set(common)
    many = spark.range(60_000).selectExpr("concat('some text ', id) AS text", "if(id % 3 = 0, 'a', 'b') AS label")
    texts, labels = classify.training_sample(many.union(rare), 3000)
    assert 2500 < len(texts) < 3700 and labels.count("de") == 30 and abs(labels.count("a") / len(texts) - 1 / 3) < 0.05
    assert classify.training_sample(many.limit(0), 3000) == ([], [])
    model = classify.language_model(rows)
    assert model.classes == ["en", "fr"]


def test_conflicting_and_equal_labels_give_the_first_class_and_one_half(spark):
    twice = spark.createDataFrame([("same text here", v) for v in (0, 1)] * 30, "text string, label int")
    model = classify.quality_model(twice)
    assert np.allclose(model.probabilities(["same text here", ""]), 0.5, atol=0.2)
    blank = Model(classify.LANGUAGE_FEATURES, ["aa", "bb"], np.zeros((1 << 16, 2), np.float32), np.zeros(2))
    found = classify.identify_language(spark.createDataFrame([(1, "words")], "doc_id long, text string"), blank, "text", doc_id="doc_id").first()
    assert (found["lang_pred"], found["score"]) == ("aa", 0.5)


def test_long_texts_go_by_slices(monkeypatch):
    rng = np.random.default_rng(5)
    table = rng.normal(size=(1 << 16, 2)).astype(np.float32)
    words = ["".join(rng.choice(list("abcdeÄé "), 7)) for _ in range(400)]
    texts = [" ".join(words), "x" * 900 + " \t" + "yz" * 700, "", " a ", "long" * 500, "one " + "w" * 2000, "w" * 2000 + " one", None and ""]
    texts = [t or "" for t in texts]
    for features in (classify.QUALITY_FEATURES, classify.LANGUAGE_FEATURES):
        model = Model(features, [0, 1], table, np.zeros(2))
        want = model.scores(texts)
        with monkeypatch.context() as m:
            m.setattr(subwords, "SLICE", 100)
            assert max(map(len, subwords.slices(texts[0]))) <= 200
            assert np.allclose(model.scores(texts), want, atol=1e-5)
