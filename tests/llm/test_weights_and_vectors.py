"""Resampling, whitening and neighbours against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from wellframe.llm import hnsw, oracle, queries, resample, whiten  # noqa: E402

from ..compare import both  # noqa: E402

SF = "/root/testdata/sf0.001"
TEXTS = [(1, None), (2, ""), (3, "  ...  "), (4, "One two THREE " * 8), (4, "One two THREE " * 8), (5, "émile Éa 中文 x1 " * 30), (None, "alpha beta " * 15), (6, "z" * 70 + " word " * 40), (7, "two one " * 12)]


# ---- 11


def plain_resampling(docs, target, buckets=resample.BUCKETS, longest=1, least=20, percent=10, seed=2024):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        words = word.findall((text or "").translate(low))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in found:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    rows = []
    for i, n, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(map(gain, f))
        rows.append([i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("longest,percent,least", [(1, 50, 20), (3, 100, 0)])
def test_resampling_against_brute_force(spark, monkeypatch, longest, percent, least):
    monkeypatch.setattr(resample, "SLICE", 16)
    docs = spark.createDataFrame([(i, t, 0, 0.5) for i, t in TEXTS], "doc_id long, text string, rank int, weight double").toDF("doc_id", "text", "TEXT", "weight")
    target = ["one two three", "word alpha", None]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, "doc_id", "text", wanted, "text", longest=longest, percent=percent, least_words=least)
    assert got.columns == ["id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_resampling(TEXTS, target, longest=longest, percent=percent, least=least)


def test_resampling_same_rows_as_sql(spark):
    columns, names, got, want = both(spark, "op11", queries.op11_resampling, oracle.resampling_sql())
    assert columns == names and got == want


def test_matrix_is_cut_into_blocks(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(resample, "BLOCK_ENTRIES", 500)
    blocks = resample.count_matrix(docs, "doc_id", "text").collect()
    assert len(blocks) > 20 and sorted(i for b in blocks for i in b["ids"]) == sorted(r[0] for r in docs.select("doc_id").collect())
    for b in blocks:
        starts = np.frombuffer(b["starts"], "<i8")
        assert len(starts) == len(b["ids"]) + 1 == len(b["words"]) + 1
        assert starts[-1] == len(b["columns"]) // 4 == len(b["counts"]) // 4


def test_resampling_long_text_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "w" * 3_000_000 + " tail" * 400_000)], "doc_id long, text string")
    row = resample.resample(docs, "doc_id", "text", docs, "text", percent=100).first()
    assert (row["n_words"], row["n_features"], row["weight"], row["rank"]) == (400_001, 400_001, 0, 1)
    none = docs.limit(0)
    assert resample.resample(none, "doc_id", "text", docs, "text").collect() == []
    assert resample.resample(docs, "doc_id", "text", none, "text").count() == 1


# ---- 12


def plain_whitening(vectors, k):
    c = np.array(vectors, np.float64)
    x = np.floor(64 * c).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    d = n * x.astype(object) - s.astype(object)
    centred = (d / n).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return x, (d**2).sum(1), centred @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def test_whitening_against_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whiten, "FAN_IN", 2)
    monkeypatch.setattr(whiten, "ROWS", 40)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    df = spark.createDataFrame([(r["vec_id"], r["embedding"], 1, 2) for r in rows], "vec_id long, embedding array<float>, n int, id int").toDF("vec_id", "embedding", "n", "Embedding").repartition(5)
    got = sorted(whiten.whiten(df, "vec_id", "embedding").collect(), key=lambda r: (r["id"], r["component"]))
    rows.sort(key=lambda r: r["vec_id"])
    _, deviation, white, share = plain_whitening([r["embedding"] for r in rows], 32)
    assert [r["id"] for r in got] == [r["vec_id"] for r in rows for _ in range(32)]
    assert [int(r["deviation"]) for r in got[::32]] == deviation.tolist() and {r["n"] for r in got} == {len(rows)}
    w = np.array([r["whitened"] for r in got]).reshape(-1, 32)
    assert np.allclose(np.abs((w * white).sum(0)) / len(w), 1, atol=1e-6)  # the same up to signs
    assert np.allclose(np.abs(w.T @ w / len(w) - np.eye(32)).max(), got[0]["identity_error"], atol=1e-12) and got[0]["identity_error"] < 1e-9
    assert np.allclose([r["explained"] for r in got[:32]], share, rtol=1e-9)


def test_whitening_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 2.0]), (5, [inf, 0.0, 0.0]), (6, [1.0, 2.0]), (7, [0.0, 1.0, 5.0]), (7, [0.0, 1.0, 5.0]), (None, [2.0, 1.0, 3.0]), (9, [-4.0, 1.0, 1.0]), (10, [1e30, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = whiten.whiten(df, "vec_id", "v").collect()
    assert sorted((r["id"] for r in got if r["component"] == 1), key=str) == [7, 7, 9, None]
    assert len(got) == 12 and all(r["n"] == 4 for r in got)
    third = [r for r in got if r["component"] == 3]  # the second entry never varies
    assert all(r["whitened"] == 0 and r["explained"] < 1e-30 for r in third)
    assert max(r["identity_error"] for r in got) < 1e-9
    assert whiten.whiten(df.limit(0), "vec_id", "v").collect() == []
    alone = whiten.whiten(df.where("vec_id = 9"), "vec_id", "v").collect()
    assert [(r["n"], int(r["deviation"]), r["whitened"]) for r in alone] == [(1, 0, 0.0)] * 3


def test_whitening_of_huge_entries_is_exact(spark):
    rows = [(1, [3e15, 1.0]), (2, [-2e15, 7.5]), (3, [1e15, -3.25])]
    got = {r["id"]: int(r["deviation"]) for r in whiten.whiten(spark.createDataFrame(rows, "vec_id long, v array<double>"), "vec_id", "v").collect()}
    assert got == dict(zip([1, 2, 3], plain_whitening([v for _, v in rows], 2)[1].tolist()))


# ---- 13


def plain_nearest(rows, asked, k):
    """query: [(id, cosine)] of the k nearest other ids, each by its best vector."""
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    out = {}
    for q, v in asked:
        best = {}
        for i, w in rows:
            if i != q and len(v) == len(w):
                best[i] = max(best.get(i, -2), float(unit(v) @ unit(w)))
        out.setdefault(q, []).extend(best.items())
    return {q: sorted(((i, s) for i, s in dict(sorted(b, key=lambda t: t[1])).items()), key=lambda t: (-round(t[1], 12), t[0]))[:k] for q, b in out.items()}


def recall(got, want):
    return sum(len({i for i, _ in want[q]} & {i for i, _ in got.get(q, [])}) for q in want) / sum(map(len, want.values()))


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["id"] if "id" in df.columns else r["vec_id"], r["score"]))
    return out


def test_nearest_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = by_query(queries.op13_nearest(spark, sf))
    want = plain_nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert recall(got, want) >= 0.97
    vector = dict(rows)
    for q, near in got.items():
        assert near == sorted(near, key=lambda t: (-t[1], t[0])) and q not in dict(near)
        for i, s in near:
            a, b = np.array(vector[q], float), np.array(vector[i], float)
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_nearest_with_copies_and_near_copies(spark, monkeypatch):
    """A third are copies of one vector, a third lie very close together; several shards and stored rows."""
    monkeypatch.setattr(hnsw, "STORED", 100)
    monkeypatch.setattr(hnsw, "SPREAD", 10)
    rng = np.random.default_rng(3)
    centre, copy = rng.normal(size=24), rng.normal(size=24)
    rows = [(i, (copy if i % 3 == 0 else centre + 0.01 * rng.normal(size=24) if i % 3 == 1 else rng.normal(size=24)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").repartition(7)
    asked = [r for r in rows if r[0] % 25 == 0]
    got, want = by_query(hnsw.nearest_neighbours(df, df.where("vec_id % 25 = 0"), "vec_id", "v", 5)), plain_nearest(rows, asked, 5)
    assert recall(got, want) >= 0.97
    for q in (q for q, _ in asked if q % 3 == 0):  # the copies of smallest id, exactly
        assert [i for i, _ in got[q]] == [i for i in (0, 3, 6, 9, 12, 15) if i != q][:5]


def test_nearest_odd_rows(spark):
    inf = float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]), (7, [inf, 1.0]), (None, [1.0, 0.0]), (8, []), (9, [1.0, 0.0, 0.0]), (10, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, v array<double>, id int, s string").toDF("vec_id", "v", "id", "V")
    got = by_query(hnsw.nearest_neighbours(df, df, "vec_id", "v", 2))
    near = {q: [i for i, _ in v] for q, v in got.items()}
    assert near == {1: [2, 3], 2: [1, 3], 3: [10, 1], 10: [3, 1]}
    assert abs(got[2][0][1] - 1) < 1e-12
    assert hnsw.nearest_neighbours(df.limit(0), df, "vec_id", "v").collect() == [] == hnsw.nearest_neighbours(df, df.limit(0), "vec_id", "v").collect()


def test_graph_links_are_other_nodes_and_layers_nest():
    x = hnsw.unit_rows(np.random.default_rng(1).normal(size=(900, 16))).astype(np.float32)
    graph = hnsw.build_graph(x)
    assert [len(g) for g in graph] == hnsw.layer_sizes(900) == [900, 57]
    for g in graph:
        for i, row in enumerate(g):
            known = row[row >= 0]
            assert len(known) and len(set(known)) == len(known) and i not in known and known.max() < len(g)
    assert hnsw.enough_width(x, graph, 5) <= 2 * hnsw.WIDTH
