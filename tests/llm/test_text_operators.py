"""Sharding, licences, rules, byte BPE, packing and token files against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from wellframe.llm import bpe, licences, packing, queries, rules, sharding, tokenfile  # noqa: E402
from wellframe.llm.common import scratch_path  # noqa: E402
from wellframe.llm.tokens import PieceEncoder, file_text, id_width, library_encoder, pieces  # noqa: E402

from ..compare import both  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two three"), (4, "one two three"), (5, "MIT License. mit license MIT LICENSE"), (6, "x" * 3000), (None, "the mit license"),
    (7, "café naïve ½ \U0001d4b3 'tis  double  space\nline's end \x1c\x85 　 wide"), (8, "Kelvin Apacheé license apache license"), (9, "a b c " * 500),
    (10, "GNU Lesser General Public License"), (11, "!!! ### $$$ 12345 67 8 中文字 <|endoftext|>"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash."""
    df = spark.createDataFrame([(i, t, "s", 1, 2.0) for i, t in ODD], "doc_id long, text string, source string, score int, n_words double")
    return df.toDF("doc_id", "text", "source", "TEXT", "score")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_pieces_join_to_the_text():
    for _, t in ODD:
        p = pieces(t or "")
        assert " ".join(p) == (t or "")


# ---- 1


def brute_table(shards, size):
    order = []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        start, step = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        order.append([(start + k * step) % size for k in range(size)])
    table, turn = {}, 0
    while len(table) < size:
        s = turn % len(shards)
        table[next(x for x in order[s] if x not in table)] = s
        turn += 1
    return [table[k] for k in range(size)]


def test_table_is_filled_in_turns_and_moves_little():
    names = [f"n{i}" for i in range(7)]
    table = sharding.fill_table(names, 211)
    assert table == brute_table(names, 211)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.fill_table(names[:-1], 211)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 6)
    assert moved < 0.35 * 211
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 211)
    with pytest.raises(ValueError):
        sharding.fill_table(names, 212)


def test_sharding_same_rows_as_sql(spark):
    columns, names, got, want = both(spark, "op1", queries.op1_sharding, queries.oracle_sql()["op1_sharding"], SF)
    assert columns == names and got == want


def test_sharding_odd_rows(spark, odd, empty, tmp_path):
    got = sharding.assign_shards(odd, "doc_id", ["a", "b", "c"], 101).collect()
    assert len(got) == len(ODD)
    assert len({r["shard"] for r in got if r["key"] == 4}) == 1
    assert sharding.assign_shards(empty, "doc_id", ["a"], 101).count() == 0
    n = sharding.shard_report(sharding.assign_shards(documents(spark), "doc_id", ["a", "b"], 101)).agg({"n_rows": "sum"}).first()[0]
    assert n == 200
    plain = odd.select("doc_id", "source")
    sharding.write_shards(plain, "doc_id", ["a", "b", "c"], str(tmp_path / "s"), 101)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD)


# ---- 5

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_licences(rows, templates=licences.TEMPLATES, least=0.7):
    texts = [t for _, t in rows]
    split = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    listed = {w for t in templates for w in t.words() if w not in licences.STOP}
    df = Counter(w for i in {row: i for i, row in enumerate(rows)}.values() for w in set(split[i]) & listed)
    # rows of equal id and text count once among texts with a word, each among all texts
    idf = {w: 1 + math.log((len(texts) + 1) / (df[w] + 1)) for w in listed}
    out = []
    for words in split:
        found = []
        for t in templates:
            tw, needed = t.words(), set()
            for key in map(str.split, t.keys):
                at = next(i for i in range(len(tw)) if tw[i : i + len(key)] == key)
                needed |= set(range(at, at + len(key)))
            looked = [(i, w) for i, w in enumerate(tw) if w not in licences.STOP]
            for start in range(-len(tw), len(words)) if set(words) & set(tw) else ():
                right = [(i, w) for i, w in looked if 0 <= start + i < len(words) and words[start + i] == w]
                score = sum(idf[w] for _, w in right) / sum(idf[w] for _, w in looked)
                if needed <= {i for i, _ in right} and round(min(score, 1), 9) >= least:
                    found.append((t, start, round(min(score, 1.0), 9)))
        base = [s for t, s, _ in found if t.base]
        out.append((len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted({t.label for t, _, _ in found if t.base})), ",".join(sorted({t.label for t, _, _ in found})), max((c for *_, c in found), default=0.0)))
    return out


def check_licences(df, rows):
    got = licences.scan_licences(df, "doc_id", "text").collect()
    want = brute_licences(rows)
    key = lambda r: tuple("~" if v is None else str(round(v, 6) if isinstance(v, float) else v) for v in r)
    assert sorted(key(r) for r in got) == sorted(key((i, *w)) for (i, _), w in zip(rows, want))


def test_licences_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    rows += [(900, "Permission is hereby granted, free of charge, to any person obtaining a copy of MIT license"), (901, "this general public license; mit  license\nmit-license"), (902, "licensed under the apache license version 2 0")]
    whole = {910 + i: t.text for i, t in enumerate(licences.TEMPLATES)}
    rows += [*whole.items(), (950, f"Copyright me. {licences.MIT} {licences.BSD} {licences.MIT.upper()}"), (951, licences.MIT.replace("restriction", "limits")), (952, licences.BSD.replace("notice", "note").replace("materials", "stuff"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_licences(df, rows)
    got = {r["id"]: r for r in licences.scan_licences(df, "doc_id", "text").collect()}
    for i, t in enumerate(licences.TEMPLATES):
        assert t.label in got[910 + i]["labels"].split(",")
    assert "mit-text" not in got[951]["labels"] and got[952]["labels"] == "bsd-text" and got[950]["labels"] == "bsd-text,mit-text"


def test_licence_in_a_long_text(spark):
    """A million words around one licence."""
    text = "word " * 500_000 + "under the MIT License " + "license mit " * 250_000
    (r,) = licences.scan_licences(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text").collect()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (1_000_004, 250_000, 500_002, 1_000_001)


def test_licences_odd_rows(odd, empty):
    check_licences(odd, ODD)
    assert licences.scan_licences(empty, "doc_id", "text").count() == 0


# ---- 6


def brute_counts(text):
    words = [w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def test_rules_counts_and_verdicts(spark, odd, empty):
    docs = documents(spark)
    for df, rows in ((docs, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]), (odd, ODD)):
        got = rules.apply_rules(df, "doc_id", "text", "source").collect()
        assert sorted(map(str, ((r["id"], *[r[c] for c in rules.COUNTS]) for r in got))) == sorted(str((i, *brute_counts(t))) for i, t in rows)
        for r in got:
            failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
            assert r["base_failed"] == failed and r["kept"] == (not failed and r["host_kept"])
    assert rules.apply_rules(empty, "doc_id", "text", "source").count() == 0


def test_bad_host_is_refused_and_small_hosts_are_shrunk(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, "fine") for i in range(300)] + [(1000 + i, "short", "bad") for i in range(100)] + [(2000, "short", "tiny"), (2001, good, None)]
    rows += [(3000 + 10 * h + i, good, f"h{h}") for h in range(20) for i in range(10)]
    got = rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "text", "source").collect()
    kept = {r["id"]: r for r in got}
    assert kept[0]["host_kept"] and not kept[1000]["host_kept"]
    assert kept[2000]["rate_base"] < 1 and kept[2001]["kept"]


# ---- 9


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_byte_bpe_like_the_library(spark, odd, empty, ranks):
    import base64

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    for df in (odd, documents(spark)):
        names = [c for c in df.columns if c in ("doc_id", "text")]
        texts = Counter(r[1] or "" for r in df.select(*[df[c] if df.columns.count(c) == 1 and c != "text" else df["text"] for c in names]).collect()) if df is not odd else Counter(t or "" for _, t in ODD)
        got = bpe.encode_decode(df, "doc_id", "text", ranks, public_tokenizers.PATTERN).collect()
        assert Counter(bytes(r["decoded"]).decode() for r in got) == texts
        for r in got:
            assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(bytes(r["decoded"]).decode())
            assert r["n_tokens"] == len(r["ids"]) // 4
    assert bpe.digests(empty, "doc_id", "text", ranks, public_tokenizers.PATTERN).count() == 0


def test_long_and_short_merges_agree(ranks):
    merges = bpe.ByteMerges(ranks)
    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 17, 64, 120):
        batch = [bytes(rng.choice([97, 98, 101, 116, 104, 195, 169], n).tolist()) for _ in range(20)]
        leaves = max(2, 1 << (n - 1).bit_length())
        assert [x.tolist() for x in merges.merge_short(batch, leaves)] == [merges.merge_long(b).tolist() for b in batch]


def test_long_pieces_like_the_library(spark, ranks):
    """Pieces that only ``merge_long`` takes, among them one that is repetitive and one of 2,000,000 bytes in little memory."""
    import base64
    import tracemalloc

    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines())}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    merges, rng = bpe.ByteMerges(ranks), np.random.default_rng(2)
    for n in (129, 1000, 4097, 30_000):
        for letters in (b"ab", b"etaoinshr", bytes(range(97, 123))):
            piece = bytes(rng.choice(list(letters), n).tolist())
            assert merges.merge_long(piece).tolist() == own.encode_ordinary(piece.decode())
    piece = bytes(rng.choice(list(b"etaoinshr"), 2_000_000).tolist())
    tracemalloc.start()
    ids = merges.merge_long(piece)
    assert tracemalloc.get_traced_memory()[1] < 45 * len(piece)
    tracemalloc.stop()
    assert merges.decode(ids) == piece
    df = spark.createDataFrame([(1, piece.decode()[:200_000])] * 2, "doc_id long, text string")
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(piece.decode()[:200_000]) for r in bpe.encode_decode(df, "doc_id", "text", ranks, public_tokenizers.PATTERN).collect())


# ---- 8


def check_packing(rows, texts, tokenizer, length=4096):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(tokenizer)
    want = Counter()
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), length):
            part = np.array(ids[s : s + length], "<u4")
            want[(i, s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r["id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    waste = 0
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        waste += 0 if at & (at - 1) == 0 else length - at
    return waste, len(filled)


def test_packing(spark, odd, empty):
    tokenizer = file_text(public_tokenizers.path("word_bpe_49k.json"))
    docs = documents(spark)
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    waste, n = check_packing(packing.pack(docs, "doc_id", "text", tokenizer, 2).collect(), texts, tokenizer)
    assert waste <= 0.05 * n * 4096
    check_packing(packing.pack(odd, "doc_id", "text", tokenizer, 2).collect(), ODD, tokenizer)
    assert packing.pack(empty, "doc_id", "text", tokenizer, 2).count() == 0


def test_plan_covers_the_histogram_near_the_optimum():
    rng = np.random.default_rng(0)
    sizes = np.ceil(np.minimum(rng.lognormal(3, 1, 5000), 256)).astype(int)
    histogram = dict(Counter(sizes.tolist()))
    made, total = Counter(), 0
    for uses, pattern in packing.plan(histogram, 256):
        assert sum(s * n for s, n in pattern.items()) <= 256
        total += uses
        for s, n in pattern.items():
            made[s] += uses * n
    assert dict(made) == histogram
    assert total <= 1.01 * math.ceil(sizes.sum() / 256) + 2
    assert packing.plan({}, 256) == []


# ---- 10


def test_token_files_round_trip(spark, odd, empty):
    from tokenizers import Tokenizer

    tokenizer = file_text(public_tokenizers.path("byte_bpe_50k.json"))
    t = Tokenizer.from_str(tokenizer)
    docs = documents(spark)
    for df, rows in ((docs, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]), (odd, ODD)):
        path = scratch_path(spark, "test-files")
        tokenfile.write_token_files(df, "doc_id", "text", tokenizer, path, sample=100)
        got = sorted(tokenfile.read_token_files(spark, path).collect(), key=lambda r: r["start"])
        assert [r["id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
        want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x in rows)
        assert Counter((r["id"], tuple(r["ids"])) for r in got) == want
        at = 0
        for r in got:
            assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["n_tokens"]
        one = tokenfile.read_document(spark, path, 4)
        assert sorted(x.tolist() for x in one) == sorted(r["ids"] for r in got if r["id"] == 4)
    path = scratch_path(spark, "test-files")
    tokenfile.write_token_files(empty, "doc_id", "text", tokenizer, path)
    assert tokenfile.read_token_files(spark, path).count() == 0


def random_texts(number):
    rng = np.random.default_rng(8)
    parts = ["the", "The", "été", "Straße", "ŉa", "it's", "don't", "12", "a1", "...", "!?", "\n", "\n", " ", " ", " ", " ", "  ", "\t", "\r\n", "\u00a0", "\x85", "\x1c", "漢字", "🙂", "e\u0301", "İ", "Σας", "<|endoftext|>", "<|startoftext|>", "<|", ""]
    return ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(number)]


def test_parts_of_pieces_give_the_librarys_ids():
    from tokenizers import Tokenizer

    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        definition = file_text(public_tokenizers.path(name))
        t = Tokenizer.from_str(definition)
        texts = [x or "" for _, x in ODD] + ["Été, İstanbul. ŉa\nNext's it's word.\nWord?! Å été", "a<|endoftext|> b", "<|startoftext|>"] + random_texts(4000)
        encoder = library_encoder(definition, spaced)
        for text, ids, again in zip(texts, encoder.encode(texts), encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
            assert again == ids


def test_cache_is_bounded_and_changes_nothing():
    encoder = PieceEncoder(lambda batch: [str(p).encode() + b"|" for p in batch], spaced=True, most=5)
    texts = [" ".join(f"w{(i * k) % 23}" for k in range(9)) for i in range(40)]
    want = [t.replace(" ", "| ").encode() + b"|" for t in texts]
    for k in range(0, 40, 4):
        assert encoder.encode(texts[k : k + 4]) == want[k : k + 4]
    assert len(encoder.kept.now) + len(encoder.kept.old) <= 2 * (5 + 36)


def test_long_text_is_packed_and_filed(spark):
    """Five million characters, one word of 100,000 among them."""
    from tokenizers import Tokenizer

    text = "the word of it " * 320_000 + "ab" * 50_000 + "\n"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    path = scratch_path(spark, "test-files")
    definition = file_text(public_tokenizers.path("byte_bpe_50k.json"))
    tokenfile.write_token_files(df, "doc_id", "text", definition, path)
    got = {r["id"]: r for r in tokenfile.read_token_files(spark, path).collect()}
    ids = Tokenizer.from_str(definition).encode(text, add_special_tokens=False).ids + [0]
    assert got[1]["ids"] == ids and got[2]["ids"] == [0]
    tokenizer = file_text(public_tokenizers.path("word_bpe_49k.json"))
    check_packing(packing.pack(df, "doc_id", "text", tokenizer, 2).collect(), [(1, text), (2, None)], tokenizer)


def test_ids_that_do_not_fit_are_an_error():
    ids = np.array([1, 70_000], "<u4").tobytes()
    assert np.frombuffer(tokenfile.serialized(ids, 4), "<u4").tolist() == [1, 70_000]
    with pytest.raises(ValueError):
        tokenfile.serialized(ids, 2)
    assert id_width(file_text(public_tokenizers.path("byte_bpe_50k.json"))) == 2
