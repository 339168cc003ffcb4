"""Byte-level BPE encoding by a segment tree over byte positions, and decoding.

Each leaf of the tree stands for a byte position and holds the rank of the pair
that starts there, with the position; each inner node holds the least of its two
children, so the root is the leftmost pair of minimum rank. A merge changes three
leaves (the pair itself, its left neighbour's, the swallowed one's) and the paths
above them. Short pieces are merged many at a time, one tree a row, in numpy; long
ones one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, pick, text_blocks
from .tokens import TEXT_BLOCK, PieceEncoder

NONE = np.iinfo(np.int64).max
#: The rank of a pair that makes no token, in 32 bits.
UNRANKED = (1 << 31) - 1
#: Leaves up to which pieces are merged many at a time.
SHORT = 128
#: Pieces in one group of trees.
TOGETHER = 4096


def read_ranks(path: str) -> bytes:
    """The vocabulary file: a line for each token, base64 of its bytes and its rank."""
    with open(path, "rb") as f:
        return f.read()


class ByteMerges:
    """The ranks of a vocabulary, as a lookup of pairs of ids."""

    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.span = max(self.tokens) + 1
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * self.span + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 where the pair makes no token."""
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """Ids of one piece of any length: 25 bytes of memory a byte of it.

        The tree's inner nodes hold the leaf of the least rank below them, the left one
        of those that tie; leaves hold the ranks. All are 32-bit arrays, written through
        memory views. An update ends where neither a node's leaf nor its rank has changed.
        """
        n = len(piece)
        leaves = 1 << max(1, (n - 1).bit_length())
        id_array = self.of_byte[np.frombuffer(piece, np.uint8)].astype(np.int32)
        rank_array = np.full(leaves, UNRANKED, np.int32)
        for at in range(0, n - 1, 1 << 20):
            end = min(n - 1, at + (1 << 20))
            found = self.lookup(id_array[at:end].astype(np.int64), id_array[at + 1 : end + 1].astype(np.int64))
            rank_array[at:end] = np.where(found >= 0, found, UNRANKED)
        tree_array = np.zeros(leaves, np.int32)
        below = np.arange(leaves, dtype=np.int32)
        width = leaves // 2
        while width:
            left, right = below[::2], below[1::2]
            below = np.where(rank_array[left] <= rank_array[right], left, right)
            tree_array[width : 2 * width] = below
            width //= 2
        after_array, before_array = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        ids, rank, tree, after, before = map(memoryview, (id_array, rank_array, tree_array, after_array, before_array))
        pairs, span = self.pairs, self.span

        def put(leaf: int, value: int) -> None:
            if rank[leaf] == value:
                return
            rank[leaf] = value
            k = (leaf + leaves) >> 1
            a = leaf & ~1
            best = a if rank[a] <= rank[a + 1] else a + 1
            while True:
                if tree[k] == best and best != leaf:
                    return
                tree[k] = best
                if k == 1:
                    return
                other = tree[k ^ 1]
                if k & 1:
                    best = other if rank[other] <= rank[best] else best
                else:
                    best = best if rank[best] <= rank[other] else other
                k >>= 1

        def pair(i: int) -> int:
            j = after[i]
            return pairs.get(ids[i] * span + ids[j], UNRANKED) if j < n else UNRANKED

        while rank[i := tree[1]] != UNRANKED:
            j = after[i]
            ids[i] = rank[i]
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            ids[j] = -1
            put(j, UNRANKED)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return id_array[id_array >= 0]

    def merge_short(self, batch: list[bytes], leaves: int) -> list[np.ndarray]:
        """Ids of pieces of at most ``leaves`` bytes (a power of two); a tree a row."""
        count = len(batch)
        length = np.array([len(b) for b in batch])
        raw = np.frombuffer(b"".join(b.ljust(leaves, b"\0") for b in batch), np.uint8).reshape(count, leaves)
        at = np.arange(leaves)
        live = at < length[:, None]
        ids = np.where(live, self.of_byte[raw], -1)
        after = np.broadcast_to(at + 1, (count, leaves)).copy()
        before = np.broadcast_to(at - 1, (count, leaves)).copy()
        shift = max(1, (leaves - 1).bit_length())
        tree = np.full((count, 2 * leaves), NONE)
        row, col = np.nonzero(at < length[:, None] - 1)
        rank = self.lookup(ids[row, col], ids[row, col + 1])
        tree[row, leaves + col] = np.where(rank >= 0, rank << shift | col, NONE)
        width = leaves
        while width > 1:
            width //= 2
            tree[:, width : 2 * width] = np.minimum(tree[:, 2 * width : 4 * width : 2], tree[:, 2 * width + 1 : 4 * width : 2])

        def put(rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            k = leaf + leaves
            tree[rows, k] = value
            while k[0] > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        def pair(rows: np.ndarray, i: np.ndarray) -> np.ndarray:
            j = after[rows, i]
            inside = j < length[rows]
            r = self.lookup(ids[rows, i], np.where(inside, ids[rows, np.minimum(j, leaves - 1)], -1))
            return np.where(inside & (r >= 0), r << shift | i, NONE)

        rows = np.flatnonzero(tree[:, 1] != NONE)
        while len(rows):
            top = tree[rows, 1]
            i = top & ((1 << shift) - 1)
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = top >> shift
            live[rows, j] = False
            after[rows, i] = k
            inside = k < length[rows]
            before[rows[inside], k[inside]] = i[inside]
            put(rows, j, np.full(len(rows), NONE))
            put(rows, i, pair(rows, i))
            h = before[rows, i]
            some = h >= 0
            if some.any():
                put(rows[some], h[some], pair(rows[some], h[some]))
            rows = rows[tree[rows, 1] != NONE]
        flat, ends = ids[live], np.cumsum(live.sum(1))
        return np.split(flat, ends[:-1]) if count else []

    def encode_pieces(self, batch: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct pieces, as little-endian unsigned 32-bit integers."""
        out: dict[bytes, bytes] = {}
        by_size: dict[int, list[bytes]] = {}
        for piece in batch:
            whole = self.ranks.get(piece)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            else:
                by_size.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(piece)
        for leaves, group in by_size.items():
            if leaves > SHORT:
                out.update((p, self.merge_long(p).astype("<u4").tobytes()) for p in group)
                continue
            for k in range(0, len(group), TOGETHER):
                part = group[k : k + TOGETHER]
                out.update((p, ids.astype("<u4").tobytes()) for p, ids in zip(part, self.merge_short(part, leaves)))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_CODECS: dict[int, tuple[ByteMerges, PieceEncoder]] = {}


def codec(ranks: bytes, pattern: str) -> tuple[ByteMerges, PieceEncoder]:
    """One codec for each Python worker and vocabulary."""
    key = hash((ranks, pattern))
    if key not in _CODECS:
        merges, matcher = ByteMerges(ranks), regex.compile(pattern)

        def encode_texts(batch: list[str]) -> Iterable[bytes]:
            split = [[m.encode() for m in matcher.findall(t)] for t in batch]
            ids = merges.encode_pieces(dict.fromkeys(p for s in split for p in s))
            return [b"".join(map(ids.__getitem__, s)) for s in split]

        _CODECS[key] = (merges, PieceEncoder(encode_texts, spaced=True))
    return _CODECS[key]


def encode_decode(df: DataFrame, id_col: str, text_col: str, ranks: bytes, pattern: str) -> DataFrame:
    """Token ids of each text and the bytes that the ids stand for.

    Returns id, ids (binary: little-endian unsigned 32-bit integers), n_tokens and
    decoded (binary) for each row; rows keep their places, nothing is shuffled.
    Null and empty texts have no ids. Rows that repeat have the same result each, an
    empty table gives no rows, and only the two named columns are read, so others do no
    harm whatever their names. Memory follows the batch and the longest text.
    """
    rows = pick(df, id=id_col, text=text_col)
    schema = rows.select("id").schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "binary")

    def run(batch: pa.RecordBatch) -> dict:
        merges, encoder = codec(ranks, pattern)
        ids, decoded = [], []
        for _, block in text_blocks(batch.column(1), TEXT_BLOCK):
            for coded in encoder.encode(block):
                ids.append(coded)
                decoded.append(merges.decode(np.frombuffer(coded, "<u4")))
        return {"id": batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids, "decoded": decoded}

    return map_arrow(rows, run, schema)


def digests(df: DataFrame, id_col: str, text_col: str, ranks: bytes, pattern: str) -> DataFrame:
    """``encode_decode`` with sha256 digests, taken in the same task, in place of ids and bytes; odd rows as there."""
    rows = pick(df, id=id_col, text=text_col)
    schema = rows.select("id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batch: pa.RecordBatch) -> dict:
        merges, encoder = codec(ranks, pattern)
        out: dict = {"id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for _, block in text_blocks(batch.column(1), TEXT_BLOCK):
            for coded in encoder.encode(block):
                out["n_tokens"].append(len(coded) // 4)
                out["ids_sha256"].append(hashlib.sha256(coded).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(merges.decode(np.frombuffer(coded, "<u4"))).hexdigest())
        return out

    return map_arrow(rows, run, schema)
