"""Averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's features are its words and the character n-grams of its words, a space
standing for each end of a word; each feature is hashed to a bucket and each bucket
has a vector. A text's vector is the mean over its features, its class scores a
linear function of that. As the mean is linear too, a bucket's vector times the
output weights is all that prediction needs: one row of a table for each feature.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from .common import text_blocks

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 1_000_003
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}
#: Characters of a text that are worked on at once, and what counts as white.
SLICE = 1 << 16
_WHITES = " \t\n\x0b\x0c\r"
_WHITE = re.compile(f"[{_WHITES}]")


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        p = np.full(n, base & (2**64 - 1), np.uint64)
        p[0] = 1
        _powers[base] = np.cumprod(p, dtype=np.uint64)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


@dataclass(frozen=True)
class Features:
    """bits: buckets, as a power of two. longest: characters of an n-gram. fold: lower case first."""

    bits: int = 16
    longest: int = 4
    fold: bool = False

    def hashed(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(buckets of each kind, their places in the joined texts, ends of the texts)."""
        if self.fold:
            texts = [t.lower() for t in texts]
        joined = "\n".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        ends = np.cumsum([len(t) + 1 for t in texts])
        space = (code == 32) | ((code >= 9) & (code <= 13))
        code = np.where(space, 32, code).astype(np.uint64)
        space = np.concatenate([[True], space, [True]])
        code = np.concatenate([[np.uint64(32)], code, [np.uint64(32)]])
        shift = np.uint64(64 - self.bits)
        buckets, places = [], []
        rolling = code.copy()
        inner = space
        for n in range(1, self.longest + 1):
            if n > 1:
                rolling = rolling[:-1] + code[n - 1 :] * np.uint64(pow(_BASE, n - 1, 2**64))
            if n == 1:
                valid = ~space
            elif n == 2:
                valid = ~(space[:-1] & space[1:])
            else:  # no space but at the ends
                inner = ~space[1:-1] if n == 3 else inner[:-1] & ~space[n - 2 : -1]
                valid = inner
            at = np.flatnonzero(valid)
            buckets.append((mixed(rolling[at] + np.uint64(n)) * _MIX >> shift).astype(np.int64))
            places.append(at - 1 + space[at])  # a leading space may be the text's before
        start = np.flatnonzero(~space[1:] & space[:-1]) + 1
        stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
        if len(start):
            total = np.concatenate([[np.uint64(0)], np.cumsum(code * powers(_BASE, len(code)), dtype=np.uint64)])
            word = (total[stop] - total[start]) * powers(_BASE_INVERSE, len(code) + 1)[start]
            buckets.append((mixed(word + np.uint64(77)) * _MIX >> shift).astype(np.int64))
            places.append(start - 1)
        return buckets, places, ends

    def of_word(self, word: str) -> Iterator[np.ndarray]:
        """Buckets of one word without spaces, of any length, some at a time: as ``hashed`` finds them, in bounded memory."""
        shift, powers_of = np.uint64(64 - self.bits), [np.uint64(pow(_BASE, n, 2**64)) for n in range(self.longest)]
        if self.fold:
            word = word.lower()
        whole = 0
        for at in range(0, len(word), SLICE):
            # windows that begin in this slice, the first one with the space before
            high = min(len(word), at + SLICE + self.longest - 1)
            code = np.frombuffer(word[at:high].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            first = [np.uint64(32)] if at == 0 else []
            last = [np.uint64(32)] if high == len(word) else []
            own = np.concatenate([first, code, last]).astype(np.uint64)
            begins = len(first) + min(SLICE, len(word) - at)
            for n in range(1, self.longest + 1):
                ends = min(begins, len(own) - n + 1)
                if ends <= 0:
                    continue
                rolling = np.zeros(ends, np.uint64)
                for k in range(n):
                    rolling += own[k : k + ends] * powers_of[k]
                if n == 1:
                    rolling = rolling[len(first) :]
                yield (mixed(rolling + np.uint64(n)) * _MIX >> shift).astype(np.int64)
            part = code[: min(SLICE, len(word) - at)]
            whole = (whole + int((part * powers(_BASE, len(part))).sum(dtype=np.uint64)) * pow(_BASE, at, 2**64)) % 2**64
        yield (mixed(np.array([(whole + 77) % 2**64], np.uint64)) * _MIX >> shift).astype(np.int64)


def slices(text: str) -> Iterator[str]:
    """The text cut at single white characters, about SLICE characters each; together they have the features of the whole.

    A cut takes the white character away, as features see a space at each end of a
    slice. A word is never cut, so one that has no space is one slice of any length.
    """
    at = 0
    while len(text) - at > 2 * SLICE:
        cut = _WHITE.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        if end - at > 2 * SLICE:  # a long word ends there, what stands before it is a slice of its own
            before = max(text.rfind(c, at, at + SLICE) for c in _WHITES)
            if before >= 0:
                yield text[at:before]
                at = before + 1
        yield text[at:end]
        if cut is None:
            return
        at = end + 1
    yield text[at:]


@dataclass
class Model:
    """table: a row of class scores for each bucket; bias; temperature, by which scores are divided."""

    features: Features
    classes: list
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def scores(self, texts: list[str]) -> np.ndarray:
        k = self.table.shape[1]
        total, number = np.zeros((len(texts), k)), np.zeros(len(texts))
        # sums add up, so a long text goes slice by slice; its pieces keep its place
        pieces, owners, size = [], [], 0
        for i, text in enumerate(texts):
            for piece in slices(text):
                if len(piece) > 2 * SLICE:  # one unbroken word
                    for buckets in self.features.of_word(piece):
                        total[i] += self.table[buckets].sum(0, dtype=float)
                        number[i] += len(buckets)
                    continue
                pieces.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= SLICE:
                    self.add(pieces, np.array(owners), total, number)
                    pieces, owners, size = [], [], 0
        self.add(pieces, np.array(owners, int), total, number)
        return total / np.maximum(number, 1)[:, None] + self.bias

    def add(self, pieces: list[str], owners: np.ndarray, total: np.ndarray, number: np.ndarray) -> None:
        if not pieces:
            return
        buckets, places, ends = self.features.hashed(pieces)
        for b, p in zip(buckets, places):
            owner = owners[np.searchsorted(ends, p, side="right")]
            number += np.bincount(owner, minlength=len(number))
            for c in range(total.shape[1]):
                total[:, c] += np.bincount(owner, weights=self.table[b, c], minlength=len(number))

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.scores(texts) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def bags(features: Features, texts: Iterable[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, their shares) of each text."""
    out = []
    for text in texts:
        found = np.concatenate(features.hashed([text])[0])
        u, n = np.unique(found, return_counts=True)
        out.append((u, n / max(n.sum(), 1)))
    return out


def train(
    texts: list[str], labels: list, features: Features, dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 7, check: float = 0.2, accept: float = 0.999, refuse: float = 0.95
) -> Model:
    """A model from labelled texts; the last ``check`` share of a shuffle calibrates it.

    Embeddings learn with Adagrad steps, one text at a time. The temperature is the one
    of least log loss on the calibration texts. ``reject_below`` is the confidence that
    a share ``refuse`` of the calibration texts with their letters shuffled, which are
    of no class, stays under, but no more than a share ``accept`` of those predicted
    rightly reaches, and no less than halfway from chance to that.
    """
    rng = np.random.default_rng(seed)
    classes = sorted(set(labels))
    y = np.array([classes.index(v) for v in labels])
    k, size = max(len(classes), 1), 1 << features.bits
    if len(classes) < 2:
        return Model(features, classes, np.zeros((size, k), np.float32), np.zeros(k))
    bag = bags(features, texts)
    order = rng.permutation(len(texts))
    held = order[: int(check * len(texts))] if len(texts) >= 20 else order
    used = order[int(check * len(texts)) :] if len(texts) >= 20 else order
    vector = rng.normal(0, 0.1, (size, dim))
    out = rng.normal(0, 0.1, (dim, k))
    bias = np.log(np.maximum(np.bincount(y[used], minlength=k), 0.5) / len(used))
    gv, go, gb = np.full(size, 1e-8), np.full((dim, k), 1e-8), np.full(k, 1.0)
    for _ in range(epochs):
        for i in rng.permutation(used):
            u, share = bag[i]
            hidden = share @ vector[u]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            step = share[:, None] * back
            gv[u] += (step * step).mean(1)
            grad = np.outer(hidden, p)
            go += grad * grad
            gb += p * p
            vector[u] -= rate * step / np.sqrt(gv[u])[:, None] * 0.2
            out -= rate * grad / np.sqrt(go) * 0.2
            bias -= 0.1 * rate * p / np.sqrt(gb)
    model = Model(features, classes, (vector @ out).astype(np.float32), bias)
    z = np.array([bag[i][1] @ model.table[bag[i][0]] for i in held]) + bias
    heats = np.geomspace(0.25, 8, 41)
    loss = [-np.log(np.maximum(softmax(z / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in heats]
    model.temperature = float(heats[int(np.argmin(loss))])
    p = softmax(z / model.temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    if len(right):
        most = np.quantile(right, 1 - accept)
        foreign = np.concatenate([model.probabilities(shuffled_letters(block, rng)).max(1) for _, block in text_blocks([texts[i] for i in held])])
        model.reject_below = float(np.clip(np.quantile(foreign, refuse), (most + 1 / k) / 2, most))
    return model


def shuffled_letters(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Each text with its letters dealt anew among the places of letters."""
    out = []
    for text in texts:
        characters = np.array(list(text), dtype=object)
        at = np.flatnonzero([c.isalpha() for c in text])
        characters[at] = characters[rng.permutation(at)]
        out.append("".join(characters))
    return out
