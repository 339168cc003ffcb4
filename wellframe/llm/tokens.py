"""Token ids of whole texts, piece by piece between spaces, with a bounded cache of pieces.

No token of the supported vocabularies crosses from a character that isn't white
space into white space, so a text may be cut before each space or line end that
follows such a character, and each piece encoded by itself. Arrow cuts a block of
texts and numbers its distinct pieces, so Python sees each of them once a block,
and Arrow puts the ids together again. Pieces repeat (words do), so most of them
come from the cache.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded together.
TEXT_BLOCK = 2_000_000

#: White space in front of a space or a line end, behind a line end, or at the start: such texts are cut with more care.
_GAP = r"[\s\p{Z}\x{85}\x1c-\x1f][ \n]|\n[\s\p{Z}\x{85}\x1c-\x1f]|\A[ \n]"
_ENDS_IN_SPACE = re.compile(r"\s\Z")


def pieces(text: str) -> list[str]:
    """The text cut before each space that follows a character which isn't white space, unless a line ends behind it.

    The space that a piece other than the first begins with is left out.
    """
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        if out[-1] == "" or part[:1] == "\n" or _ENDS_IN_SPACE.search(out[-1]):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def arrow_blocks(column: pa.Array, most: int = TEXT_BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """(index of the first, texts) slices of about ``most`` bytes; null is the empty text."""
    texts = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(texts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield low, texts.slice(low, high - low)
        pa.default_memory_pool().release_unused()
        low = high


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Recent:
    """Values by key; holds the last ``most`` new keys at least, and about twice as many at most."""

    def __init__(self, most: int):
        self.most, self.now, self.old = most, {}, {}

    def trim(self) -> None:
        if len(self.now) > self.most:
            self.now, self.old = {}, self.now

    def values(self, keys: list[str]) -> tuple[list, list[int]]:
        """(the value of each key, or None; the places of those)."""
        found = list(map(self.now.get, keys))
        missing = []
        for i in [i for i, v in enumerate(found) if v is None]:
            value = self.old.get(keys[i])
            if value is None:
                missing.append(i)
            else:
                found[i] = self.now[keys[i]] = value
        return found, missing


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    encode_pieces: gets whole pieces, returns the bytes of each one's ids.
    spaced: whether a piece other than the first is encoded with its leading space.
    added: strings that the vocabulary takes out of a text before all else; a text
    that holds one is encoded as a whole by ``encode_whole``.
    """

    LONGEST = 64  # characters of a piece that is worth keeping

    def __init__(self, encode_pieces: Callable[[list[str]], Iterable[bytes]], spaced: bool, added: Iterable[str] = (), encode_whole: Callable[[str], bytes] | None = None, most: int = 60_000):
        self.encode_pieces, self.spaced, self.encode_whole = encode_pieces, spaced, encode_whole
        self.added, self.kept = list(added), Recent(most)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text (null is empty)."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        column = pc.fill_null(column, "")
        whole = np.zeros(len(column), bool)
        for content in self.added:
            whole |= pc.match_substring(column, content).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(column)
        if self.spaced:
            gap = pc.match_substring_regex(column, _GAP).to_numpy(zero_copy_only=False) & ~whole
        else:
            gap = np.zeros(len(column), bool)
        plain = np.flatnonzero(~whole & ~gap)
        if len(plain):
            easy = column if len(plain) == len(column) else column.take(pa.array(plain))
            cut = pc.split_pattern(pc.replace_substring(easy, "\n", " \n" if self.spaced else " "), " ")
            self._fill(out, plain, cut.flatten(), np.diff(cut.offsets.to_numpy()))
        careful = np.flatnonzero(gap)
        if len(careful):
            cuts = [pieces(column[i].as_py()) for i in careful.tolist()]
            self._fill(out, careful, pa.array([p for c in cuts for p in c], pa.string()), np.array([len(c) for c in cuts]))
        for i in np.flatnonzero(whole).tolist():
            out[i] = self.encode_whole(column[i].as_py())
        return out

    def _fill(self, out: list[bytes], at: np.ndarray, found: pa.Array, number: np.ndarray) -> None:
        """Puts the ids of the texts ``at`` into ``out``, of which each is cut into ``number`` of the pieces found."""
        ends = np.cumsum(number)
        coded = found.dictionary_encode()
        distinct, index = strings(coded.dictionary), coded.indices.to_numpy()
        values = self._looked_up(distinct)
        if self.spaced:  # a text's first piece has no space in front
            index = index.copy()
            first = ends - number
            opening: dict[str, int] = {}
            index[first] = [opening.setdefault(p, len(distinct) + len(opening)) for p in strings(found.take(pa.array(first)))]
            values += self.encode_pieces(list(opening))
        ids = pa.array(values, pa.large_binary()).take(pa.array(index))
        bounds = np.frombuffer(ids.buffers()[1], np.int64)[: len(index) + 1][np.concatenate([[0], ends])].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        for i, low, high in zip(at.tolist(), bounds[:-1], bounds[1:]):
            out[i] = bytes(data[low:high])

    def _looked_up(self, distinct: list[str]) -> list[bytes]:
        self.kept.trim()
        values, missing = self.kept.values(distinct)
        lead = " " if self.spaced else ""
        new = [distinct[i] for i in missing]
        for i, p, ids in zip(missing, new, self.encode_pieces([p if p[:1] == "\n" else lead + p for p in new])):
            values[i] = ids
            if len(p) <= self.LONGEST:
                self.kept.now[p] = ids
        return values


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


_ENCODERS: dict[tuple, PieceEncoder] = {}

#: ASCII signs other than the apostrophe.
_SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
#: A space or line end, and Latin letters that are normal as they stand.
_WORD = re.compile(r"[ \n]?[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž]+")


def _whole_pieces(tokenizer) -> Callable[[list[str]], list[bytes]]:
    def encode(batch: list[str]) -> list[bytes]:
        return [packed(e.ids) for e in tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    return encode


def _byte_letters() -> dict[int, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(hidden)}


def _parts_apply(tokenizer) -> bool:
    """Whether the parts of a piece can go to the model one by one: for byte-level BPE without other steps."""
    probe = [" thusly", "Façade", " À bientôt", "x...", " y!?", " Straße", "\nNext,"]
    try:
        parted = _parted_pieces(tokenizer, _whole_pieces(tokenizer))(probe)
    except Exception:  # another kind of model
        return False
    return parted == _whole_pieces(tokenizer)(probe)


def _parted_pieces(tokenizer, whole: Callable[[list[str]], list[bytes]], most: int = 120_000) -> Callable[[list[str]], list[bytes]]:
    """Encodes a word and the signs behind it apart, each once; other pieces as a whole.

    A word of letters is one match of the vocabulary's pattern whatever follows it,
    and so are the signs, so the library's model takes the word directly.
    """
    letters, tokenize = _byte_letters(), tokenizer.model.tokenize
    folded, space = tokenizer.normalizer is not None, chr(letters[32])
    words, signs = Recent(most), Recent(most)
    line = b"" if folded else whole(["\n"])[0]

    def word(text: str) -> bytes | None:
        """None for what isn't one word of letters."""
        if _WORD.fullmatch(text) is None:
            return None
        ahead = b""
        if folded:
            text = text.lower().lstrip(" \n")
        elif text[0] == "\n":
            text, ahead = text[1:], line
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(letters)
        elif text[0] == " ":
            text = space + text[1:]
        return ahead + packed([t.id for t in tokenize(text)])

    def encode(batch: list[str]) -> list[bytes]:
        words.trim()
        signs.trim()
        known, before = words.now, words.old
        bodies = [p.rstrip(_SIGNS) for p in batch]
        tails = [p[len(b) :] for p, b in zip(batch, bodies)]
        signs_wanted = list({t for t in tails if t})
        found, new = signs.values(signs_wanted)
        for i, ids in zip(new, whole([signs_wanted[i] for i in new])):
            signs.now[signs_wanted[i]] = found[i] = ids
        behind = dict(zip(signs_wanted, found))
        behind[""] = b""
        out: list = []
        others = []
        for body, tail in zip(bodies, tails):
            ids = known.get(body)
            if ids is None:
                ids = before.get(body)
                if ids is None:
                    ids = word(body)
                if ids is None:
                    others.append(len(out))
                    out.append(None)
                    continue
                known[body] = ids
            out.append(ids + behind[tail])
        for i, ids in zip(others, whole([batch[i] for i in others])):
            out[i] = ids
        return out

    return encode


def library_encoder(definition: str, spaced: bool) -> PieceEncoder:
    """An encoder by the tokenizers library; one for each Python worker and vocabulary.

    definition: the text of a tokenizer's JSON file. The ids are those of the
    library's ``encode(text, add_special_tokens=False)``, so the string of an added
    token in a text becomes that token. spaced: True for byte-level vocabularies;
    False for those that drop white space.
    """
    key = (hash(definition), spaced)
    if key not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]

        whole = _whole_pieces(tokenizer)
        encode_pieces = _parted_pieces(tokenizer, whole) if _parts_apply(tokenizer) else whole
        _ENCODERS[key] = PieceEncoder(encode_pieces, spaced, added, lambda text: whole([text])[0])
    return _ENCODERS[key]


def id_width(definition: str) -> int:
    """Bytes that hold every id of the vocabulary: 2 or 4."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    return 2 if max(tokenizer.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else 4


def file_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
