"""Encoding texts by pre-tokens, each distinct one encoded once while it is remembered.

Byte-level BPE never merges across pre-tokens, so a text's ids are those of its pre-tokens joined. Texts
are taken a block at a time: a block is cut at spaces, of its equal words one is looked up, and the ids of
all are gathered by numpy. Known words are numpy arrays too; only new ones become Python objects, are cut
into pre-tokens and encoded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import mix64

#: Pre-tokens that a generation of a worker's memo holds; two generations are kept.
PIECES = 300_000
#: Words that are remembered; beyond, all but those of the last block are forgotten.
WORDS = 2_000_000
#: Longer pre-tokens (in characters) and words (in bytes) are not remembered.
LONGEST = 40
#: Words whose ids are gathered at once.
STEP = 1 << 15
#: Characters of texts in a block; a longer text stands alone.
BLOCK_CHARS = 6 << 20

# Of the characters that a plain text may have, the letters and the numbers. All pattern
# engines class these alike; white space is only space and line feed.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_PLAIN = re.compile("[\\n -~¡-ɏ‐-‧‰-⁞₠-₿]*")
# Fixed value: the pattern by which a space that stands between words always starts a pre-token.
_BY_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A space doesn't start a pre-token behind white space if white space or the end follows.
_RUNS, _LAST = ("   ", "\n  ", "  \n", "\n \n"), ("  ", "\n ")
# Marks of a block, none a plain character: a text's first word, its end, a text that is encoded by itself.
_FIRST, _END, _ALONE = "\x00", "\x01", "\x02"


def plain_splitter(pattern: str) -> Callable[[str], list[str]] | None:
    """pattern for plain texts, by the faster engine; None where it has parts that aren't known here."""
    out = pattern
    for known, plain in ((r"[^\s\p{L}\p{N}]", f"[^\n {_LETTERS}{_NUMBERS}]"), (r"\p{L}", f"[{_LETTERS}]"), (r"\p{N}", f"[{_NUMBERS}]"), (r"\S", "[^\n ]"), (r"\s", "[\n ]")):
        out = out.replace(known, plain)
    return None if "\\" in out else re.compile(out).findall


def text_blocks(rows: Iterable[tuple[object, str]], size: int = BLOCK_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of about size characters from (key, text)."""
    keys: list = []
    texts: list[str] = []
    held = 0
    for key, text in rows:
        if held and held + len(text) > size:
            yield keys, texts
            keys, texts, held = [], [], 0
        keys.append(key)
        texts.append(text)
        held += len(text) + 16
    if keys:
        yield keys, texts


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string of data, of at most LONGEST bytes."""
    eight = np.ndarray((len(data) + LONGEST,), "<u8", data.tobytes() + bytes(LONGEST + 8), strides=(1,))
    a = size.astype(np.uint64)
    b = mix64(a)
    for j in range(0, LONGEST, 8):
        part = eight[first + j] & _MASKS[np.clip(size - j, 0, 8)]
        a = mix64(a ^ part) * np.uint64(0x9E3779B97F4A7C15)
        b = mix64(b + part) * np.uint64(0xC2B2AE3D27D4EB4F)
    return a, b


class PieceEncoder:
    """encode_words gives the ids, as bytes, of each of a list of pre-tokens; split cuts a text into pre-tokens.

    whole, if given, encodes texts that aren't plain and those that hold one of added. The memo of pre-tokens
    has two generations: when the young one is full, the old one is forgotten. The memo of words is known by
    128 bits of each.
    """

    def __init__(self, pattern: str, split: Callable[[str], list[str]], encode_words: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes] | None = None, limit: int = PIECES, added: tuple[str, ...] = (), words: int | None = None):
        self.limit, self.added, self.words = limit, added, words
        self.split, self.encode_words, self.whole = split, encode_words, whole
        self.split_plain = plain_splitter(pattern)
        self.by_words = pattern == _BY_WORDS
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """Empty the memo of words: sorted first halves of their hashes, second halves, first id and number of ids in flat."""
        self.high, self.low = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.first, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, "<u4")

    def _coded(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        known, old = self.young, self.old
        out = list(map(known.get, pieces))
        # Never a set operation with a memo on its right side: some go through all of the memo.
        at = [i for i, x in enumerate(out) if x is None]
        if at:
            missing = {pieces[i] for i in at}
            if old:
                known.update([(w, old[w]) for w in missing if w in old])
            new = [w for w in missing if w not in known]
            known.update(zip(new, self.encode_words(new)))
            for i in at:
                out[i] = known[pieces[i]]
            for w in new:
                if len(w) > LONGEST:
                    del known[w]
        return out

    def _alone(self, text: str) -> bytes:
        """The ids of a text that isn't cut at spaces."""
        plain = self.split_plain and _PLAIN.fullmatch(text) and not any(a in text for a in self.added)
        if self.whole and not plain:
            return self.whole(text)
        return b"".join(self._coded(self.split_plain(text) if plain else self.split(text)))

    def encode(self, texts: list[str], end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, unsigned 32-bit, end behind each, and how many are each text's."""
        marked, alone = [], []
        for x in texts:
            if self.by_words and _PLAIN.fullmatch(x) and not any(r in x for r in _RUNS) and not x.endswith(_LAST) and not any(a in x for a in self.added):
                marked.append(_FIRST + x)
            else:
                marked.append(f"{_ALONE}{len(alone)}")
                alone.append(x)
        if not marked:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        cut = pc.split_pattern(pa.array([f" {_END} ".join(marked) + f" {_END}"], pa.large_string()), " ").values.dictionary_encode()
        del marked
        which = cut.indices.to_numpy()
        places = np.frombuffer(cut.dictionary.buffers()[1], np.int64)[cut.dictionary.offset :][: len(cut.dictionary) + 1]
        data, length = np.frombuffer(cut.dictionary.buffers()[2], np.uint8), np.diff(places)
        # Words that may be remembered: no mark, no white space at either end.
        usual = (length > 0) & (length <= LONGEST)
        usual[usual] = (data[places[:-1][usual]] > 10) & (data[places[1:][usual] - 1] > 10)
        high, low = word_hashes(data, places[:-1], np.minimum(length, LONGEST))
        # In ascending order, as a search then finds in the cache what the last one read.
        by = np.argsort(high)
        at = np.empty(len(high), np.int64)
        at[by] = np.searchsorted(self.high, high[by])
        at[at == len(self.high)] = 0
        hit = usual & (self.high[at] == high) & (self.low[at] == low) if len(self.high) else np.zeros(len(length), bool)
        first, size = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        first[hit], size[hit] = self.first[at[hit]], self.size[at[hit]]
        new, rest = np.flatnonzero(usual & ~hit), np.flatnonzero(~usual)
        flat, size[new] = self._new(cut.dictionary.take(pa.array(new)).to_pylist())
        first[new] = np.cumsum(size[new]) - size[new] + len(self.flat)
        self.flat = np.concatenate((self.flat, flat))
        last = self._rest(cut.dictionary.take(pa.array(rest)).to_pylist(), alone, end)
        size[rest] = [len(x) >> 2 for x in last]
        first[rest] = np.cumsum(size[rest]) - size[rest] + len(self.flat)
        flat = np.concatenate((self.flat, np.frombuffer(b"".join(last), "<u4")))
        n = size[which]
        stop = np.cumsum(n)
        ids = np.empty(stop[-1], "<u4")
        for a in range(0, len(n), STEP):
            part, begin, upto = n[a : a + STEP], int(stop[a] - n[a]), int(stop[min(a + STEP, len(n)) - 1])
            ids[begin:upto] = flat[np.repeat(first[which[a : a + STEP]] - stop[a : a + STEP] + part, part) + np.arange(begin, upto)]
        ends = stop[np.flatnonzero(which == which[-1])]
        # Remember the new words; one whose first half is taken stays unknown.
        if len(self.high) + len(new) > (WORDS if self.words is None else self.words):
            self._forget()
            self.flat, new = flat, np.flatnonzero(usual)
        into = new[np.argsort(high[new])]
        spot = np.searchsorted(self.high, high[into])
        for name, values in (("high", high), ("low", low), ("first", first), ("size", size.astype(np.int32))):
            setattr(self, name, np.insert(getattr(self, name), spot, values[into]))
        return ids, np.diff(ends, prepend=0)

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words behind a space, in a row, and the number of each. Cut at once: each starts with its space."""
        if not words:
            return np.empty(0, "<u4"), np.empty(0, np.int64)
        joined = "".join([f" {w}" for w in words])
        pieces = self.split_plain(joined)
        coded = self._coded(pieces)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        starts = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        heads = np.flatnonzero(np.frombuffer((" " + joined).encode("utf-32-le"), "<u4")[np.concatenate(([1], starts[:-1] + 1))] == 32)
        return np.frombuffer(b"".join(coded), "<u4"), np.add.reduceat(sizes, heads)

    def _rest(self, words: list[str], alone: list[str], end: bytes) -> list[bytes]:
        """The ids of each other word: a mark, a text's first word, one that is long or has white space at an end.

        The pre-tokens of all are looked up at once.
        """
        out, at, cuts, pieces = [end] * len(words), [], [0], []
        for i, word in enumerate(words):
            if word[:1] == _ALONE:
                out[i] = self._alone(alone[int(word[1:])])
            elif word != _END:
                at.append(i)
                pieces += self.split_plain(word[1:] if word[:1] == _FIRST else " " + word)
                cuts.append(len(pieces))
        coded = self._coded(pieces)
        for i, a, b in zip(at, cuts, cuts[1:]):
            out[i] = b"".join(coded[a:b])
        return out
