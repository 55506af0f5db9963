"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue (operator 10)."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches
from .pretokens import PieceEncoder, text_blocks

#: Bytes of pre-tokens that are merged in one queue; a longer one stands alone.
BATCH = 1 << 17
#: In a list of ids: a byte that is no token, and one that was merged into the token before it.
_NO_ID, _GONE = -2, -1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """A priority queue over merge ranks: three levels of 64-way bitmaps over buckets of positions.

    A bit of `leaf` says that a rank's bucket has positions; a bit of `inner` that a leaf word is not
    zero; `top` the same of inner. The lowest rank is found by three find-first-set steps. Positions of
    a bucket come out from the left, one by one or all at once.
    """

    def __init__(self, n_ranks: int):
        self.leaf = [0] * ((n_ranks >> 6) + 1)
        self.inner = [0] * ((n_ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, positions: list[int]) -> None:
        """Queue one or more positions; the list is the queue's from now on."""
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket += positions
            return
        self.buckets[rank] = positions
        j = rank >> 6
        word = self.leaf[j]
        self.leaf[j] = word | 1 << (rank & 63)
        if not word:
            self.inner[j >> 6] |= 1 << (j & 63)
            self.top |= 1 << (j >> 6)

    def push(self, rank: int, position: int) -> None:
        self.put(rank, [position])

    def take(self) -> tuple[int, list[int]]:
        """The lowest rank and all its positions, ascending."""
        top = self.top
        i = (top & -top).bit_length() - 1
        word = self.inner[i]
        j = i << 6 | (word & -word).bit_length() - 1
        bits = self.leaf[j]
        rank = j << 6 | (bits & -bits).bit_length() - 1
        bucket = self.buckets.pop(rank)
        self.leaf[j] = bits = bits & (bits - 1)
        if not bits:
            self.inner[i] = word = word & (word - 1)
            if not word:
                self.top = top & (top - 1)
        bucket.sort()
        return rank, bucket

    def pop(self) -> tuple[int, int]:
        rank, positions = self.take()
        if len(positions) > 1:
            self.put(rank, positions[1:])
        return rank, positions[0]


class Codec:
    """Encodes and decodes by the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.queue = RankQueue(self.size)
        self.bytes_of = [b""] * self.size
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        # White_Space as the rank files' own library takes it, whatever `\s` is here.
        split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        byte_ids = [ranks.get(bytes([b]), _NO_ID) for b in range(256)]
        self.byte_ids = np.array(byte_ids, np.int32)
        self.pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32)
        self.pieces = PieceEncoder(pattern, split, lambda words: self.merge([w.encode() for w in words]), limit=120_000, words=600_000)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as bytes; those that are no token are merged many at once."""
        out = [b""] * len(pieces)
        some, held = [], 0
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = whole.to_bytes(4, "little")
            elif piece:
                if some and held + len(piece) > BATCH:
                    self._merge(pieces, some, out)
                    some, held = [], 0
                some.append(k)
                held += len(piece)
        if some:
            self._merge(pieces, some, out)
        return out

    def _merge(self, pieces: list[bytes], some: list[int], out: list[bytes]) -> None:
        """Put the ids of some of the pieces into out: in each always the lowest rank first, leftmost on ties.

        All are in one queue, as they don't touch each other: the lowest rank of all is taken with all its positions.
        """
        data = b"".join([pieces[k] for k in some])
        n = len(data)
        sizes = np.fromiter((len(pieces[k]) for k in some), np.int64, len(some))
        first = np.cumsum(sizes) - sizes
        # Where a piece begins, and behind the last.
        begins = bytearray(n + 1)
        np.frombuffer(begins, np.uint8)[first] = 1
        begins[n] = 1
        codes = np.frombuffer(data, np.uint8)
        pairs = np.append(self.pairs[codes[:-1].astype(np.int32) << 8 | codes[1:]], [-1, -1]).astype(np.int32)
        pairs[first[1:] - 1] = -1
        at = np.flatnonzero(pairs >= 0)
        at = at[np.argsort(pairs[at], kind="stable")]
        queue, get = self.queue, self.ranks.get
        buckets, put, take = queue.buckets, queue.put, queue.take
        if len(at):
            new = np.flatnonzero(np.diff(pairs[at], prepend=-1))
            for rank, positions in zip(pairs[at[new]].tolist(), np.split(at, new[1:])):
                put(rank, positions.tolist())
        rank_at, ids = pairs.tolist(), self.byte_ids[codes].tolist()
        following, previous = list(range(1, n + 1)), list(range(-1, n))
        while queue.top:
            rank, positions = take()
            lower = False
            for k, i in enumerate(positions):
                if rank_at[i] != rank:  # a neighbour was merged since: stale
                    continue
                mid = following[i]
                following[i] = end = following[mid]
                ids[i], ids[mid], rank_at[mid] = rank, _GONE, -1
                r = None
                if not begins[end]:
                    previous[end] = i
                    r = get(data[i : following[end]])
                if r is None:
                    rank_at[i] = -1
                else:
                    rank_at[i] = r
                    lower = r < rank
                    if r in buckets:
                        buckets[r].append(i)
                    else:
                        put(r, [i])
                if not begins[i]:
                    p = previous[i]
                    r = get(data[p:end])
                    if r is None:
                        rank_at[p] = -1
                    else:
                        rank_at[p] = r
                        lower |= r < rank
                        if r in buckets:
                            buckets[r].append(p)
                        else:
                            put(r, [p])
                if lower:  # it comes before what is left of this rank
                    if k + 1 < len(positions):
                        put(rank, positions[k + 1 :])
                    break
        ids = np.array(ids, np.int32)
        if (ids == _NO_ID).any():
            raise KeyError("a byte that is no token")
        left = ids != _GONE
        stop = 4 * np.cumsum(np.add.reduceat(left, first, dtype=np.int64))
        coded = ids[left].astype("<u4").tobytes()
        a = 0
        for k, b in zip(some, stop.tolist()):
            out[k] = coded[a:b]
            a = b

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        ids, n = self.pieces.encode(texts)
        data, stop = memoryview(ids.tobytes()), np.cumsum(n) * 4
        return [bytes(data[a:b]) for a, b in zip((stop - n * 4).tolist(), stop.tolist())]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary in each worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Ids of every whole text, decoded again.

    Returns id_col, ids (binary, little-endian unsigned 32-bit; left out without with_ids), n_tokens long,
    ids_sha256, decoded_sha256 string and round_trip boolean (decoded bytes equal the text's). A null or
    empty text has no ids. Each row of docs, repeated or not, gives one row; other columns are ignored.
    Texts are held a batch at a time; nothing is shuffled, so rows of any skew cost the same.
    """
    small_batches(docs.sparkSession)
    names = [id_col] + (["ids"] if with_ids else [])

    def run(batches):
        c = codec(ranks_path, pattern)
        for batch in batches:
            at = 0
            for _, texts in text_blocks((None, x or "") for x in batch.column(1).to_pylist()):
                ids, sizes, sums, back, same = [], [], [], [], []
                for text, coded in zip(texts, c.encode(texts)):
                    decoded = c.decode(coded)
                    if with_ids:
                        ids.append(coded)
                    sizes.append(len(coded) >> 2)
                    sums.append(hashlib.sha256(coded).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                    same.append(decoded == text.encode())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *([pa.array(ids, pa.binary())] if with_ids else []), pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string()), pa.array(same, pa.bool_())], [*names, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"])
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}" + ", ids binary" * with_ids + ", n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
