"""Suffix-array dedup of repeated byte strings across documents (operator 9).

A byte of a document goes if a LENGTH-byte string that covers it also starts in a document with a
smaller doc_id. Every such string (window) holds one anchor: the least hash among its K-byte strings,
leftmost on ties. Equal windows have equal anchors at equal places, so windows need only be compared
with windows of the same anchor. A segment is a maximal run of a document's windows with one anchor.

1. Documents are packed into chunks, a written table.
2. Each chunk sends its distinct anchors, 8 bytes each, to the anchors' buckets; a bucket answers with
   the anchors that two documents hold.
3. Each chunk sends its distinct segments of those anchors, with the least doc_id that holds each. A
   bucket finds, for every window of every segment, the least doc_id of that window. Where an anchor has
   several distinct segments, their suffixes are put in order (grouping_suffix_array) and runs of suffixes
   that agree in LENGTH bytes are the classes; all strings of an anchor are in one array, and nothing else
   joins windows. Windows whose 64-bit hash no other window of the bucket has can have no twin and are
   left out of the arrays beforehand. Where an anchor has one distinct segment its windows are alike
   in all that hold it, and there is nothing to order.
4. Each chunk looks its windows up and cuts.

An anchor with many distinct segments (HOT) would gather a large group: its windows are sent one by one
instead, each a segment of its own that is its own anchor, so that they spread over all buckets.

Sent are distinct strings of a chunk, never occurrences: a passage that a third of all documents hold
is a few records for each chunk. Strings are known by 128 bits. The chunks are a table bucketed by chunk,
so that only answers are shuffled to them, not texts.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import _BASE, _LETTERS, U64, _power_table, delete, drop_spool, free_shuffles, mix64, shared_dir, small_batches, spool

LENGTH = 50
#: Bytes that an anchor hashes; a window holds LENGTH - K + 1 of them.
K = 20
#: Bytes of text in a chunk (a longer document is a chunk of its own) and in a block of it.
CHUNK_BYTES = 8 << 20
PIECE = 1 << 20
#: Bytes that are hashed at once: what that takes stays in a core's cache.
STEP = 1 << 15
#: Text bytes for one bucket of anchors.
BUCKET_BYTES = 8 << 20
#: Symbols that one suffix array orders; whole anchors' strings are packed into arrays of about so many.
ORDERED = 1 << 16
#: An anchor with more distinct segments than this is sent by windows. Those of a chunk with at most FEW are counted as one.
HOT, FEW = 1_000, 4

_PLACE = U64((1 << 22) - 1)


def grouping_suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array of symbols, whose last must be the only least one; linear time, no renaming, no recursion.

    First part: suffixes stand in groups, at first by their first symbol, at the end by their Lyndon
    prefix. From the greatest group down, each suffix of a group finds by pointers the last suffix before
    it in a smaller group (its previous smaller one); those are split off their groups, upwards, by how
    many suffixes of the group point to them: their prefix is longer by so many of the group's.
    Second part: in suffix order, each suffix puts those whose next smaller suffix it is at the front of
    what is open of their groups, following the same pointers.
    """
    n = len(symbols)
    kinds = sorted(set(symbols))
    number = {c: i for i, c in enumerate(kinds)}
    group = [number[c] for c in symbols]
    members: list[list[int]] = [[] for _ in kinds]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(kinds) - 1))
    above = list(range(1, len(kinds))) + [-1]
    previous = list(range(-1, n - 1))
    done = bytearray(n)

    def split(positions: list[int]) -> None:
        """Move positions, each out of its group into one just above it."""
        new: dict[int, int] = {}
        for p in positions:
            q = group[p]
            x = new.get(q)
            if x is None:
                new[q] = x = len(members)
                members.append([])
                a = above[q]
                below.append(q)
                above.append(a)
                above[q] = x
                if a >= 0:
                    below[a] = x
            group[p] = x
            members[x].append(p)

    g = len(kinds) - 1
    while g >= 0:
        own = [s for s in members[g] if group[s] == g]
        members[g] = own
        for s in own:
            done[s] = 1
        count: dict[int, int] = {}
        for s in own:
            p = previous[s]
            while p >= 0 and done[p]:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        if count:
            most = max(count.values())
            if most == 1:
                split(list(count))
            else:
                by: dict[int, list[int]] = {}
                for p, c in count.items():
                    by.setdefault(c, []).append(p)
                for c in sorted(by, reverse=True):
                    split(by[c])
        g = below[g]

    front, at, g = [0] * len(members), 0, 0
    while g >= 0:
        front[g] = at
        at += len(members[g])
        g = above[g]
    out = [0] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            out[front[g]] = s
            front[g] += 1
            placed[s] = 1
            s = previous[s]
    return out


def _pieces(texts: list[bytes]):
    """Blocks of (document number, offset, bytes), about PIECE bytes; a long text is cut with LENGTH - 1 bytes of overlap."""
    block, held = [], 0
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            part = text[a : a + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if block and held + len(part) > PIECE:
                yield block
                block, held = [], 0
            block.append((i, a, part))
            held += len(part)
    if block:
        yield block


_CHECK_BASE = 0xA24BAED4963EE407
_CHECK_LETTERS = mix64(_LETTERS)


def string_hashes(text: np.ndarray, first: np.ndarray, sizes: np.ndarray | int, check: bool = False) -> np.ndarray:
    """64 bits of each string of text from the ascending places first; with check, other 64 bits. Works on about STEP bytes at a time."""
    name, base, letters = ("check", _CHECK_BASE, _CHECK_LETTERS) if check else ("", _BASE, _LETTERS)
    back = pow(base, -1, 1 << 64)
    stop = first + sizes
    out = np.empty(len(first), U64)
    i = 0
    while i < len(first):
        low = int(first[i])
        j = int(np.searchsorted(first, low + STEP))
        a, b = first[i:j] - low, stop[i:j] - low
        n = int(b.max())
        up, down = _power_table(name or "up", base, n + 1), _power_table(name + "down", back, n + 1)
        total = np.empty(n + 1, U64)
        total[0] = 0
        value = letters[text[low : low + n]]
        value *= up[:n]
        np.cumsum(value, out=total[1:])
        h = total[b]
        h -= total[a]
        h *= down[a]
        out[i:j] = mix64(h)
        i = j
    return out


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, the first one first, and where in that order a new key starts."""
    order = np.argsort(keys[0])
    if len(keys) > 1 and len(order):
        # The other keys are looked at only where the first is met again.
        k = keys[0][order]
        alike = np.zeros(len(k) + 1, bool)
        alike[1:-1] = k[1:] == k[:-1]
        tied = np.flatnonzero(alike[1:] | alike[:-1])
        some = order[tied]
        order[tied] = some[np.lexsort([k[some] for k in keys[::-1]])]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def _anchor_runs(raw: bytes, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each maximal run of windows with one place of the anchor, and the anchor; a run also begins where cut says so."""
    eight = np.ndarray((len(raw),), "<u8", raw + bytes(8), strides=(1,))
    need = LENGTH - K + 1
    firsts, anchors, before = [], [], -1
    for a in range(0, len(cut), STEP):
        new = cut[a : a + STEP].copy()
        m = len(new) + need - 1  # K-byte strings that these windows hold
        part = eight[a : a + m + K - 8].copy()
        h = part[:m] * U64(0x9E3779B97F4A7C15)
        spare = np.empty(m, U64)
        for j in sorted({*range(8, K - 7, 8), K - 8}):
            h ^= part[j : j + m]
            _mix64(h, spare)
            h *= U64(0x9E3779B97F4A7C15)
        _mix64(h, spare)
        low = h & ~_PLACE
        low |= np.arange(a, a + m, dtype=U64)
        # Least of each LENGTH - K + 1 neighbours, by doubling.
        width = 1
        while width * 2 <= need:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
        low &= _PLACE
        new[0] |= int(low[0]) != before
        new[1:] |= low[1:] != low[:-1]
        before = int(low[-1])
        at = np.flatnonzero(new)
        firsts.append(at + a)
        anchors.append(h[low[at].astype(np.int64) - a])
    return np.concatenate(firsts), np.concatenate(anchors)


def _mix64(x: np.ndarray, spare: np.ndarray) -> None:
    """mix64() in place."""
    for _ in range(2):
        np.right_shift(x, U64(32), out=spare)
        x ^= spare
        x *= U64(0xD6E8FEB86659FD93)
    np.right_shift(x, U64(32), out=spare)
    x ^= spare


class Segments:
    """The segments of one block: anchor, content and check hashes, document number, first window and number of windows.

    Of anchors that are hot, each window is a segment.
    """

    def __init__(self, block: list[tuple[int, int, bytes]], hot: np.ndarray | None = None):
        self.raw = b"".join(p for _, _, p in block)
        n = len(self.raw)
        buf = np.frombuffer(self.raw, np.uint8)
        sizes = np.array([len(p) for _, _, p in block], np.int64)
        start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        last = start + sizes - LENGTH  # a piece's last window
        cut = np.zeros(n - LENGTH + 1, bool)
        cut[start] = True
        after = last + 1
        cut[after[after < len(cut)]] = True
        first, anchor = _anchor_runs(self.raw, cut)
        count = np.diff(np.append(first, len(cut)))
        owner = np.searchsorted(start, first, side="right") - 1
        ok = first <= last[owner]
        self.first, self.count, owner, self.anchor = first[ok], count[ok], owner[ok], anchor[ok]
        if hot is not None and len(hot):
            single = np.isin(self.anchor, hot)
            n = np.where(single, self.count, 1)
            self.first = np.repeat(self.first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.count, owner, self.anchor, single = (np.repeat(x, n) for x in (self.count, owner, self.anchor, single))
            self.count[single] = 1
        self.content = string_hashes(buf, self.first, self.count + LENGTH - 1)
        if hot is not None:
            self.check = string_hashes(buf, self.first, self.count + LENGTH - 1, True)
            if len(hot):
                self.anchor[single] = self.content[single]
        self.doc = np.array([i for i, _, _ in block])[owner]
        self.window = self.first - start[owner] + np.array([a for _, a, _ in block])[owner]


def least_by_window(texts: list[bytes], docs: list[int]) -> list[np.ndarray]:
    """For each text, the least of docs over all texts that hold its window, window by window."""
    symbols: list[int] = []
    starts = []
    for t in texts:
        starts.append(len(symbols))
        symbols.extend([c + 2 for c in t])
        symbols.append(1)
    symbols.append(0)
    order = np.array(grouping_suffix_array(symbols))
    whole = np.array(symbols, np.int16)
    starts = np.array(starts)
    sizes = np.array([len(t) for t in texts])
    owner = np.searchsorted(starts, order, side="right") - 1
    order_ok = order <= starts[owner] + sizes[owner] - LENGTH
    order, owner = order[order_ok], owner[order_ok]
    rows = np.lib.stride_tricks.sliding_window_view(whole, LENGTH)[order]
    new = np.ones(len(order), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    least = np.minimum.reduceat(np.array(docs, np.int64)[owner], at) if len(at) else np.empty(0, np.int64)
    by_place = np.empty(len(whole), np.int64)
    by_place[order] = np.repeat(least, np.diff(np.append(at, len(order))))
    return [by_place[a : a + n - LENGTH + 1] for a, n in zip(starts, sizes)]


def _squeeze(data: bytes, _by=[]) -> bytes:
    if not _by:
        _by.append(zstandard.ZstdCompressor(level=3))
    return _by[0].compress(data)


def _restore(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _chunks(docs: DataFrame) -> DataFrame:
    """chunk string, n_bytes long, doc_ids and sizes (64-bit) and texts (compressed) binary."""

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def chunk():
            return pa.RecordBatch.from_arrays([pa.array([f"{part}-{number}"]), pa.array([held], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.array([len(t) for t in texts], "<i8").tobytes()], pa.binary()), pa.array([_squeeze(b"".join(texts))], pa.binary())], ["chunk", "n_bytes", "doc_ids", "sizes", "texts"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids.append(doc_id)
                texts.append(text or b"")
                held += len(texts[-1])
                if held >= CHUNK_BYTES:
                    yield chunk()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield chunk()

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "chunk string, n_bytes long, doc_ids binary, sizes binary, texts binary")


def _open(doc_ids: bytes, sizes: bytes, texts: bytes) -> tuple[np.ndarray, list[bytes]]:
    data, at = _restore(texts), np.concatenate(([0], np.cumsum(np.frombuffer(sizes, "<i8"))))
    return np.frombuffer(doc_ids, "<i8"), [data[a:b] for a, b in zip(at, at[1:])]


def _by_bucket(values: np.ndarray, buckets: int):
    """(bucket, places of its values) of each bucket that has any."""
    b = (values % U64(buckets)).astype(np.int64)
    order, new = _distinct(b)
    yield from zip(b[order[new]].tolist(), np.split(order, new[1:]) if len(new) else ())


def _anchors(chunks: DataFrame, buckets: int, few: int) -> DataFrame:
    """bucket, chunk, anchors, often and many binary: the chunk's distinct anchors of a bucket (one at least),
    whether several documents hold each (a byte), and its distinct segments beyond one where they are over few."""

    def run(batches):
        for batch in batches:
            for chunk, doc_ids, sizes, texts in zip(*(c.to_pylist() for c in batch.columns)):
                ids, texts = _open(doc_ids, sizes, texts)
                found = []
                for block in _pieces(texts):
                    s = Segments(block)
                    order, new = _distinct(s.anchor, s.content)
                    a, d = s.anchor[order], ids[s.doc[order]]
                    at = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                    kinds = np.diff(np.searchsorted(new, np.append(at, len(a))))
                    found.append((a[at], np.minimum.reduceat(d, at), np.maximum.reduceat(d, at), kinds))
                if not found:
                    continue
                a, lo, hi, kinds = map(np.concatenate, zip(*found))
                order, at = _distinct(a)
                often = np.minimum.reduceat(lo[order], at) < np.maximum.reduceat(hi[order], at)
                a, kinds = a[order[at]], np.add.reduceat(kinds[order], at)
                kinds = np.where(kinds > few, kinds - 1, 0).astype("<u4")
                rows = [(b, chunk, a[p].tobytes(), often[p].tobytes(), kinds[p].tobytes() if kinds[p].any() else None) for b, p in _by_bucket(a, buckets)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), *[pa.binary()] * 3))], ["bucket", "chunk", "anchors", "often", "many"])

    return chunks.select("chunk", "doc_ids", "sizes", "texts").mapInArrow(run, "bucket int, chunk string, anchors binary, often binary, many binary")


def _repeated(table: pa.Table, most: int) -> pa.Table:
    """chunk, anchors, hot binary: of one bucket, each chunk's anchors that two documents hold, the hot ones (over most distinct segments) apart."""
    own = [np.frombuffer(x, U64) for x in table["anchors"].to_pylist()]
    anchors = np.concatenate(own)
    often = np.concatenate([np.frombuffer(x, bool) for x in table["often"].to_pylist()])
    many = np.concatenate([np.zeros(len(o), np.int64) if x is None else np.frombuffer(x, "<u4").astype(np.int64) for x, o in zip(table["many"].to_pylist(), own)])
    values, which, seen = np.unique(anchors, return_inverse=True, return_counts=True)
    wanted = seen > 1
    wanted[which[often]] = True
    hot = wanted & (seen + np.bincount(which, many, len(values)) > most)
    ends = np.cumsum([len(x) for x in own])[:-1]
    parts = [[x[k] for x, k in zip(own, np.split(keep[which], ends))] for keep in (wanted & ~hot, hot)]
    return pa.table({"chunk": table["chunk"], **{n: pa.array([x.tobytes() for x in part], pa.binary()) for n, part in zip(("anchors", "hot"), parts)}})


def _segments(chunks: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, and of the chunk's distinct segments of repeated anchors: anchor (64-bit), and compressed in a row low, high (doc_id) and sizes (64-bit) and their bytes."""
    asked = chunks.join(anchors.groupBy("chunk").agg(F.collect_list("anchors").alias("anchors"), F.collect_list("hot").alias("hot")), "chunk")

    def run(batches):
        for batch in batches:
            for chunk, doc_ids, sizes, texts, anchors, hot in zip(*(c.to_pylist() for c in batch.columns)):
                wanted, hot = (np.frombuffer(b"".join(x), U64) for x in (anchors, hot))
                wanted = np.sort(np.concatenate((wanted, hot)))
                if not len(wanted):
                    continue
                ids, texts = _open(doc_ids, sizes, texts)
                parts = []
                for block in _pieces(texts):
                    s = Segments(block, hot)
                    keep = wanted[np.minimum(np.searchsorted(wanted, s.anchor), len(wanted) - 1)] == s.anchor
                    if len(hot):
                        keep |= s.anchor == s.content
                    keep = np.flatnonzero(keep)
                    if not len(keep):
                        continue
                    order, at = _distinct(s.content[keep], s.check[keep])
                    order = keep[order]
                    d, one = ids[s.doc[order]], order[at]
                    data = [s.raw[a : a + n] for a, n in zip(s.first[one].tolist(), (s.count[one] + LENGTH - 1).tolist())]
                    parts.append((s.anchor[one], s.content[one], s.check[one], np.minimum.reduceat(d, at), np.maximum.reduceat(d, at), data))
                if not parts:
                    continue
                anchor, content, check, low, high = (np.concatenate([p[i] for p in parts]) for i in range(5))
                data = [x for p in parts for x in p[5]]
                order, at = _distinct(content, check)
                low, high, one = np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at), order[at]
                anchor = anchor[one]
                rows = []
                for b, p in _by_bucket(anchor, buckets):
                    own = [data[i] for i in one[p]]
                    rows.append((b, chunk, anchor[p].tobytes(), _squeeze(b"".join((low[p].tobytes(), high[p].tobytes(), np.array([len(x) for x in own], "<i8").tobytes(), *own)))))
                    if len(rows) == 256:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["bucket", "chunk", "anchor", "data"])
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["bucket", "chunk", "anchor", "data"])

    return asked.select("chunk", "doc_ids", "sizes", "texts", "anchors", "hot").mapInArrow(run, "bucket int, chunk string, anchor binary, data binary")


def _classes(texts: list[bytes], docs: list[int], anchors: np.ndarray, ordered: int) -> list[np.ndarray]:
    """least_by_window() of the distinct segments of several anchors; those of an anchor come one after the other.

    Equal windows have one anchor, so an anchor's strings are put in suffix order by themselves. A window whose
    hash is met once has no twin; what is left of the segments is far less and mostly alike, and is ordered
    once for each distinct string of an anchor.
    """
    sizes = np.array([len(t) for t in texts])
    start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    whole = np.frombuffer(b"".join(texts), np.uint8)
    counts = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(texts)), counts)
    places = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    h = string_hashes(whole, places, LENGTH)
    by = np.argsort(h)
    alike = h[by[1:]] == h[by[:-1]]
    shared = np.zeros(len(h), bool)
    shared[by[1:][alike]] = shared[by[:-1][alike]] = True
    least = np.array(docs, np.int64)[owner]
    # Runs of windows that may have twins, within a segment.
    edge = np.flatnonzero(shared & np.concatenate(([True], ~shared[:-1] | (owner[1:] != owner[:-1]))))
    stop = np.flatnonzero(shared & np.concatenate((~shared[1:] | (owner[1:] != owner[:-1]), [True]))) + 1
    runs: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
    kinds = anchors[owner[edge]]
    for kind, x, y in zip(kinds.tolist(), edge.tolist(), stop.tolist()):
        runs.setdefault((kind, whole[places[x] : places[x] + y - x + LENGTH - 1].tobytes()), []).append((x, y))
    pack: list[tuple[int, bytes]] = []
    size = 0

    def order():
        strings = [t for _, t in pack]
        low = [min(docs[owner[x]] for x, _ in runs[k]) for k in pack]
        for k, values in zip(pack, least_by_window(strings, low)):
            for x, y in runs[k]:
                least[x:y] = values

    for k in runs:
        if pack and size > ordered and k[0] != pack[-1][0]:
            order()
            pack, size = [], 0
        pack.append(k)
        size += len(k[1])
    if pack:
        order()
    return np.split(least, np.cumsum(counts)[:-1])


def _least(table: pa.Table, ordered: int) -> pa.Table:
    """chunk, content, check, value, counts and windows binary: of one bucket, each chunk's segments that a smaller document shares.

    value is the least doc_id of a segment's windows. Where they differ, counts has their number, else 0,
    and windows the least doc_id of each.
    """
    chunk = table["chunk"].to_pylist()
    own = [np.frombuffer(x, U64) for x in table["anchor"].to_pylist()]
    number, anchor = np.repeat(np.arange(len(chunk)), [len(x) for x in own]), np.concatenate(own)
    heads, strings = [], []
    for x, packed in zip(own, table["data"].to_pylist()):
        packed = _restore(packed)
        heads.append(np.frombuffer(packed, "<i8", 3 * len(x)).reshape(3, -1))
        strings.append(packed[24 * len(x) :])
    low, high, sizes = np.concatenate(heads, axis=1)
    data = b"".join(strings)
    del own, heads, strings
    place = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    content, check = (string_hashes(np.frombuffer(data, np.uint8), place, sizes, x) for x in (False, True))
    del table
    order, new = _distinct(anchor, content, check)
    a, c = anchor[order], content[order]
    least = np.minimum.reduceat(low[order], new)
    kind = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    windows: dict[int, np.ndarray] = {}
    heads = a[new]
    group = np.flatnonzero(np.concatenate(([True], heads[1:] != heads[:-1])))
    several = np.repeat(np.diff(np.append(group, len(new))) > 1, np.diff(np.append(group, len(new))))
    several = np.flatnonzero(several)
    if len(several):
        ones = order[new[several]]
        strings = [data[p : p + n] for p, n in zip(place[ones].tolist(), sizes[ones].tolist())]
        for k, found in zip(several.tolist(), _classes(strings, least[several].tolist(), heads[several], ordered)):
            least[k] = found.min()
            if not (found == found[0]).all():
                windows[k] = found
    tell = least[kind] < high[order]
    out = {"chunk": [], "content": [], "check": [], "value": [], "counts": [], "windows": []}
    by = np.argsort(number[order], kind="stable")
    by = by[tell[by]]
    check = check[order]
    for own in np.split(by, np.flatnonzero(np.diff(number[order][by])) + 1):
        if len(own):
            k = kind[own]
            own_windows = [windows.get(x) for x in k.tolist()]
            out["chunk"].append(chunk[number[order][own[0]]])
            out["content"].append(c[own].tobytes())
            out["check"].append(check[own].tobytes())
            out["value"].append(least[k].astype("<i8").tobytes())
            out["counts"].append(np.array([0 if w is None else len(w) for w in own_windows], "<i8").tobytes())
            out["windows"].append(b"".join(w.astype("<i8").tobytes() for w in own_windows if w is not None))
    return pa.table({n: pa.array(v, pa.string() if n == "chunk" else pa.binary()) for n, v in out.items()})


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


_ANSWERS = ("content", "check", "value", "counts", "windows", "hot")


def _cut(chunks: DataFrame, least: DataFrame, with_kept: bool) -> DataFrame:
    told = least.groupBy("chunk").agg(*(F.collect_list(c).alias(c) for c in _ANSWERS))
    asked = chunks.join(told, "chunk", "left").select("doc_ids", "sizes", "texts", *_ANSWERS)

    def run(batches):
        for batch in batches:
            for doc_ids, sizes, texts, *answers in zip(*(c.to_pylist() for c in batch.columns)):
                ids, texts = _open(doc_ids, sizes, texts)
                start = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
                edges = np.zeros(start[-1] + 1, np.int32)
                content, check, value, counts, windows, hot = (np.frombuffer(b"".join(x or ()), t) for x, t in zip(answers, (U64, U64, "<i8", "<i8", "<i8", U64)))
                if len(content):
                    order, first_of = np.lexsort((check, content)), np.cumsum(counts) - counts
                    known, proof = content[order], check[order]
                    for block in _pieces(texts):
                        s = Segments(block, hot)
                        at = np.minimum(np.searchsorted(known, s.content), len(known) - 1)
                        # Strings that share the first 64 bits stand in a row.
                        while True:
                            on = (known[at] == s.content) & (proof[at] < s.check) & (at + 1 < len(known))
                            if not on.any():
                                break
                            at[on] += 1
                        hit = (known[at] == s.content) & (proof[at] == s.check)
                        at = order[at]
                        hit = np.flatnonzero(hit & (value[at] < ids[s.doc]))
                        at, place = at[hit], start[s.doc[hit]] + s.window[hit]
                        alike = counts[at] == 0
                        np.add.at(edges, place[alike], 1)
                        np.add.at(edges, place[alike] + s.count[hit][alike] + LENGTH - 1, -1)
                        for k, p, d in zip(at[~alike].tolist(), place[~alike].tolist(), ids[s.doc[hit][~alike]].tolist()):
                            below = p + np.flatnonzero(windows[first_of[k] : first_of[k] + counts[k]] < d)
                            edges[below] += 1
                            edges[below + LENGTH] -= 1
                gone = np.cumsum(edges[:-1], dtype=np.int32) > 0
                rows = []
                for doc_id, text, a, b in zip(ids.tolist(), texts, start.tolist(), start[1:].tolist()):
                    cut = gone[a:b]
                    n = int(cut.sum())
                    kept = np.frombuffer(text, np.uint8)[~cut].tobytes() if n else text
                    spans = int((cut[1:] & ~cut[:-1]).sum()) + int(cut[0]) if n else 0
                    rows.append((doc_id, len(text), n, spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_kept else [])))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string(), pa.binary()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    return asked.mapInArrow(run, _OUT + ", kept binary" * with_kept)


def remove_repeats(docs: DataFrame, with_kept: bool = False, most: int = HOT, few: int = FEW, ordered: int = ORDERED) -> DataFrame:
    """Each document without the bytes that a smaller document has: doc_id, n_bytes, n_removed, n_spans long,
    kept_sha256 string, and with_kept the remaining bytes.

    Texts are UTF-8 bytes (null: empty); windows are judged on the input and never cross documents. Rows with
    a null doc_id are left out; rows that share a doc_id don't cut each other. Texts under LENGTH bytes lose
    nothing. Other columns are ignored; an empty table gives no rows. most, few and ordered decide how the work
    is dealt, not the result.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    # Bucketed by chunk in the shared folder: joins by chunk shuffle the answers only.
    name = f"orbiton_chunks_{uuid.uuid4().hex}"
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (4 * CHUNK_BYTES)))
    path = f"{shared_dir(spark)}/orbiton/{name}"
    _chunks(docs).write.format("parquet").bucketBy(parts, "chunk").option("compression", "uncompressed").option("path", path).saveAsTable(name)
    chunks = spark.table(name)
    buckets = max(12, -(-total // BUCKET_BYTES))
    sent = _anchors(chunks, buckets, few)
    anchors = spool(sent.groupBy("bucket").applyInArrow(lambda t: _repeated(t, most), "chunk string, anchors binary, hot binary"), "uncompressed")
    del sent
    free_shuffles(spark)
    segments = _segments(chunks, anchors, buckets)
    least = spool(segments.groupBy("bucket").applyInArrow(lambda t: _least(t, ordered), "chunk string, " + ", ".join(f"{c} binary" for c in _ANSWERS[:-1])))
    del segments
    free_shuffles(spark)
    hot = anchors.where("length(hot) > 0").select("chunk", *(F.lit(None).cast("binary").alias(c) for c in _ANSWERS[:-1]), "hot")
    out = spool(_cut(chunks, least.withColumn("hot", F.lit(None).cast("binary")).unionByName(hot), with_kept))
    spark.sql(f"DROP TABLE {name}")
    drop_spool(anchors, least)
    delete(spark, path)
    return out
