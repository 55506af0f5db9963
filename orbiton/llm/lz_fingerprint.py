"""Lempel-Ziv phrase fingerprints (operator 4).

A text's UTF-8 bytes are parsed into LZ78 phrases: each phrase is the shortest string that is no phrase
yet. The phrases' 64-bit hashes form a set; its SIGNATURE least 32-bit values are the fingerprint, and
the likeness of two fingerprints estimates the Jaccard similarity of the phrase sets (exactly, where
both sets are that small).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import _BASE, _LETTERS, U64, _power_table, mix64, small_batches, spool

SIGNATURE = 64


def parse(data: bytes, start: int, seen: set[bytes], phrases: list[bytes], ends: list[int]) -> None:
    """Append the phrases of data[start:] to seen, phrases and ends; a last piece that is a phrase already adds none.

    Phrases are closed under prefixes, so the match is found from the last match's length up or down.
    """
    n, k = len(data), 1
    while start < n:
        k = min(k, n - start)
        piece = data[start : start + k]
        if piece in seen:
            while True:
                k += 1
                if start + k > n:
                    return
                piece = data[start : start + k]
                if piece not in seen:
                    break
        else:
            while k > 1:
                shorter = data[start : start + k - 1]
                if shorter in seen:
                    break
                k -= 1
                piece = shorter
        seen.add(piece)
        phrases.append(piece)
        start += k
        ends.append(start)


def phrase_hashes(data: bytes, first: int, ends: list[int]) -> np.ndarray:
    """32-bit hashes of consecutive phrases of data from byte first."""
    if not ends:
        return np.empty(0, "<u4")
    bounds = np.array([first, *ends]) - first
    n = int(bounds[-1])
    up, down = _power_table("up", _BASE, n + 1), _power_table("down", pow(_BASE, -1, 1 << 64), n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(_LETTERS[np.frombuffer(data, np.uint8, n, first)] * up[:n], out=total[1:])
    a, b = bounds[:-1], bounds[1:]
    return (mix64((total[b] - total[a]) * down[a] + (b - a).astype(U64)) >> U64(32)).astype("<u4")


def signature(hashes: np.ndarray) -> bytes:
    """The least SIGNATURE distinct hashes, ascending."""
    h = np.partition(hashes, 2 * SIGNATURE)[: 2 * SIGNATURE] if len(hashes) > 2 * SIGNATURE else hashes
    h = np.unique(h)
    if len(h) < SIGNATURE < len(hashes):
        h = np.unique(hashes)
    return h[:SIGNATURE].astype("<u4").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Of two fingerprints, 0 to 1; two empty ones are alike."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    union = np.union1d(x, y)[:SIGNATURE]
    if not len(union):
        return 1.0
    both = np.intersect1d(x, y, assume_unique=True)
    return float((both <= union[-1]).sum() / len(union))


class Parsed:
    """A text with its phrases, fingerprint and place to branch off for an edited end."""

    def __init__(self, text: str):
        self.text, self.data = text, text.encode()
        self.phrases: list[bytes] = []
        self.ends: list[int] = []
        parse(self.data, 0, set(), self.phrases, self.ends)
        self.hashes = phrase_hashes(self.data, 0, self.ends)
        self.fingerprint = signature(self.hashes)

    def edited(self, following: str) -> tuple[bytes, bytes]:
        """Bytes and fingerprint of the text whose last third is replaced from the start of the following text.

        Phrases that end before the replaced part stay as they are; the parse goes on from there.
        """
        third = len(self.text) // 3
        if not third:
            return self.data, self.fingerprint
        kept = self.text[: len(self.text) - third].encode()
        data = kept + following[:third].encode()
        m = int(np.searchsorted(self.ends, len(kept), side="right")) if self.ends else 0
        start = self.ends[m - 1] if m else 0
        ends: list[int] = []
        parse(data, start, set(self.phrases[:m]), [], ends)
        return data, signature(np.concatenate((self.hashes[:m], phrase_hashes(data, start, ends))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_chars long, fingerprint binary. A null or empty text has an empty fingerprint."""

    def run(batches):
        for batch in batches:
            parsed = [Parsed(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p.text) for p in parsed], pa.int64()), pa.array([p.fingerprint for p in parsed], pa.binary())], [id_col, "n_chars", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_chars long, fingerprint binary")


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _row(doc_id, this: Parsed, after: Parsed) -> list:
    data, edited = this.edited(after.text)
    return [doc_id, len(this.text), hashlib.sha256(data).hexdigest(), this.fingerprint, edited, likeness(this.fingerprint, edited), likeness(this.fingerprint, after.fingerprint)]


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each whole text's fingerprint against its edited text's and the next document's.

    The next document has the next smaller doc_id (of the least: the greatest); rows that share a doc_id
    go by text, null doc_ids come last. Null texts are empty. One row for each row of docs; other columns
    are ignored; a single document is its own next; an empty table gives no rows.

    Documents are dealt by doc_id range in one shuffle and each partition is read in order, a document and
    its next at a time; the last document of a partition waits for the first of the next partition, two
    texts for each partition.
    """
    small_batches(docs.sparkSession)
    names = [*_COLUMNS, "part", "edge", "text"]

    def run(batches):
        part = TaskContext.get().partitionId()
        rows: list[list] = []
        before, first = None, True

        def out():
            columns = list(zip(*rows)) or [[]] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*_TYPES, pa.int32(), pa.string(), pa.string()])], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now = (doc_id, Parsed(text or ""))
                if before:
                    rows.append([*_row(*before, now[1]), part, "head" if first else None, before[1].text if first else None])
                    first = False
                before = now
                if len(rows) >= 1000:
                    yield out()
        if before:
            rows.append([before[0], *[None] * 6, part, "only" if first else "tail", before[1].text])
        yield out()

    key = F.col("doc_id").desc_nulls_last()
    ordered = docs.select("doc_id", "text").repartitionByRange(key).sortWithinPartitions(key, F.col("text").desc_nulls_last())
    found = spool(ordered.mapInArrow(run, _DDL + ", part int, edge string, text string"))
    edges = found.where("edge is not null").select("doc_id", "part", "edge", "text")
    heads = edges.where("edge in ('head', 'only')")
    order = Window.orderBy("part")
    follow = heads.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("next"))
    pairs = edges.where("edge in ('tail', 'only')").join(follow, "part").join(heads.select(F.col("part").alias("next"), F.col("text").alias("after")), "next").select("doc_id", "text", "after")

    def last(batches):
        for batch in batches:
            rows = [_row(d, Parsed(t or ""), Parsed(a or "")) for d, t, a in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(_TYPES), _TYPES)], _COLUMNS)

    return found.where("edge is null or edge = 'head'").select(*_COLUMNS).union(pairs.mapInArrow(last, _DDL))
