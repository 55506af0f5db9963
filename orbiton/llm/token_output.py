"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding (operator 5).

File format. A written corpus is a folder with two tables.

`segments`: part int, seq int, first long (ids before this segment within its part), n long (its ids),
ids_of binary (doc ids, little-endian signed 64-bit), lengths binary (ids of each document, little-endian unsigned
32-bit), control binary, data binary. By (part, seq) the documents ascend by id. Each token id is first
replaced by its rank by corpus frequency (most frequent 0; ties by id), then written as the 1 to 4 low
bytes that its rank needs into `data`; `control` holds each length less one in two bits, four to a byte,
low bits first.

`ranks`: one row, id_of binary: the token id of each rank, little-endian unsigned 32-bit.

A segment is closed at SEGMENT_IDS ids, so a reader holds one segment, and a lost task is one segment
file to write anew under the writer's commit protocol.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import drop_spool, shared_dir, small_batches, spool
from .pretokens import PieceEncoder, text_blocks

SEGMENT_IDS = 1 << 18

_LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    n = len(v)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    width = 2 if not n or v.max() <= 0xFFFF else 4
    keep = np.empty((n, width), bool)
    keep[:, 0] = True
    for i in range(1, width):
        keep[:, i] = v > (1 << 8 * i) - 1
        codes[:n] += keep[:, i]
    # Four codes lie in the bytes of a word; shifted, they meet in its lowest byte.
    four = codes.view("<u4")
    control = (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8)
    return control.tobytes(), v.astype(f"<u{width}").view(np.uint8).reshape(-1, width)[keep].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that pack() coded, by one table lookup of their lengths."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    width = 2 if not n or size.max() <= 2 else 4
    keep = np.empty((n, width), bool)
    keep[:, 0] = True
    for i in range(1, width):
        keep[:, i] = size > i
    out = np.zeros((n, width), np.uint8)
    out[keep] = np.frombuffer(data, np.uint8)
    return out.view(f"<u{width}").reshape(-1).astype("<u4", copy=False)


def _load(path: str, pattern: str, added_tokens: bool) -> PieceEncoder:
    import regex
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added_tokens
    added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values()) if added_tokens else ()
    bytes_of = lambda e: array("I", e.ids).tobytes()

    # The library's model takes a pre-token with each byte as one visible character: those of Latin-1 that
    # are visible stand for themselves, the others follow from U+0100 on.
    visible = [*range(33, 127), *range(161, 173), *range(174, 255)]
    shown = np.zeros(256, "<u2")
    shown[visible] = visible
    # 0xFF is in no UTF-8 text; shown as zero it stands between pre-tokens.
    hidden = np.setdiff1d(np.arange(256), visible)
    shown[hidden], shown[255] = 256 + np.arange(len(hidden)), 0
    tokenize = tokenizer.model.tokenize

    def encode_words(words: list[str]) -> list[bytes]:
        seen = shown[np.frombuffer(b"\xff".join([w.encode() for w in words]), np.uint8)].tobytes().decode("utf-16-le")
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in seen.split("\0")] if words else []

    # Texts with characters that pattern engines may class differently go to the library whole, and so do
    # those with an added token, which the library cuts out before it looks for pre-tokens.
    return PieceEncoder(pattern, regex.compile(pattern).findall, encode_words, lambda x: bytes_of(tokenizer.encode(x, add_special_tokens=False)), added=added)


_encoders: dict[tuple[str, str, bool], PieceEncoder] = {}


def encoder(path: str, pattern: str, added_tokens: bool = False) -> PieceEncoder:
    """One encoder by a tokenizers file for each worker; ids are unsigned 32-bit."""
    if (path, pattern, added_tokens) not in _encoders:
        _encoders[path, pattern, added_tokens] = _load(path, pattern, added_tokens)
    return _encoders[path, pattern, added_tokens]


_RAW = "part int, seq int, first long, n long, ids_of binary, lengths binary, ids binary, counts binary"


def _encode_sorted(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, vocabulary: int, added_tokens: bool) -> DataFrame:
    """Segments of plain ids; the documents ascend by (part, seq) and within a segment. A part's last row holds no ids, but counts of each id."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc, part, seq, first = encoder(tokenizer_path, pattern, added_tokens), TaskContext.get().partitionId(), 0, 0
        counts = np.zeros(vocabulary, np.int64)

        def row(n, keys, lengths, ids, counted=None):
            values = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), *(pa.array([x], pa.binary()) for x in (keys, lengths, ids, counted))]
            return pa.RecordBatch.from_arrays(values, ["part", "seq", "first", "n", "ids_of", "lengths", "ids", "counts"])

        texts = ((key, x or "") for batch in batches for key, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        for keys, block in text_blocks(texts):
            ids, lengths = enc.encode(block, end)
            counts += np.bincount(ids, minlength=vocabulary)
            stop = np.cumsum(lengths)
            keys, a = np.array(keys, "<i8"), 0
            while a < len(keys):
                # Documents up to the one that reaches SEGMENT_IDS.
                low = int(stop[a] - lengths[a])
                b = min(len(keys), int(np.searchsorted(stop, low + SEGMENT_IDS)) + 1)
                n = int(stop[b - 1]) - low
                yield row(n, keys[a:b].tobytes(), lengths[a:b].astype("<u4").tobytes(), ids[low : low + n].astype(kind).tobytes())
                seq, first, a = seq + 1, first + n, b
        if seq:
            yield row(0, b"", b"", b"", counts.tobytes())

    key = F.col("doc_id")
    return docs.select("doc_id", "text").where(key.isNotNull()).repartitionByRange(key).sortWithinPartitions("doc_id", "text").mapInArrow(run, _RAW)


def _rank_order(raw: DataFrame, size: int) -> np.ndarray:
    """Token ids by falling corpus count, ties by id; the counts come to the driver, one for each id of the vocabulary."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for counts in batch.column(0):
                total += np.frombuffer(counts.as_buffer(), np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    total = np.zeros(size, np.int64)
    for r in raw.select("counts").where("counts is not null").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        total[r.id] = r.n
    return np.argsort(-total, kind="stable").astype("<u4")


def write_token_corpus(docs: DataFrame, path: str, tokenizer_path: str, pattern: str, end_id: int, vocabulary: int, added_tokens: bool = False) -> str:
    """Encode every whole text of docs (doc_id, text), append end_id to each, write the corpus to path.

    A null or empty text is the end id alone. Rows with a null doc_id have no place in the order and are
    left out. Repeated rows are written as often as they come. Other columns are ignored; an empty table
    writes an empty corpus. One shuffle, by doc_id range. With added_tokens the tokenizer's added tokens, where
    a text spells them out, get their own ids, as by the library's encode; without, they are text as any other.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    raw = spool(_encode_sorted(docs, tokenizer_path, pattern, end_id, vocabulary, added_tokens), "zstd")
    order = _rank_order(raw, vocabulary)
    rank_of = np.empty(vocabulary, "<u4")
    rank_of[order] = np.arange(vocabulary, dtype="<u4")
    ranks, kind = spark.sparkContext.broadcast(rank_of), "<u2" if vocabulary <= 1 << 16 else "<u4"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                control, data = pack(ranks.value[np.frombuffer(batch.column(6)[i].as_buffer(), kind)])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(6)), pa.array([control], pa.binary()), pa.array([data], pa.binary())], ["part", "seq", "first", "n", "ids_of", "lengths", "control", "data"])

    raw.where("counts is null").drop("counts").mapInArrow(run, "part int, seq int, first long, n long, ids_of binary, lengths binary, control binary, data binary").write.option("compression", "uncompressed").parquet(f"{path}/segments")
    spark.createDataFrame([(bytearray(order.tobytes()),)], "id_of binary").coalesce(1).write.parquet(f"{path}/ranks")
    drop_spool(raw)
    return path


def read_token_corpus(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of a written corpus: doc_id, start long (ids of all documents before), n_tokens long,
    ids_crc32 long, and with_ids ids array<int>."""
    order = spark.sparkContext.broadcast(np.frombuffer(spark.read.parquet(f"{path}/ranks").first().id_of, "<u4"))
    segments = spark.read.parquet(f"{path}/segments")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, first, keys, lengths, control, data = (batch.column(k)[i].as_py() for k in range(6))
                n = np.frombuffer(lengths, "<u4").astype(np.int64)
                ids = order.value[unpack(control, data, int(n.sum()))]
                at = np.concatenate(([0], np.cumsum(n)))
                view = memoryview(ids.tobytes())
                columns = [pa.array([part] * len(n), pa.int32()), pa.array(np.frombuffer(keys, "<i8")), pa.array(first + at[:-1]), pa.array(n), pa.array([zlib.crc32(view[a * 4 : b * 4]) for a, b in zip(at, at[1:])], pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "within", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    found = segments.select("part", "first", "ids_of", "lengths", "control", "data").mapInArrow(run, "part int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    # One row for each part: what all earlier parts hold.
    sizes = segments.groupBy("part").agg(F.sum("n").alias("n"))
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return found.join(base, "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_corpus(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, vocabulary: int, path: str | None = None, added_tokens: bool = False) -> DataFrame:
    """Write docs as a token corpus, by default in the shared folder, and read it back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/orbiton/{uuid.uuid4().hex}"
    return read_token_corpus(spark, write_token_corpus(docs, path, tokenizer_path, pattern, end_id, vocabulary, added_tokens))
