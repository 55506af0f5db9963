"""Shared pieces: the shared folder, written tables, and vectorised word hashing."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text that one numpy pass works on; bounds a worker's memory whatever the Arrow batch holds.
BLOCK_BYTES = 2 << 20
#: Documents in one Arrow batch.
BATCH_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a local session without one gets one here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Have Python workers get at most BATCH_ROWS documents at once, unless the session asks for fewer: their memory follows a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def spool(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orbiton/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spool_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of scratch."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_spool(*tables: DataFrame) -> None:
    """Delete tables that spool() wrote and nothing reads any more."""
    for df in tables:
        path = getattr(df, "_spool_path", None)
        if path:
            delete(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of finished steps; it does so once the JVM has collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place on a fresh array."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, base, U64)
        out[0] = 1
        _powers[name] = have = np.multiply.accumulate(out)
    return have


_rng = np.random.default_rng(20240229)
_LETTERS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a block of texts.

    buf: the UTF-8 bytes with a line feed after each text; start, end: byte bounds of each word;
    bounds: of text i, the words bounds[i]..bounds[i+1]; hash: 64 bits of each word.
    """

    def __init__(self, encoded: list[bytes], fold: bool = False):
        self.raw = b"\n".join(encoded) + b"\n"
        self.buf = buf = np.frombuffer(self.raw, np.uint8)
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        space = IS_SPACE[buf]
        self.space = space
        before = np.empty_like(space)
        before[0], before[1:] = True, space[:-1]
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(space & ~before)
        self.bounds = np.searchsorted(self.start, self.offsets)
        n = len(buf)
        up = _power_table("up", _BASE, n + 1)
        down = _power_table("down", pow(_BASE, -1, 1 << 64), n + 1)
        total = np.zeros(n + 1, U64)
        np.cumsum((_FOLDED if fold else _LETTERS)[buf] * up[:n], out=total[1:])
        self.hash = mix64((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words within a text, and the index of its first word."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, U64), np.empty(0, np.int64)
        h = self.hash
        out = h[:n].copy()
        for j in range(1, k):
            out *= U64(0xC2B2AE3D27D4EB4F)
            out += h[j : n + j]
        doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        ok = np.flatnonzero(doc[:n] == doc[k - 1 :])
        return mix64(out[ok]), ok


def encoded(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def blocks(rows: list[bytes], size: int = BLOCK_BYTES):
    """(first, last) index ranges of about size bytes; a longer text stands alone."""
    first = held = 0
    for i, x in enumerate(rows):
        if held and held + len(x) > size:
            yield first, i
            first, held = i, 0
        held += len(x) + 1
    if first < len(rows):
        yield first, len(rows)


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column is called so (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
