"""Language ID by a string kernel (operator 8).

The kernel of two texts blends, over n-gram lengths, how many distinct n-grams they share, each length
normalised by the geometric mean of their numbers (a presence kernel). Landmark texts give a Nystroem
feature map K(x, landmarks) K(landmarks, landmarks)^-1/2; on it one-versus-rest kernel ridge regression is
solved in closed form. Prediction is two matrix products for each block of texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import small_batches, spool

#: Hash buckets of the n-grams of 1, 2 and 3 code points, and the weight of each length in the blend.
BUCKETS = (512, 4096, 8192)
BLEND = (0.2, 0.3, 0.5)
#: Labelled texts of each language that the model is fitted on, those of the least id hashes, and landmarks of them.
PER_LANGUAGE, LANDMARKS = 400, 40
#: Longer labelled texts aren't fitted on (they are predicted whole like any other).
LONGEST_FITTED = 20_000
#: Parts in which a language's rows are ranked before the best of all parts meet.
SALTS = 32
RIDGE = 1e-2

_STARTS = np.cumsum((0, *BUCKETS))
_LETTER = re.compile(r"[^\W\d_]")


def presence(texts: list[str]) -> np.ndarray:
    """One row for each text: 1 for each bucket that an n-gram of the whole text falls into, lower-cased."""
    out = np.zeros((len(texts), _STARTS[-1]), np.uint8)
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in lowered])
    h = np.zeros(len(codes), np.uint32)
    for n, size in enumerate(BUCKETS, 1):
        if len(codes) < n:
            break
        m = len(codes) - n + 1
        h = (h[:m] * np.uint32(0x01000193)) ^ (codes[n - 1 :] * np.uint32(0x9E3779B1))
        bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(16)).astype(np.int64) * size >> 16
        same = owner[:m] == owner[n - 1 :]
        out[owner[:m][same], _STARTS[n - 1] + bucket[same]] = 1
    return out


def embedded(rows: np.ndarray) -> np.ndarray:
    """Rows whose dot products are kernel values."""
    out = rows.astype(np.float32)
    for i, weight in enumerate(BLEND):
        part = out[:, _STARTS[i] : _STARTS[i + 1]]
        part *= np.sqrt(weight / np.maximum(1, part.sum(axis=1)))[:, None]
    return out


@dataclass(frozen=True)
class Model:
    """languages in order; scores of a text are K(text, landmarks) @ coefficients."""

    languages: tuple[str, ...]
    landmarks: np.ndarray
    coefficients: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: `und` and 0 where it is null or has no letter."""
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if not known or not self.languages:
            return names, scores
        found = embedded(presence([texts[i] for i in known])) @ self.landmarks.T @ self.coefficients
        best = found.argmax(axis=1)
        e = np.exp(4 * (found - found.max(axis=1, keepdims=True)))
        share = e[np.arange(len(known)), best] / e.sum(axis=1)
        for i, b, s in zip(known, best.tolist(), share.tolist()):
            names[i], scores[i] = self.languages[b], s
        return names, scores


def fit_rows(labels: list[str], rows: np.ndarray) -> Model:
    """The model of labelled presence rows; the first LANDMARKS rows of each language are landmarks."""
    languages = tuple(sorted(set(labels)))
    if not languages:
        return Model((), np.empty((0, _STARTS[-1]), np.float32), np.empty((0, 0), np.float32))
    names = np.array(labels)
    x = embedded(rows)
    marks = np.concatenate([np.flatnonzero(names == c)[:LANDMARKS] for c in languages])
    z = x[marks]
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = (x @ z.T).astype(np.float64) @ root
    target = np.where(names[:, None] == np.array(languages), 1.0, -1.0)
    # Each language weighs alike, however many rows it has.
    weight = 1.0 / np.array([(names == c).sum() for c in labels])
    ridge = (phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1])
    solved = np.linalg.solve(ridge, (phi * weight[:, None]).T @ target)
    return Model(languages, z, (root @ solved).astype(np.float32))


def fit(labelled: DataFrame) -> Model:
    """Fit on (doc_id, text, lang): of each language the PER_LANGUAGE texts of the least id hashes, up to LONGEST_FITTED.

    Null texts, languages and ids aren't fitted on, repeated rows once. The rows that come to the driver are
    hashed bits, at most PER_LANGUAGE for each language.
    """
    usable = labelled.where("lang is not null and doc_id is not null and length(text) between 1 and " + str(LONGEST_FITTED)).select("lang", "text", F.xxhash64("doc_id").alias("_h"), F.xxhash64("text").alias("_t"))
    # Rows are chosen by their hashes, first in SALTS parts of each language; only the chosen ones' texts are sent.
    keys = usable.select("lang", "_h", "_t")
    part, order = (F.pmod(F.col("_h"), F.lit(SALTS)),), ("_h", "_t")
    for by in (("lang", *part), ("lang",)):
        keys = keys.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= PER_LANGUAGE)
    chosen = spool(keys.groupBy("lang", "_h", "_t").agg(F.min("_r").alias("_r")))
    chosen = usable.join(chosen, ["lang", "_h", "_t"]).dropDuplicates(["lang", "_h", "_t"])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                rows = np.packbits(presence(batch.column(2).slice(i, 128).to_pylist()), axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 128), batch.column(1).slice(i, 128), pa.array([r.tobytes() for r in rows], pa.binary())], ["lang", "_r", "bits"])

    found = sorted(chosen.select("lang", "_r", "text").mapInArrow(run, "lang string, _r int, bits binary").collect(), key=lambda r: (r["lang"], r["_r"]))
    if not found:
        return fit_rows([], np.empty((0, _STARTS[-1]), np.uint8))
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in found), np.uint8).reshape(len(found), -1)
    return fit_rows([r["lang"] for r in found], np.unpackbits(bits, axis=1, count=_STARTS[-1]))


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns keep with lang_pred string and score double of every whole text."""
    shape = docs.select(*keep).schema
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            first = size = 0
            for i in range(len(texts) + 1):
                if i == len(texts) or i - first >= 256 or size > 2_000_000:
                    if i > first:
                        names, scores = held.value.predict(texts[first:i])
                        yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, i - first) for k in range(len(keep))), pa.array(names), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])
                    first, size = i, 0
                if i < len(texts):
                    size += len(texts[i] or "")

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape) + ", lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out boolean, lang_pred string, score double of every row of docs.

    held_out says crc32(doc_id as text) mod 5 is 0 (a null doc_id is not held out and not fitted on); the
    model is fitted on the other rows with a language. lang, source and doc_id are no inputs of a prediction.
    Without any fitted row all is `und` with score 0. Repeated rows are predicted each, alike; other columns
    are ignored.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = fit(docs.where(~held))
    return predict(docs.withColumn("_held", held), model, ("doc_id", "_held")).withColumnRenamed("_held", "held_out").select("doc_id", "held_out", "lang_pred", "score")
