"""Quality rules with risk-controlled thresholds (operator 6).

Each rule scores a document's risk in [0, 1]. Per stratum and rule a ladder of cutoffs is walked from
the mildest to the strictest. A cutoff is certified while the exact (Clopper-Pearson) upper bound of
its false-rejection rate, from the labelled good documents of the stratum, stays within the risk. The
walk stops at the first cutoff that fails (fixed-sequence testing needs no correction along a ladder);
the error probability is divided by the number of rules and strata (Bonferroni), and the risk by the
number of rules, so that all rules together falsely reject at most `risk` of a stratum's good
documents with probability 1 - `delta`, over all strata at once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Words, blocks, encoded, small_batches, spool

#: Scores are counted in STEPS equal steps; rung j of a ladder rejects scores above 1 - (j + 1) / STEPS.
STEPS = 50
#: Rungs of a ladder: the candidates for a rule's cutoff are 0.98, 0.96, ..., 0.06. Which of them is taken is
#: for the labels alone to say. Scores under the last are those of ordinary prose, and no candidate is among them.
RUNGS = 47
RULES = ("symbols", "punctuation", "shouting", "repeated_lines", "repeated_words")

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_PUNCT = np.zeros(256, np.uint8)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = 1
_UPPER = np.zeros(256, np.uint8)
_UPPER[65:91] = 1

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punct", "n_upper")
FEATURES = ", ".join(f"{c} long" for c in _COUNTS)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def counts(rows: list[bytes]) -> dict[str, np.ndarray]:
    """The base counts of a block of texts."""
    w = Words(rows)
    n = len(rows)
    out = {"n_words": np.diff(w.bounds), "word_chars": _sums(~w.space & ((w.buf & 0xC0) != 0x80), w.offsets), "n_symbols": _sums(_SYMBOL[w.buf], w.offsets), "n_punct": _sums(_PUNCT[w.buf], w.offsets), "n_upper": _sums(_UPPER[w.buf], w.offsets)}
    hashes, at = w.windows(5)
    doc = np.searchsorted(w.bounds, at, side="right") - 1
    salted = hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(salted)
    ranked = salted[order]
    same = ranked[1:] == ranked[:-1]
    often = np.zeros(len(at), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    edge = np.zeros(len(w.hash) + 6, np.int64)
    first = at[often]
    np.add.at(edge, first, 1)
    np.add.at(edge, first + 5, -1)
    out["n_repeat_words"] = _sums(np.cumsum(edge)[: len(w.hash)] > 0, w.bounds)
    lines, repeats = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(rows):
        full = [x for x in text.split(b"\n") if x and not x.isspace()]
        lines[i], repeats[i] = len(full), len(full) - len(set(full))
    return out | {"n_lines": lines, "n_dup_lines": repeats}


def base_failed(c):
    """The fixed rule: fewer than 10 words, or over a fifth of them in repeated windows."""
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def steps(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """By rule, how many cutoffs of the ladder reject a document (0 to STEPS)."""
    chars, words, lines = (np.maximum(1, c[k]) for k in ("word_chars", "n_words", "n_lines"))
    score = {"symbols": c["n_symbols"] / chars, "punctuation": c["n_punct"] / chars, "shouting": c["n_upper"] / chars, "repeated_lines": c["n_dup_lines"] / lines, "repeated_words": c["n_repeat_words"] / words}
    # Cutoff j rejects scores over 1 - (j + 1) / STEPS, so the mildest that rejects a score is the first j beyond (1 - score) * STEPS - 1.
    return {r: STEPS - np.clip(np.floor((1 - np.minimum(1, score[r])) * STEPS + 1e-9), 0, STEPS).astype(np.int64) for r in RULES}


def measure(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """docs' columns keep with the base counts and each rule's steps of every whole text (null: empty)."""
    small_batches(docs.sparkSession)
    shape = docs.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape) + f", {FEATURES}, " + ", ".join(f"step_{r} long" for r in RULES)

    def run(batches):
        for batch in batches:
            rows = encoded(batch.column(len(keep)))
            for a, b in blocks(rows):
                c = counts(rows[a:b])
                s = steps(c)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), *(pa.array(c[k], pa.int64()) for k in _COUNTS), *(pa.array(s[r], pa.int64()) for r in RULES)], [*keep, *_COUNTS, *(f"step_{r}" for r in RULES)])

    return docs.select(*keep, text_col).mapInArrow(run, ddl)


def upper_bound(failures: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which `failures` of n or fewer still has probability delta."""
    if failures >= n:
        return 1.0
    low, high = failures / n, 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(failures + 1)]
    for _ in range(60):
        p = (low + high) / 2
        tail = math.fsum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs)) if 0 < p < 1 else float(p <= 0)
        low, high = (p, high) if tail > delta else (low, p)
    return high


def certify(good: dict[str, list[int]], risk: float, delta: float, n_tests: int) -> dict[str, int]:
    """By rule, the strictest certified rung of one stratum (0: the rule is off).

    good[rule][s]: labelled good documents that exactly s rungs reject.
    """
    out = {}
    for rule, by_steps in good.items():
        n, rejected, best = sum(by_steps), 0, 0
        most = math.floor(n * risk / len(good))
        for rung in range(RUNGS):
            # Rung j rejects documents with at least STEPS - j steps.
            rejected += by_steps[STEPS - rung]
            if not n or rejected > most or upper_bound(rejected, n, delta / n_tests) > risk / len(good):
                break
            best = rung + 1
        out[rule] = best
    return out


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Rows (stratum, rule columns rung_<rule> int): the certified rungs.

    labels (doc_id, quality 0/1): all of them are the holdout; the rules have no fitted part. A document
    counts as good if every label it has is 1; labels of unknown documents and null labels don't count.
    Counts by (stratum, rule, step) are summed in the cluster, at most STEPS + 1 rows for each pair, and
    certified a stratum at a time. A null stratum is a stratum of its own. Documents that fail the base
    rule are rejected anyway and don't enter.
    """
    verdict = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1").select("doc_id")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    good = measured.where(~failed).join(verdict, "doc_id", "left_semi")
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"step_{r}").alias("step")) for r in RULES)))
    table = spool(good.select(F.col(stratum).alias("stratum"), pairs.alias("p")).groupBy("stratum", "p.rule", "p.step").agg(F.count(F.lit(1)).alias("n")))
    n_tests = max(1, table.select("stratum").distinct().count()) * len(RULES)

    def run(key, pdf):
        import pandas as pd

        seen = {r: [0] * (STEPS + 1) for r in RULES}
        for rule, step, n in zip(pdf["rule"], pdf["step"], pdf["n"]):
            seen[rule][step] += int(n)
        rungs = certify(seen, risk, delta, n_tests)
        return pd.DataFrame({"stratum": [key[0]], **{f"rung_{r}": [rungs[r]] for r in RULES}})

    kind = table.schema["stratum"].dataType.simpleString()
    return spool(table.groupBy("stratum").applyInPandas(run, f"stratum {kind}, " + ", ".join(f"rung_{r} int" for r in RULES)))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Verdict of each document: doc_id, stratum, the base counts, base_failed and kept boolean.

    A null or empty text has no words and fails the base rule. Strata without enough labelled good
    documents certify nothing and lose no document to a learned threshold. Repeated rows are judged each
    for itself, alike; other columns of docs are ignored; empty docs or labels give no rows or no
    learned rejection.
    """
    measured = spool(measure(docs, ("doc_id", stratum)))
    cuts = thresholds(measured, labels, stratum, risk, delta)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    risky = F.lit(False)
    for r in RULES:
        rung = F.coalesce(F.col(f"rung_{r}"), F.lit(0))
        risky = risky | (F.col(f"step_{r}") > STEPS - rung)
    joined = measured.join(cuts, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    return joined.select("doc_id", F.col(stratum), *_COUNTS, failed.alias("base_failed"), (~failed & ~risky).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The rows of docs, all columns as they are, that judge() keeps.

    The texts aren't shuffled: the thresholds, one row for each stratum, go to a second pass over docs.
    Null and empty texts fail the base rule and go; repeated rows are kept or go alike, and so do rows with a
    null doc_id, which no label names; a null stratum is one of its own; columns of any name are kept; empty
    docs give no rows, empty labels certify no rule.
    """
    measured = spool(measure(docs, ("doc_id", stratum)))
    cuts = {r["stratum"]: {k: r[f"rung_{k}"] for k in RULES} for r in thresholds(measured, labels, stratum, risk, delta).collect()}
    names = docs.columns
    text_at, stratum_at = names.index("text"), names.index(stratum)

    def run(batches):
        for batch in batches:
            rows, strata = encoded(batch.column(text_at)), batch.column(stratum_at).to_pylist()
            keep = np.zeros(len(rows), bool)
            for a, b in blocks(rows):
                c = counts(rows[a:b])
                bad = base_failed(c)
                for r, s in steps(c).items():
                    bad |= s > STEPS - np.array([cuts[x][r] if x in cuts else 0 for x in strata[a:b]], np.int64)
                keep[a:b] = ~bad
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
