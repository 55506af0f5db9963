"""MinHash near-dedup: fast similarity sketching, banding, exact verification (operator 1).

Sketch: T coordinates are filled in rounds. In each of the first T rounds every element of the set is
hashed to one coordinate and a value; in round T + j every element goes to coordinate j, so that no
coordinate stays empty. A coordinate keeps the least (round, value). A document stops after the round
that fills its last coordinate, so a large set costs one or two hashes an element.

Search: the sketch is cut into bands; a band's values are a bucket. Equal sets are one node from the
start. In two star rounds one node of each bucket is compared with all others of it, and what links is
joined into components: first the least node, then the one with the least share of own shingles (those
no other node of an undecided bucket has), the middle of a group of near copies. Then pairs
of a bucket whose nodes are still in different components are compared, save those that counts rule out:
a node with too many own shingles has no links and is left out before any join; an intersection is at most what is left of either set without its own shingles, and at most the sum, over
hash groups of shingles, of the lesser number that either set has in the group. A bucket is thus compared in full
but for pairs that are joined or can't be links. Links are confirmed on full sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import U64, Words, blocks, drop_spool, encoded, free_shuffles, fresh, mix64, small_batches, spool

T = 128
#: Rows of a band. At similarity 0.8 a pair shares no band of 4 of 128 coordinates with probability under 1e-7.
BAND_ROWS = 4

#: Hash groups whose shingles are counted for the bound, seven to a long.
GROUPS = 63

#: Links that one task joins by itself; more are joined in rounds over the cluster.
ALONE = 400_000

_MAX = U64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(rows: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct 64-bit hashes of k-word shingles, A-Z folded; of fewer words, the whole sequence's."""
    out = []
    for a, b in blocks(rows):
        w = Words(rows[a:b], fold=True)
        hashes, first = w.windows(k)
        at = np.searchsorted(first, w.bounds)
        for i in range(b - a):
            n = w.bounds[i + 1] - w.bounds[i]
            if n >= k:
                out.append(np.unique(hashes[at[i] : at[i + 1]]))
            elif n:
                h = U64(n)
                for x in w.hash[w.bounds[i] : w.bounds[i + 1]]:
                    h = mix64(np.array([h ^ x]))[0]
                out.append(np.array([h], U64))
            else:
                out.append(np.empty(0, U64))
    return out


def sketch(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """One row of t coordinates for each set; of an empty set all are the largest value."""
    n = len(sets)
    out = np.full(n * t, _MAX, U64)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    items = np.concatenate(sets) if n else np.empty(0, U64)
    owner = np.repeat(np.arange(n), sizes)
    for r in range(2 * t):
        if not len(items):
            break
        h = mix64(items ^ U64((r + 1) * 0x9FB21C651E98DF25 & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> U64(32)) * U64(t) >> U64(32)).astype(np.int64) if r < t else r - t
        np.minimum.at(out, owner * t + bins, (h & U64(0xFFFFFFFF)) | U64(r << 32))
        open_ = (out.reshape(n, t) == _MAX).any(axis=1)
        keep = open_[owner]
        if not keep.all():
            items, owner = items[keep], owner[keep]
    return out.reshape(n, t)


def band_keys(sketches: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A 64-bit key for each band, its number mixed in."""
    n, t = sketches.shape
    parts = sketches.reshape(n, t // rows, rows)
    keys = np.broadcast_to(np.arange(t // rows, dtype=U64), (n, t // rows)).copy()
    for j in range(rows):
        keys = mix64(keys * U64(0xC2B2AE3D27D4EB4F) ^ parts[:, :, j])
    return keys


def _describe(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_id binary (of the whole set), bands array<long>; the latter null for empty sets."""

    def run(batches):
        for batch in batches:
            rows = encoded(batch.column(1))
            for a, b in blocks(rows):
                sets = shingle_sets(rows[a:b], k)
                keys = band_keys(sketch(sets)).view(np.int64)
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if f else None for s, f in zip(sets, full)], pa.binary()), pa.array([x if f else None for x, f in zip(keys, full)], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "bands"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, bands array<long>")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. Each text is sent once for each pair."""
    wide = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches):
        sets: dict[bytes, np.ndarray] = {}

        def of(text: bytes) -> np.ndarray:
            if text not in sets:
                if len(sets) > 64:
                    sets.clear()
                sets[text] = shingle_sets([text], k)[0]
            return sets[text]

        for batch in batches:
            a, b = encoded(batch.column(2)), encoded(batch.column(3))
            ok = []
            for x, y in zip(a, b):
                x, y = of(x), of(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return wide.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def group_counts(shingles: np.ndarray) -> list[int] | None:
    """How many shingles each hash group has, seven 8-bit counts to a long; None where one exceeds 127."""
    n = np.bincount((shingles % U64(GROUPS)).astype(np.int64), minlength=GROUPS)
    if n.max() > 127:
        return None
    return (n.reshape(-1, 7) << (8 * np.arange(7))).sum(axis=1).tolist()


def shared_at_most(x: Column, y: Column) -> Column:
    """The sum of the lesser counts of two group_counts(), lane by lane in whole longs.

    By functions of arrays, as written out for every long the code that Spark makes of it is very large.
    """
    high, even = F.lit(0x0080808080808080), F.lit(0x00FF00FF00FF00FF)

    def least(a: Column, b: Column) -> Column:
        # The high bit of a lane stays where a's count is not below b's; it widens to a mask of the lane.
        mask = F.shiftrightunsigned((a.bitwiseOR(high) - b).bitwiseAND(high), 7) * 255
        return a.bitwiseXOR(a.bitwiseXOR(b).bitwiseAND(mask))

    def lanes(t: Column) -> Column:
        lane = F.lit(0xFFFF)
        return t.bitwiseAND(lane) + F.shiftrightunsigned(t, 16).bitwiseAND(lane) + F.shiftrightunsigned(t, 32).bitwiseAND(lane) + F.shiftrightunsigned(t, 48)

    return F.aggregate(F.zip_with(x, y, least), F.lit(0).cast("long"), lambda t, low: t + low.bitwiseAND(even) + F.shiftrightunsigned(low, 8).bitwiseAND(even), lanes)


def _counted(nodes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(rep, own long, groups array<long>): shingles of a node that no other of the nodes has, and group_counts().

    Counted by shingle, in the cluster.
    """

    def run(batches):
        for batch in batches:
            sets = shingle_sets(encoded(batch.column(1)), k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([group_counts(x) for x in sets], pa.list_(pa.int64()))], ["rep", "shingles", "groups"])

    reps = nodes.select("rep").distinct()
    sets = spool(texts.select(F.col("doc_id").alias("rep"), "text").join(reps, "rep", "left_semi").mapInArrow(run, "rep long, shingles array<long>, groups array<long>"))
    single = sets.select("rep", F.explode("shingles").alias("x")).groupBy("x").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("c")).where("c = 1")
    own = single.groupBy("rep").agg(F.count(F.lit(1)).alias("own"))
    return spool(sets.select("rep", "groups").join(own, "rep", "left").fillna(0, ["own"]))


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct nodes of the edges (a, b), and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        # Of every edge between two trees, the greater root gets the lesser one above it.
        u, v = root[x], root[y]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root != root[root]).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[root]


def components(edges: DataFrame, alone: int = ALONE) -> DataFrame:
    """(node, component): the least node reachable, of every node with an edge.

    Up to alone edges (16 bytes each) are joined by one task, as rounds would only be many small jobs. More
    go through alternating large-star and small-star rounds over the edges (a, b), until nothing changes; each
    round is a written table. No key gathers its neighbours: both rounds take a minimum by key and
    join it back.
    """
    if edges.count() <= alone:

        def run(batches):
            held = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
            found = least_reachable(*np.concatenate([np.empty((2, 0), np.int64), *held], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["node", "component"])

        return edges.where("a <> b").select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")
    edges = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = spool(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        after = spool(small)
        drop_spool(edges, large)
        edges = after
        s = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (s.n, s.h):
            break
        mark = (s.n, s.h)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Component of each document: doc_id, n_shingles long, component_id long, kept boolean, n_equal long.

    Documents are linked with 100 * intersection >= percent * union of their shingle sets; component_id is
    the least doc_id reachable over links, itself included; kept says doc_id = component_id; n_equal counts
    the documents with the same set. Null and empty texts, and texts without words, have the empty set and
    no links. Rows with a null doc_id are left out. Rows that repeat a doc_id with different texts are
    described row by row, but links are confirmed on one of the texts. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    info = spool(_describe(docs, shingle))
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    if info.groupBy("doc_id").count().where("count > 1").limit(1).count():
        texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    classes = info.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_equal"))
    nodes = info.join(classes, "set_id").where("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), "bands").dropDuplicates(["rep"])
    placed = nodes.select("rep", "n", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("bucket")
    placed = spool(placed.join(shared, "bucket", "left_semi"))
    free_shuffles(docs.sparkSession)
    links, seen, comp = None, None, None

    def undecided() -> DataFrame:
        """Rows of buckets whose nodes are in several components."""
        if comp is None:
            held = placed.withColumn("comp", F.col("rep"))
        else:
            held = placed.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
        mixed = held.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
        return spool(held.join(mixed, "bucket", "left_semi"))

    def compare(pairs: DataFrame) -> None:
        """Confirm pairs (a, b) that weren't compared yet and join what they link."""
        nonlocal links, seen, comp
        if seen is not None:
            pairs = pairs.join(seen, ["a", "b"], "left_anti")
        pairs = spool(pairs)
        if pairs.limit(1).count():
            found = spool(_linked(pairs, texts, shingle, percent))
            links = found if links is None else links.union(found)
            comp = spool(components(links))
        seen = pairs if seen is None else seen.union(pairs)
        free_shuffles(docs.sparkSession)

    def rename(df: DataFrame, *names: str) -> DataFrame:
        return df.select("bucket", *(F.col(c).alias(f"{c}2") for c in names))

    pair = F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")
    able = lambda most: 100 * most >= percent * (F.col("n") + F.col("n2") - most)
    least = placed.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("s")).select("bucket", "s.*")
    compare(placed.join(rename(least, "rep", "n"), "bucket").where((F.col("rep") != F.col("rep2")) & able(F.least("n", "n2"))).select(*pair).distinct())
    placed = undecided()
    facts = _counted(placed, texts, shingle)
    placed = placed.drop("comp")
    # A node whose own shingles are more than what may be missing has no links at all.
    alone = 100 * (F.col("n") - F.col("own")) < percent * F.col("n")
    middle = undecided().join(facts.select("rep", "own"), "rep").where(~alone)
    center = middle.groupBy("bucket").agg(F.min_by(F.struct("rep", "n", "own", "comp"), F.struct(F.col("own") / F.col("n"), "rep")).alias("s")).select("bucket", "s.*")
    most = F.least(F.col("n") - F.col("own"), F.col("n2") - F.col("own2"))
    compare(middle.join(rename(center, "rep", "n", "own", "comp"), "bucket").where((F.col("comp") != F.col("comp2")) & able(most)).select(*pair).distinct())
    last = spool(undecided().join(facts, "rep").where(~alone).join(nodes.select("rep", "bands"), "rep"))
    # A pair counts in the first bucket that its nodes share.
    first = F.col("bucket") == F.element_at(F.array_intersect("bands", "bands2"), 1)
    counts = F.coalesce(able(shared_at_most(F.col("groups"), F.col("groups2"))), F.lit(True))
    both = last.join(rename(last, "rep", "n", "own", "comp", "groups", "bands"), "bucket")
    compare(both.where((F.col("rep") > F.col("rep2")) & (F.col("comp") != F.col("comp2")) & able(most) & counts & first).select(*pair))
    base = info.select("doc_id", "n_shingles", "set_id").join(classes, "set_id", "left")
    if comp is not None:
        base = base.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        base = base.withColumn("component", F.lit(None).cast("long"))
    out = base.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"), F.coalesce("n_equal", F.lit(1).cast("long")).alias("n_equal"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"), "n_equal")


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, columns as they are, but those that near_duplicates() says another one stands for.

    Rows that share a doc_id are documents of their own, judged by their own texts and ordered by doc_id, then
    text; of rows equal in both one stays. Rows with a null doc_id, and those with a null or empty text or one
    without words, all stay. Columns of any name are kept; an empty table stays empty.
    """
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").limit(1).count():
        # Ids in the order of (doc_id, text), written once, so that they are the same wherever they are read.
        row = fresh(docs.columns, "_row")
        rows = spool(known.dropDuplicates(["doc_id", "text"]).orderBy("doc_id", "text").withColumn(row, F.monotonically_increasing_id()))
        gone = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), shingle, percent).where("not kept").select(F.col("doc_id").alias(row))
        return rows.join(gone, row, "left_anti").select(*docs.columns).unionByName(docs.where("doc_id is null"))
    gone = near_duplicates(docs, shingle, percent).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
