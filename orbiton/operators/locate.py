"""Nearest-site location and nearest neighbours."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..errors import IndexedSphereQueryError
from ..functions import sphere as S
from ..tables import is_empty, written
from .weld import lattice_key, lattice_keys_within

#: Up to so many sites go to every task.
BROADCAST_SITES = 20_000


def _nearest(queries: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """(key, site_id, dot): the best of the pairs in one aggregate; ties go to the least site_id."""
    d = S.dot(S.vector("q"), S.vector("s"))
    pairs = queries.join(sites, "_k") if "_k" in queries.columns else queries.crossJoin(F.broadcast(sites))
    return pairs.groupBy(key).agg(F.max(F.struct(d.alias("d"), (-F.col("site_id")).alias("i"))).alias("m")).select(key, (-F.col("m.i")).alias("site_id"), F.col("m.d").alias("dot"))


class SphereLocator:
    """Finds the site nearest to each direction: among broadcast sites if they are few, else by lattice cells that grow until the find is certain."""

    def __init__(self, sites: DataFrame):
        self.sites = sites.select("site_id", *(F.col(c).cast("double").alias(f"s{c}") for c in "xyz"))
        self.count = sites.count()

    def _queries(self, df: DataFrame, key: str, x: Column, y: Column, z: Column) -> DataFrame:
        raw = tuple(c.cast("double") for c in (x, y, z))
        n = S.length(raw)
        ok = S.finite(raw) & (n > 0)
        return df.select(F.col(key), *(F.when(ok, (c / n).cast("float").cast("double")).alias(f"q{a}") for a, c in zip("xyz", raw)))

    def locate(self, df: DataFrame, key: str = "query_id", x: Column | str = "x", y: Column | str = "y", z: Column | str = "z", checked: bool = True) -> DataFrame:
        """(key, site_id, dot) of every direction of df, of any finite non-zero length.

        checked: the least key of a direction that isn't raises before any search. Unchecked (as in a
        stream), such rows get no site.
        """
        col = lambda c: F.col(c) if isinstance(c, str) else c
        q = self._queries(df, key, col(x), col(y), col(z))
        if checked and not df.isStreaming:
            bad = q.where("qx is null").agg(F.min(key)).first()[0]
            if bad is not None:
                raise IndexedSphereQueryError(bad)
        if self.count <= BROADCAST_SITES:
            return self._held(q, key)
        return self._by_cells(written(q.where("qx is not null")), key)

    def _held(self, q: DataFrame, key: str) -> DataFrame:
        """Every task holds the sites, whose number was checked, and scores its queries by matrix products."""
        local = self.sites.orderBy("site_id").toPandas()
        held = q.sparkSession.sparkContext.broadcast((local["site_id"].to_numpy(), local[["sx", "sy", "sz"]].to_numpy()))

        def run(batches):
            ids, points = held.value
            for pdf in batches:
                out = pdf[[key]].copy()
                p = pdf[["qx", "qy", "qz"]].to_numpy(np.float64)
                best, score = np.empty(len(p), np.int64), np.empty(len(p))
                for a in range(0, len(p), 1024):
                    # Products in the order of the components, as everywhere else, so that ties are ties.
                    block = p[a : a + 1024]
                    d = block[:, :1] * points[:, 0] + block[:, 1:2] * points[:, 1] + block[:, 2:] * points[:, 2]
                    best[a : a + 1024] = d.argmax(axis=1)
                    score[a : a + 1024] = d.max(axis=1)
                out["site_id"] = pd.array(ids[best], dtype="Int64")
                out["dot"] = score
                out.loc[np.isnan(p).any(axis=1), ["site_id", "dot"]] = None
                yield out

        kind = q.schema[key].dataType.simpleString()
        return q.mapInPandas(run, f"`{key}` {kind}, site_id bigint, dot double")

    def _by_cells(self, left: DataFrame, key: str) -> DataFrame:
        """Queries meet the sites of the lattice cells within reach; what lies farther than reach can't be nearer than a find within it."""
        reach, found = 4.0 / self.count**0.5, None
        while True:
            everything = reach >= 1.0
            if everything:
                # The rest, far from all sites: one pass over them.
                best = _nearest(left, self.sites, key)
            else:
                step = 2 * reach
                probes = left.withColumn("_k", F.explode(lattice_keys_within(step, reach, *S.vector("q"))))
                best = _nearest(probes, self.sites.withColumn("_k", lattice_key(step, *S.vector("s"))), key)
            good = best if everything else best.where(2 - 2 * F.col("dot") < reach * reach * (1 - 1e-9))
            good = written(good)
            found = good if found is None else found.unionByName(good)
            left = written(left.join(good, key, "left_anti"))
            if everything or is_empty(left):
                return found
            reach *= 3


def knn(sites: DataFrame, k: int) -> DataFrame:
    """(site_id, rank, neighbor_id, dot): the k nearest others of every site, nearest first, ties by id; dots in doubles of the stored floats.

    Up to BROADCAST_SITES sites meet all others; more meet those in reach of their lattice cell, which grows
    for sites with fewer than k certain neighbours.
    """
    n = sites.count()
    s = sites.select("site_id", *(F.col(c).cast("double").alias(f"s{c}") for c in "xyz"))
    d = S.dot(S.vector("q"), S.vector("s"))
    ranked = Window.partitionBy("site_id").orderBy(F.col("dot").desc(), "neighbor_id")

    def top(pairs: DataFrame) -> DataFrame:
        return pairs.where("site_id <> neighbor_id").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("site_id", "rank", "neighbor_id", "dot")

    def pairs_of(q: DataFrame, others: DataFrame, on: str | None) -> DataFrame:
        o = others.withColumnRenamed("site_id", "neighbor_id")
        joined = q.join(o, on) if on else q.crossJoin(F.broadcast(o))
        return joined.select("site_id", "neighbor_id", d.alias("dot"))

    q = s.select("site_id", *(F.col(f"s{c}").alias(f"q{c}") for c in "xyz"))
    if n <= 2_000:
        return top(pairs_of(q, s, None))
    reach, found, left = 4.0 * (max(1, k) / n) ** 0.5, None, q
    while True:
        if reach >= 1.0:
            out = top(pairs_of(left, s, None))
            return out if found is None else found.unionByName(out)
        step = 2 * reach
        probes = left.withColumn("_k", F.explode(lattice_keys_within(step, reach, *S.vector("q"))))
        near = top(pairs_of(probes, s.withColumn("_k", lattice_key(step, *S.vector("s"))), "_k"))
        sure = written(near.withColumn("_last", F.min("dot").over(Window.partitionBy("site_id"))).withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy("site_id"))).where((F.col("_c") == k) & (2 - 2 * F.col("_last") < reach * reach * (1 - 1e-9))).drop("_last", "_c"))
        found = sure if found is None else found.unionByName(sure)
        left = written(left.join(sure.select("site_id").distinct(), "site_id", "left_anti"))
        if is_empty(left):
            return found
        reach *= 2
