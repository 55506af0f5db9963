"""Geometric quality of a diagram: residuals and nearest-rank statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import sphere as S
from ..tables import dense_ids
from .diagram import SphericalVoronoi
from .weld import near_pairs

#: Upper ends of the buckets of site chords.
BUCKETS = (2e-6, 1e-5, 1e-4, 1e-3, float("inf"))


def stats(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, max, mean, p95 and p99 of value; a percentile p is the value of rank (n - 1) * p // 100, no mean of two.

    Ranks come from counts by distinct value, so that equal values cost one row.
    """
    by = by or []
    each = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = each.withColumn("_upto", F.sum("_c").over(group.orderBy(value))).withColumn("_n", F.sum("_c").over(group))

    def at(p: int) -> Column:
        return F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - 1) * p / 100), F.col(value)))

    return ranked.groupBy(*by).agg(F.sum("_c").alias("n"), F.max(value).alias("max"), (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"), at(95).alias("p95"), at(99).alias("p99"))


def bucketed(df: DataFrame, value: str, site_chord: str) -> DataFrame:
    """stats() by the bucket of the owners' chord."""
    bucket = F.lit(len(BUCKETS) - 1)
    for i in range(len(BUCKETS) - 2, -1, -1):
        bucket = F.when(F.col(site_chord) < BUCKETS[i], i).otherwise(bucket)
    return stats(df.withColumn("bucket", bucket), value, ["bucket"])


def vertex_residuals(d: SphericalVoronoi) -> DataFrame:
    """(vertex_id, residual, norm_error): the spread of a vertex's dots with its owners, and its length's distance from 1."""
    around = d.geometry.select(F.col("v0").alias("vertex_id"), S.dot(S.vector("a"), S.unit(S.vector("g"))).alias("dot"), S.length(S.vector("a")).alias("size"))
    return around.groupBy("vertex_id").agg((F.max("dot") - F.min("dot")).alias("residual"), F.abs(F.first("size") - 1).alias("norm_error"))


def edge_residuals(d: SphericalVoronoi) -> DataFrame:
    """(a, b, residual, cross_track, site_chord) once for each edge: how far its ends are from the owners' bisector."""
    p, q, g, h = *(S.vector(c) for c in "ab"), *(S.unit(S.vector(c)) for c in "gh")
    off = lambda v: F.abs(S.dot(v, g) - S.dot(v, h))
    return d.geometry.where("cell_id < neighbor_id").select(F.col("cell_id").alias("a"), F.col("neighbor_id").alias("b"), F.greatest(off(p), off(q)).alias("residual"), F.greatest(S.cross_track(p, g, h), S.cross_track(q, g, h)).alias("cross_track"), F.sqrt(S.chord2(S.vector("g"), S.vector("h"))).alias("site_chord"))


def canonicalization_error(raw: DataFrame, sites: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, error): the angle between a raw point (x, y, z) and its stored site."""
    r = raw.select(key, *(F.col(c).cast("double").alias(f"r{c}") for c in "xyz"))
    return r.join(sites.select(F.col("site_id").alias(key), "x", "y", "z"), key).select(key, S.angular_separation(S.vector("r"), S.vector()).alias("error"))


def low_degree(d: SphericalVoronoi, within: float = 1e-6) -> DataFrame:
    """(vertex_id, near): vertices of one or two cells, and whether another vertex lies within the distance."""
    thin = d.cell_edges.groupBy(F.col("v0").alias("vertex_id")).agg(F.countDistinct("cell_id").alias("k")).where("k < 3").select("vertex_id")
    pairs = near_pairs(d.vertices, "vertex_id", within)
    close = pairs.select(F.col("a").alias("vertex_id")).union(pairs.select("b")).distinct().withColumn("near", F.lit(True))
    return thin.join(close, "vertex_id", "left").select("vertex_id", F.coalesce("near", F.lit(False)).alias("near"))


def sampled_ownership(d: SphericalVoronoi, most: int = 1_000) -> DataFrame:
    """(site_id, owner, gap) for at most `most` cells, evenly spaced by dense index: the nearest site of the cell's centroid.

    gap is how much nearer than the cell's own site, as a dot product; up to 32-bit rounding 0 or less where the cell owns its centroid.
    """
    index = dense_ids(d.weld.where("site_id = canonical_id").select("site_id"), ["site_id"], "i")
    n = d.effective_cell_count()
    step = max(1, -(-n // most))
    chosen = d.cell_centroid().join(index.where(F.col("i") % step == 0), "site_id").select("site_id", "x", "y", "z")
    found = d.build_locator().locate(chosen.withColumnRenamed("site_id", "query_id")).withColumnRenamed("site_id", "owner")
    own = chosen.join(d.sites.select("site_id", *(F.col(c).cast("double").alias(f"s{c}") for c in "xyz")), "site_id")
    return found.join(own.select(F.col("site_id").alias("query_id"), S.dot(S.vector(), S.vector("s")).alias("mine")), "query_id").select(F.col("query_id").alias("site_id"), "owner", (F.col("dot") - F.col("mine")).alias("gap"))


def fingerprint(d: SphericalVoronoi) -> DataFrame:
    """One row: a hash of the topology that knows neither vertex ids nor starts of cells nor winding."""
    t = d.triangles().select(F.array_sort(F.array("a", "b", "c")).alias("t"))
    each = F.conv(F.substring(F.md5(F.array_join("t", ",")), 1, 15), 16, 10)
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum(each.cast("decimal(28,0)")).cast("string").alias("hash"))
