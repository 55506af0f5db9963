"""Topology of the cube map's cells, and Lloyd's method by samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import sphere as S
from ..tables import written
from .locate import SphereLocator


def cell_corners(spark: SparkSession, res: int) -> DataFrame:
    """(cell, k, x, y, z): the four corners of every cell."""
    cells = spark.range(6 * res * res).withColumnRenamed("id", "cell")
    face, iu, iv = S.cell_to_face_ij(F.col("cell"), res)
    flat = cells.select("cell", face.alias("face"), iu.alias("iu"), iv.alias("iv"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    u = S.st_to_uv((F.col("iu") + F.col("k") % 2) / float(res))
    v = S.st_to_uv((F.col("iv") + F.floor(F.col("k") / 2)) / float(res))
    return flat.select("cell", "k", *(c.alias(n) for c, n in zip(S.face_uv_to_point(F.col("face"), u, v), "xyz")))


def neighbors(spark: SparkSession, res: int) -> DataFrame:
    """(cell, neighbor): cells that share a corner, across face borders too; 8 of each, 7 at the cube's corners.

    Corners meet by equality of their rounded coordinates.
    """
    corner = cell_corners(spark, res).select("cell", *((F.round(F.col(c) * 1e9) + 0.0).cast("bigint").alias(c) for c in "xyz"))
    return corner.join(corner.withColumnRenamed("cell", "neighbor"), ["x", "y", "z"]).where("cell <> neighbor").select("cell", "neighbor").distinct()


def ring2(near: DataFrame) -> DataFrame:
    """(cell, neighbor): cells two steps away, of neighbors()."""
    step = near.withColumnRenamed("neighbor", "mid").join(near.withColumnRenamed("cell", "mid"), "mid").where("cell <> neighbor").select("cell", "neighbor").distinct()
    return step.join(near, ["cell", "neighbor"], "left_anti")


def cap_bounds(spark: SparkSession, res: int) -> DataFrame:
    """(cell, x, y, z, radius): a cap that holds the cell: its centre and the angle to its farthest corner, padded."""
    cells = spark.range(6 * res * res).withColumnRenamed("id", "cell")
    face, iu, iv = S.cell_to_face_ij(F.col("cell"), res)
    center = S.face_uv_to_point(face, S.st_to_uv((iu + 0.5) / res), S.st_to_uv((iv + 0.5) / res))
    mid = cells.select("cell", *(c.alias(f"c{n}") for c, n in zip(center, "xyz")))
    return cell_corners(spark, res).join(mid, "cell").groupBy("cell").agg(*(F.first(f"c{n}").alias(n) for n in "xyz"), (F.max(S.angular_separation(S.vector("c"), S.vector())) + 1e-5).alias("radius"))


def least_chord2(query: S.Vector, center: S.Vector, radius: Column) -> Column:
    """A lower bound of the squared chord from a query to any point of a cap."""
    apart = F.greatest(F.lit(0.0), S.angular_separation(query, center) - radius)
    return 2 - 2 * F.cos(apart)


def sampled_lloyd(sites: DataFrame, samples: DataFrame, rounds: int = 1) -> DataFrame:
    """Sites moved, round by round, to the mean direction of the samples nearest to them; sites without samples stay."""
    asked = samples.select(F.col("site_id").alias("query_id"), "x", "y", "z")
    for _ in range(rounds):
        owner = SphereLocator(sites).locate(asked).select("query_id", "site_id")
        sums = owner.join(asked, "query_id").groupBy("site_id").agg(*(F.sum(F.col(c).cast("double")).alias(f"s{c}") for c in "xyz"))
        moved = sites.join(sums, "site_id", "left")
        n = S.length(S.vector("s"))
        sites = written(moved.select("site_id", *(F.when(n > 1e-12, F.col(f"s{c}") / n).otherwise(F.col(c).cast("double")).cast("float").alias(c) for c in "xyz")))
    return sites
