"""Synthetic sites by spark.range: (site_id, x, y, z FLOAT), the same in every run and partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import sphere as S

#: The golden angle.
GOLDEN = math.pi * (3 - math.sqrt(5))


def _draw(seed: int, salt: int) -> Column:
    """A number in [0, 1) that depends on id, seed and salt alone."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _sites(df: DataFrame, x: Column, y: Column, z: Column) -> DataFrame:
    return df.select(F.col("id").alias("site_id"), *S.as_float(S.unit((x, y, z))))


def _on_band(df: DataFrame, z: Column, turn: Column) -> DataFrame:
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))
    return _sites(df, r * F.cos(turn), r * F.sin(turn), z)


def fibonacci(spark: SparkSession, n: int, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """A spiral of evenly spread sites; jitter moves x and z by up to so much."""
    df = spark.range(n)
    z = 1 - (2 * F.col("id") + 1) / float(n)
    r, turn = F.sqrt(1 - z * z), F.col("id") * GOLDEN
    return _sites(df, r * F.cos(turn) + jitter * (2 * _draw(seed, 1) - 1), r * F.sin(turn), z + jitter * (2 * _draw(seed, 2) - 1))


def uniform(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    df = spark.range(n)
    return _on_band(df, 2 * _draw(seed, 1) - 1, 2 * math.pi * _draw(seed, 2))


def great_circle(spark: SparkSession, n: int, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    df = spark.range(n)
    turn = 2 * math.pi * F.col("id") / n
    return _sites(df, F.cos(turn), F.sin(turn), jitter * (2 * _draw(seed, 1) - 1))


def cap(spark: SparkSession, n: int, radius: float = 0.002, background: float = 0.02, seed: int = 0) -> DataFrame:
    """All but a share of the sites within a cap about +Z."""
    df = spark.range(n)
    far = _draw(seed, 3) < background
    low = math.cos(radius)
    z = F.when(far, 2 * _draw(seed, 1) - 1).otherwise(low + (1 - low) * _draw(seed, 1))
    return _on_band(df, z, 2 * math.pi * _draw(seed, 2))


def clustered(spark: SparkSession, n: int, clusters: int = 40, radius: float = 0.05, seed: int = 0) -> DataFrame:
    """Sites around evenly spread cluster centres."""
    df = spark.range(n)
    c = F.floor(_draw(seed, 4) * clusters)
    z = 1 - (2 * c + 1) / float(clusters)
    r, turn = F.sqrt(1 - z * z), c * GOLDEN
    spread = [radius * (2 * _draw(seed, k) - 1) for k in (1, 2, 3)]
    return _sites(df, r * F.cos(turn) + spread[0], r * F.sin(turn) + spread[1], z + spread[2])


def bimodal(spark: SparkSession, n: int, share: float = 0.8, radius: float = 0.3, seed: int = 0) -> DataFrame:
    return cap(spark, n, radius, 1 - share, seed)


def mega(spark: SparkSession, n: int, fraction: float = 0.8, radius: float = 0.05, seed: int = 0) -> DataFrame:
    return cap(spark, n, radius, 1 - fraction, seed)


def gradient(spark: SparkSession, n: int, k: float = 4.0, seed: int = 0) -> DataFrame:
    """Density rising as exp(k z)."""
    df = spark.range(n)
    u = _draw(seed, 1)
    z = F.log(math.exp(-k) + u * (math.exp(k) - math.exp(-k))) / k
    return _on_band(df, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z)), 2 * math.pi * _draw(seed, 2))


def hemisphere(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    return _on_band(spark.range(n), _draw(seed, 1), 2 * math.pi * _draw(seed, 2))


def outlier(spark: SparkSession, n: int, pile: int = 500, seed: int = 0) -> DataFrame:
    """Uniform sites of which the first `pile` lie within 1e-4 of +X."""
    u = uniform(spark, n, seed)
    near = F.col("site_id") < pile
    return u.select("site_id", *S.as_float(S.unit((F.when(near, 1.0).otherwise(F.col("x")), *(F.when(near, F.col(c) * 1e-4).otherwise(F.col(c)) for c in "yz")))))


def cubed_sphere(spark: SparkSession, k: int) -> DataFrame:
    """Centres of the 6 k^2 cells of the cube map."""
    df = spark.range(6 * k * k)
    face, iu, iv = S.cell_to_face_ij(F.col("id"), k)
    u, v = (S.st_to_uv((i + 0.5) / k) for i in (iu, iv))
    return _sites(df, *S.face_uv_to_point(face, u, v))


def cube_vertices(spark: SparkSession, n: int, spread: float = 0.01, seed: int = 0) -> DataFrame:
    """Sites around the eight corners of a cube."""
    df = spark.range(n)
    sign = lambda bit: F.when(F.floor(F.col("id") / bit) % 2 == 0, -1.0).otherwise(1.0)
    return _sites(df, *(sign(1 << i) + spread * (2 * _draw(seed, i) - 1) for i in range(3)))


FAMILIES = {f.__name__: f for f in (fibonacci, uniform, great_circle, cap, clustered, bimodal, mega, gradient, hemisphere, outlier, cube_vertices)}
