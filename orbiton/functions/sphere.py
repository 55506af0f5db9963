"""Scalar geometry as column expressions; all of it stays in whole-stage code."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..config import EPS32
from ..errors import InsufficientPoints, InvalidInput, SphereEmbeddingError

Vector = tuple[Column, Column, Column]


def vector(prefix: str = "", suffix: str = "") -> Vector:
    """The columns <prefix>x<suffix>, ...y..., ...z... as doubles."""
    return tuple(F.col(f"{prefix}{c}{suffix}").cast("double") for c in "xyz")


def literal(v: Sequence[float]) -> Vector:
    return tuple(F.lit(float(c)) for c in v)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def sub(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b))


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    n = length(a)
    return tuple(c / n for c in a)


def finite(a: Vector) -> Column:
    """True where all three components are numbers and none is infinite; false for nulls."""
    ok = [F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)) for c in a]
    return ok[0] & ok[1] & ok[2]


def as_float(a: Vector, names: Sequence[str] = ("x", "y", "z")) -> list[Column]:
    return [c.cast("float").alias(n) for c, n in zip(a, names)]


def direction(df: DataFrame, key: str, x: Column, y: Column, z: Column) -> DataFrame:
    """(key, x, y, z FLOAT): unit directions, normalised in double and rounded; the key of a bad row raises when checked."""
    return df.select(F.col(key), *as_float(unit((x.cast("double"), y.cast("double"), z.cast("double")))))


def canonical(a: Vector) -> Vector:
    """Normalised where the squared length is in [0.25, 4], else untouched."""
    n2 = dot(a, a)
    return tuple(F.when(n2.between(0.25, 4.0), c / F.sqrt(n2)).otherwise(c) for c in a)


def canonicalize(df: DataFrame, key: str, x: Column, y: Column, z: Column) -> DataFrame:
    """(site_id BIGINT, x, y, z FLOAT) canonical sites of raw 32-bit points."""
    raw = tuple(c.cast("float").cast("double") for c in (x, y, z))
    return df.select(F.col(key).cast("bigint").alias("site_id"), *as_float(canonical(raw)))


def check_sites(sites: DataFrame) -> int:
    """Number of sites; raises for fewer than 4, and for a bad row with the least site_id. One aggregate."""
    bad = ~finite(vector()) | (dot(vector(), vector()) == 0)
    n, first = sites.agg(F.count(F.lit(1)), F.min(F.when(bad, F.col("site_id")))).first()
    if n < 4:
        raise InsufficientPoints(n)
    if first is not None:
        raise InvalidInput(first, "not a finite, non-zero direction")
    return n


def is_stored_point(a: Vector) -> Column:
    """Finite, and the squared norm within 2 * eps32 of 1."""
    return finite(a) & (F.abs(dot(a, a) - 1) <= 2 * EPS32)


# World space -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class SphereEmbedding:
    """A sphere in world space; all operations are column expressions."""

    center: tuple[float, float, float]
    radius: float

    def __post_init__(self):
        if not all(map(math.isfinite, self.center)):
            raise SphereEmbeddingError("the centre must be finite")
        if not (math.isfinite(self.radius) and self.radius > 0):
            raise SphereEmbeddingError("the radius must be finite and positive")
        most = 1.7976931348623157e308
        if any(self.radius > most - abs(c) for c in self.center):
            raise SphereEmbeddingError("the sphere must lie in the range of doubles")

    def project(self, df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
        """df with ux, uy, uz: the direction of a world point from the centre; null at the centre or if not finite.

        Where a difference overflows, all six operands are scaled down first. Column by column, so that each
        value is computed once.
        """
        names = ("ux", "uy", "uz")
        p = tuple(F.col(c).cast("double") for c in (x, y, z))
        d = tuple(map(F.col, names))
        out = df.withColumns({"_s": F.greatest(*(F.abs(c) for c in p), *(F.lit(abs(float(c))) for c in self.center)), **{n: a - F.lit(float(o)) for n, a, o in zip(names, p, self.center)}})
        out = out.withColumn("_o", finite(p) & ~finite(d))
        out = out.withColumns({n: F.when(F.col("_o"), a / F.col("_s") - F.lit(float(o)) / F.col("_s")).otherwise(F.col(n)) for n, a, o in zip(names, p, self.center)})
        out = out.withColumn("_s", F.greatest(*(F.abs(c) for c in d)))
        out = out.withColumns({n: F.when(F.col("_s") > 0, F.col(n) / F.col("_s")) for n in names})
        out = out.withColumn("_s", length(d))
        out = out.withColumn("_o", finite(p) & finite(d))
        return out.withColumns({n: F.when(F.col("_o"), F.col(n) / F.col("_s")) for n in names}).drop("_s", "_o")

    def to_world(self, u: Vector) -> Vector:
        return tuple(c * float(self.radius) + float(o) for c, o in zip(u, self.center))

    def to_area(self, solid_angle: Column) -> Column:
        return solid_angle * float(self.radius) * float(self.radius)


# The cube map ------------------------------------------------------------------------------------------


def face_uv(a: Vector) -> tuple[Column, Column, Column]:
    """Cube face (0..5: +X -X +Y -Y +Z -Z; ties x, then y) and u, v in [-1, 1]."""
    x, y, z = a
    ax, ay, az = F.abs(x), F.abs(y), F.abs(z)
    on_x, on_y = (ax >= ay) & (ax >= az), (ay >= ax) & (ay >= az)

    def pick(px, nx, py, ny, pz, nz):
        return F.when(on_x, F.when(x >= 0, px).otherwise(nx)).when(on_y, F.when(y >= 0, py).otherwise(ny)).otherwise(F.when(z >= 0, pz).otherwise(nz))

    face = pick(*(F.lit(i) for i in range(6)))
    return face, pick(-z / ax, z / ax, x / ay, x / ay, x / az, -x / az), pick(y / ax, y / ax, -z / ay, z / ay, y / az, y / az)


def uv_to_st(u: Column) -> Column:
    """Quadratic map of [-1, 1] to [0, 1] that evens out areas."""
    half = 0.5 * F.sqrt(1 + 3 * F.abs(u))
    return F.when(u >= 0, half).otherwise(1 - half)


def st_to_uv(s: Column) -> Column:
    return F.when(s >= 0.5, (4 * s * s - 1) / 3).otherwise((1 - 4 * (1 - s) * (1 - s)) / 3)


def cell_of(a: Vector, res: int) -> tuple[Column, Column, Column, Column]:
    """(face, iu, iv, cell) on the cube map of res * res cells a face."""
    face, u, v = face_uv(a)
    step = lambda c: F.least(F.lit(res - 1), F.greatest(F.lit(0), F.floor(uv_to_st(c) * res))).cast("int")
    iu, iv = step(u), step(v)
    return face, iu, iv, (face.cast("bigint") * (res * res) + iv * res + iu).cast("bigint")


def cell_to_face_ij(cell: Column, res: int) -> tuple[Column, Column, Column]:
    rem = cell % (res * res)
    return F.floor(cell / (res * res)).cast("int"), (rem % res).cast("int"), F.floor(rem / res).cast("int")


def face_uv_to_point(face: Column, u: Column, v: Column) -> Vector:
    one, low = F.lit(1.0), F.lit(-1.0)

    def pick(*by_face):
        out = by_face[5]
        for i in range(4, -1, -1):
            out = F.when(face == i, by_face[i]).otherwise(out)
        return out

    return unit((pick(one, low, u, u, u, -u), pick(v, v, one, low, v, v), pick(-u, u, -v, v, one, low)))


def grid_resolution(n: int, per_cell: int = 24, least: int = 4, most: int = 26_754) -> int:
    """Cells along a face edge for about per_cell sites in a cell."""
    return min(most, max(least, math.isqrt(n // (6 * per_cell))))


# Measures ----------------------------------------------------------------------------------------------


def solid_angle(a: Vector, b: Vector, c: Vector) -> Column:
    """Signed solid angle of a spherical triangle."""
    return 2 * F.atan2(dot(a, cross(b, c)), 1 + dot(a, b) + dot(b, c) + dot(c, a))


def angular_separation(a: Vector, b: Vector) -> Column:
    return F.atan2(length(cross(a, b)), dot(a, b))


def cross_track(p: Vector, a: Vector, b: Vector) -> Column:
    """Angle of p from the plane that is equally far from a and b."""
    d = sub(a, b)
    return F.asin(F.abs(dot(p, d)) / length(d))


def chord2(a: Vector, b: Vector) -> Column:
    d = sub(a, b)
    return dot(d, d)


def circumcenter(a: Vector, b: Vector, c: Vector) -> Vector:
    """Direction of (b - a) x (c - a): outward where a, b, c wind counter-clockwise seen from outside."""
    return unit(cross(sub(b, a), sub(c, a)))


def tangent_basis(p: Vector) -> tuple[Vector, Vector]:
    """e1, e2 with (e1, e2, p) right-handed; p x X, or p x Y where p is near the X axis."""
    near = F.abs(p[0]) >= 0.9
    zero = F.lit(0.0)
    e1 = unit(tuple(F.when(near, a).otherwise(b) for a, b in zip((-p[2], zero, p[0]), (zero, p[2], -p[1]))))
    return e1, cross(p, e1)


def stable_sign(key: Column) -> Column:
    """A fixed pseudo-random value of an id in [-1, -0.125] or [0.125, 1]."""
    bits = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("double") / 4294967295.0
    s = bits * 2 - 1
    return F.when(s >= 0, F.greatest(s, F.lit(0.125))).otherwise(F.least(s, F.lit(-0.125)))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + 0.0


def owner_arcs(df: DataFrame) -> DataFrame:
    """Edges from a to b (ax..bz) of a cell g and its neighbour h (gx..hz) as arcs of the plane equally far from both.

    Adds arc_kind (`ordinary`, `near_pi`, `exact_pi` or `invalid`: an endpoint over 2e-6 off the plane), the
    arc's normal nx..nz, the projected start px..pz, the tangent tx..tz there, and angle; a point of the arc
    at s is p cos s + t sin s. Column by column, so that each value is computed once.
    """
    put = lambda d, name, v: d.withColumns({f"{name}{c}": e for c, e in zip("xyz", v)})
    a, b, n, p, q, t = (vector(c) for c in "abnpqt")
    d = put(df, "n", sub(vector("g"), vector("h")))
    d = put(d.withColumn("_l", length(n)), "n", tuple(c / F.col("_l") for c in n))
    d = d.withColumns({"_da": dot(n, a), "_db": dot(n, b)})
    d = put(d, "p", tuple(c - F.col("_da") * m for c, m in zip(a, n)))
    d = put(d, "q", tuple(c - F.col("_db") * m for c, m in zip(b, n)))
    d = d.withColumns({"_lp": length(p), "_lq": length(q)})
    d = put(put(d, "p", tuple(c / F.col("_lp") for c in p)), "q", tuple(c / F.col("_lq") for c in q))
    d = put(d, "t", cross(n, p)).withColumn("_s", dot(t, q))
    d = d.withColumns({"_f": F.when(F.col("_s") < 0, -1.0).otherwise(1.0), "_c": dot(p, q)})
    d = put(put(d, "t", tuple(c * F.col("_f") for c in t)), "n", tuple(c * F.col("_f") for c in n)).withColumn("_s", F.abs("_s"))
    kind = F.when(F.greatest(F.abs("_da"), F.abs("_db")) > 2e-6, "invalid").when((F.col("_c") < 0) & (F.col("_s") <= 1e-12), "exact_pi").when(dot(a, b) <= -1 + 1e-5, "near_pi").otherwise("ordinary")
    return d.withColumns({"arc_kind": kind, "angle": F.atan2("_s", "_c")}).drop("_l", "_da", "_db", "_lp", "_lq", "_s", "_f", "_c", "qx", "qy", "qz")
