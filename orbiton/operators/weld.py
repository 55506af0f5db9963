"""Near-coincident sites: pairs below a radius and their classes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..config import MOST_WELD_PAIRS
from ..errors import DegenerateInput
from ..tables import components, written


def lattice_key(step: float, *coordinates: Column) -> Column:
    """One long for the cubic lattice cell of a point of the unit ball, 21 bits an axis."""
    out = F.lit(0).cast("bigint")
    for c in coordinates:
        out = out * F.lit(1 << 21) + F.floor((c + 1.25) / step).cast("bigint")
    return out


def lattice_keys_within(step: float, reach: float, *coordinates: Column) -> Column:
    """All cells that a box of half side reach around the point meets (reach <= step / 2: at most 8)."""
    axes = [F.array_distinct(F.array(F.floor((c - reach + 1.25) / step), F.floor((c + reach + 1.25) / step))) for c in coordinates]
    x, y, z = axes
    flat = F.flatten(F.transform(x, lambda i: F.flatten(F.transform(y, lambda j: F.transform(z, lambda k: (i.cast("bigint") * (1 << 21) + j) * (1 << 21) + k)))))
    return flat


def near_pairs(points: DataFrame, key: str, radius: float) -> DataFrame:
    """(a, b, d2 FLOAT), a < b: points with a 32-bit squared distance strictly below the 32-bit squared radius.

    Each point goes to its own lattice cell and, as a probe, to the cells that its surroundings meet; cells
    are joined by equality, so the work follows the number of close pairs, not the square of the rows.
    """
    reach = radius * (1 + 1e-5) + 1e-9
    step = max(2 * reach, 2.0**-18)
    limit = F.lit(float(np.float32(radius) * np.float32(radius))).cast("float")
    xyz = [F.col(c).cast("double") for c in "xyz"]
    left = points.select(F.col(key).alias("a"), *(F.col(c).cast("float").alias(f"a{c}") for c in "xyz"), F.explode(lattice_keys_within(step, reach, *xyz)).alias("_k"))
    right = points.select(F.col(key).alias("b"), *(F.col(c).cast("float").alias(f"b{c}") for c in "xyz"), lattice_key(step, *xyz).alias("_k"))
    d = [F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"]
    d2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    return left.join(right, "_k").where((F.col("a") < F.col("b")) & (d2 < limit)).select("a", "b", d2.alias("d2"))


def classes(sites: DataFrame, pairs: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, canonical_id) of every site: the least id of its class over pairs, itself where it has none."""
    found = components(pairs).select(F.col("node").alias(key), "component")
    return sites.select(key).join(found, key, "left").select(key, F.coalesce("component", key).alias("canonical_id"))


def weld(sites: DataFrame, radius: float | None) -> DataFrame:
    """(site_id, canonical_id) of every site; identity without a radius. More than 2^20 pairs are an error."""
    if radius is None:
        return sites.select("site_id", F.col("site_id").alias("canonical_id"))
    pairs = written(near_pairs(sites, "site_id", radius).select("a", "b"))
    n = pairs.limit(MOST_WELD_PAIRS + 1).count()
    if n > MOST_WELD_PAIRS:
        raise DegenerateInput(n, f"more than {MOST_WELD_PAIRS} pairs within the weld radius")
    if not n:
        return sites.select("site_id", F.col("site_id").alias("canonical_id"))
    return written(classes(sites, pairs))
