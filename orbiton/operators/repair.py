"""Local rebuild of cells that their neighbours disagree with, by an exact convex hull."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import sphere as S
from ..tables import written
from .kernel import hull_faces

#: Sites of all defects and their surroundings that a rebuild takes on; more stay a reported residual.
MOST_SITES = 3_000
#: Nearest sites that join each defect's two rings of neighbours.
NEAR = 32


def unpaired(edges: DataFrame) -> DataFrame:
    """Edges that aren't used exactly once by another cell the other way round."""
    return edges.where("neighbor_id is null")


def rebuild(d, sites: DataFrame):
    """The diagram with the cells of unpaired edges, of vertices under three cells, and of sites without a cell, taken from the hull of their surroundings.

    It stands only if the whole diagram then passes the strict gate; else the diagram comes back as it was,
    with its residuals, and the status says so.
    """
    low = d.cell_edges.groupBy("v0").agg(F.countDistinct("cell_id").alias("k"), F.min("cell_id").alias("cell_id")).where("k < 3").select("cell_id")
    gone = sites.select(F.col("site_id").alias("cell_id")).join(d.cell_edges.select("cell_id").distinct(), "cell_id", "left_anti")
    seeds = written(unpaired(d.cell_edges).select("cell_id").union(low).union(gone).distinct())
    if seeds.limit(1).count() == 0:
        return d
    pairs = d.cell_edges.where("neighbor_id is not null").select(F.col("cell_id").alias("a"), F.col("neighbor_id").alias("b"))
    ring = seeds.select(F.col("cell_id").alias("a"))
    rings = [ring]
    for _ in range(2):
        ring = ring.join(pairs, "a").select(F.col("b").alias("a")).distinct()
        rings.append(ring)
    closure = rings[0].union(rings[1]).distinct()
    p = S.unit(S.vector())
    spots = sites.join(seeds.withColumnRenamed("cell_id", "site_id"), "site_id", "left_semi").limit(MOST_SITES).collect()
    if not spots or len(spots) >= MOST_SITES:
        return dataclasses.replace(d, rebuild_status="rejected")
    centers = np.array([[s.x, s.y, s.z] for s in spots], np.float64)
    score = F.greatest(*(S.dot(p, S.literal(c)) for c in centers[:16]), F.lit(-2.0))
    near = sites.orderBy(score.desc(), "site_id").limit(NEAR * min(16, len(spots))).select(F.col("site_id").alias("a"))
    wanted = rings[0].union(rings[1]).union(rings[2]).union(near).distinct()
    local = sites.join(wanted.withColumnRenamed("a", "site_id"), "site_id", "left_semi").orderBy("site_id").limit(MOST_SITES).toPandas()
    if len(local) >= MOST_SITES:
        return dataclasses.replace(d, rebuild_status="rejected")
    ids = local["site_id"].to_numpy()
    points = local[["x", "y", "z"]].to_numpy(np.float64)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    around: dict[int, dict[int, tuple[int, tuple]]] = {}
    for f in hull_faces(points):
        key = tuple(sorted(int(ids[i]) for i in f))
        for i in range(3):
            around.setdefault(f[i], {})[f[(i + 1) % 3]] = (f[(i + 2) % 3], key)
    inner = {r["a"] for r in closure.collect()}
    rows = []
    for i, turns in around.items():
        if int(ids[i]) not in inner:
            continue
        start = at = min(turns)
        for pos in range(len(turns)):
            if at not in turns:
                return dataclasses.replace(d, rebuild_status="rejected")
            at, key = turns[at]
            rows.append((int(ids[i]), pos, int(ids[at]), *key))
        if at != start:
            return dataclasses.replace(d, rebuild_status="rejected")
    spark = sites.sparkSession
    fresh = spark.createDataFrame(rows, "cell_id long, pos int, neighbor_id long, g0 long, g1 long, g2 long")
    from .build import _exact_positions, cell_edges, pair_edges

    spot = sites.select(F.col("site_id").alias("cell_id"), *(F.col(c).cast("double").alias(c) for c in "xyz"))
    keys = fresh.join(spot, "cell_id").groupBy("g0", "g1", "g2").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))
    placed = _exact_positions(keys, sites)
    base = d.vertices.agg(F.max("vertex_id")).first()[0] + 1
    known = placed.join(d.vertices.select("g0", "g1", "g2", "vertex_id"), ["g0", "g1", "g2"], "left")
    new = sorted(((r.g0, r.g1, r.g2), r) for r in known.where("vertex_id is null").collect())
    added = spark.createDataFrame([(base + i, *k, r.x, r.y, r.z) for i, (k, r) in enumerate(new)], "vertex_id long, g0 long, g1 long, g2 long, x double, y double, z double")
    vertices = written(d.vertices.unionByName(added))
    named = fresh.join(vertices.select("vertex_id", "g0", "g1", "g2"), ["g0", "g1", "g2"])
    done = cell_edges(named.select("cell_id", "pos", "vertex_id", "neighbor_id"))
    kept = d.cell_edges.join(done.select("cell_id").distinct(), "cell_id", "left_anti")
    edges = written(pair_edges(kept.unionByName(done).drop("neighbor_id")))
    out, _ = dataclasses.replace(d, cell_edges=edges, vertices=vertices, rebuild_status="accepted").compact_vertices()
    return out if out.validate().is_strictly_valid() else dataclasses.replace(d, rebuild_status="rejected")
