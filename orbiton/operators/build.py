"""Construction of a diagram: welding, cells with certificates, one shared mesh."""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..config import RECONCILE, DegenerateMode, LocalRebuildMode, VoronoiConfig
from ..errors import ComputationFailed, UnsupportedGeometry, VoronoiError
from ..functions import sphere as S
from ..tables import components, dense_ids, is_empty, written
from .diagram import SphericalVoronoi
from .kernel import clip_cells
from .weld import lattice_key, lattice_keys_within, near_pairs, weld

#: Up to so many sites every task holds them all (a proven bound of the broadcast): no certificate is needed.
BROADCAST_SITES = 4_000
#: Side of a block in units of the certified reach, and the reach in units of 1 / sqrt(sites).
BLOCK, REACH = 12.0, 6.5
#: Sites in a block that make the grid finer there, and how many times it may halve.
CROWDED, FINEST = 6_000, 14
#: Rounds in which the reach of undecided cells doubles before they meet all sites.
WIDENINGS = 4

_CELLS = "site_id long, status int, edges array<long>, corners array<double>"


def _unit(pdf: pd.DataFrame) -> np.ndarray:
    p = pdf[["x", "y", "z"]].to_numpy(np.float64)
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def _nearest(own: np.ndarray, own_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each own point the numbers of its k nearest others by (distance, id), and how many there are."""
    near = own @ points.T
    near[own_ids[:, None] == ids[None, :]] = -3
    k = min(k, len(ids) - 1) if len(ids) > 1 else 0
    if k < len(ids) - 1 and k > 0:
        some = np.argpartition(-near, k - 1, axis=1)[:, :k]
    else:
        some = np.broadcast_to(np.arange(len(ids)), near.shape)
    # Chords are exact where dot products of close points are not.
    d = ((points[some] - own[:, None, :]) ** 2).sum(axis=2)
    d = np.where(np.take_along_axis(near, some, axis=1) < -2, 9.0, d)
    order = np.lexsort((ids[some], d), axis=1)[:, :k]
    return np.take_along_axis(some, order, axis=1), np.full(len(own), k)


def cells_of(own: pd.DataFrame, points: np.ndarray, ids: np.ndarray, reach: float, widen: bool) -> pd.DataFrame:
    """Cells of own sites among points, complete up to chord reach. status 1: not certified.

    First the 32 nearest, which nearly always certify; then all; widen: undecided cells also in the wide chart.
    """
    rows: dict[int, tuple] = {}
    own_ids, own_points = own["site_id"].to_numpy(), _unit(own)
    todo = np.arange(len(own))
    for k, wide in ((32, False), (len(ids), False), *([(len(ids), True)] if widen else [])):
        undecided = []
        size = max(1, min(1024, 4_000_000 // max(1, len(ids))))
        for a in range(0, len(todo), size):
            part = todo[a : a + size]
            which, counts = _nearest(own_points[part], own_ids[part], points, ids, k)
            edges, corners, status, far = clip_cells(own_points[part], points[which], counts, wide)
            seen = reach
            if k < len(ids) - 1 and which.shape[1]:
                seen = np.minimum(reach, np.linalg.norm(points[which[:, -1]] - own_points[part], axis=1))
            good = (status == 0) & ((far < seen) | (k >= len(ids) - 1) & (reach > 2))
            for i, (row, ok) in enumerate(zip(part.tolist(), good.tolist())):
                if ok:
                    rows[row] = (int(own_ids[row]), 0, ids[which[i]][edges[i]], corners[i].ravel())
                else:
                    undecided.append(row)
        todo = np.array(undecided, np.int64)
        if not len(todo):
            break
    out = [rows[i] if i in rows else (int(own_ids[i]), 1, None, None) for i in range(len(own))]
    return pd.DataFrame(out, columns=["site_id", "status", "edges", "corners"])


def _small(sites: DataFrame) -> DataFrame:
    """Cells of at most BROADCAST_SITES sites: each task has all of them."""
    local = sites.select("site_id", "x", "y", "z").orderBy("site_id").toPandas()
    held = sites.sparkSession.sparkContext.broadcast((_unit(local), local["site_id"].to_numpy()))

    def run(batches):
        for own in batches:
            yield cells_of(own, *held.value, 3.0, True)

    return sites.select("site_id", "x", "y", "z").repartition("site_id").mapInPandas(run, _CELLS)


def _levels(sites: DataFrame, side: float) -> DataFrame:
    """sites with `level`: how often the block side is halved so that the site's block isn't crowded."""
    xyz = S.vector()
    most = sites.groupBy(lattice_key(side, *xyz)).count().agg(F.max("count")).first()[0] or 0
    if most <= CROWDED:
        return sites.withColumn("level", F.lit(0))
    key = F.lit(None).cast("bigint")
    for level in range(FINEST + 1):
        key = F.when(F.col("level") == level, lattice_key(side / 2**level, *xyz)).otherwise(key)
    each = sites.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(FINEST)))).withColumn("_k", key)
    counts = each.groupBy("level", "_k").agg(F.count(F.lit(1)).alias("_n"))
    open_ = each.join(counts, ["level", "_k"]).where((F.col("_n") <= CROWDED) | (F.col("level") == FINEST))
    return open_.groupBy("site_id", "x", "y", "z").agg(F.min("level").alias("level"))


def _blocks(points: DataFrame, queries: DataFrame, side: float, reach: float, levels: list[int]) -> DataFrame:
    """Cells of queries (with level), block by block; each block also gets the sites within its halo.

    At level l a block's side is side / 2^l and its halo, the certified reach, reach / 2^l.
    """
    xyz = S.vector()
    shape = ("level", "block", "site_id", "x", "y", "z", "own")
    parts = []
    for level in levels:
        s, r = side / 2**level, reach / 2**level
        own = queries.where(F.col("level") == level).withColumn("block", lattice_key(s, *xyz)).withColumn("own", F.lit(True))
        halo = points.withColumn("block", F.explode(lattice_keys_within(s, r, *xyz))).withColumn("level", F.lit(level)).withColumn("own", F.lit(False))
        needed = own.select("block").distinct()
        parts.append(own.select(*shape).unionByName(halo.join(needed, "block", "left_semi").select(*shape)))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)

    def run(key, pdf):
        own, rest = pdf[pdf["own"]], pdf[~pdf["own"]]
        return cells_of(own.sort_values("site_id"), _unit(rest), rest["site_id"].to_numpy(), reach / 2.0 ** int(key[0]) * (1 - 1e-9), False)

    return rows.groupBy("level", "block").applyInPandas(run, _CELLS)


def _everywhere(sites: DataFrame, queries: DataFrame) -> DataFrame:
    """Cells of the few sites that stayed undecided, against all sites.

    A neighbour in the whole is a neighbour in every part that holds it: each partition of sites clips the
    queries' cells and passes on the neighbours that are left; those of all partitions give the cell. Only
    what is broadcast, the queries, must be few, and is checked.
    """
    asked = queries.select("site_id", "x", "y", "z").limit(BROADCAST_SITES + 1).toPandas()
    if len(asked) > BROADCAST_SITES:
        raise UnsupportedGeometry(int(asked["site_id"].min()), f"more than {BROADCAST_SITES} cells reach over a large part of the sphere")
    held = sites.sparkSession.sparkContext.broadcast(asked)

    def part(batches):
        for pdf in batches:
            points, ids = _unit(pdf), pdf["site_id"].to_numpy()
            out = []
            for a in range(0, len(held.value), 64):
                own = held.value.iloc[a : a + 64]
                which, counts = _nearest(_unit(own), own["site_id"].to_numpy(), points, ids, len(ids))
                edges, _, status, _ = clip_cells(_unit(own), points[which], counts, True)
                for i, (site, e, s) in enumerate(zip(own["site_id"], edges, status)):
                    numbers = which[i] if s else which[i][e]
                    # A part that doesn't bound the cell keeps its edges too, and the nearest for good measure.
                    numbers = np.unique(np.concatenate((which[i][e[e >= 0]], which[i][:64]))) if s else numbers
                    out.append(pd.DataFrame({"query_id": site, "site_id": ids[numbers], "x": pdf["x"].to_numpy()[numbers], "y": pdf["y"].to_numpy()[numbers], "z": pdf["z"].to_numpy()[numbers]}))
            yield pd.concat(out)

    found = sites.select("site_id", "x", "y", "z").mapInPandas(part, "query_id long, site_id long, x double, y double, z double")

    def whole(key, pdf):
        own = held.value[held.value["site_id"] == key[0]]
        return cells_of(own, _unit(pdf), pdf["site_id"].to_numpy(), 3.0, True)

    return found.groupBy("query_id").applyInPandas(whole, _CELLS)


def cells(sites: DataFrame, n: int) -> DataFrame:
    """(site_id, edges, corners) of every site: neighbours counter-clockwise and the corner each edge starts at."""
    if n <= BROADCAST_SITES:
        done, left = written(_small(sites)), None
        found, undecided = done.where("status = 0"), done.where("status <> 0")
    else:
        reach = REACH / n**0.5
        side = BLOCK * reach
        placed = written(_levels(sites, side))
        levels = sorted(r[0] for r in placed.select("level").distinct().collect())
        done = written(_blocks(sites, placed, side, reach, levels))
        found, left = done.where("status = 0"), done.where("status <> 0").select("site_id")
        for _ in range(WIDENINGS):
            if is_empty(left) or reach > 0.5:
                break
            reach, side = reach * 2, side * 2
            done = written(_blocks(sites, placed.join(left, "site_id", "left_semi"), side, reach, levels))
            found, left = found.union(done.where("status = 0")), done.where("status <> 0").select("site_id")
        if is_empty(left):
            return found.drop("status")
        done = written(_everywhere(sites, sites.join(left, "site_id", "left_semi")))
        found, undecided = found.union(done.where("status = 0")), done.where("status <> 0")
    bad = undecided.agg(F.min("site_id")).first()[0]
    if bad is not None:
        raise UnsupportedGeometry(bad, "its cell is not bounded by the other sites")
    return found.drop("status")


def _corners(found: DataFrame) -> DataFrame:
    """(cell_id, pos, neighbor_id, g0, g1, g2, x, y, z): corner pos of a cell, where its edge to neighbor_id starts."""
    size = F.size("edges")
    flat = found.select(F.col("site_id").alias("cell_id"), "edges", "corners", F.explode(F.sequence(F.lit(0), size - 1)).alias("pos"))
    at = lambda i: F.element_at("edges", (i + 1).cast("int"))
    key = F.array_sort(F.array("cell_id", at((F.col("pos") - 1 + F.size("edges")) % F.size("edges")), at(F.col("pos"))))
    c = lambda k: F.element_at("corners", F.col("pos") * 3 + k)
    return flat.select("cell_id", "pos", at(F.col("pos")).alias("neighbor_id"), *(key[i].alias(f"g{i}") for i in range(3)), *(c(k + 1).alias(n) for k, n in enumerate("xyz")))


def _exact_positions(keys: DataFrame, sites: DataFrame) -> DataFrame:
    """Vertices placed at the circumcentre of their three sites, in doubles, on the side where the clip saw them."""
    out = keys
    for i in range(3):
        out = out.join(sites.select(F.col("site_id").alias(f"g{i}"), *(F.col(c).cast("double").alias(f"{c}{i}") for c in "xyz")), f"g{i}")
    a, b, c = (S.unit(S.vector(suffix=str(i))) for i in range(3))
    n = S.cross(S.sub(b, a), S.sub(c, a))
    seen = S.vector()
    size = S.length(n)
    side = F.when(S.dot(n, seen) < 0, -1.0).otherwise(1.0)
    placed = tuple(p / size * side for p in n)
    # Sites almost on a line leave the direction open; then the clip's corner stands.
    ok = (size > 1e-12) & (S.dot(placed, seen) > 1 - 1e-8)
    return out.select("g0", "g1", "g2", *(F.when(ok, p).otherwise(q).alias(n) for p, q, n in zip(placed, seen, "xyz")))


@dataclasses.dataclass
class Assembly:
    """mismatches: keys that not exactly three cells hold; merged: of their vertices, those that are one with another."""

    mismatches: int
    merged: int


def assemble(found: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame, Assembly]:
    """cell_edges and vertices of the cells, every vertex stored once.

    A vertex is known by its three sites, never by its place. Where more than three cells meet, cells may
    name different triples for one place; such vertices, and those within RECONCILE of them, are merged.
    """
    corners = written(_corners(found))
    keys = corners.groupBy("g0", "g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("x", "y", "z"), "cell_id").alias("p"))
    placed = written(_exact_positions(keys.select("g0", "g1", "g2", "n", "p.x", "p.y", "p.z"), sites).join(keys.select("g0", "g1", "g2", "n"), ["g0", "g1", "g2"]))
    odd = placed.where("n <> 3").count()
    vertices = dense_ids(placed.drop("n"), ["g0", "g1", "g2"], "vertex_id")
    if not odd:
        vertices = written(vertices)
        named = corners.drop("x", "y", "z").join(vertices.select("vertex_id", "g0", "g1", "g2"), ["g0", "g1", "g2"])
        return written(cell_edges(named.select("cell_id", "pos", "vertex_id", "neighbor_id"))), vertices, Assembly(0, 0)
    vertices = written(vertices)
    pairs = written(near_pairs(vertices, "vertex_id", RECONCILE).select("a", "b"))
    if is_empty(pairs):
        merge = vertices.select("vertex_id", F.col("vertex_id").alias("to"))
    else:
        classes = components(pairs).select(F.col("node").alias("vertex_id"), "component")
        merge = vertices.select("vertex_id").join(classes, "vertex_id", "left").select("vertex_id", F.coalesce("component", "vertex_id").alias("to"))
    merge = written(merge)
    gone = merge.where("to <> vertex_id").count()
    named = corners.drop("x", "y", "z", "neighbor_id").join(vertices.select("vertex_id", "g0", "g1", "g2"), ["g0", "g1", "g2"]).join(merge, "vertex_id")
    cycle = Window.partitionBy("cell_id").orderBy("pos")
    whole = Window.partitionBy("cell_id")
    before = F.coalesce(F.lag("to").over(cycle), F.max_by("to", "pos").over(whole))
    kept = named.withColumn("before", before).where("to <> before").select("cell_id", "pos", F.col("to").alias("vertex_id"))
    kept = kept.withColumn("pos", F.row_number().over(cycle) - 1)
    edges = written(pair_edges(cell_edges(kept.withColumn("neighbor_id", F.lit(None).cast("bigint"))).drop("neighbor_id")))
    used = edges.select(F.col("v0").alias("vertex_id")).distinct()
    return edges, written(vertices.join(used, "vertex_id", "left_semi")), Assembly(odd, gone)


def cell_edges(corners: DataFrame) -> DataFrame:
    """(cell_id, pos, v0, v1, neighbor_id) of corners (cell_id, pos, vertex_id, neighbor_id): each corner with its cyclic successor."""
    cycle = Window.partitionBy("cell_id").orderBy("pos")
    after = F.coalesce(F.lead("vertex_id").over(cycle), F.min_by("vertex_id", "pos").over(Window.partitionBy("cell_id")))
    return corners.select("cell_id", F.col("pos").cast("int").alias("pos"), F.col("vertex_id").alias("v0"), after.alias("v1"), "neighbor_id")


def pair_edges(edges: DataFrame) -> DataFrame:
    """Edges with neighbor_id: the cell that uses the edge the other way round, null unless there is just one."""
    other = edges.groupBy(F.col("v1").alias("v0"), F.col("v0").alias("v1")).agg(F.min("cell_id").alias("c"), F.count(F.lit(1)).alias("n")).where("n = 1").select("v0", "v1", F.col("c").alias("neighbor_id"))
    return edges.join(other, ["v0", "v1"], "left").select("cell_id", "pos", "v0", "v1", "neighbor_id")


def _perturbed(sites: DataFrame) -> DataFrame | None:
    """Sites of a great circle moved off it by a hundredth of a fixed value of their id; None for other inputs.

    The circle's normal is the direction of least variance of the sites.
    """
    p = S.unit(S.vector())
    moments = sites.agg(*(F.sum(p[i] * p[j]) for i in range(3) for j in range(3))).first()
    values, vectors = np.linalg.eigh(np.array(moments).reshape(3, 3))
    normal = [float(c) for c in vectors[:, 0]]
    off = S.dot(p, S.literal(normal))
    most, square, n = sites.agg(F.max(F.abs(off)), F.avg(off * off), F.count(F.lit(1))).first()
    if most > 2e-6 or square**0.5 > 5e-7:
        return None
    s = S.stable_sign(F.col("site_id")) * 0.01
    return written(sites.select("site_id", *S.as_float(S.unit(tuple(c + float(m) * s for c, m in zip(p, normal))))))


def compute_with_report(df: DataFrame, config: VoronoiConfig = VoronoiConfig(), key: str = "site_id", x: Column | str = "x", y: Column | str = "y", z: Column | str = "z") -> SphericalVoronoi:
    """The diagram of the points of df by id column key and coordinate expressions x, y, z.

    Edges without stored length are contracted where no cell dies of it. Residuals of the output stay in the report.
    """
    radius = config.weld_radius()
    col = lambda c: F.col(c) if isinstance(c, str) else c
    sites = written(S.canonicalize(df, key, col(x), col(y), col(z)))
    S.check_sites(sites)
    canonical = weld(sites, radius)
    effective = written(sites.join(canonical.where("site_id = canonical_id"), "site_id", "left_semi"))
    n = S.check_sites(effective)
    perturbed, solved = False, effective
    try:
        found = written(cells(effective, n))
        edges, vertices, assembly = assemble(found, effective)
    except (UnsupportedGeometry, ComputationFailed):
        solved = _perturbed(effective) if config.degenerate is DegenerateMode.PERTURB_COPLANAR else None
        if solved is None:
            raise
        perturbed = True
        found = written(cells(solved, n))
        edges, vertices, assembly = assemble(found, solved)
    out = SphericalVoronoi(sites=sites, weld=canonical, cell_edges=edges, vertices=vertices, config=config)
    out.preprocess = {"requested_mode": config.preprocess.value, "threshold_used": radius, "original_points": sites.count(), "effective_points": n}
    out.degenerate = {"requested_mode": config.degenerate.value, "perturbation_applied": perturbed}
    out.assembly = assembly
    if assembly.mismatches and config.local_rebuild is LocalRebuildMode.HULL3D:
        from .repair import rebuild

        out = rebuild(out, solved)
    from .resolution import contract_zero_edges

    return contract_zero_edges(out)


def compute(df: DataFrame, config: VoronoiConfig = VoronoiConfig(), **columns) -> SphericalVoronoi:
    """compute_with_report(), but a diagram that isn't a coherent subdivision of the sphere is an error."""
    from .resolution import enforce_cell_killing

    out = compute_with_report(df, config, **columns)
    if out.assembly.mismatches or config.verify:
        issue = out.validate().first_issue()
        if issue:
            raise ComputationFailed(issue)
    enforce_cell_killing(out)
    return out


def compute_on_sphere(df: DataFrame, embedding: S.SphereEmbedding, config: VoronoiConfig = VoronoiConfig(), key: str = "site_id", x: str = "x", y: str = "y", z: str = "z") -> SphericalVoronoi:
    """compute() of world points, seen from the embedding's centre."""
    from ..errors import IndexedSphereProjectionError

    unit = written(embedding.project(df, x, y, z).select(F.col(key).cast("bigint").alias("site_id"), *S.as_float(S.vector("u"))))
    bad = unit.where("x is null").agg(F.min("site_id")).first()[0]
    if bad is not None:
        raise IndexedSphereProjectionError(bad)
    return compute(unit, config)


__all__ = ["VoronoiError", "compute", "compute_on_sphere", "compute_with_report"]
