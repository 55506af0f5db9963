"""Edges that stored coordinates can't tell apart, short edges, and meshes without them."""

from __future__ import annotations

import dataclasses
import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..config import CellKillingPolicy, check_simplification_threshold
from ..errors import CellElisionError, CellEliminationRequired
from ..functions import sphere as S
from ..tables import components, dense_ids, is_empty, written
from .build import cell_edges, pair_edges
from .diagram import SphericalVoronoi


def zero_edges(d: SphericalVoronoi) -> DataFrame:
    """(v0, v1), v0 < v1: edges whose distinct ends have equal stored (32-bit) coordinates."""
    same = [F.col(f"a{c}").cast("float") == F.col(f"b{c}").cast("float") for c in "xyz"]
    return d.geometry.where((F.col("v0") != F.col("v1")) & same[0] & same[1] & same[2]).select(F.least("v0", "v1").alias("v0"), F.greatest("v0", "v1").alias("v1")).distinct()


def quotient(edges: DataFrame, merge: DataFrame) -> DataFrame:
    """cell_edges with vertices replaced by merge (vertex_id, to), repeats in a row dropped and positions renumbered."""
    cycle, whole = Window.partitionBy("cell_id").orderBy("pos"), Window.partitionBy("cell_id")
    named = edges.select("cell_id", "pos", F.col("v0").alias("vertex_id")).join(merge, "vertex_id", "left").select("cell_id", "pos", F.coalesce("to", "vertex_id").alias("to"))
    before = F.coalesce(F.lag("to").over(cycle), F.max_by("to", "pos").over(whole))
    kept = named.withColumn("_b", before).where("to <> _b").select("cell_id", "pos", F.col("to").alias("vertex_id")).withColumn("pos", F.row_number().over(cycle) - 1)
    return cell_edges(kept.withColumn("neighbor_id", F.lit(None).cast("bigint"))).drop("neighbor_id")


def contract_zero_edges(d: SphericalVoronoi) -> SphericalVoronoi:
    """The diagram with components of zero edges contracted, save those that would leave a cell under three corners.

    Components that share a cell are contracted or kept together. Counts are in `resolution`.
    """
    zero = written(zero_edges(d))
    found = zero.count()
    if not found:
        return dataclasses.replace(d, resolution=_counts(0, 0, 0, 0, 0, 0))
    parts = written(components(zero, "v0", "v1"))
    touched = d.cell_edges.join(parts.select(F.col("node").alias("v0"), "component"), "v0")
    by_cell = touched.groupBy("cell_id").agg(F.min("component").alias("lo"), F.collect_set("component").alias("all"))
    links = by_cell.select(F.explode("all").alias("b"), F.col("lo").alias("a"))
    grouped = components(links) if not is_empty(links.where("a <> b")) else None
    after = d.cell_edges.join(parts.select(F.col("node").alias("v0"), "component"), "v0", "left").groupBy("cell_id").agg(F.countDistinct(F.coalesce("component", "v0")).alias("k"))
    killed = by_cell.join(after, "cell_id").where("k < 3").select(F.explode("all").alias("component")).distinct()
    whole = parts.select("component").distinct()
    group = whole.join(grouped.select(F.col("node").alias("component"), F.col("component").alias("g")), "component", "left") if grouped is not None else whole.withColumn("g", F.lit(None).cast("bigint"))
    group = group.select("component", F.coalesce("g", "component").alias("g"))
    bad = group.join(killed, "component", "left_semi").select("g").distinct()
    good = written(group.join(bad, "g", "left_anti").select("component"))
    merge = parts.join(good, "component", "left_semi").select(F.col("node").alias("vertex_id"), F.col("component").alias("to"))
    edges = written(pair_edges(quotient(d.cell_edges, merge)))
    n_parts, n_good = whole.count(), good.count()
    gone = zero.join(parts.select(F.col("node").alias("v0"), "component"), "v0").join(good, "component", "left_semi").count()
    out = dataclasses.replace(d, cell_edges=edges, resolution=_counts(found, n_parts, gone, n_good, n_parts - n_good, found - gone))
    return out.compact_vertices()[0] if n_good else out


def _counts(edges, parts, gone, contracted, preserved, left) -> dict:
    return {"exact_zero_edges_detected": edges, "exact_zero_components_detected": parts, "exact_zero_edges_contracted": gone, "exact_zero_components_contracted": contracted, "cell_killing_components_preserved": preserved, "topology_rejected_components": 0, "exact_zero_edges_remaining": left}


def enforce_cell_killing(d: SphericalVoronoi) -> None:
    """Under the error policy, zero edges that could not be contracted raise, naming all inputs of the affected cells.

    The ids are the error's own content, so all of them come to the driver.
    """
    if d.config.cell_killing is not CellKillingPolicy.ERROR or not d.resolution.get("exact_zero_edges_remaining"):
        return
    hit = d.cell_edges.join(zero_edges(d).select("v0").distinct(), "v0", "left_semi").select(F.col("cell_id").alias("canonical_id")).distinct()
    ids = sorted(r["site_id"] for r in d.weld.join(hit, "canonical_id", "left_semi").select("site_id").collect())
    raise CellEliminationRequired(ids, d.resolution["exact_zero_edges_remaining"])


# Meshes ------------------------------------------------------------------------------------------------


@dataclasses.dataclass
class SphericalCellMesh:
    """A dense cell complex with provenance; no claim to be a Voronoi diagram any more.

    mesh_vertices (vertex_id, x, y, z), mesh_cells (cell_id, pos, v0, v1, neighbor_id), input_map (site_id,
    cell_id or null), source_sites (cell_id, site_id).
    """

    mesh_vertices: DataFrame
    mesh_cells: DataFrame
    input_map: DataFrame
    source_sites: DataFrame
    report: dict

    def num_cells(self) -> int:
        return self.source_sites.count()

    def num_vertices(self) -> int:
        return self.mesh_vertices.count()

    def cell_for_input(self, site_id: int) -> int | None:
        row = self.input_map.where(F.col("site_id") == site_id).first()
        return None if row is None else row["cell_id"]

    def source_input_index(self, cell_id: int) -> int | None:
        row = self.source_sites.where(F.col("cell_id") == cell_id).first()
        return None if row is None else row["site_id"]

    def adjacency(self) -> DataFrame:
        return self.mesh_cells.select("cell_id", "pos", "neighbor_id")

    def validate(self):
        """ValidationReport of the mesh as a subdivision, and disconnected_vertex_links."""
        cells = self.source_sites.select("cell_id", "site_id")
        as_diagram = SphericalVoronoi(
            sites=self.mesh_vertices.select(F.col("vertex_id").alias("site_id"), *(F.col(c).cast("float").alias(c) for c in "xyz")).limit(0).unionByName(cells.select(F.col("cell_id").alias("site_id"), *(F.lit(0.0).cast("float").alias(c) for c in "xyz"))),
            weld=cells.select(F.col("cell_id").alias("site_id"), F.col("cell_id").alias("canonical_id")), cell_edges=self.mesh_cells, vertices=self.mesh_vertices)
        return as_diagram.validate(), disconnected_links(self.mesh_cells)


def disconnected_links(edges: DataFrame) -> int:
    """Vertices around which the cells form more than one fan (a pinch).

    Around a vertex each cell has one edge that comes in and one that goes out; following the cell across its
    outgoing edge walks the fan. The cells of a vertex are few; fans are counted as components of the pairs.
    """
    out = edges.select(F.col("v0").alias("v"), "cell_id", "neighbor_id").where("neighbor_id is not null")
    link = F.aggregate(F.sequence(F.lit(1), F.size("n")), F.struct(F.element_at("n", 1).getField("cell_id").alias("at"), F.lit(0).alias("steps"), F.lit(False).alias("done")),
                       lambda a, i: F.when(a["done"], a).otherwise(F.struct(F.element_at(F.map_from_entries("n"), a["at"]).alias("at"), (a["steps"] + 1).alias("steps"), (F.element_at(F.map_from_entries("n"), a["at"]) == F.element_at("n", 1).getField("cell_id")).alias("done"))))
    rings = out.groupBy("v").agg(F.collect_list(F.struct("cell_id", "neighbor_id")).alias("n"), F.countDistinct("cell_id").alias("d")).where(F.size("n") == F.col("d"))
    return rings.where(link["steps"] < F.size("n")).count()


def as_mesh(d: SphericalVoronoi, report: dict) -> SphericalCellMesh:
    """The diagram's cells of three corners or more, dense in cells and vertices, with provenance."""
    size = d.cell_edges.groupBy("cell_id").agg(F.countDistinct("v0").alias("k")).where("k >= 3").select(F.col("cell_id").alias("site_id"))
    cells = written(dense_ids(size, ["site_id"], "cell_id"))
    kept = d.cell_edges.join(cells.select(F.col("site_id").alias("cell_id"), F.col("cell_id").alias("_c")), "cell_id")
    used = kept.select(F.col("v0").alias("old")).distinct()
    ids = written(dense_ids(used, ["old"], "vertex_id"))
    edges = kept.join(ids.select(F.col("old").alias("v0"), F.col("vertex_id").alias("_a")), "v0").join(ids.select(F.col("old").alias("v1"), F.col("vertex_id").alias("_b")), "v1")
    edges = pair_edges(edges.select(F.col("_c").alias("cell_id"), "pos", F.col("_a").alias("v0"), F.col("_b").alias("v1")))
    vertices = ids.join(d.vertices, ids["old"] == d.vertices["vertex_id"]).select(ids["vertex_id"], "x", "y", "z")
    provenance = d.weld.join(cells.select(F.col("site_id").alias("canonical_id"), "cell_id"), "canonical_id", "left").select("site_id", "cell_id")
    return SphericalCellMesh(written(vertices), written(edges), written(provenance), cells.select("cell_id", "site_id"), report)


def short_edges(d: SphericalVoronoi, threshold: float) -> DataFrame:
    """(chord2, v0, v1): edges of positive length up to the threshold, shortest first by (length, v0, v1)."""
    c = S.chord2(S.vector("a"), S.vector("b"))
    return d.geometry.select(c.alias("chord2"), F.least("v0", "v1").alias("v0"), F.greatest("v0", "v1").alias("v1")).where((F.col("chord2") > 0) & (F.col("chord2") <= threshold * threshold)).distinct()


def simplify(d: SphericalVoronoi, threshold: float) -> SphericalCellMesh:
    """Edges up to the threshold contracted, so that no vertex moves farther than the threshold; one batch.

    Candidates are taken shortest first. Two clusters with radii ra, rb and representatives at distance d
    join if max(ra, d + rb) or max(rb, d + ra) stays within the threshold, the smaller one wins; ties keep the
    larger cluster, then the lower id. The order matters, so all candidates and the cells about them are
    worked on in one place, as arrays (`contract_in_order`). Contractions that would kill a cell are not made,
    nor those after which two edges had the same ends or a cell touched itself.
    """
    threshold = check_simplification_threshold(threshold)
    listed = written(short_edges(d, threshold))
    table = listed.toArrow()
    report = {"candidates": table.num_rows, "contracted": 0, "max_displacement": 0.0}
    if not table.num_rows:
        return as_mesh(d, report)
    ends = listed.select(F.col("v0").alias("vertex_id")).union(listed.select("v1")).distinct()
    hit = d.cell_edges.join(ends.withColumnRenamed("vertex_id", "v0"), "v0", "left_semi").select("cell_id").distinct()
    around = d.cell_edges.join(hit, "cell_id", "left_semi").select("cell_id", "pos", "v0", "v1").toArrow()
    places = d.vertices.join(ends, "vertex_id", "left_semi").select("vertex_id", "x", "y", "z").toArrow()
    columns = lambda t: [t[c].to_numpy() for c in t.column_names]
    gone, kept, report["max_displacement"] = contract_in_order(columns(table), columns(around), columns(places), threshold)
    report["contracted"] = len(gone)
    merge = d.sites.sparkSession.createDataFrame(pa.table({"vertex_id": gone, "to": kept}))
    edges = written(pair_edges(quotient(d.cell_edges, merge)))
    return as_mesh(dataclasses.replace(d, cell_edges=edges), report)


def contract_in_order(listed: list[np.ndarray], around: list[np.ndarray], places: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Vertices that went, the representative of each, and the largest displacement bound.

    listed: chord2, v0, v1 of the candidates; around: cell_id, pos, v0, v1 of all edges of the cells that meet
    one; places: vertex_id, x, y, z of their ends. Each edge of a cell knows its neighbours in the cell and its
    twin in the other cell, so that a contraction touches only the stars of its ends.
    """
    chord2, v0, v1 = listed
    order = np.lexsort((v1, v0, chord2))
    cell_id, pos, start, end = around
    by = np.lexsort((pos, cell_id))
    ids, index = np.unique(np.concatenate((start[by], end[by])), return_inverse=True)
    n, m = len(by), len(ids)
    start, end = index[:n], index[n:]
    first = np.flatnonzero(np.diff(cell_id[by], prepend=cell_id[by][0] - 1))
    sizes = np.diff(first, append=n)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[first + sizes - 1], before[first] = first, first + sizes - 1
    code = start * m + end
    sort = np.argsort(code)
    ranked = code[sort]

    def numbers(wanted: np.ndarray) -> np.ndarray:
        """The edge of each code, -1 unless there is just one."""
        lo, hi = np.searchsorted(ranked, wanted), np.searchsorted(ranked, wanted, side="right")
        return np.where(hi - lo == 1, sort[np.minimum(lo, n - 1)], -1)

    at = np.searchsorted(ids, v0)[order], np.searchsorted(ids, v1)[order]
    forth, back = numbers(at[0] * m + at[1]), numbers(at[1] * m + at[0])
    wanted = np.where((forth >= 0) & (back >= 0), forth, -1)
    place = np.zeros((m, 3))
    place[np.searchsorted(ids, places[0])] = np.stack(places[1:], axis=1)
    flat = lambda a, kind="q": array(kind, np.ascontiguousarray(a, np.int64 if kind == "q" else np.float64).tobytes())
    origin, next_, prior, size = flat(start), flat(after), flat(before), flat(sizes)
    twin, cell = flat(numbers(end * m + start)), flat(np.repeat(np.arange(len(first)), sizes))
    x, y, z = (flat(place[:, i], "d") for i in range(3))
    radius, members, to = flat(np.zeros(m), "d"), flat(np.ones(m)), flat(np.arange(m))
    most = 0.0

    def star(h: int) -> list[int]:
        """The edges that start where h does; none if they don't close."""
        out, e = [h], twin[prior[h]]
        while e != h:
            if e < 0:
                return []
            out.append(e)
            e = twin[prior[e]]
        return out

    for h in wanted.tolist():
        t = twin[h] if h >= 0 else -1
        if t < 0 or size[cell[h]] <= 3 or size[cell[t]] <= 3:
            continue
        a, b = origin[h], origin[t]
        gap = math.sqrt((x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2 + (z[a] - z[b]) ** 2)
        options = sorted((r, -members[k], k) for r, k in ((max(radius[a], gap + radius[b]), a), (max(radius[b], gap + radius[a]), b)) if r <= threshold)
        if not options:
            continue
        here, there = star(h), star(t)
        if not here or not there or len({cell[e] for e in here} & {cell[e] for e in there}) != 2:
            continue
        if not {origin[next_[e]] for e in here}.isdisjoint([origin[next_[e]] for e in there]):
            continue
        reach, _, keep = options[0]
        gone = b if keep == a else a
        for e in there if keep == a else here:
            origin[e] = keep
        for e in (h, t):
            next_[prior[e]], prior[next_[e]] = next_[e], prior[e]
            size[cell[e]] -= 1
        to[gone], radius[keep], members[keep] = keep, reach, members[a] + members[b]
        most = max(most, reach)
    root = np.frombuffer(to, np.int64)
    while (root[root] != root).any():
        root = root[root]
    moved = np.flatnonzero(root != np.arange(m))
    return ids[moved], ids[root[moved]], most


def elide_zero_edges(d: SphericalVoronoi) -> SphericalCellMesh:
    """All zero edges contracted, cells under three corners dropped and vertices of two edges suppressed.

    The result must be a valid subdivision without pinches; else CellElisionError, and d stays as it was.
    """
    if not d.is_complete():
        raise CellElisionError("residuals", "the diagram has unpaired edges")
    zero = written(zero_edges(d))
    report = {"zero_edges": zero.count()}
    edges = d.cell_edges
    if report["zero_edges"]:
        merge = components(zero, "v0", "v1").select(F.col("node").alias("vertex_id"), F.col("component").alias("to"))
        edges = quotient(edges, merge)
        alive = edges.groupBy("cell_id").agg(F.countDistinct("v0").alias("k")).where("k >= 3").select("cell_id")
        edges = written(edges.join(alive, "cell_id", "left_semi"))
        thin = edges.groupBy("v0").agg(F.countDistinct("cell_id").alias("k")).where("k < 3").select("v0")
        cycle = Window.partitionBy("cell_id").orderBy("pos")
        kept = edges.join(thin, "v0", "left_anti").select("cell_id", F.col("v0").alias("vertex_id"), "pos").withColumn("pos", F.row_number().over(cycle) - 1)
        edges = written(pair_edges(cell_edges(kept.withColumn("neighbor_id", F.lit(None).cast("bigint"))).drop("neighbor_id")))
    mesh = as_mesh(dataclasses.replace(d, cell_edges=edges), report)
    found, pinched = mesh.validate()
    if pinched or found.euler_characteristic != 2 or found.boundary_edges or found.overused_edges:
        raise CellElisionError("invalid mesh", found.headline())
    return mesh


def compute_simplified(df: DataFrame, threshold: float, **kwargs) -> SphericalCellMesh:
    from .build import compute

    check_simplification_threshold(threshold)
    return simplify(compute(df, **kwargs), threshold)
