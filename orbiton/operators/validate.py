"""Validation of a diagram: counters, the strict gate, and its wording."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, functions as F

from ..config import NEAR_PI, ON_SPHERE
from ..functions import sphere as S
from ..tables import components, written
from .diagram import SphericalVoronoi


@dataclasses.dataclass(frozen=True)
class ValidationReport:
    num_cells: int
    num_vertices: int
    used_vertices: int
    num_edges: int
    euler_characteristic: int
    connected_components: int
    degenerate_cells: int
    cells_with_fewer_than_three_stored_positions: int
    cells_with_duplicate_vertices: int
    cells_with_invalid_references: int
    invalid_vertex_references: int
    duplicate_cells_count: int
    unique_cells: int
    welded_twin_cells: int
    weld_map_issues: int
    total_cell_vertices: int
    vertices_off_sphere: int
    orphan_vertices: int
    low_incidence_vertices: int
    degree_0: int
    degree_1: int
    degree_2: int
    degree_3: int
    degree_4_plus: int
    self_loop_edges: int
    zero_length_edges: int
    antipodal_edges: int
    boundary_edges: int
    overused_edges: int
    same_direction_edge_pairs: int

    #: Checks of the strict gate, in order: each must be zero.
    STRICT = ("cells_with_invalid_references", "degenerate_cells", "cells_with_duplicate_vertices", "self_loop_edges", "boundary_edges", "overused_edges", "same_direction_edge_pairs", "duplicate_cells_count", "low_incidence_vertices", "weld_map_issues", "vertices_off_sphere", "antipodal_edges")

    def first_issue(self) -> str | None:
        """The first check of the strict gate that fails."""
        for name in self.STRICT:
            if getattr(self, name):
                return f"{name}: {getattr(self, name)}"
        if self.connected_components != 1:
            return f"connected_components: {self.connected_components}"
        if self.euler_characteristic != 2:
            return f"euler_characteristic: {self.euler_characteristic}"
        return None

    def is_strictly_valid(self) -> bool:
        return self.first_issue() is None

    def subdivision_issues(self) -> list[str]:
        out = [f"{n}: {getattr(self, n)}" for n in self.STRICT[:9] if getattr(self, n)]
        if self.euler_characteristic != 2:
            out.append(f"euler_characteristic: {self.euler_characteristic}")
        if self.connected_components != 1:
            out.append(f"connected_components: {self.connected_components}")
        return out

    def invariant_issues(self) -> list[str]:
        return [f"{n}: {getattr(self, n)}" for n in self.STRICT[9:] if getattr(self, n)]

    def representation_notes(self) -> list[str]:
        return [f"{n}: {getattr(self, n)}" for n in ("orphan_vertices", "zero_length_edges", "cells_with_fewer_than_three_stored_positions", "welded_twin_cells") if getattr(self, n)]

    def headline(self) -> str:
        state = "valid" if self.is_strictly_valid() else f"invalid ({self.first_issue()})"
        return f"{state}: {self.num_cells} cells, {self.num_edges} edges, {self.used_vertices} vertices"


def edge_uses(edges: DataFrame) -> DataFrame:
    """(lo, hi, forward, reverse): how often an undirected edge is used each way."""
    lo, hi = F.least("v0", "v1"), F.greatest("v0", "v1")
    return edges.where("v0 <> v1").groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.sum(F.when(F.col("v0") < F.col("v1"), 1).otherwise(0)).alias("forward"), F.sum(F.when(F.col("v0") > F.col("v1"), 1).otherwise(0)).alias("reverse"))


def counters(d: SphericalVoronoi) -> DataFrame:
    """One row with the columns of ValidationReport."""
    edges = d.cell_edges
    vertices = d.vertices
    known = vertices.select(F.col("vertex_id").alias("v0"), *(F.col(c).cast("float").alias(f"p{c}") for c in "xyz"))
    at = written(edges.join(known, "v0", "left"))
    n = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(name)
    by_cell = at.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("v0").alias("d"), F.countDistinct("px", "py", "pz").alias("p"), F.sum(F.col("px").isNull().cast("int")).alias("bad"), F.xxhash64(F.array_sort(F.collect_list("v0"))).alias("sign"))
    roots = d.weld.where("site_id = canonical_id").select(F.col("site_id").alias("cell_id"))
    by_cell = roots.join(by_cell, "cell_id", "left").fillna(0, ["n", "d", "p", "bad"])
    cells = by_cell.agg(F.count(F.lit(1)).alias("faces"), n(F.col("d") < 3, "degenerate_cells"), n((F.col("p") < 3) & (F.col("bad") == 0), "cells_with_fewer_than_three_stored_positions"), n(F.col("d") < F.col("n"), "cells_with_duplicate_vertices"), n(F.col("bad") > 0, "cells_with_invalid_references"), F.sum("bad").cast("bigint").alias("invalid_vertex_references"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_cell_vertices"), F.countDistinct("sign").alias("unique_cells"))
    uses = edge_uses(edges)
    near = F.col("forward") + F.col("reverse")
    used = uses.agg(F.count(F.lit(1)).alias("num_edges"), n(near < 2, "boundary_edges"), n(near > 2, "overused_edges"), n((near == 2) & (F.col("forward") != 1), "same_direction_edge_pairs"))
    loops = edges.agg(n(F.col("v0") == F.col("v1"), "self_loop_edges"))
    degree = vertices.select("vertex_id").join(edges.groupBy(F.col("v0").alias("vertex_id")).agg(F.countDistinct("cell_id").alias("k")), "vertex_id", "left").fillna(0, ["k"])
    incidence = degree.agg(F.count(F.lit(1)).alias("num_vertices"), n(F.col("k") > 0, "used_vertices"), n(F.col("k") == 0, "orphan_vertices"), n(F.col("k").between(1, 2), "low_incidence_vertices"), *(n(F.col("k") == i, f"degree_{i}") for i in range(4)), n(F.col("k") >= 4, "degree_4_plus"))
    norm = S.dot(S.vector(), S.vector())
    off = vertices.agg(n(~S.finite(S.vector()) | (F.abs(norm - 1) > ON_SPHERE), "vertices_off_sphere"))
    g = d.geometry
    a, b = S.vector("a"), S.vector("b")
    far = S.dot(a, b) <= -1 + NEAR_PI
    same = [F.col(f"a{c}").cast("float") == F.col(f"b{c}").cast("float") for c in "xyz"]
    once = (F.col("neighbor_id").isNull()) | (F.col("cell_id") < F.col("neighbor_id"))
    shape = g.where(once).agg(n((F.col("v0") != F.col("v1")) & same[0] & same[1] & same[2], "zero_length_edges"), n(far & F.col("hx").isNull(), "open_far"))
    arcs = d.long_edges.where("cell_id < neighbor_id").agg(n(F.col("arc_kind").isin("exact_pi", "invalid"), "bad_arcs"))
    twins = d.weld.agg(F.count(F.lit(1)).alias("num_cells"), n(F.col("site_id") != F.col("canonical_id"), "welded_twin_cells"))
    wrong = d.weld.where("site_id <> canonical_id").join(roots.withColumnRenamed("cell_id", "canonical_id"), "canonical_id", "left_anti").agg(F.count(F.lit(1)).alias("weld_map_issues"))
    joined = d.adjacent_pairs()
    linked = components(joined)
    # Cells without any neighbour are components of their own.
    parts = roots.join(linked, roots["cell_id"] == linked["node"], "left").agg(F.countDistinct(F.coalesce("component", "cell_id")).alias("connected_components"))
    out = cells
    for other in (used, loops, incidence, off, shape, arcs, twins, wrong, parts):
        out = out.crossJoin(F.broadcast(other))  # one row each
    out = out.withColumn("duplicate_cells_count", F.col("faces") - F.col("unique_cells")).withColumn("euler_characteristic", F.col("used_vertices") - F.col("num_edges") + F.col("faces"))
    out = out.withColumn("antipodal_edges", F.col("open_far") + F.col("bad_arcs"))
    return out.select(*(F.col(f.name).cast("bigint").alias(f.name) for f in dataclasses.fields(ValidationReport)))


def validate(d: SphericalVoronoi) -> ValidationReport:
    return ValidationReport(**counters(d).first().asDict())
