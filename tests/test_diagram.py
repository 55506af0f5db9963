import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbiton.config import CellKillingPolicy, DegenerateMode, PreprocessMode, VoronoiConfig, check_simplification_threshold
from orbiton.errors import CellElisionError, DegenerateInput, InsufficientPoints, InvalidConfiguration, InvalidInput, UnsupportedGeometry, VoronoiError
from orbiton.functions import sphere as S
from orbiton.operators import build, quality, resolution
from orbiton.operators.build import compute, compute_on_sphere, compute_with_report
from orbiton.operators.diagram import SphericalVoronoi
from orbiton.sources import generators as G

OCTAHEDRON = np.vstack([np.eye(3), -np.eye(3)])
CUBE = [[x, y, z] for x in (-0.57735026, 0.57735026) for y in (-0.57735026, 0.57735026) for z in (-0.57735026, 0.57735026)]
CUBOCTAHEDRON = [[a, b, 0] for a in (-1, 1) for b in (-1, 1)] + [[a, 0, b] for a in (-1, 1) for b in (-1, 1)] + [[0, a, b] for a in (-1, 1) for b in (-1, 1)]
FIVE = [(0.5804965, -0.53599244, -0.612973), (-0.9531088, -0.2993283, 0.044567585), (0.08629143, -0.3427741, -0.93544626), (0.5260911, -0.6580147, -0.53874373), (0.13459253, 0.759519, -0.63640857)]
NEAR_PI = [(-0.34606427, -0.758758, -0.55183864), (0.6727604, -0.21730708, -0.7072277), (-0.75319445, 0.3688903, 0.5446265), (-0.6618142, -0.68174225, -0.31181645)]


def unit(rows):
    p = np.array(rows, float)
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def random(n, seed=0):
    return unit(np.random.default_rng(seed).normal(size=(n, 3)))


def area(d):
    return d.cell_area().agg(F.sum("area")).first()[0]


@pytest.fixture(scope="module")
def sample(spark, points):
    return compute(points(random(150)))


def test_octahedron(points):
    d = compute(points(OCTAHEDRON))
    v = d.validate()
    assert v.is_strictly_valid() and (v.num_edges, v.used_vertices, v.degree_3) == (12, 8, 8)
    assert all(abs(r.area - 4 * math.pi / 6) < 1e-9 for r in d.cell_area().collect())


@pytest.mark.parametrize("rows,vertices", [(CUBE, 6), (unit(CUBOCTAHEDRON), 14)])
def test_high_degree_vertices_are_one(points, rows, vertices):
    v = compute(points(rows)).validate()
    assert v.is_strictly_valid() and v.used_vertices == vertices


@pytest.mark.parametrize("rows", [FIVE, NEAR_PI])
def test_few_sites_with_large_cells(points, rows):
    d = compute(points(rows))
    v = d.validate()
    assert v.euler_characteristic == 2 and v.antipodal_edges == 0
    assert abs(area(d) - 4 * math.pi) < 1e-4
    sites = {r.site_id: np.array([r.x, r.y, r.z]) for r in d.sites.collect()}
    for r in d.cell_centroid().collect():
        dots = {k: float(p @ [r.x, r.y, r.z]) for k, p in sites.items()}
        assert dots[r.site_id] > max(dots.values()) - 2e-6


def test_invariants(sample):
    v = sample.validate()
    assert v.is_strictly_valid() and v.headline().startswith("valid")
    assert 5.5 < v.total_cell_vertices / v.num_cells < 6.5
    assert abs(area(sample) - 4 * math.pi) < 1e-6
    assert sample.is_complete() and sample.triangles().count() == 2 * 150 - 4


def test_triangles_wind_outward_and_are_empty(sample):
    p = {r.site_id: np.array([r.x, r.y, r.z]) for r in sample.sites.collect()}
    every = np.array(list(p.values()))
    for t in sample.triangles().collect():
        a, b, c = p[t.a], p[t.b], p[t.c]
        assert np.linalg.det([a, b, c]) > 0
        n = np.cross(b - a, c - a)
        n /= np.linalg.norm(n)
        assert (every @ n).max() <= n @ a + 1e-6


def test_blocks_equal_the_broadcast_path(spark, points, monkeypatch):
    sites = points(random(700, 4))
    whole = {tuple(sorted((t.a, t.b, t.c))) for t in compute(sites).triangles().collect()}
    monkeypatch.setattr(build, "BROADCAST_SITES", 50)
    parts = {tuple(sorted((t.a, t.b, t.c))) for t in compute(sites.repartition(7)).triangles().collect()}
    assert whole == parts


def test_crowded_blocks_get_finer(spark, monkeypatch):
    monkeypatch.setattr(build, "BROADCAST_SITES", 200)
    monkeypatch.setattr(build, "CROWDED", 150)
    v = compute(G.mega(spark, 800)).validate()
    assert v.is_strictly_valid()


def test_great_circle_is_moved_off_its_plane(spark):
    circle = G.great_circle(spark, 24)
    d = compute_with_report(circle)
    assert d.degenerate["perturbation_applied"] and d.validate().euler_characteristic == 2
    with pytest.raises(UnsupportedGeometry):
        compute(circle, VoronoiConfig(degenerate=DegenerateMode.STRICT))


def test_twins_share_a_cell(points):
    rows = np.vstack([random(30), random(30)[:1]])
    d = compute(points(rows))
    assert d.welded_twin_count() == 1 and d.canonical_cell_index(30) == 0
    cells = {r.site_id: r.vertex_ids for r in d.cells().collect()}
    assert cells[30] == cells[0] and d.effective_cell_count() == 30
    areas = {r.site_id: r.area for r in d.cell_area().collect()}
    assert areas[30] == areas[0]


def test_merge_within(points):
    rows = np.vstack([OCTAHEDRON, unit([[1, 1e-5 * i, 1e-5 * (8 - i)] for i in range(8)])])
    d = compute(points(rows), VoronoiConfig(PreprocessMode.MERGE_WITHIN, 1e-3))
    assert d.effective_cell_count() == 6 and d.validate().is_strictly_valid()


@pytest.mark.parametrize("t", [0.0, -1.0, float("nan"), float("inf"), 1e-30])
def test_bad_merge_thresholds(points, t):
    with pytest.raises(InvalidConfiguration):
        compute(points(OCTAHEDRON), VoronoiConfig(PreprocessMode.MERGE_WITHIN, t))


def test_input_errors(points):
    with pytest.raises(InsufficientPoints):
        compute(points(OCTAHEDRON[:3]))
    bad = OCTAHEDRON.copy()
    bad[2, 1], bad[4, 0] = float("nan"), float("inf")
    with pytest.raises(InvalidInput) as e:
        compute(points(bad))
    assert e.value.point_index == 2
    with pytest.raises(VoronoiError):
        compute(points([]))


def test_too_many_weld_pairs(points, monkeypatch):
    from orbiton.operators import weld

    monkeypatch.setattr(weld, "MOST_WELD_PAIRS", 3)
    with pytest.raises(DegenerateInput):
        compute(points(np.vstack([OCTAHEDRON, OCTAHEDRON[:4]])))


def test_row_order_and_partitions_do_not_matter(points):
    rows = points(random(60, 9))
    one, two = (quality.fingerprint(compute(r)).first() for r in (rows, rows.orderBy(F.desc("x")).repartition(5)))
    assert one == two


def test_lloyd_evens_out_areas(points, sample):
    spread = lambda d: d.cell_area().agg(F.stddev("area")).first()[0]
    assert spread(compute(sample.lloyd_step())) < spread(sample)


def test_save_and_load(sample, spark, tmp_path):
    sample.save(f"file://{tmp_path}/d")
    again = SphericalVoronoi.load(spark, f"file://{tmp_path}/d")
    assert again.validate() == sample.validate()
    broken = tmp_path / "d" / "weld"
    sample.weld.where("site_id <> 3").write.mode("overwrite").parquet(f"file://{broken}")
    with pytest.raises(InvalidInput):
        SphericalVoronoi.load(spark, f"file://{tmp_path}/d")


def test_world_points(spark):
    e = S.SphereEmbedding((10.0, -5.0, 2.0), 3.0)
    rows = [(i, *(3 * p + [10, -5, 2])) for i, p in enumerate(random(20, 2))]
    df = spark.createDataFrame([(i, float(x), float(y), float(z)) for i, x, y, z in rows], "site_id long, x double, y double, z double")
    assert compute_on_sphere(df, e).validate().is_strictly_valid()
    with pytest.raises(VoronoiError):
        compute_on_sphere(df.union(spark.createDataFrame([(20, 10.0, -5.0, 2.0)], df.schema)), e)
    for bad in (((float("nan"), 0, 0), 1.0), ((0, 0, 0), 0.0), ((1.7e308, 0, 0), 1e308)):
        with pytest.raises(VoronoiError):
            S.SphereEmbedding(*bad)


def test_validation_sees_damage(sample):
    import dataclasses

    edges = sample.cell_edges
    hole = dataclasses.replace(sample, cell_edges=edges.where("cell_id <> 5")).validate()
    assert hole.boundary_edges > 0 and hole.degenerate_cells == 1 and not hole.is_strictly_valid()
    flipped = dataclasses.replace(sample, cell_edges=edges.withColumns({"v0": F.when(F.col("cell_id") == 5, F.col("v1")).otherwise(F.col("v0")), "v1": F.when(F.col("cell_id") == 5, F.col("v0")).otherwise(F.col("v1"))})).validate()
    assert flipped.same_direction_edge_pairs > 0
    twice = dataclasses.replace(sample, cell_edges=edges.union(edges.where("cell_id = 5"))).validate()
    assert twice.overused_edges > 0 and twice.cells_with_duplicate_vertices == 1


def test_simplification_stays_within_the_threshold(sample):
    m = resolution.simplify(sample, 0.1)
    report, pinched = m.validate()
    assert m.report["contracted"] > 0 and m.report["max_displacement"] <= 0.1
    assert report.euler_characteristic == 2 and pinched == 0 and report.boundary_edges == 0
    assert m.cell_for_input(0) is not None and m.source_input_index(m.cell_for_input(7)) == 7


@pytest.mark.parametrize("t", [0.0, -1.0, float("nan"), 2.000001])
def test_bad_simplification_thresholds(t):
    with pytest.raises(InvalidConfiguration):
        check_simplification_threshold(t)


def test_elision_of_a_clean_diagram_changes_nothing(sample):
    m = resolution.elide_zero_edges(sample)
    assert m.report["zero_edges"] == 0 and m.num_cells() == 150 and m.num_vertices() == 296
    assert resolution.contract_zero_edges(sample).resolution["exact_zero_edges_detected"] == 0


def test_zero_edges_are_contracted_or_named(sample):
    import dataclasses

    e = sample.cell_edges.where("cell_id < neighbor_id").orderBy("cell_id", "pos").first()
    at = sample.vertex(e["v0"])
    same = F.col("vertex_id") == e["v1"]
    squeezed = dataclasses.replace(sample, vertices=sample.vertices.withColumns({c: F.when(same, F.lit(at[c])).otherwise(F.col(c)) for c in "xyz"}))
    done = resolution.contract_zero_edges(squeezed)
    assert done.resolution["exact_zero_edges_detected"] == 1 and done.resolution["exact_zero_edges_remaining"] == 0
    assert done.validate().euler_characteristic == 2
    strict = dataclasses.replace(squeezed, config=VoronoiConfig(cell_killing=CellKillingPolicy.ERROR), resolution={"exact_zero_edges_remaining": 1})
    with pytest.raises(VoronoiError):
        resolution.enforce_cell_killing(strict)


def test_elision_refuses_residuals(sample):
    import dataclasses

    open_ = dataclasses.replace(sample, cell_edges=sample.cell_edges.withColumn("neighbor_id", F.when(F.col("cell_id") == 5, None).otherwise(F.col("neighbor_id"))))
    with pytest.raises(CellElisionError):
        resolution.elide_zero_edges(open_)


def test_quality(sample):
    assert quality.vertex_residuals(sample).agg(F.max("residual")).first()[0] < 1e-9
    assert quality.edge_residuals(sample).agg(F.max("cross_track")).first()[0] < 1e-6
    assert quality.low_degree(sample).count() == 0
    assert quality.sampled_ownership(sample, 50).where("gap > 1e-6").count() == 0


def test_rebuild_mends_a_hole(sample):
    import dataclasses

    from orbiton.operators.build import pair_edges
    from orbiton.operators.repair import rebuild

    hole = dataclasses.replace(sample, cell_edges=pair_edges(sample.cell_edges.where("cell_id <> 5").drop("neighbor_id")))
    mended = rebuild(hole, sample.sites)
    assert mended.rebuild_status == "accepted" and mended.validate().is_strictly_valid()


def test_areas_add_up_to_the_sphere_in_doubles(spark):
    total = compute(G.uniform(spark, 80)).cell_area().agg(F.sum("area")).first()[0]
    assert abs(total - 4 * math.pi) < 1e-12


def test_generated_queries_take_the_distributed_paths():
    from orbiton.operators import build, locate
    from orbiton.plans import spread

    assert spread.SITES > build.BROADCAST_SITES and spread.MANY > locate.BROADCAST_SITES
