"""Simplification against a version that keeps whole cycles, and where many edges are candidates."""

import numpy as np
import pytest

from orbiton.operators import resolution
from orbiton.operators.build import compute
from orbiton.sources import generators as G


@pytest.fixture(scope="module")
def dense(spark):
    return compute(G.uniform(spark, 400))


def brute(d, threshold):
    """Contracted edges and the lengths of the cycles after them."""
    cycles = {}
    for r in d.cell_edges.orderBy("cell_id", "pos").collect():
        cycles.setdefault(r.cell_id, []).append(r.v0)
    place = {r.vertex_id: np.array([r.x, r.y, r.z]) for r in d.vertices.collect()}
    to, radius, members = {v: v for v in place}, dict.fromkeys(place, 0.0), dict.fromkeys(place, 1)
    done = 0
    for r in resolution.short_edges(d, threshold).orderBy("chord2", "v0", "v1").collect():
        a, b = to[r.v0], to[r.v1]
        gap = float(np.linalg.norm(place[a] - place[b]))
        ways = sorted((m, -members[k], k) for m, k in ((max(radius[a], gap + radius[b]), a), (max(radius[b], gap + radius[a]), b)) if m <= threshold)
        shared = [c for c in cycles if a in cycles[c] and b in cycles[c]]
        if a == b or not ways or any(len(cycles[c]) <= 3 for c in shared):
            continue
        around = [{w for c in cycles.values() if v in c for w in (c[c.index(v) - 1], c[(c.index(v) + 1) % len(c)])} for v in (a, b)]
        if len(shared) != 2 or around[0] & around[1]:
            continue
        reach, _, keep = ways[0]
        gone = b if keep == a else a
        radius[keep], members[keep], done = reach, members[a] + members[b], done + 1
        to = {v: keep if w == gone else w for v, w in to.items()}
        for c in shared:
            cycles[c].remove(gone)
        cycles = {c: [keep if v == gone else v for v in vs] for c, vs in cycles.items()}
    return done, sorted(map(len, cycles.values()))


@pytest.mark.parametrize("threshold", [0.03, 0.15, 0.6])
def test_simplification_equals_brute_force(dense, threshold, monkeypatch):
    monkeypatch.setattr(resolution, "MOST_CANDIDATES", 3, raising=False)
    m = resolution.simplify(dense, threshold)
    done, lengths = brute(dense, threshold)
    assert m.report["contracted"] == done > 0 and m.report["max_displacement"] <= threshold
    assert sorted(r["count"] for r in m.mesh_cells.groupBy("cell_id").count().collect()) == lengths
    report, pinched = m.validate()
    assert report.num_cells == 400 and report.euler_characteristic == 2 and not pinched
    assert not report.boundary_edges and not report.overused_edges


def test_no_two_edges_get_the_same_ends():
    """Two prisms on one triangle 0, 1, 2 that is no cell: without edge 0-1 its other two edges had the same ends."""
    cells = [(0, 1, 4, 3), (1, 2, 5, 4), (2, 0, 3, 5), (3, 4, 5), (1, 0, 6, 7), (2, 1, 7, 8), (0, 2, 8, 6), (6, 8, 7)]
    around = np.array([(c, i, v, vs[(i + 1) % len(vs)]) for c, vs in enumerate(cells) for i, v in enumerate(vs)]).T
    places = [np.arange(9), *np.random.default_rng(0).normal(size=(3, 9))]
    one = lambda a, b: [np.array([1.0]), np.array([a]), np.array([b])]
    assert not len(resolution.contract_in_order(one(0, 1), list(around), places, 9.0)[0])
    gone, kept, _ = resolution.contract_in_order(one(0, 3), list(around), places, 9.0)
    assert gone.tolist() == [3] and kept.tolist() == [0]
