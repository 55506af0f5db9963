import numpy as np
import pytest

from orbiton.operators.kernel import clip_cells, hull_faces


def unit(p):
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def triangles(p, wide):
    n = len(p)
    order = np.argsort(-(p @ p.T), axis=1, kind="stable")
    near = np.array([[j for j in row if j != i] for i, row in enumerate(order)])
    edges, corners, status, _ = clip_cells(p, p[near], np.full(n, n - 1), wide)
    out = set()
    for i in range(n):
        if status[i] == 0:
            ids = near[i][edges[i]]
            out |= {tuple(sorted((i, int(a), int(b)))) for a, b in zip(np.roll(ids, 1), ids)}
    return out, status, corners


@pytest.mark.parametrize("n", [8, 30, 200])
@pytest.mark.parametrize("wide", [False, True])
def test_random_sites_give_the_hull(n, wide):
    p = unit(np.random.default_rng(n).normal(size=(n, 3)))
    found, status, corners = triangles(p, wide)
    assert len(found) == 2 * n - 4
    assert found == {tuple(sorted(f)) for f in hull_faces(p)}
    assert all(abs(np.linalg.norm(c, axis=1) - 1).max() < 1e-12 for c in corners)


def test_hemisphere_needs_the_wide_chart():
    p = np.random.default_rng(1).normal(size=(120, 3))
    p[:, 2] = abs(p[:, 2])
    p = unit(p)
    assert triangles(p, False)[1].any()
    found, status, _ = triangles(p, True)
    assert not status.any() and len(found) == 2 * 120 - 4


def test_a_pole_of_many_neighbours_grows_the_arrays():
    t = np.linspace(0, 2 * np.pi, 60, endpoint=False)
    p = unit(np.vstack([[[0, 0, 1.0]], np.stack([np.cos(t), np.sin(t), np.full(60, 0.5)], axis=1), [[0, 0, -1.0]]]))
    near = np.array([[j for j in np.argsort(-(p @ q)) if j != i] for i, q in enumerate(p)])
    edges, _, status, _ = clip_cells(p, p[near], np.full(len(p), len(p) - 1), True)
    assert status[0] == 0 and len(edges[0]) == 60


def test_hull_of_a_plane_has_no_faces():
    t = np.linspace(0, 2 * np.pi, 9, endpoint=False)
    assert hull_faces(np.stack([np.cos(t), np.sin(t), np.zeros(9)], axis=1)) == []
