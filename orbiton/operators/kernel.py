"""Cells as polygons: half-plane clipping of many cells at once, in NumPy."""

from __future__ import annotations

import numpy as np

#: Corner of the first triangle of a chart, and the half extent beyond which a chart is not trusted.
FAR, TRUSTED = 1e7, 1e3
UNBOUNDED, CLIPPED_AWAY = 1, 2


def _norm(v: np.ndarray) -> np.ndarray:
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _basis(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """t1, t2 with (t1, t2, c) right-handed, for rows of unit vectors."""
    axis = np.zeros_like(c)
    axis[np.arange(len(c)), np.abs(c).argmin(axis=1)] = 1.0
    t1 = _norm(np.cross(axis, c))
    return t1, np.cross(c, t1)


def clip_cells(sites: np.ndarray, neighbors: np.ndarray, counts: np.ndarray, wide: bool = False) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Clip every cell by its neighbours' half-planes, nearest first.

    sites [B, 3] and neighbors [B, K, 3] are unit vectors, of row b the first counts[b] neighbours count,
    ordered by rising distance. A cell is drawn in the gnomonic chart about its site; wide: about the mean
    of its planes' normals, where every cell of three planes or more lies within the chart.

    Returns by cell the neighbour numbers of its edges (counter-clockwise) and its corners (corner i is
    where edge i starts), the status (0, UNBOUNDED or CLIPPED_AWAY), and 2 sin of the farthest corner's
    angle from the site: no site at that chord or beyond can change the cell.
    """
    b, k = neighbors.shape[:2]
    valid = np.arange(k) < counts[:, None]
    normals = sites[:, None, :] - neighbors
    size = np.linalg.norm(normals, axis=2, keepdims=True)
    normals = np.where(valid[:, :, None], normals / np.where(size > 0, size, 1), 0.0)
    chart = sites
    if wide:
        mean = normals.sum(axis=1)
        length = np.linalg.norm(mean, axis=1, keepdims=True)
        chart = np.where(length > 1e-9, mean / np.where(length > 0, length, 1), sites)
    t1, t2 = _basis(chart)
    lines = np.stack([np.einsum("bkj,bj->bk", normals, v) for v in (t1, t2, chart)], axis=2)
    room = 16
    corners, edges = np.zeros((b, room, 2)), np.full((b, room), -1)
    corners[:, :3] = FAR * np.array([[-0.8660254037844386, -0.5], [0.8660254037844386, -0.5], [0.0, 1.0]])
    edges[:, :3] = [-1, -2, -3]
    n, status = np.full(b, 3), np.zeros(b, np.int64)
    distance = size[:, :, 0]
    live = np.arange(b)

    def reach(rows: np.ndarray) -> np.ndarray:
        held = np.arange(corners.shape[1]) < n[rows, None]
        p = corners[rows]
        v = p[:, :, :1] * t1[rows, None] + p[:, :, 1:] * t2[rows, None] + chart[rows, None]
        cos = np.einsum("bvj,bj->bv", v, sites[rows]) / np.linalg.norm(v, axis=2)
        cos = np.where(held, cos, 1.0).min(axis=1)
        fake = (np.where(held, edges[rows], 0) < 0).any(axis=1)
        return np.where(fake | (cos <= 0), 3.0, 2 * np.sqrt(np.maximum(0.0, 1 - cos * cos)) + 1e-9)

    for step in range(k):
        live = live[valid[live, step] & (status[live] == 0)]
        if not len(live):
            break
        if step >= 4 and step % 2 == 0:
            live = live[distance[live, step] < reach(live)]
            if not len(live):
                break
        if n[live].max() + 2 > corners.shape[1]:
            more = corners.shape[1]
            corners = np.concatenate((corners, np.zeros((b, more, 2))), axis=1)
            edges = np.concatenate((edges, np.full((b, more), -1)), axis=1)
        width = corners.shape[1]
        p, e, m = corners[live], edges[live], n[live]
        line = lines[live, step]
        d = p[:, :, 0] * line[:, :1] + p[:, :, 1] * line[:, 1:2] + line[:, 2:]
        held = np.arange(width) < m[:, None]
        inside = (d >= 0) & held
        kept = inside.sum(axis=1)
        status[live[kept == 0]] = CLIPPED_AWAY
        cut = np.flatnonzero((kept < m) & (kept > 0))
        if not len(cut):
            continue
        rows = live[cut]
        p, e, m, d, inside, kept = p[cut], e[cut], m[cut], d[cut], inside[cut], kept[cut]
        r = np.arange(len(cut))
        before = np.take_along_axis(inside, (np.arange(width)[None, :] - 1) % m[:, None], axis=1)
        start = (inside & ~before).argmax(axis=1)
        order = (start[:, None] + np.arange(width)[None, :]) % m[:, None]
        new_p, new_e = np.take_along_axis(p, order[:, :, None], axis=1), np.take_along_axis(e, order, axis=1)
        last = (start + kept - 1) % m
        after, prior = (last + 1) % m, (start - 1) % m
        t = d[r, last] / (d[r, last] - d[r, after])
        exit_ = p[r, last] + t[:, None] * (p[r, after] - p[r, last])
        t = d[r, prior] / (d[r, prior] - d[r, start])
        enter = p[r, prior] + t[:, None] * (p[r, start] - p[r, prior])
        new_p[r, kept], new_p[r, kept + 1] = exit_, enter
        new_e[r, kept], new_e[r, kept + 1] = step, e[r, prior]
        corners[rows], edges[rows], n[rows] = new_p, new_e, kept + 2
    far = reach(np.arange(b)) if b else np.empty(0)
    held = np.arange(corners.shape[1]) < n[:, None]
    fake = (np.where(held, edges, 0) < 0).any(axis=1)
    extent = np.where(held, np.abs(corners).max(axis=2), 0).max(axis=1) if b else np.empty(0)
    status = np.where((status == 0) & (fake | (extent > (FAR / 10 if wide else TRUSTED))), UNBOUNDED, status)
    out_edges, out_corners = [], []
    for i in range(b):
        c = corners[i, : n[i]]
        out_edges.append(edges[i, : n[i]])
        out_corners.append(_norm(c[:, :1] * t1[i] + c[:, 1:] * t2[i] + chart[i]))
    return out_edges, out_corners, status, far


def hull_faces(points: np.ndarray) -> list[tuple[int, int, int]]:
    """Faces, counter-clockwise from outside, of the convex hull of points on the sphere; exact orientation, ties not visible.

    Incremental; for the few sites of a repair, not for whole diagrams.
    """
    from fractions import Fraction

    exact = [tuple(Fraction(float(c)) for c in p) for p in points]

    def orient(a, b, c, d) -> int:
        v = points[[b, c, d]] - points[a]
        s = float(np.linalg.det(v))
        if abs(s) > 1e-14 * max(1e-30, float(np.abs(v).max()) ** 3) * 64:
            return 1 if s > 0 else -1
        u = [[exact[q][i] - exact[a][i] for i in range(3)] for q in (b, c, d)]
        e = u[0][0] * (u[1][1] * u[2][2] - u[1][2] * u[2][1]) - u[0][1] * (u[1][0] * u[2][2] - u[1][2] * u[2][0]) + u[0][2] * (u[1][0] * u[2][1] - u[1][1] * u[2][0])
        return (e > 0) - (e < 0)

    n = len(points)
    first = next(((0, i, j, k) for i in range(1, n) for j in range(i + 1, n) for k in range(j + 1, n) if orient(0, i, j, k)), None)
    if first is None:
        return []
    a, b, c, d = first
    if orient(a, b, c, d) > 0:
        b, c = c, b
    faces = {(a, b, c), (a, c, d), (a, d, b), (b, d, c)}
    for p in range(n):
        if p in first:
            continue
        seen = {f for f in faces if orient(*f, p) > 0}
        if not seen:
            continue
        rim = {(f[i], f[(i + 1) % 3]) for f in seen for i in range(3)}
        faces -= seen
        faces |= {(u, v, p) for u, v in rim if (v, u) not in rim}
    return sorted(faces)
