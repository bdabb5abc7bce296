"""Convex polyhedra cut by half-spaces, as numpy kernels: cells nearest to a site, their volumes and weighted centroids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: The four-point rule of degree two on a tetrahedron, as weights of its corners.
_NEAR, _FAR = 0.5854101966249685, 0.1381966011250105

Face = tuple[int, np.ndarray]  # what lies beyond it, corners in order, seen from outside counter-clockwise


def box_faces(lo, hi) -> list[Face]:
    """The sides of a box, owned by -1 to -6 (low x, high x, low y, ...)."""
    c = np.array([[(lo, hi)[n >> k & 1][k] for k in range(3)] for n in range(8)], float)
    sides = [(0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)]
    return [(-1 - n, c[list(s)]) for n, s in enumerate(sides)]


def cut(faces: list[Face], normal: np.ndarray, level: float, owner: int, eps: float) -> list[Face]:
    """The part of a convex polyhedron where normal . x <= level; the new side belongs to ``owner``.  ``normal`` has length one."""
    sizes = [len(p) for _, p in faces]
    height = np.concatenate([p for _, p in faces]) @ normal - level
    if height.max() <= eps:
        return faces
    if height.min() >= -eps:
        return []
    out, rim, at = [], [], 0
    for (own, p), n in zip(faces, sizes, strict=True):
        h = height[at : at + n]
        at += n
        low = h <= eps
        if low.all():
            out.append((own, p))
            rim.append(p[h >= -eps])
            continue
        if not (h < -eps).any():
            rim.append(p[low])
            continue
        after, q = np.roll(np.arange(n), -1), []
        for a, b in zip(range(n), after, strict=True):
            if low[a]:
                q.append(p[a])
                if h[a] >= -eps:
                    rim.append(p[a : a + 1])
            if (h[a] > eps and h[b] < -eps) or (h[a] < -eps and h[b] > eps):
                m = p[a] + (p[b] - p[a]) * (h[a] / (h[a] - h[b]))
                q.append(m)
                rim.append(m[None])
        if len(q) > 2:
            out.append((own, np.array(q)))
    ring = _ring(np.concatenate(rim), normal, eps)
    return [*out, (owner, ring)] if len(ring) > 2 else out


def _ring(points: np.ndarray, normal: np.ndarray, eps: float) -> np.ndarray:
    """Points of a convex polygon in order around ``normal``, equal ones once."""
    u = np.eye(3)[np.argmin(np.abs(normal))]
    u = u - normal * (u @ normal)
    u /= np.linalg.norm(u)
    flat = points - points.mean(axis=0)
    order = np.argsort(np.arctan2(flat @ np.cross(normal, u), flat @ u), kind="stable")
    p = points[order]
    far = np.abs(p - np.roll(p, 1, axis=0)).max(axis=1) > 4 * eps
    return p[far] if far.any() else p[:1]


def reach(faces: list[Face], site: np.ndarray) -> float:
    """The distance from the site to the furthest corner."""
    return float(np.sqrt(max(((p - site) ** 2).sum(axis=1).max() for _, p in faces))) if faces else 0.0


def restricted_cell(faces: list[Face], site: np.ndarray, sid: int, others: np.ndarray, ids: np.ndarray, eps: float) -> list[Face]:
    """The part of ``faces`` that is nearer to the site than to any other.

    Others are met in growing distance, until they are too far to reach the cell
    (twice the distance of its furthest corner).  Of sites in one place, the least id
    has the cell.
    """
    step = others - site
    gap = np.sqrt((step * step).sum(axis=1))
    far = reach(faces, site)
    for n in np.argsort(gap, kind="stable"):
        if not faces or gap[n] > 2 * far + eps:
            break
        if gap[n] == 0:
            if ids[n] < sid:
                return []
            continue
        normal = step[n] / gap[n]
        now = cut(faces, normal, float(normal @ (site + others[n]) / 2), int(ids[n]), eps)
        if now is not faces:
            faces, far = now, reach(now, site)
    return faces


def tets(faces: list[Face]) -> np.ndarray:
    """Tetrahedra (n, 4, 3) of positive volume that fill a convex polyhedron, about the mean of its corners."""
    if not faces:
        return np.zeros((0, 4, 3))
    centre = np.concatenate([p for _, p in faces]).mean(axis=0)
    return np.array([[centre, p[0], p[k], p[k + 1]] for _, p in faces for k in range(1, len(p) - 1)])


def mass_and_centroid(faces: list[Face], size: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[float, float, np.ndarray]:
    """(volume, mass, centroid).  The density is one over the cube of ``size`` (of points (n, 3)), or one."""
    t = tets(faces)
    v = np.einsum("ij,ij->i", np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]), t[:, 3] - t[:, 0]) / 6
    weights = np.full((4, 4), _FAR) + np.eye(4) * (_NEAR - _FAR)
    points = np.einsum("qc,tcx->tqx", weights, t)
    density = np.ones(points.shape[:2]) if size is None else np.asarray(size(points.reshape(-1, 3)), float).reshape(points.shape[:2]) ** -3
    own = density * v[:, None] / 4
    mass = float(own.sum())
    return float(v.sum()), mass, (np.einsum("tq,tqx->x", own, points) / mass if mass > 0 else np.full(3, np.nan))


def cells_at_once(lo, hi, sites: np.ndarray, gap: np.ndarray, step: np.ndarray, eps: float):
    """What ``restricted_cell`` does, for many sites in one box: (cell, planes (n, 3), corners (n, 3)), far, sure.

    gap (n, K) holds the distances to other sites in growing order (inf where there is
    none), step (n, K, 3) the ways to them.  A corner is the meeting of three planes:
    0 to 5 are the box's sides, 6 + k the half-way plane to other k.  far is the
    distance to the furthest corner.  Not ``sure`` are cells for which a plane passed a
    corner so near that rounding may have decided: those are for ``restricted_cell``.
    """
    n, k_all = gap.shape
    bits = np.array([[c >> k & 1 for k in range(3)] for c in range(8)])
    start = np.where(bits, np.asarray(hi, float), np.asarray(lo, float))
    meet = np.array([(b[0], 2 + b[1], 4 + b[2]) if b.sum() % 2 == 0 else (b[0], 4 + b[2], 2 + b[1]) for b in bits])
    cell, tri, pos = np.repeat(np.arange(n), 8), np.tile(meet, (n, 1)), np.tile(start, (n, 1))
    known = np.isfinite(gap) & (gap > 0)
    normal = step / np.where(known, gap, 1.0)[:, :, None]
    level = (normal * (sites[:, None] + step / 2)).sum(axis=2)
    furthest = lambda at, c, p: np.maximum.at(at, c, ((p - sites[c]) ** 2).sum(axis=1))
    far2, sure, kept, wide = np.zeros(n), np.ones(n, bool), [], np.int64(6 + k_all)
    furthest(far2, cell, pos)
    for k in range(k_all):
        open_ = known[:, k] & (gap[:, k] <= 2 * np.sqrt(far2) + eps)
        if not open_.any():
            break
        go = open_[cell]
        if not go.all():  # what is no longer open stays so
            kept.append((cell[~go], tri[~go], pos[~go]))
            cell, tri, pos = cell[go], tri[go], pos[go]
        h = (pos * normal[cell, k]).sum(axis=1) - level[cell, k]
        sure[cell[np.abs(h) <= 100 * eps]] = False
        out = h > eps
        if not out.any():
            continue
        hit = np.zeros(n, bool)
        hit[cell[out]] = True
        gone, rest = np.flatnonzero(out), np.flatnonzero(hit[cell] & ~out)
        edge = lambda at, a, b: ((cell[at, None] * wide + tri[at][:, a]) * wide + tri[at][:, b]).ravel()
        have, want = edge(rest, [0, 1, 2], [1, 2, 0]), edge(gone, [1, 2, 0], [0, 1, 2])
        order = np.argsort(have)
        place = np.minimum(np.searchsorted(have, want, sorter=order), max(0, len(have) - 1))
        rim = np.flatnonzero(have[order[place]] == want) if len(have) else np.zeros(0, int)
        a, b = gone[rim // 3], rest[order[place[rim]] // 3]
        one, two = tri[a, rim % 3], tri[a, (rim + 1) % 3]
        m = pos[a] + (pos[b] - pos[a]) * (h[a] / (h[a] - h[b]))[:, None]
        stay = ~out
        cell, tri, pos = np.concatenate([cell[stay], cell[a]]), np.concatenate([tri[stay], np.stack([one, two, np.full(len(a), 6 + k)], axis=1)]), np.concatenate([pos[stay], m])
        far2[hit] = 0
        new = hit[cell]
        furthest(far2, cell[new], pos[new])
    kept.append((cell, tri, pos))
    cell, tri, pos = (np.concatenate(x) for x in zip(*kept, strict=True))
    planes = np.unique(cell[:, None] * wide + tri)
    corners, sides = np.bincount(cell, minlength=n), np.bincount(planes // wide, minlength=n)
    return cell, tri, pos, np.sqrt(far2), sure & ((corners == 2 * sides - 4) | (corners == 0))


def faces_at_once(n: int, cell: np.ndarray, tri: np.ndarray, pos: np.ndarray, step: np.ndarray, size: Callable[[np.ndarray], np.ndarray] | None = None):
    """Faces of ``cells_at_once`` in the order of cells: (cell, plane and number of points of each, all points, volume, mass, centroid).

    A face's points are in order, seen from outside counter-clockwise.
    """
    wide = np.int64(6 + step.shape[1])
    key, p = (cell[:, None] * wide + tri).ravel(), np.repeat(pos, 3, axis=0)
    found, which, count = np.unique(key, return_inverse=True, return_counts=True)
    owner, plane = found // wide, found % wide
    away = np.zeros((len(found), 3))
    box = plane < 6
    away[box, plane[box] // 2] = np.where(plane[box] % 2, 1.0, -1.0)
    d = step[owner[~box], plane[~box] - 6]
    away[~box] = d / np.sqrt((d * d).sum(axis=1))[:, None]
    u = np.eye(3)[np.argmin(np.abs(away), axis=1)]
    u = u - away * (u * away).sum(axis=1)[:, None]
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    mean = np.stack([np.bincount(which, p[:, c], len(found)) for c in range(3)], axis=1) / count[:, None]
    flat = p - mean[which]
    order = np.lexsort((np.arctan2((flat * np.cross(away, u)[which]).sum(axis=1), (flat * u[which]).sum(axis=1)), which))
    p, which = p[order], which[order]
    first = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(int)
    fan = np.flatnonzero((np.arange(len(p)) - first[which] >= 1) & (np.arange(len(p)) - first[which] < count[which] - 1))
    own, corners = owner[which[fan]], np.maximum(1, np.bincount(cell, minlength=n))
    middle = np.stack([np.bincount(cell, pos[:, c], n) for c in range(3)], axis=1) / corners[:, None]
    t = np.stack([middle[own], p[first[which[fan]]], p[fan], p[fan + 1]], axis=1) if len(fan) else np.zeros((0, 4, 3))
    v = (np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]) * (t[:, 3] - t[:, 0])).sum(axis=1) / 6
    points = np.einsum("qc,tcx->tqx", np.full((4, 4), _FAR) + np.eye(4) * (_NEAR - _FAR), t)
    density = np.ones(points.shape[:2]) if size is None or not len(t) else np.asarray(size(points.reshape(-1, 3)), float).reshape(points.shape[:2]) ** -3
    w = density * v[:, None] / 4
    mass = np.bincount(own, w.sum(axis=1), n)
    total = np.stack([np.bincount(own, (w * points[:, :, c]).sum(axis=1), n) for c in range(3)], axis=1)
    centre = np.where(mass[:, None] > 0, total / np.where(mass > 0, mass, 1.0)[:, None], np.nan)
    return owner, plane, count, p, np.bincount(own, v, n), mass, centre
