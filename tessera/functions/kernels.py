"""Element kernels in numpy: shape functions, quadrature, stiffness, loads, stresses.

Kernels take batches of elements (n x nodes x 3) and run inside mapInPandas.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def elasticity(young: float, poisson: float) -> np.ndarray:
    """6 x 6 isotropic stiffness for engineering shear, order xx yy zz yz xz xy."""
    lam, mu = young * poisson / ((1 + poisson) * (1 - 2 * poisson)), young / (2 * (1 + poisson))
    d = np.zeros((6, 6))
    d[:3, :3] = lam
    d[np.arange(3), np.arange(3)] += 2 * mu
    d[np.arange(3, 6), np.arange(3, 6)] = mu
    return d


_HEX = np.array([[-1, -1, -1], [1, -1, -1], [1, 1, -1], [-1, 1, -1], [-1, -1, 1], [1, -1, 1], [1, 1, 1], [-1, 1, 1]], float)
#: The edges of a hexahedron, bottom ring, top ring, uprights.
_HEX_EDGES = [(i, (i + 1) % 4) for i in range(4)] + [(4 + i, 4 + (i + 1) % 4) for i in range(4)] + [(i, i + 4) for i in range(4)]
_TET_EDGES = [(0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3)]


def shape(etype: str, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (points x nodes) and reference gradients (points x nodes x 3)."""
    p = np.atleast_2d(p)
    x, y, z = p.T
    if etype in ("tet4", "tet10"):
        bary = np.stack([1 - x - y - z, x, y, z], axis=1)
        g = np.array([[-1, -1, -1], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float)
        if etype == "tet4":
            return bary, np.broadcast_to(g, (len(p), 4, 3)).copy()
        n = np.concatenate([bary * (2 * bary - 1), np.stack([4 * bary[:, a] * bary[:, b] for a, b in _TET_EDGES], axis=1)], axis=1)
        corner = (4 * bary - 1)[:, :, None] * g
        edge = np.stack([4 * (bary[:, a, None] * g[b] + bary[:, b, None] * g[a]) for a, b in _TET_EDGES], axis=1)
        return n, np.concatenate([corner, edge], axis=1)
    if etype == "hex8":
        f = 1 + p[:, None, :] * _HEX
        g = np.stack([_HEX[:, i] * np.prod(np.delete(f, i, axis=2), axis=2) / 8 for i in range(3)], axis=2)
        return f.prod(axis=2) / 8, g
    if etype == "prism6":
        tri, gt = np.stack([1 - x - y, x, y], axis=1), np.array([[-1, -1], [1, 0], [0, 1]], float)
        lo, hi = (1 - z) / 2, (1 + z) / 2
        n = np.concatenate([tri * lo[:, None], tri * hi[:, None]], axis=1)
        g = np.zeros((len(p), 6, 3))
        g[:, :3, :2], g[:, 3:, :2] = gt * lo[:, None, None], gt * hi[:, None, None]
        g[:, :3, 2], g[:, 3:, 2] = -tri / 2, tri / 2
        return n, g
    if etype == "hex20":
        f = 1 + p[:, None, :] * _HEX
        r = (p[:, None, :] * _HEX).sum(axis=2) - 2
        n, g = np.zeros((len(p), 20)), np.zeros((len(p), 20, 3))
        n[:, :8] = f.prod(axis=2) * r / 8
        for i in range(3):
            g[:, :8, i] = _HEX[:, i] * np.prod(np.delete(f, i, axis=2), axis=2) * (r + f[:, :, i]) / 8
        for k, (a, b) in enumerate(_HEX_EDGES, 8):
            i = int(np.flatnonzero(_HEX[a] != _HEX[b])[0])
            u, v = (j for j in range(3) if j != i)
            bubble, fu, fv = 1 - p[:, i] ** 2, 1 + _HEX[a, u] * p[:, u], 1 + _HEX[a, v] * p[:, v]
            n[:, k] = bubble * fu * fv / 4
            g[:, k, i], g[:, k, u], g[:, k, v] = -p[:, i] * fu * fv / 2, bubble * _HEX[a, u] * fv / 4, bubble * fu * _HEX[a, v] / 4
        return n, g
    if etype == "pyramid5":
        base, up = _HEX[:4, :2], (1 - z) / 2  # the base at z = -1, the apex at z = 1
        fx, fy = 1 + x[:, None] * base[:, 0], 1 + y[:, None] * base[:, 1]
        n = np.concatenate([fx * fy * up[:, None] / 4, ((1 + z) / 2)[:, None]], axis=1)
        g = np.zeros((len(p), 5, 3))
        g[:, :4, 0], g[:, :4, 1], g[:, :4, 2] = base[:, 0] * fy * up[:, None] / 4, base[:, 1] * fx * up[:, None] / 4, -fx * fy / 8
        g[:, 4, 2] = 0.5
        return n, g
    raise ValueError(f"no shape functions for {etype}")


def reference_nodes(etype: str) -> np.ndarray:
    """The nodes of the reference element."""
    tet = np.concatenate([np.zeros((1, 3)), np.eye(3)])
    if etype in ("tet4", "tet10"):
        return tet if etype == "tet4" else np.concatenate([tet, [(tet[a] + tet[b]) / 2 for a, b in _TET_EDGES]])
    if etype in ("hex8", "hex20"):
        return _HEX if etype == "hex8" else np.concatenate([_HEX, [(_HEX[a] + _HEX[b]) / 2 for a, b in _HEX_EDGES]])
    if etype == "prism6":
        return np.array([[x, y, z] for z in (-1, 1) for x, y in ((0, 0), (1, 0), (0, 1))], float)
    if etype == "pyramid5":
        return np.concatenate([_HEX[:4], [[0, 0, 1]]])
    raise ValueError(f"no reference nodes for {etype}")


def gauss(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def quadrature(etype: str) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights that integrate the stiffness of the type."""
    if etype == "tet4":
        return np.full((1, 3), 0.25), np.array([1 / 6])
    if etype == "tet10":
        a, b = (5 - 5**0.5) / 20, (5 + 3 * 5**0.5) / 20
        return np.where(np.eye(4, 3, -1) > 0, b, a), np.full(4, 1 / 24)
    if etype in ("hex8", "hex20"):
        g, w = gauss(2 if etype == "hex8" else 3)
        return np.stack(np.meshgrid(g, g, g, indexing="ij"), -1).reshape(-1, 3), np.einsum("i,j,k->ijk", w, w, w).ravel()
    if etype == "prism6":
        g, w = gauss(2)
        t = np.array([[1 / 6, 1 / 6], [2 / 3, 1 / 6], [1 / 6, 2 / 3]])
        return np.array([[*q, z] for z in g for q in t]), np.repeat(w, 3) / 6
    if etype == "pyramid5":  # over the pyramid between base and apex itself; stiffness, loads and volumes use its two tetrahedra
        g, w = gauss(3)
        c = np.stack(np.meshgrid(g, g, g, indexing="ij"), -1).reshape(-1, 3)
        a = (1 - c[:, 2]) / 2
        return np.stack([a * c[:, 0], a * c[:, 1], c[:, 2]], axis=1), np.einsum("i,j,k->ijk", w, w, w).ravel() * a * a
    raise ValueError(f"no quadrature for {etype}")


def tet_quadrature(degree: int) -> tuple[np.ndarray, np.ndarray]:
    """A rule for the tetrahedron that is exact for polynomials of the degree: Gauss points of a cube drawn together."""
    g, w = gauss((degree + 4) // 2)
    g, w = (g + 1) / 2, w / 2
    u, v, t = (m.ravel() for m in np.meshgrid(g, g, g, indexing="ij"))
    return np.stack([u, v * (1 - u), t * (1 - u) * (1 - v)], axis=1), np.einsum("i,j,k->ijk", w, w, w).ravel() * (1 - u) ** 2 * (1 - v)


def strain_matrix(grad: np.ndarray) -> np.ndarray:
    """B (... x 6 x 3n) from gradients (... x n x 3)."""
    n = grad.shape[-2]
    b = np.zeros((*grad.shape[:-2], 6, 3 * n))
    gx, gy, gz = (grad[..., i] for i in range(3))
    b[..., 0, 0::3], b[..., 1, 1::3], b[..., 2, 2::3] = gx, gy, gz
    b[..., 3, 1::3], b[..., 3, 2::3] = gz, gy
    b[..., 4, 0::3], b[..., 4, 2::3] = gz, gx
    b[..., 5, 0::3], b[..., 5, 1::3] = gy, gx
    return b


def physical_gradients(etype: str, coords: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, gradients in space (elements x points x nodes x 3) and det J (elements x points)."""
    n, g = shape(etype, p)
    jac = np.einsum("qnr,enx->eqrx", g, coords)
    return n, np.einsum("eqxr,qnr->eqnx", np.linalg.inv(jac), g), np.linalg.det(jac)


def _pyramid_tets(coords: np.ndarray):
    """The two tetrahedra of each pyramid, over the base's diagonal 0-2, as places turned to a positive volume."""
    for own in ((0, 1, 2, 4), (0, 2, 3, 4)):
        x = coords[:, own]
        flat = np.linalg.det(x[:, 1:] - x[:, :1]) < 0
        yield np.where(flat[:, None], np.array(own)[[0, 2, 1, 3]], np.array(own))


def volumes(etype: str, coords: np.ndarray) -> np.ndarray:
    """Volumes (elements)."""
    if etype == "pyramid5":
        return sum(volumes("tet4", np.take_along_axis(coords, ids[:, :, None], axis=1)) for ids in _pyramid_tets(coords))
    p, w = quadrature(etype)
    return (physical_gradients(etype, coords, p)[2] * w).sum(axis=1)


def stiffness(etype: str, coords: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Element matrices (elements x 3n x 3n).  A pyramid is two tetrahedra over the base's diagonal 0-2; inverted elements fail."""
    if etype == "pyramid5":
        out = np.zeros((len(coords), 15, 15))
        for ids in _pyramid_tets(coords):
            k = stiffness("tet4", np.take_along_axis(coords, ids[:, :, None], axis=1), d)
            dof = (ids[:, :, None] * 3 + np.arange(3)).reshape(len(coords), 12)
            out[np.arange(len(coords))[:, None, None], dof[:, :, None], dof[:, None, :]] += k
        return out
    p, w = quadrature(etype)
    _, grad, det = physical_gradients(etype, coords, p)
    if (det <= 0).any():
        raise ValueError(f"an inverted {etype}")
    b = strain_matrix(grad)
    return np.einsum("eqsi,st,eqtj,eq->eij", b, d, b, det * w, optimize=True)


def body_load(etype: str, coords: np.ndarray, force: tuple[float, float, float]) -> np.ndarray:
    """Consistent loads (elements x 3n) of a constant body force."""
    if etype == "pyramid5":
        out = np.zeros((len(coords), 15))
        for ids in _pyramid_tets(coords):
            dof = (ids[:, :, None] * 3 + np.arange(3)).reshape(len(coords), 12)
            out[np.arange(len(coords))[:, None], dof] += body_load("tet4", np.take_along_axis(coords, ids[:, :, None], axis=1), force)
        return out
    p, w = quadrature(etype)
    n, _, det = physical_gradients(etype, coords, p)
    return np.einsum("qn,x,eq->enx", n, np.array(force, float), det * w).reshape(len(coords), -1)


def face_shape(n: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and gradients (points x nodes (x 2)) of a triangle (n = 3) or quadrilateral (n = 4)."""
    x, y = p.T
    if n == 3:
        return np.stack([1 - x - y, x, y], axis=1), np.broadcast_to(np.array([[-1.0, -1], [1, 0], [0, 1]]), (len(p), 3, 2))
    if n == 4:
        c = _HEX[:4, :2]
        fx, fy = 1 + x[:, None] * c[:, 0], 1 + y[:, None] * c[:, 1]
        return fx * fy / 4, np.stack([c[:, 0] * fy / 4, c[:, 1] * fx / 4], axis=2)
    raise ValueError(f"no face of {n} nodes")


def traction_load(coords: np.ndarray, traction) -> np.ndarray:
    """Consistent loads (faces x 3n) on faces (faces x n x 3) of three or four nodes.  ``traction`` maps points (m x 3) to forces by area (m x 3)."""
    n = coords.shape[1]
    if n == 3:
        p, w = np.array([[1 / 6, 1 / 6], [2 / 3, 1 / 6], [1 / 6, 2 / 3]]), np.full(3, 1 / 6)
    else:
        g, own = gauss(3)
        p, w = np.stack(np.meshgrid(g, g, indexing="ij"), -1).reshape(-1, 2), np.outer(own, own).ravel()
    shape_of, grad = face_shape(n, p)
    du, dv = (np.einsum("qn,fnx->fqx", grad[:, :, k], coords) for k in (0, 1))
    area = np.linalg.norm(np.cross(du, dv), axis=2) * w
    at = np.einsum("qn,fnx->fqx", shape_of, coords)
    force = np.asarray(traction(at.reshape(-1, 3)), float).reshape(at.shape)
    return np.einsum("qn,fqx,fq->fnx", shape_of, force, area).reshape(len(coords), -1)


def traction_loads(faces: DataFrame, traction) -> DataFrame:
    """(i, val): loads of faces (nodes of three or four, coords) summed by dof."""

    def run(batches):
        for batch in batches:
            for _, own in batch.groupby(batch["nodes"].map(len)):
                nodes = np.array(own["nodes"].tolist(), np.int64)
                dof = (nodes[:, :, None] * 3 + np.arange(3)).ravel()
                yield pd.DataFrame({"i": dof, "val": traction_load(_coords(own), traction).ravel()})

    return faces.select("nodes", "coords").mapInPandas(run, "i long, val double").groupBy("i").agg(F.sum("val").alias("val"))


def hp_modes(p: int) -> list[tuple[int, int, int]]:
    """Tensor orders (i, j, k) of the hierarchical modes of a hexahedron up to order p; 0 and 1 are the linear functions of a direction."""
    return [(i, j, k) for i in range(p + 1) for j in range(p + 1) for k in range(p + 1)]


def hp_values(p: int, x: np.ndarray) -> np.ndarray:
    """Values (points x modes) of ``hp_modes`` at points of the reference cube."""
    one = [np.concatenate([np.stack([(1 - c) / 2, (1 + c) / 2], axis=1), lobatto(p, c)], axis=1) for c in x.T]
    return np.stack([one[0][:, i] * one[1][:, j] * one[2][:, k] for i, j, k in hp_modes(p)], axis=1)


def lobatto(p: int, x: np.ndarray) -> np.ndarray:
    """The 1D hierarchical modes of order 2..p (integrated Legendre), by column."""
    leg = np.polynomial.legendre.legvander(np.asarray(x, float), p)
    return np.stack([(leg[:, k] - leg[:, k - 2]) / np.sqrt(2 * (2 * k - 1)) for k in range(2, p + 1)], axis=1) if p >= 2 else np.zeros((len(x), 0))


def _coords(batch: pd.DataFrame) -> np.ndarray:
    return np.array([np.array([list(p.values()) if isinstance(p, dict) else list(p) for p in row], float) for row in batch["coords"]])


def with_coordinates(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds coords: the node coordinates in element order (one join, one regrouping)."""
    flat = elements.select("eid", F.posexplode("nodes").alias("pos", "nid")).join(nodes, "nid")
    coords = flat.groupBy("eid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "z"))), lambda s: F.array(s["x"], s["y"], s["z"])).alias("coords"))
    return elements.join(coords, "eid")


def stiffness_triplets(elements: DataFrame, young: float, poisson: float) -> DataFrame:
    """(row, col, val) of all element matrices.  elements: eid, etype, nodes, coords."""
    d = elasticity(young, poisson)

    def run(batches):
        for batch in batches:
            for etype, own in batch.groupby("etype"):
                nodes = np.array(own["nodes"].tolist(), np.int64)
                k = stiffness(etype, _coords(own), d)
                dof = (nodes[:, :, None] * 3 + np.arange(3)).reshape(len(nodes), -1)
                m = dof.shape[1]
                yield pd.DataFrame({"row": np.repeat(dof, m, axis=1).ravel(), "col": np.tile(dof, (1, m)).ravel(), "val": k.ravel()})

    return elements.select("etype", "nodes", "coords").mapInPandas(run, "row long, col long, val double")


def element_stress(elements: DataFrame, displacement: DataFrame, young: float, poisson: float) -> DataFrame:
    """(eid, six stresses, cx, cy, cz, volume) at element centres.  elements need coords; displacement: nid, ux, uy, uz."""
    d = elasticity(young, poisson)
    centre = {"tet4": [0.25] * 3, "tet10": [0.25] * 3, "hex8": [0.0] * 3, "prism6": [1 / 3, 1 / 3, 0.0], "hex20": [0.0] * 3, "pyramid5": [0.0, 0.0, -0.5]}
    flat = elements.select("eid", F.posexplode("nodes").alias("pos", "nid")).join(displacement, "nid")
    u = flat.groupBy("eid").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ux", "uy", "uz"))), lambda s: F.array(s["ux"], s["uy"], s["uz"])).alias("u"))

    def run(batches):
        for batch in batches:
            for etype, own in batch.groupby("etype"):
                coords = _coords(own)
                disp = np.array([np.array([list(p) for p in row], float) for row in own["u"]])
                _, grad, _ = physical_gradients(etype, coords, np.array([centre[etype]]))
                s = np.einsum("st,etj,ej->es", d, strain_matrix(grad[:, 0]), disp.reshape(len(disp), -1))
                volume = volumes(etype, coords)
                mid = coords.mean(axis=1)
                yield pd.DataFrame({"eid": own["eid"].to_numpy(), **{k: s[:, i] for i, k in enumerate(("sxx", "syy", "szz", "syz", "sxz", "sxy"))}, "cx": mid[:, 0], "cy": mid[:, 1], "cz": mid[:, 2], "volume": volume})

    return elements.join(u, "eid").select("eid", "etype", "coords", "u").mapInPandas(run, "eid long, sxx double, syy double, szz double, syz double, sxz double, sxy double, cx double, cy double, cz double, volume double")
