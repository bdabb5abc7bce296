"""Voronoi cells against cells cut by all other sites, and what must hold of any cells."""

import random

import numpy as np
import pytest

from tessera.functions import voronoi as V
from tessera.operators.voronoi import lloyd_cells, voronoi_cells
from tessera.session import saver

LO, HI = (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)


def frame(spark, sites):
    return spark.createDataFrame([(i, *map(float, p), "clash") for i, p in enumerate(sites)], "sid long, x double, y double, z double, cell string")


def brute(sites, n, lo=LO, hi=HI):
    p = np.array(sites, float)
    others = np.array([i for i in range(len(p)) if i != n])
    return V.restricted_cell(V.box_faces(lo, hi), p[n], n, p[others], others, 1e-12)


def clouds():
    r = random.Random(4)
    even = [[r.random() for _ in range(3)] for _ in range(120)]
    # a dense knot, a few lone sites, a lattice (corners shared by eight cells), copies, sites outside
    knot = [[0.1 + 0.002 * r.random() for _ in range(3)] for _ in range(150)] + [[0.9, 0.9, 0.9], [0.9, 0.1, 0.5], [0.5, 0.5, 0.5]]
    lattice = [[(a + 0.5) / 3, (b + 0.5) / 3, (c + 0.5) / 3] for a in range(3) for b in range(3) for c in range(3)]
    return {"even": even, "knot": knot, "lattice": lattice, "copies": even[:20] + even[:5] + [[2.0, 0.5, 0.5], [-3.0, -3.0, -3.0]]}


@pytest.mark.parametrize("kind", list(clouds()))
def test_cells_equal_brute_force(spark, kind):
    sites = clouds()[kind]
    found = {x["sid"]: x for x in voronoi_cells(frame(spark, sites), LO, HI, 0.5, saver(spark)).collect()}
    assert sorted(found) == list(range(len(sites))) and abs(sum(x["volume"] for x in found.values()) - 1) < 1e-9
    for n, x in found.items():
        faces = brute(sites, n)
        volume, mass, centre = V.mass_and_centroid(faces)
        assert abs(x["volume"] - volume) < 1e-9 and x["mass"] == pytest.approx(mass, abs=1e-9)
        if volume > 1e-9:
            assert np.allclose([x["cx"], x["cy"], x["cz"]], centre, atol=1e-7)
        if kind in ("even", "copies"):
            assert {f["owner"] for f in x["faces"]} == {o for o, _ in faces}


def test_neighbours_are_mutual_and_faces_equal(spark):
    """A face has the same area from both of its sides."""
    found = voronoi_cells(frame(spark, clouds()["even"]), LO, HI, 0.5, saver(spark)).collect()
    area = {}
    for x in found:
        for f in x["faces"]:
            p = np.array(f["points"])
            area[x["sid"], f["owner"]] = np.linalg.norm(sum(np.cross(p[k] - p[0], p[k + 1] - p[0]) for k in range(1, len(p) - 1))) / 2
    inner = {k: a for k, a in area.items() if k[1] >= 0}
    assert inner and all(abs(a - inner[k[::-1]]) < 1e-9 for k, a in inner.items())
    assert abs(sum(a for k, a in area.items() if k[1] < 0) - 6) < 1e-9


def test_two_sites_and_odd_rows(spark):
    found = {x["sid"]: x["volume"] for x in voronoi_cells(frame(spark, [(0.25, 0.5, 0.5), (0.75, 0.5, 0.5)]), LO, HI, 0.1, saver(spark)).collect()}
    assert found == {0: pytest.approx(0.5, abs=1e-12), 1: pytest.approx(0.5, abs=1e-12)}
    one = spark.createDataFrame([(7, 5.0, 5.0, 5.0), (8, None, 0.5, 0.5)], "sid long, x double, y double, z double")
    assert [(x["sid"], round(x["volume"], 12)) for x in voronoi_cells(one, LO, HI, 0.1, saver(spark)).collect()] == [(7, 1.0)]
    assert voronoi_cells(one.limit(0), LO, HI, 0.1, saver(spark)).count() == 0


def test_domain_planes(spark):
    """A cube cut to a wedge."""
    found = voronoi_cells(frame(spark, clouds()["even"][:30]), LO, HI, 0.6, saver(spark), planes=[((1, 1, 0), 1.0)]).collect()
    assert abs(sum(x["volume"] for x in found) - 0.5) < 1e-9
    assert any(f["owner"] == -7 for x in found for f in x["faces"])


def test_weighted_centroid_by_sampling():
    faces = brute(clouds()["even"], 3)
    size = lambda p: 0.5 + 0.1 * p[:, 0]
    volume, mass, centre = V.mass_and_centroid(faces, size)
    g = np.random.default_rng(1).random((400_000, 3))
    p = np.array(clouds()["even"])
    near, own = g, ((g - p[3]) ** 2).sum(axis=1)
    for q in np.delete(p, 3, axis=0):
        keep = own < ((near - q) ** 2).sum(axis=1)
        near, own = near[keep], own[keep]
    w = size(near) ** -3
    assert abs(len(near) / 400_000 - volume) < 1e-3 and abs(w.sum() / 400_000 - mass) < 1e-2 * mass + 1e-3
    assert np.allclose((near * w[:, None]).sum(axis=0) / w.sum(), centre, atol=5e-3)


def test_lloyd(spark):
    """Fixed sites stay; a constant size changes nothing; a fine side draws sites; energy falls."""
    lattice = [[(a + 0.5) / 2, (b + 0.5) / 2, (c + 0.5) / 2] for a in range(2) for b in range(2) for c in range(2)]
    fixed = lambda sites, n: spark.createDataFrame([(i, *map(float, p), i < n) for i, p in enumerate(sites)], "sid long, x double, y double, z double, fixed boolean")
    still = lloyd_cells(fixed(lattice, 0), LO, HI, 1.0, 1e-5, saver(spark), most=3).collect()
    assert max(x["move"] for x in still) < 1e-9
    drawn = lloyd_cells(fixed(lattice, 1), LO, HI, 1.0, 1e-3, saver(spark), size_at=lambda p: 0.05 + 0.2 * p[:, 0], most=4).collect()
    assert [(x["x"], x["y"], x["z"]) for x in drawn if x["sid"] == 0] == [tuple(lattice[0])]
    assert np.mean([x["x"] for x in drawn]) < 0.48 and max(x["move"] for x in drawn) > 0
