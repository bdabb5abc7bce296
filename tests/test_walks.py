"""Joins along lines against brute force, wall thickness and automatic size on parts whose answer is known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.operators import surface, walks
from tessera.plans import lattice, sizing
from tessera.session import saver

RAY = "rid long, " + ", ".join(f"{n}{c} double" for n in "od" for c in "xyz")
TRI = "tid long, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz")
SEG = "sid long, " + ", ".join(f"{n}{c} double" for n in "ab" for c in "xyz")
POINT = "pid long, x double, y double, z double"


def first_hit(o, d, t):
    """The least positive distance along the ray, by solving for each triangle."""
    best = math.inf
    for a, b, c in t:
        m = np.array([b - a, c - a, -d]).T
        if abs(np.linalg.det(m)) < 1e-12:
            continue
        u, v, w = np.linalg.solve(m, o - a)
        if u >= 0 and v >= 0 and u + v <= 1 and w > 1e-12:
            best = min(best, w)
    return best


def segment_distance(p, a, b):
    d = b - a
    t = min(1.0, max(0.0, float((p - a) @ d) / (float(d @ d) or 1.0)))
    return float(np.linalg.norm(p - a - t * d))


def test_cells_along(spark):
    r = np.random.default_rng(1)
    rows = [(i, *map(float, r.uniform(-5, 5, 6))) for i in range(60)] + [(100, 0.0, 0.0, 0.0, 3.0, 3.0, 3.0), (101, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5), (102, 1.0, 2.5, 0.5, -2.0, 2.5, 0.5), (103, None, 0.0, 0.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, SEG)
    got = {x["sid"]: x["c"] for x in df.select("sid", walks.cells_along(G.vec("a"), G.vec("b"), 0.7).alias("c")).collect()}
    for sid, *v in rows[:60]:
        a, b = np.array(v[:3]), np.array(v[3:])
        fine = {tuple(np.floor((a + t * (b - a)) / 0.7).astype(int)) for t in np.linspace(0, 1, 20001)}
        own = [tuple(c) for c in got[sid]]
        assert len(own) == len(set(own)) and fine <= set(own)
        assert len(own) <= 1 + sum(abs(int(np.floor(q / 0.7)) - int(np.floor(p / 0.7))) for p, q in zip(a, b))  # linear in the length
    assert [tuple(c) for c in got[101]] == [(0, 0, 0)] and got[103] is None and len(got[100]) == 5 and len(got[102]) >= 4


@pytest.mark.parametrize("bands", [False, True])
def test_first_hits(spark, bands):
    r = np.random.default_rng(4)
    tri = [(i, *map(float, np.concatenate([p := r.uniform(0, 10, 3), p + r.normal(0, 2, 3), p + r.normal(0, 2, 3)]))) for i in range(150)]
    tri += [(200, 4.0, 0.0, 0.0, 4.0, 10.0, 0.0, 4.0, 0.0, 10.0), (201, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (202, 4.0, 0.0, 0.0, 4.0, 10.0, 0.0, 4.0, 0.0, 10.0)]  # in a plane of the grid, a point, a repeat
    rays = []
    for i in range(120):
        d = r.normal(0, 1, 3)
        rays.append((i, *map(float, r.uniform(0, 10, 3)), *map(float, d / np.linalg.norm(d))))
    rays += [(500 + i, 0.5, 0.3 + i, 0.3 + i, 1.0, 0.0, 0.0) for i in range(5)] + [(600, 50.0, 50.0, 50.0, 1.0, 0.0, 0.0)]
    T = [np.array(t[1:]).reshape(3, 3) for t in tri]
    want = {x[0]: first_hit(np.array(x[1:4]), np.array(x[4:]), T) for x in rays}
    save = saver(spark, "rays") if bands else None
    got = {x["rid"]: x["t"] for x in walks.ray_hits(spark.createDataFrame(rays, RAY), spark.createDataFrame(tri, TRI), 1.0, 9.0, save).collect()}
    assert set(got) == {k for k, v in want.items() if v <= 9.0} and all(got[k] == pytest.approx(want[k]) for k in got) and len(got) > 20
    assert walks.ray_hits(spark.createDataFrame(rays, RAY), spark.createDataFrame([], TRI), 1.0, 9.0, save).count() == 0
    assert walks.ray_hits(spark.createDataFrame([], RAY), spark.createDataFrame(tri, TRI), 1.0, 9.0, save).count() == 0


def test_closest_edges_and_hausdorff(spark):
    r = np.random.default_rng(6)
    make = lambda n, shift: [(i, *map(float, np.concatenate([p := r.uniform(0, 10, 3) + shift, p + r.normal(0, 3, 3)]))) for i in range(n)]
    one, other = make(40, 0.0), [*make(25, 1.0), (90, 30.0, 30.0, 30.0, 31.0, 30.0, 30.0), (91, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0), (92, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0)]
    points = [(i, *map(float, r.uniform(-20, 30, 3))) for i in range(90)]
    save = saver(spark, "edges")
    p, a, b = spark.createDataFrame(points, POINT), spark.createDataFrame(one, SEG), spark.createDataFrame(other, SEG)
    ends = lambda s: (np.array(s[1:4]), np.array(s[4:]))
    for only, kept in ((None, other), (F.col("sid") % 3 == 0, [s for s in other if s[0] % 3 == 0])):
        got = {x["pid"]: x for x in walks.closest_edge(p, b, 0.5, save, only).collect()}
        want = {q[0]: min((segment_distance(np.array(q[1:]), *ends(s)), s[0]) for s in kept) for q in points}
        assert set(got) == set(want) and all(math.sqrt(got[k]["d2"]) == pytest.approx(want[k][0]) and got[k]["sid"] == want[k][1] for k in want)
        assert walks.farthest(p, b, 0.5, save, only) == pytest.approx(max(v[0] for v in want.values()))
    dots = lambda rows: [u + (v - u) * k / n for s in rows for u, v in [ends(s)] for n in [max(1, math.ceil(np.linalg.norm(v - u) / 0.5))] for k in range(n + 1)]
    side = lambda f, g: max(min(segment_distance(q, *ends(s)) for s in g) for q in dots(f))
    assert walks.edge_hausdorff(a, b, 0.5, save) == pytest.approx(max(side(one, other), side(other, one)))
    assert walks.edge_hausdorff(a, a, 0.5, save) == pytest.approx(0.0, abs=1e-9)
    assert walks.farthest(p, b.limit(0), 0.5, save) == 0.0 and walks.farthest(p.limit(0), b, 0.5, save) == 0.0


def plate(spark, high, n=4):
    """A box cut into a grid of triangles on its two large sides, so inner vertices face each other."""
    v = [(k * (n + 1) ** 2 + j * (n + 1) + i, high[0] * i / n, high[1] * j / n, high[2] * k) for k in range(2) for j in range(n + 1) for i in range(n + 1)]
    at = lambda i, j, k: k * (n + 1) ** 2 + j * (n + 1) + i
    t = []
    for i in range(n):
        for j in range(n):
            q = [at(i, j, 1), at(i + 1, j, 1), at(i + 1, j + 1, 1), at(i, j + 1, 1)]
            t += [[q[0], q[1], q[2]], [q[0], q[2], q[3]]]
            q = [at(i, j, 0), at(i, j + 1, 0), at(i + 1, j + 1, 0), at(i + 1, j, 0)]
            t += [[q[0], q[1], q[2]], [q[0], q[2], q[3]]]
        for a, b in (((i, 0), (i + 1, 0)), ((n, i), (n, i + 1)), ((n - i, n), (n - i - 1, n)), ((0, n - i), (0, n - i - 1))):
            q = [at(*a, 0), at(*b, 0), at(*b, 1), at(*a, 1)]
            t += [[q[0], q[1], q[2]], [q[0], q[2], q[3]]]
    return spark.createDataFrame(list(enumerate(t)), "tid long, nodes array<long>"), spark.createDataFrame(v, "vid long, x double, y double, z double")


def test_thickness_of_a_plate(spark):
    tri, vert = plate(spark, (10.0, 8.0, 0.5))
    got = {x["vid"]: x["thickness"] for x in walks.local_thickness(tri, vert, saver(spark, "plate")).collect()}
    inner = [r["vid"] for r in vert.filter("x > 0 AND x < 10 AND y > 0 AND y < 8").collect()]
    assert len(got) == vert.count() and len(inner) == 18 and all(got[v] == pytest.approx(0.5) for v in inner)
    open_ = tri.limit(1)
    assert {x["thickness"] for x in walks.local_thickness(open_, vert, saver(spark, "plate")).collect()} == {None}


def test_automatic_size(spark):
    save = saver(spark, "size")
    tri, vert = plate(spark, (10.0, 8.0, 1.0))
    got = sizing.mesh_size(tri, vert, save)
    diagonal = math.sqrt(100 + 64 + 1)
    base = min(10 / 16, diagonal / 28)
    assert got["auto"] and got["thickness"] == pytest.approx(1.0) and got["feature"] == pytest.approx(1.0) and got["n_sharp"] == 36
    h = base
    radius = got["radius"]
    h = max(radius / 6, 0.28 * base) if radius / 6 < h else h
    h = min(h, max(0.5, 0.35 * base)) if 0.2 * base < 0.5 < h else h
    h = max(0.35, 0.4 * base) if 0.35 < h else h
    assert got["h"] == pytest.approx(min(max(h, diagonal / 80), diagonal / 6))
    assert sizing.mesh_size(tri, vert, save, 0.3) == {"h": 0.3, "auto": False, "n_sharp": 0, "radius": None, "thickness": None, "feature": None, "edge": None}
    lengths = spark.createDataFrame([(0.15,), (0.01,), (5.0,)], "length double")
    assert sizing.mesh_size(tri, vert, save, edge_lengths=lengths)["edge"] == pytest.approx(5.0) and sizing.mesh_size(tri, vert, save, edge_lengths=lengths.filter("length < 1"))["edge"] == pytest.approx(0.15)
    tri, vert = lattice.cylinder_surface(spark, 1.0, 3.0, 48)  # 48 sides, turns of 7.5 degrees: only the rims are sharp
    got = sizing.mesh_size(tri, vert, save)
    assert got["n_sharp"] == 96 and got["radius"] > 0 and math.sqrt(17) / 80 <= got["h"] <= 3 / 16


@pytest.mark.parametrize("extent,axis", [((4.0, 1.0, 2.0), 0), ((1.0, 4.0, 2.0), 1), ((1.0, 2.0, 2.0), 2)])
def test_sweep(spark, extent, axis):
    tri, vert = lattice.box_surface(spark, (0.0, 0.0, 0.0), extent)
    elements, nodes, found = lattice.sweep_surface(surface.triangles_of(tri, vert), extent, 0.5, spark)
    at = {r["nid"]: np.array([r["x"], r["y"], r["z"]]) for r in nodes.collect()}
    total = 0.0
    for e in elements.collect():
        p = [at[n] for n in e["nodes"]]
        v = np.cross(p[1] - p[0], p[2] - p[0]) @ (p[3] - p[0]) / 2
        assert v > 0 and all(np.allclose(np.delete(q - s, axis), 0) for s, q in zip(p[:3], p[3:])) and len({s[axis] for s in p[:3]}) == 1
        total += v
    assert found == axis and total == pytest.approx(math.prod(extent)) and elements.select("eid").distinct().count() == elements.count()
