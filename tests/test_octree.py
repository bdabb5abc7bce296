"""Octrees against a naive refinement, and their elements by volume and shared faces."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import octree as O
from tessera.session import saver

H, DEPTH = 0.5, 3
FACES = {"hex8": [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)], "pyramid5": [(0, 3, 2, 1), (0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4)], "tet4": [(0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)]}


def naive_leaves(points, counts):
    """Splits cells for points, then for any two neighbours two levels apart, one at a time."""
    cells = {(0, *c) for c in itertools.product(*map(range, counts))}

    def split(c):
        cells.remove(c)
        cells.update((c[0] + 1, *(2 * x + o for x, o in zip(c[1:], off, strict=True))) for off in itertools.product((0, 1), repeat=3))

    def holds(c, p):
        return all(x * H / 2 ** c[0] <= v < (x + 1) * H / 2 ** c[0] for x, v in zip(c[1:], p, strict=True))

    for *p, level in points:
        while bad := [c for c in cells if c[0] < level and holds(c, p)]:
            split(bad[0])

    def touch(a, b):
        size = [2 ** (DEPTH - c[0]) for c in (a, b)]
        return all(x * size[0] <= (y + 1) * size[1] and y * size[1] <= (x + 1) * size[0] for x, y in zip(a[1:], b[1:], strict=True))

    while bad := [a for a in cells for b in cells if b[0] > a[0] + 1 and touch(a, b)]:
        split(bad[0])
    return cells


def grown(spark, points, counts):
    save = saver(spark)
    inner = O.balance(O.wanted(spark.createDataFrame(points, "x double, y double, z double, level int"), H, counts), counts, DEPTH, save)
    return save(inner), O.leaves(spark, inner, counts, DEPTH)


def volumes(elements, nodes):
    at = {n: np.array(p) for n, *p in nodes}
    for eid, etype, ns, _ in elements:
        p = np.array([at[n] for n in ns])
        whole = 0.0
        centre = p.mean(axis=0)
        for f in FACES[etype]:  # outward faces, cut about the centre
            for a, b in zip(f[1:], f[2:]):  # noqa: B905
                whole += np.dot(np.cross(p[a] - p[f[0]], p[b] - p[f[0]]), p[f[0]] - centre) / 6
        yield eid, whole


def open_faces(elements):
    n = Counter(frozenset(ns[x] for x in f) for _, etype, ns, _ in elements for f in FACES[etype])
    assert max(n.values()) == 2
    return [f for f, k in n.items() if k == 1]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("hexes", [True, False])
def test_balanced_and_conforming(spark, seed, hexes):
    r = random.Random(seed)
    counts = [(2, 2, 1), (3, 1, 2), (1, 1, 1)][seed]
    points = [(*(r.uniform(-0.05, n * H + 0.05) for n in counts), r.choice([0, 1, 3, 3])) for _ in range(3)] + [(0.0, 0.0, 0.0, seed + 1)]
    inner, leaves = grown(spark, points, counts)
    found = leaves.collect()
    inside = [p for p in points if all(0 <= v < n * H for v, n in zip(p[:3], counts, strict=True))]
    assert {tuple(x[1:]) for x in found} == naive_leaves(inside, counts) and len({x["code"] for x in found}) == len(found)
    e = saver(spark)(O.elements(O.transitions(leaves, inner), counts, DEPTH, hexes))
    elements, nodes = e.collect(), O.nodes_of(e, H, counts, DEPTH).collect()
    assert len({x["eid"] for x in elements}) == len(elements) and ({x["etype"] for x in elements} <= {"pyramid5", "tet4"} or hexes)
    v = dict(volumes(elements, nodes))
    assert min(v.values()) > 0 and abs(sum(v.values()) - np.prod(counts) * H**3) < 1e-12
    at = {n: p for n, *p in nodes}
    for f in open_faces(elements):  # only on the box's sides
        p = np.array([at[x] for x in f])
        assert any(np.all(p[:, c] == 0) or np.all(np.abs(p[:, c] - counts[c] * H) < 1e-12) for c in range(3))


def test_morton_order(spark):
    """Codes interleave the bits of the lower corner, and a node's leaves are neighbours in their order."""
    df = spark.createDataFrame([(2, 5, 3, 1), (3, 10, 6, 3), (3, 131071, 0, 131070)], "level int, i long, j long, k long")
    for c in df.select("*", O.morton(3).alias("code")).collect():
        want = 0
        for bit in range(20):
            for axis, x in enumerate((c["i"], c["j"], c["k"])):
                want |= ((x << 3 - c["level"]) >> bit & 1) << 3 * bit + axis
        assert c["code"] == want
    with pytest.raises(ValueError):
        O.leaves(spark, df, (1 << 18, 1, 1), 0)


def test_level_of_size(spark):
    sizes = [1.0, 0.5, 0.49, 0.25, 0.1, 0.0001]
    found = spark.createDataFrame([(s,) for s in sizes], "s double").select(O.level_of_size(F.col("s"), 0.5, 4).alias("l")).collect()
    assert [x["l"] for x in found] == [0, 0, 1, 1, 3, 4]


def test_carved_solid(spark):
    """A box that cell borders meet has its own volume, and its open faces are its surface."""
    a, b = (0.25, 0.25, 0.125), (0.75, 1.0, 0.375)
    corner = [tuple((a, b)[c >> n & 1][n] for n in range(3)) for c in range(8)]
    quads = [(0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)]
    tri = [(*corner[q[0]], *corner[q[m]], *corner[q[m + 1]]) for q in quads for m in (1, 2)]
    triangles = spark.createDataFrame(tri, ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz"))
    counts = (2, 2, 1)
    marks = [(*p, 2) for p in corner] + [(*(v - 1e-3 for v in p), 2) for p in corner] + [(0.5, 0.5, 0.24, 3)]
    # every leaf the surface passes has to have its border there
    marks += [(x / 16 + 0.01, y / 16 + 0.01, z / 16 + 0.01, 2) for x in range(3, 13) for y in range(3, 17) for z in range(1, 7)]
    inner, leaves = grown(spark, marks, counts)
    solid = saver(spark)(O.carve(leaves, triangles, H, DEPTH))
    e = saver(spark)(O.elements(O.transitions(solid, inner), counts, DEPTH))
    elements, nodes = e.collect(), O.nodes_of(e, H, counts, DEPTH).collect()
    v = dict(volumes(elements, nodes))
    want = np.prod(np.subtract(b, a))
    assert min(v.values()) > 0 and abs(sum(v.values()) - want) < 1e-12 and {x["level"] for x in solid.collect()} == {2, 3}
    at = {n: p for n, *p in nodes}
    for f in open_faces(elements):
        p = np.array([at[x] for x in f])
        assert any(np.all(np.abs(p[:, c] - s[c]) < 1e-12) for c in range(3) for s in (a, b))
