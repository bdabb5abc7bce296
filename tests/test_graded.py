"""Graded fills: levels as asked, conforming, positive volumes that sum to the solid's; collapses against what must hold."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import surface
from tessera.plans import graded, lattice
from tessera.session import saver


def solid(elements, nodes):
    """Volumes and faces (counted) of tetrahedra, by numpy."""
    at = {r["nid"]: np.array([r["x"], r["y"], r["z"]]) for r in nodes.collect()}
    tets = [r["nodes"] for r in elements.collect()]
    volume = np.array([np.cross(at[b] - at[a], at[c] - at[a]) @ (at[d] - at[a]) / 6 for a, b, c, d in tets])
    return at, tets, volume, Counter(tuple(sorted(f)) for t in tets for f in combinations(t, 3))


def test_levels_and_bisection(spark):
    save = saver(spark, "graded")
    extent = (2.0, 2.0, 2.0)
    tri, vert = lattice.box_surface(spark, (0.0, 0.0, 0.0), extent)
    t = surface.triangles_of(tri, vert)
    seeds = spark.createDataFrame([(0.1, 0.1, 0.1)], "x double, y double, z double")
    edges = spark.createDataFrame([(1.9, 1.9, 1.5)], "x double, y double, z double")
    elements, nodes, done = graded.graded_fill(t, extent, 1.0, spark, save, seeds=seeds, seed_band=0.9, edges=edges, edge_band=0.8)
    at, tets, volume, faces = solid(elements, nodes)
    assert done["cells"] == [6, 1, 1] and done["h_fine"] == 0.25 and done["taken_back"] == 0
    assert (volume > 0).all() and volume.sum() == pytest.approx(8.0) and set(faces.values()) == {1, 2}
    once = [f for f, n in faces.items() if n == 1]
    area = sum(np.linalg.norm(np.cross(at[b] - at[a], at[c] - at[a])) / 2 for a, b, c in once)
    assert area == pytest.approx(24.0)  # no face hangs: the faces of one element are the box's
    asked = {(0, 0, 0): 2, (1, 1, 1): 1}
    for t_ in tets:
        p = [at[n] for n in t_]
        level = asked.get(tuple(np.floor(sum(p) / 4).astype(int)), 0)
        assert max(np.linalg.norm(a - b) for a, b in combinations(p, 2)) <= 3**0.5 / 2**level + 1e-9
    assert set(at) == {n for t_ in tets for n in t_}


def test_skin_by_hops(spark):
    save = saver(spark, "graded")
    counts = (5, 5, 5)
    inside = save(lattice.cells(spark, counts).filter("NOT (i = 4 AND j = 4)"))
    cells = {(r["i"], r["j"], r["k"]) for r in inside.collect()}
    near = lambda c: [tuple(np.add(c, s)) for s in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
    want = {c: 0 for c in cells if any(n not in cells for n in near(c))}
    want |= {c: 1 for c in cells - set(want) if any(want.get(n) == 0 for n in near(c))}
    for layers, most in ((1, 0), (2, 1)):
        got = {(r["i"], r["j"], r["k"]): r["hops"] for r in graded.skin_cells(inside, layers, save).join(inside, "cell").collect()}
        assert got == {c: n for c, n in want.items() if n <= most}
    level = {(r["i"], r["j"], r["k"]): r["level"] for r in graded.cell_levels(inside, counts, 1.0, save, layers=1).collect()}
    assert level == {c: int(want.get(c) == 0) for c in cells}
    assert {r["level"] for r in graded.cell_levels(inside, counts, 1.0, save).collect()} == {0}


def test_collapse(spark):
    """Jittered inner nodes, some very near others: what is left fills the same box, and no free short edge could still go."""
    save = saver(spark, "graded")
    counts = (3, 3, 3)
    elements = save(lattice.fill(lattice.cells(spark, counts), counts).select("eid", "nodes"))
    r = np.random.default_rng(5)
    rows = []
    for n in lattice.lattice_nodes(spark, counts, 1.0).orderBy("nid").collect():
        inner = all(0 < n[c] < 3 for c in "xyz")
        shift = r.uniform(-0.3, 0.3, 3) if inner else np.zeros(3)
        rows.append((n["nid"], *(float(n[c] + s) for c, s in zip("xyz", shift)), not inner))
    nodes = spark.createDataFrame(rows, "nid long, x double, y double, z double, fixed boolean")
    _, _, before, _ = solid(elements, nodes)
    assert (before > 0).all()
    out, kept, taken = graded.collapse(elements, nodes, 0.85, save)
    at, tets, volume, faces = solid(out, kept)
    assert taken > 0 and len(at) == len(rows) - taken and (volume > 0).all() and volume.sum() == pytest.approx(27.0) and max(faces.values()) == 2
    free = {x[0] for x in rows if not x[4]} & set(at)
    assert {x[0] for x in rows if x[4]} <= set(at)
    for a in free:
        star = [t for t in tets if a in t]
        for b in {n for t in star for n in t if n != a and np.linalg.norm(at[n] - at[a]) < 0.85}:
            rest = [[b if n == a else n for n in t] for t in star if b not in t]
            assert any(np.cross(at[q] - at[p], at[s] - at[p]) @ (at[u] - at[p]) / 6 <= 0 for p, q, s, u in rest)
    same, _, none = graded.collapse(elements, nodes.withColumn("fixed", F.lit(True)), 9.0, save)
    assert none == 0 and same.count() == elements.count()


def test_fill_of_a_cylinder(spark):
    """Snapped and collapsed: positive volumes, no face of three elements, boundary nodes nearer to the surface than the cells' corners."""
    save = saver(spark, "graded")
    tri, vert = lattice.cylinder_surface(spark, 1.0, 2.0, 24)
    vert = vert.select("vid", (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"), "z")
    t = save(surface.triangles_of(tri, vert))
    far = lambda e, n: surface.closest_on_surface(n.join(graded.boundary_nodes(e), "nid", "left_semi").select(F.col("nid").alias("pid"), "x", "y", "z"), t, 0.5, save).agg(F.avg(F.sqrt("d2"))).first()[0]
    plain = graded.graded_fill(t, (2.0, 2.0, 2.0), 0.5, spark, save, snapped=False)
    elements, nodes, done = graded.graded_fill(t, (2.0, 2.0, 2.0), 0.5, spark, save, short=0.7)
    at, tets, volume, faces = solid(elements, nodes)
    assert (volume > 0).all() and max(faces.values()) == 2 and done["moved"] > 0 and set(at) >= {n for e in tets for n in e}
    assert far(elements, nodes) < 0.5 * far(*plain[:2])
