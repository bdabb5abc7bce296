"""Surfaces, selections, fills, bisection and kernels on small meshes."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import kernels, registry
from tessera.operators import experiments, fields, ordered, spatial, surface, topology, walks
from tessera.plans import lattice, relax, sizing
from tessera.session import saver
from tessera.sources import meshes, records, sinks
from tessera.streaming import run_log


def brute_closest(p, a, b, c):
    """By minimising over a fine grid of barycentric coordinates, then along the sides."""
    best = np.inf
    for u in np.linspace(0, 1, 201):
        v = np.linspace(0, 1 - u, 201)[:, None]
        q = a + u * (b - a) + v * (c - a)
        best = min(best, ((q - p) ** 2).sum(axis=1).min())
    return best


def unit_box(spark):
    tri, vert = lattice.box_surface(spark, (0, 0, 0), (1, 1, 1))
    return tri, vert, surface.triangles_of(tri, vert)


def test_closest_on_triangle(spark):
    r = np.random.default_rng(3)
    rows = [(i, *map(float, r.uniform(-1, 2, 12))) for i in range(40)]
    rows.append((40, 0.5, 0.5, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0))  # a flat triangle
    names = [f"{n}{c}" for n in "pabc" for c in "xyz"]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{n} double" for n in names))
    got = df.select("i", G.closest_on_triangle(G.vec("p"), G.vec("a"), G.vec("b"), G.vec("c")).alias("q")).collect()
    for x in got:
        p, a, b, c = np.array(rows[x["i"]][1:]).reshape(4, 3)
        assert math.isclose(x["q"]["d2"], brute_closest(p, a, b, c), abs_tol=2e-3)
        q = np.array([x["q"][k] for k in "xyz"])
        assert math.isclose(((q - p) ** 2).sum(), x["q"]["d2"], abs_tol=1e-12)


def test_closest_on_surface_and_what_follows(spark):
    tri, vert, t = unit_box(spark)
    save = saver(spark, "surface-test")
    pts = spark.createDataFrame([(0, 0.5, 0.5, 0.9), (1, 0.5, 0.5, 1.5), (2, 2.0, 2.0, 2.0), (3, 0.2, 0.5, 0.5), (4, 900.0, 0.5, 0.5)], "pid long, x double, y double, z double")
    got = {r["pid"]: math.sqrt(r["d2"]) for r in surface.closest_on_surface(pts, t, 0.4, save, 3).collect()}
    assert all(math.isclose(got[i], d, abs_tol=1e-9) for i, d in {0: 0.1, 1: 0.5, 2: math.sqrt(3), 3: 0.2, 4: 899.0}.items())
    assert surface.closest_on_surface(pts, t.limit(0), 0.4, save).count() == 0
    c = surface.conformity(surface.closest_on_surface(pts.filter("pid < 2"), t, 0.4, save)).first()
    assert math.isclose(c["max_distance"], 0.5) and c["n"] == 2 and c["n_on"] == 0
    nodes = pts.select(F.col("pid").alias("nid"), "x", "y", "z")
    regions = t.select("tid", (F.col("tid") % 6).alias("region"))
    assert {r["nid"] for r in surface.region_of_nodes(nodes, t, regions, 0.1, save).collect()} == {0}
    sites = pts.select(F.col("pid").alias("sid"), "x", "y", "z", (F.col("pid") == 3).alias("fixed"))
    moved, row = surface.project_sites(sites, t, sites.filter("sid = 1").select("sid", "x", "y", "z"), 0.55, 0.01, 0.4, save)
    at = {r["sid"]: r["z"] for r in moved.collect()}
    assert at[0] == 1.0 and at[1] == 1.5 and row.first()["n_moved"] == 1  # site 1 is guarded, 3 is fixed, the others are far


def test_snap_takes_back_what_offends(spark):
    tri, vert, t = unit_box(spark)
    nodes = spark.createDataFrame([(0, 0.5, 0.5, 0.95), (1, 0.5, 0.5, 0.9), (2, 0.1, 0.5, 0.5)], "nid long, x double, y double, z double")
    offenders = lambda n: n.filter("nid = 1 AND z > 0.99")
    together = spark.createDataFrame([(7, 1), (8, 0), (8, 2)], "eid long, nid long")
    out, row = surface.snap(nodes, t, 0.2, offenders, together, saver(spark))
    at = {r["nid"]: (r["x"], r["z"]) for r in out.collect()}
    assert at[0][1] == pytest.approx(1.0) and at[1][1] == 0.9 and at[2][0] == pytest.approx(0.0) and tuple(row.first()) == (3, 1)


def test_scorecard_of_a_box_and_a_cylinder(spark):
    save = saver(spark, "card")
    counts, h = (2, 2, 2), 0.5
    nodes = lattice.lattice_nodes(spark, counts, h)
    e = lattice.fill(lattice.cells(spark, counts), counts)
    skin = topology.boundary_skin(topology.faces(e)).select("eid", "local", "nodes")
    _, _, t = unit_box(spark)
    card = surface.curved_scorecard(skin, nodes, t, h, save, (1.0, 1.0), None, e).first()
    assert card["m1"] == pytest.approx(0, abs=1e-9) and card["m2"] == pytest.approx(0, abs=1e-9) and card["m3"] == 0 and card["m4"] is None and 0.2 < card["m6"] < 1
    assert card["score"] == pytest.approx((0.12 + 0.30 + 0.12 + 0.08 * card["m6"]) / 0.62)
    tri, vert = lattice.cylinder_surface(spark, 1.0, 2.0, 12)
    assert topology.open_edges(tri, ["tid"]).count() == 0
    own = surface.triangles_of(tri, vert)
    around = vert.select(F.col("vid").alias("nid"), "x", "y", "z")
    card = surface.curved_scorecard(tri.select(F.col("tid").alias("eid"), F.lit(0).alias("local"), "nodes"), around, own, 0.5, save, None, {"axis": 2, "origin": (0, 0, 0), "radius": 1.0}).first()
    assert card["m4"] == pytest.approx(0, abs=1e-9) and card["m5"] == pytest.approx(math.pi / 6) and card["m3"] is None and card["m6"] is None


def test_selections(spark):
    counts, h = (2, 2, 2), 0.5
    nodes = lattice.lattice_nodes(spark, counts, h)
    e = lattice.fill(lattice.cells(spark, counts), counts, "hex8")
    skin = topology.boundary_skin(topology.faces(e)).select("eid", "local", "nodes")
    box = lambda lo, hi: spark.createDataFrame([("b", [True, True, True], *lo, *hi)], "box string, fix array<boolean>, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    assert surface.fixed_dofs(nodes, skin, box((-0.1, -0.1, -0.1), (0.1, 1.1, 1.1))).count() == 27
    assert surface.fixed_dofs(nodes, skin, box((-0.02, -1.0, -1.0), (-0.01, 2.0, 2.0))).count() == 27  # only the widened box meets the plane
    face = lambda f, x, nx, a: (f, x, 0.0, 0.0, nx, 0.0, math.sqrt(1 - nx * nx), a)
    faces = spark.createDataFrame([face(0, 1.0, 1.0, 1.0), face(1, 0.9, -1.0, 1.0), face(2, 0.8, 1.0, 1.0), face(3, 1.0, 0.0, 1.0)], "fid long, x double, y double, z double, nx double, ny double, nz double, area double")
    load = lambda expected, dot: spark.createDataFrame([("l", 0.0, -1.0, -1.0, 2.0, 1.0, 1.0, 3.0, 0.0, 0.0, dot, expected)], "box string, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double, tx double, ty double, tz double, least_dot double, expected_area double")
    chosen = lambda *a: sorted(r["fid"] for r in surface.load_faces(faces, load(*a), saver(spark)).collect())
    assert chosen(None, 0.5) == [0, 1, 2] and chosen(2.0, 0.5) == [0, 1] and chosen(2.9, 0.5) == [0, 1, 2] and chosen(None, 1.5) == [0, 1, 2, 3]


def test_polyhedra_and_skins(spark):
    v = [(i, float(i & 1), float(i >> 1 & 1), float(i >> 2) * 2) for i in range(8)]
    nodes = spark.createDataFrame(v, "nid long, x double, y double, z double")
    hexa = [list(c) for _, c in lattice.SIDES]
    e = spark.createDataFrame([(0, "poly", list(range(8)), hexa)], "eid long, etype string, nodes array<long>, faces array<array<int>>")
    got = topology.polyhedra(e, nodes).first()
    assert got["volume"] == pytest.approx(2.0) and [got[c] for c in ("cx", "cy", "cz")] == pytest.approx([0.5, 0.5, 1.0])
    assert topology.boundary_polygons(topology.faces(e)).count() == 6
    assert topology.skin_edges(spark.createDataFrame([(0, [0, 1, 3, 2, 4, 5, 7, 6]), (1, [0, 1, 2, 3, 4, 5, 6])], "eid long, nodes array<long>")).count() > 12
    flat = spark.createDataFrame([(0, 0, [1, 2, 2]), (0, 1, [1, 2, 3])], "eid long, local int, nodes array<long>")
    assert [r["nodes"] for r in topology.boundary_skin(flat).collect()] == [[1, 2, 3]]


def volume_of(e, nodes):
    flat = e
    for i in range(4):
        flat = flat.withColumn("nid", F.element_at("nodes", i + 1)).join(nodes.toDF("nid", f"p{i}x", f"p{i}y", f"p{i}z"), "nid").drop("nid")
    v = G.tet_volume(*[G.vec(f"p{i}") for i in range(4)])
    return flat.agg(F.sum(v), F.min(v)).first()


def test_bisection(spark):
    counts, h = (1, 1, 2), 1.0
    nodes, e = lattice.lattice_nodes(spark, counts, h), lattice.fill(lattice.cells(spark, counts), counts)
    first = {r["eid"]: sorted(r["nodes"]) for r in e.collect()}
    new, more = topology.bisect(e, nodes, spark.createDataFrame([(0,), (3,)], "eid long"), saver(spark, "bisect"))
    total, least = volume_of(new, more)
    assert total == pytest.approx(2.0) and least > 0 and new.count() > 13
    assert topology.conformity(topology.face_classes(topology.faces(new.withColumns({"etype": F.lit("tet4"), "faces": F.lit(None).cast("array<array<int>>")})))).first()["conforming"]
    left = {r["eid"]: sorted(r["nodes"]) for r in new.collect()}
    assert left[0] != first[0] and left[3] != first[3]
    hanging = topology.faces(new.withColumns({"etype": F.lit("tet4"), "faces": F.lit(None).cast("array<array<int>>")}))
    assert topology.hanging_faces(topology.boundary_skin(hanging), more, 1e-9).count() == 0
    seeds = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "sid long, x double, y double, z double")
    waves, at = topology.bisect_near(e, nodes, seeds, 0.9, 2, saver(spark, "waves"))
    assert volume_of(waves, at)[0] == pytest.approx(2.0) and waves.count() > new.count() - 12


def test_fills(spark):
    counts, h = (3, 3, 3), 1.0
    inside = lattice.cells(spark, counts)
    nodes = lattice.lattice_nodes(spark, counts, h).unionByName(lattice.centre_nodes(inside, counts, h))
    skin = lattice.pyramid_skin(inside, counts)
    assert {r["etype"]: r["n"] for r in topology.element_type_counts(skin).collect()} == {"hex8": 1, "pyramid5": 26 * 6}
    c = topology.conformity(topology.face_classes(topology.faces(skin))).first()
    assert c["conforming"] and c["n_boundary"] == 54
    own = kernels.with_coordinates(skin.filter("etype = 'pyramid5'").limit(5), nodes).collect()
    x = np.array([r["coords"] for r in own])
    assert np.allclose(kernels.volumes("pyramid5", x), 1 / 6) and np.isclose(kernels.quadrature("pyramid5")[1].sum(), 8 / 3)
    assert np.allclose(kernels.body_load("pyramid5", x, (0, 0, 6.0)).sum(axis=1), 1.0)
    octa = lattice.octahedral_fill(inside, counts)
    total, least = volume_of(octa, nodes)
    assert total == pytest.approx(27.0) and least > 0 and octa.select("eid").distinct().count() == octa.count() == 54 * 4 + 54 * 2
    c = topology.conformity(topology.face_classes(topology.faces(octa))).first()
    assert c["conforming"] and c["n_boundary"] == 108
    tri, vert = lattice.box_surface(spark, (0, 0, 0), (1.0, 1.5, 2.0))
    t = surface.triangles_of(tri, vert)
    for axis in "xyz":
        assert lattice.classify(t, (4, 4, 4), 0.5, spark, axis).count() == 2 * 3 * 4
    bent = t.withColumns({"ka": F.lit(0.0), "kb": F.lit(0.0), "kc": F.when(F.col("tid") == 0, 1.0).otherwise(0.0)})
    levels = {r["level"] for r in lattice.curvature_levels(bent, (4, 4, 4), 0.5, 0.3).collect()}
    assert levels == {1, 2}


def test_l_domain(spark):
    e, nodes = lattice.l_domain(spark, 2)
    assert volume_of(e, nodes)[0] == pytest.approx(0.75 * 0.25) and topology.orphans(nodes, e).count() == 0
    line = lattice.graded_line(0.0, 1.0, 0.5, 0.1, 2.0, 2)
    assert line == pytest.approx([0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0])
    e, nodes = lattice.l_domain(spark, 1, graded=(0.1, 2.0, 2))
    assert volume_of(e, nodes)[0] == pytest.approx(0.75 * 0.25)


def test_kernels_of_all_types():
    r = np.random.default_rng(8)
    for etype in ("tet4", "tet10", "hex8", "hex20", "prism6", "pyramid5"):
        ref = kernels.reference_nodes(etype)
        n, _ = kernels.shape(etype, ref)
        on = np.arange(len(ref)) < (4 if etype == "pyramid5" else len(ref))
        assert np.allclose(n[on], np.eye(len(ref))[on])
        p = r.uniform(0.1, 0.3, (4, 3))
        _, g = kernels.shape(etype, p)
        for k in range(3):
            step = np.zeros(3)
            step[k] = 1e-6
            near = (kernels.shape(etype, p + step)[0] - kernels.shape(etype, p - step)[0]) / 2e-6
            assert np.allclose(g[:, :, k], near, atol=1e-7)
        x = (ref @ np.array([[1.0, 0.2, 0], [0, 1, 0.1], [0, 0, 1.3]]))[None]
        k = kernels.stiffness(etype, x, kernels.elasticity(1.0, 0.3))[0]
        assert np.allclose(k, k.T) and (np.abs(np.linalg.eigvalsh(k)) < 1e-9).sum() == 6
    for degree in range(6):
        p, w = kernels.tet_quadrature(degree)
        assert math.isclose((w * p[:, 0] ** degree).sum(), math.factorial(degree) / math.factorial(degree + 3), rel_tol=1e-12)
    square = np.array([[[0, 0, 0], [2, 0, 0], [2, 1, 0], [0, 1, 0]]], float)
    load = kernels.traction_load(square, lambda x: np.stack([x[:, 0], 0 * x[:, 0], 1 + 0 * x[:, 0]], axis=1)).reshape(4, 3)
    assert load.sum(axis=0) == pytest.approx([2.0, 0.0, 2.0])
    with pytest.raises(ValueError):
        kernels.stiffness("tet4", np.array([[[0, 0, 0], [0, 1, 0], [1, 0, 0], [0, 0, 1]]], float), kernels.elasticity(1.0, 0.3))
    assert kernels.hp_values(2, np.array([[0.1, 0.2, 0.3]])).shape == (1, 27) and math.isclose(kernels.hp_values(1, np.array([[0.1, 0.2, 0.3]])).sum(), 1.0)


def test_solves_agree(spark):
    a = spark.createDataFrame([(0, 0, 4.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 3.0)], "row long, col long, val double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, val double")
    want = np.linalg.solve([[4, 1], [1, 3]], [1, 2])
    for method in ("auto", "direct", "cg"):
        got = {r["i"]: r["val"] for r in fields.solve(a, b, saver(spark), method).collect()}
        assert [got[0], got[1]] == pytest.approx(want)
    assert fields.solve_method(9000) == "cg" and fields.solve_method(9000, threshold=100_000) == "direct"
    with pytest.raises(ArithmeticError):
        fields.direct_solve(spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 1.0)], "row long, col long, val double"), b)
    assert fields.strain_energy(a, b) == pytest.approx(0.5 * (4 + 2 + 2 + 12))
    loads = kernels.traction_loads(spark.createDataFrame([([0, 1, 2], [[0.0, 0.0, 0.0], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])], "nodes array<long>, coords array<array<double>>"), lambda x: np.ones_like(x))
    assert loads.agg(F.sum("val")).first()[0] == pytest.approx(1.5)


def test_marking_at_any_magnitude(spark, monkeypatch):
    for scale in (1e-9, 1.0, 1e18, 1e200):
        for one_task in (1_000_000, 20):
            monkeypatch.setattr(ordered, "ONE_TASK", one_task)
            values = [scale * ((i * 37) % 101) for i in range(300)] + [None]
            df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, eta double")
            got = {r["id"] for r in ordered.dorfler_mark(df, "eta", 0.6, ["id"]).filter("marked").collect()}
            base = [(v or 0.0) / scale for v in values]
            total, acc, want = sum(v * v for v in base), 0.0, set()
            for i in sorted(range(300), key=lambda i: (-base[i], i)):
                if acc >= 0.6 * total:
                    break
                acc += base[i] ** 2
                want.add(i)
            assert got == want


def test_blocks_equal_one_window(spark, monkeypatch):
    """Heavy ties, null keys and null parts give the same in blocks as in one window."""
    rows = [(i, None if i % 17 == 0 else "a" if i % 3 else "b", None if i % 29 == 0 else float(5 if i % 2 else i % 40), i % 7) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, part string, lead double, v long")
    for descending in (False, True):
        for part in (None, ["part"]):
            for kind in ("sum", "max"):
                out = []
                for one_task in (10**9, 5):
                    monkeypatch.setattr(ordered, "ONE_TASK", one_task)
                    got = ordered.running(df, F.col("v"), "r", "lead", ["id"], kind, descending, False, part)
                    out.append({x["id"]: x["r"] for x in got.collect()})
                assert out[0] == out[1]
    front = experiments.pareto_front(spark.createDataFrame([(None, 1.0, 1.0), (None, 0.5, 2.0), ("a", 0.5, 2.0), ("a", None, 0.1)], "p string, good double, cost double"), "good", "cost", ["p"])
    assert sorted((r["p"] or "", r["good"]) for r in front.collect()) == [("", 1.0), ("a", 0.5)]


def test_parity_follows_the_last_kept(spark):
    cross = spark.createDataFrame([("k", z) for z in (0.0, 0.6, 1.2, 1.8, 5.0)] + [("m", 1.0)], "k string, z double")
    q = spark.createDataFrame([("k", z) for z in (-1.0, 0.0, 1.5, 9.0)] + [("none", 1.0), (None, 1.0)], "k string, at double")
    kept = sorted(r["z"] for r in ordered.merged_crossings(cross.filter("k = 'k'"), "k", "z", 1.0).collect())
    assert kept == [0.0, 1.2, 5.0]
    got = sorted((r["k"] or "", r["at"], r["n_below"], r["inside"]) for r in ordered.parity_inside(cross, q, "k", "z", "at", 1.0).collect())
    assert got == [("", 1.0, 0, False), ("k", -1.0, 0, False), ("k", 0.0, 1, True), ("k", 1.5, 2, False), ("k", 9.0, 3, True), ("none", 1.0, 0, False)]


def test_thinning_is_sequential(spark):
    line = spark.createDataFrame([(i, 0.9 * i, 0.0, 0.0) for i in range(3)], "sid long, x double, y double, z double")
    assert sorted(r["sid"] for r in spatial.thin_greedily(line, 1.0, saver(spark)).collect()) == [0, 2]
    r = np.random.default_rng(5)
    pts = r.uniform(0, 3, (70, 3))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(pts)], "sid long, x double, y double, z double")
    kept = []
    for i, x in enumerate(pts):
        if all(((x - pts[j]) ** 2).sum() >= 0.8**2 for j in kept):
            kept.append(i)
    assert sorted(r["sid"] for r in spatial.thin_greedily(df, 0.8, saver(spark)).collect()) == kept


def test_helpers_run(spark, tmp_path):
    """Each operator that no query binds, once on a case whose answer is known."""
    save = saver(spark, "helpers")
    tri, vert, t = unit_box(spark)
    ids = spark.createDataFrame([(10, 0), (20, 1)], "old long, new long")
    e, lost = topology.remap(spark.createDataFrame([(0, [20, 10]), (1, [10, 30])], "eid long, nodes array<long>"), ids)
    assert {r["eid"]: r["nodes"] for r in e.collect()}[0] == [1, 0] and [r["old"] for r in lost.collect()] == [30]
    f = spark.createDataFrame([(0, 0.1, 0.0, 0.0), (1, 0.1000001, 0.0, 0.0), (2, 0.9, 0.0, 0.0)], "fid long, x double, y double, z double")
    assert [tuple(r) for r in topology.pair_by_centroid(f, 1e-3).collect()] == [(0, 1)]
    p = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0)], "pid long, x double, y double, z double, nx double, ny double, nz double")
    q = spark.createDataFrame([(0, 0.1, 0.0, 0.0, -0.9, 0.1, 0.0), (1, 0.1, 0.0, 0.0, 0.0, 1.0, 0.0)], "sid long, x double, y double, z double, nx double, ny double, nz double")
    assert spatial.best_alignment(p, q, 1.0).first()["best"] == pytest.approx(0.9)
    ray = spark.createDataFrame([(0, 0.3, 0.4, 0.5, 1.0, 0.0, 0.0)], "rid long, ox double, oy double, oz double, dx double, dy double, dz double")
    assert walks.ray_hits(ray, t, 0.5, 2.0).first()["t"] == pytest.approx(0.7)
    s = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (1, 0, 0.1, 0.0, 0.0), (2, 1, 0.3, 0.0, 0.0)], "sid long, edge long, x double, y double, z double")
    assert {r["pid"]: round(r["gap"], 6) for r in spatial.other_edges_gap(s, 1.0).collect()} == {0: 0.3, 1: 0.2, 2: 0.2}
    assert fields.distance_summary(spark.createDataFrame([(4.0,), (0.0,)], "d2 double")).first()[:] == (2.0, 1.0, 2, 1)
    assert fields.chordal_efficiency(spark.createDataFrame([(0.125, 1.0, 1.0), (9.0, 1.0, 0.0)], "d double, length double, kappa double")).first()[0] == 1.0
    u = spark.createDataFrame([(0, 3.0, 0.0, 4.0), (1, 1.0, 0.0, 0.0)], "nid long, ux double, uy double, uz double")
    assert fields.displacement_summary(u, u.filter("nid = 1"), "ux").first()[:] == (1.0, 1.0, 5.0)
    counts, flags = fields.short_features(spark.createDataFrame([(0, "sharp", 0.5), (1, "sharp", 1.9), (2, "smooth", 0.1)], "id long, feature string, length double"), 1.0)
    assert counts.first()[:] == (2, 1) and [r["id"] for r in flags.collect()] == [0]
    n = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0)], "nid long, x double, y double, z double")
    held, load = fields.slab_conditions(n, 0.5, 10.0)
    assert held.count() == 3 and {r["val"] for r in load.collect()} == {5.0}
    k = spark.createDataFrame([(0, 1, None, None), (0, 0, None, None), (0, 1, 0.99, None), (0, 1, 0.0, None)], "f1 long, f2 long, dot double, x string")
    assert [r["feature"] for r in topology.edge_classes(k.withColumn("f2", F.when(F.col("dot").isNull() & (F.col("f2") == 1), F.lit(None)).otherwise(F.col("f2")))).collect()] == ["sharp", "seam", "smooth", "sharp"]
    assert [r["n"] for r in topology.numbered_once(s, ["edge"], ["sid"], "n").orderBy("sid").collect()] == [0, 1, 0]
    assert spark.range(1).select(experiments.grid_size(F.create_map(F.lit("a"), F.array(F.lit(1), F.lit(2)), F.lit("b"), F.array(F.lit(1), F.lit(2), F.lit(3))), F.lit(4))).first()[0] == 24
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "shot.png").write_bytes(b"1")
    assert records.artifacts(spark, str(tmp_path)).count() == 1
    eta = spark.createDataFrame([(i, 1.0 if i else 10.0) for i in range(30)], "eid long, eta double")
    marked, h, band = relax.refine_suggestion(eta, 0.5, 1.0, 0.5)
    assert [r["eid"] for r in marked.collect()] == [0] and h == 1.0 and band == 1.5
    steps = relax.adapt(lambda h: spark.createDataFrame([(i, h) for i in range(4)], "eid long, eta double"), 1.0, 0.5, 0.6, 0.5)
    assert [x[1] for x in steps] == [1.0, 0.5, 0.25]
    assert topology.weld_within(n.withColumnRenamed("nid", "pos").unionByName(spark.createDataFrame([(7, 1.0 + 1e-12, 1.0, 0.0)], "pos long, x double, y double, z double")), "pos").select("weld_id").distinct().count() == 3
    assert fields.mean_edge_length(tri, vert).first()[0] == pytest.approx((2 + math.sqrt(2)) / 3)
    own, top = fields.element_to_nodes(spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "eid long, nid long"), spark.createDataFrame([(0, 1.0), (1, 3.0)], "eid long, eta double"), spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "nid long, sxx double, syy double, szz double, syz double, sxz double, sxy double"), u)
    assert {r["nid"]: r["eta"] for r in own.collect()} == {0: 2.0, 1: 3.0} and top.first()[:] == (3.0, 1.0, 5.0)
    samples = spark.createDataFrame([("e", 0, 0.0, 0.0, 0.0), ("e", 1, 1.0, 0.0, 0.0), ("e", 2, 1.0, 1.0, 0.0)], "edge string, pos int, x double, y double, z double")
    seg = spatial.polyline_segments(samples)
    assert seg.count() == 2 and spatial.samples_along(seg, 0.25).count() == 10
    near = spatial.nearest_segment(n.select(F.col("nid").alias("pid"), "x", "y", "z"), seg, 1.0, 2.0, F.col("bx") == F.col("ax"))
    assert {r["pid"]: r["d2"] for r in near.collect()} == {0: 1.0, 1: 0.0, 2: 0.0}
    j = spark.range(1).select(*[G.hash_signed(F.lit(a), F.lit(b), F.lit(c), x) for a, b, c, x in ((1, 2, 3, 0), (-4, 5, 900, 2))]).first()
    mix = lambda x: (lambda a: (a ^ a >> 16) / 4294967295)((lambda a: (a ^ a >> 15) * 0x846CA68B % 2**32)((x ^ x >> 16) * 0x7FEB352D % 2**32))
    key = lambda a, b, c, x: (a * 73856093 ^ b * 19349663 ^ c * 83492791 ^ x * 2654435761) % 2**32
    assert list(j) == pytest.approx([2 * mix(key(1, 2, 3, 0)) - 1, 2 * mix(key(-4, 5, 900, 2)) - 1])


def test_sizing(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 10.0, None), (1, 0.1, 0.0, 0.0, 2.0, None), (2, 5.0, 0.0, 0.0, None, 1.0), (3, 9.0, 0.0, 0.0, None, None)], "vid long, x double, y double, z double, kappa double, thickness double")
    geo = sizing.geometry_sources(v, 0.05, 1.0)
    assert {r["sid"]: round(r["h"], 6) for r in geo.collect()} == {0: 0.05, 1: 0.15, 2: 0.35}
    regions = spark.createDataFrame([("r", 8.0, -1.0, -1.0, 10.0, 1.0, 1.0, 0.01)], "box string, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double, share double")
    seeds, row = sizing.refinement_plan(geo, v.select(F.col("vid").alias("sid"), "x", "y", "z"), regions, 1.0)
    assert sorted((r["kind"], r["sid"]) for r in seeds.collect()) == [("geometry", 0), ("geometry", 2), ("region", 3)] and row.first()[:] == (2, 1, 1.5, 0.05)
    assert sizing.point_sources(v.select(F.col("vid").alias("sid"), "x", "y", "z"), 0.5).agg(F.sum("h")).first()[0] == 2.0 and sizing.auto_size(v, 9.0) == 1.0


def test_registered_functions(spark, tmp_path):
    names = registry.register(spark)
    assert {"soft_time", "tet_volume", "stl_triangles"} <= set(names)
    row = spark.sql("SELECT soft_time(1000) AS t, tet_volume(0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1) AS v, geometry_class(false, 0.3) AS g, relative_error(2, 0) AS r, von_mises(1, 0, 0, 0, 0, 0) AS m").first()
    assert (row["t"], row["g"], row["r"], row["m"]) == (0.5, "curved", 2.0, 1.0) and row["v"] == pytest.approx(1 / 6)
    text = "solid t\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid"
    spark.createDataFrame([(bytearray(text.encode()),)], "data binary").createOrReplaceTempView("stl_files")
    assert spark.sql("SELECT t.tid, t.c FROM stl_files, LATERAL stl_triangles(data) t").first()["c"] == [0.0, 0, 0, 1, 0, 0, 0, 1, 0]


def test_versions_and_budget(spark, tmp_path):
    (tmp_path / "log").mkdir()
    row = lambda c, s: json.dumps({"cfg_id": c, "part": "p", "tier": 0, "status": s, "accuracy": {"score": 0.5}})
    (tmp_path / "log" / "1.jsonl").write_text(row("a", "ok") + "\n")
    path = str(tmp_path / "versions")
    assert run_log.newer(spark, path) is None
    q = run_log.publish_versions(run_log.live_ranking(run_log.stream_runs(spark, str(tmp_path / "log"))), path, str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        version, df = run_log.newer(spark, path)
        assert df.count() == 1 and run_log.newer(spark, path, version) is None  # a batch that only moves the watermark is a version, too
        (tmp_path / "log" / "2.jsonl").write_text(row("b", "ok") + "\n" + row("a", "ok") + "\n")
        q.processAllAvailable()
        version, df = run_log.newer(spark, path, version)
        assert version >= 1 and {r["cfg_id"]: r["n_runs"] for r in df.collect()} == {"a": 1, "b": 1}
        state = run_log.progress(q)
        assert state["active"] and state["version"] >= 1
        assert run_log.run_within(q, 0.5) == "budget" and not q.isActive
    finally:
        q.stop()


def test_rows_of_reports(spark, tmp_path):
    rows = sinks.constant_rows(spark, [{"case_id": "a", "solver": "s", "label": "l", "dofs": 3, "value": 1.0, "notes": "n"}, {"case_id": "b", "solver": "s"}])
    out = sinks.scoreboard_rows(rows, ["a"], {"case_id": "ratio", "solver": "s", "label": "l", "dofs": 3, "dof_ratio": 5.1, "time_ratio": None, "total_s": 1.0}).collect()
    assert [(r["case_id"], r["notes"]) for r in out] == [("a", "n; dof_ratio=5.1"), ("ratio", "unknowns, uniform over graded")]
    path = str(tmp_path / "log.jsonl")
    for i in range(2):
        sinks.append_line(path, {"cfg_id": f"c{i}", "part": "p", "tier": 0, "status": "ok", "accuracy": {"score": 0.5}, "mesh_ms": 2.0})
    runs = records.run_log(spark, path, "skip")
    assert [tuple(r) for r in sinks.pareto_points(runs).collect()] == [("c0", "p", 0.5, 2.0), ("c1", "p", 0.5, 2.0)]
    assert records.reference_values is not None and spark.createDataFrame([('{"values": {"scf": 3.0}}',)], "t string").select(records.reference_values(F.col("t")).alias("v")).first()["v"] == {"scf": 3.0}
    broken = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)], "nid long, x double, y double, z double")
    with pytest.raises(ValueError):
        sinks.write_vtu(broken, spark.createDataFrame([(0, "tet4", [0, 1, 2, 3])], "eid long, etype string, nodes array<long>"), str(tmp_path / "x.vtu"))
    assert meshes.is_ascii_stl(b"solid x\n facet")
