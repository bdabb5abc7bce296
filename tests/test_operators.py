"""Operators against small fixtures: topology, fields, kernels, plans, streaming."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.functions import hp, kernels, scoring
from tessera.operators import experiments, fields, ordered, spatial, topology
from tessera.plans import campaign, lattice, relax
from tessera.session import saver
from tessera.streaming import run_log

CUBE = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]


def cube(spark):
    v = [(i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)]
    rows = []
    for t, f in enumerate(CUBE):
        a, b, c = (np.array(v[i][1:]) for i in f)
        n = np.cross(b - a, c - a)
        rows.append((t, list(f), float(np.linalg.norm(n) / 2), *map(float, n / np.linalg.norm(n))))
    return spark.createDataFrame(rows, "tid long, nodes array<long>, area double, nx double, ny double, nz double"), spark.createDataFrame(v, "vid long, x double, y double, z double")


def test_cube_surface(spark):
    tri, vertices = cube(spark)
    assert topology.open_edges(tri, ["tid"]).count() == 0
    sharp = topology.sharp_edges(tri, 30.0).collect()
    assert len(sharp) == 12 and all(abs(r["dihedral"] - math.pi / 2) < 1e-9 for r in sharp)
    links = topology.smooth_links(tri, 30.0)
    labels = topology.components(links, tri.select(F.col("tid").alias("node")), saver(spark))
    regions = topology.regions(labels)
    assert regions.select("region").distinct().count() == 6
    assert {(r["node"], r["region"]) for r in regions.collect()} == {(t, t // 2) for t in range(12)}
    normals = {r["vid"]: r for r in fields.vertex_normals(tri).collect()}
    assert len(normals) == 8 and all(abs(r["nx"] ** 2 + r["ny"] ** 2 + r["nz"] ** 2 - 1) < 1e-9 for r in normals.values())
    assert all(r["kappa"] > 0 for r in fields.vertex_curvature(tri, vertices).collect())
    hop = {r["node"]: r["hops"] for r in topology.hops(spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long"), spark.createDataFrame([(0,)], "node long"), saver(spark)).collect()}
    assert hop == {0: 0, 1: 1, 2: 2, 3: 3}


def test_elements(spark):
    counts, h = (2, 2, 2), 0.5
    nodes = lattice.lattice_nodes(spark, counts, h)
    for etype, boundary in (("tet4", 48), ("hex8", 24), ("prism6", 32)):
        e = lattice.fill(lattice.cells(spark, counts), counts, etype)
        f = topology.faces(e)
        c = topology.conformity(topology.face_classes(f)).first()
        assert c["n_boundary"] == boundary and c["conforming"], etype
        assert topology.boundary_skin(f).count() == boundary and topology.hanging_faces(topology.boundary_skin(f), nodes, 1e-9).count() == 0
        assert topology.violations(e, nodes).count() == 0 and topology.orphans(nodes, e).count() == 0
    tets = lattice.fill(lattice.cells(spark, counts), counts)
    assert topology.face_pairs(topology.faces(tets)).count() == (4 * 48 - 48) // 2
    bad = spark.createDataFrame([(0, "tet4", [0, 1, 2]), (1, "tet4", [0, 1, 2, 2]), (2, "tet4", [0, 1, 2, 99]), (3, "poly", [0, 1, 2, 3])], "eid long, etype string, nodes array<long>")
    assert {(r["eid"], r["problem"]) for r in topology.violations(bad, nodes).collect()} == {(0, "arity"), (1, "repeated node"), (2, "unknown node")}
    one = tets.filter("eid = 0")
    new_nodes, new = topology.compact(nodes, one)
    assert sorted(new.first()["nodes"]) == [0, 1, 2, 3] and new_nodes.count() == 4
    more, quad = topology.midpoints(one, nodes, [(0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3)])
    assert len(quad.first()["nodes"]) == 10 and more.count() == 27 + 6
    assert lattice.node_counts("tet10", 2) == 125 and lattice.fit_counts((1, 1, 1), 0.001, 1000)[0] == (10, 10, 10)


def test_weld_keeps_zero_signs_apart(spark):
    p = spark.createDataFrame([(0, 0.0), (1, -0.0), (2, 0.0), (3, 1.0)], "pos long, x double")
    assert [r["weld_id"] for r in topology.weld(p, ["x"], "pos", exact_bits=True).orderBy("pos").collect()] == [0, 1, 0, 2]
    assert topology.weld(p, ["x"], "pos").select("weld_id").distinct().count() == 2


def test_patch_test(spark):
    """Constant strain through assembly, elimination, solving, stresses and recovery on a jittered box."""
    counts, h = (2, 2, 2), 0.5
    nodes = lattice.lattice_nodes(spark, counts, h)
    inner = F.col("nid") == 13
    nodes = nodes.withColumn("x", F.when(inner, 0.56).otherwise(F.col("x")))
    for etype in ("tet4", "hex8"):
        e = kernels.with_coordinates(lattice.fill(lattice.cells(spark, counts), counts, etype), nodes)
        k = fields.assemble(kernels.stiffness_triplets(e, 200.0, 0.3))
        exact = nodes.select("nid", (0.01 * F.col("x") + 0.002 * F.col("y")).alias("ux"), (-0.003 * F.col("y")).alias("uy"), (0.004 * F.col("z")).alias("uz"), inner.alias("inner"))
        dofs = exact.select("nid", "inner", F.posexplode(F.array("ux", "uy", "uz")).alias("c", "v")).select((F.col("nid") * 3 + F.col("c")).alias("dof"), F.col("v").alias("value"), "inner")
        fixed = dofs.filter("NOT inner").select("dof", "value")
        kff, f = fields.eliminate(k, spark.createDataFrame([], "i long, val double"), fixed)
        u = {r["i"]: r["val"] for r in fields.conjugate_gradient(kff, f, saver(spark)).collect()}
        want = {r["dof"]: r["value"] for r in dofs.filter("inner").collect()}
        assert set(u) == set(want) and all(abs(u[i] - want[i]) < 1e-7 for i in u)
    s = kernels.element_stress(e, exact.select("nid", "ux", "uy", "uz"), 200.0, 0.3)
    d = kernels.elasticity(200.0, 0.3) @ np.array([0.01, -0.003, 0.004, 0, 0, 0.002])
    got = s.collect()
    assert all(np.allclose([r[c] for c in fields.VOIGT], d) for r in got) and abs(sum(r["volume"] for r in got) - 1) < 1e-9
    inc = topology.incidence(e)
    rec = fields.recover_patches(inc, s, nodes)
    assert all(np.allclose([r[c] for c in fields.VOIGT], d) for r in rec.collect())
    assert max(r["eta"] for r in fields.recovery_error(inc, s, rec).collect()) < 1e-9
    full = fields.spmv(k, dofs.select(F.col("dof").alias("i"), F.col("value").alias("val")))
    health = fields.solve_health(full, fixed.select(F.col("dof").alias("i"), F.lit(1e-3).alias("val")), fixed).first()
    assert health["free_residual_rel"] < 1e-9
    assert fields.nodal_average(inc, s, ["sxx"], nodes).count() == 27


def test_kernels():
    r = np.random.default_rng(1)
    for etype, nodes in (("tet4", 4), ("tet10", 10), ("hex8", 8), ("prism6", 6)):
        n, g = kernels.shape(etype, r.uniform(0.1, 0.3, (5, 3)))
        assert n.shape == (5, nodes) and np.allclose(n.sum(axis=1), 1) and np.allclose(g.sum(axis=1), 0)
        p, w = kernels.quadrature(etype)
        assert np.isclose(w.sum(), {"tet4": 1 / 6, "tet10": 1 / 6, "hex8": 8, "prism6": 1}[etype])
    unit = np.array([[[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]]], float)
    k = kernels.stiffness("tet4", unit, kernels.elasticity(1.0, 0.3))[0]
    assert np.allclose(k, k.T) and (np.abs(np.linalg.eigvalsh(k)) < 1e-12).sum() == 6
    assert np.isclose(kernels.body_load("tet4", unit, (0, 0, 6.0)).sum(), 1.0)
    assert np.allclose(kernels.lobatto(4, np.array([-1.0, 1.0])), 0)


def test_geometry(spark):
    v = lambda *x: tuple(F.lit(float(c)) for c in x)
    a, b, c, d = v(0, 0, 0), v(1, 0, 0), v(0, 1, 0), v(0, 0, 1)
    row = spark.range(1).select(
        G.triangle_area(a, b, c).alias("area"), G.tet_volume(a, b, c, d).alias("vol"), G.triangle_normal(a, a, b)[2].alias("flat"), G.segment_distance2(v(0.5, 2, 0), a, b).alias("seg"), G.ray_triangle(v(0.2, 0.2, -1), v(0, 0, 1), a, b, c).alias("ray"),
        G.ray_triangle(v(2, 2, -1), v(0, 0, 1), a, b, c).alias("miss"), G.menger_curvature(v(1, 0, 0), v(0, 1, 0), v(-1, 0, 0)).alias("k"), G.at_fraction(F.array(F.lit(1.0), F.lit(3.0)), F.lit(0.25)).alias("lin"), G.dominant_axis(v(1, -2, 2)).alias("axis"),
        G.hash01(F.lit(7)).alias("h"), G.graded_size(F.lit(1.0), F.lit(0.5), F.lit(100.0), F.lit(4.0)).alias("g"), G.quad_area(a, b, c, c).alias("quad"), G.prism_volume([v(0, 0, 0), v(1, 0, 0), v(0, 1, 0), v(0, 0, 1), v(1, 0, 1), v(0, 1, 1)]).alias("prism"),
        G.blended_size(F.lit(1.0), F.lit(3.0), F.lit(1.0), F.lit(2.0)).alias("blend"), G.feature_size(F.lit(0.0), F.lit(None).cast("double"), 0.5, 0.5, F.lit(1.0), F.lit(9.0)).alias("free"),
    ).first()
    assert (row["area"], row["flat"], row["seg"], row["ray"], row["miss"], row["axis"], row["g"], row["quad"], row["blend"], row["free"]) == (0.5, 1.0, 4.0, 1.0, None, 1, 4.0, 0.5, 2.0, 9.0)
    assert math.isclose(row["vol"], 1 / 6) and math.isclose(row["k"], 1.0) and math.isclose(row["lin"], 1.5) and 0 <= row["h"] < 1 and math.isclose(row["prism"], 0.5)


def test_scoring(spark):
    fnv = lambda s: f"cfg-{__import__('functools').reduce(lambda h, c: (h ^ c) * 0x100000001B3 % 2**64, s.encode(), 0xCBF29CE484222325) % 2**32:08x}"
    texts = ["", "a", '{"mesher":"é"}', "x" * 100]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scoring.config_id(F.col("t")).alias("id")).collect()
    assert all(r["id"] == fnv(r["t"]) for r in got)
    r = spark.range(1).select(
        scoring.accuracy(F.lit("ok"), F.lit(None).cast("double"), F.lit(-0.05)).alias("a"), scoring.relative_error(F.lit(-2.0), F.lit(0.0)).alias("z"), scoring.wall_limit(F.lit(5), F.lit(None).cast("double")).alias("w"), scoring.tendency(F.lit("cvt_poly"), F.lit(-1.0), F.lit(2))[0].alias("t"), scoring.tendency(F.lit("tet"), F.lit(0.9), F.lit(2))[1].alias("skin"), scoring.mesher(F.lit("zoo")).alias("zoo"), scoring.probe(F.lit("scf"), F.lit(2.0), {k: F.lit(3.0) for k in ("sigma_face_mean", "sigma_max", "sigma_p99", "strain_energy", "tip_deflection", "dominant_load_axis", "mean_u_component", "mean_ux", "mean_uz")}).alias("probe"),
        scoring.level_value(F.lit("true")).alias("b"), scoring.level_value(F.lit("1.5")).alias("f"), scoring.level_value(F.lit("x")).alias("s"), scoring.milliseconds(F.lit(1500.0)).alias("ms"), scoring.percent(F.lit(0.123)).alias("p"), experiments.sparkline(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("sp"),
        scoring.run_score(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(False)).alias("credit"), scoring.run_score(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(False), "zero").alias("zero"), scoring.over_budget(F.lit(7000.0), F.lit(1), F.lit(61000), F.lit(1.0), F.lit(2.0)).alias("o"), scoring.canonical_json(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))).alias("j"),
    ).first()
    assert (r["a"], r["z"], r["w"], r["t"], r["b"]["kind"], r["f"]["number"], r["s"]["kind"], r["ms"], r["p"], r["zero"], r["o"], r["j"]) == (0.5, 2.0, 2700.0, "cvt_poly", "bool", 1.5, "str", "1.50s", "12.3%", 0.0, "mesher", '{"a":"2","b":"1"}')
    assert math.isclose(r["credit"], 0.5) and r["sp"] == "▁▄█" and (r["skin"], r["zoo"], r["probe"]) == (3, "hybrid", 1.5)
    h = spark.range(1).select(hp.shape_vote(F.lit(0.9), F.lit(0.85), F.lit(0.1)).alias("keep"), hp.broadcast_signal(F.array().cast("array<double>"), F.lit(3), 2.0).alias("d"), hp.dof_factor(F.lit(0.5), F.lit(0.2), F.lit(0.0)).alias("f")).first()
    assert h["keep"] == "keep" and h["d"] == 2.0 and math.isclose(h["f"], 4.8)


def test_marking_edges(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(5)], "id long, eta double")
    assert ordered.dorfler_mark(df, "eta", 0.5, ["id"]).filter("marked").count() == 0
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(300)], "id long, eta double")
    marked = {r["id"] for r in ordered.dorfler_mark(df, "eta", 0.4, ["id"]).filter("marked").collect()}
    total, acc, want = sum((i % 7) ** 2 for i in range(300)), 0, set()
    for i in sorted(range(300), key=lambda i: (-(i % 7), i)):
        if acc >= 0.4 * total:
            break
        acc += (i % 7) ** 2
        want.add(i)
    assert marked == want
    with pytest.raises(ValueError):
        ordered.dorfler_mark(df, "eta", 0.0, ["id"])
    lengths = spark.createDataFrame([(i, i % 4) for i in range(200)], "k long, n long")
    off = ordered.unset_offsets(lengths, "k", "n")
    assert [r["length"] for r in ordered.offsets_to_lengths(off, "k", "offset").orderBy("k").collect()] == [i % 4 for i in range(200)]


def test_spatial(spark):
    r = np.random.default_rng(2)
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(r.uniform(0, 10, (80, 3)))], "pid long, x double, y double, z double")
    s = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(r.uniform(0, 3, (40, 3)))], "sid long, x double, y double, z double")
    P, S = (np.array([[q["x"], q["y"], q["z"]] for q in df.orderBy(df.columns[0]).collect()]) for df in (p, s))
    d = ((P[:, None] - S[None]) ** 2).sum(axis=2)
    got = {q["pid"]: q["sid"] for q in spatial.nearest(p, s, 0.5, saver(spark), most_rounds=3).collect()}
    assert got == {i: int(d[i].argmin()) for i in range(80)}
    assert spatial.within(p, s, 1.5).count() == int((d <= 2.25).sum())
    seg = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0), (1, 0.0, 5.0, 0.0, 5.0, 5.0, 0.0)], "sid long, ax double, ay double, az double, bx double, by double, bz double")
    near = spatial.nearest_segment(p, seg, 2.0, 4.0).collect()
    for q in near:
        x = P[q["pid"]]
        best = min((x[0] - min(max(x[0], 0), 5)) ** 2 + (x[1] - y) ** 2 + x[2] ** 2 for y in (0, 5))
        assert math.isclose(q["d2"], best, abs_tol=1e-9)
    balls = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0)], "sid long, x double, y double, z double")
    one = 4 / 3 * math.pi
    lens = math.pi * (2 - 1) ** 2 * (1 + 4) / 12
    assert math.isclose(spatial.packing_fill(balls, 1.0, 10.0).first()["fill"], (2 * one - lens) / 10)
    assert spatial.stamp(spark.createDataFrame([(0.5, 0.5, 0.5)], "x double, y double, z double"), 0.6, 1.0, (3, 3, 3)).count() == 1
    tri, v = cube(spark)
    flat = tri.select("tid", *[F.element_at("nodes", i + 1).alias(n) for i, n in enumerate("abc")])
    for n in "abc":
        flat = flat.join(v.toDF(n, f"{n}x", f"{n}y", f"{n}z"), n)
    assert lattice.classify(flat, (4, 4, 4), 0.3, spark).count() == 27  # centres 0.15, 0.45 and 0.75 in each axis


def test_relaxation(spark):
    s = spark.createDataFrame([(0, 0.1, 0.0, 0.0, False), (1, 0.2, 0.0, 0.0, False), (2, 1.0, 0.0, 0.0, True)], "sid long, x double, y double, z double, fixed boolean")
    grid = spark.range(101).select(F.col("id").alias("pid"), (F.col("id") / 100).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("w"))
    out = {r["sid"]: r["x"] for r in relax.lloyd(s, grid, 0.5, 1e-3, saver(spark), most=3).collect()}
    assert out[2] == 1.0 and out[0] < out[1] < 1.0
    apart = {r["sid"]: r["x"] for r in relax.bubble(s, 0.3, saver(spark), rounds=4).collect()}
    assert apart[1] - apart[0] > 0.1
    n = spark.createDataFrame([(0, 0.0, 0.0, 0.0, True), (1, 0.9, 0.0, 0.0, False), (2, 1.0, 0.0, 0.0, True)], "nid long, x double, y double, z double, fixed boolean")
    mid = {r["nid"]: r["x"] for r in relax.smooth(n, spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"), saver(spark), rounds=8).collect()}
    assert abs(mid[1] - 0.5) < 0.01


def test_campaign_resumes(spark, tmp_path):
    configs = campaign.expand(spark, {"a": ["1", "2", "3"], "b": ["x", "y"], "c": ["k", "k"]})
    assert configs.count() == 6
    parts = spark.createDataFrame([("p",), ("q",)], "part string")
    schema = "cfg string, part string, tier int, ok boolean, score double"
    run = lambda r: {"cfg": r["cfg"], "part": r["part"], "tier": r["tier"], "ok": True, "score": int(r["cfg"][-4:], 16) / 65536}
    path = str(tmp_path / "runs")
    first = campaign.run_campaign(spark, configs, parts, [0.5, 0.34], run, schema, path, stop=lambda: True)
    assert first.count() == 12
    full = campaign.run_campaign(spark, configs, parts, [0.5, 0.34], run, schema, path)
    assert full.count() == 12 + 6 and full.select("cfg", "part", "tier").distinct().count() == 18
    best = {r["cfg"] for r in full.filter("tier = 1").collect()}
    assert best == set(sorted((r["cfg"] for r in configs.collect()), key=lambda c: -int(c[-4:], 16))[:3])


def test_streaming_run_log(spark, tmp_path):
    (tmp_path / "log").mkdir()
    row = lambda c, p, s: json.dumps({"cfg_id": c, "part": p, "tier": 0, "status": s, "accuracy": {"score": 0.5}})
    (tmp_path / "log" / "1.jsonl").write_text(row("a", "p", "ok") + "\n" + row("a", "p", "ok") + "\n{broken\n")
    q = run_log.publish(run_log.live_ranking(run_log.stream_runs(spark, str(tmp_path / "log"))), "live", str(tmp_path / "cp"))
    try:
        q.processAllAvailable()
        (tmp_path / "log" / "2.jsonl").write_text(row("a", "q", "solve_fail") + "\n" + row("b", "p", "ok") + "\n")
        q.processAllAvailable()
        got = {r["cfg_id"]: (r["n_runs"], r["n_ok"], r["mean_score"]) for r in spark.sql("SELECT * FROM live").collect()}
    finally:
        q.stop()
    assert got == {"a": (2, 1, 0.25), "b": (1, 1, 0.5)}


def test_entry_without_subpackage():
    """The entry module works where the llm folders and the pipeline are deleted."""
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['tessera.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), [k for k in e.queries() if k.startswith('op') and k[2].isdigit()])"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert out.returncode == 0 and out.stdout.strip().endswith("[]"), out.stderr


def test_nearest_vectors_against_brute_force(spark):
    r = np.random.default_rng(4)
    e = r.normal(size=(300, 6))
    e[50], e[60] = e[7], e[7]  # copies: the least id wins
    rows = spark.createDataFrame([(i, [float(v) for v in e[i]]) for i in range(300)], "vec_id long, e array<double>")
    got = {x["vec_id"]: x["nearest"] for x in spatial.nearest_vectors(rows.filter("vec_id % 5 = 0"), rows, 16, 40).collect()}
    n = e / np.linalg.norm(e, axis=1, keepdims=True)
    d = np.floor((1 - n @ n.T) * 1e5 + 0.5)
    np.fill_diagonal(d, np.inf)
    assert got == {i: int(d[i].argmin()) for i in range(0, 300, 5)} and got[50] == 7


def test_embedding_nearest_all_crosses_labels(spark, tmp_path):
    from tessera import queries

    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.1], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [tuple(x) for x in queries.QUERIES["embedding_nearest_all"](spark, str(tmp_path)).collect()] == [(0, 2)]


def test_nearest_other_gap_of_far_sites(spark):
    at = [0.0, 1.0, 2.0, 1e6]
    sites = spark.createDataFrame([(i, x, 0.0, 0.0) for i, x in enumerate(at)], "sid long, x double, y double, z double")
    r = spatial.nearest_other_gap(sites, 1.0, saver(spark)).first()
    assert r["n"] == 4 and r["mean_gap"] == pytest.approx((1 + 1 + 1 + 1e6 - 2) / 4)


def test_hop_distance_all_runs_until_exhaustion(spark, tmp_path):
    from tessera import queries

    n = 4  # a path: customer i buys the parts i and i + 1
    spark.createDataFrame([(i, i) for i in range(1, n + 1)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(i, i + s) for i in range(1, n + 1) for s in (0, 1)], "l_orderkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["node"]: r["hops"] for r in queries.QUERIES["hop_distance_all"](spark, str(tmp_path)).collect()}
    assert got == {2 * i: 2 * (i - 1) for i in range(1, n + 1)} | {2 * i + 1: max(1, 2 * i - 3) for i in range(1, n + 2)}


def test_bisection_closure_reaches_the_end_of_a_long_chain(spark):
    n = 54  # triangles in a fan of growing edges: each one's longest edge is held by the next
    nodes = spark.createDataFrame([(i, 2.0**i, 0.0, 0.0) for i in range(n + 2)], "nid long, x double, y double, z double")
    elements = spark.createDataFrame([(i, [0, i + 1, i + 2] if i else [0, 1, 2]) for i in range(n)], "eid long, nodes array<long>")
    marked = spark.createDataFrame([(0,)], "eid long")
    got = topology.bisection_closure(elements, nodes, marked, [(0, 1), (1, 2), (0, 2)], saver(spark))
    assert got.count() == n


def test_unfinished_solve_is_an_error(spark):
    a = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 3.0)], "row long, col long, val double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, val double")
    with pytest.raises(ArithmeticError):
        fields.conjugate_gradient(a, b, saver(spark), most=1)
