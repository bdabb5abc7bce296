"""Queries and shared steps on small tables with crowded places, against the plain way."""

import random
from math import dist

import pytest
from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import ordered, spatial, surface, walks
from tessera.session import saver

LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"


def test_marking_queries_read_their_own_columns(spark, tmp_path):
    rows = [(i, 1, i, i, 1.0, float(p), 0.1, 0.1) for i, p in enumerate((10, 1, 3, 1))]
    spark.createDataFrame(rows, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert [x["l_orderkey"] for x in run("dorfler_mark")] == [0]
    assert [tuple(x) for x in run("mark_smooth")] == [(3, 5.0)]
    assert len(run("geometry_scalars")) == 4


def places_of(n, seed, copies=3):
    """Points in a crowd, far from it, and several in one place."""
    r = random.Random(seed)
    at = [tuple(r.uniform(0, 0.01) for _ in range(3)) for _ in range(n)] + [tuple(r.uniform(-5, 5) for _ in range(3)) for _ in range(n // 4)]
    return [(i, *p) for i, p in enumerate(at * copies)]


def joined_rows(df):
    """Rows that the joins of the plan put out, largest first, after a run."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if "Join" in node.nodeName():
            found.append((node.nodeName(), node.metrics().apply("numOutputRows").value()))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.fixture
def crowd(spark):
    p, s = places_of(120, 1), places_of(60, 2)
    return p, s, spark.createDataFrame(p, "pid long, x double, y double, z double"), spark.createDataFrame(s, "sid long, x double, y double, z double")


def test_nearest_in_crowds(spark, crowd, monkeypatch):
    p, s, dp, ds = crowd
    asked, settle = [], spatial._settle
    monkeypatch.setattr(spatial, "_settle", lambda todo, near, size, *a: asked.append((todo.count(), size)) or settle(todo, near, size, *a))
    got = {r["pid"]: (r["sid"], r["d2"]) for r in spatial.nearest(dp, ds, 4.0, saver(spark)).collect()}
    for pid, *at in p:
        d2, sid = min((dist(at, x[1:]) ** 2, x[0]) for x in s)
        assert got[pid][0] == sid and got[pid][1] == pytest.approx(d2)
    assert asked[0][0] == 150 and asked[0][1] < 0.1  # places, not points; cells as small as the crowd asks for
    none = spatial.nearest(dp.withColumn("x", F.when(F.col("pid") > 0, F.col("x"))), ds, 4.0, saver(spark))
    assert none.count() == len(p) - 1


def test_near_any_in_crowds(spark, crowd):
    p, s, dp, ds = crowd
    for radius in (0.002, 1.0):
        want = {x[0] for x in p if min(dist(x[1:], y[1:]) for y in s) <= radius}
        assert sorted(r["pid"] for r in spatial.near_any(dp, ds, radius).collect()) == sorted(want)


def test_within_cuts_crowded_cells(spark, crowd, monkeypatch):
    p, s, dp, ds = crowd
    monkeypatch.setattr(spatial, "CHUNK", 20)
    df = spatial.within(dp, ds, 0.5)
    want = sorted((x[0], y[0]) for x in p for y in s if dist(x[1:], y[1:]) <= 0.5)
    assert sorted((r["pid"], r["sid"]) for r in df.collect()) == want
    assert ("SortMergeJoin", len(want)) in joined_rows(df) and spark.conf.get("spark.sql.shuffle.partitions") == "4" and df.rdd.getNumPartitions() > 4
    few = spatial.within(dp.limit(5), ds, 0.5, ("y",), ("z",))
    assert few.columns == ["pid", "sid", "d2", "y", "z"] and few.count() == sum(x < 5 for x, _ in want)


def test_gaps_in_crowds(spark, crowd):
    p, _, dp, _ = crowd
    sites = dp.withColumnRenamed("pid", "sid")
    one = spatial.nearest_other_gap(sites, 4.0, saver(spark)).first()
    assert (one["mean_gap"], one["n"]) == (0.0, len(p))  # each place is taken three times
    single = [x for x in p if x[0] < 150]
    one = spatial.nearest_other_gap(sites.filter("sid < 150"), 4.0, saver(spark)).first()
    want = sum(min(dist(x[1:], y[1:]) for y in single if y[0] != x[0]) for x in single) / 150
    assert one["mean_gap"] == pytest.approx(want) and one["n"] == 150
    edges = sites.withColumn("edge", F.col("sid") % 4)
    got = {r["pid"]: r["gap"] for r in spatial.other_edges_gap(edges, 0.5).collect()}
    for x in p:
        gap = min(dist(x[1:], y[1:]) for y in p if y[0] % 4 != x[0] % 4)
        assert got.get(x[0]) == (pytest.approx(gap) if gap <= 0.5 else None)


def test_packing_ends_once_lenses_outweigh_balls(spark, crowd, monkeypatch):
    p, _, dp, _ = crowd
    rounds, plain = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a: rounds.append(1) or plain(*a))
    sites = dp.withColumnRenamed("pid", "sid")
    assert spatial.packing_fill(sites, 0.02, 1.0).first()["fill"] == 0.0 and len(rounds) < 5
    thin = [x for x in p if x[0] % 150 >= 120]
    ball = 4 / 3 * 3.141592653589793 * 0.3**3
    lens = sum(3.141592653589793 * (0.6 - d) ** 2 * (d * d + 1.2 * d) / (12 * d) for x in thin for y in thin if x[0] < y[0] and 0 < (d := dist(x[1:], y[1:])) <= 0.6)
    assert spatial.packing_fill(sites.filter("sid % 150 >= 120"), 0.3, 1000.0).first()["fill"] == pytest.approx((len(thin) * ball - lens) / 1000.0)


def test_best_alignment_in_crowds(spark, crowd):
    p, s, dp, ds = crowd
    turn = lambda i: [f.alias(n) for n, f in zip(("nx", "ny", "nz"), (F.sin(i) * F.cos(2 * F.col(i)), F.sin(i) * F.sin(2 * F.col(i)), F.cos(i)), strict=True)]
    a, b = dp.select("*", *turn("pid")), ds.select("*", *turn("sid"))
    rows, others = a.collect(), b.collect()
    got = {r["pid"]: r["best"] for r in spatial.best_alignment(a, b, 0.02).collect()}
    for x in rows:
        dots = [abs(sum(x[n] * y[n] for n in ("nx", "ny", "nz"))) for y in others if dist(x[1:4], y[1:4]) <= 0.02]
        assert got.get(x["pid"]) == (pytest.approx(max(dots), abs=1e-12) if dots and max(dots) >= 0.866 else None)


def test_min_plus_on_a_line(spark):
    r = random.Random(4)
    p, s = [(i, r.uniform(0, 9)) for i in range(60)] + [(60, None), (61, 500.0)], [(r.uniform(0, 9), r.uniform(1, 4)) for _ in range(40)]
    out = spatial.min_plus(spark.createDataFrame(p, "pid long, x double"), spark.createDataFrame(s * 3, "x double, h double"), 0.5, 1.0, 20.0, ["x"])
    got = {x["pid"]: x["size"] for x in out.collect()}
    assert got == {i: 20.0 if x is None else pytest.approx(max(1.0, min(20.0, min(h + 0.5 * abs(x - a) for a, h in s)))) for i, x in p}
    assert not any("Hash" in n or "Nested" in n for n, _ in joined_rows(out)) and max(n for _, n in joined_rows(out)) == len(p)  # no row for each pair


def test_surface_edges_and_rays_of_equal_things(spark, crowd):
    p, s, dp, _ = crowd
    save = saver(spark)
    tri = "tid long, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz")
    t = spark.createDataFrame([(i, x, y, z, x + 0.02, y, z, x, y + 0.02, z) for i, x, y, z in s], tri)
    found = surface.closest_on_surface(dp, t, 4.0, save).select("pid", "tid", "d2")
    plain = dp.withColumnsRenamed({c: f"p{c}" for c in "xyz"}).crossJoin(t).select("pid", "tid", surface.closest_on_triangle(*[surface.vec(n) for n in "pabc"])["d2"].alias("d2")).groupBy("pid").agg(F.min(F.struct("d2", "tid")).alias("m"))
    assert sorted(found.collect()) == sorted(plain.select("pid", "m.tid", "m.d2").collect())
    e = t.select(F.col("tid").alias("sid"), *[f"{n}{c}" for n in "ab" for c in "xyz"])
    found = walks.closest_edge(dp, e, 4.0, save)
    plain = dp.withColumnsRenamed({c: f"p{c}" for c in "xyz"}).crossJoin(e).withColumn("d2", walks.segment_distance2(*[walks.vec(n) for n in "pab"])).groupBy("pid").agg(F.min(F.struct("d2", "sid")).alias("m"))
    assert sorted(found.collect()) == sorted(plain.select("pid", "m.sid", "m.d2").collect())
    rays = dp.select(F.col("pid").alias("rid"), *[(F.col(c) - v).alias(f"o{c}") for c, v in (("x", 0.0), ("y", 0.0), ("z", 0.05))], *[F.lit(v).alias(f"d{c}") for c, v in (("x", 0.0), ("y", 0.0), ("z", 1.0))])
    got = {r["rid"]: r["t"] for r in walks.ray_hits(rays, t, 4.0, 9.0, save).collect()}
    hit = walks.ray_triangle(*[walks.vec(n) for n in "odabc"])
    want = rays.crossJoin(t).withColumn("t", hit).filter("t > 0 AND t <= 9").groupBy("rid").agg(F.min("t").alias("t"))
    assert got == {r["rid"]: r["t"] for r in want.collect()} and got


def test_cut_deals_rows_once(spark, monkeypatch):
    r = random.Random(5)
    df = spark.createDataFrame([(i % 5, i, r.random(), float(r.randint(1, 9))) for i in range(100)], "p long, id long, lead double, area double")
    out = {}
    for one_task in (10**9, 5):
        monkeypatch.setattr(ordered, "ONE_TASK", one_task)
        out[one_task] = sorted(x["id"] for x in ordered.cut_nearest(df, ["p"], "lead", ["id"], "area", F.lit(40.0)).collect())
    assert out[5] == out[10**9] and 0 < len(out[5]) < 100
