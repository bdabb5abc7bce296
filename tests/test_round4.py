"""Steps for very many pairs: the plain results, without the plans that made them slow or large."""

import random
from math import dist

import pytest
from pyspark.sql import functions as F

from tessera.operators import spatial, surface, walks
from tessera.plans import protect
from tessera.session import saver


def watched(spark):
    """A saver, and the optimized plans of all that it has written."""
    save, plans = saver(spark), []
    return lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(df), plans


def corners(n, seed):
    r = random.Random(seed)
    at = [[r.uniform(-1, 1) for _ in range(3)] for _ in range(n)]
    return [(i, x, y, z, x + 0.5, y, z + r.uniform(-0.1, 0.1), x, y + 0.5, z) for i, (x, y, z) in enumerate(at)]


TRI = "tid long, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz")


def test_ray_pairs_are_tested_in_steps(spark):
    """The test of a pair is no condition of the join, where what is used twice is worked out again."""
    r = random.Random(3)
    t = spark.createDataFrame([*corners(60, 1), (99, *[0.5] * 9)], TRI)
    rays = spark.createDataFrame([(i, *[r.uniform(-1, 1) for _ in range(3)], 2 / 3, 1 / 3, 2 / 3) for i in range(200)], "rid long, " + ", ".join(f"{n}{c} double" for n in "od" for c in "xyz"))
    save, plans = watched(spark)
    got = {x["rid"]: x["t"] for x in walks.ray_hits(rays, t, 0.5, 2.0, save).collect()}
    want = rays.crossJoin(t).withColumn("t", walks.ray_triangle(*[walks.vec(n) for n in "odabc"])).filter("t > 0 AND t <= 2").groupBy("rid").agg(F.min("t").alias("t"))
    assert got == {x["rid"]: x["t"] for x in want.collect()} and got
    assert not [x for plan in plans for x in plan.splitlines() if "Join" in x and " / " in x]


@pytest.mark.parametrize("near", [128, 12])
def test_voronoi_cells_are_cut_block_by_block(spark, monkeypatch, near):
    """No site is joined to those around it row by row; small blocks, small shares and few first others change nothing."""
    from .test_voronoi import HI, LO, V, brute, clouds, frame

    from tessera.operators import voronoi

    for name, value in (("BLOCK", 2), ("CHUNK", 16), ("NEAR", near)):
        monkeypatch.setattr(voronoi, name, value)
    sites = clouds()["even"][:80] + clouds()["knot"][:30]
    save, plans = watched(spark)
    found = {x["sid"]: x for x in voronoi.voronoi_cells(frame(spark, sites), LO, HI, 0.5, save).collect()}
    assert sorted(found) == list(range(len(sites))) and not [p for p in plans[:4] if "collect_list" in p]
    for n, x in found.items():
        faces = brute(sites, n)
        volume, _, centre = V.mass_and_centroid(faces)
        assert abs(x["volume"] - volume) < 1e-9
        if volume > 1e-9:
            assert [x["cx"], x["cy"], x["cz"]] == pytest.approx(centre.tolist(), abs=1e-7)
            assert {f["owner"] for f in x["faces"]} == {o for o, _ in faces}


def test_distances_alone_need_no_sort_of_pairs(spark):
    """Flat triangles, points on and off them: the distances of the whole search."""
    r = random.Random(5)
    t = spark.createDataFrame([*corners(40, 2), (98, *[0.5] * 9), (99, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 1.0, 0.0, 0.0)], TRI)
    p = spark.createDataFrame([(i, *[r.uniform(-2, 2) for _ in range(3)]) for i in range(60)] + [(60, 0.5, 0.5, 0.5)], "pid long, x double, y double, z double")
    want = p.withColumnsRenamed({c: f"p{c}" for c in "xyz"}).crossJoin(t).groupBy("pid").agg(F.min(surface.closest_on_triangle(*[surface.vec(n) for n in "pabc"])["d2"]).alias("d2"))
    got = surface.closest_on_surface(p, t, 1.0, saver(spark), only_distance=True)
    assert got.columns == ["pid", "d2"] and sorted(got.collect()) == sorted(want.collect())


def test_choosing_balls_broadcasts_nothing(spark):
    """Chosen balls are spread over 27 cells each, which the estimate that allows a broadcast does not see."""
    r = random.Random(6)
    sites = spark.createDataFrame([(i, r.random(), r.random(), 0.0, 0.2) for i in range(25)], "sid long, x double, y double, z double, r double")
    plain, plans = saver(spark), []
    save = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df)
    rows = sites.collect()
    kept = {x["sid"] for x in protect.independent_balls(sites, save).collect()}
    assert kept and all(dist(a[1:4], b[1:4]) >= protect.APART * 0.2 for a in rows for b in rows if a["sid"] in kept and b["sid"] in kept and a != b)
    assert all(any(dist(a[1:4], b[1:4]) < protect.APART * 0.2 for b in rows if b["sid"] in kept) for a in rows)
    assert not [p for p in plans if "Broadcast" in p]
