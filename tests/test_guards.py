"""Taking back one by one, and smoothing that turns nothing, against sequential versions."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import surface
from tessera.plans import lattice
from tessera.plans.relax import wall_smooth
from tessera.session import saver


def volume(p):
    return np.dot(np.cross(p[1] - p[0], p[2] - p[0]), p[3] - p[0]) / 6


def box(spark, n=3):
    counts = (n, n, n)
    e = lattice.fill(lattice.cells(spark, counts), counts).select("eid", "nodes")
    return e, lattice.lattice_nodes(spark, counts, 1.0)


def test_taking_back_is_one_by_one(spark):
    save = saver(spark)
    e, nodes = box(spark, 2)
    tets = {r["eid"]: r["nodes"] for r in e.collect()}
    for seed in range(1, 2):
        r = random.Random(seed)
        state = {}
        for x in nodes.collect():
            old = np.array([x["x"], x["y"], x["z"]])
            step = np.array([r.uniform(-1.1, 1.1) for _ in range(3)]) if r.random() < 0.7 else np.zeros(3)
            if r.random() < 0.3:
                step = np.sign(step) * 0.8  # ties
            state[x["nid"]] = [old, old + step, float(np.linalg.norm(step).round(6))]
        rows = [(n, *map(float, old), *map(float, now), d) for n, (old, now, d) in state.items()]
        df = save(spark.createDataFrame(rows, "nid long, ox double, oy double, oz double, x double, y double, z double, moved double"))
        found, back = surface.take_back(df, surface.turned(e, 1e-9), e.select("eid", F.explode("nodes").alias("nid")), save)
        taken = 0
        while True:
            wrong = {n for ns in tets.values() if volume([state[n][1] for n in ns]) <= 1e-9 for n in ns if state[n][2] > 0}
            if not wrong:
                break
            worst = min(wrong, key=lambda n: (-state[n][2], n))
            state[worst][1:] = [state[worst][0], 0.0]
            taken += 1
        assert taken == back > 3
        assert {x["nid"]: (x["x"], x["y"], x["z"]) for x in found.collect()} == {n: tuple(now) for n, (_, now, _) in state.items()}


def test_smoothing_turns_nothing(spark):
    """Nodes pushed about inside a box, where plain smoothing turns elements; the guard is compared with a plain version of itself."""
    save = saver(spark)
    e, nodes = box(spark)
    r = np.random.default_rng(4)
    at = {x["nid"]: np.array([x["x"], x["y"], x["z"]]) for x in nodes.collect()}
    tets = [x["nodes"] for x in e.collect()]
    for n in at:  # as far as it goes without turning
        for _ in range(8):
            old, at[n] = at[n], at[n] + r.normal(0, 0.45, 3)
            if min(volume([at[m] for m in t]) for t in tets if n in t) <= 1e-3:
                at[n] = old
    fixed = {n: bool(n % 5 == 0) for n in at}
    pairs = sorted({tuple(sorted((a, b))) for t in tets for a in t for b in t if a < b})
    df = spark.createDataFrame([(n, *map(float, p), fixed[n]) for n, p in at.items()], "nid long, x double, y double, z double, fixed boolean")
    out, returned = wall_smooth(df, spark.createDataFrame(pairs, "a long, b long"), e, save, rounds=3, rate=1.0, most_step=0.6)
    beside = {n: [b for a, b in pairs + [p[::-1] for p in pairs] if a == n] for n in at}
    count = 0
    for _ in range(3):
        old, now = dict(at), {}
        for n in old:
            step = np.zeros(3) if fixed[n] else np.mean([old[m] for m in beside[n]], axis=0) - old[n]
            now[n] = old[n] + step * min(1.0, 0.6 / max(np.linalg.norm(step), 1e-300))
        while bad := {n for t in tets if volume([now[m] for m in t]) <= 0 for n in t if np.any(now[n] != old[n])}:
            count += len(bad)
            now |= {n: old[n] for n in bad}
        at = now
    assert returned == count > 0
    found = {x["nid"]: np.array([x["x"], x["y"], x["z"]]) for x in out.collect()}
    assert all(np.allclose(found[n], at[n], atol=1e-9) for n in at) and min(volume([found[m] for m in t]) for t in tets) > 0


def test_projected_smoothing(spark):
    """Wall nodes stay on their plane."""
    save = saver(spark)
    e, nodes = box(spark, 2)
    df = nodes.withColumn("x", F.when(F.col("z") == 2, F.col("x") + 0.1 * F.col("y")).otherwise(F.col("x"))).withColumn("fixed", F.col("z") < 2)
    pairs = e.select(F.explode("nodes").alias("a"), "nodes").select("a", F.explode("nodes").alias("b")).filter("a < b").distinct()
    out, _ = wall_smooth(df, pairs, e, save, rounds=2, project=lambda n: n.withColumn("z", F.lit(2.0)))
    assert {x["z"] for x in out.collect() if not x["fixed"]} == {2.0}
