"""Protecting balls against one sequential pass in the same order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.plans.protect import independent_balls, protecting_radii
from tessera.session import saver


def sequential(rows, apart):
    chosen = []
    for s in sorted(rows, key=lambda s: (-math.floor(math.log2(s["r"])), s["h"], s["sid"])):
        if all(math.dist((s["x"], s["y"], s["z"]), (t["x"], t["y"], t["z"])) >= apart * max(s["r"], t["r"]) for t in chosen):
            chosen.append(s)
    return {s["sid"] for s in chosen}


@pytest.mark.parametrize("kind", ["even", "crowded", "copies"])
def test_independent_balls(spark, kind):
    r = random.Random(1)
    spot = {"even": lambda: [r.uniform(-2, 2) for _ in range(3)], "crowded": lambda: [r.gauss(0, 0.05) for _ in range(3)], "copies": lambda: [float(r.randint(0, 2)) for _ in range(3)]}[kind]
    rows = [(i, *spot(), r.choice([0.03, 0.2, 0.25, 0.9])) for i in range(400)]
    rows += [(900, None, 0.0, 0.0, 1.0), (901, 0.0, 0.0, 0.0, 0.0), (902, 0.0, 0.0, 0.0, -1.0), (903, 0.0, 0.0, 0.0, None)]
    sites = spark.createDataFrame([(*x, "clash") for x in rows], "sid long, x double, y double, z double, r double, cell string")
    found = [x["sid"] for x in independent_balls(sites, saver(spark), 0.55).collect()]
    own = sites.filter("sid < 900").withColumn("h", F.xxhash64("sid")).collect()
    assert len(found) == len(set(found)) and set(found) == sequential(own, 0.55)


def test_no_balls(spark):
    empty = spark.createDataFrame([], "sid long, x double, y double, z double, r double")
    assert independent_balls(empty, saver(spark)).count() == 0


def test_radii(spark):
    """An L of two edges and a third one beside it, against a plain version."""
    h = 0.4
    lines = {1: [(k / 20, 0.0, 0.0) for k in range(21)], 2: [(0.0, k / 20, 0.0) for k in range(21)], 3: [(k / 20, 0.0, 0.3) for k in range(21)]}
    rows = [(e, n, *p) for e, ps in lines.items() for n, p in enumerate(ps)]
    found = {(x["edge"], x["x"], x["y"], x["z"]): x["r"] for x in protecting_radii(spark.createDataFrame(rows, "edge long, pos int, x double, y double, z double"), h, saver(spark)).collect()}
    ends = [p for ps in lines.values() for p in (ps[0], ps[-1])]
    for e, ps in lines.items():
        for p in ps:
            far = [math.dist(p, q) for o, qs in lines.items() if o != e for q in qs if all(math.dist(q, x) >= 1e-4 * h for x in (ps[0], ps[-1]))]
            r = min(0.45 * h, min(far) / 3)
            r = 0.5 * r if min(math.dist(p, q) for q in ends) < 2 * r else r
            assert found[e, *p] == pytest.approx(max(r, 1e-9 * h))
