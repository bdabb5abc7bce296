"""The ways beyond size limits, against the plain ones: blocks for every type, cuts in blocks, boxes by grids."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordered, spatial


def lead_of(kind, n):
    day = datetime.date(2020, 1, 1) + datetime.timedelta(days=n)
    return {"string": ["", "a", "é", "zz", f"w{n}", "heavy", "heavy", "heavy"][n % 8], "date": day if n % 4 else datetime.date(2021, 5, 5), "timestamp": datetime.datetime(2020, 1, 1, n % 24, n % 60) if n % 3 else datetime.datetime(2022, 1, 1), "double": float("nan") if n % 9 == 0 else float(n % 23), "boolean": n % 2 == 0, "decimal(9,2)": n % 13}[kind]


@pytest.mark.parametrize("kind", ["string", "date", "timestamp", "double", "boolean", "decimal(9,2)"])
def test_blocks_of_every_type(spark, monkeypatch, kind):
    rows = [(i, None if i % 17 == 0 else "p" if i % 3 else "q", None if i % 29 == 0 else lead_of(kind, i), f"t{i % 50}", i % 7) for i in range(400)]
    if kind.startswith("decimal"):
        df = spark.createDataFrame([(*r[:2], None if r[2] is None else float(r[2]), *r[3:]) for r in rows], "id long, part string, lead double, tie string, v long").withColumn("lead", F.col("lead").cast(kind))
    else:
        df = spark.createDataFrame(rows, f"id long, part string, lead {kind}, tie string, v long")
    for descending in (False, True):
        for part in (None, ["part"]):
            out = []
            for one_task in (10**9, 5):
                monkeypatch.setattr(ordered, "ONE_TASK", one_task)
                out.append({x["id"]: x["r"] for x in ordered.running(df, F.col("v"), "r", "lead", ["tie", "id"], "sum", descending, True, part).collect()})
            assert out[0] == out[1]
    monkeypatch.setattr(ordered, "ONE_TASK", 5)
    ranks = {x["id"]: x["k"] for x in ordered.ranked(df, "lead", ["tie", "id"], "k", descending=False).collect()}
    assert sorted(ranks.values()) == list(range(1, 401))


@pytest.mark.parametrize("one_task", [10**9, 5])
def test_cut_of_one_part_with_all_rows(spark, monkeypatch, one_task):
    monkeypatch.setattr(ordered, "ONE_TASK", one_task)
    r = random.Random(2)
    rows = [("hot" if i % 10 else None, float(r.randint(0, 40)), i, float(r.randint(0, 5))) for i in range(300)] + [("tiny", 1.0, 1000, 5.0)]
    target = {"hot": 200.0, None: 30.0, "tiny": 5.0}
    df = spark.createDataFrame([(*x, target[x[0]], "clash") for x in rows], "p string, lead double, id long, area double, target double, rank string")
    found = {(x["p"], x["id"]) for x in ordered.cut_nearest(df, ["p"], "lead", ["id"], "area", F.col("target")).collect()}
    want = set()
    for p, t in target.items():
        own, acc, best = sorted((x for x in rows if x[0] == p), key=lambda x: (-x[1], x[2])), 0.0, (math.inf, 0)
        for n, x in enumerate(own):
            acc += x[3]
            best = min(best, (abs(acc - t), n))
        keep = own if acc <= 1.05 * t else own[: best[1] + 1]
        want |= {(p, x[2]) for x in keep}
    assert found == want


def test_many_boxes(spark, monkeypatch):
    """Boxes from points to half-spaces, beside and around all points, empty and inverted ones."""
    r = random.Random(3)
    points = [(i, r.uniform(-3, 5), r.choice([0.0, 1.0, r.gauss(0, 1)]), 7.0) for i in range(300)] + [(900, None, 0.0, 7.0), (901, float("nan"), 0.0, 7.0), (902, float("inf"), 0.0, 7.0)]
    boxes = []
    for n in range(150):
        w = [10 ** r.uniform(-4, 1.5) for _ in range(3)]
        c = [r.uniform(-4, 6), r.uniform(-3, 3), 7.0]
        boxes.append((n, *(v for c_, w_ in zip(c, w, strict=True) for v in (c_ - w_ / 2, c_ + w_ / 2))))
    boxes += [(200 + i, points[i][1], points[i][1], points[i][2], points[i][2], 7.0, 7.0) for i in range(5)]
    boxes += [(300, -1e12, 1e12, -1e12, 1e12, -1e12, 1e12), (301, float("-inf"), 0.0, float("-inf"), float("inf"), 0.0, 9.0), (302, 1.0, -1.0, -9.0, 9.0, 0.0, 9.0), (303, 50.0, 60.0, -9.0, 9.0, 0.0, 9.0), (304, None, 1.0, 0.0, 1.0, 0.0, 9.0)]
    p = spark.createDataFrame(points, "pid long, x double, y double, z double")
    b = spark.createDataFrame(boxes, "box long, lo_x double, hi_x double, lo_y double, hi_y double, lo_z double, hi_z double")
    want = {(q[0], o[0]) for q in points for o in boxes if None not in q and None not in o and all(o[1 + 2 * k] <= q[1 + k] <= o[2 + 2 * k] for k in range(3))}
    for few, grids in ((64, 256), (64, 2), (10**6, 256)):
        monkeypatch.setattr(spatial, "FEW_BOXES", few)
        monkeypatch.setattr(spatial, "_GRIDS", grids)
        found = [(x["pid"], x["box"]) for x in spatial.box_select(p, b, ["x", "y", "z"]).collect()]
        assert len(found) == len(set(found)) and set(found) == want
    assert spatial.box_select(p.limit(0), b, ["x", "y", "z"]).count() == 0


@pytest.mark.parametrize("one_task", [10**9, 5])
def test_nearest_in_one_part_with_all_rows(spark, monkeypatch, one_task):
    monkeypatch.setattr(ordered, "ONE_TASK", one_task)
    r = random.Random(4)
    sites = [("hot", float(r.randint(0, 60)), i) for i in range(120)] + [("cold", 3.0, 500)]
    points = [("hot", r.choice([float(r.randint(-5, 70)), r.uniform(0, 60)]), i) for i in range(200)] + [("cold", 1.0, 900), ("none", 1.0, 901)]
    s, p = spark.createDataFrame(sites, "k string, v double, sid long"), spark.createDataFrame(points, "k string, v double, pid long")
    got = {x["pid"]: (x["dist"], x["sid"]) for x in spatial.nearest_1d(p, s, ["k"]).collect()}
    want = {pid: min(((abs(v - w), sid) for q, w, sid in sites if q == k), default=(None, None)) for k, v, pid in points}
    assert got == want


def test_near_any_by_brute_force(spark):
    r = random.Random(5)
    make = lambda n, top: [(i, *(r.uniform(0, top) for _ in range(3))) for i in range(n)]
    points, sites = make(150, 10), make(60, 4) + [(900, None, 1.0, 1.0)]
    p, s = spark.createDataFrame(points, "pid long, x double, y double, z double"), spark.createDataFrame(sites, "sid long, x double, y double, z double")
    want = {a[0] for a in points for b in sites if None not in b and sum((u - v) ** 2 for u, v in zip(a[1:], b[1:], strict=True)) <= 0.8}
    got = [x["pid"] for x in spatial.near_any(p, s, 0.8**0.5).collect()]
    assert len(got) == len(set(got)) and set(got) == want
