"""Distances to triangulated surfaces, what is measured with them, and selections on boundaries.

A surface is a table of triangles: tid, ax.., bx.., cx...  A triangle lies in the
grid cells of its bounding box, a point searches the cells around its own, and the
pairs are refined by exact distance.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import closest_on_triangle, tet_aspect, tet_volume, triangle_area, triangle_distance2_steps, triangle_normal, vec
from . import ordered
from .ordered import cut_nearest, largest_gap
from .spatial import _settle, box_select, cell, fitted, places, spread, told

#: Weights of the curved-mesh scorecard.
WEIGHTS = {"m1": 0.12, "m2": 0.30, "m3": 0.12, "m4": 0.28, "m5": 0.10, "m6": 0.08}


def triangles_of(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """tid, ax.., bx.., cx.. from triangles (tid, nodes of three) and vertices (vid, x, y, z)."""
    out = faces.select("tid", *[F.element_at("nodes", i + 1).alias(n) for i, n in enumerate("abc")])
    for n in "abc":
        out = out.join(vertices.select(F.col("vid").alias(n), *[F.col(c).alias(f"{n}{c}") for c in "xyz"]), n)
    return out.drop("a", "b", "c")


def closest_on_surface(points: DataFrame, triangles: DataFrame, size: float, save, most_rounds: int = 12, only_distance: bool = False) -> DataFrame:
    """(pid, tid, d2, x, y, z): each point's nearest point on the surface, the least tid on ties; exact.  Without a triangle there is no row.

    With ``only_distance`` it is (pid, d2): the least of a number needs no sort of all
    pairs, as that of a row does, and pairs are measured in steps.

    ``size`` is where the search begins at most; it begins with less where triangles
    are dense.  Points in one place are one search, equal triangles one triangle.
    """
    corners = [f"{n}{c}" for n in "abc" for c in "xyz"]
    triangles = save(triangles.groupBy(*corners).agg(F.min("tid").alias("tid")).select("tid", *corners).dropna(subset=corners))
    n_t = triangles.count()
    steps, d2 = triangle_distance2_steps()

    def boxed(size: float, by: float = 0.0) -> DataFrame:
        """Triangles in the cells of their box, widened by ``by``."""
        t = triangles
        for n, c in zip("ijk", "xyz", strict=True):
            low, high = F.least(f"a{c}", f"b{c}", f"c{c}") - by, F.greatest(f"a{c}", f"b{c}", f"c{c}") + by
            t = t.withColumn(n, F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))))
        return t.withColumn("cell", F.struct("i", "j", "k")).drop("i", "j", "k")

    def near(todo: DataFrame, size: float) -> DataFrame:
        many = todo.count() > n_t  # what there is less of is spread
        p = todo.select("pid", *[F.col(c).alias(f"p{c}") for c in "xyz"])
        p = p.withColumn("cell", cell(vec("p"), size) if many else F.explode(spread(cell(vec("p"), size), 1)))
        pairs = p.hint("merge").join(boxed(size, size * (1 + 1e-9) if many else 0.0), "cell")
        if only_distance:
            for step in steps:
                pairs = pairs.withColumns(step)
            return pairs.groupBy("pid").agg(F.min(d2).alias("d2"))
        hit = pairs.select("pid", "tid", closest_on_triangle(vec("p"), vec("a"), vec("b"), vec("c")).alias("q"))
        best = hit.groupBy("pid").agg(F.min(F.struct(F.col("q.d2").alias("d2"), "tid", "q")).alias("m"))
        return best.select("pid", "m.tid", "m.d2", "m.q.x", "m.q.y", "m.q.z")

    if not n_t:
        return near(points.limit(0), size)
    spots = places(points, save)
    found = _settle(spots, near, fitted(size, boxed, entries=24.0 * n_t), save, most_rounds)
    return told(points, spots, found).select("pid", *(["d2"] if only_distance else ["tid", "d2", "x", "y", "z"]))


def conformity(found: DataFrame, within: float = 1e-6) -> DataFrame:
    """One row from distances (d2): largest, mean, how many, how many lie on the surface."""
    d = F.sqrt("d2")
    return found.agg(F.max(d).alias("max_distance"), F.avg(d).alias("mean_distance"), F.count("*").alias("n"), F.count_if(d <= within).alias("n_on"))


def region_of_nodes(nodes: DataFrame, triangles: DataFrame, regions: DataFrame, h: float, save) -> DataFrame:
    """(nid, region): a boundary node takes the region of its nearest triangle if that lies within 1.5 h.  regions: tid, region."""
    points = nodes.select(F.col("nid").alias("pid"), "x", "y", "z")
    found = closest_on_surface(points, triangles, h, save).filter(F.col("d2") <= (1.5 * h) ** 2)
    return found.join(regions, "tid").select(F.col("pid").alias("nid"), "region")


def project_sites(sites: DataFrame, triangles: DataFrame, sharp: DataFrame, band: float, guard: float, size: float, save) -> tuple[DataFrame, DataFrame]:
    """(sites with those free ones within ``band`` moved onto the surface; one row of the moved distances' mean and maximum).

    sites: sid, x, y, z, fixed.  Sites within ``guard`` of a point of ``sharp`` (sid, x, y, z) stay.
    """
    from .spatial import near_any

    free = sites.filter(~F.col("fixed")).select(F.col("sid").alias("pid"), "x", "y", "z")
    free = free.join(near_any(free, sharp, guard).select("pid"), "pid", "left_anti")
    moved = save(closest_on_surface(free, triangles, size, save).filter(F.col("d2") <= band * band))
    to = moved.select(F.col("pid").alias("sid"), *[F.col(c).alias(f"to_{c}") for c in "xyz"])
    out = sites.join(to, "sid", "left").select("sid", *[F.coalesce(f"to_{c}", c).alias(c) for c in "xyz"], "fixed")
    return out, moved.agg(F.count("*").alias("n_moved"), F.avg(F.sqrt("d2")).alias("mean_residual"), F.max(F.sqrt("d2")).alias("max_residual"))


def turned(elements: DataFrame, least: float = 0.0):
    """offenders(nodes) -> (eid, nid): the nodes of tetrahedra (eid, nodes) whose volume is ``least`` or less."""

    def offenders(nodes: DataFrame) -> DataFrame:
        at = elements.select("eid", F.posexplode("nodes").alias("n", "nid")).join(nodes.select("nid", F.struct("x", "y", "z").alias("p")), "nid")
        corner = at.groupBy("eid").agg(*[F.max(F.when(F.col("n") == k, F.col("p"))).alias(f"p{k}") for k in range(4)], F.collect_list("nid").alias("own"))
        wrong = corner.filter(tet_volume(*[vec(f"p{k}.") for k in range(4)]) <= least)
        return wrong.select("eid", F.explode("own").alias("nid"))

    return offenders


def _next_back(key: DataFrame, wrong: DataFrame, together: DataFrame, save) -> DataFrame:
    """The nodes at fault (``wrong``: nid) that no larger one can come before.  key: nid, key; together: eid, nid.

    Between a node at fault and its turn, only larger nodes are taken back, and they
    can put larger ones at fault that share an element with them.  So a node must wait
    for a larger one at fault that reaches it by way of larger nodes.  ``top`` is the
    best such way to a node, measured by its smallest node; it spreads until it is
    stable.
    """
    fault = wrong.select("nid").distinct().withColumn("fault", F.lit(True))
    state = save(key.join(fault, "nid", "left").select("nid", "key", F.coalesce("fault", F.lit(False)).alias("fault"), F.when(F.col("fault"), F.col("key")).alias("top")))
    while True:
        near = together.join(state.filter("top IS NOT NULL").select("nid", "top"), "nid").groupBy("eid").agg(F.max("top").alias("top"))
        best = together.join(near, "eid").groupBy("nid").agg(F.max("top").alias("best"))
        way = F.when(F.col("fault"), F.col("key")).when(F.col("best").isNotNull(), F.least("key", "best"))
        spread_ = save(state.join(best, "nid", "left").select("nid", "key", "fault", way.alias("top"), "best", F.col("top").alias("was")))
        if spread_.filter("NOT (top <=> was)").isEmpty():
            return spread_.filter(F.col("fault") & (F.col("best") == F.col("key"))).select("nid")
        state = spread_.select("nid", "key", "fault", "top")


def take_back(state: DataFrame, offenders, together: DataFrame, save) -> tuple[DataFrame, int]:
    """Takes moves back until nothing offends that taking back could mend: (state, how many).

    state: nid, x, y, z, where it came from (ox, oy, oz) and how far it moved.
    ``offenders(nodes)`` returns the nodes (nid) at fault; whether an element is at
    fault depends on its own nodes alone, and ``together`` (eid, nid) names those.
    The result is that of taking back one node at a time, always the one that moved
    furthest of all at fault (the least nid on ties).  Nodes that can't come in each
    other's way are taken back in one round.
    """
    together, back = save(together.select("eid", "nid").distinct()), 0
    while True:
        key = state.filter("moved > 0").select("nid", F.struct("moved", (-F.col("nid")).alias("least")).alias("key"))
        wrong = save(offenders(state.select("nid", "x", "y", "z")).select("nid").distinct().join(key.select("nid"), "nid"))
        if wrong.isEmpty():
            return state, back
        undo = save(_next_back(key, wrong, together.join(key.select("nid"), "nid", "left_semi"), save))
        back += undo.count()
        state = save(state.join(undo.withColumn("undo", F.lit(True)), "nid", "left").select("nid", "ox", "oy", "oz", *[F.when(F.col("undo"), F.col(f"o{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"], F.when(F.col("undo"), 0.0).otherwise(F.col("moved")).alias("moved")))


def snap(nodes: DataFrame, triangles: DataFrame, h: float, offenders, together: DataFrame, save, most: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Moves boundary nodes (nid, x, y, z) onto the surface, at most ``most`` h, and takes back what offends (``take_back``).

    Returns (nodes, one row: moved, taken back).
    """
    found = closest_on_surface(nodes.select(F.col("nid").alias("pid"), "x", "y", "z"), triangles, h, save).filter((F.col("d2") > 0) & (F.col("d2") <= (2.5 * h) ** 2))
    d = F.sqrt("d2")
    step = F.least(F.lit(1.0), F.lit(most * h) / d)
    state = nodes.join(found.select(F.col("pid").alias("nid"), d.alias("d"), step.alias("t"), *[F.col(c).alias(f"q{c}") for c in "xyz"]), "nid", "left")
    state = save(state.select("nid", *[F.col(c).alias(f"o{c}") for c in "xyz"], *[F.coalesce(F.col(c) + F.col("t") * (F.col(f"q{c}") - F.col(c)), F.col(c)).alias(c) for c in "xyz"], F.coalesce(F.least(F.col("d"), F.lit(most * h)), F.lit(0.0)).alias("moved")))
    total = state.filter("moved > 0").count()
    state, back = take_back(state, offenders, together, save)
    counts = nodes.sparkSession.createDataFrame([(total, back)], "n_moved long, n_taken_back long")
    return state.select("nid", "x", "y", "z"), counts


def skin_samples(skin: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pid, x, y, z): the middles of all sides and the centroid of each skin face (eid, local, nodes of three or four)."""
    n = F.size("nodes")
    ring = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("i"), F.element_at("nodes", i).alias("p"), F.element_at("nodes", i % n + 1).alias("q")))
    e = skin.select("eid", "local", F.explode(ring).alias("e")).select("eid", "local", "e.*")
    for k in "pq":
        e = e.join(nodes.select(F.col("nid").alias(k), *[F.col(c).alias(f"{k}{c}") for c in "xyz"]), k)
    middle = e.filter("p <> q").select(F.xxhash64("eid", "local", "i").alias("pid"), *[((F.col(f"p{c}") + F.col(f"q{c}")) / 2).alias(c) for c in "xyz"])
    centre = e.groupBy("eid", "local").agg(*[F.avg(f"p{c}").alias(c) for c in "xyz"]).select(F.xxhash64("eid", "local", F.lit(0)).alias("pid"), "x", "y", "z")
    return middle.unionByName(centre)


def curved_scorecard(skin: DataFrame, nodes: DataFrame, triangles: DataFrame, h: float, save, volumes: tuple[float, float] | None = None, circle: dict | None = None, tets: DataFrame | None = None) -> DataFrame:
    """One row: m1 to m6 and their weighted score over those that are known (weights renormalised).

    m1: largest distance of boundary nodes to the surface; m2: that of side middles
    and centroids of skin faces; m3: relative error of (mesh, reference) volumes; m4
    and m5: radial error and largest azimuth gap of the nodes on a ``circle`` (axis
    0..2, origin, radius, band); m6: least aspect of tets (eid, nodes) that touch the
    boundary.  Distances count against h, the gap against half a turn.
    """
    spark = nodes.sparkSession
    on = nodes.join(skin.select(F.explode("nodes").alias("nid")).distinct(), "nid", "left_semi")
    far = lambda points, name: closest_on_surface(points, triangles, h, save).agg(F.max(F.sqrt("d2")).alias(name))
    row = far(on.select(F.col("nid").alias("pid"), "x", "y", "z"), "m1").crossJoin(far(save(skin_samples(skin, nodes)), "m2"))  # single rows, here and below
    m3 = abs(volumes[0] - volumes[1]) / volumes[1] if volumes and volumes[0] > 0 and volumes[1] > 0 else None
    row = row.withColumn("m3", F.lit(m3).cast("double"))
    if circle:
        u, v = "xyz"[(circle["axis"] + 1) % 3], "xyz"[(circle["axis"] + 2) % 3]
        du, dv = F.col(u) - circle["origin"][(circle["axis"] + 1) % 3], F.col(v) - circle["origin"][(circle["axis"] + 2) % 3]
        off = F.abs(F.sqrt(du * du + dv * dv) - circle["radius"])
        ring = save(on.select(off.alias("off"), F.atan2(dv, du).alias("angle"), F.lit(0).alias("one")).filter(F.col("off") <= circle.get("band", 0.75 * h)))
        gap = largest_gap(ring, ["one"], "angle", 2 * pi).agg(F.max("max_gap").alias("gap"))
        row = row.crossJoin(ring.agg(F.coalesce(F.max("off") / circle["radius"], F.lit(1.0)).alias("m4"))).crossJoin(gap.select(F.coalesce("gap", F.lit(2 * pi)).alias("m5")))
    else:
        row = row.withColumns({"m4": F.lit(None).cast("double"), "m5": F.lit(None).cast("double")})
    if tets is not None:
        touching = tets.join(tets.select("eid", F.explode("nodes").alias("nid")).join(on.select("nid"), "nid", "left_semi").select("eid").distinct(), "eid", "left_semi")
        for i in range(4):
            touching = touching.withColumn("nid", F.element_at("nodes", i + 1)).join(nodes.select("nid", *[F.col(c).alias(f"n{i}{c}") for c in "xyz"]), "nid").drop("nid")
        corners = [vec(f"n{i}") for i in range(4)]
        aspect = F.greatest(tet_aspect(*corners), tet_aspect(corners[1], corners[0], *corners[2:]))  # of either orientation
        row = row.crossJoin(touching.agg(F.min(aspect).alias("m6")))
    else:
        row = row.withColumn("m6", F.lit(None).cast("double"))
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    good = {"m1": 1 - unit(F.col("m1") / h), "m2": 1 - unit(F.col("m2") / h), "m3": 1 - unit(F.col("m3")), "m4": 1 - unit(F.col("m4")), "m5": 1 - unit(F.col("m5") / pi), "m6": unit(F.col("m6"))}
    known = {k: F.col(k).isNotNull() for k in WEIGHTS}
    num = sum((F.when(known[k], w * good[k]).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    den = sum((F.when(known[k], w).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    return spark.range(1).select().crossJoin(row).withColumn("score", num / F.nullif(den, F.lit(0.0)))


def fixed_dofs(nodes: DataFrame, skin: DataFrame, boxes: DataFrame) -> DataFrame:
    """(dof, value): the held dofs of nodes in a box, and of skin faces whose centroid is in one; with fewer than nine, boxes widened by 2 % of the diagonal.

    boxes: box, lo_x.., hi_x.., fix (three booleans); skin: eid, local, nodes.
    """
    axes = ["x", "y", "z"]

    def held(found: DataFrame) -> DataFrame:
        return found.select("nid", F.posexplode("fix").alias("axis", "on")).filter("on").select((F.col("nid") * 3 + F.col("axis")).alias("dof"), F.lit(0.0).alias("value")).distinct()

    corner = skin.select("eid", "local", F.explode(F.array_distinct("nodes")).alias("nid")).join(nodes, "nid")
    centre = corner.groupBy("eid", "local").agg(*[F.avg(c).alias(c) for c in axes], F.collect_set("nid").alias("own"))
    by_face = box_select(centre, boxes, axes).select(F.explode("own").alias("nid"), "fix")
    out = held(box_select(nodes, boxes, axes).select("nid", "fix").unionByName(by_face))
    if out.limit(9).count() >= 9:
        return out
    ends = nodes.agg(*[f(c).alias(f"{c}{n}") for c in axes for n, f in (("0", F.min), ("1", F.max))]).first()
    if ends["x0"] is None:
        return out
    pad = 0.02 * max(sum((ends[f"{c}1"] - ends[f"{c}0"]) ** 2 for c in axes) ** 0.5, 1e-9)
    wide = boxes.select("box", "fix", *[(F.col(f"lo_{c}") - pad).alias(f"lo_{c}") for c in axes], *[(F.col(f"hi_{c}") + pad).alias(f"hi_{c}") for c in axes])
    return out.unionByName(held(box_select(nodes, wide, axes).select("nid", "fix"))).distinct()


def load_faces(faces: DataFrame, boxes: DataFrame, save) -> DataFrame:
    """The faces that carry each load.  faces: fid, x, y, z (centroid), nx, ny, nz, area; boxes: box, lo_x.., hi_x.., tx, ty, tz, least_dot, expected_area.

    Faces with their centroid in the box; of those, where any is, the ones whose
    normal lies within the asked angle of the traction, either way round; and where
    their area is more than 5 % too large, the outermost along the traction up to the
    running area nearest to the expected one.
    """
    size = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty") + F.col("tz") * F.col("tz"))
    inside = box_select(faces, boxes, ["x", "y", "z"]).withColumn("size", size)
    unit = {c: F.col(f"t{c}") / F.nullif(F.col("size"), F.lit(0.0)) for c in "xyz"}
    towards = lambda p: sum((F.col(f"{p}{c}") * unit[c] for c in "yz"), F.col(f"{p}x") * unit["x"])
    inside = inside.withColumn("align", F.abs(towards("n"))).withColumn("along", towards("")).withColumn("fits", (F.col("size") > 1e-30) & (F.col("align") > F.col("least_dot")))
    inside = save(inside.select("box", "fid", "area", "along", "align", "fits", "size", "expected_area"))
    by_rank = F.col("along") + 0.1 * F.col("align")
    largest = inside.groupBy("box").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= ordered.ONE_TASK:  # a box's faces fit one task: they are dealt once
        some = F.coalesce(F.bool_or("fits").over(Window.partitionBy("box")), F.lit(False))
        kept = inside.withColumn("any", some).filter(~F.col("any") | F.col("fits")).withColumn("rank_by", by_rank)
    else:
        some = inside.groupBy("box").agg(F.bool_or("fits").alias("any"))
        kept = save(inside.join(some, "box").filter(~F.coalesce("any", F.lit(False)) | F.col("fits")).withColumn("rank_by", by_rank))
    sizes = F.coalesce((F.col("expected_area") > 0) & (F.col("size") > 1e-30), F.lit(False))
    if largest <= ordered.ONE_TASK:
        return ordered.with_cut(kept, ["box"], "rank_by", ["fid"], "area", F.col("expected_area")).filter(~sizes | F.col("_stays")).select("box", "fid", "area")
    cut = cut_nearest(kept.filter(sizes), ["box"], "rank_by", ["fid"], "area", F.col("expected_area"))
    return cut.unionByName(kept.filter(~sizes)).select("box", "fid", "area")
