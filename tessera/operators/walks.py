"""Joins along lines: cells that a segment or ray runs through, first hits, wall thickness, distances to edges.

A line lies in the cells between its crossings of the grid's planes, so their number
grows with its length, not with the volume of its bounding box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Vec, cross, dot, norm, ray_triangle, ray_triangle_steps, segment_distance2, sub, vec  # noqa: F401
from .spatial import _settle, cell, fitted, places, samples_along, spread, told
from .surface import triangles_of

#: What lies this near to a cell (in cells) counts as inside, so that rounding loses nothing.
SLACK = 1e-6


def _shares(planes: Column, p: Column, q: Column, size: float) -> Column:
    """Where, from 0 at p to 1 at q, planes of the grid are crossed."""
    return F.transform(planes, lambda n: (n * size - p) / (q - p))


def cells_along(a: Vec, b: Vec, size: float) -> Column:
    """The cells (i, j, k) that the segment from a to b runs through, as an array; null coordinates give null."""
    cuts = []
    for p, q in zip(a, b, strict=True):
        i, j = F.floor(p / size), F.floor(q / size)
        planes = F.when(i == j, F.array().cast("array<bigint>")).when(i != j, F.sequence(F.least(i, j) + 1, F.greatest(i, j)))
        cuts.append(_shares(planes, p, q, size))
    t = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), *cuts))
    n = F.size(t) - 1
    middle = F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda s, e: (s + e) / 2)
    return F.array_distinct(F.transform(middle, lambda m: cell(tuple(p + m * (q - p) for p, q in zip(a, b, strict=True)), size)))


def triangle_cells(triangles: DataFrame, size: float) -> DataFrame:
    """Triangles once for each cell (column ``cell``) of their bounding box that their plane cuts."""
    t, near = triangles, SLACK * size
    for n, c in zip("ijk", "xyz", strict=True):
        low, high = F.least(f"a{c}", f"b{c}", f"c{c}") - near, F.greatest(f"a{c}", f"b{c}", f"c{c}") + near
        t = t.withColumn(f"_{n}", F.explode(F.sequence(F.floor(low / size).cast("long"), F.floor(high / size).cast("long"))))
    normal = cross(sub(vec("b"), vec("a")), sub(vec("c"), vec("a")))
    centre = tuple((F.col(f"_{n}") + 0.5) * size for n in "ijk")
    cut = F.abs(dot(normal, sub(centre, vec("a")))) <= (0.5 * size + near) * (F.abs(normal[0]) + F.abs(normal[1]) + F.abs(normal[2]))
    return t.filter(cut).withColumn("cell", F.struct(*[F.col(f"_{n}").alias(n) for n in "ijk"])).drop("_i", "_j", "_k")


def ray_hits(rays: DataFrame, triangles: DataFrame, size: float, reach: float, save=None, unless: Column | None = None, carry: tuple[str, ...] = (), least: float = 0.0) -> DataFrame:
    """(rid, t): the first hit of each ray beyond ``least`` and within reach; rays without one have no row.

    rays: rid, ox.., dx.. (unit); triangles: ax.., bx.., cx...  Pairs for which
    ``unless`` (over rid and the triangle's columns named in ``carry``) holds are no
    hits.  With ``save`` the rays go band by band, each four times as long as the
    last, and only those without a hit go on: all cells up to a band's end have been
    seen, so the least hit before it is the first.  Cells then begin as small as the
    triangles are dense, equal triangles are one, and so are equal rays (without ``unless``).
    """
    corners = [f"{n}{c}" for n in "abc" for c in "xyz"]
    triangles = triangles.select(*corners, *carry)
    if save:
        triangles = save(triangles.distinct())
        size = fitted(size, lambda size: triangle_cells(triangles, size), entries=24.0 * triangles.count())
    boxed = triangle_cells(triangles, size)
    boxed = save(boxed) if save else boxed
    at = lambda t: tuple(F.col(f"o{c}") + t * F.col(f"d{c}") for c in "xyz")
    steps, hit = ray_triangle_steps()

    def band(todo: DataFrame, start: float, end: float) -> DataFrame:
        pairs = todo.withColumn("cell", F.explode(cells_along(at(start), at(end), size))).hint("merge").join(boxed, "cell")
        pairs = pairs if unless is None else pairs.filter(~unless)
        for step in steps:
            pairs = pairs.withColumns(step)
        return pairs.groupBy("rid").agg(F.min(F.when((hit > least) & (hit <= end), hit)).alias("t")).filter("t IS NOT NULL")

    rays = rays.select("rid", *[f"{n}{c}" for n in "od" for c in "xyz"])
    if save is None:
        return band(rays, 0.0, reach)
    line = [f"{n}{c}" for n in "od" for c in "xyz"]
    once = save(rays.groupBy(*line).agg(F.min("rid").alias("rid")) if unless is None else rays)
    tell = lambda found: found if unless is not None else rays.hint("merge").join(once.withColumnRenamed("rid", "_rid"), line).select("rid", "_rid").hint("merge").join(found.withColumnRenamed("rid", "_rid"), "_rid").select("rid", "t")
    done, todo, start, end = None, once, 0.0, min(reach, 4 * size)
    while True:
        found = save(band(todo, start, end))
        done = found if done is None else done.unionByName(found)
        if end >= reach:
            return tell(done)
        todo = save(todo.hint("merge").join(found.select("rid"), "rid", "left_anti"))
        if not todo.limit(1).count():
            return tell(done)
        start, end = end, min(reach, 4 * end)


def local_thickness(triangles: DataFrame, vertices: DataFrame, save, eps_scale: float = 1e-4) -> DataFrame:
    """(vid, thickness): how far the inward ray from each vertex runs to the wall opposite, null where there is none.

    triangles: tid, nodes (outward); vertices: vid, x, y, z.  A vertex's normal is the
    mean of its triangles' by area; those triangles themselves are no walls.
    """
    t = save(triangles_of(triangles, vertices).join(triangles.select("tid", "nodes"), "tid"))
    sides = [norm(sub(vec(p), vec(q))) for p, q in ("ab", "bc", "ca")]
    ends = vertices.agg(*[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).select(norm(vec("")).alias("d")).first()["d"]
    mean = t.agg(F.avg((sides[0] + sides[1] + sides[2]) / 3)).first()[0]
    size, eps = 2 * (mean or 0.5), max(eps_scale * (mean or 1.0), 1e-12)
    turned = cross(sub(vec("b"), vec("a")), sub(vec("c"), vec("a")))
    normals = t.select(F.explode("nodes").alias("vid"), *[v.alias(f"n{c}") for c, v in zip("xyz", turned, strict=True)]).groupBy("vid").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"])
    length = norm(vec("n"))
    inward = vertices.join(normals.filter(length > 1e-30), "vid").withColumn("l", length)
    rays = inward.select(F.col("vid").alias("rid"), *[(F.col(c) - eps * F.col(f"n{c}") / F.col("l")).alias(f"o{c}") for c in "xyz"], *[(-F.col(f"n{c}") / F.col("l")).alias(f"d{c}") for c in "xyz"])
    hits = ray_hits(rays, t, size, (ends or 0.0) + eps, save, F.array_contains("nodes", F.col("rid")), ("nodes",), 0.5 * eps)
    return vertices.select("vid").join(hits.withColumnRenamed("rid", "vid"), "vid", "left").select("vid", (F.col("t") + eps).alias("thickness"))


def closest_edge(points: DataFrame, segments: DataFrame, size: float, save, only: Column | None = None) -> DataFrame:
    """(pid, sid, d2): each point's nearest segment (sid, ax.., bx..), the least sid on ties; exact, at any distance.

    ``only`` keeps some segments (sharp edges, say) before any distance is taken.
    Without a segment there is no row.
    """
    ends = [f"{n}{c}" for n in "ab" for c in "xyz"]
    segments = save((segments if only is None else segments.filter(only)).groupBy(*ends).agg(F.min("sid").alias("sid")).select("sid", *ends).dropna(subset=ends))
    n_s = segments.count()

    def near(todo: DataFrame, size: float) -> DataFrame:
        width, many = size * (1 + SLACK), todo.count() > n_s  # what there is less of is spread
        own = cells_along(vec("a"), vec("b"), width)
        s = segments.withColumn("cell", F.explode(F.array_distinct(F.flatten(F.transform(own, lambda at: spread(at, 1)))) if many else own))
        here = cell(vec("p"), width)
        p = todo.select("pid", *[F.col(c).alias(f"p{c}") for c in "xyz"]).withColumn("cell", here if many else F.explode(spread(here, 1)))
        d2 = segment_distance2(vec("p"), vec("a"), vec("b"))
        return p.hint("merge").join(s, "cell").withColumn("d2", d2).groupBy("pid").agg(F.min(F.struct("d2", "sid")).alias("m")).select("pid", "m.sid", "m.d2")

    if not n_s:
        return near(points.limit(0), size)
    spots = places(points, save)
    start = fitted(size, lambda size: segments.withColumn("cell", F.explode(cells_along(vec("a"), vec("b"), size))), entries=24.0 * n_s)
    return told(points, spots, _settle(spots, near, start, save, 12)).select("pid", "sid", "d2")


def farthest(points: DataFrame, segments: DataFrame, size: float, save, only: Column | None = None) -> float:
    """The largest distance of a point to its nearest segment (of those that ``only`` keeps); 0 without points or segments."""
    return closest_edge(points, segments, size, save, only).agg(F.sqrt(F.max("d2"))).first()[0] or 0.0


def edge_hausdorff(one: DataFrame, other: DataFrame, spacing: float, save, only: Column | None = None) -> float:
    """The two-sided largest distance between two sets of segments (sid, ax.., bx..), each sampled no wider than ``spacing``.

    ``only`` keeps some segments of both.  What the first side finds is a lower bound:
    samples of the second side that have an edge within it settle in the first round.
    """
    kept = [save(s if only is None else s.filter(only)) for s in (one, other)]
    dots = [save(samples_along(s, spacing).select("x", "y", "z").distinct().select(F.struct("x", "y", "z").alias("pid"), "x", "y", "z")) for s in kept]
    first = farthest(dots[0], kept[1], spacing, save)
    return max(first, farthest(dots[1], kept[0], max(first, spacing), save))
