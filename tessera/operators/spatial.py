"""Spatial joins: nearest, within a distance, in a box, least over sources.

Distances are joined over grid cells: both sides get a cell, the searching side is
spread over the cells within reach, and an equi-join on the cell is refined by the
exact distance (a crowded cell is a skewed key, which adaptive execution splits).
Nearest neighbours widen the reach in rounds until all are settled, for the points
that are not yet settled only.
"""

from __future__ import annotations

from math import log2, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Vec, dot, segment_distance2, sub, vec
from ..session import saver


def cell(p: Vec, size: float) -> Column:
    return F.struct(*[F.floor(c / size).cast("long").alias(n) for c, n in zip(p, "ijk", strict=True)])


def spread(at: Column, reach: int) -> Column:
    """The cells around a cell, as an array."""
    span = F.sequence(F.lit(-reach), F.lit(reach))
    return F.flatten(F.transform(span, lambda di: F.flatten(F.transform(span, lambda dj: F.transform(span, lambda dk: F.struct((at["i"] + di).alias("i"), (at["j"] + dj).alias("j"), (at["k"] + dk).alias("k")))))))


KNOWN = "x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL"
#: Rows of a crowded cell that each side brings to one pair of chunks.
CHUNK = 4096
#: Rows that a cell may hold, as one of them sees it on the mean, before cells are halved.
FULL = 4.0


def fitted(size: float, cells, most: float = FULL, entries: float = float("inf")) -> float:
    """``size``, halved until cells are not crowded: ``cells(size)`` has a row (column ``cell``) for each thing in each cell.

    What counts is how many share a cell on the mean over the things, so that a crowd
    in few places counts too.  Halving ends where there would be more than ``entries``
    rows.
    """
    for _ in range(40):
        n = F.col("count").cast("double")
        one = cells(size).groupBy("cell").count().agg((F.sum(n * n) / F.sum(n)).alias("mean"), F.sum(n).alias("rows")).first()
        if one["rows"] and one["rows"] > entries:
            return 2 * size
        if not one["mean"] or one["mean"] <= most:
            return size
        size /= 2 ** max(1, int(log2(one["mean"] / most) / 3)) if entries == float("inf") else 2
    return size


def _meet(p: DataFrame, s: DataFrame, size: float, more_points: bool, only: Column | None = None, how: str = "inner") -> DataFrame:
    """Rows of p (px..) and s (sx..) in the same or neighbouring cells: the side with fewer rows is spread, and no side is broadcast."""
    here, there = cell(vec("p"), size), cell(vec("s"), size)
    p = p.withColumn("cell", here if more_points else F.explode(spread(here, 1)))
    s = s.withColumn("_cell", F.explode(spread(there, 1)) if more_points else there)
    test = F.col("cell") == F.col("_cell")
    return p.hint("merge").join(s, test if only is None else test & only, how).drop("cell", "_cell")


def within(points: DataFrame, sites: DataFrame, radius: float, carry: tuple[str, ...] = (), partners: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (pid, sid, d2, and the columns ``carry`` of points and ``partners`` of sites) no further apart than radius.

    points: pid, x, y, z; sites: sid, x, y, z.  Both are read twice.  Crowded cells are cut into chunks of both
    sides, each pair of chunks being a key of its own, and the number of tasks follows
    the number of pairs, so that no task has more than some ten million to look at.
    """
    p = points.select("pid", *carry, *[F.col(c).alias(f"p{c}") for c in "xyz"]).filter("px IS NOT NULL AND py IS NOT NULL AND pz IS NOT NULL")
    s = sites.select("sid", *partners, *[F.col(c).alias(f"s{c}") for c in "xyz"]).filter("sx IS NOT NULL AND sy IS NOT NULL AND sz IS NOT NULL")
    here, there = cell(vec("p"), radius), cell(vec("s"), radius)
    n_p = p.groupBy(here.alias("cell")).agg(F.count("*").alias("n_p"))
    n_s = s.groupBy(there.alias("c")).agg(F.count("*").alias("n")).select(F.explode(spread(F.col("c"), 1)).alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n_s"))
    cells = saver(points.sparkSession, "within")(n_p.hint("merge").join(n_s, "cell"))
    one = cells.agg(F.sum(F.col("n_p").cast("double") * F.col("n_s")).alias("pairs"), F.sum("n_p").alias("n_p"), F.sum("n_s").alias("n_s")).first()
    more_points = (one["n_p"] or 0) * 27 > (one["n_s"] or 0)
    few = 1 + ((one["n_p"] or 0) + (one["n_s"] or 0)) // 50_000 + (one["pairs"] or 0) // 1_000_000
    tasks = int(min(20_000, (one["pairs"] or 0) // CHUNK**2 + min(few, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    # A cell holds n_p points and a twenty-seventh of n_s sites, or the other way round where points are spread.
    parts = lambda n: F.ceil(F.col(n) / CHUNK).cast("int")
    heavy = cells.filter((F.col("n_p") > CHUNK) | (F.col("n_s") > CHUNK)).select("cell", parts("n_p").alias("k_p"), parts("n_s").alias("k_s"))

    def dealt(df: DataFrame, at: Column, spread_it: bool, key: str, own: str, other: str) -> DataFrame:
        df = df.withColumn("cell", F.explode(spread(at, 1)) if spread_it else at).join(F.broadcast(heavy), "cell", "left")  # a cell in some thousand rows
        mine, all_ = F.pmod(F.xxhash64(key), F.coalesce(F.col(f"k_{own}"), F.lit(1))).cast("int"), F.sequence(F.lit(0), F.coalesce(F.col(f"k_{other}"), F.lit(1)) - 1)
        return df.withColumn(f"c_{own}", mine).withColumn(f"c_{other}", F.explode(all_)).drop("k_p", "k_s").repartition(tasks, "cell", "c_p", "c_s")

    d = sub(vec("p"), vec("s"))
    pairs = dealt(p, here, not more_points, "pid", "p", "s").hint("merge").join(dealt(s, there, more_points, "sid", "s", "p"), ["cell", "c_p", "c_s"])
    return pairs.withColumn("d2", dot(d, d)).filter(F.col("d2") <= radius * radius).select("pid", "sid", "d2", *carry, *partners)


def near_any(points: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """Points with a site within radius; no pair is made, a point's first site settles it.

    Places count once however many rows share them, and cells begin as small as the
    sites are dense, so that crowds settle by what is nearest.
    """
    save = saver(points.sparkSession, "near-any")
    s = save(sites.filter(KNOWN).select(*[F.col(c).alias(f"s{c}") for c in "xyz"]).distinct())
    todo = save(points.filter(KNOWN).select(*[F.col(c).alias(f"p{c}") for c in "xyz"]).distinct())
    size, n_s, done = fitted(radius, lambda size: s.select(cell(vec("s"), size).alias("cell"))), s.count(), todo.limit(0)
    d = sub(vec("p"), vec("s"))
    while n_s:
        held = save(_meet(todo, s, size, todo.count() > n_s, dot(d, d) <= radius * radius, "left_semi").distinct())
        done = done.unionByName(held)
        if size >= radius:
            break
        todo, size = save(todo.hint("merge").join(held, ["px", "py", "pz"], "left_anti")), min(2 * size, radius)
    return points.hint("merge").join(done.toDF("x", "y", "z"), ["x", "y", "z"], "left_semi").select(points.columns)


def _settle(todo: DataFrame, near, size: float, save, most_rounds: int, reach: float = float("inf")) -> DataFrame | None:
    """Final rows (pid, d2, ...) of ``near(todo, size)``, asked with a growing size for the points that have none yet.

    A hit is final when it is no further than ``size``, the border of what was
    searched.  The size doubles, and after ``most_rounds`` grows eightfold, up to
    ``reach``; without one, points stay open at last only where there is nothing to be
    near to.
    """
    done, rounds, empty = None, 0, 0
    while True:
        found = save(near(todo, size))
        final = found.filter(F.col("d2") <= size * size)
        done = final if done is None else done.unionByName(final)
        if size >= reach:
            return done
        todo = save(todo.hint("merge").join(final.select("pid"), "pid", "left_anti"))
        if not todo.limit(1).count():
            return done
        rounds += 1
        empty = 0 if rounds <= most_rounds or found.limit(1).count() else empty + 1
        if empty > 200:  # 8 ** 200 is beyond every double
            return done
        size = min(reach, size * (2 if rounds < most_rounds else 8))


def places(points: DataFrame, save) -> DataFrame:
    """(pid, x, y, z): each place once, under its least pid; ``told`` gives what is found there back to all points of the place."""
    return save(points.filter(KNOWN).groupBy("x", "y", "z").agg(F.min("pid").alias("pid")).select("pid", "x", "y", "z"))


def told(points: DataFrame, spots: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` (pid, ...) of ``places``, for every point."""
    at = spots.select("pid", *[F.col(c).alias(f"_at_{c}") for c in "xyz"]).hint("merge").join(found, "pid").drop("pid")
    own = points.filter(KNOWN).select("pid", *[F.col(c).alias(f"_at_{c}") for c in "xyz"])
    return own.hint("merge").join(at, [f"_at_{c}" for c in "xyz"]).drop(*[f"_at_{c}" for c in "xyz"])


def nearest(points: DataFrame, sites: DataFrame, size: float, save, most_rounds: int = 12) -> DataFrame:
    """(pid, sid, d2): each point's nearest site, the least sid on ties; exact.  Without a site there is no row.

    ``size`` is where the search begins at most; it begins with less where sites are
    dense.  Points in one place are one search, sites in one place one site.
    """
    sites = save(sites.filter(KNOWN).groupBy("x", "y", "z").agg(F.min("sid").alias("sid")).select("sid", *[F.col(c).alias(f"s{c}") for c in "xyz"]))
    n_s = sites.count()
    if not n_s:
        return points.select("pid", F.lit(None).cast("long").alias("sid"), F.lit(None).cast("double").alias("d2")).limit(0)
    d = sub(vec("p"), vec("s"))

    def near(todo: DataFrame, size: float) -> DataFrame:
        p = todo.select("pid", *[F.col(c).alias(f"p{c}") for c in "xyz"])
        joined = _meet(p, sites, size, todo.count() > n_s)
        return joined.withColumn("d2", dot(d, d)).groupBy("pid").agg(F.min(F.struct("d2", "sid")).alias("m")).select("pid", "m.sid", "m.d2")

    spots = places(points, save)
    size = fitted(size, lambda size: sites.select(cell(vec("s"), size).alias("cell")))
    return told(points, spots, _settle(spots, near, size, save, most_rounds)).select("pid", "sid", "d2")


def nearest_1d(points: DataFrame, sites: DataFrame, part: list[str]) -> DataFrame:
    """(pid, sid, dist): the nearest site by one coordinate inside a part, the least sid on ties.

    Only the neighbours below and above can be nearest: the last site before a point in
    one order and in the other.  Parts of any size are cut into blocks (``running``);
    the sides are read several times, so hand over scans or written tables.
    """
    from .ordered import running

    s = sites.groupBy(*part, "v").agg(F.min("sid").alias("sid")).select(*part, "v", F.col("sid").cast("long").alias("sid"), F.lit(None).cast("long").alias("pid"), F.lit(0).alias("side"))
    p = points.select(*part, "v", F.lit(None).cast("long").alias("sid"), F.col("pid").cast("long"), F.lit(1).alias("side"))
    both = s.unionByName(p)
    below, above = (F.when(F.col("side") == 0, F.struct(k.alias("k"), "v", "sid")) for k in (F.col("v"), -F.col("v")))
    both = running(both, below, "low", "v", ["side", "pid"], "max", part=part)
    both = running(both, above, "high", "v", ["side", "pid"], "max", descending=True, part=part).filter("side = 1")
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("v") - F.col(c)["v"]).alias("dist"), F.col(c)["sid"].alias("sid")))
    return both.withColumn("m", F.least(gap("low"), gap("high"))).select("pid", "m.sid", "m.dist")


def polyline_segments(samples: DataFrame) -> DataFrame:
    """(sid, edge, ax.., bx..) from the samples of edges (edge, pos, x, y, z, ...): each sample to the next."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("edge").orderBy("pos")  # one edge's samples
    following = F.lead(F.struct("x", "y", "z")).over(w)
    rows = samples.select("edge", "pos", *[F.col(c).alias(f"a{c}") for c in "xyz"], following.alias("b")).filter("b is not null")
    return rows.select(F.xxhash64("edge", "pos").alias("sid"), "edge", "ax", "ay", "az", *[F.col("b")[c].alias(f"b{c}") for c in "xyz"])


def samples_along(segments: DataFrame, spacing: float) -> DataFrame:
    """(sid, x, y, z): points on each segment, both ends included, no further apart than ``spacing``."""
    d = sub(vec("b"), vec("a"))
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(dot(d, d)) / spacing).cast("int"))
    t = segments.select("sid", "ax", "ay", "az", "bx", "by", "bz", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("i"))
    at = lambda c: (F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * F.col("i") / F.col("n")).alias(c)
    return t.select("sid", at("x"), at("y"), at("z"))


def nearest_segment(points: DataFrame, segments: DataFrame, size: float, reach: float, only: Column | None = None) -> DataFrame:
    """(pid, sid, d2): each point's nearest segment within reach, the least sid on ties.

    segments: sid, ax.., bx..; each lies in the cells of its bounding box, widened by
    reach, so the point is in one cell only.  ``only`` keeps some of them before any
    distance is taken (sharp edges, say).
    """
    segments = segments if only is None else segments.filter(only)
    lo = [F.floor((F.least(f"a{c}", f"b{c}") - reach) / size).cast("long") for c in "xyz"]
    hi = [F.floor((F.greatest(f"a{c}", f"b{c}") + reach) / size).cast("long") for c in "xyz"]
    s = segments
    for n, a, b in zip("ijk", lo, hi, strict=True):
        s = s.withColumn(n, F.explode(F.sequence(a, b)))
    p = points.select("pid", *[F.col(c).alias(f"p{c}") for c in "xyz"], *[F.floor(F.col(c) / size).cast("long").alias(n) for c, n in zip("xyz", "ijk", strict=True)])
    d2 = segment_distance2(vec("p"), vec("a"), vec("b"))
    out = p.join(s, ["i", "j", "k"]).withColumn("d2", d2).filter(F.col("d2") <= reach * reach)
    return out.groupBy("pid").agg(F.min(F.struct("d2", "sid")).alias("m")).select("pid", "m.sid", "m.d2")


def stamp(points: DataFrame, band: float, h: float, counts: tuple[int, int, int]) -> DataFrame:
    """Lattice cells (i, j, k) whose centre lies within band of a point."""
    reach = int(band / h) + 1
    near = points.withColumn("c", F.explode(spread(cell(vec(""), h), reach))).select("x", "y", "z", "c.i", "c.j", "c.k")
    centre = tuple((F.col(n) + 0.5) * h for n in "ijk")
    d = sub(vec(""), centre)
    inside = [F.col(n).between(0, m - 1) for n, m in zip("ijk", counts, strict=True)]
    return near.filter((dot(d, d) <= band * band) & inside[0] & inside[1] & inside[2]).select("i", "j", "k").distinct()


#: So few boxes are held against every point.
FEW_BOXES = 64
_LEVELS, _GRIDS = 40, 256


def box_select(points: DataFrame, boxes: DataFrame, axes: list[str]) -> DataFrame:
    """Pairs of rows and boxes that hold them.  boxes: box, lo_<axis>, hi_<axis>, any number.

    Along each axis a box gets the grid (the points' extent, halved again and again)
    whose cells are just as wide as itself, so it lies in two of them at most, and
    points join the boxes of their cell in each of the grids that occur.  Those are
    coarsened to 256 at most.
    """
    test = F.lit(True)
    for a in axes:
        test = test & F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}"))
    if boxes.limit(FEW_BOXES + 1).count() <= FEW_BOXES:
        return points.join(F.broadcast(boxes), test)
    finite = {a: F.when(F.abs(F.col(a).cast("double")) < float("inf"), F.col(a).cast("double")) for a in axes}
    ends = points.agg(*[f(finite[a]).alias(f"{n}_{a}") for a in axes for n, f in (("low", F.min), ("high", F.max))]).first()
    extent = {a: (ends[f"low_{a}"] or 0.0, (ends[f"high_{a}"] or 0.0) - (ends[f"low_{a}"] or 0.0)) for a in axes}
    level = lambda a: F.floor(F.log2(F.lit(extent[a][1]) / F.greatest(F.col(f"hi_{a}") - F.col(f"lo_{a}"), F.lit(extent[a][1] / 2**_LEVELS))))
    own = {a: F.greatest(F.lit(0), F.least(F.lit(_LEVELS), F.coalesce(level(a), F.lit(0)))).cast("int") if extent[a][1] > 0 else F.lit(0) for a in axes}
    used = boxes.select(F.array(*own.values()).alias("g")).distinct().collect()  # at most 41 levels an axis
    step = 1
    while len(grids := {tuple(x // step * step for x in r["g"]) for r in used}) > _GRIDS:
        step *= 2

    def at(value, a: str, lv) -> Column:
        """The cell of a value; whatever lies outside is in the outermost one."""
        low, width = extent[a]
        n = F.pow(F.lit(2.0), lv)
        place = F.floor((F.least(F.greatest(value, F.lit(low)), F.lit(low + width)) - low) / (width or 1.0) * n)
        return F.least(place, n - 1).cast("long")

    b = boxes.withColumn("_g", F.array(*[F.floor(v / step).cast("int") * step for v in own.values()]))
    p = points.withColumn("_g", F.explode(F.array(*[F.array(*map(F.lit, g)) for g in sorted(grids)])))
    for n, a in enumerate(axes):
        lo, hi = at(F.col(f"lo_{a}"), a, F.col("_g")[n]), at(F.col(f"hi_{a}"), a, F.col("_g")[n])
        b = b.filter(F.col(f"lo_{a}") <= F.col(f"hi_{a}")).withColumn(f"_{a}", F.explode(F.sequence(lo, hi)))
        p = p.withColumn(f"_{a}", at(F.col(a), a, F.col("_g")[n]))
    return p.hint("merge").join(b, ["_g", *[f"_{a}" for a in axes]]).filter(test).drop("_g", *[f"_{a}" for a in axes])


def min_plus(points: DataFrame, sources: DataFrame, slope: float, h_min: float, h_max: float, axes: list[str], reach: float | None = None) -> DataFrame:
    """Adds size: the least of h_source + slope * distance over all sources, clamped to h_min..h_max.

    Along one axis the least from either side is a running extreme, whatever the
    density.  With more axes a source only matters within (h_max - h) / slope, so
    sources are spread over the cells they reach and points join their own cell.
    Without a source it is h_max.
    """
    if len(axes) == 1 and reach is None and slope > 0:
        return _min_plus_line(points, sources, slope, h_min, h_max, axes[0])
    reach = reach or (h_max - h_min) / slope
    s, p = sources, points
    for a in axes:
        s = s.withColumn(f"c_{a}", F.explode(F.sequence(F.floor((F.col(a) - reach) / reach).cast("long"), F.floor((F.col(a) + reach) / reach).cast("long"))))
        p = p.withColumn(f"c_{a}", F.floor(F.col(a) / reach).cast("long"))
    s = s.select(*[f"c_{a}" for a in axes], *[F.col(a).alias(f"s_{a}") for a in axes], F.col("h").alias("s_h"))
    distance = F.sqrt(sum(((F.col(a) - F.col(f"s_{a}")) * (F.col(a) - F.col(f"s_{a}")) for a in axes[1:]), (F.col(axes[0]) - F.col(f"s_{axes[0]}")) * (F.col(axes[0]) - F.col(f"s_{axes[0]}"))))
    best = p.join(s, [f"c_{a}" for a in axes]).groupBy("pid").agg(F.min(F.col("s_h") + slope * distance).alias("best"))
    return points.join(best, "pid", "left").withColumn("size", F.greatest(F.lit(h_min), F.least(F.lit(h_max), F.coalesce("best", F.lit(h_max))))).drop("best")


def _min_plus_line(points: DataFrame, sources: DataFrame, slope: float, h_min: float, h_max: float, axis: str) -> DataFrame:
    """``min_plus`` along one axis: of the sources below a place the one of largest slope * place - h is best, of those above that of least slope * place + h.

    The extremes only tell which source it is; its value is taken by the formula.
    """
    from .ordered import running

    save = saver(points.sparkSession, "min-plus")
    s = sources.filter(F.col(axis).isNotNull()).groupBy(F.col(axis).cast("double").alias("_x")).agg(F.min(F.col("h").cast("double")).alias("_h")).filter("_h IS NOT NULL")
    p = points.filter(F.col(axis).isNotNull()).select(F.col(axis).cast("double").alias("_x")).distinct().withColumn("_h", F.lit(None).cast("double"))
    both = save(s.withColumn("_side", F.lit(0)).unionByName(p.withColumn("_side", F.lit(1))))
    below, above = (F.when(F.col("_side") == 0, F.struct((sign * slope * F.col("_x") - F.col("_h")).alias("k"), F.col("_x").alias("x"), F.col("_h").alias("h"))) for sign in (1.0, -1.0))
    both = save(running(both, below, "_low", "_x", ["_side"], "max"))
    both = running(both, above, "_high", "_x", ["_side"], "max", descending=True).filter("_side = 1")
    size = lambda c: F.col(c)["h"] + slope * F.abs(F.col("_x") - F.col(c)["x"])
    best = both.select("_x", F.least(size("_low"), size("_high")).alias("best"))
    out = points.withColumn("_x", F.col(axis).cast("double")).hint("merge").join(best, "_x", "left")
    return out.withColumn("size", F.greatest(F.lit(h_min), F.least(F.lit(h_max), F.coalesce("best", F.lit(h_max))))).select(*points.columns, "size")


def finest_per_cell(sources: DataFrame, cells: list[Column], h: str, index: str) -> DataFrame:
    """Keeps, for each cell, the source of least size (the first on ties)."""
    names = [f"_c{i}" for i in range(len(cells))]
    df = sources.withColumns(dict(zip(names, cells, strict=True)))
    kept = df.groupBy(*names).agg(F.min(F.struct(h, index)).alias("_m")).select(F.col("_m")[index].alias(index))
    return sources.join(kept, index, "left_semi")


def other_edges_gap(samples: DataFrame, radius: float) -> DataFrame:
    """(pid, gap): least distance from each edge sample to a sample of another edge within radius.

    An edge's samples in one place are one search, and cells begin as small as the
    samples are dense: the nearest of another edge is found before its rivals are met.
    """
    save = saver(samples.sparkSession, "other-edges")
    known = samples.filter(KNOWN).filter("edge IS NOT NULL")
    spots = save(known.groupBy("edge", "x", "y", "z").agg(F.min("sid").alias("pid")))
    s = spots.select(F.col("edge").alias("_edge"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    n_s, d = s.count(), sub(vec("p"), vec("s"))

    def near(todo: DataFrame, size: float) -> DataFrame:
        p = todo.select("pid", "edge", *[F.col(c).alias(f"p{c}") for c in "xyz"])
        return _meet(p, s, size, 2 * todo.count() > n_s, F.col("edge") != F.col("_edge")).groupBy("pid").agg(F.min(dot(d, d)).alias("d2"))

    start = fitted(radius, lambda size: s.select(cell(vec("s"), size).alias("cell")))
    found = _settle(spots, near, start, save, 60, radius)
    at = spots.hint("merge").join(found, "pid").select("edge", "x", "y", "z", F.sqrt("d2").alias("gap"))
    return known.select(F.col("sid").alias("pid"), "edge", "x", "y", "z").hint("merge").join(at, ["edge", "x", "y", "z"]).select("pid", "gap")


def packing_fill(balls: DataFrame, radius: float, volume: float) -> DataFrame:
    """One row: the share of a volume that equal balls fill, less the lenses of overlapping pairs, clamped to 0..1.

    Balls in one place have no lens with each other, and are one place with a number.
    Lenses are summed over growing shares of the balls, each against all others: none
    is negative, so once they outweigh the balls the share is 0 whatever else there is,
    and until then there are few pairs a ball.
    """
    save, ball = saver(balls.sparkSession, "fill"), 4 / 3 * 3.141592653589793 * radius**3
    spots = save(balls.filter(KNOWN).groupBy("x", "y", "z").agg(F.min("sid").alias("sid"), F.count("*").cast("double").alias("n")))
    total, lens, low = balls.count() * ball, 0.0, 0
    r, d = F.lit(float(radius)), F.sqrt("d2")
    one = F.lit(3.141592653589793) * F.pow(2 * r - d, F.lit(2.0)) * (d * d + 4 * d * r) / (12 * F.nullif(d, F.lit(0.0)))
    draw = F.pmod(F.xxhash64("x", "y", "z"), F.lit(256))
    for high in (1, 4, 16, 64, 256):
        some = spots.filter((draw >= low) & (draw < high)).select(F.col("sid").alias("pid"), "x", "y", "z", F.col("n").alias("m"))
        pairs = within(some, spots, 2 * radius, ("m",), ("n",)).filter("pid < sid")
        lens, low = lens + (pairs.agg(F.sum(F.col("m") * F.col("n") * one)).first()[0] or 0.0), high
        if lens > total * (1 + 1e-9):
            break
    return balls.sparkSession.createDataFrame([(max(0.0, min(1.0, (total - lens) / volume)),)], "fill double")


def bounding_box(points: DataFrame) -> DataFrame:
    return points.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def radius_peak(points: DataFrame, radius: Column, bins: int, top: float) -> DataFrame:
    """The fullest of equal radius bins up to ``top``."""
    b = F.least(F.floor(radius / top * bins), F.lit(bins - 1)).cast("int")
    return points.select(b.alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bin").limit(1)


def columns_under(triangles: DataFrame, h: float) -> DataFrame:
    """Lattice columns (i, j) whose centre a triangle covers in the plane, with the height where it is met."""
    t = triangles
    for n, c in (("i", "x"), ("j", "y")):
        low, high = F.least(f"a{c}", f"b{c}", f"c{c}"), F.greatest(f"a{c}", f"b{c}", f"c{c}")
        t = t.withColumn(n, F.explode(F.sequence(F.floor(low / h).cast("long"), F.floor(high / h).cast("long"))))
    px, py = (F.col("i") + 0.5) * h, (F.col("j") + 0.5) * h
    det = F.nullif((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (F.col("by") - F.col("ay")), F.lit(0.0))
    u = ((px - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("cx") - F.col("ax")) * (py - F.col("ay"))) / det
    v = ((F.col("bx") - F.col("ax")) * (py - F.col("ay")) - (px - F.col("ax")) * (F.col("by") - F.col("ay"))) / det
    hit = t.withColumn("u", u).withColumn("v", v).filter("u >= 0 AND v >= 0 AND u + v <= 1")
    return hit.select("i", "j", (F.col("az") + F.col("u") * (F.col("bz") - F.col("az")) + F.col("v") * (F.col("cz") - F.col("az"))).alias("z"))


def nearest_passing(faces: DataFrame, elements: DataFrame, quality: float, size: float, save) -> DataFrame:
    """(pid, sid, d2): each face's nearest element whose quality passes (filtered before any distance)."""
    return nearest(faces, elements.filter(F.col("quality") >= quality).select("sid", "x", "y", "z"), size, save)


def weighted_value(faces: DataFrame, found: DataFrame, elements: DataFrame, value: str) -> DataFrame:
    """One row: the mean of the nearest elements' values, weighted by face area."""
    own = found.join(faces.select("pid", "area"), "pid").join(elements.select("sid", value), "sid")
    return own.agg((F.sum(F.col("area") * F.col(value)) / F.sum("area")).alias("mean"), F.count("*").alias("n"))


def best_alignment(faces: DataFrame, targets: DataFrame, radius: float, least: float = 0.866) -> DataFrame:
    """(pid, best): the best |n . n'| with a target face within radius, from ``least`` on.

    Faces are met by place and by direction: only targets turned no further than the
    width of a direction cell are looked at, and that width begins as small as targets
    are dense and doubles until the best found can't be beaten by any outside of it.
    """
    save, names = saver(faces.sparkSession, "alignment"), [f"n{c}" for c in "xyz"]
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    ready = lambda df, to, *own: df.filter(KNOWN).withColumn("length", length).filter("length > 0").select(*own, "length", *[F.col(c).alias(f"{to}{c}") for c in "xyz"], *[F.col(n).alias(f"{to}{n}") for n in names])
    s = save(ready(targets, "s").distinct())
    todo = save(ready(faces, "p", "pid"))
    most, longest = s.agg(F.max("length")).first()[0], todo.agg(F.max("length")).first()[0]
    if not most or not longest or least > most * longest * (1 + 1e-9):
        return faces.select("pid", F.lit(None).cast("double").alias("best")).limit(0)
    reach = sqrt(2 - 2 * max(0.0, min(1.0, least / (most * longest)))) + 1e-6
    turn = lambda p, size, sign=1.0: tuple(F.floor(sign * F.col(f"{p}n{c}") / F.col("length") / size).cast("long") for c in "xy")
    # Either sign of a target's direction; the third coordinate follows from the two but for its sign.
    sited = lambda size: s.select(F.explode(F.array(*[F.struct(*[v.alias(n) for n, v in zip("ab", turn("s", size, sign), strict=True)]) for sign in (1.0, -1.0)])).alias("t"), "*").withColumn("c", cell(vec("s"), radius))

    def near(todo: DataFrame, size: float) -> DataFrame:
        wide = size * (1 + 1e-9)
        a, b = turn("p", wide)
        steps = F.array(*[F.struct((a + i).alias("a"), (b + j).alias("b")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        p = todo.withColumn("t", F.explode(steps)).withColumn("c", cell(vec("p"), radius))
        q = sited(wide).drop("length").withColumn("c", F.explode(spread(F.col("c"), 1)))
        d = sub(vec("p"), vec("s"))
        same = F.abs(F.col("pnx") * F.col("snx") + F.col("pny") * F.col("sny") + F.col("pnz") * F.col("snz"))
        met = p.hint("merge").join(q, ["c", "t"]).filter(dot(d, d) <= radius * radius).select("pid", "length", same.alias("dot")).filter(F.col("dot") >= least)
        best = met.groupBy("pid").agg(F.max("dot").alias("best"), F.first("length").alias("length"))
        return best.select("pid", "best", (2 - 2 * F.col("best") / (F.col("length") * most)).alias("d2"))

    start = fitted(reach, lambda size: sited(size).select(F.struct("c", "t").alias("cell")))
    return _settle(todo, near, start, save, 60, reach).select("pid", "best")


def regions_of_midpoints(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(mid, region): a mid-edge node takes a region that both its ends are in.  edges: mid, a, b; regions: nid, region."""
    ends = edges.join(regions.select(F.col("nid").alias("a"), F.col("region").alias("ra")), "a").join(regions.select(F.col("nid").alias("b"), F.col("region").alias("rb")), "b")
    return ends.filter("ra = rb").select("mid", F.col("ra").alias("region"))


def nearest_other_gap(sites: DataFrame, size: float, save) -> DataFrame:
    """One row: the mean distance from each site to its nearest other site, and how many sites have one."""
    spots = save(sites.filter(KNOWN).groupBy("x", "y", "z").agg(F.min("sid").alias("pid"), F.count("*").alias("n")))
    s = spots.select(F.col("pid").alias("sid"), *[F.col(c).alias(f"s{c}") for c in "xyz"])
    n_s, d = spots.count(), sub(vec("p"), vec("s"))
    gaps = spots.filter("n > 1").select(F.lit(0.0).alias("gap"), "n")  # sites in one place are each other's nearest

    def near(todo: DataFrame, size: float) -> DataFrame:
        p = todo.select("pid", *[F.col(c).alias(f"p{c}") for c in "xyz"])
        return _meet(p, s, size, 2 * todo.count() > n_s, F.col("pid") != F.col("sid")).groupBy("pid").agg(F.min(dot(d, d)).alias("d2"))

    if n_s > 1:
        start = fitted(size, lambda size: s.select(cell(vec("s"), size).alias("cell")))
        found = _settle(spots.filter("n = 1").select("pid", "x", "y", "z"), near, start, save, 12)
        gaps = gaps.unionByName(found.select(F.sqrt("d2").alias("gap"), F.lit(1).cast("long").alias("n")))
    return gaps.agg((F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("mean_gap"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def thin_greedily(sites: DataFrame, gap: float, save) -> DataFrame:
    """Keeps a site if none kept before it (by sid) is nearer than gap: the sequential rule, in rounds.

    A round keeps every undecided site without an undecided site before it within the
    gap, and drops the undecided ones near a kept site, until all are decided.
    """
    named = sites.select(F.col("sid").alias("pid"), "x", "y", "z")
    close = save(within(named, sites.select("sid", "x", "y", "z"), gap).filter(F.col("d2") < gap * gap).filter("sid < pid").select(F.col("sid").alias("early"), F.col("pid").alias("late")))
    todo, kept = save(sites.select("sid").distinct()), None
    while todo.limit(1).count():
        waits = close.join(todo.select(F.col("sid").alias("early")), "early", "left_semi").select(F.col("late").alias("sid")).distinct()
        new = save(todo.join(waits, "sid", "left_anti"))
        gone = close.join(new.select(F.col("sid").alias("early")), "early", "left_semi").select(F.col("late").alias("sid")).distinct()
        kept = new if kept is None else kept.unionByName(new)
        todo = save(todo.join(new, "sid", "left_anti").join(gone, "sid", "left_anti"))
    return sites.select("sid", "x", "y", "z").join(kept, "sid", "left_semi") if kept is not None else sites.select("sid", "x", "y", "z").limit(0)


def nearest_vectors(queries: DataFrame, rows: DataFrame, query_block: int = 1024, row_block: int = 2048) -> DataFrame:
    """(vec_id, nearest): the row of another id at the least cosine distance (to five decimals), the least id on ties; all rows are compared.

    Both sides are dealt to blocks by their id's hash; each pair of blocks is one group
    whose distances are one matrix product, and gives the least of each query.  Rows
    without a vector take no part; one of length 0 is further than all others.
    """
    import numpy as np
    import pyarrow as pa

    def matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids, e = t["vec_id"].to_numpy(), t["e"].combine_chunks()
        m = e.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        return ids, m / np.where((size := np.linalg.norm(m, axis=1, keepdims=True)) > 0, size, np.nan)

    def least(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"vec_id": pa.array([], pa.int64()), "dist": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        (a, x), (b, y) = matrix(left), matrix(right)
        order = np.argsort(b)
        b, y = b[order], y[order]
        d = np.nan_to_num(np.floor((1 - x @ y.T) * 1e5 + 0.5), nan=1e9).astype(np.int64)
        own = a[:, None] == b[None, :]
        d[own] = 1 << 60
        at = d.argmin(axis=1)  # the first of equals: the least id
        ok = ~own[np.arange(len(a)), at]
        return pa.table({"vec_id": a[ok].astype(np.int64), "dist": d[np.arange(len(a)), at][ok], "other": b[at][ok].astype(np.int64)})

    def dealt(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        df = df.filter("e is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "e")
        n = max(1, -(-df.count() // size))
        return df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")), n

    (q, nq), (r, nr) = dealt(queries, query_block, "qb"), dealt(rows, row_block, "rb")
    q = q.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    r = r.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(least, "vec_id long, dist long, other long")
    return found.groupBy("vec_id").agg(F.min(F.struct("dist", "other"))["other"].alias("nearest"))
