"""Protecting balls: radii from local feature size, and a maximal set of them that is independent.

``independent_balls`` takes candidates in the order of their priority: the binary
exponent of the radius (large balls first), then a hash of the id.  The result is what
one pass over the candidates in that order would choose.  Instead of a pass there are
rounds: in each grid cell only the candidate of highest priority can be the next one,
and it is chosen if it precedes those of all cells within reach.  So a round compares
one candidate a cell with at most 124 others, however crowded a cell is.  Chosen balls
then drop what they exclude, and the rest goes into the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dot, sub, vec
from ..operators.spatial import cell, spread, within

#: Radius as a share of the size and of the local feature size; separation as a share of the larger radius.
OF_SIZE, OF_FEATURE, APART = 0.45, 1 / 3, 0.55


def protecting_radii(samples: DataFrame, h: float, save) -> DataFrame:
    """(sid, edge, x, y, z, r) from samples of sharp edges (edge, pos, x, y, z).

    The radius is 0.45 h, or a third of the local feature size if that is less: the
    distance to the samples of other edges, but for those at this edge's own ends.
    Within two radii of an end of any edge it is halved.
    """
    s = save(samples.select("edge", "pos", "x", "y", "z").withColumn("sid", F.xxhash64("edge", "pos")))
    at = F.struct("pos", "x", "y", "z")
    ends = save(s.groupBy("edge").agg(F.min(at).alias("a"), F.max(at).alias("b")))
    corners = ends.select("edge", F.explode(F.array("a", "b")).alias("c")).select("edge", "c.x", "c.y", "c.z")
    reach = OF_SIZE / OF_FEATURE * h  # beyond it the feature size has no say
    spots = s.select(F.col("sid").alias("pid"), "x", "y", "z")
    near = within(spots, s, reach).join(s.select(F.col("sid").alias("pid"), F.col("edge").alias("own")), "pid").join(s.select("sid", "edge", "x", "y", "z"), "sid").filter("edge <> own")
    near = near.join(ends.select(F.col("edge").alias("own"), "a", "b"), "own")
    off = lambda e: (F.col("x") - F.col(f"{e}.x")) ** 2 + (F.col("y") - F.col(f"{e}.y")) ** 2 + (F.col("z") - F.col(f"{e}.z")) ** 2
    feature = near.filter((off("a") >= (1e-4 * h) ** 2) & (off("b") >= (1e-4 * h) ** 2)).groupBy(F.col("pid").alias("sid")).agg(F.sqrt(F.min("d2")).alias("lfs"))
    r = F.least(F.lit(OF_SIZE * h), OF_FEATURE * F.coalesce("lfs", F.lit(reach)))
    sized = save(s.join(feature, "sid", "left").withColumn("r", r))
    ids = corners.select("x", "y", "z").distinct().withColumn("sid", F.xxhash64("x", "y", "z"))
    end = within(spots, ids, 2 * OF_SIZE * h).groupBy(F.col("pid").alias("sid")).agg(F.sqrt(F.min("d2")).alias("d"))
    halved = F.when(F.col("d") < 2 * F.col("r"), 0.5 * F.col("r")).otherwise(F.col("r"))
    return sized.join(end, "sid", "left").select("sid", "edge", "x", "y", "z", F.greatest(halved, F.lit(1e-9 * h)).alias("r"))


def _drop_excluded(rest: DataFrame, chosen: DataFrame, size: float, apart: float) -> DataFrame:
    """The candidates that no chosen ball (of reach ``size``) excludes, each chosen ball itself included.

    No side is broadcast: chosen balls are spread over 27 cells, which Spark's estimate of their size does not count.
    """
    c = chosen.select(*[F.col(x).alias(f"c{x}") for x in ("x", "y", "z", "r")]).withColumn("cell", F.explode(spread(cell(vec("c"), size), 1)))
    d = sub(vec(""), vec("c"))
    gone = rest.withColumn("cell", cell(vec(""), size)).hint("merge").join(c, "cell").filter(dot(d, d) < F.pow(apart * F.greatest("r", "cr"), F.lit(2.0))).select("sid")
    return rest.hint("merge").join(gone, "sid", "left_anti")


def independent_balls(sites: DataFrame, save, apart: float = APART) -> DataFrame:
    """The chosen of ``sites`` (sid, x, y, z, r): no two nearer than ``apart`` times the larger radius, and none could be added.

    Sites without a place or a positive radius are left out.  Of sites in one place
    one is chosen at most.
    """
    level = F.floor(F.log2("r")).cast("int")
    rest = save(sites.filter("r > 0 AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").select("sid", "x", "y", "z", "r").withColumn("level", level).withColumn("first", F.struct(F.xxhash64("sid"), "sid")))
    chosen = rest.drop("level", "first").limit(0)
    for at in sorted((x["level"] for x in rest.select("level").distinct().collect()), reverse=True):  # binary exponents
        size, picked = apart * 2.0 ** (at + 1), None  # exclusion reaches no further
        todo = rest.filter(F.col("level") == at)
        while True:
            best = save(todo.groupBy(cell(vec(""), size / 2).alias("cell")).agg(F.min(F.struct("first", "sid", "x", "y", "z", "r")).alias("b")))
            if best.isEmpty():
                break
            around = best.select("cell", "b", F.explode(spread(F.col("cell"), 2)).alias("near")).hint("merge").join(best.select(F.col("cell").alias("near"), F.col("b.first").alias("other")), "near")
            wins = save(around.groupBy("b.sid").agg(F.min("b").alias("b"), F.min("other").alias("other")).filter("b.first = other").select("b.sid", "b.x", "b.y", "b.z", "b.r"))
            picked = wins if picked is None else picked.unionByName(wins)
            todo = save(_drop_excluded(todo, wins, size, apart))
        if picked is not None:
            chosen = chosen.unionByName(picked)
            rest = save(_drop_excluded(rest.filter(F.col("level") < at), picked, size, apart))
    return chosen
