"""Ball packings of the unit cube: seeds on edges and inside, pushed apart until they hardly overlap, and what they fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import hash01
from ..operators.spatial import packing_fill, within
from .relax import bubble

#: Fixed value: how far a seed inside is shifted from its cell's centre at most, in spacings.
JITTER = 0.15


def edge_seeds(spark: SparkSession, spacing: float) -> DataFrame:
    """(x, y, z): points along the twelve edges, corners once."""
    n = max(2, round(1 / spacing) + 1)
    edge, t = F.floor(F.col("id") / n), F.col("id") % n / (n - 1)
    axis, side = F.floor(edge / 4), edge % 4
    at = lambda a: F.when(axis == a, t).when((a - axis + 3) % 3 == 1, side % 2).otherwise(F.floor(side / 2)).cast("double")
    return spark.range(12 * n).select(*[at(a).alias(c) for a, c in enumerate("xyz")]).distinct()


def volume_seeds(spark: SparkSession, spacing: float, seed: int = 0) -> DataFrame:
    """(x, y, z): a shifted point in each cell of a lattice, none within half a spacing of a face."""
    n = max(2, int(1 / spacing))
    place = (F.col("id") % n, F.floor(F.col("id") / n) % n, F.floor(F.col("id") / (n * n)))
    at = [(p + 0.5) / n + (2 * hash01(F.col("id") * 3 + a, seed) - 1) * JITTER * spacing for a, p in enumerate(place)]
    clear = F.least(*[F.least(x, 1 - x) for x in at]) >= 0.5 * spacing
    return spark.range(n**3).filter(clear).select(*[x.alias(c) for x, c in zip(at, "xyz", strict=True)])


def worst_overlap(sites: DataFrame, spacing: float) -> float:
    """How much nearer than ``spacing`` the nearest two free or free and fixed sites are, as a share of it."""
    a = sites.select(F.col("sid").alias("pid"), "x", "y", "z").join(sites.filter("NOT fixed").select(F.col("sid").alias("pid")), "pid", "left_semi")
    near = within(a, sites, spacing).filter("pid <> sid").agg(F.min("d2")).first()[0]
    return 0.0 if near is None else 1 - near**0.5 / spacing


def push_apart(sites: DataFrame, spacing: float, save, enough: float = 0.02, stall: float = 0.01, most: int = 100) -> tuple[DataFrame, list[float]]:
    """(sites inside the cube, the worst overlap before and after each round).

    sites: sid, x, y, z, fixed.  Rounds end when the worst overlap is ``enough`` or
    three rounds together lessen it by a share of less than ``stall`` (a cube too full
    for its balls), so the caller sees from the list which of both it was.
    """
    sites = save(sites)
    seen = [worst_overlap(sites, spacing)]
    while seen[-1] > enough and len(seen) <= most and (len(seen) < 4 or seen[-1] < (1 - stall) * seen[-4]):
        moved = bubble(sites, spacing, save, 1)
        sites = save(moved.select("sid", *[F.when(F.col("fixed"), F.col(c)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))).alias(c) for c in "xyz"], "fixed"))
        seen.append(worst_overlap(sites, spacing))
    return sites, seen


def pack_cube(spark: SparkSession, spacing: float, save, seed: int = 0) -> tuple[DataFrame, dict]:
    """(sites, measures) of the unit cube: edge seeds stay, inner ones are pushed apart; the share filled and the mean gap of edge seeds to their nearest other."""
    from ..operators.ordered import dense_ids_from

    both = edge_seeds(spark, spacing).withColumn("fixed", F.lit(True)).unionByName(volume_seeds(spark, spacing, seed).withColumn("fixed", F.lit(False)))
    sites, seen = push_apart(dense_ids_from(save(both), ["x", "y", "z"], "sid", 0), spacing, save)
    edge = sites.filter("fixed")
    own = edge.select(F.col("sid").alias("pid"), "x", "y", "z")
    close = within(own, sites, spacing * 1.5).filter("pid <> sid").groupBy("pid").agg(F.sqrt(F.min("d2")).alias("gap"))
    row = sites.agg(F.count_if("fixed").alias("e"), F.count_if(~F.col("fixed")).alias("v")).first()
    fill = packing_fill(sites, 0.5 * spacing, 1.0).first()["fill"]
    return sites, {"n_edge": row["e"], "n_volume": row["v"], "fill": fill, "gap": close.agg(F.avg("gap")).first()[0], "overlaps": seen}
