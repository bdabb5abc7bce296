"""Experiment analytics: aggregate, rank, filter and expand runs.

All functions take and return DataFrames.  Ranks and shares of a whole table are
counted block-wise (``ordered``); grouped top-k uses windows over already
aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import saver
from .ordered import _all_equal, first_share, ranked, running


def aggregate_configs(runs: DataFrame, by: str = "cfg") -> DataFrame:
    """Per configuration: mean score, accuracy and times, ok and failed runs, parts.

    runs: cfg, part, ok, score, accuracy, mesh_ms, solve_ms.
    """
    return runs.groupBy(by).agg(
        F.count("*").alias("n_runs"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_fail"),
        F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg("accuracy"), 6).alias("mean_accuracy"),
        F.round(F.avg("mesh_ms"), 6).alias("mean_mesh_ms"), F.round(F.avg("solve_ms"), 6).alias("mean_solve_ms"),
        F.array_join(F.sort_array(F.collect_set("part")), ",").alias("parts"),
    )


def rank(df: DataFrame, score: str = "mean_score", key: str = "cfg") -> DataFrame:
    """Adds rank from 1: best score first, then the key."""
    df = saver(df.sparkSession, "rank")(df)
    return ranked(df, score, [key]).withColumn("rank", F.col("rank").cast("int"))


def halving_trim(df: DataFrame, keep: float, score: str = "score", key: str = "cfg") -> DataFrame:
    """The best ceil(keep * n), at least one: score descending, key ascending."""
    return first_share(df, score, [key], keep, 1, descending=True)


def factor_breakdown(runs: DataFrame, config: str = "config") -> DataFrame:
    """Per (factor, level): the mean of configuration means, configurations, runs and the share of ok runs.

    runs: cfg, config (map), score, ok.  Runs are aggregated by configuration
    first, and only those few rows are unpivoted.
    """
    per = runs.groupBy("cfg", F.map_entries(config).alias("entries")).agg(F.avg("score").alias("m"), F.count("*").alias("n"), F.count_if("ok").alias("k"))
    flat = per.select("cfg", "m", "n", "k", F.explode("entries").alias("e"))
    return flat.groupBy(F.col("e.key").alias("factor"), F.col("e.value").alias("level")).agg(
        F.round(F.avg("m"), 6).alias("mean_score"), F.count("*").alias("n_configs"), F.sum("n").alias("n_runs"), F.round(F.sum("k") / F.sum("n"), 6).alias("ok_rate")
    )


def best_levels(levels: DataFrame) -> DataFrame:
    """Per factor the best level: mean, then ok rate, then name."""
    w = Window.partitionBy("factor").orderBy(F.desc("mean_score"), F.desc("ok_rate"), "level")
    return levels.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def presets(runs: DataFrame, conditions: list[str], by: str = "cfg", score: str = "score", top: int = 5) -> DataFrame:
    """The best configurations under each value of each condition column (grouping sets, then top-k)."""
    tags = F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).cast("string").alias("value")) for c in conditions])
    flat = runs.groupBy(*conditions, by).agg(F.sum(score).alias("s"), F.count(score).alias("n")).withColumn("t", F.explode(tags))
    means = flat.groupBy("t.condition", "t.value", by).agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean_score"), F.sum("n").alias("n_runs"))
    w = Window.partitionBy("condition", "value").orderBy(F.desc("mean_score"), by)
    return means.withColumn("place", F.row_number().over(w).cast("int")).filter(F.col("place") <= top)


def pareto_front(df: DataFrame, good: str, cost: str, part: list[str] | None = None) -> DataFrame:
    """Rows that none dominates (more good, less cost); equal points all stay.

    Points are first reduced to the best ``good`` for each cost; the running maximum
    over ascending costs is taken block-wise, and the front is joined back.
    """
    part = part or []
    per_cost = saver(df.sparkSession, "front")(df.filter(F.col(good).isNotNull() & F.col(cost).isNotNull()).groupBy(*part, cost).agg(F.max(good).alias("_best")))
    front = running(per_cost, F.col("_best"), "_before", cost, [], kind="max", inclusive=False, part=part)
    front = front.filter(F.col("_before").isNull() | (F.col("_best") > F.col("_before")))
    keys = [*part, cost, good]
    names = [f"_f{i}" for i in range(len(keys))]
    front = front.select(*[F.col("_best" if k == good else k).alias(n) for k, n in zip(keys, names, strict=True)])
    same = _all_equal(part, names[: len(part)]) & (F.col(cost) == F.col(names[-2])) & (F.col(good) == F.col(names[-1]))
    return df.join(front, same, "left_semi")  # parts may be null, a point without cost or good is never on the front


def best_level_by_name(levels: DataFrame) -> DataFrame:
    """Per factor the level of the best mean; the greatest name on ties."""
    return levels.groupBy("factor").agg(F.max(F.struct("mean_score", F.col("level").cast("string").alias("level"))).alias("m")).select("factor", "m.level", "m.mean_score")


def status_counters(runs: DataFrame) -> DataFrame:
    """One row: runs by status, least error among ok runs, load areas known and wrong."""
    return runs.agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") == "solve_suspect").alias("n_suspect"),
        F.count_if(~F.col("status").isin("ok", "solve_suspect")).alias("n_fail"), F.min(F.when(F.col("status") == "ok", F.col("rel_err"))).alias("min_rel_err"),
        F.count("area_ok").alias("area_known"), F.count_if(~F.col("area_ok")).alias("area_bad"),
    )


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not done yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def survivors_or_all(configs: DataFrame, survivors: DataFrame, key: str = "cfg") -> DataFrame:
    """Configurations that survive; all of them if none does."""
    found = configs.join(survivors.select(key).distinct(), key, "left_semi")
    return found if found.limit(1).count() else configs


def expand_grid(axes: dict[str, DataFrame]) -> DataFrame:
    """All combinations of the values of each axis (a one-column frame), distinct.  The product is the result."""
    out = None
    for name, values in axes.items():
        own = values.select(F.col(values.columns[0]).alias(name)).distinct()
        out = own if out is None else out.crossJoin(own)
    return out


def grid_size(grid: Column, n_parts: Column) -> Column:
    """How many runs a grid (map of arrays) makes: the product of its axes, times the parts."""
    return F.aggregate(F.map_values(grid), F.lit(1).cast("long"), lambda a, v: a * F.size(v)) * n_parts


def work_list(configs: DataFrame, parts: DataFrame, tiers: list[int], done: DataFrame | None = None) -> DataFrame:
    """(cfg, part, tier) of every run that is due."""
    spark = configs.sparkSession
    due = configs.select("cfg").crossJoin(parts.select("part")).crossJoin(spark.range(1).select(F.explode(F.array(*map(F.lit, tiers))).alias("tier")))
    return due if done is None else remaining(due, done, ["cfg", "part", "tier"])


def trend(results: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per key the values in order, as one comma-joined series with its length and ends."""
    series = F.sort_array(F.collect_list(F.struct(*order, value)))
    out = results.groupBy(*keys).agg(series.alias("s"))
    values = F.transform("s", lambda x: x[value].cast("string"))
    return out.select(*keys, F.size("s").alias("n"), F.array_join(values, ",").alias("series"), F.element_at("s", 1)[value].alias("first"), F.element_at("s", -1)[value].alias("last"))


def sparkline(values: Column, marks: str = "▁▂▃▄▅▆▇█", width: int = 24) -> Column:
    """Numbers scaled between their least and greatest to eight marks, a dot for a null; the lowest mark (at most ``width``) where all are equal."""
    low, high = F.array_min(values), F.array_max(values)
    place = lambda v: F.least(F.lit(len(marks) - 1), F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * (len(marks) - 1) + 1e-9).cast("int"))
    drawn = F.array_join(F.transform(values, lambda v: F.coalesce(F.substring(F.lit(marks), place(v) + 1, F.lit(1)), F.lit("·"))), "")
    return F.when(low.isNull(), "(no data)").when(high <= low, F.repeat(F.lit(marks[0]), F.least(F.lit(width), F.greatest(F.lit(1), F.size(values))))).otherwise(drawn)


def graded_pairs(graded: DataFrame, uniform: DataFrame, slack: float = 1e-4) -> DataFrame:
    """The pair (graded, uniform) of equal energy with fewer unknowns whose ratio of unknowns is greatest.

    graded, uniform: id, energy, dof.  The best partner of a graded run is the
    largest uniform run whose energy it reaches: a running maximum over energies.
    """
    side = lambda df, energy, best, own: df.select(energy.alias("e"), best.alias("best"), own.alias("own"))
    none = F.lit(None)
    u = side(uniform, F.col("energy") * (1 - slack), F.struct(F.col("dof").cast("double").alias("ud"), (-F.col("id")).cast("long").alias("u")), F.struct(none.cast("long").alias("g"), none.cast("double").alias("gd")))
    g = side(graded, F.col("energy").cast("double"), none.cast("struct<ud:double,u:bigint>"), F.struct(F.col("id").cast("long").alias("g"), F.col("dof").cast("double").alias("gd")))
    both = u.unionByName(g).withColumn("last", F.col("best").isNull())  # at equal energy the uniform runs come first
    found = running(both, F.col("best"), "top", "e", ["last"], kind="max").filter("last AND own.gd > 0 AND top.ud > own.gd")
    out = found.select("own.g", "own.gd", (-F.col("top.u")).alias("u"), "top.ud", (F.col("top.ud") / F.col("own.gd")).alias("ratio"))
    return out.orderBy(F.desc("ratio"), "g", "u").limit(1)
