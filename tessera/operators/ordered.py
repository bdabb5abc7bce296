"""Running aggregates and ranks over a whole table without sorting it in one task.

Tables (or parts of a table) of at most ``ONE_TASK`` rows are windowed as they
are; a count decides.  Larger ones are cut into blocks by quantiles of the leading
order column, and a leading value that fills blocks of its own is cut again by the
first tie column.  A running aggregate is that of the blocks before (one row a
block) combined with a window inside the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, NumericType
from pyspark.sql.window import Window

from ..session import saver

#: Rows that one task may sort.
ONE_TASK = 1_000_000


def _blocks(df: DataFrame) -> int:
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _bounds(df: DataFrame, column: str, n: int) -> list:
    """Some n - 1 values that cut the column's order into like shares (repeated where a value is heavy).

    Numbers are cut by approximate quantiles, all else by the order statistics of a
    sample of about 64 n values.  Where the cuts lie decides how even blocks are, never
    what is in order.
    """
    if isinstance(df.schema[column].dataType, NumericType):
        return df.approxQuantile(column, [i / n for i in range(1, n)], 1 / (8 * n))
    known = df.filter(F.col(column).isNotNull()).select(column)
    drawn = known.sample(min(1.0, 64 * n / max(1, known.count())), seed=5).limit(256 * n)
    values = sorted(r[0] for r in drawn.collect())
    return [values[len(values) * i // n] for i in range(1, n)] if values else []


def _place(df: DataFrame, column: str, bounds: list, descending: bool) -> Column:
    """How many bounds come before the value; nulls come first in ascending order and last in descending."""
    kind = df.schema[column].dataType
    edges = F.array(*[F.lit(b) for b in bounds]).cast(ArrayType(DoubleType() if isinstance(kind, NumericType) else kind))
    test = (lambda b: b > F.col(column)) if descending else (lambda b: b < F.col(column))
    return F.when(F.col(column).isNull(), F.lit(len(bounds) + 1 if descending else -1)).otherwise(F.size(F.filter(edges, test)))


def with_block(df: DataFrame, column: str, descending: bool = False, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds _block, ascending in the order (column, then the first of ``ties``): about as many rows in each."""
    n = _blocks(df)
    found = _bounds(df, column, n)
    bounds = sorted(set(found))
    out = df.withColumn("_block", _place(df, column, bounds, descending).cast("long") * (n + 2))
    heavy = sorted({a for a, b in zip(found, found[1:], strict=False) if a == b})
    if heavy and ties:
        same = F.col(column).isin(heavy)
        inner = sorted(set(_bounds(df.filter(same), ties[0], n)))
        if inner:
            out = out.withColumn("_block", F.when(same, F.col("_block") + 1 + _place(df, ties[0], inner, False)).otherwise(F.col("_block")))
    return out


def _all_equal(columns: list[str], other: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(columns, other, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def running(df: DataFrame, value: Column, name: str, lead: str, ties: list[str], kind: str = "sum", descending: bool = False, inclusive: bool = True, part: list[str] | None = None) -> DataFrame:
    """Adds ``name``: the running sum or max of ``value`` in the order lead, ties (with or without the row itself).

    The input is read several times: hand over a scan or a written table.  Parts may
    be null; they are parts like any other.
    """
    part = part or []
    agg = {"sum": F.sum, "max": F.max}[kind]
    order = [F.desc(lead) if descending else F.asc(lead), *ties]
    end = Window.currentRow if inclusive else -1
    largest = df.groupBy(*part).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] if part else df.count()
    if (largest or 0) <= ONE_TASK:
        return df.withColumn(name, agg(value).over(Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)))
    df = with_block(df, lead, descending, tuple(ties)).withColumn("_v", value)
    inside = Window.partitionBy(*part, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy(*part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*part, "_block"]
    base = df.groupBy(*keys).agg(agg("_v").alias("_t")).select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)], agg("_t").over(before).alias("_base"))
    same = _all_equal(keys, [f"_p{i}" for i in range(len(keys))])
    out = df.withColumn("_in", agg("_v").over(inside)).join(base if part else F.broadcast(base), same, "left")  # without parts: a row a block
    both = F.coalesce(F.col("_in") + F.col("_base"), "_in", "_base") if kind == "sum" else F.greatest("_in", "_base")
    return out.withColumn(name, both).drop("_block", "_v", "_in", "_base", *[f"_p{i}" for i in range(len(keys))])


def dorfler_mark(df: DataFrame, eta: str, theta: float, ties: list[str]) -> DataFrame:
    """Adds marked: the least prefix in descending eta (then ``ties``) whose squares reach theta of their total; none at total 0.

    Only the cut is ordered.  Sums by value interval find the interval that holds it,
    and that one is cut again until it has few rows or one value: whatever lies above
    is marked, whatever lies below is not.  Values are taken relative to the largest,
    so any magnitude will do.  Nulls are not marked.
    """
    if not 0 < theta <= 1:
        raise ValueError("theta must be in (0, 1]")
    n = _blocks(df)
    value = F.col(eta).cast("double")
    cuts = F.array(*[F.lit(i / n) for i in range(1, n)])
    one = df.agg(F.max(F.abs(value)).alias("top"), F.count(value).alias("n"), F.percentile_approx(value, cuts, F.lit(8 * n)).alias("bounds")).first()
    top, rows, bounds = one["top"], one["n"], sorted(set(one["bounds"] or ()))
    if not top:
        return df.withColumn("marked", F.lit(False))
    square = (value / top) * (value / top)
    low, high, before, total = float("-inf"), float("inf"), 0.0, None
    while True:
        # Intervals (bound, next bound], from the largest down.
        inside = df.filter((value > low) & (value <= high)) if total is not None else df.filter(value.isNotNull())
        edges = F.array(*[F.lit(b) for b in bounds]).cast("array<double>")
        sums = inside.groupBy(F.size(F.filter(edges, lambda b: b < value)).alias("at")).agg(F.sum(square).alias("s"), F.count("*").alias("n")).orderBy(F.desc("at")).collect()  # a row an interval
        if total is None:
            total = sum(r["s"] for r in sums)
            if not total > 0:
                return df.withColumn("marked", F.lit(False))
        for r in sums:
            if before + r["s"] >= theta * total or r is sums[-1]:
                break
            before += r["s"]
        limits = [low, *bounds, high]
        low, high, last, rows = limits[r["at"]], limits[r["at"] + 1], rows, r["n"]
        if rows <= ONE_TASK or rows == last and len(sums) == 1:
            break
        bounds = [b for b in sorted(set(df.filter((value > low) & (value <= high)).approxQuantile(eta, [i / n for i in range(1, n)], 1 / (8 * n)))) if low < b < high]
        if not bounds:
            break
    cut = running(df.filter((value > low) & (value <= high)), square, "_before", eta, ties, descending=True, inclusive=False)
    cut = cut.withColumn("marked", F.coalesce("_before", F.lit(0.0)) + before < theta * total).drop("_before")
    rest = df.filter(value.isNull() | (value <= low) | (value > high)).withColumn("marked", F.coalesce(value > high, F.lit(False)))
    return rest.unionByName(cut)


def ranked(df: DataFrame, lead: str, ties: list[str], name: str = "rank", descending: bool = True) -> DataFrame:
    """Adds a rank from 1 over the whole table."""
    return running(df, F.lit(1).cast("long"), name, lead, ties, descending=descending)


def dense_ids_from(df: DataFrame, keys: list[str], name: str, first: int) -> DataFrame:
    """Adds numbers from ``first`` on in the order of distinct keys."""
    return ranked(df, keys[0], keys[1:], name, descending=False).withColumn(name, F.col(name) + (first - 1))


def first_share(df: DataFrame, lead: str, ties: list[str], share: float, least: int, descending: bool, up: bool = True) -> DataFrame:
    """The first ceil (or floor) of share * n rows, at least ``least``, in the order lead, ties."""
    df = saver(df.sparkSession, "first-share")(df)
    want = share * df.count()
    most = max(least, -int(-want // 1) if up else int(want))
    return ranked(df, lead, ties, "_rank", descending).filter(F.col("_rank") <= most).drop("_rank")


def cut_nearest(df: DataFrame, part: list[str], lead: str, ties: list[str], area: str, target: Column) -> DataFrame:
    """Keeps, per part, the prefix in descending ``lead`` whose running area comes nearest to the target; all if within 5 % of it."""
    save = saver(df.sparkSession, "cut")
    df = save(df.withColumn("_target", target))
    largest = df.groupBy(*part).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= ONE_TASK:
        return with_cut(df, part, lead, ties, area, F.col("_target")).filter("_stays").drop("_target", "_stays")
    summed = running(df, F.col(area), "_acc", lead, ties, descending=True, part=part)
    ranked_ = save(running(save(summed), F.lit(1), "_rn", lead, ties, descending=True, part=part))
    cut = F.min(F.struct(F.abs(F.col("_acc") - F.col("_target")).alias("e"), F.col("_rn").alias("rn")))
    whole = ranked_.groupBy(*part).agg(F.sum(area).alias("_all"), cut.alias("_cut")).select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(part)], "_all", F.col("_cut.rn").alias("_cut"))
    out = ranked_.join(whole, _all_equal(part, [f"_p{i}" for i in range(len(part))]))
    return out.filter((F.col("_all") <= 1.05 * F.col("_target")) | (F.col("_rn") <= F.col("_cut"))).drop("_acc", "_rn", "_target", "_all", "_cut", *[f"_p{i}" for i in range(len(part))])


def with_cut(df: DataFrame, part: list[str], lead: str, ties: list[str], area: str, target: Column) -> DataFrame:
    """Adds _stays: whether ``cut_nearest`` keeps the row.  Parts must be no larger than one task may sort; rows are dealt once."""
    whole = Window.partitionBy(*part)
    upto = whole.orderBy(F.desc(lead), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({"_acc": F.sum(area).over(upto), "_rn": F.count("*").over(upto)})
    cut = F.min(F.struct(F.abs(F.col("_acc") - target).alias("e"), F.col("_rn").alias("rn"))).over(whole)
    df = df.withColumns({"_all": F.sum(area).over(whole), "_cut": cut})
    return df.withColumn("_stays", F.coalesce((F.col("_all") <= 1.05 * target) | (F.col("_rn") <= F.col("_cut")["rn"]), F.lit(False))).drop("_acc", "_rn", "_all", "_cut")


def largest_gap(df: DataFrame, part: list[str], angle: str, period: Column | float) -> DataFrame:
    """Per part the largest gap between neighbouring angles on a circle, wrap-around included."""
    gaps = running(df, F.col(angle), "_last", angle, [], kind="max", inclusive=False, part=part).withColumn("_gap", F.col(angle) - F.col("_last"))
    return gaps.groupBy(*part).agg(F.count("*").alias("n"), F.greatest(F.coalesce(F.max("_gap"), F.lit(0.0)), F.min(angle) + period - F.max(angle)).alias("max_gap"))


def merged_crossings(crossings: DataFrame, key: str, at: str, eps: float) -> DataFrame:
    """(key, at): the crossings of each key without those that lie within eps of the last one kept.

    Runs of crossings with steps of at most eps are told apart by the step before;
    only inside a run longer than eps is the rule followed one by one.
    """
    save = saver(crossings.sparkSession, "crossings")
    once = save(crossings.select(key, at).filter(F.col(at).isNotNull()).distinct())
    steps = running(once, F.col(at), "_last", at, [], kind="max", inclusive=False, part=[key])
    steps = save(steps.withColumn("_first", F.coalesce(F.col(at) - F.col("_last") > eps, F.lit(True)).cast("int")))
    starts = running(steps, F.col("_first"), "_run", at, [], part=[key])
    runs = starts.groupBy(key, "_run").agg(F.min(at).alias("_low"), F.max(at).alias("_high"), F.sort_array(F.collect_list(at)).alias("_all"))
    step = lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > eps), F.concat(acc, F.array(x))).otherwise(acc)
    kept = F.when(F.col("_high") - F.col("_low") <= eps, F.array("_low")).otherwise(F.aggregate("_all", F.array().cast("array<double>"), step))
    return runs.select(key, F.explode(kept).alias(at))


def parity_inside(crossings: DataFrame, queries: DataFrame, key: str, at: str, z: str, eps: float = 1e-9) -> DataFrame:
    """For query points on rays: crossings at or below z after merging those within eps of the last kept; odd is inside."""
    kept = merged_crossings(crossings.withColumn(at, F.col(at).cast("double")), key, at, eps)
    names = queries.columns
    both = kept.select(F.col(key).alias("_k"), F.col(at).alias("_z"), F.lit(1).alias("_one"), F.lit(None).cast(queries.schema.simpleString()).alias("_q"))
    own = queries.select(F.col(key).alias("_k"), F.col(z).cast("double").alias("_z"), F.lit(0).alias("_one"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_q"))
    both = saver(queries.sparkSession, "parity")(both.unionByName(own).withColumn("_after", 1 - F.col("_one")))
    out = running(both, F.col("_one"), "n_below", "_z", ["_after"], part=["_k"]).filter("_one = 0")  # at equal height crossings come first
    out = out.select("_q.*", F.when(F.col("_z").isNull() | F.col("_k").isNull(), F.lit(0)).otherwise(F.col("n_below")).alias("n_below"))
    return out.withColumn("inside", F.col("n_below") % 2 == 1)


def lower_rank_quantile(df: DataFrame, by: list[str], value: str, q: float, accuracy: int = 10_000) -> DataFrame:
    """sorted[floor(q (n - 1))] per group, exact.

    Approximate quantiles bracket the wanted rank; only the distinct values inside the
    bracket (a few ten-thousandths of a group, each with its count) are ordered, on
    top of the number of values below it.
    """
    known, step = df.filter(F.col(value).isNotNull()), 2 / accuracy
    ends = F.percentile_approx(value, F.array(F.lit(max(0.0, q - step)), F.lit(min(1.0, q + step))), F.lit(accuracy))
    bracket = known.groupBy(*by).agg(F.count("*").alias("_all"), ends.alias("_e"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    few = F.col("_all") <= accuracy  # two ranks are more than the step
    low = F.col("_min") if q <= step else F.when(few, F.col("_min")).otherwise(F.element_at("_e", 1))
    high = F.col("_max") if q + step >= 1 else F.when(few, F.col("_max")).otherwise(F.element_at("_e", 2))
    names = [f"_b{i}" for i in range(len(by))]
    bracket = saver(df.sparkSession, "bracket")(bracket.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], "_all", low.alias("_low"), high.alias("_high")))
    placed = known.select(*by, value).join(bracket, _all_equal(by, names)).filter(F.col(value) <= F.col("_high"))
    inside = F.when(F.col(value) >= F.col("_low"), F.col(value))  # null: below the bracket
    counts = placed.groupBy(*by, inside.alias("_v")).agg(F.count("*").alias("_n"), F.first("_all").alias("_all"))
    upto = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v"))))
    return upto.filter(F.col("_v").isNotNull() & (F.col("_upto") > F.floor(q * (F.col("_all") - 1)))).groupBy(*by).agg(F.min("_v").alias("quantile"), F.first("_all").alias("n"))


def unset_offsets(lengths: DataFrame, order: str, length: str) -> DataFrame:
    """Lengths to cumulative end offsets, in the given order."""
    return running(lengths, F.col(length).cast("long"), "offset", order, [])


def offsets_to_lengths(df: DataFrame, order: str, offset: str) -> DataFrame:
    """Cumulative offsets back to lengths: each less the one before."""
    previous = running(df, F.col(offset), "_prev", order, [], kind="max", inclusive=False)
    return previous.withColumn("length", F.col(offset) - F.coalesce("_prev", F.lit(0))).drop("_prev")
