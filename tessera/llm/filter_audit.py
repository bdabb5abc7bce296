"""Filter interaction audit by inclusion and exclusion.

What a chain of filters removes depends on their order.  Instead of running every
order, one aggregation counts for each set T of filters the documents that fail all
of T (sums of flag products, 2^n of them); everything else is arithmetic on those:

* survivors of a set m: the Möbius sum over T within m of (-1)^|T| J[T];
* removed by a step: the difference of two survivors;
* redundant: J[{filter}] less what the step removed;
* failing one filter only: the sum over T holding it of (-1)^(|T|-1) J[T];
* Shapley value: the game "documents that a set of filters removes" has the Harsanyi
  dividends (-1)^(|T|+1) J[T], and each is shared evenly by the members of T.
  Summed over all n! orders instead of averaged, it is a whole number.

``failures`` gives the five filters of the audit query, ``joint_failures`` and
``audit`` take any filters (up to 8).

Nulls, empties, repeats: a null text is empty, and equal to an empty one.  A null
part is the empty string.  Repeated rows count each; rows of one id don't make each
other duplicates, as no id is smaller.  A row without id is nobody's duplicate and
makes none.  A document is good or toxic if any label row of its id says so.  An
empty table gives no rows.  Long texts are read whole.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import fold, if_small

_SPACE = " \t\n\x0b\x0c\r"
CLASSES = ("all", "good", "toxic")


def _long(condition: Column) -> Column:
    return condition.cast("long")


def text_failures(text: Column) -> dict[str, Column]:
    """The conditions A to D of one text: few words, few distinct words, many capitals, symbols."""
    bare = F.btrim(text, F.lit(_SPACE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {"A": F.size(words) < 100, "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"), "C": 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), "D": text.rlike("[#$%&*|]")}


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, A to E as 0 or 1, good, toxic, n): documents counted by what they fail.

    E is a copy of a smaller id's text, in any part.  Texts travel as their SHA-256.
    Rows are counted by text and id, then by text, part and labels, before the
    smallest id of a text is looked up: however many copies a text has, it has one row
    left for each part and label.
    """
    src = fold(docs, id_col, text_col, part_col).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = src.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), *[_long(c).alias(k) for k, c in text_failures(F.col("text")).items()])
    said = fold(labels, "doc_id", "quality", "toxic").filter("doc_id is not null and (quality = 1 or toxic = 1)")
    said = said.groupBy("doc_id").agg(F.max(_long(F.coalesce(F.col("quality") == 1, F.lit(False)))).alias("good"), F.max(_long(F.coalesce(F.col("toxic") == 1, F.lit(False)))).alias("toxic"))
    rows = rows.join(if_small(said), "doc_id", "left").fillna(0, ["good", "toxic"])
    same = ["key", "part", "A", "B", "C", "D", "good", "toxic"]
    by_id = rows.groupBy(*same, "doc_id").agg(F.count("*").alias("n"))
    known = F.col("doc_id").isNotNull()
    by_text = by_id.groupBy(*same).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("no_id"), F.min("doc_id").alias("low"), F.min_by(F.when(known, F.col("n")), "doc_id").alias("n_low"))
    first = F.min("low").over(Window.partitionBy("key"))
    free = F.col("no_id") + F.when(F.col("low") == first, F.col("n_low")).otherwise(0)
    found = by_text.withColumn("free", free)
    split = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("E"), F.col("free").alias("n")), F.struct(F.lit(1).cast("long").alias("E"), (F.col("n") - F.col("free")).alias("n"))))
    return found.select("part", "A", "B", "C", "D", "good", "toxic", split.alias("x")).select("part", "A", "B", "C", "D", F.col("x.E").alias("E"), "good", "toxic", F.col("x.n").alias("n")).filter("n > 0")


def joint_failures(flagged: DataFrame, filters: str) -> DataFrame:
    """One row per part with an array for each class: entry T counts the documents failing every filter of the bit set T."""
    every = range(1 << len(filters))
    product = lambda t, weights: " * ".join(weights + [f for i, f in enumerate(filters) if t >> i & 1])
    sums = [F.expr(f"sum({product(t, ['n'] if c == 'all' else ['n', c])})").cast("long").alias(f"{c}_{t}") for c in CLASSES for t in every]
    return flagged.groupBy("part").agg(*sums).select("part", *[F.array(*[f"{c}_{t}" for t in every]).alias(f"joint_{c}") for c in CLASSES])


def _sign(t: int) -> int:
    return -1 if t.bit_count() % 2 else 1


def _sums(column: str, weights: list[dict[int, int]]) -> Column:
    """An array of weighted sums of the entries of an array column."""
    return F.expr("array(" + ", ".join(" + ".join(f"{w}L * {column}[{t}]" for t, w in one.items()) for one in weights) + ")")


def audit(joint: DataFrame, filters: str) -> DataFrame:
    """One row per part, order of the filters and step: what that step does there.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (see the
    module).  ``filters`` are single letters, the bits of ``joint`` in that order.
    """
    n = len(filters)
    if n > 8:
        raise ValueError("all orders of more than 8 filters are too many to list")
    every = range(1 << n)
    holding = [[t for t in every if t >> i & 1] for i in range(n)]
    kept = [{t: _sign(t) for t in every if t & m == t} for m in every]
    whole = joint.select(
        "part", *[_sums(f"joint_{c}", kept).alias(f"kept_{c}") for c in CLASSES], _sums("joint_all", [{1 << i: 1} for i in range(n)]).alias("alone"),
        _sums("joint_all", [{t: -_sign(t) for t in ts} for ts in holding]).alias("only"), _sums("joint_all", [{t: -_sign(t) * (math.factorial(n) // t.bit_count()) for t in ts} for ts in holding]).alias("shares"),
    )
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(sorted(filters))])).alias("filter_order")
    steps = whole.select("*", orders).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    bits = lambda upto: reduce(lambda a, b: a + b, (F.when(F.instr(F.substring("filter_order", F.lit(1), upto), f) > 0, 1 << i).otherwise(0) for i, f in enumerate(filters)))
    steps = steps.select("*", bits(F.col("step") - 1).alias("before"), bits(F.col("step")).alias("after"), (F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))) - 1).alias("i"))
    gone = lambda c: F.col(f"kept_{c}")[F.col("before")] - F.col(f"kept_{c}")[F.col("after")]
    own = lambda c: F.col(c)[F.col("i")]
    return steps.select("part", "filter_order", "step", F.col("kept_all")[F.col("after")].alias("kept"), gone("all").alias("removed"), (own("alone") - gone("all")).alias("redundant"), own("only").alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), own("shares").alias("shapley"))
