"""Pattern matches with positions, in column expressions only.

``regexp_extract_all`` gives the matches and ``split`` by the same pattern the text
between them; running sums of their lengths turn both into start and end, counted
in code points.  Everything is linear in the matches of a text: sums are taken in
chunks, context comes from the text between matches, overlaps are looked up by
binary search.  Patterns use possessive quantifiers and anchors at run starts so
that no text makes them quadratic; they match what the plain patterns match.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,text:string,left:string,right:string>>"
CHUNK = 64


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _plain_sums(values: Column) -> Column:
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, begin, step, lambda acc: acc["out"])


def _chunked_sums(values: Column, depth: int) -> Column:
    first = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int"))

    def joined_up(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x))
        bases = _plain_sums(totals) if depth == 1 else let(totals, lambda t: _chunked_sums(t, depth - 1))
        return F.flatten(F.zip_with(chunks, bases, lambda c, b: F.transform(_plain_sums(c), lambda s: s + b)))

    return let(F.transform(first, lambda c: F.slice(values, c * CHUNK + 1, F.lit(CHUNK))), joined_up)


def sums_before(values: Column) -> Column:
    """For each of the integers the sum of those before it."""
    return let(values, lambda v: F.when(F.size(v) <= CHUNK, _plain_sums(v)).otherwise(_chunked_sums(v, 2)))


def matches(text: Column, pattern: str, when: Column | None = None, left: int = 0, right: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, text, left, right).

    left and right are so many code points of the text around, at most up to the
    match before and after.
    """

    def spans(s: Column) -> Column:
        found, gaps = s["found"], s["gaps"]
        at = F.sequence(F.lit(1), F.size(found))
        steps = F.transform(at, lambda i: F.length(F.element_at(gaps, i)) + F.length(F.element_at(found, i)))
        sums = F.zip_with(at, sums_before(steps), lambda i, b: F.struct(i.alias("i"), b.alias("b")))

        def one(x: Column) -> Column:
            start = x["b"] + F.length(F.element_at(gaps, x["i"]))
            own = F.element_at(found, x["i"])
            around = [F.right(F.element_at(gaps, x["i"]), F.lit(left)) if left else F.lit(""), F.left(F.element_at(gaps, x["i"] + 1), F.lit(right)) if right else F.lit("")]
            return F.struct(start.alias("start"), (start + F.length(own)).alias("end"), own.alias("text"), around[0].alias("left"), around[1].alias("right"))

        return F.when(F.size(found) > 0, F.transform(sums, one)).otherwise(F.array().cast(SPAN))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    test = F.regexp_like(text, F.lit(pattern)) if when is None else when & F.regexp_like(text, F.lit(pattern))
    return F.when(test, let(both, spans)).otherwise(F.array().cast(SPAN))


def starting_before(spans: Column, at: Column) -> Column:
    """How many of the spans, ascending by start, start before ``at``."""

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        right = F.element_at(spans, middle + 1)["start"] < at
        done = acc["low"] >= acc["high"]
        return F.struct(F.when(~done & right, middle + 1).otherwise(acc["low"]).alias("low"), F.when(~done & ~right, middle).otherwise(acc["high"]).alias("high"))

    rounds = F.sequence(F.lit(1), F.length(F.bin(F.size(spans).cast("long"))))
    begin = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))
    return F.when(F.size(spans) == 0, F.lit(0)).otherwise(F.aggregate(rounds, begin, halve, lambda acc: acc["low"]))


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of the spans (disjoint, ascending) overlaps start..end: only the last that starts before ``end`` can."""
    return let(starting_before(spans, end), lambda n: F.when(n > 0, F.element_at(spans, n)["end"] > start).otherwise(F.lit(False)))


def strongest(spans: Column, longest: int, rounds: int = 2) -> Column:
    """Of spans (start, end, p, kind; ascending) that overlap, those of the greatest p; then the longer, the earlier, the lower kind.

    That is what taking the strongest again and again leaves.  No span is longer than
    ``longest``, so only near ones are compared.  Spans whose rivals all lost are
    compared once more in each further round; what is open after those (the inside of
    long chains) is taken one by one.
    """
    strength = lambda s: F.struct(s["p"], s["end"] - s["start"], -s["start"], -s["kind"])

    def beaten(all_of: Column, c: Column) -> Column:
        low, high = starting_before(all_of, c["start"] - longest), starting_before(all_of, c["end"])
        near = let(F.struct(low.alias("low"), high.alias("high")), lambda r: F.slice(all_of, r["low"] + 1, r["high"] - r["low"]))
        return F.exists(near, lambda d: (d["end"] > c["start"]) & (strength(d) > strength(c)))

    def one_by_one(left: Column) -> Column:
        ranked = F.reverse(F.array_sort(F.transform(left, lambda c: F.struct(strength(c).alias("s"), c.alias("c")))))
        free = lambda kept, c: ~F.exists(kept, lambda k: (k["end"] > c["start"]) & (c["end"] > k["start"]))
        return F.aggregate(F.transform(ranked, lambda r: r["c"]), F.slice(left, 1, 0), lambda kept, c: F.when(free(kept, c), F.concat(kept, F.array(c))).otherwise(kept))

    def pick(left: Column, more: int) -> Column:
        if not more:
            return one_by_one(left)
        won = F.filter(left, lambda c: ~beaten(left, c))
        rest = lambda w: F.filter(left, lambda c: ~overlaps(w, c["start"], c["end"]))
        return let(won, lambda w: let(rest(w), lambda r: F.when(F.size(r) == 0, w).otherwise(F.concat(w, pick(r, more - 1)))))

    return let(spans, lambda s: F.when(F.size(s) <= 1, s).otherwise(F.array_sort(pick(s, rounds))))


def joined(spans: Column) -> Column:
    """kind:start:end of (kind, start, end, ...) structs, comma-joined in their order."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kind(spans: Column, kind: str, order: int) -> Column:
    """Adds the kind and its place among the kinds."""
    return F.transform(spans, lambda s: F.struct(F.lit(order).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def normal_tail(z: Column) -> Column:
    """Two-sided tail probability of a standard normal, by a rational approximation (error below 1e-7)."""

    def tail(a: Column) -> Column:
        poly = let(1 / (1 + 0.2316419 * a), lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        return F.least(F.lit(1.0), 2 * 0.3989422804014327 * F.exp(-a * a / 2) * poly)

    return let(F.abs(z), tail)


def upper_tail(z: Column) -> Column:
    """Probability that a standard normal exceeds z."""
    return let(z, lambda v: F.when(v > 0, normal_tail(v) / 2).otherwise(1 - normal_tail(v) / 2))
