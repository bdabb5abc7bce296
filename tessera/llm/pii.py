"""Personal data by candidate gradient boosting, in column expressions only.

Fixed patterns with validity tests give the base spans (e-mail, IPv4, card,
phone); they always stay.  Further, wide generators propose overlapping spans:
digit groups of any punctuation, identifiers of letters and digits, dates, IPv6
addresses (also shortened ones), e-mail addresses written out.  Boosted trees judge
each by its format and by the words around it.  Their margins are calibrated to
probabilities on examples that the trees have not seen, one scale for each
generator, and a generator's candidates are redacted from the probability on at
which those examples show the asked precision.  Of accepted spans that overlap the
most probable stays.

Nobody labelled spans in the corpus, so the trees learn from examples written by
rule (``examples``): sentences in which numbers of the same shapes are personal or
not, told by their words, by their format or by both.  Which words matter is learned
from them, too (``context_words``).  Training runs in numpy on the driver; the trees
become nested conditional expressions over an array of features.

Nulls, empties, repeats: a null text counts as empty and has no span.  Rows are
judged alone.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import joined, let, matches, of_kind, overlaps, strongest
from .store import fold
from .trees import Forest, fit_forest

KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """Valid base spans by kind."""
    digit = F.regexp_like(text, F.lit("[0-9]"))
    email = matches(text, EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(matches(text, IP, digit), lambda s: F.regexp_like(s["text"], F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")))
    card = F.filter(matches(text, CARD, digit), lambda s: F.length(_digits(s["text"])).between(13, 19) & F.call_function("luhn_check", _digits(s["text"])))
    phone = F.filter(matches(text, PHONE, F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["text"])).between(9, 15))
    return dict(zip(KINDS, (email, ip, card, phone), strict=True))


#: Generators: name, pattern, and what a text must contain for the pattern to be tried.
MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]{0,6}"
_HEX4 = "[0-9A-Fa-f]{1,4}"
GENERATORS = (
    ("number", r"[(]?(?<![0-9A-Za-z_@.,:/-])[0-9](?:[\x20()./-]{0,2}[0-9])++(?![0-9A-Za-z_@])", "[0-9]"),
    ("id", r"(?<![0-9A-Za-z_@./-])(?=[A-Z0-9\x20]{0,8}[0-9])[A-Z]{1,3}[\x20-]?[0-9][0-9A-Z]++(?:\x20[0-9A-Z]{2,4}){0,8}+(?![0-9A-Za-z_@])", "[A-Z][A-Z]{0,2}[\\x20-]?[0-9]"),
    ("date", rf"(?<![0-9./-])(?:[0-3]?[0-9][./-][0-3]?[0-9][./-](?:[12][0-9])?[0-9]{{2}}|[12][0-9]{{3}}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9](?:st|nd|rd|th|\.)?\x20{MONTHS}\x20[12][0-9]{{3}}|{MONTHS}\x20[0-3]?[0-9],?\x20[12][0-9]{{3}})(?![0-9/-])", "[0-9]{2}"),
    ("ip6", rf"(?<![0-9A-Za-z:.])(?:{_HEX4}(?::{_HEX4}){{7}}|(?:{_HEX4}(?::{_HEX4}){{0,5}})?::{_HEX4}(?::{_HEX4}){{0,5}})(?![0-9A-Za-z:])", ":[0-9A-Fa-f]{1,4}:|::"),
    ("mail", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({](?:at|AT|At)[\])}]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[({](?:dot|DOT|Dot)[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]++)++", r"(?:[\[({]|\x20)(?:at|AT|At)(?:[\])}]|\x20)\x20?[A-Za-z0-9-]++(?:\x20?[\[({]|\x20(?:dot|DOT)\x20|\.[A-Za-z0-9])"),
)
LONGEST = 128  # code points of a candidate; longer runs are no personal datum
LEFT, RIGHT = 40, 6  # code points of context


def candidates(text: Column) -> Column:
    """All generated spans with their generator's number and the text around them, ascending by start."""

    def of(k: int, pattern: str, need: str) -> Column:
        found = matches(text, pattern, F.regexp_like(text, F.lit(need)), LEFT, RIGHT)
        found = F.filter(found, lambda s: F.length(s["text"]) <= LONGEST)
        if GENERATORS[k][0] == "number":
            found = F.filter(found, lambda s: F.length(_digits(s["text"])).between(6, 19))
        if GENERATORS[k][0] == "id":
            found = F.filter(found, lambda s: (F.length(s["text"]) >= 6) & (F.length(_digits(s["text"])) >= 4))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"), s["text"].alias("text"), s["left"].alias("left"), s["right"].alias("right")))

    return F.array_sort(F.concat(*[of(k, p, need) for k, (_, p, need) in enumerate(GENERATORS)]))


#: Format features of a candidate, in the order of ``_format``.
FORMAT = (
    "kind", "length", "digits", "capitals", "letters", "spaces", "hyphens", "dots", "slashes", "colons", "brackets", "groups",
    "first", "second", "third", "last", "first_value", "second_value", "last_value", "zero", "luhn", "before", "after",
)
_BEFORE, _AFTER = "$€£#+=-/:.,", "%€$:/-,.+"


def _format(c: Column) -> list[Column]:
    t = c["text"]
    count = lambda chars: F.length(t) - F.length(F.regexp_replace(t, chars, ""))
    groups = F.split(F.trim(F.regexp_replace(t, "[^0-9A-Za-z]+", " ")), " ")
    group = lambda i: F.coalesce(F.get(groups, F.lit(i)), F.lit(""))
    last = F.coalesce(F.element_at(groups, -1), F.lit(""))
    value = lambda g: F.when(F.regexp_like(g, F.lit("^[0-9]{1,6}$")), g.cast("int")).otherwise(F.lit(-1))
    ends = [F.position(F.right(F.rtrim(c["left"]), F.lit(1)), F.lit(_BEFORE)), F.position(F.left(F.ltrim(c["right"]), F.lit(1)), F.lit(_AFTER))]
    luhn = F.when(F.length(_digits(t)).between(8, 19), F.call_function("luhn_check", _digits(t)).cast("int")).otherwise(F.lit(-1))
    return [
        c["kind"], F.length(t), count("[0-9]"), count("[A-Z]"), count("[A-Za-z]"), count(" "), count("-"), count("[.]"), count("/"), count(":"), count("[()\\[\\]{}]"), F.size(groups),
        F.length(group(0)), F.length(group(1)), F.length(group(2)), F.length(last), value(group(0)), value(group(1)), value(last), (F.left(t, F.lit(1)) == "0").cast("int"), luhn, *ends,
    ]


def features(c: Column, words: list[str]) -> Column:
    """FORMAT and, for each of ``words``, whether it is among the words on the left: an array of doubles."""
    left = F.split(F.lower(c["left"]), "[^a-z\\x{e0}-\\x{ff}]+")
    return F.array(*[x.cast("double") for x in _format(c)], *[F.array_contains(left, F.lit(w)).cast("double") for w in words])


def examples(count: int = 8000, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """(sentence, start, end, personal): one datum each, personal (1) or not (0).

    Shapes are shared: a run of digits may be an account or an order, a date may be
    of birth or of delivery.  Some sentences have no telling word.
    """
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    pick = lambda *x: r.choice(x)
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    caps = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
    hexa = lambda n=4: "".join(r.choice("0123456789abcdef") for _ in range(n))
    day, month, year = (lambda: r.randint(1, 28)), (lambda: r.randint(1, 12)), (lambda: r.randint(1930, 2029))
    name = lambda: pick("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "Jan", "Feb", "Sep", "Oct")
    date = lambda: pick(f"{day():02d}/{month():02d}/{year()}", f"{month()}/{day()}/{year()}", f"{day():02d}.{month():02d}.{year()}", f"{year()}-{month():02d}-{day():02d}", f"{day()} {name()} {year()}", f"{name()} {day()}, {year()}")
    local = lambda: pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(4)} {d(3)}", f"0{d(2)}/{d(7)}", f"{d(4)} {d(3)} {d(3)}", f"00{d(2)}-{d(2)}-{d(3)}-{d(4)}", d(10), f"0{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}")
    home = lambda: pick("com", "org", "net", "de", "fr")
    call = lambda: pick("call", "phone", "tel", "mobile", "cell", "fax", "whatsapp", "reach me on", "telephone", "handy", "teléfono", "téléphone", "sms")
    thing = lambda: pick("order", "invoice", "sku", "item", "ref", "isbn", "page", "ticket", "part number", "article", "tracking", "case", "total", "serial", "build", "version", "lot", "chapter", "amount")
    link = lambda: pick(" ", " ", ": ", " is ", " number ", " no. ")
    good = [
        lambda: (call() + link(), local()),
        lambda: (call() + link(), local()),
        lambda: (call() + link(), local()),
        lambda: ("", pick(f"({d(3)}) 555-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}")),
        lambda: (pick("ssn", "social security", "my ssn", "social") + link(), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: ("", f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (pick("account", "iban", "bank account", "konto", "tax id", "national id", "id card") + link(), pick(d(10), d(9), d(12), f"{d(4)} {d(4)} {d(4)} {d(2)}")),
        lambda: (pick("iban", "account", "") + link(), f"{pick('DE', 'FR', 'ES', 'GB', 'NL')}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"),
        lambda: (pick("passport", "licence", "license", "driving licence", "national insurance", "personalausweis") + link(), pick(f"{caps(1)}{d(7)}", f"{caps(2)}{d(7)}", f"{caps(2)}{d(6)}{caps(1)}", d(9))),
        lambda: (pick("passport", "licence", "license", "driving licence", "national insurance", "personalausweis") + link(), pick(f"{caps(1)}{d(7)}", f"{caps(2)}{d(7)}", f"{caps(2)}{d(6)}{caps(1)}", d(9))),
        lambda: (pick("born", "dob", "date of birth", "birthday", "born on", "geboren", "née le", "nacido") + link(), date()),
        lambda: (pick("born", "dob", "date of birth", "birthday", "born on") + link(), date()),
        lambda: (pick("", "host ", "address ", "from ", "ip "), pick(":".join(hexa() for _ in range(8)), f"2001:db8::{hexa(r.randint(1, 4))}", f"fe80::{hexa()}:{hexa()}:{hexa()}:{hexa()}", f"2a02:{hexa()}:{hexa()}::{hexa(1)}")),
        lambda: (pick("mail ", "contact ", "", "write to ", "email "), f"{word()}{pick('.', '_', '')}{word()}{pick(' [at] ', '(at)', ' at ', ' AT ', '[at]')}{word()}{pick(' [dot] ', ' dot ', '(dot)', ' DOT ')}{home()}"),
        lambda: (pick("mail ", "", "write to "), f"{word()}{pick('(at)', '[at]', ' (at) ')}{word()}.{home()}"),
    ]
    bad = [
        lambda: (thing() + link(), local()),
        lambda: (thing() + link(), local()),
        lambda: (thing() + link(), pick(d(r.randint(8, 12)), f"{caps(1)}{d(7)}", f"{caps(2)}{d(7)}", f"{caps(2)}{d(6)}{caps(1)}")),
        lambda: (thing() + link(), pick(d(r.randint(6, 19)), f"{caps(1)}{d(7)}", f"{caps(2)}{d(6)}", f"{caps(3)}-{d(5)}", f"{d(3)}-{d(2)}-{d(4)}")),
        lambda: ("", pick(d(r.randint(6, 9)), d(r.randint(11, 19)), d(r.randint(6, 19)))),
        lambda: (pick("on", "due", "published", "updated", "delivered", "since", "until", "dated", "from", "released", "", "", "") + " ", date()),
        lambda: (pick("on", "due", "published", "updated", "delivered", "since", "until", "dated", "from", "released", "", "", "") + " ", date()),
        lambda: (pick("isbn ", ""), f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}"),
        lambda: (pick("total ", "price ", "$", "€", "costs "), pick(f"{d(3)} {d(3)}.{d(2)}", f"{d(3)}.{d(3)}.{d(2)}")),
        lambda: (pick("version ", "", "release "), pick(f"{d(1)}.{d(2)}.{d(3)}.{d(4)}", f"{d(2)}.{d(1)}.{d(4)}")),
        lambda: ("", f"{d(4)} {d(4)} {d(4)} {d(4)}"),
        lambda: (pick("between ", "years ", "pages ", ""), f"{year()}-{year()}"),
        lambda: ("", " ".join(d(r.randint(1, 3)) for _ in range(r.randint(4, 9)))),
        lambda: (pick("", "model ", "type ", "route ", "flight ", "version "), pick(f"{caps(1)}{d(4)}", f"{caps(2)}{d(5)}", f"{caps(3)}{d(4)}", f"{caps(1)}{d(4)}{caps(2)}")),
        lambda: (pick("at ", "time ", ""), pick(f"{d(1)}::{d(1)}", f"{hexa(2)}::{hexa(2)}", f"::{d(1)}", f"{hexa(1)}::{hexa(3)}")),
        lambda: (pick("we ", "look ", "they ", "") + word() + " ", f"{word()} at {word()}.{word()}"),
        lambda: (pick("we ", "look ", "they ", "") + word() + " ", f"{word()} at {word()}. {pick('The', 'A', 'It')}"),
        lambda: ("", f"0.{d(r.randint(7, 15))}"),
    ]
    out = []
    for i in range(count):
        y = i % 2
        before, item = r.choice(good if y else bad)()
        head = " ".join(word() for _ in range(r.randint(0, 4)))
        head = f"{head} {before}" if head else before
        out.append((f"{head}{item}{pick(' ', '. ', ', ', '')}{word()} {word()}" if r.random() < 0.8 else f"{head}{item}", len(head), len(head) + len(item), y))
    return out


def context_words(lefts: list[str], y: np.ndarray, most: int = 128, least: int = 6) -> list[str]:
    """The words whose presence tells most about the label (information gain)."""
    sets = [set(re.split("[^a-zà-ÿ]+", x.lower())) - {""} for x in lefts]
    counts, good = Counter(w for s in sets for w in s), Counter(w for s, v in zip(sets, y, strict=True) for w in s if v)

    def entropy(p: float) -> float:
        return 0.0 if p <= 0 or p >= 1 else -p * np.log2(p) - (1 - p) * np.log2(1 - p)

    n, k = max(1, len(y)), float(y.sum())
    gain = {w: entropy(k / n) - c / n * entropy(good[w] / c) - (n - c) / n * entropy((k - good[w]) / max(1, n - c)) for w, c in counts.items() if c >= least}
    return sorted(sorted(gain), key=lambda w: -gain[w])[:most]


def margin(forest: Forest, x: Column) -> Column:
    """The trees as nested conditionals over an array of features."""

    def node(k: int, i: int) -> Column:
        inner = forest.feature.shape[1]
        if i >= inner:
            return F.lit(float(forest.value[k, i - inner]))
        if not np.isfinite(forest.threshold[k, i]):
            return node(k, 2 * i + 1)
        return F.when(F.element_at(x, int(forest.feature[k, i]) + 1) > F.lit(float(forest.threshold[k, i])), node(k, 2 * i + 2)).otherwise(node(k, 2 * i + 1))

    total = F.lit(float(forest.base))
    for k in range(forest.feature.shape[0]):
        total = total + node(k, 0)
    return total


def platt(score: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(a, b) of the logistic curve 1 / (1 + exp(-(a score + b))) that fits the labels best (smoothed targets, Newton steps)."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([score, np.ones(len(score))], axis=1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p) - 1e-6 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


@dataclass
class Model:
    """Trees, context words, and for each generator its calibration and least probability (above 1: none is redacted)."""

    forest: Forest
    words: list[str]
    curves: list[tuple[float, float]]
    least: list[float]
    held: dict[str, tuple[int, float, float]]  # by generator: unseen examples, precision, recall


def fit(spark: SparkSession, trees: int = 80, depth: int = 4, precision: float = 0.95) -> Model:
    """Trains on ``examples``; a third of them calibrates and sets the thresholds."""
    made = examples()
    rows = json.dumps([{"text": t, "a": a, "z": z, "y": y} for t, a, z, y in made])
    frame = spark.range(1).select(F.posexplode(F.from_json(F.lit(rows), "array<struct<text:string,a:int,z:int,y:int>>")).alias("i", "e"))
    drawn = frame.select("i", "e.*", F.explode(candidates(F.col("e.text"))).alias("c"))
    # A candidate that covers the datum has its label; one that only touches it is not personal, whatever the datum.
    drawn = drawn.withColumn("y", F.when((F.col("c.start") <= F.col("a")) & (F.col("c.end") >= F.col("z")) & (F.col("c.end") - F.col("c.start") <= F.col("z") - F.col("a") + 2), F.col("y")).otherwise(F.lit(0)))
    lefts = drawn.select("i", "c.start", "c.kind", "c.left", "y").collect()
    lefts = sorted(lefts, key=lambda r: (r["i"], r["start"], r["kind"]))
    on = np.array([r["i"] % 6 < 4 for r in lefts])  # rows i and i + 1 have both labels
    y = np.array([r["y"] for r in lefts], float)
    words = context_words([r["left"] for r, t in zip(lefts, on, strict=True) if t], y[on])
    got = drawn.select("i", "c.start", "c.kind", features(F.col("c"), words).alias("x")).collect()
    x = np.array([r["x"] for r in sorted(got, key=lambda r: (r["i"], r["start"], r["kind"]))], float)
    forest = fit_forest(x[on], y[on], trees=trees, depth=depth, rate=0.2, least=6)
    score, label, kind = forest.margin(x[~on]), y[~on], x[~on][:, 0]
    curves, least, held = [], [], {}
    for k, (name, *_) in enumerate(GENERATORS):
        s, v = score[kind == k], label[kind == k]
        a, b = platt(s, v) if len(v) else (1.0, 0.0)
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -40, 40)))
        order = np.argsort(-p, kind="stable")
        share = np.cumsum(v[order]) / np.arange(1, len(v) + 1)
        ok = np.flatnonzero((share >= precision) & np.r_[np.diff(p[order]) < 0, True]) if len(v) else []  # between equal ones there is no cut
        curves.append((a, b))
        least.append(float(p[order][ok[-1]]) if len(ok) else 2.0)
        taken = p >= least[-1]
        held[name] = (len(v), float(v[taken].mean()) if taken.any() else 0.0, float(v[taken].sum() / max(1, v.sum())))
    return Model(forest, words, curves, least, held)


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base (spans by kind and start), more (accepted candidates outside the base)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    src = fold(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = src.select("doc_id", *[v.alias(k) for k, v in base_spans(text).items()], candidates(text).alias("proposed"))
    base = F.concat(*[of_kind(F.col(k), k, i) for i, k in enumerate(KINDS)])
    per = lambda values, c: F.element_at(F.array(*[F.lit(float(v)) for v in values]), c["kind"] + 1)
    names = F.array(*[F.lit(g[0]) for g in GENERATORS])

    def scored(c: Column) -> Column:
        m = let(features(c, model.words), lambda x: margin(model.forest, x))
        p = 1 / (1 + F.exp(-(per([a for a, _ in model.curves], c) * m + per([b for _, b in model.curves], c))))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), p.alias("p"))

    def accepted(own: Column) -> Column:
        def clear(c: Column) -> Column:
            hit = F.lit(False)
            for k in KINDS:
                hit = hit | overlaps(own[k], c["start"], c["end"])
            return ~hit

        judged = F.transform(F.filter(own["proposed"], clear), scored)
        taken = strongest(F.filter(judged, lambda c: c["p"] >= per(model.least, c)), LONGEST)
        return F.transform(taken, lambda c: F.struct((c["kind"] + len(KINDS)).alias("order"), c["start"].alias("start"), c["end"].alias("end"), F.element_at(names, c["kind"] + 1).alias("kind")))

    more = F.when(F.size("proposed") > 0, let(F.struct(*KINDS, "proposed"), accepted))
    none = F.array().cast("array<struct<order:int,start:int,end:int,kind:string>>")
    return out.select("doc_id", *KINDS, base.alias("base"), F.coalesce(more, none).alias("more"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from ``find``: counts, base_sha256 and all spans."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "more"))).alias("spans"))
