"""Secret scanning by a battery of randomness tests, in column expressions only.

Fixed patterns with length tests give the base spans (assignments, access keys,
hex runs); they always stay.  Further, every token of 20 or more key characters is a
candidate.  Its encoding is inferred from the characters it uses (hex, letters of one
case or both, base 32, letters and digits of one case or both, base 64), and four tests are made for that alphabet: the chi-squared test of uniform
symbol counts, the runs test (changes between capitals, small letters, digits and
signs), the serial correlation of neighbouring symbols, and how common the symbols
are in text.  Fisher's sum of their log p-values is the token's score: small for a
random token, large for words, paths and other structured strings.

What is tested is the opposite: that a token is text.  Decoys say how text scores:
tokens made from the words of every document, and ``DECOYS`` made from a fixed list
of words, with digits and separators as identifiers, slugs and paths have them.  A
token's p-value is the share of decoys of its length class that score as low.  In
each length class the Benjamini-Hochberg cut at rate ``q`` over all candidates of
the corpus decides which are reported, so at most that share of the reported ones
is expected to be text.  Scores are counted in fixed bins: what is gathered is a few
hundred counts for each length class, whatever the corpus.

Nulls, empties, repeats: a null text counts as empty and has no span; repeated
rows count as often as they occur.  An empty table gives an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import joined, let, matches, normal_tail, of_kind, overlaps, upper_tail
from .store import Scratch, fold

KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++"""
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{16,}+"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+"
#: Encodings: name, characters, symbols in their order.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("letters_lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    ("letters_upper", "^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base32_lower", "^[a-z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567"),
    ("alphanumeric_lower", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("alphanumeric_upper", "^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
    ("letters", "^[A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("alphanumeric", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"),
)
#: Letters by how common they are in text, in per mille (digits count as 1, capitals as a tenth, other signs as 2).
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (127, 91, 82, 75, 70, 67, 63, 61, 60, 43, 40, 28, 28, 24, 24, 22, 20, 20, 19, 15, 10, 8, 2, 2, 1, 1), strict=True))
BINS = 240  # bins of the score, a quarter wide
CLASSES = (24, 32, 48, 64, 128)  # upper ends of the length classes
#: Lengths of decoys, alike in each class.  Text of any greater length is still further from random, so the last class needs none.
LENGTHS = ((20, 24), (25, 32), (33, 48), (49, 64), (65, 128), (129, 200))
#: Decoys made by rule, and the words they are made of.
DECOYS = 36_000
WORDS = (
    "section chapter page figure table user data file path index value name time date number order item list group type code text line word state level field point unit model part class form test case rule "
    "link node edge face cell size rate load plan run task job batch stage step phase report result score rank total count first last next main base core full half open close start stop begin end left right "
    "upper lower inner outer north south east west spring summer winter autumn green blue black white silver golden river mountain valley forest garden market street village city country world people music "
    "paper water light stone metal configuration environment development performance implementation administration message service account session request response "
    "haus strasse kapitel seite tabelle benutzer datei ordner wert zeit datum bestellung gruppe entwicklung verwaltung rechnung bericht ergebnis fruehling sommer herbst winter schluessel nachricht "
    "maison chapitre tableau utilisateur fichier dossier valeur temps commande groupe developpement gestion facture rapport resultat printemps automne hiver clef "
    "casa calle capitulo pagina tabla usuario archivo carpeta valor tiempo fecha pedido grupo desarrollo gestion factura informe resultado primavera verano otono invierno llave "
    "dom ulica rozdzial strona tabela uzytkownik plik wartosc czas grupa rozwoj faktura raport wynik wiosna lato jesien zima klucz"
).split()


def base_spans(text: Column) -> dict[str, Column]:
    """Base spans by kind; a span is the whole match."""
    low = F.lower(text)
    assign = matches(text, ASSIGN, F.contains(low, F.lit("pass")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | F.contains(low, F.lit("key")))
    assign = F.filter(assign, lambda s: F.length(F.regexp_extract(s["text"], _VALUE, 1)) >= 12)
    access = F.filter(matches(text, ACCESS, F.contains(text, F.lit("AKIA"))), lambda s: F.length(s["text"]) >= 18)
    return dict(zip(KINDS, (assign, access, matches(text, HEX)), strict=True))


def text_weights(alphabet: str) -> list[float]:
    """The log frequency in text of each symbol, with mean 0 and variance 1 over the alphabet."""
    one_case = alphabet == alphabet.lower() or alphabet == alphabet.upper()
    of = lambda c: LETTERS[c.lower()] / (1 if one_case or c.islower() else 10) if c.isalpha() else 1 if c.isdigit() else 2
    raw = [math.log(of(c)) for c in alphabet]
    mean = sum(raw) / len(raw)
    spread = math.sqrt(sum((v - mean) ** 2 for v in raw) / len(raw))
    return [(v - mean) / spread for v in raw]


def _class_of(c: Column) -> Column:
    return F.when(c.between("a", "z"), F.lit(1)).when(c.between("A", "Z"), F.lit(0)).when(c.between("0", "9"), F.lit(2)).otherwise(F.lit(3))


def class_shares(alphabet: str) -> tuple[float, float]:
    """Sums of the squared and cubed shares of capitals, small letters, digits and signs in an alphabet."""
    kinds = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "s" for c in alphabet]
    shares = [kinds.count(k) / len(kinds) for k in "ulds"]
    return sum(f**2 for f in shares), sum(f**3 for f in shares)


def battery(token: Column, encoding: Column) -> Column:
    """The four p-values of a token under uniform random symbols of its encoding's alphabet.

    The chi-squared value is put on a normal scale by its cube root; the number of
    changes, the serial correlation and the sum of weights are normal for a random
    sequence.  Only what points to text counts: too even counts, too many changes and
    too rare symbols don't.
    """
    of = lambda values: F.element_at(F.array(*values), encoding + 1)
    alphabets = [a for _, _, a in ENCODINGS]
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    shares = [class_shares(a) for a in alphabets]
    known = F.struct(
        chars.alias("c"), of([F.lit(a) for a in alphabets]).alias("alphabet"), of([F.lit(float(len(a))) for a in alphabets]).alias("k"),
        of([F.array(*[F.lit(w) for w in text_weights(a)]) for a in alphabets]).alias("w"), of([F.lit(x) for x, _ in shares]).alias("f2"), of([F.lit(x) for _, x in shares]).alias("f3"),
    )
    placed = let(known, lambda s: F.struct(F.transform(s["c"], lambda c: F.position(c, s["alphabet"]).cast("double")).alias("x"), F.transform(s["c"], _class_of).alias("kinds"), s["k"].alias("k"), s["w"].alias("w"), s["f2"].alias("f2"), s["f3"].alias("f3")))
    return let(placed, lambda s: _p_values(s["x"], s["kinds"], s["k"], s["w"], s["f2"], s["f3"]))


def _p_values(x: Column, kinds: Column, k: Column, weights: Column, f2: Column, f3: Column) -> Column:
    n = F.size(x).cast("double")
    middle = (k + 1) / 2
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    steps = lambda values, test: F.zip_with(F.slice(values, F.lit(1), F.size(x) - 1), F.slice(values, F.lit(2), F.size(x) - 1), test)
    squares = total(F.transform(F.array_distinct(x), lambda v: let(F.size(F.filter(x, lambda y: y == v)).cast("double"), lambda c: c * c)))
    cube = F.pow(F.greatest(k / n * squares - n, F.lit(0.0)) / (k - 1), F.lit(1 / 3))
    p_chi = upper_tail((cube - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1))))
    changes = total(steps(kinds, lambda a, b: (a != b).cast("double")))
    spread = (n - 1) * f2 * (1 - f2) + 2 * (n - 2) * (f3 - f2 * f2)
    p_runs = upper_tail(((n - 1) * (1 - f2) - changes) / F.sqrt(F.greatest(spread, F.lit(1e-9))))
    p_serial = normal_tail(total(steps(x, lambda a, b: (a - middle) * (b - middle))) / ((k * k - 1) / 12 * F.sqrt(n - 1)))
    p_text = upper_tail(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.element_at(weights, v.cast("int"))) / F.sqrt(n))
    return F.array(p_chi, p_runs, p_serial, p_text)


def bin_of(p_values: Column) -> Column:
    """The bin of Fisher's sum of -ln p: 0 for the most random tokens, BINS - 1 for the most structured."""
    score = F.aggregate(p_values, F.lit(0.0), lambda a, p: a - F.log(F.greatest(p, F.lit(1e-30))))
    return F.least(F.lit(BINS - 1), F.floor(4 * score)).cast("int")


def judged(core: Column) -> Column:
    """(encoding's number, length class, bin) of a token."""
    kind = F.lit(len(ENCODINGS) - 1)
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        kind = F.when(F.regexp_like(core, F.lit(pattern)), F.lit(i)).otherwise(kind)
    step = F.lit(0)
    for c in CLASSES:
        step = step + (F.length(core) > c).cast("int")
    return let(kind, lambda k: F.struct(k.alias("encoding"), step.alias("class"), bin_of(battery(core, k)).alias("bin")))


def candidates(text: Column) -> Column:
    """Candidate tokens: start, end, encoding's number, length class, bin."""
    cored = F.transform(matches(text, TOKEN), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_replace(s["text"], "=+$", "").alias("core")))
    return F.transform(cored, lambda s: let(judged(s["core"]), lambda j: F.struct(s["start"].alias("start"), s["end"].alias("end"), j["encoding"].alias("encoding"), j["class"].alias("class"), j["bin"].alias("bin"))))


def _dressed(words: Column, draw: Column) -> Column:
    """Words, each followed by a space, as one token: digits behind some, a separator or none, cut to a length of a drawn class."""
    digits = F.substring(F.abs(F.xxhash64(draw, F.lit("digits"))).cast("string"), F.lit(3), F.lit(1) + F.pmod(draw, F.lit(3)).cast("int"))
    sign = F.element_at(F.array(*[F.lit(c) for c in ("", "-", "_", "/")]), F.pmod(F.shiftright(draw, 2), F.lit(4)).cast("int") + 1)
    # One word in two or three, told by its last letter, is followed by the digits.
    some = F.regexp_replace(words, F.lit("([a-ehjlnpsuwy]) +"), F.concat(F.lit("$1"), digits, F.lit(" ")))
    cased = F.when(F.pmod(F.shiftright(draw, 4), F.lit(3)) == 0, F.initcap(some)).otherwise(some)
    low, high = (F.element_at(F.array(*[F.lit(x[k]) for x in LENGTHS]), F.pmod(F.shiftright(draw, 8), F.lit(len(LENGTHS))).cast("int") + 1) for k in (0, 1))
    return F.substring(F.replace(cased, F.lit(" "), sign), F.lit(1), low + F.pmod(F.shiftright(draw, 16), high - low + 1).cast("int"))


def decoy(text: Column, draw: Column) -> Column:
    """A token made from the words at a drawn place of a text; null if it is too short."""
    at = F.pmod(draw, F.greatest(F.length(text) - 300, F.lit(1)).cast("long")).cast("int")
    words = F.regexp_replace(F.substring(text, at + 1, F.lit(300)), "[^A-Za-z]+", " ")
    return let(_dressed(words, draw), lambda d: F.when(F.length(d) >= 20, d))


def made_decoys(spark: SparkSession, count: int = DECOYS) -> DataFrame:
    """(class, bin) of ``count`` tokens made of WORDS."""
    own, n = F.array(*[F.lit(w) for w in WORDS]), len(WORDS)
    words = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.element_at(own, F.pmod(F.xxhash64("id", i), F.lit(n)).cast("int") + 1))
    tokens = spark.range(0, count, 1, 8).select(F.concat(F.array_join(words, " "), F.lit(" ")).alias("text"), F.xxhash64("id").alias("draw")).select(_dressed(F.col("text"), F.col("draw")).alias("t")).filter(F.length("t") >= 20)
    return tokens.select(judged(F.col("t")).alias("j")).select("j.class", "j.bin")


def discoveries(tokens: dict[tuple[int, int], int], decoys: dict[tuple[int, int], int], q: float) -> list[int]:
    """For each length class the last bin whose tokens are reported (-1 for none): the Benjamini-Hochberg cut at rate q.

    tokens, decoys: counts by (class, bin).  A bin's p-value is (1 + decoys up to it) / (1 + all decoys).
    """
    out = []
    for c in range(len(CLASSES) + 1):
        all_tokens, all_decoys = (sum(n for (k, _), n in x.items() if k == c) for x in (tokens, decoys))
        cut, found, like = -1, 0, 0
        for b in range(BINS):
            found, like = found + tokens.get((c, b), 0), like + decoys.get((c, b), 0)
            if found and (1 + like) / (1 + all_decoys) <= q * found / all_tokens:
                cut = b
        out.append(cut)
    return out


def cuts(spark: SparkSession, found: DataFrame, q: float) -> list[int]:
    """The last reported bin of each length class over all candidates of the corpus."""
    counts = lambda df: {(r["class"], r["bin"]): r["n"] for r in df.groupBy("class", "bin").agg(F.count("*").alias("n")).collect()}  # noqa: E731  fixed bins
    decoys = counts(found.filter("decoy is not null").select("decoy.class", "decoy.bin").unionByName(made_decoys(spark)))
    return discoveries(counts(found.select(F.explode("tokens").alias("t")).select("t.class", "t.bin")), decoys, q)


def find(spark: SparkSession, docs: DataFrame, q: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base (by start, then kind), more (random tokens outside the base)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    src = fold(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = let(decoy(text, F.xxhash64("doc_id", F.length("text"))), lambda d: F.when(d.isNotNull(), judged(d)))
    scanned = src.select("doc_id", *[v.alias(k) for k, v in base_spans(text).items()], candidates(text).alias("tokens"), made.alias("decoy"))
    slim = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    scanned = Scratch(spark, "secrets").save(scanned.select("doc_id", *[slim(k).alias(k) for k in KINDS], "tokens", "decoy"), "scanned")
    cut = F.array(*[F.lit(c) for c in cuts(spark, scanned, q)])
    by_start = lambda spans: F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))))
    base = by_start(F.concat(*[of_kind(F.col(k), k, i) for i, k in enumerate(KINDS)]))
    names = F.array(*[F.lit(e[0]) for e in ENCODINGS])

    def random(own: Column, t: Column) -> Column:
        clear = F.lit(True)
        for k in KINDS:
            clear = clear & ~overlaps(own[k], t["start"], t["end"])
        return (t["bin"] <= F.element_at(cut, t["class"] + 1)) & clear

    more = let(F.struct(*KINDS, "tokens"), lambda own: F.transform(F.filter(own["tokens"], lambda t: random(own, t)), lambda t: F.struct(t["start"].alias("start"), (t["encoding"] + len(KINDS)).alias("order"), t["end"].alias("end"), F.element_at(names, t["encoding"] + 1).alias("kind"))))
    return scanned.select("doc_id", *KINDS, base.alias("base"), more.alias("more"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from ``find``: counts, base_sha256 and all spans."""
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "more"))).alias("spans"))
