"""Learned parts against plain versions, odd rows through the pipeline, long texts."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_operators import R, brute_components, brute_hits, frame, prose, sets_of


def test_gradients_against_differences():
    from tessera.llm.language_id import gradients

    r = np.random.default_rng(2)
    w, k, steps, batch = 3, 2, 6, 4
    shapes = {"t0": (256, 3 * w), "t1": (256, 3 * w), "u0": (w, 3 * w), "u1": (w, 3 * w), "out": (2 * w, k), "bias": (k,)}
    par = {n: r.normal(0, 0.5, s).astype(np.float32) for n, s in shapes.items()}
    xs, ls, ys = r.integers(97, 101, (steps, batch)).astype(np.uint8), np.array([6, 3, 1, 5]), np.array([0, 1, 1, 0])
    xs[np.arange(steps)[:, None] >= ls[None, :]] = 0
    _, grad = gradients(par, xs, ls, ys)
    for name, g in grad.items():
        for _ in range(6):
            at = tuple(int(r.integers(97, 101)) if name[0] == "t" and i == 0 else int(r.integers(n)) for i, n in enumerate(par[name].shape))
            loss = []
            for step in (1e-2, -1e-2):
                moved = {n: v.copy() for n, v in par.items()}
                moved[name][at] += step
                loss.append(gradients(moved, xs, ls, ys)[0])
            assert math.isclose(g[at], (loss[0] - loss[1]) / 2e-2, rel_tol=0.03, abs_tol=2e-4), (name, at)


def test_whole_texts_are_pooled():
    from tessera.llm.language_id import document_probabilities, position_probabilities, train

    r = random.Random(3)
    texts = ["".join(r.choice(a) for _ in range(n)).encode() for a, n in (("abc ", 500), ("xyz ", 70), ("abc ", 64), ("xyz ", 1))]
    m = train([t[:32] for t in texts] * 8, ["a", "x", "a", "x"] * 8, window=32, width=4, epochs=2, batch=8)
    got = document_probabilities(m, texts, block=5)
    for t, p in zip(texts, got, strict=True):
        total = np.zeros(2)
        for i in range(0, len(t), 32):
            x = np.frombuffer(t[i : i + 32], np.uint8)[:, None]
            total += position_probabilities(m, x, np.array([len(x)]))[0]
        assert np.allclose(p, total / len(t), atol=1e-4) and math.isclose(p.sum(), 1, abs_tol=1e-3)


def test_trees_descend_as_trees():
    from tessera.llm.trees import fit_forest

    r = np.random.default_rng(4)
    x = r.normal(size=(300, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    f = fit_forest(x, y, trees=20, depth=3)
    for row, got in zip(x[:50], f.margin(x[:50]), strict=True):
        total = f.base
        for k in range(len(f.feature)):
            i = 0
            while i < f.feature.shape[1]:
                i = 2 * i + 1 + bool(row[f.feature[k, i]] > f.threshold[k, i])
            total += f.value[k, i - f.feature.shape[1]]
        assert math.isclose(total, got, abs_tol=1e-9)
    assert ((f.probability(x) > 0.5) == (y > 0)).mean() > 0.95
    # One split on one feature: the best of all cuts by the plain gain.
    one = fit_forest(x[:, :1], (x[:, 0] > 0.3).astype(float), trees=1, depth=1, bins=64)
    assert abs(one.threshold[0, 0] - 0.3) < 0.1


def test_quality_statistics_by_hand():
    from tessera.llm.quality_trees import FEATURES, statistics

    t = "Aa bb bb #1, cc!\nsame line\nsame line\n\né x"
    w, lines, n = t.encode().split(), [x for x in t.encode().split(b"\n") if x], len(t.encode())
    got = dict(zip(FEATURES, statistics(t.encode()), strict=True))
    assert got["log_words"] == math.log1p(len(w)) and got["mean_word"] == sum(map(len, w)) / len(w) and got["repeated_lines"] == 1 - 3 / 4
    assert got["top_word"] == 2 / len(w) and got["repeated_neighbours"] == 1 / len(w) and got["upper"] == 1 / n and got["symbols"] == 1 / n and got["mean_line"] == n / len(lines) / 100
    assert statistics(None) == statistics(b"") and not any(statistics(b""))


def test_verdict_is_the_list(spark):
    from tessera.llm.quality_rules import MEASURES, covers, learn, verdict

    r = np.random.default_rng(6)
    x = {k: np.round(r.uniform(0, 1, 500), 3) for k in MEASURES}
    bad = (x["symbols_per_word"] > 0.7) | ((x["upper_share"] > 0.6) & (x["mean_word"] <= 0.4))
    rules = learn(x, bad)
    want = np.ones(500, bool)
    for rule in rules:
        want &= ~covers(rule, x, 500)
    assert rules and (want == ~bad).mean() > 0.93
    rows = [(i, *(float(x[k][i]) for k in MEASURES)) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{k} double" for k in MEASURES))
    plain = verdict(rules)
    sql = str(plain._jc.toString())
    assert sql.count("WHEN") == len(rules)
    # The expression reads counts; give it counts whose measures are the drawn values.
    counts = df.select("i", F.lit(1).alias("n_words"), F.col("symbols_per_word").alias("n_symbols"), F.col("repeat_share").alias("n_repeat_words"), F.lit(1.0).alias("n_lines"), F.col("mean_word").alias("word_chars"), F.col("distinct_share").alias("n_distinct"), F.lit(0.0).alias("n_upper"), F.lit(0.0).alias("n_dup_lines"))
    derived = {"symbols_per_word": x["symbols_per_word"], "repeat_share": x["repeat_share"], "duplicate_line_share": np.zeros(500), "upper_share": np.zeros(500), "distinct_share": x["distinct_share"], "mean_word": x["mean_word"], "words_per_line": np.ones(500)}
    want = np.ones(500, bool)
    for rule in rules:
        want &= ~covers(rule, derived, 500)
    got = {r["i"]: r["k"] for r in counts.select("i", plain.alias("k")).collect()}
    assert [got[i] for i in range(500)] == want.tolist()


def numpy_battery(t, encoding):
    from tessera.llm.secrets import ENCODINGS, text_weights

    a = ENCODINGS[encoding][2]
    k, n, x = len(a), len(t), np.array([a.index(c) + 1 for c in t], float)
    upper = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    kind = lambda c: 0 if "A" <= c <= "Z" else 1 if "a" <= c <= "z" else 2 if c.isdigit() else 3
    chi = max(0.0, k / n * sum(v * v for v in Counter(t).values()) - n)
    shares = np.array([sum(kind(c) == g for c in a) / k for g in range(4)])
    f2, f3 = (shares**2).sum(), (shares**3).sum()
    changes = sum(kind(p) != kind(q) for p, q in zip(t, t[1:], strict=False))
    mid = (k + 1) / 2
    serial = ((x[:-1] - mid) * (x[1:] - mid)).sum() / ((k * k - 1) / 12 * math.sqrt(n - 1))
    w = dict(zip(a, text_weights(a), strict=True))
    return [
        upper(((chi / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / math.sqrt(2 / (9 * (k - 1)))), upper(((n - 1) * (1 - f2) - changes) / math.sqrt(max(1e-9, (n - 1) * f2 * (1 - f2) + 2 * (n - 2) * (f3 - f2 * f2)))),
        2 * upper(abs(serial)), upper(sum(w[c] for c in t) / math.sqrt(n)),
    ]


def test_battery_against_numpy(spark):
    from tessera.llm.secrets import ENCODINGS, battery, bin_of, judged

    r = random.Random(8)
    tokens = ["".join(r.choice(e[2]) for _ in range(r.randint(20, 80))) for e in ENCODINGS for _ in range(6)] + ["chapter3-section12-page45-fig7", "a1" * 20, "configuration2management17"]
    rows = spark.createDataFrame(list(enumerate(tokens)), "i long, t string").select("i", judged(F.col("t")).alias("j"), "t")
    got = rows.select("i", "j", battery(F.col("t"), F.col("j.encoding")).alias("p"), bin_of(battery(F.col("t"), F.col("j.encoding"))).alias("b")).collect()
    for x in got:
        t = tokens[x["i"]]
        want = numpy_battery(t, x["j"]["encoding"])
        assert np.allclose(x["p"], want, atol=2e-6), t
        assert x["b"] == x["j"]["bin"] and abs(x["b"] - min(239, 4 * -sum(math.log(max(p, 1e-30)) for p in want))) < 1.01
        assert set(t) <= set(ENCODINGS[x["j"]["encoding"]][2])


def test_discoveries_are_benjamini_hochberg():
    from tessera.llm.secrets import BINS, CLASSES, discoveries

    r = random.Random(9)
    for _ in range(30):
        tokens = {(c, b): r.randint(1, 9) for c in range(len(CLASSES) + 1) for b in r.sample(range(BINS), 12)}
        decoys = {(c, b): r.randint(1, 200) for c in range(len(CLASSES) + 1) for b in r.sample(range(40, BINS), 60)}
        got = discoveries(tokens, decoys, 0.05)
        for c in range(len(CLASSES) + 1):
            like, total = {b: n for (k, b), n in decoys.items() if k == c}, sum(n for (k, _), n in decoys.items() if k == c)
            p = sorted(((1 + sum(n for x, n in like.items() if x <= b)) / (1 + total), b) for (k, b), n in tokens.items() if k == c for _ in range(n))
            keep = [b for i, (v, b) in enumerate(p, 1) if v <= 0.05 * i / len(p)]
            shown = {b for (k, b) in tokens if k == c and b <= got[c]}
            assert shown == {b for (k, b) in tokens if k == c and keep and b <= max(keep)}
    assert discoveries({}, {}, 0.05) == [-1] * (len(CLASSES) + 1)


def test_few_false_secrets(spark):
    """Of what is reported among slugs, paths, names and random keys, few are text; the probe's slug is not a secret."""
    from tessera.llm.secrets import find

    r = random.Random(12)
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(r.choice(b62) for _ in range(r.choice((24, 32, 40)))) for _ in range(60)]
    parts = ["chapter", "section", "invoice", "customer", "backup", "report", "august", "release", "photo", "holiday", "server", "north", "draft", "final", "copy"]
    slug = lambda: r.choice("-_/").join(r.choice(parts) + (str(r.randint(1, 2030)) if r.random() < 0.5 else "") for _ in range(r.randint(3, 6)))
    plain = ["chapter3-section12-page45-fig7", "usr/local/lib/python3/site-packages/numpy2"] + [slug() for _ in range(400)]
    got = {x["doc_id"]: bool(x["more"]) for x in find(spark, frame(spark, list(enumerate(f"see {t} there" for t in keys + plain)))).collect()}
    hits, wrong = sum(got[i] for i in range(60)), sum(got[i] for i in range(60, len(got)))
    assert hits >= 52 and wrong <= max(3, 0.1 * (hits + wrong)) and not got[60]


def test_secrets_of_every_length(spark):
    """Random tokens of 24 to 2,000 characters and of letters alone are found; slugs of words the module doesn't know, of any length, are not."""
    from tessera.llm.secrets import WORDS, find

    r = random.Random(1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kinds = [(upper + upper.lower() + "0123456789", n) for n in (24, 60, 66, 88, 128, 129, 200, 2000)] + [(upper + upper.lower(), 48), (upper + upper.lower(), 128), (upper.lower(), 64), (upper, 100)]
    parts = [w for w in "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu maintenance quarterly onboarding dashboards".split() if w not in WORDS]
    keys = ["".join(r.choice(a) for _ in range(n)) for a, n in kinds for _ in range(60)]
    slugs = [r.choice(["-", "_", "/", ""]).join(r.choice(parts) + (str(r.randint(1, 2030)) if r.random() < 0.4 else "") for _ in range(r.randint(4, 30))) for _ in range(900)] + ["-" * 40, "a" * 90]
    got = {x["doc_id"]: bool(x["more"]) for x in find(spark, frame(spark, list(enumerate(f"see {t} there" for t in keys + slugs)))).collect()}
    for k in range(len(kinds)):
        assert sum(got[60 * k + i] for i in range(60)) >= 54, kinds[k]
    hits, wrong = sum(got[i] for i in range(len(keys))), sum(got[i] for i in range(len(keys), len(got)))
    assert wrong <= 0.05 * (hits + wrong)


def test_margin_is_the_forest(spark):
    from tessera.llm.pii import candidates, features, find, fit, margin

    model = fit(spark)
    texts = ["call (212) 555-0199 now or 0049-30-123-4567", "born 12/03/1985 in X", "iban DE89 3704 0044 0532 0130 00", "host 2001:db8::1 up", "jane at example dot com", "order 123456789 and 4111 1111 1111 1111", "x" * 50]
    df = frame(spark, list(enumerate(texts)))
    rows = df.select("doc_id", F.explode(candidates(F.col("text"))).alias("c")).select("doc_id", features(F.col("c"), model.words).alias("x")).select("doc_id", "x", margin(model.forest, F.col("x")).alias("m")).collect()
    assert len(rows) >= 7 and np.allclose([r["m"] for r in rows], model.forest.margin(np.array([r["x"] for r in rows])))
    found = {r["doc_id"]: [(x["kind"], texts[r["doc_id"]][x["start"] : x["end"]]) for x in r["more"]] for r in find(df, model).collect()}
    assert ("number", "(212) 555-0199") in found[0] and any(t == "12/03/1985" for _, t in found[1]) and found[2] == [("id", "DE89 3704 0044 0532 0130 00")] and found[3] == [("ip6", "2001:db8::1")] and found[6] == []
    assert all(n and precision >= 0.9 and recall >= 0.6 for n, precision, recall in model.held.values())


def test_strongest_by_brute_force(spark):
    from tessera.llm.spans import starting_before, strongest, sums_before

    r, rows = random.Random(10), []
    for i in range(60):
        spans, at = [], [0, 0, 0]
        for _ in range(r.randint(0, 12)):
            k = r.randrange(3)
            a = at[k] + r.randint(0, 6)
            at[k] = z = a + r.randint(1, 9)  # spans of one kind are disjoint
            spans.append((a, z, k, r.choice((0.5, 0.7, 0.9))))
        rows.append((i, sorted(spans)))
    chain = lambda n: [(10 * k, 10 * k + 12, k % 2, 1 - k / 1000) for k in range(n)]  # noqa: E731  each overlaps the next, weaker one
    rows += [(60, chain(9)), (61, chain(200)), (62, chain(9) + [(500, 510, 0, 0.9)])]
    df = spark.createDataFrame(rows, "i long, s array<struct<start:int,end:int,kind:int,p:double>>")
    got = {x["i"]: [tuple(s) for s in x["t"]] for x in df.select("i", strongest(F.col("s"), 16).alias("t")).collect()}
    key = lambda s: (s[3], s[1] - s[0], -s[0], -s[2])
    meets = lambda a, b: a[0] < b[1] and b[0] < a[1]
    for i, spans in rows:
        kept = []
        for s in sorted(spans, key=key, reverse=True):
            if not any(meets(s, o) for o in kept):
                kept.append(s)
        assert got[i] == sorted(kept)
    assert len(got[60]) == 5 and len(got[61]) == 100
    lists = [[r.randint(0, 9) for _ in range(n)] for n in (0, 1, 63, 64, 65, 5000)]
    out = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i long, v array<int>").select("i", sums_before(F.col("v")).alias("s")).collect()
    for x in out:
        assert x["s"] == np.concatenate([[0], np.cumsum(lists[x["i"]])]).tolist()[:-1][: len(lists[x["i"]])]
    probe = spark.createDataFrame([([(a, a + 1) for a in (2, 4, 4, 9)],)], "s array<struct<start:int,end:int>>")
    assert [probe.select(starting_before(F.col("s"), F.lit(x))).first()[0] for x in (0, 2, 3, 5, 99)] == [0, 0, 1, 3, 4]


def test_many_matches_in_one_text(spark):
    """Two hundred thousand matches, and a megabyte of mixed ones, in seconds; positions are those of the pattern."""
    from tessera.llm import pii, secrets

    model = pii.fit(spark, trees=4, depth=2)
    mixed = "mail a@b.cd 1.2.3.4 call 212-555-0199 "
    pii.find(frame(spark, [(0, mixed)]), model).collect()  # compiled
    for text, n_ip in (("12 a " * 200_000, 0), (mixed * 27_000, 27_000)):
        began = time.time()
        row = pii.digest(pii.find(frame(spark, [(1, text)]), model)).first()
        assert row["n_ip"] == n_ip and time.time() - began < 30
    starts = [m.start() for m in re.finditer(r"a@b\.cd", mixed * 27_000)]
    found = pii.find(frame(spark, [(1, mixed * 27_000)]), model).first()["base"]
    assert [s["start"] for s in found if s["kind"] == "email"] == starts
    began = time.time()
    assert secrets.digest(secrets.find(spark, frame(spark, [(1, "deadbeef01234567 x " * 50_000)]))).first()["n_hex"] == 50_000
    assert time.time() - began < 40


def test_long_texts(spark):
    """Texts of some 100,000 characters are read whole by every learned operator."""
    from tessera.llm import language_id, quality_rules, quality_trees, secrets

    r = random.Random(14)
    long = prose(18_000, r)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(48))
    texts = [long, long + " " + "password = " + key, "short one"]
    df = frame(spark, list(enumerate(texts)))
    assert len(long) > 100_000
    got = {x["doc_id"]: x for x in quality_rules.judge(df, []).collect()}
    assert got[0]["n_words"] == 18_000 and got[1]["n_words"] == 18_003
    assert quality_trees.statistics(texts[0].encode())[0] == math.log1p(18_000) and quality_trees.score(spark, df, quality_trees.fit(df, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))).count() == 3
    assert secrets.digest(secrets.find(spark, df)).orderBy("doc_id").collect()[1]["n_assign"] == 1
    model = language_id.train([b"abc abd", b"xyz xyy"] * 20, ["a", "x"] * 20, window=16, width=4, epochs=2, batch=8)
    out = language_id.identify(spark, frame(spark, [(0, "abd " * 30_000), (1, "xyy " * 30_000)]), model).collect()
    assert {x["doc_id"]: x["lang_pred"] for x in out} == {0: "a", 1: "x"}


ROWS = [(3, "A"), (5, "A"), (5, "B"), (7, "A"), (7, "A"), (None, "A"), (None, "B2"), (None, "C"), (None, "C"), (8, "D"), (9, None), (9, None), (10, ""), (11, "D"), (12, "E"), (12, "F"), (13, "F")]


def texts_of():
    r = random.Random(21)
    base = {k: prose(40, r) for k in "ABCDEF"}
    base["B2"] = base["B"] + " " + prose(1, r)
    return [(d, base.get(k, k)) for d, k in ROWS]


def test_rows_that_share_an_id(spark):
    from tessera.llm.near_dup import near_duplicates, near_groups

    rows = texts_of()
    found = near_duplicates(spark, frame(spark, rows)).collect()
    by_text = {}
    for d, n, c in found:
        by_text.setdefault(d, set()).add(c)
    assert by_text[5] == {3} and by_text[3] == {3} and by_text[8] == by_text[11] == {8} and by_text[12] == by_text[13] == {12} and by_text[10] == {10}
    want = brute_components([(d, t) for d, t in rows if d is not None])
    assert {tuple(x) for x in found if x["doc_id"] is not None} == want
    assert Counter(x["component_id"] for x in found if x["doc_id"] is None) == {3: 2, None: 2}  # B2 is near B, which shares an id with A
    groups = near_groups(spark, frame(spark, rows), link_ids=False).filter("n_shingles > 0").collect()
    apart = {(x["doc_id"], x["text_hash"]): x["group"] for x in groups}
    assert len({g for (d, _), g in apart.items() if d == 5}) == 2


def test_pipeline_keeps_unique_texts(spark, tmp_path):
    """Rows without id, repeated ids with other texts and exact repeats, stage by stage against a plain version."""
    import corpus_pipeline as pipeline

    rows = texts_of()
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(((x["doc_id"] is None, x["doc_id"] or 0, x["text"] or "") for x in pipeline.near_dup(spark, docs, "").collect()))
    sets, root = [sets_of(t) for _, t in rows], list(range(len(rows)))
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    kept, seen = [], set()
    for i in order:
        if not sets[i] or find(i) not in seen:
            seen.add(find(i))
            kept.append((rows[i][0] is None, rows[i][0] or 0, rows[i][1] or ""))
    assert left == sorted(kept)
    spark.createDataFrame([(1, rows[9][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["text"] or "") for x in pipeline.decontaminate(spark, docs, str(tmp_path)).collect())
    hits = brute_hits(rows, [(1, rows[9][1])])
    assert len(clean) == sum(not (hit and 20 * hit >= n) for _, _, n, hit, *_ in hits) and all(t != rows[9][1] for *_, t in clean)
    assert pipeline.line_dedup(spark, docs, "").count() == len(rows)


def test_language_stage_decides(spark):
    import corpus_pipeline as pipeline

    r = random.Random(5)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(2, 7)))
    rows = [(i, " ".join(word(a) for _ in range(30)), lang) for i, (lang, a) in enumerate([("aa", "abcd"), ("bb", "nopq"), ("cc", "stuv")] * 40)]
    rows += [(900, "zz9 " * 40 + "kk7 " * 40, None), (901, "abc", None), (902, "123", None), (None, " ".join(word("abcd") for _ in range(30)), None)]
    docs = spark.createDataFrame([(d, t, x, "s", 1) for d, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in pipeline.language_id(spark, docs, "").collect()}
    assert set(range(120)) <= kept and 901 in kept and 902 not in kept and None in kept
    from tessera.llm.labelled import held_out
    from tessera.llm.language_id import fit, identify

    found = {x["doc_id"]: x["score"] for x in identify(spark, docs, fit(docs.filter(~held_out("doc_id")))).collect()}
    assert (900 in kept) == (found[900] >= 0.5)


def test_empty_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline
    from tessera.llm import token_orc
    from tessera.llm.tokens import public_path

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    token_orc.write_token_ids(none, str(tmp_path / "ids"), public_path())
    assert token_orc.token_index(spark, str(tmp_path / "ids")).count() == 0


def test_ids_are_the_librarys(spark, tmp_path):
    """Token files and packing give what an untouched Tokenizer gives, strings of added tokens included, and starts follow the files' rows."""
    tokenizers = pytest.importorskip("tokenizers")
    from tessera.llm import token_orc
    from tessera.llm.packing import pack
    from tessera.llm.tokens import encoder, public_path

    lib = tokenizers.Tokenizer.from_file(public_path())
    ids = lambda t: lib.encode(t or "", add_special_tokens=False).ids
    assert ids("<|endoftext|>") == [50256]
    odd = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "two  spaces\n\nend ", "\tx", "a\x1cb", None, "", "naïve　wide", "it's,,, ok!?"]
    r = random.Random(3)
    odd += ["".join(r.choice("ab \n\t.é\xa0\x00d,漢$1'") for _ in range(r.randint(0, 60))) for _ in range(300)]
    rows = [(i // 3, t) for i, t in enumerate(odd)]  # three texts share an id
    path = str(tmp_path / "ids")
    token_orc.write_token_ids(frame(spark, rows), path, public_path(), end_id=0)
    stored = token_orc.read_token_ids(spark, path).withColumn("file", F.col("_metadata.file_name")).collect()
    stored = sorted(stored, key=lambda x: (x["file"], x["row"]))
    assert Counter((x["doc_id"], tuple(x["ids"])) for x in stored) == Counter((d, (*ids(t), 0)) for d, t in rows)
    assert [x["doc_id"] for x in stored] == sorted(x["doc_id"] for x in stored)
    at, want = 0, []
    for x in stored:
        want.append((x["doc_id"], at, len(x["ids"]), zlib.crc32(np.array(x["ids"], "<u4").tobytes())))
        at += len(x["ids"])
    assert sorted(tuple(x) for x in token_orc.token_index(spark, path).collect()) == sorted(want)
    pieces = Counter((x["doc_id"], x["length"], x["ids_crc32"]) for x in pack(spark, frame(spark, rows), public_path(), 1024, 2).collect())
    assert pieces == Counter((d, len(ids(t)) + 1, zlib.crc32(np.array([*ids(t), 2], "<u4").tobytes())) for d, t in rows)
    enc = encoder(public_path())
    for t in odd:
        assert np.frombuffer(enc.encode_many([t or ""])[0], "<u4").tolist() == ids(t), t


def test_shares_follow_the_counts():
    from tessera.llm.packing import shares_of

    counts = [(1024, 4 * 10**9), (7, 3 * 10**9), (8, 5)]
    shares = shares_of(counts, 20_000)
    assert all(n / shares[size] <= 1_000_000 for size, n in counts) and shares[8] == 1 and sum(shares.values()) < 200_000
    assert shares_of([(5, 100)], 211)[5] == 100 and shares_of([], 8) == {}


def test_bloom_filter_has_no_false_negatives(spark):
    from tessera.llm.store import bitmap, in_bitmap

    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    bits = bitmap(keys, "k")
    own = np.array([x["k"] for x in keys.collect()], np.int64).view(np.uint64)
    other = np.array([x["k"] for x in spark.range(10**6, 10**6 + 50_000).select(F.xxhash64("id").alias("k")).collect()], np.int64).view(np.uint64)
    assert len(in_bitmap(bits, own)) == 5000 and len(in_bitmap(bits, other)) < 50
    assert len(in_bitmap(bitmap(keys.limit(0), "k"), own)) == 0


def test_hot_words_in_items(spark):
    """A one-word item that is everywhere: every occurrence is a hit, none is lost."""
    from tessera.llm.decontaminate import contamination

    rows = [(i, " ".join(x for _ in range(60) for x in ("the", R.choice("abcdefgh") * 3))) for i in range(40)] + [(None, "the"), (50, "The the THE")]
    items = [(1, "the"), (2, "the aaa the"), (3, rows[0][1])]
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], tuple(r["items"])) for r in contamination(spark, frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == brute_hits(rows, items)
