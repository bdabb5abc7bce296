"""The filter audit, spelling variants and toxicity against brute-force versions."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from .test_operators import corpus, frame, prose

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string, part string")


def brute_audit(rows, labels):
    """Every order of the filters, run one after the other."""
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good, toxic = ({d for d, q, x, *_ in labels if d is not None and (q, x)[k] == 1} for k in (0, 1))

    def fails(d, t):
        t, w = t or "", SPACE.findall(t or "")
        return {f for f, on in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > least[t]), strict=True) if on}

    docs = [(p or "", d, fails(d, t)) for d, t, p in rows]
    out, share = {}, Counter()
    for part in {p for p, *_ in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [(d, bad) for p, d, bad in docs if p == part]
            for k, f in enumerate(order):
                gone = [(d, bad) for d, bad in left if f in bad]
                every = [bad for p, _, bad in docs if p == part and f in bad]
                left = [x for x in left if f not in x[1]]
                share[part, f] += len(gone)
                out[part, "".join(order), k + 1] = (len(left), len(gone), len(every) - len(gone), sum(bad == {f} for bad in every), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, docs, labels):
    from tessera.llm.filter_audit import audit, failures, joint_failures

    found = audit(joint_failures(failures(docs, labels), "ABCDE"), "ABCDE").collect()
    return {tuple(r[:3]): tuple(r[3:]) for r in found}


def test_filter_audit(spark):
    r = random.Random(5)
    rows = [(d, t, r.choice(["en", "de", None, ""])) for d, t in corpus()]
    rows += [(100 + i, r.choice(["LOUD " * 120, "a # b " + prose(120, r), prose(130, r), "same words " * 70, "", None]), r.choice(["en", "de"])) for i in range(60)]
    rows += [rows[0], rows[-1], (None, rows[0][1], "de"), (3, rows[1][1], "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None]), "x", "y") for i in range(0, 160, 2)] + [(2, 1, 1, "x", "y"), (None, 1, 1, "x", "y")]
    docs = spark.createDataFrame([(d, t, p, "k", 1, 2, True) for d, t, p in rows], "doc_id long, text string, lang string, key string, n long, low long, good boolean")
    assert audited(spark, docs, labels_of(spark, labels)) == brute_audit(rows, labels)
    assert audited(spark, docs.limit(0), labels_of(spark, labels)) == {}
    assert set(audited(spark, docs, labels_of(spark, labels).limit(0))) == set(brute_audit(rows, []))


def test_audit_of_other_filters(spark):
    """Three filters, and shares that sum to what all of them remove, in every order."""
    from tessera.llm.filter_audit import audit, joint_failures

    flagged = spark.createDataFrame([("p", i & 1, i >> 1 & 1, i >> 2 & 1, i % 3 == 0, i % 5 == 0, i + 1) for i in range(8)], "part string, X long, Y long, Z long, good boolean, toxic boolean, n long")
    flagged = flagged.withColumn("good", flagged.good.cast("long")).withColumn("toxic", flagged.toxic.cast("long"))
    found = audit(joint_failures(flagged, "XYZ"), "XYZ").collect()
    assert len(found) == 18
    lost = sum(i + 1 for i in range(1, 8))
    for order, steps in itertools.groupby(sorted(found, key=lambda x: (x["filter_order"], x["step"])), key=lambda x: x["filter_order"]):
        steps = list(steps)
        assert sum(x["removed"] for x in steps) == lost and sum(x["shapley"] for x in steps) == 6 * lost, order
        assert steps[-1]["kept"] == 1


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(counts):
    words, out, form = sorted(counts), {}, {}
    for w in words:
        beside = [v for v in words if near(w, v)]
        best = min(beside, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
        out[w] = (form[w], counts[w], len(beside), counts[best] if form[w] else None)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def grouped(spark, counts, **options):
    from tessera.llm.spelling import variant_groups

    df = spark.createDataFrame([(w, n, "x", 0) for w, n in counts.items()], "word string, n long, node string, form int")
    found = variant_groups(spark, df, **options).collect()
    assert len(found) == len(counts)
    return {r["word"]: tuple(r[1:]) for r in found}


@pytest.mark.parametrize("task_words", [3, 40, 10_000])
def test_variant_groups(spark, task_words):
    """Small partitions, with one prefix before nearly all words, doubled letters and words that are prefixes of others."""
    r = random.Random(task_words)
    words = {"präfix" + "".join(r.choice("abÿ") for _ in range(r.randint(0, 4))) for _ in range(120)} | {"präfi", "präfixaa", "prräfix", "a" * 30, "a" * 31, "a" * 32, "ab" * 9, "zzzzzz", "räfix", "präfixaaaaaaaa"}
    counts = {w: r.choice([5, 6, 30, 31, 160, 900]) for w in words}
    assert grouped(spark, counts, task_words=task_words) == brute_groups(counts)


def test_no_words(spark):
    from tessera.llm.spelling import variant_groups, vocabulary

    docs = frame(spark, [(1, "short"), (2, None), (3, "")])
    assert vocabulary(docs).count() == 0
    assert variant_groups(spark, vocabulary(docs)).count() == 0
    assert grouped(spark, {"alone": 5, "Zürich": 6}) == brute_groups({"alone": 5, "Zürich": 6})


def test_vocabulary(spark):
    from tessera.llm.spelling import vocabulary

    r = random.Random(8)
    rows = corpus() + [(i, " ".join(r.choice(["Straßenbahn", "ÀÉÿ÷×ab", "naïveté", "x1wordy", "Wordyword", "ungemein_ungemein", "KELVINſ"]) for _ in range(400))) for i in range(50, 90)] + [(None, "lonely lonely lonely lonely lonely")]
    counts = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    want = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    assert {r["word"]: r["n"] for r in vocabulary(frame(spark, rows)).collect()} == want


def test_whole_vocabulary_against_deletions(spark):
    """The query's words, joined by their deletions instead of a trie."""
    from tessera.llm.queries import op12_spelling_variants

    found = {r["word"]: r for r in op12_spelling_variants(spark, "/root/testdata/sf0.001").collect()}
    holes, links = {}, {w: set() for w in found}
    for w in found:
        for i in range(len(w)):
            holes.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
            if w[:i] + w[i + 1 :] in found:
                links[w].add(w[:i] + w[i + 1 :])
                links[w[:i] + w[i + 1 :]].add(w)
    for same in holes.values():
        for a, b in itertools.permutations(same, 2):
            links[a].add(b)
    assert {w: len(x) for w, x in links.items()} == {w: r["n_near"] for w, r in found.items()}
    for w, r in found.items():
        best = min(links[w], key=lambda v: (-found[v]["n"], v), default=None)
        assert r["form"] == (best if best and found[best]["n"] >= 5 * r["n"] else None)


def test_toxicity_gradients():
    """Analytic gradients against central differences."""
    from tessera.llm.toxicity import gradients, grams

    rng = np.random.default_rng(2)
    words = grams([b"idiot", b"clown", b"hello", b"a"], 64)
    table, out, bias = rng.normal(size=(64, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    bags, y = [np.array([0, 1, 1]), np.array([2]), np.array([3, 0])], np.array([1, 0, 0])
    loss = lambda: gradients(table, out, bias, bags, words, y)[0]
    _, (rows, d_rows), d_out, d_bias = gradients(table, out, bias, bags, words, y)
    whole = np.zeros_like(table)
    whole[rows] = d_rows
    for value, grad in ((table, whole), (out, d_out), (bias, d_bias)):
        for at in np.ndindex(value.shape):
            kept, value[at] = value[at], value[at] + 1e-6
            up = loss()
            value[at] = kept - 1e-6
            down, value[at] = loss(), kept
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-6


def test_toxicity_windows_cover_the_text():
    from tessera.llm.toxicity import starts

    for n in range(1, 120):
        at = starts(n, 16)
        assert at[0] == 0 and set().union(*(range(s, min(n, s + 16)) for s in at)) == set(range(n)) and len(set(at.tolist())) == len(at)


def test_score_is_the_network(spark):
    """The leaning of words against the whole network, window by window."""
    from tessera.llm.toxicity import Model, Scorer, grams, starts, tokens

    rng = np.random.default_rng(3)
    m = Model(rng.normal(size=(512, 4)), rng.normal(size=(4, 2)), rng.normal(size=2), 16)
    for text in (b"", b"one", b"Some words, and more words! " * 9, "naïve Ünïcödé …".encode() * 30):
        words = tokens(text)
        keys, bounds = grams(words, 512) if words else (np.zeros(0, int), np.zeros(1, int))
        vectors = np.array([m.table[keys[a:b]].mean(axis=0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]).reshape(-1, 4)
        best = 0.0
        for s in starts(len(words), 16):
            mean = vectors[s : s + 16].mean(axis=0) if words else np.zeros(4)
            z = np.exp(mean @ m.out + m.bias)
            best = max(best, z[1] / z.sum())
        assert abs(Scorer(m).score(text) - best) < 1e-9


def test_toxicity_held_out(spark):
    """Held-out accuracy, toxic passages within long texts, misspellings that no training text has, and rows at the edges."""
    from tessera.llm.toxicity import fit, score

    r = random.Random(3)
    bad = ["wretched", "imbecile", "dimwit", "scoundrel"]

    def text(i, words, n):
        w = prose(n, r).split()
        for at in (range(5, n, 40) if i % 4 == 0 else ()):
            w[at] = r.choice(words)
        return " ".join(w)

    rows = [(i, text(i, bad, r.randint(20, 200))) for i in range(1200)]
    labels = [(i, 1, int(i % 4 == 0), "x", "y") for i, _ in rows] + [(1, 1, 0, "x", "y"), (None, 1, 1, "x", "y"), (7, None, None, "x", "y")]
    model = fit(frame(spark, rows), labels_of(spark, labels))
    long = prose(9000, r)
    probes = [(5000, long), (5001, long[: len(long) // 2] + " wretched imbecile " + long[len(long) // 2 :]), (5002, None), (5003, ""), (5004, " \n"), (None, "dimwit"), (5003, "")]
    slips = [(6000 + i, text(0, ["wretchedd", "imbecille", "dimmwit", "scoundrrel", "wrecthed", "imbeciles"], 60)) for i in range(20)]
    found = score(spark, frame(spark, rows + probes + slips), model).collect()
    got = {x["doc_id"]: x["score"] for x in found}
    assert len(found) == len(rows + probes + slips) and all(0 <= s <= 1 for s in got.values())
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 300 and sum((got[i] >= 0.7) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[5001] >= 0.7 > got[5000] and got[5002] == got[5003] == got[5004] < 0.7
    assert sum(got[i] >= 0.7 for i, _ in slips) >= 16
    assert fit(frame(spark, rows), labels_of(spark, labels).limit(0)) is None
    assert {x["score"] for x in score(spark, frame(spark, rows[:3]), None).collect()} == {0.5} and score(spark, frame(spark, rows).limit(0), model).count() == 0
