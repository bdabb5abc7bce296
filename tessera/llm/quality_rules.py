"""Quality rules as a learned decision list.

Fixed base rules come first.  Further rules are learned by sequential covering
from labelled document statistics: a rule grows as a conjunction of thresholds by
information gain on one part of the sample, is pruned back on the other, and joins
the list while it is precise; the documents it covers leave the sample.  The list
is emitted as one ordered Spark conditional expression over the statistics, so
judging a document is a column expression.

Nulls, empties, repeats: a null text has no words and fails the base rules, like
an empty one.  Rows are judged alone, so repeats agree.  Without a labelled row
the list is empty and the base rules decide.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .store import fold

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct")
#: What rules test: names and their SQL over COUNTS.
MEASURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
_SYMBOLS = b"#*$%&|<>"
_NOT_CHARS = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))  # spaces and the continuation bytes of a code point
_UPPER = bytes(range(0x41, 0x5B))


def repeated_words(w: list[bytes], k: int = 5) -> int:
    """Words inside k-word windows that occur twice or more, first occurrences included."""
    runs = list(zip(*(w[i:] for i in range(k)), strict=False))
    counts = Counter(runs)
    if len(counts) == len(runs):
        return 0
    total, end = 0, 0
    for i, run in enumerate(runs):
        if counts[run] > 1:
            total += i + k - max(i, end)
            end = i + k
    return total


def counts_of(text: bytes | None) -> tuple[int, ...]:
    """The COUNTS of one whole text."""
    t = text or b""
    w, seen, again, lines = t.split(), set(), 0, 0
    for line in t.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    drop = lambda chars: len(t) - len(t.translate(None, chars))
    return len(w), len(t) - drop(_NOT_CHARS), drop(_SYMBOLS), again, repeated_words(w), lines, drop(_UPPER), len(set(w))


def text_counts(docs: DataFrame, *carry: str, text_col: str = "text") -> DataFrame:
    """The ``carry`` columns and COUNTS of each row."""
    src = docs.select(*carry, F.col(text_col).cast("binary").alias("text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:-1]] + [f"{c} long" for c in COUNTS])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([counts_of(t) for t in part.column(part.num_columns - 1).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(len(COUNTS)))], [*part.schema.names[:-1], *COUNTS])

    return src.mapInArrow(run, schema)


@dataclass(frozen=True)
class Test:
    measure: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.measure] > self.value if self.above else x[self.measure] <= self.value

    @property
    def sql(self) -> str:
        return f"{MEASURES[self.measure]} {'>' if self.above else '<='} {self.value!r}D"


def covers(rule: list[Test], x: dict[str, np.ndarray], n: int) -> np.ndarray:
    on = np.ones(n, bool)
    for test in rule:
        on &= test.holds(x)
    return on


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, tests: list[Test], held: np.ndarray) -> list[Test]:
    """Adds the test of most information gain while the rule covers any good document."""
    rule: list[Test] = []
    on = np.ones(len(bad), bool)
    while (on & ~bad).any() and len(rule) < 4:
        p, n = (on & bad).sum(), (on & ~bad).sum()
        p1, n1 = held[:, on & bad].sum(axis=1), held[:, on & ~bad].sum(axis=1)
        gain = np.where(p1 > 0, p1 * (np.log2(np.maximum(p1, 1) / np.maximum(p1 + n1, 1)) - np.log2(max(p, 1) / max(p + n, 1))), 0)
        best = int(gain.argmax())
        if gain[best] <= 1e-9:
            break
        rule.append(tests[best])
        on &= held[best]
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most: int = 16, seed: int = 11) -> list[list[Test]]:
    """An ordered list of rules for bad documents, by sequential covering with pruning."""
    rng, rules, live = np.random.default_rng(seed), [], np.ones(len(bad), bool)
    # Thresholds lie midway between neighbouring quantiles.
    values = {k: np.unique(np.quantile(v, np.linspace(0, 1, 80))) for k, v in x.items()} if len(bad) else {}
    values = {k: (v[1:] + v[:-1]) / 2 for k, v in values.items()}
    tests = [Test(k, above, float(v)) for k, vs in values.items() for v in vs for above in (True, False)]
    held_all = np.array([t.holds(x) for t in tests]) if tests else np.zeros((0, len(bad)), bool)
    while len(rules) < most and (bad & live).sum() >= 10:
        at = rng.permutation(np.flatnonzero(live))
        grow, prune = np.split(at, [2 * len(at) // 3])
        rule = _grow({k: v[grow] for k, v in x.items()}, bad[grow], tests, held_all[:, grow])
        if not rule:
            break

        def worth(r: list[Test]) -> tuple[float, int]:
            on = covers(r, {k: v[prune] for k, v in x.items()}, len(prune))
            p, n = int((on & bad[prune]).sum()), int((on & ~bad[prune]).sum())
            return ((p - n) / (p + n) if p + n else -1.0, p)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        ratio, hits = worth(rule)
        if hits < 3 or (ratio + 1) / 2 < precision:
            break
        rules.append(rule)
        live &= ~covers(rule, x, len(bad))
    return rules


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> list[list[Test]]:
    """Learns the list from about ``sample`` labelled documents outside the held-out fifth."""
    drawn = text_counts(labelled_sample(docs, labels, label_col, sample, id_col, text_col), "doc_id", "label")
    rows = drawn.filter("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words").select("doc_id", "label", *[F.expr(e).alias(k) for k, e in MEASURES.items()]).collect()
    rows = sorted(rows, key=tuple)
    return learn({k: np.array([r[k] for r in rows], float) for k in MEASURES}, np.array([r["label"] == 0 for r in rows], bool))


def verdict(rules: list[list[Test]]) -> Column:
    """The list as one ordered conditional: the first rule that holds rejects, else the document stays."""
    out = None
    for rule in rules:
        test = F.expr(" AND ".join(f"({t.sql})" for t in rule))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[Test]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, COUNTS, base_failed, kept."""
    counts = text_counts(fold(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    base = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return counts.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))
