"""Quality classification by histogram gradient-boosted trees over document statistics.

The statistics of a whole text (lengths, repetition, character classes, lines) are
computed in Arrow batches; the trees, trained on the driver from a bounded sample
of labelled documents, lie in flat arrays that numpy traverses for a whole batch.

Nulls, empties, repeats: a null text counts as empty, whose statistics are zeros
and which gets a score like any other.  Rows are scored alone, so repeats agree.
Without a labelled row the score is 0.5.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .store import fold
from .trees import Forest, fit_forest

FEATURES = ("log_words", "log_chars", "mean_word", "longest_word", "distinct_words", "repeated_neighbours", "top_word", "symbols", "punctuation", "digits", "upper", "exclamation", "lines", "repeated_lines", "mean_line", "other_bytes")
_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))


def statistics(text: bytes | None) -> list[float]:
    """The FEATURES of one whole text."""
    t = text or b""
    size = max(1, len(t))
    without = lambda drop: (len(t) - len(t.translate(None, drop))) / size
    w = t.split()
    n, lines = max(1, len(w)), [x for x in t.split(b"\n") if x]
    counts = Counter(w)
    same = sum(map(bytes.__eq__, w, w[1:]))
    k = max(1, len(lines))
    return [
        float(np.log1p(len(w))), float(np.log1p(len(t))), sum(map(len, w)) / n, float(np.log1p(max(map(len, w), default=0))), len(counts) / n, same / n, max(counts.values(), default=0) / n,
        without(b"#*$%&|<>"), without(b".,;:?!-'\"()"), without(b"0123456789"), without(_UPPER), without(b"!"), len(lines) / n, 1 - len(set(lines)) / k if lines else 0.0, len(t) / k / 100, 1 - without(_LETTERS) - without(b" \n") if t else 0.0,
    ]


def _matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Trains on about ``sample`` labelled documents outside the held-out fifth."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = labelled_sample(docs, labels, label_col, sample, id_col, text_col).mapInArrow(run, "doc_id long, label int, x array<double>").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["label"], r["x"]))
    return fit_forest(np.array([r["x"] for r in rows], float).reshape(-1, len(FEATURES)), np.array([r["label"] == 1 for r in rows], float))


def score(spark: SparkSession, docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score.  Only the text is read."""
    shared = spark.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.probability(_matrix(part.column(1).to_pylist())))], ["doc_id", "score"])

    src = fold(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, score double")
