"""Toxicity by averaged subword embeddings and a linear softmax.

A word is the bag of its byte n-grams (with its two ends marked), each hashed to a
row of an embedding table.  A window of words is the mean of its words, a word the
mean of its n-grams, and a linear softmax over that mean gives the two classes.  An
unseen misspelling shares most of its n-grams, and so its vector, with the word it
comes from.  Embeddings and output layer are trained together in numpy.

A document is as toxic as its most toxic window: windows of ``window`` words overlap
by half and cover the whole text, so a passage counts in full however long the text
around it is.  Training comes to that rule in two parts: first a document is the mean
over some windows of it, drawn anew each time, which tells the words apart; then it is
represented by the window that scores highest at the time, so clean documents put
forward their hardest window.

Since the model is linear after the mean, scoring needs one number for each distinct
word; it is computed once per task and word (in bounded maps).

Nulls, empties, repeats: a null text counts as empty, and a text without words has
the score of the mean zero (the output layer's bias).  Rows are scored alone, so
repeats agree.  Without labelled rows the score is 0.5.  Long texts are read whole;
only training reads bounded windows of them.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .store import fold, trimmed

GRAMS = (3, 4, 5)
_EDGE = b"\x01"
_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MAP_WORDS = 200_000


@dataclass
class Model:
    """Embeddings (buckets x width), the output layer (width x 2, 2) and the window's words."""

    table: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    window: int

    def lean(self) -> tuple[np.ndarray, float]:
        """The log-odds of class 1 that each n-gram adds, and where they start."""
        return self.table @ (self.out[:, 1] - self.out[:, 0]), float(self.bias[1] - self.bias[0])


def tokens(text: bytes | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, without punctuation at their ends."""
    return [w for w in (x.strip(_STRIP) for x in (text or b"").lower().split()) if w]


def grams(words: list[bytes], buckets: int, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words in one array, and the bounds of each word's (at least one each)."""
    found, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for first in range(0, len(words), block):
        marked = [_EDGE + w + _EDGE for w in words[first : first + block]]
        size = np.array([len(w) for w in marked], np.int64)
        raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
        owner = np.repeat(np.arange(len(marked)), size)
        left = np.cumsum(size)[owner] - np.arange(len(raw))  # bytes to the word's end
        who, keys = [], []
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            h = np.full(len(at), n, np.uint64)
            for j in range(n):
                h = (h ^ raw[at + j]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            who.append(owner[at])
            keys.append((h >> np.uint64(20)) % np.uint64(buckets))
        who = np.concatenate(who)
        found.append(np.concatenate(keys)[np.argsort(who, kind="stable")].astype(np.int32))
        sizes.append(np.bincount(who, minlength=len(marked)))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


def slip(word: bytes, rng: np.random.Generator) -> bytes:
    """The word with one byte left out, doubled, replaced or changing places with the next; short words stay."""
    if len(word) < 4:
        return word
    at, kind = int(rng.integers(1, len(word) - 1)), int(rng.integers(4))
    if kind == 3:
        return word[:at] + word[at + 1 : at + 2] + word[at : at + 1] + word[at + 2 :]
    return word[:at] + (b"", word[at : at + 1] * 2, bytes([int(rng.integers(0x61, 0x7B))]))[kind] + word[at + 1 :]


def _means(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean of each run of rows; runs are not empty."""
    if len(bounds) < 2:
        return np.zeros((0, *values.shape[1:]), values.dtype)
    n = np.diff(bounds)
    return np.add.reduceat(values, bounds[:-1], axis=0) / (n[:, None] if values.ndim == 2 else n)


def _take(words: tuple[np.ndarray, np.ndarray], some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of some of the words, and their bounds."""
    keys, bounds = words
    n = bounds[some + 1] - bounds[some]
    own = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    return keys[np.arange(own[-1]) - np.repeat(own[:-1], n) + np.repeat(bounds[some], n)], own


def starts(n: int, window: int) -> np.ndarray:
    """First words of the windows over ``n`` words: half a window apart, the last one flush with the end."""
    if n <= window:
        return np.zeros(1, np.int64)
    step = window // 2
    return np.append(np.arange(0, n - window, step), n - window)


def gradients(table: np.ndarray, out: np.ndarray, bias: np.ndarray, bags: list[np.ndarray], words: tuple[np.ndarray, np.ndarray], y: np.ndarray):
    """Mean cross-entropy of windows and its gradients.

    bags: the words of each window; words: (n-gram ids, bounds) of all words.  Only
    rows of the table that occur have a gradient: (loss, (rows, gradient), out, bias).
    """
    used, inverse = np.unique(np.concatenate(bags), return_inverse=True)
    keys, own = _take(words, used)
    n = np.diff(own)
    rows, row = np.unique(keys, return_inverse=True)
    small = table[rows]
    vectors = _means(small[row], own)
    size = np.array([len(b) for b in bags])
    owner = np.repeat(np.arange(len(bags)), size)
    mean = _means(vectors[inverse], np.concatenate([np.zeros(1, np.int64), np.cumsum(size)]))
    z = mean @ out + bias
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    loss = -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-30)).mean())
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    d_mean = (p @ out.T) / size[:, None]
    d_vec = np.stack([np.bincount(inverse, d_mean[owner, k], len(used)) for k in range(out.shape[0])], axis=1) / n[:, None]
    word = np.repeat(np.arange(len(used)), n)
    d_rows = np.stack([np.bincount(row, d_vec[word, k], len(rows)) for k in range(out.shape[0])], axis=1)
    return loss, (rows, d_rows), mean.T @ p, p.sum(axis=0)


def train(docs: list[list[bytes]], labels: list[int], window: int = 16, buckets: int = 1 << 17, width: int = 8, steps: int = 800, batch: int = 128, rate: float = 3.0, eps: float = 1e-5, keep: float = 0.7, slip_share: float = 0.3, spread_windows: int = 6, seed: int = 11) -> Model:
    """Fits embeddings and output layer by about ``steps`` steps of Adagrad.  ``docs`` are lists of windows, windows words with spaces between.

    For half of the steps a document gives the words of ``spread_windows``
    windows, then those of the window that scores highest under the model as it
    stands.  A share ``1 - keep`` of each word's n-grams is left out, so that no single one carries a word, and a share
    ``slip_share`` of the words is misspelt anew.
    ``eps`` starts Adagrad's sums: n-grams met rarely move little.
    """
    rng = np.random.default_rng(seed)
    names = sorted({w for d in docs for ws in d for w in ws.split()})
    number = {w: i for i, w in enumerate(names)}
    full = [i for i, d in enumerate(docs) if any(d)]
    cuts = [[ws for ws in docs[i] if ws] for i in full]
    of = np.cumsum([0] + [len(d) for d in cuts])
    edges = np.cumsum([0] + [len(ws.split()) for d in cuts for ws in d])
    held = np.fromiter((number[w] for d in cuts for ws in d for w in ws.split()), np.int32, int(edges[-1]))
    y = np.asarray(labels, np.int64)[full]
    words = grams(names, buckets)
    del cuts, number
    table = rng.normal(0, 0.1, (buckets, width))
    out, bias = rng.normal(0, 0.3, (width, 2)), np.zeros(2)
    squares = [np.full((buckets, width), eps), np.full((width, 2), eps), np.full(2, eps)]
    rounds = max(1, len(full) // batch)
    for epoch in range(-(-steps // rounds) if full else 0):
        if epoch * rounds < steps // 2:
            picks = rng.integers(of[:-1, None], of[1:, None], (len(full), spread_windows))
        else:
            value = _means(_means((table @ (out[:, 1] - out[:, 0]))[words[0]], words[1])[held], edges)
            picks = np.array([[a + int(value[a:b].argmax())] for a, b in zip(of[:-1], of[1:], strict=True)])
        for cut in np.array_split(rng.permutation(len(full)), rounds):
            bags = [np.concatenate([held[edges[k] : edges[k + 1]] for k in picks[i]]) for i in cut]
            size = np.cumsum([0] + [len(b) for b in bags])
            some, at = np.unique(np.concatenate(bags), return_inverse=True)
            slipped = np.flatnonzero(rng.random(len(at)) < slip_share)
            new = grams([slip(names[some[i]], rng) for i in at[slipped]], buckets)
            at[slipped] = len(some) + np.arange(len(slipped))
            keys, bounds = _take(words, some)
            keys, bounds = np.concatenate([keys, new[0]]), np.concatenate([bounds, bounds[-1] + new[1][1:]])
            stay = rng.random(len(keys)) < keep
            stay[bounds[:-1]] = True  # no word is left without any
            bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(stay)])[bounds]
            _, (rows, d_rows), d_out, d_bias = gradients(table, out, bias, [at[a:b] for a, b in zip(size[:-1], size[1:], strict=True)], (keys[stay], bounds), y[cut])
            squares[0][rows] += d_rows * d_rows
            table[rows] -= rate * d_rows / np.sqrt(squares[0][rows])
            for value, square, grad in ((out, squares[1], d_out), (bias, squares[2], d_bias)):
                square += grad * grad
                value -= 0.1 * rate * grad / np.sqrt(square)
    return Model(table, out, bias, window)


def _cut(words: list[bytes], window: int, most: int) -> list[list[bytes]]:
    at = starts(len(words), window)
    if len(at) > most:
        at = at[np.linspace(0, len(at) - 1, most).astype(int)]
    return [words[s : s + window] for s in at]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = 6000, per_doc: int = 48, window: int = 16, id_col: str = "doc_id", text_col: str = "text", share: int = 3, rest: int = 1) -> Model | None:
    """Trains on about ``sample`` labelled documents outside the held-out third, at most ``per_doc`` windows of each."""

    def run(batches):
        for batch in batches:
            cuts = [[b" ".join(w) for w in _cut(tokens(t), window, per_doc)] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cuts, pa.list_(pa.binary()))], ["doc_id", "label", "cuts"])

    rows = labelled_sample(docs, labels, label_col, sample, id_col, text_col, share, rest).mapInArrow(trimmed(run), "doc_id long, label int, cuts array<binary>").collect()
    rows = sorted((r["doc_id"], r["label"], [bytes(c) for c in r["cuts"]]) for r in rows)
    return train([cuts for _, _, cuts in rows], [int(label == 1) for _, label, _ in rows], window) if rows else None


class Scorer:
    """Probabilities of whole texts, with the leanings of words met before in a bounded map."""

    def __init__(self, model: Model):
        self.lean, self.bias = model.lean()
        self.window, self.known = model.window, {}

    def _learn(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > _MAP_WORDS:
            self.known.clear()
            new = list(words)
        for a in range(0, len(new), 8192):
            part = new[a : a + 8192]
            keys, bounds = grams(part, len(self.lean))
            self.known.update(zip(part, _means(self.lean[keys], bounds).tolist(), strict=True))

    def score(self, text: bytes | None) -> float:
        words = tokens(text)
        top = 0.0
        if words:
            self._learn(set(words))
            run = np.concatenate([np.zeros(1), np.cumsum([self.known[w] for w in words])])
            at = starts(len(words), self.window)
            end = np.minimum(at + self.window, len(words))
            top = float(((run[end] - run[at]) / (end - at)).max())
        return float(1 / (1 + np.exp(-np.clip(top + self.bias, -60, 60))))


def score(spark: SparkSession, docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score.  Only the text is read."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for batch in batches:
            found = [scorer.score(t.as_py()) if scorer else 0.5 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    src = fold(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(trimmed(run), "doc_id long, score double")
