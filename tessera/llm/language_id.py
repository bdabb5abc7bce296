"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read windows of ``window`` bytes, one in each direction; every byte
position gets a probability for each language, and a document's probabilities are
the mean over all positions of its whole text.  Training is plain numpy:
backpropagation through time with Adam, on windows cut from a bounded sample of
labelled documents (``sample_docs``), drawn by a hash of their ids in equal shares
for each language.

Nulls, empties, repeats: a null text or one without a letter is ``und`` with score
0.  Every row is predicted alone, so repeats agree.  Long texts are read whole.
An empty table gives an empty result; without any training row every document is
``und``.  More than 4096 distinct labels are an error.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bound_batches, trimmed

UNKNOWN = "und"


@dataclass
class Model:
    """Gate tables (byte x 3H), recurrent weights (H x 3H) for each direction, and the output layer."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray
    window: int

    @property
    def width(self) -> int:
        return self.recurrent[0].shape[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _states(table: np.ndarray, u: np.ndarray, x: np.ndarray, lengths: np.ndarray | None, tape: list | None = None) -> np.ndarray:
    """Hidden states (steps, batch, H) of one direction; x is (steps, batch).  Past a window's end the state stays."""
    steps, batch = x.shape
    w = u.shape[0]
    out = np.empty((steps, batch, w), np.float32)
    h = np.zeros((batch, w), np.float32)
    for t in range(steps):
        g = table[x[t]]
        r = h @ u
        zr = _sigmoid(g[:, : 2 * w] + r[:, : 2 * w])
        hn = r[:, 2 * w :]
        n = np.tanh(g[:, 2 * w :] + zr[:, w:] * hn)
        new = n + zr[:, :w] * (h - n)
        if lengths is not None:
            new = np.where((lengths > t)[:, None], new, h)
        if tape is not None:
            tape.append((h, zr, n, hn))
        out[t] = h = new
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def _backward_order(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each window read from its own end; padding stays behind."""
    steps = np.arange(x.shape[0])[:, None]
    at = lengths[None, :] - 1 - steps
    return np.where(at >= 0, np.take_along_axis(x, np.maximum(at, 0), axis=0), 0)


def _fast_states(table: np.ndarray, u: np.ndarray, x: np.ndarray, lengths: np.ndarray | None) -> np.ndarray:
    """As _states, without allocation in the loop; the gate halves of table and u are halved beforehand."""
    steps, batch = x.shape
    w = u.shape[0]
    out = np.empty((steps, batch, w), np.float32)
    g, r = np.empty((batch, 3 * w), np.float32), np.empty((batch, 3 * w), np.float32)
    zr, n = np.empty((batch, 2 * w), np.float32), np.empty((batch, w), np.float32)
    h = np.zeros((batch, w), np.float32)
    for t in range(steps):
        np.take(table, x[t], axis=0, out=g, mode="clip")
        np.matmul(h, u, out=r)
        np.add(g[:, : 2 * w], r[:, : 2 * w], out=zr)
        np.tanh(zr, out=zr)  # sigmoid(2 a) = (1 + tanh(a)) / 2
        zr += 1
        zr *= 0.5
        np.multiply(zr[:, w:], r[:, 2 * w :], out=n)
        n += g[:, 2 * w :]
        np.tanh(n, out=n)
        new = out[t]
        np.subtract(h, n, out=new)
        new *= zr[:, :w]
        new += n
        if lengths is not None:
            over = lengths <= t
            new[over] = h[over]
        h = new
    return out


def position_probabilities(model: Model, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum over positions of each window's language probabilities: (windows, languages)."""
    full = bool((lengths == x.shape[0]).all())
    mask, w = None if full else lengths, model.width
    half = np.r_[np.full(2 * w, 0.5, np.float32), np.ones(w, np.float32)]
    fore = _fast_states(model.tables[0] * half, model.recurrent[0] * half, x, mask)
    rear = x[::-1] if full else _backward_order(x, lengths)
    back = _fast_states(model.tables[1] * half, model.recurrent[1] * half, rear, mask)
    steps, total = x.shape[0], np.zeros((x.shape[1], len(model.languages)), np.float32)
    for t in range(steps):
        if full:
            other = back[steps - 1 - t]
        else:
            other = back[np.maximum(lengths - 1 - t, 0), np.arange(len(lengths))]
        p = fore[t] @ model.out[:w]
        p += other @ model.out[w:]
        p += model.bias
        np.minimum(p, 60, out=p)  # far below overflow, so no maximum need be taken off
        np.exp(p, out=p)
        p /= (p @ np.ones((p.shape[1], 1), np.float32)) + np.float32(1e-30)
        if not full:
            p *= (lengths > t)[:, None]
        total += p
    return total


def gradients(par: dict[str, np.ndarray], xs: np.ndarray, ls: np.ndarray, ys: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over all positions and its gradient by backpropagation through time.

    xs: bytes (steps x batch); ls: lengths; ys: languages.
    """
    (steps, batch), w = xs.shape, par["u0"].shape[0]
    rear = _backward_order(xs, ls)
    tapes: list[list] = [[], []]
    fore = _states(par["t0"], par["u0"], xs, ls, tapes[0])
    back = _states(par["t1"], par["u1"], rear, ls, tapes[1])
    at = ls[None, :] - 1 - np.arange(steps)[:, None]
    on, take = (at >= 0), np.maximum(at, 0)
    both = np.concatenate([fore, np.take_along_axis(back, take[:, :, None], axis=0)], axis=2)
    p = _softmax(both @ par["out"] + par["bias"])
    loss = -float((np.log(np.maximum(p[:, np.arange(batch), ys], 1e-30)) * on).sum()) / max(1, on.sum())
    p[:, np.arange(batch), ys] -= 1
    p *= (on / max(1, on.sum()))[:, :, None].astype(np.float32)  # cross-entropy of every position
    grad = {"out": np.einsum("tbw,tbk->wk", both, p, optimize=True), "bias": p.sum(axis=(0, 1))}
    d = p @ par["out"].T
    d_back = np.zeros_like(back)
    np.put_along_axis(d_back, np.where(on, take, 0)[:, :, None], np.where(on[:, :, None], d[:, :, w:], 0), axis=0)
    d_back[0] = np.where((ls > 0)[:, None], d[np.maximum(ls - 1, 0), np.arange(batch), w:], 0)  # position 0 is written once
    for name, seq, tape, dh_out in (("0", xs, tapes[0], d[:, :, :w]), ("1", rear, tapes[1], d_back)):
        u = par["u" + name]
        gt, gu = np.zeros_like(par["t" + name]), np.zeros_like(u)
        dh = np.zeros((batch, w), np.float32)
        for t in range(steps - 1, -1, -1):
            h, zr, n, hn = tape[t]
            live = (ls > t)[:, None]
            dh = dh + dh_out[t]
            z, r = zr[:, :w], zr[:, w:]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            pre = np.where(live, np.concatenate([dz, dr, dn], axis=1), 0)
            rec = np.where(live, np.concatenate([dz, dr, dn * r], axis=1), 0)
            np.add.at(gt, seq[t], pre)
            gu += h.T @ rec
            dh = np.where(live, dh * z, dh) + rec @ u.T
        grad["t" + name], grad["u" + name] = gt, gu
    return loss, grad


def train(texts: list[bytes], labels: list[str], window: int = 64, width: int = 8, epochs: int = 3, batch: int = 192, rate: float = 0.02, seed: int = 7) -> Model:
    """Fits the network on windows (at most ``window`` bytes each) and their documents' languages."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    x = np.zeros((window, len(texts)), np.uint8)
    lengths = np.array([min(len(t), window) for t in texts])
    for i, t in enumerate(texts):
        x[: lengths[i], i] = np.frombuffer(t[:window], np.uint8)
    w, k = width, len(names)
    shape = {"t0": (256, 3 * w), "t1": (256, 3 * w), "u0": (w, 3 * w), "u1": (w, 3 * w), "out": (2 * w, k), "bias": (k,)}
    par = {n: (rng.normal(0, 0.3 if n[0] != "b" else 0, s)).astype(np.float32) for n, s in shape.items()}
    mean, var, step = {n: np.zeros_like(v) for n, v in par.items()}, {n: np.zeros_like(v) for n, v in par.items()}, 0
    for _ in range(epochs):
        for cut in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            if not len(cut):
                continue
            _, grad = gradients(par, x[:, cut], lengths[cut], y[cut])
            step += 1
            for n, g in grad.items():
                mean[n] += 0.1 * (g - mean[n])
                var[n] += 0.01 * (g * g - var[n])
                par[n] -= (rate * (mean[n] / (1 - 0.9**step)) / (np.sqrt(var[n] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return Model(names, [par["t0"], par["t1"]], [par["u0"], par["u1"]], par["out"], par["bias"], window)


def document_probabilities(model: Model, texts: list[bytes], block: int = 1024) -> np.ndarray:
    """Pooled language probabilities of whole texts."""
    w = model.window
    pooled = np.zeros((len(texts), len(model.languages)))
    parts = [np.zeros(0, np.uint8)]
    owner, size = [], []
    for i, t in enumerate(texts):
        full, rest = divmod(len(t), w)
        owner += [i] * (full + (rest > 0))
        size += [w] * full + [rest] * (rest > 0)
        parts.append(np.frombuffer(t, np.uint8))
        if rest:
            parts.append(np.zeros(w - rest, np.uint8))
    if not owner:
        return pooled
    x = np.concatenate(parts).reshape(-1, w)
    who, lengths = np.array(owner), np.array(size)
    order = np.argsort(lengths == w, kind="stable")  # short windows together: only they need a mask
    for a in range(0, len(order), block):
        at = order[a : a + block]
        np.add.at(pooled, who[at], position_probabilities(model, np.ascontiguousarray(x[at].T), lengths[at]))
    return pooled / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


#: Distinct labels that are still languages; a column with more is not one.
MOST_LANGUAGES = 4096


def training_windows(docs: DataFrame, sample_docs: int, per_doc: int, window: int) -> list[tuple[str, bytes]]:
    """Windows spread over the whole texts of a hashed sample of labelled documents.

    ``docs`` has doc_id, text, lang.  The share of a language is sample_docs over
    the number of languages (one document at least), so the sample's size doesn't
    depend on the corpus.  Equal windows of one document id count once.
    """
    known = docs.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    if not counts:
        return []
    share = max(1, sample_docs // len(counts))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40)) / float(1 << 40)
    rate = F.create_map(*[F.lit(x) for pair in ((k, share / n) for k, n in counts.items()) for x in pair])
    drawn = known.filter(draw < F.element_at(rate, F.col("lang"))).select("doc_id", "lang", F.col("text").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            rows = []
            for d, lang, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = max(0, len(t) - window)
                starts = sorted({round(last * k / max(1, per_doc - 1)) for k in range(per_doc)})
                rows += [(d, k, lang, t[s : s + window]) for k, s in enumerate(starts) if t]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.binary()), strict=True)], ["doc_id", "k", "lang", "cut"])

    cuts = drawn.mapInArrow(trimmed(run), "doc_id long, k int, lang string, cut binary").distinct()
    rows = cuts.orderBy(F.xxhash64("doc_id", "k"), "doc_id", "k", "lang", "cut").limit(4 * per_doc * max(sample_docs, len(counts))).collect()
    return [(r["lang"], bytes(r["cut"])) for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["k"], r["lang"], bytes(r["cut"])))]


def fit(docs: DataFrame, sample_docs: int = 800, per_doc: int = 6, window: int = 64) -> Model | None:
    """Trains on the driver from a bounded sample of ``docs`` (doc_id, text, lang); None without labels."""
    rows = training_windows(docs, sample_docs, per_doc, window)
    return train([t for _, t in rows], [x for x, _ in rows], window) if rows else None


def identify(spark: SparkSession, docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, and the columns of ``carry``.  Only the text is judged."""
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, m = batch.slice(at, 256), shared.value
                texts = part.column(1).to_pylist()
                lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool)
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                on = np.flatnonzero(lettered)
                if m is not None and len(on):
                    p = document_probabilities(m, [texts[i].encode() for i in on])
                    best = p.argmax(axis=1)
                    scores[on] = np.clip(p[np.arange(len(on)), best], 0, 1)
                    for i, b in zip(on, best, strict=True):
                        names[i] = m.languages[b]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores), *part.columns[2:]], ["doc_id", "lang_pred", "score", *carry])

    src = docs.select(docs[f"`{id_col}`"].cast("long"), docs[f"`{text_col}`"], *[docs[f"`{c}`"].alias(f"carried_{c}") for c in carry])
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return src.mapInArrow(trimmed(run), f"doc_id long, lang_pred string, score double{kinds}")
