"""Vectorised word segmentation and hashing over batches of UTF-8 byte strings.

A batch is one contiguous byte buffer in which documents are separated by a
space, so that no word crosses a document border.  Word hashes are polynomial
sums over 64-bit byte codes (computed from one running sum over the buffer) put
through a 64-bit finaliser.  Two different words or shingles share a value with
a probability of about 2**-64.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)

#: Class tables: True where a byte belongs to a word.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
ALNUM[0x41:0x5B] = True  # upper case counts: callers fold it


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, a bijection)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _codes() -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
    t[0x41:0x5B] = t[0x61:0x7B]  # A-Z count as a-z
    return t


CODES = _codes()
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        m = 1 << max(16, int(n - 1).bit_length())
        up, down = np.empty(m, U64), np.empty(m, U64)
        for out, base in ((up, _BASE), (down, _INV)):
            out[0], k = 1, 1
            while k < m:
                out[k : 2 * k] = out[:k] * U64(pow(base, k, 1 << 64))
                k *= 2
        if m > 1 << 22:  # a single huge text: do not keep its tables
            return up, down
        _powers = (up, down)
    return _powers


#: Bytes whose words are hashed at a time.
_SEGMENT = 1 << 20


def chunks(texts: list[bytes | None], size: int = 1 << 19):
    """Yields (first, last) index ranges of about ``size`` bytes each (working arrays take some 60 times that)."""
    first, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or b"") + 1
        if n >= size:
            yield first, i + 1
            first, n = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def words(texts: list[bytes | None], table: np.ndarray, need_hash: bool = True):
    """(buffer, starts, ends, document index, folded hash) of every word."""
    buf = np.frombuffer(b" " + b" ".join([t or b"" for t in texts]) + b" ", np.uint8)
    inside = table[buf]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    lengths = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    borders = np.cumsum(lengths)
    doc = np.searchsorted(borders, starts, side="right") if len(texts) > 1 else np.zeros(len(starts), np.int64)
    if not need_hash:
        return buf, starts, ends, doc, None
    h, first = np.empty(len(starts), U64), 0
    while first < len(starts):  # words of so many bytes at a time: a huge text takes no more room than many small ones
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, base + _SEGMENT, side="right")))
        part = buf[base : int(ends[last - 1])]
        a, z = starts[first:last] - base, ends[first:last] - base
        up, down = _power_tables(len(part) + 1)
        run = np.zeros(len(part) + 1, U64)
        np.cumsum(CODES[part] * up[: len(part)], out=run[1:])
        h[first:last] = mix((run[z] - run[a]) * down[a])
        first = last
    return buf, starts, ends, doc, h


_SHINGLE = [pow(_BASE, 2 * k + 3, 1 << 64) | 1 for k in range(64)]


def windows(h: np.ndarray, doc: np.ndarray, k: int):
    """Hashes of all k-word windows inside a document, with their first word's index."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    out = np.zeros(n, U64)
    for j in range(k):
        out += h[j : j + n] * U64(_SHINGLE[j])
    return mix(out[at]), at


def shingle_sets(texts: list[bytes | None], k: int = 5):
    """Per document the sorted distinct hashes of its k-word shingles.

    Words are runs of bytes other than space and \\x09-\\x0D, A-Z folded.  A
    document of fewer than k words (but not none) has its whole sequence as its
    one shingle; one without words has an empty set.  Returns (hashes, bounds):
    document i owns hashes[bounds[i]:bounds[i + 1]].
    """
    _, _, _, doc, h = words(texts, NOT_SPACE)
    sh, at = windows(h, doc, k)
    owner = doc[at]
    count = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.zeros(len(short), U64)
        for j in range(k - 1):
            on = count[short] > j
            extra[on] += h[first[on] + j] * U64(_SHINGLE[j])
        extra = mix(extra + mix(count[short].astype(U64)))
        sh, owner = np.concatenate([sh, extra]), np.concatenate([owner, short])
    order = np.lexsort((sh, owner))
    sh, owner = sh[order], owner[order]
    if len(sh):
        keep = np.ones(len(sh), bool)
        keep[1:] = (sh[1:] != sh[:-1]) | (owner[1:] != owner[:-1])
        sh, owner = sh[keep], owner[keep]
    return sh, np.searchsorted(owner, np.arange(len(texts) + 1))
