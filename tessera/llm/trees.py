"""Histogram gradient-boosted trees for a binary label, in numpy.

Features are binned by quantiles; each level of a tree is grown for all its nodes
at once from gradient histograms.  Trees are complete and lie in flat arrays
(node i has children 2i + 1 and 2i + 2), so a batch goes down all of them by index
arithmetic alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes: right if above
    value: np.ndarray  # trees x leaves
    base: float

    @property
    def depth(self) -> int:
        return int(self.value.shape[1]).bit_length() - 1

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        f, t, v = self.feature.ravel(), self.threshold.ravel(), self.value.ravel()
        rows, root = np.arange(len(x))[:, None], (np.arange(trees) * inner)[None, :]
        at = np.zeros((len(x), trees), np.int64)
        for _ in range(self.depth):
            node = root + at
            at = 2 * at + 1 + (x[rows, f[node]] > t[node])
        return self.base + v[(np.arange(trees) * self.value.shape[1])[None, :] + at - inner].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, l2: float = 2.0, least: int = 8) -> Forest:
    """Boosts logistic loss.  x: rows x features (finite), y: 0 or 1."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    inner = (1 << depth) - 1
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    share = min(max(y.mean(), 1e-4), 1 - 1e-4) if n else 0.5
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    for k in range(trees if n else 0):
        p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best, pick, cut = np.full(count, 1e-9), np.zeros(count, np.int64), np.full(count, bins + 1)
            for j in range(m):
                cell = (at - first) * (bins + 1) + binned[:, j]
                sums = [np.bincount(cell, w, count * (bins + 1)).reshape(count, -1).cumsum(axis=1) for w in (g, h, np.ones(n))]
                gl, hl, nl = sums
                gt, ht, nt = (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < least) | (nt - nl < least)] = 0
                top = gain.argmax(axis=1)
                high = gain[np.arange(count), top]
                on = high > best
                best[on], pick[on], cut[on] = high[on], j, top[on]
            for i in range(count):
                if cut[i] <= bins and cut[i] < len(cuts[pick[i]]):
                    feature[k, first + i], threshold[k, first + i] = pick[i], cuts[pick[i]][cut[i]]
            node = at
            at = 2 * node + 1 + (x[np.arange(n), feature[k, node]] > threshold[k, node])
        leaf = at - inner
        value[k] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        score += value[k][leaf]
    return Forest(feature, threshold, value, base)
