"""Packing of the unit cube against a plain version in numpy."""

import math

import numpy as np
import pytest

from tessera.plans import packing
from tessera.session import saver


def test_pack_cube(spark):
    h = 0.25
    save = saver(spark, "pack")
    edges = {tuple(round(v, 9) for v in r) for r in packing.edge_seeds(spark, h).collect()}
    line = [i / 4 for i in range(5)]
    assert edges == {p for t in line for u in (0.0, 1.0) for v in (0.0, 1.0) for p in ((t, u, v), (u, t, v), (u, v, t))} and len(edges) == 44
    inner = np.array([list(r) for r in packing.volume_seeds(spark, h, 1).collect()])
    assert len(inner) and inner.min() >= h / 2 and inner.max() <= 1 - h / 2 and np.abs(inner * 4 % 1 - 0.5).max() <= 0.15 * h * 4 + 1e-9
    sites, row = packing.pack_cube(spark, h, save, 1)
    got = sorted(tuple(r) for r in sites.select("x", "y", "z").collect())
    # plain: half of the missing distance from each overlapping pair, half of that a round
    fixed = np.array(sorted(edges))
    x, worst = inner.copy(), []
    while True:
        every = np.concatenate([fixed, x])
        d = x[:, None] - every[None]
        r = np.linalg.norm(d, axis=2)
        r[r == 0] = math.inf
        worst.append(max(0.0, 1 - r.min() / h))
        if worst[-1] <= 0.02 or len(worst) >= 4 and worst[-1] >= 0.99 * worst[-4]:
            break
        push = np.where(r <= h, (h - r) / 2 / r, 0.0)
        push[~np.isfinite(r)] = 0.0
        x = np.clip(x + 0.5 * (push[:, :, None] * d).sum(axis=1), 0, 1)
    assert row["overlaps"] == pytest.approx(worst) and len(worst) > 1 and worst[-1] < worst[0]
    want = sorted(map(tuple, np.concatenate([fixed, x])))
    assert np.allclose(got, want) and (row["n_edge"], row["n_volume"]) == (44, len(inner))
    every = np.concatenate([fixed, x])
    r = np.linalg.norm(every[:, None] - every[None], axis=2)
    p = r[np.triu_indices(len(every), 1)]
    p = p[p <= h]
    lens = (math.pi * (h - p) ** 2 * (p * p + 2 * h * p) / (12 * p)).sum()
    assert row["fill"] == pytest.approx(len(every) * 4 / 3 * math.pi * (h / 2) ** 3 - lens)
    np.fill_diagonal(r, math.inf)
    assert row["gap"] == pytest.approx(r[:44].min(axis=1).mean())
