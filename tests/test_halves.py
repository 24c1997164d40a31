"""Split-half components over subjects against a plain version on whole maps."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.operators import halves as H

UNITS, N, K, B = 60, 9, 3, 8


@pytest.fixture(scope="module")
def x():
    r = np.random.default_rng(7)
    return 2 * r.standard_normal((UNITS, 1)) * r.uniform(0.5, 1.5, N) + r.standard_normal((UNITS, 2)) @ r.standard_normal((2, N)) + 0.4 * r.standard_normal((UNITS, N)) + 1


def plain(x):
    reference = x @ np.linalg.svd(x, full_matrices=False)[2].T
    rs, shares, mean = np.zeros((B, K)), np.zeros((B, K)), np.zeros((UNITS, K))
    for b in range(B):
        order = np.random.default_rng((42, b)).permutation(N)
        maps = []
        for part in (order[: N // 2], order[N // 2 :]):
            u, s, _ = np.linalg.svd(x[:, part], full_matrices=False)
            maps.append(np.stack([u[:, k] * np.sign(np.corrcoef(u[:, k], reference[:, k])[0, 1]) for k in range(K)], axis=1))
            shares[b] += (s**2 / (s**2).sum())[:K] / 2
        for k in range(K):
            one, two = maps[0][:, k], maps[1][:, k]
            rs[b, k] = np.corrcoef(one, two)[0, 1]
            noise = ((one - one.mean()) / one.std(ddof=1) - (two - two.mean()) / two.std(ddof=1)) / np.sqrt(2)
            mean[:, k] += (one / one.std(ddof=1) + two / two.std(ddof=1)) / np.sqrt(2) / noise.std(ddof=1) / B
    # the sign of the reference is free: the program's has its largest weight positive
    v = np.linalg.svd(x, full_matrices=False)[2][:K].T
    mean = mean * np.sign(v[np.abs(v).argmax(axis=0), np.arange(K)])
    load = x.T @ mean
    return np.median(rs, axis=0), (rs > 0).mean(axis=0), np.median(shares, axis=0), mean, load / np.linalg.norm(load, axis=0)


def test_halves(spark, x):
    packed = spark.createDataFrame([(1, u, x[u].tolist()) for u in range(UNITS)], "g int, unit long, y array<double>").repartition(3)
    r, positive, share, mean, load = plain(x)
    summary, maps, loads = H.split_half_pca(packed, ["g"], K, B)
    for row in summary.collect():
        i = row.component - 1
        assert (row.R, row.positive, row.variance) == pytest.approx((r[i], positive[i], share[i]))
    got = {(m.unit, m.component): m.z for m in maps.collect()}
    assert len(got) == UNITS * K and all(got[u, i + 1] == pytest.approx(mean[u, i]) for u in range(UNITS) for i in range(K))
    assert all(w.weight == pytest.approx(load[w.place, w.component - 1]) for w in loads.collect())
    kept, cut, _ = H.split_half_pca(packed, ["g"], K, B, level=0.05)
    values = {(m.unit, m.component): m.z for m in cut.collect()}
    assert kept.count() * UNITS == len(values) and all(v == 0 or v == pytest.approx(got[key]) for key, v in values.items())
    assert 0 < sum(v == 0 for (_, c), v in values.items() if c == 1) < UNITS and all(abs(got[key]) >= 1.6 for key, v in values.items() if v)


def test_odd_input(spark):
    packed = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [0.0, 0.0]), (2, 1, [0.0, 0.0])], "g int, unit long, y array<double>")
    assert all(t.count() == 0 for t in H.split_half_pca(packed, ["g"], 2, 3))
    assert all(t.count() == 0 for t in H.split_half_pca(packed.filter(F.lit(False)), ["g"], 2, 3, level=0.05))
