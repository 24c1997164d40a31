"""Registered queries run the whole job: all resamples, all units, all rows."""

from __future__ import annotations

import numpy as np
import pytest

from gridwise.fixtures import fixture
from gridwise.operators import groups
from gridwise.plans.registry import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bootstrap_1sample", "bootstrap_2sample", "bootstrap_paired"])
def test_bootstrap_runs_1000_resamples(spark, name):
    p = queries()[name](spark, SF).toPandas()["p"].to_numpy() * 1000
    assert np.allclose(p, np.rint(p))
    assert not np.allclose(p / 10, np.rint(p / 10))  # as with 100 resamples


def test_bootstrap_ratio_equals_the_standard_error(spark):
    r = np.random.default_rng(7)
    y = r.standard_normal((3, 400)) + np.array([[0.0], [0.1], [0.5]])
    rows = [(u, s, float(y[u, s])) for u in range(3) for s in range(400)] + [(0, 400, None), (None, 0, 1.0), (None, 1, 3.0)]
    table = spark.createDataFrame(rows, "unit long, sample long, y double").repartition(3)
    got = {x.unit: x for x in groups.bootstrap_1sample(table, "y", "unit", "sample").collect()}
    assert set(got) == {0, 1, 2, None}
    for u in range(3):
        assert got[u].ratio == pytest.approx(y[u].mean() / (y[u].std() / 20), rel=0.12, abs=0.15)


def test_poisson_draws():
    k = groups.poisson_draws(np.arange(500, dtype=np.int64), 1000)
    assert k.mean() == pytest.approx(1, abs=0.01) and k.var() == pytest.approx(1, abs=0.02) and k.max() > 6
    assert abs(np.corrcoef(k[:, 0], k[:, 1])[0, 1]) < 0.15 and abs(np.corrcoef(k[0], k[1])[0, 1]) < 0.12


def test_volume_displacement_and_trajectory_use_all_units(spark):
    daily = fixture(spark, SF, "series_daily").toPandas()
    moved = queries()["volume_displacement"](spark, SF).toPandas()
    paths = queries()["volume_trajectory"](spark, SF).toPandas()
    for subject, rows in daily.groupby("subject"):
        x = rows.pivot(index="unit", columns="t", values="y").sort_index(axis=1).to_numpy()
        assert len(x) > 6
        _, size, v = np.linalg.svd(x - x.mean(axis=1, keepdims=True), full_matrices=False)
        q = (v.T * size)[:, size > 1e-6 * size[0]]
        near = [[u for u in range(max(0, t - 7), min(len(q), t + 8)) if u != t] for t in range(len(q))]
        got = moved[moved.subject == subject].sort_values("t")["displacement"].to_numpy()
        assert np.allclose(got, [((q[t] - np.median(q[near[t]], axis=0)) ** 2).sum() for t in range(len(q))], rtol=1e-5, atol=1e-3)
        path = paths[paths.subject == subject].pivot(index="t", columns="k", values="path").to_numpy()
        expected = np.stack([q[n].mean(axis=0) for n in near])
        assert path.shape == expected.shape and np.allclose(np.abs(path), np.abs(expected), atol=1e-3)
