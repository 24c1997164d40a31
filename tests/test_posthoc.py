"""Post-hoc tests by name against numpy formulas."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.functions import special
from gridwise.operators import groups as G

UNITS, SAMPLES = 12, 14


@pytest.fixture(scope="module")
def data():
    """[component, group, unit, sample]; in component 0 the first four units differ from 0 and between groups; unit 11 never varies."""
    y = np.random.default_rng(3).normal(size=(2, 2, UNITS, SAMPLES))
    y[0, 0, :4] += 2.0
    y[0, 1, :4] += 5.0
    y[:, :, 11] = 1.0
    return y


@pytest.fixture(scope="module")
def table(spark, data):
    rows = [(c, g, u, n, float(data[c, g, u, n])) for c, g, u, n in np.ndindex(*data.shape)]
    return spark.createDataFrame(rows, "component long, grp long, unit long, sample long, y double").repartition(5)


def formula(data, kind):
    a, b = data[:, 0], data[:, 1]
    with np.errstate(all="ignore"):
        if kind == "2sample":
            pooled = (a.var(2, ddof=1) + b.var(2, ddof=1)) / 2
            return (b.mean(2) - a.mean(2)) / np.sqrt(pooled * 2 / SAMPLES), 2 * SAMPLES - 2
        x = b - a if kind == "paired" else np.concatenate([a, b], axis=2)
        return x.mean(2) / (x.std(2, ddof=1) / np.sqrt(x.shape[2])), x.shape[2] - 1


def passing(p, q=0.05):
    order = np.sort(p[~np.isnan(p)])
    r = int((order / np.arange(1, len(order) + 1) <= q / len(order)).sum())
    return p <= order[r - 1] if r else np.zeros(len(p), bool)


def result(table, test):
    # a one-sample test sees the samples of both groups as samples of their own
    table = table.withColumn("sample", F.col("grp") * 100 + F.col("sample")) if test.endswith("1sample") else table
    return {(r.component, r.unit): r for r in G.posthoc(table, test, "y", "component", "unit", "sample", "grp", 0, 1).collect()}


@pytest.mark.parametrize("kind", ["1sample", "2sample", "paired"])
def test_t_maps(table, data, kind):
    got = result(table, f"ttest,{kind}")
    t, dof = formula(data, kind)
    t[:, 11] = np.nan
    p = np.array([[np.nan if np.isnan(v) else 2 * (1 - special.t_cdf(abs(v), dof)) for v in row] for row in t])
    assert len(got) == 2 * UNITS
    for c in range(2):
        passed = passing(p[c])
        for u in range(UNITS):
            r = got[c, u]
            if u == 11:
                assert r.raw is None and r.p is None and r.passed == 0 and r.thresholded is None
            else:
                assert r.raw == pytest.approx(t[c, u], rel=1e-9) and r.passed == passed[u]
                assert r.thresholded == (r.raw if passed[u] else 0.0)
    assert all(got[0, u].passed for u in range(4))


@pytest.mark.parametrize("kind", ["1sample", "2sample", "paired"])
def test_bootstrap_maps(table, data, kind):
    got = result(table, f"boots,{kind}")
    t, _ = formula(data, kind)
    for c in range(2):
        p = np.array([np.nan if got[c, u].p is None else got[c, u].p for u in range(UNITS)])
        passed = passing(p)
        for u in range(UNITS - 1):
            r = got[c, u]
            assert r.raw == pytest.approx(t[c, u], rel=0.35, abs=0.5) and 0 <= r.p <= 0.5
            assert r.passed == passed[u] and r.thresholded == (r.raw if passed[u] else 0.0)
    assert all(got[0, u].passed and got[0, u].p == 0 for u in range(4))


def test_names_and_groups_are_checked(table):
    with pytest.raises(ValueError, match="none of"):
        G.posthoc(table, "ttest", "y", "component", "unit", "sample")
    with pytest.raises(ValueError, match="two groups"):
        G.posthoc(table, "boots,paired", "y", "component", "unit", "sample", "grp", 0)


def test_empty_table(table):
    for name in G.POSTHOC:
        assert G.posthoc(table.limit(0), name, "y", "component", "unit", "sample", "grp", 0, 1).count() == 0
