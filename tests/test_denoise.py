"""Denoising chains, motion components and regressions over runs against formulas on whole arrays."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.operators import denoise as N
from gridwise.operators import gram as G

T, UNITS = 21, 15


def least_squares(data, noise, signal):
    """data (units x T) less the noise part of a fit on noise and signal."""
    both = np.hstack([noise, signal])
    beta = np.linalg.lstsq(both, data.T, rcond=None)[0]
    return data - (noise @ beta[: noise.shape[1]]).T


def halves(x):
    a, b = x.copy(), x.copy()
    a[11:], b[:11] = 0, 0
    return np.hstack([a, b])


@pytest.fixture(scope="module")
def parts():
    r = np.random.default_rng(5)
    data = {s: r.standard_normal((UNITS, T)) + 3 * r.standard_normal((UNITS, 1)) * r.standard_normal(T) + 10 for s in ("a", "b")}
    columns = {n: {s: r.standard_normal((T, k)) for s in data} for n, k in (("motion", 2), ("signal", 1), ("physio", 2))}
    return data, columns, r.uniform(0.2, 1, UNITS), np.where(np.arange(UNITS) < 5, 1.0 + np.arange(UNITS), 0.0)


def packed(spark, data):
    return spark.createDataFrame([(s, u, y[u].tolist()) for s, y in data.items() for u in range(len(y))], "subject string, unit long, y array<double>").repartition(4)


def regressors(spark, columns):
    return spark.createDataFrame([(s, k, x[:, k].tolist()) for s, x in columns.items() for k in range(x.shape[1])], "subject string, k long, y array<double>")


def by_unit(spark, values):
    return spark.createDataFrame([(u, float(v)) for u, v in enumerate(values)], "unit long, weight double")


@pytest.mark.parametrize("split", [True, False])
def test_chain_equals_successive_fits(spark, parts, split):
    data, columns, weight, region = parts
    cut = halves if split else (lambda x: x)
    units = packed(spark, data)
    tables = {n: regressors(spark, c) for n, c in columns.items()}
    operators = N.chain_operators(units, ["subject"], 1, split, **tables, region=by_unit(spark, region), first_component=True, weights=by_unit(spark, weight))
    got = {(r.subject, r.unit): np.array(r.y) for r in G.apply_operators(units, operators, ["subject"]).collect()}
    for s, y in data.items():
        motion, signal, physio = (columns[n][s] for n in ("motion", "signal", "physio"))
        drift = np.zeros((T, 4)) if split else G.legendre(T, 1)
        if split:
            drift[:11, :2], drift[11:, 2:] = G.legendre(11, 1), G.legendre(10, 1)
        signal = cut(signal)
        y = least_squares(y, np.hstack([cut(motion), drift]), signal)
        y = least_squares(y, cut(((y * region[:, None])[:5].mean(axis=0) / region.sum())[:, None]), signal)
        first = lambda x: np.linalg.svd(x * weight[:, None], full_matrices=False)[2][0]
        if split:
            course = cut(np.concatenate([first(y[:, :11]), first(y[:, 11:])])[:, None])
        else:
            course = np.stack([np.ones(T), first(y)], axis=1)
        y = least_squares(least_squares(y, course, signal), physio, np.zeros((T, 0)))
        assert np.allclose(np.stack([got[s, u] for u in range(UNITS)]), y, atol=1e-8)


def test_signal_is_kept(spark, parts):
    _, columns, _, _ = parts
    signal = columns["signal"]["a"]
    data = {"a": np.outer(np.arange(1.0, 5), signal[:, 0]) + 7}
    units = packed(spark, data)
    m = N.chain_operators(units, ["subject"], 0, False, signal=regressors(spark, {"a": signal}))
    kept = np.stack([r.y for r in G.apply_operators(units, m, ["subject"]).orderBy("unit").collect()])
    assert np.allclose(kept, data["a"] - 7)
    gone = np.stack([r.y for r in G.apply_operators(units, N.chain_operators(units, ["subject"], 0, False, motion=regressors(spark, {"a": signal})), ["subject"]).collect()])
    assert np.abs(gone).max() < 1e-9


def test_odd_input(spark, parts):
    data, columns, _, _ = parts
    units = packed(spark, data)
    empty = units.limit(0)
    assert N.chain_operators(empty, ["subject"], 1, first_component=True).count() == 0
    # regressors of one group only, a constant signal (dropped), units that are all 0, an automatic order, a run of one scan
    constant = regressors(spark, {"a": np.ones((T, 1))})
    rows = {r.subject: np.array(r.m).reshape(T, T) for r in N.chain_operators(units, ["subject"], -1, signal=constant, motion=regressors(spark, {"b": columns["motion"]["b"]}), tr=2.0).collect()}
    assert np.allclose(rows["a"].sum(axis=0), 0) and np.linalg.matrix_rank(rows["a"]) == T - 4 and np.linalg.matrix_rank(rows["b"]) == T - 8
    zeros = N.chain_operators(packed(spark, {"a": np.zeros((3, T))}), ["subject"], 0, first_component=True).first()
    assert np.isfinite(zeros.m).all()
    assert N.chain_operators(packed(spark, {"a": np.ones((3, 1))}), ["subject"], 0).first().m == [0.0]
    assert N.automatic_order(300, 2.0) == 3


def test_motion_components(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((40, 6)) * [5, 4, 3, 2, 1, 0.5] + r.standard_normal(6)
    rows = [("a", t, k, float(x[t, k])) for t in range(40) for k in range(6)] + [("still", t, k, 1.0) for t in range(3) for k in range(6)]
    table = spark.createDataFrame(rows, "subject string, t long, k long, y double").repartition(3)
    u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    many = int((np.cumsum(s**2) / (s**2).sum() <= 0.85).sum()) + 1
    got = N.motion_components(table, ["subject"]).orderBy("component", "t").collect()
    assert {r.subject for r in got} == {"a"} and len(got) == 40 * many
    signs = np.sign(v[np.arange(6), np.abs(v).argmax(axis=1)])
    assert np.allclose(np.array([r.y for r in got]).reshape(many, 40).T, (u * s * signs)[:, :many])
    assert N.motion_components(table.limit(0), ["subject"]).count() == 0


def test_multirun_glm(spark):
    tr, lengths, dropped = 2.0, (12, 9), 2
    r = np.random.default_rng(2)
    y = [r.standard_normal((4, n)) for n in lengths]
    series = spark.createDataFrame([("s", i, u, t, float(y[i][u, t])) for i, n in enumerate(lengths) for u in range(4) for t in range(n)], "subject string, run long, unit long, t long, y double")
    # (run, onset, duration): before the first scan, across the end of a run, past the end, in the second run at its first scan
    events = {"x": [(0, 2.0, 5.0), (0, 24.0, 30.0), (1, 4.0, 4.0)], "y": [(0, 13.0, 2.0), (1, 60.0, 3.0), (1, 14.5, 0.0)]}
    table = spark.createDataFrame([("s", run, c, o, d) for c, rows in events.items() for run, o, d in rows], "subject string, run long, cond string, onset_s double, duration_s double")
    censor = spark.createDataFrame([("s", 1, 10.0, 2.0)], "subject string, run long, onset_s double, duration_s double")
    total = sum(lengths)
    on = {"x": [0, 1, 9, 10, 11, 12, 12 + 1, 12 + 2], "y": [4, 5, 12 + 5]}
    # first: onset -2 s shortens 5 s to 3 s = round(1.5) = 2 scans more; the second lies 20 s in (scan 10 of 1..12), cut to 4 s = 2 scans more
    on["x"] = [0, 1, 2, 9, 10, 11, 12, 13, 14]
    lag = np.arange(11) * tr
    kernel = np.exp(-lag) * (0.0083333 * lag**5 - 1.274527e-13 * lag**15)
    x = np.zeros((total, 4))
    x[:, 0] = 1
    x[[12 + 2, 12 + 3], 1] = 1
    for j, c in enumerate("xy"):
        box = np.zeros(total)
        box[on[c]] = 1
        x[:, 2 + j] = np.convolve(box, kernel)[:total]
    data = np.hstack(y)
    inverse = np.linalg.inv(x.T @ x)
    beta = data @ x @ inverse
    t = beta / np.sqrt(((data - beta @ x.T) ** 2).sum(axis=1, keepdims=True) / (total - 1) * np.diag(inverse))
    got = {(r.unit, r.cond): r for r in N.multirun_glm(series, table, ["subject"], tr, dropped, censor).collect()}
    assert len(got) == 8
    for u in range(4):
        for j, c in enumerate("xy"):
            assert got[u, c].beta == pytest.approx(beta[u, 2 + j], rel=1e-8) and got[u, c].t == pytest.approx(t[u, 2 + j], rel=1e-8)
    assert N.multirun_glm(series.limit(0), table, ["subject"], tr).count() == 0


def test_task_motion_corr(spark):
    r = np.random.default_rng(4)
    x, y = r.standard_normal((30, 2)), r.standard_normal(30)
    response = spark.createDataFrame([("a", c, t, float(x[t, j])) for j, c in enumerate("pq") for t in range(30)], "subject string, cond string, t long, v double")
    motion = spark.createDataFrame([(s, k, t, float(y[t])) for s in "ab" for k in (1, 2) for t in range(30)], "subject string, component int, t long, y double")
    got = {r.subject: r.r for r in N.task_motion_corr(response, motion, ["p", "q"], ["subject"]).collect()}
    design = np.hstack([np.ones((30, 1)), x])
    fit = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert got["a"] == pytest.approx(np.corrcoef(fit, y)[0, 1]) and got["b"] == 0.0
    assert N.task_motion_corr(response, motion.filter(F.lit(False)), ["p", "q"], ["subject"]).count() == 0
