"""Dense algebra and distribution functions against independent formulas."""

from __future__ import annotations

import math

import numpy as np
import pytest

from gridwise.functions import special as P
from gridwise.operators import gram as G
from gridwise.operators import stats


@pytest.fixture
def x():
    r = np.random.default_rng(3)
    return r.standard_normal((200, 24)) + 3 * r.standard_normal((200, 1)) @ r.standard_normal((1, 24))


def test_special_against_tables():
    assert P.norm_ppf(0.975) == pytest.approx(1.959963985, abs=1e-8)
    assert P.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert 1 - P.chi2_cdf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert 1 - P.f_cdf(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert P.gamma_cdf(2.0, 1.0, 2.0) == pytest.approx(1 - math.exp(-1))
    assert P.gamma_cdf(P.gamma_ppf(0.95, 2.5, 1.5), 2.5, 1.5) == pytest.approx(0.95)


def test_gamma_fit_finds_its_parameters():
    v = np.random.default_rng(0).gamma(3.0, 2.0, 200_000)
    shape, scale = P.gamma_fit(v.mean(), np.log(v).mean())
    assert shape == pytest.approx(3.0, rel=0.02) and scale == pytest.approx(2.0, rel=0.02)


def test_signed_rank_exact_and_normal():
    assert P.signed_rank_p(np.arange(1, 6), 15, 0) == pytest.approx(2 / 32)
    assert P.signed_rank_p(np.arange(1, 31), 232.5, 0) == pytest.approx(1.0)
    assert P.signed_rank_p(np.zeros(0), 0, 0) == 1.0


def test_operator_takes_design_out(x):
    design = np.hstack([G.legendre(24, 2), np.random.default_rng(1).standard_normal((24, 2))])
    y = x @ G.remove_columns(design)
    assert np.abs(y @ design).max() < 1e-9
    beta = np.linalg.lstsq(design, x.T, rcond=None)[0]
    assert np.allclose(y, x - (design @ beta).T)


def test_independent_columns():
    r = np.random.default_rng(2).standard_normal((20, 3))
    assert G.independent_columns(np.hstack([r, r[:, :1] + r[:, 1:2]])) in ([0, 1, 2], [0, 2, 3], [1, 2, 3])


def test_eigen_agrees_with_svd(x):
    c = x - x.mean(axis=1, keepdims=True)
    values, _ = G.eigen(G.centred(x.T @ x))
    s = np.linalg.svd(c, compute_uv=False)
    assert np.allclose(values, (s**2)[: len(values)])


def test_map_correlation_needs_no_units(x):
    a, b = np.random.default_rng(4).standard_normal((2, 24))
    assert G._map_correlation(x.T @ x, x.sum(axis=0), len(x), a, b) == pytest.approx(np.corrcoef(x @ a, x @ b)[0, 1])


def test_lowpass_properties():
    n, cut = G.lowpass_order(2.0)
    m = G.zero_phase_operator(200, *G.butterworth(n, cut))
    t = np.arange(200) * 2.0
    slow, fast = np.sin(2 * np.pi * 0.02 * t), np.sin(2 * np.pi * 0.2 * t)
    assert np.corrcoef((slow + fast) @ m, slow)[0, 1] > 0.99
    assert np.allclose(np.ones(200) @ m, 1)
    v = np.random.default_rng(5).standard_normal(200)
    inner = slice(60, 140)
    assert np.allclose((v[::-1] @ m)[::-1][inner], (v @ m)[inner], atol=1e-3)


def test_interpolation_keeps_kept_times_and_lines():
    y = 2.0 * np.arange(12) + 1
    assert np.allclose(G._cubic(np.where(np.isin(np.arange(12), [4, 5]), 99.0, y), {4, 5}), y)
    out = G._cubic(np.where(np.arange(12) == 0, 50.0, y), {0})
    assert out[0] == y[1] and np.array_equal(out[1:], y[1:])


def test_lda_finds_a_planted_difference():
    r = np.random.default_rng(6)
    classes, half = np.tile([-1, 1], 20), np.repeat([1, 2], 20)
    pattern = r.standard_normal(300)
    x = r.standard_normal((300, 40)) + np.outer(pattern, classes) * 1.5
    best = min(G.split_half_lda(x.T @ x, x.sum(axis=0), 300, classes, half), key=lambda v: v[4])
    assert best[1] > 0.5 and best[3] > 0.95
    noise = r.standard_normal((300, 40))
    assert min(G.split_half_lda(noise.T @ noise, noise.sum(axis=0), 300, classes, half), key=lambda v: v[4])[3] < 0.8


def test_friedman_critical_difference_is_from_the_residual_ranks(spark):
    r = np.random.default_rng(3)
    ranks = np.argsort(np.argsort(r.normal(size=(7, 4)) + np.arange(4) * 0.5, axis=1), axis=1) + 1.0
    rows = [(1, b, t, float(ranks[b, t])) for b in range(7) for t in range(4)] + [(2, 0, t, float(t)) for t in range(3)] + [(3, b, 0, 1.0) for b in range(2)]
    got = {x.k: x for x in stats.friedman(spark.createDataFrame(rows, "k int, b int, t int, v double"), "v", "t", "b", ["k"]).collect()}
    residual = ranks - ranks.mean(axis=0) - ranks.mean(axis=1, keepdims=True) + ranks.mean()
    square = (residual**2).sum() / (6 * 3)
    assert np.isclose(got[1].critical, P.t_ppf(0.975, 18) * np.sqrt(2 * square / 7))
    assert got[1].p == pytest.approx(1 - P.chi2_cdf(got[1].q, 3))
    assert got[2].critical is None and got[2].p is not None
    assert got[3].critical is None and got[3].p is None


def test_discriminants_try_half_of_the_components_asked_for(x):
    assert [G.tried_components(a, [40, 38], 99) for a in (1, 3, 4, 5, 8, 9, 100)] == [1, 1, 1, 2, 3, 4, 37]
    assert G.tried_components(100, [50, 6], 99) == 5 and G.tried_components(100, [50, 60], 7) == 7
    t = x.shape[1]
    classes, half = np.where(np.arange(t) // 2 % 2 == 0, -1, 1), np.where(np.arange(t) < t // 2, 1, 2)
    rows = G.split_half_lda(x.T @ x, x.sum(axis=0), len(x), classes, half)
    asked = int(t * 0.5)
    assert [r[0] for r in rows] == list(range(1, (asked + 1) // 2))


def test_single_pipeline_output(spark):
    from gridwise.operators.selection import single_pipeline_output

    one = spark.createDataFrame([(1, 4, 0.5), (2, 4, None)], "subject long, pipeline_id long, P double")
    two = spark.createDataFrame([(1, 4, 0.5), (2, 5, 0.1), (3, None, 0.2)], "subject long, pipeline_id long, P double")
    assert sorted(r.subject for r in single_pipeline_output(one).collect()) == [1, 2]
    assert single_pipeline_output(two).count() == 0 and single_pipeline_output(one.limit(0)).count() == 0
