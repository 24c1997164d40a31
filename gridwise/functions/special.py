"""Distribution functions with numpy alone: normal, gamma, beta, t, F and chi-square."""

from __future__ import annotations

import math

import numpy as np


def norm_cdf(x):
    return 0.5 * np.vectorize(math.erfc)(-np.asarray(x, float) / math.sqrt(2))


def _bisect(f, p: float, low: float, high: float) -> float:
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < p else (low, mid)
    return (low + high) / 2


def norm_ppf(p: float) -> float:
    return _bisect(lambda x: float(norm_cdf(x)), p, -40.0, 40.0)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    head = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * head
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - head * h


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by a continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    head = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return head * h


def gamma_cdf(x: float, shape: float, scale: float) -> float:
    return gamma_p(shape, x / scale)


def gamma_ppf(p: float, shape: float, scale: float) -> float:
    high = shape + 1.0
    while gamma_p(shape, high) < p:
        high *= 2
    return scale * _bisect(lambda x: gamma_p(shape, x), p, 0.0, high)


def chi2_cdf(x: float, dof: float) -> float:
    return gamma_p(dof / 2, x / 2)


def t_cdf(t: float, dof: float) -> float:
    half = beta_i(dof / 2, 0.5, dof / (dof + t * t)) / 2
    return 1 - half if t > 0 else half


def t_ppf(p: float, dof: float) -> float:
    high = 2.0
    while t_cdf(high, dof) < max(p, 1 - p):
        high *= 2
    return _bisect(lambda x: t_cdf(x, dof), p, -high, high)


def f_cdf(x: float, d1: float, d2: float) -> float:
    return beta_i(d1 / 2, d2 / 2, d1 * x / (d1 * x + d2)) if x > 0 else 0.0


def digamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    r = 1 / (x * x)
    return out + math.log(x) - 1 / (2 * x) - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))


def gamma_fit(mean: float, mean_log: float) -> tuple[float, float]:
    """Maximum-likelihood shape and scale of a gamma distribution from the mean and the mean logarithm."""
    s = math.log(mean) - mean_log
    if not s > 0:
        return 1e9, mean / 1e9
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(100):
        h = 1e-5 * k
        slope = 1 / k - (digamma(k + h) - digamma(k - h)) / (2 * h)
        step = (math.log(k) - digamma(k) - s) / slope
        k = k - step if k - step > 0 else k / 2
        if abs(step) < 1e-12 * k:
            break
    return k, mean / k


def signed_rank_p(ranks: np.ndarray, w: float, tie_adjust: float) -> float:
    """Two-sided p of a signed-rank sum: exact by counting subsets of the (doubled) ranks for up to 15 values, else normal."""
    n = len(ranks)
    if n == 0:
        return 1.0
    if n > 15:
        z = (w - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - tie_adjust) / 24)
        return 2 * float(norm_cdf(-abs(z)))
    doubled = np.rint(2 * ranks).astype(int)
    ways = np.zeros(doubled.sum() + 1)
    ways[0] = 1
    for r in doubled:
        ways[r:] = ways[r:] + ways[: len(ways) - r].copy()
    at = int(round(2 * min(w, n * (n + 1) / 2 - w)))
    return min(1.0, 2 * ways[: at + 1].sum() / 2.0**n)
