"""Canonical analysis and what rests on it against formulas over whole data matrices."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from gridwise.functions import special
from gridwise.operators import canonical as C
from gridwise.operators import gram as G
from gridwise.operators import groups
from gridwise.operators import resampled as R
from gridwise.operators import selection

K = ["subject"]


def _qr(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Canonical correlations by orthonormal bases of centred columns."""
    bases = []
    for b in (x, y):
        u, s, _ = np.linalg.svd(b - b.mean(axis=0), full_matrices=False)
        bases.append(u[:, s > 1e-9 * s[0]])
    return np.linalg.svd(bases[0].T @ bases[1], compute_uv=False)


def _packed(spark, data: dict, keys: str = "subject string"):
    rows = [(*(k if isinstance(k, tuple) else (k,)), i, v.tolist()) for k, m in data.items() for i, v in enumerate(m)]
    return spark.createDataFrame(rows, f"{keys}, unit long, y array<double>").repartition(5)


def _tests_of(r, n, p, q):
    out = []
    for k in range(len(r)):
        wilks = np.prod(1 - r[k:] ** 2)
        a, b = p - k, q - k
        s = math.sqrt((a * a * b * b - 4) / (a * a + b * b - 5)) if a * b > 2 else 1
        df2 = (n - (p + q + 3) / 2) * s - a * b / 2 + 1
        root = wilks ** (1 / s)
        out.append((wilks, (1 - root) / root * df2 / (a * b), a * b, df2, -(n - k - (p + q + 3) / 2 + (1 / r[:k] ** 2).sum()) * math.log(wilks)))
    return out


def test_canoncorr_against_orthonormal_bases(spark):
    r = np.random.default_rng(2)
    data = {}
    for key in ("a", "b", "flat", "one"):
        x = r.normal(size=(60, 3))
        y = np.hstack([x[:, :1] + r.normal(size=(60, 1)), r.normal(size=(60, 1)), x[:, 1:2] - 0.5 * r.normal(size=(60, 1)), r.normal(size=(60, 1))])
        if key == "b":  # a column that depends on others, one that is constant
            x[:, 2], y[:, 3] = x[:, 0] - 2 * x[:, 1], 7.0
        if key == "flat":
            x[:] = 1.0
        data[key] = np.hstack([x, y])[: 1 if key == "one" else 60]
    names = ["p", "q", "s", "t", "u", "v", "w"]
    rows = [(k, *map(float, row)) for k, m in data.items() for row in m] + [("a", None, *[1.0] * 6)]
    table = spark.createDataFrame(rows, "subject string, " + ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {}
    for row in C.canoncorr(table, names[:3], names[3:], K).collect():
        got.setdefault(row.subject, []).append(row)
    assert set(got) == {"a", "b"}
    for key, rank in (("a", (3, 4)), ("b", (2, 3))):
        x, y = data[key][:, :3], data[key][:, 3:]
        expected = _qr(x, y)
        own = sorted(got[key], key=lambda row: row.component)
        assert np.allclose([row.r for row in own], expected, atol=1e-9) and all((row.rank_x, row.rank_y) == rank for row in own)
        for row, (wilks, f, df1, df2, chi2) in zip(own, _tests_of(expected, 60, *rank), strict=True):
            assert (row.wilks, row.F, row.df1, row.df2, row.chi2) == pytest.approx((wilks, f, df1, df2, chi2), rel=1e-7)
            assert row.p_f == pytest.approx(1 - special.f_cdf(f, df1, df2), abs=1e-9)
            u, v = (x - x.mean(axis=0)) @ np.asarray(row.a), (y - y.mean(axis=0)) @ np.asarray(row.b)
            assert np.var(u, ddof=1) == pytest.approx(1) and np.var(v, ddof=1) == pytest.approx(1) and np.corrcoef(u, v)[0, 1] == pytest.approx(row.r, abs=1e-9)
    assert C.canoncorr(table.filter("false"), names[:3], names[3:], K).collect() == []


def test_sequential_p_stops_at_the_first_significant_one():
    tests = C.canonical_tests(np.asarray([0.99, 0.9, 0.1]), 50, 3, 3)
    p = [1 - special.chi2_cdf(t["chi2"], t["df1"]) for t in tests]
    assert [t["p_chi2"] for t in tests] == [0.0, pytest.approx(p[1], abs=1e-12), pytest.approx(p[2])] and p[1] < 0.001 < p[2]
    certain = C.canonical_tests(np.asarray([1.0, 0.5]), 20, 2, 2)
    assert certain[0]["wilks"] == 0 and math.isinf(certain[0]["F"]) and certain[0]["p_f"] == 0 and certain[1]["wilks"] == pytest.approx(0.75)


def _courses(x: np.ndarray, k: int) -> np.ndarray:
    """Significant autocorrelated courses of k principal components, from the data matrix (units x times)."""
    x = x - x.mean(axis=1, keepdims=True)
    v = np.linalg.svd(x, full_matrices=False)[2].T[:, :k]
    a, b = v[:-1] - v[:-1].mean(axis=0), v[1:] - v[1:].mean(axis=0)
    qa, ta = np.linalg.qr(a)
    qb, tb = np.linalg.qr(b)
    left, r, right = np.linalg.svd(qa.T @ qb)
    u, w = a @ np.linalg.solve(ta, left), b @ np.linalg.solve(tb, right.T)
    course = np.vstack([u[:1], u[1:] + w[:-1] / 2, w[-1:]])
    course = (course - course.mean(axis=0)) / np.linalg.norm(course - course.mean(axis=0), axis=0)
    n, keep, significant = len(a), [], True
    for j in range(k - 1, -1, -1):
        chi = -(n - j - (2 * k + 3) / 2 + (1 / r[:j] ** 2).sum()) * np.log(1 - r[j:] ** 2).sum()
        p = 1 - special.chi2_cdf(chi, (k - j) ** 2) if significant else 0.0
        significant = significant and p >= 0.001
        keep.append(p < 0.05)
    return course[:, np.asarray(keep[::-1])]


def test_physio_components_against_whole_matrices(spark):
    r = np.random.default_rng(8)
    units, times, runs = 120, 30, 3
    weight = np.where(np.arange(units) < 50, 0.2, 0.8)
    weight[-5:] = 0.5  # neither
    slow = lambda: np.convolve(r.normal(size=times + 9), np.ones(10) / 3, "valid")
    data = {}
    outside, inside = r.random(units) * (weight < 0.5), r.random(units) * (weight > 0.5)
    for run in range(runs):
        data["s", run] = 3 * np.outer(outside, slow()) + 3 * np.outer(inside, slow()) + r.normal(size=(units, times)) + 10
    tissue = spark.createDataFrame([("s", i, float(w)) for i, w in enumerate(weight)], "subject string, unit long, weight double")
    packed = _packed(spark, data, "subject string, run long")
    summary, regressors, spm = C.physio_components(packed, tissue, K)
    best = None
    for k in range(3, 15):  # half of 30 less 1 is 14
        courses, maps = [], []
        for run in range(runs):
            x = data["s", run] - data["s", run].mean(axis=1, keepdims=True)
            t = _courses(data["s", run], k)
            v = (x @ t) ** 2 / (x**2).sum(axis=1, keepdims=True)
            kept = np.median(v[weight < 0.5], axis=0) >= np.median(v[weight > 0.5], axis=0)
            courses.append(t[:, kept])
            maps.append(v[:, kept].sum(axis=1))
        if all(c.shape[1] for c in courses):
            pairs = list(itertools.combinations(maps, 2))
            score = np.mean([np.corrcoef(a, b)[0, 1] for a, b in pairs])
            if best is None or score > best[1]:
                z = np.mean([(a / a.std(ddof=1) + b / b.std(ddof=1)) / math.sqrt(2) / math.sqrt(1 - np.corrcoef(a, b)[0, 1]) for a, b in pairs], axis=0)
                best = (k, score, courses, z)
    (row,) = summary.collect()
    assert (row.k, row.R) == (best[0], pytest.approx(best[1], abs=1e-8)) and row.components == pytest.approx(np.mean([c.shape[1] for c in best[2]]))
    assert np.allclose([x.z for x in spm.orderBy("unit").collect()], best[3], atol=1e-6)
    assert np.corrcoef(best[3], outside)[0, 1] > 0.7  # it finds what was planted
    found = regressors.collect()
    for run in range(runs):
        own = np.stack([x.w for x in sorted(found, key=lambda x: x.component) if x.run == run], axis=1)
        assert np.allclose(np.abs(own.T @ best[2][run]), np.eye(own.shape[1]), atol=1e-6)
    clean = {(x.run, x.unit): np.asarray(x.y) for x in C.physio_denoise(packed, regressors, tissue, K).collect()}
    kept = {(x.run, x.unit): np.asarray(x.y) for x in C.physio_denoise(packed, regressors, tissue, K, weighted=False, keep_mean=True).collect()}
    for (_, run), x in data.items():
        design = np.hstack([np.ones((times, 1)), best[2][run]])
        rest = x - x @ np.linalg.pinv(design).T @ design.T
        assert all(np.allclose(clean[run, i], rest[i] * weight[i], atol=1e-6) and np.allclose(kept[run, i], rest[i] + x[i].mean(), atol=1e-6) for i in range(units))
    alone = C.physio_components(packed.filter("run = 0"), tissue, K)  # one run makes no pair
    assert [x.collect() for x in alone] == [[], [], []]


def test_task_courses_are_taken_out(spark):
    r = np.random.default_rng(1)
    data, maps, weight = r.normal(size=(40, 20)) + 5, r.normal(size=(40, 2)), r.random(40)
    packed = _packed(spark, {("s", 0): data}, "subject string, run long")
    table = spark.createDataFrame([("s", i, j, float(maps[i, j])) for i in range(40) for j in range(2)], "subject string, unit long, component int, value double")
    tissue = spark.createDataFrame([("s", i, float(w)) for i, w in enumerate(weight)], "subject string, unit long, weight double")
    x = data - data.mean(axis=1, keepdims=True)
    course = (x * weight[:, None]).T @ ((maps - maps.mean(axis=0)) / maps.std(axis=0, ddof=1))
    design = np.hstack([np.ones((20, 1)), course])
    expected = data - data @ np.linalg.pinv(design).T @ design.T
    got = [row.y for row in C.without_task(packed, table, tissue, K).orderBy("unit").collect()]
    assert np.allclose(got, expected, atol=1e-8)


def _variates(x: np.ndarray, lags: int, splits: list, by_course: bool, share: float) -> dict:
    """x: units x blocks x lags, normalised.  (q, component) -> R, P, rms, course, map, all from maps over units."""
    units, blocks, _ = x.shape
    flat = x.reshape(units, -1)
    u, s, _ = np.linalg.svd(flat, full_matrices=False)
    first = min(int((s**2 > flat.shape[1] * np.finfo(float).eps * s[0] ** 2).sum()), math.floor(share * blocks * lags))
    u = u[:, :first]

    def side(part):
        q = (u.T @ x[:, part].reshape(units, -1))
        q = q - q.mean(axis=1, keepdims=True)
        return q, np.linalg.svd(q)[0]

    def fit(scores):
        c = scores.T - scores.T.mean(axis=0)
        d = np.tile(np.eye(lags), (len(c) // lags, 1))
        d = np.linalg.svd(d - d.mean(axis=0), full_matrices=False)[0][:, : lags - 1]
        q, t = np.linalg.qr(c)
        left = np.linalg.svd(q.T @ d, full_matrices=False)[0]
        a = np.linalg.solve(t, left) * math.sqrt(len(c) - 1)
        return a * np.sign(a[np.abs(a).argmax(axis=0), np.arange(a.shape[1])])

    z = lambda v: (v - v.mean(axis=0)) / v.std(axis=0, ddof=1)
    lagged = lambda v: v.reshape(-1, lags, v.shape[1])
    out = {}
    whole, u0 = side(list(range(blocks)))
    for q in range(1, math.floor(first / 2 + 0.5) + 1):
        s0 = (u0.T @ whole)[:q]
        a0 = fit(s0)
        m0, c0 = u @ u0[:, :q] @ a0, lagged(s0.T @ a0).mean(axis=0)
        found = []
        for split in splits:
            sides = []
            for h in (1, 2):
                own, uh = side([b for b in range(blocks) if split[b] == h])
                a = fit((uh.T @ own)[:q])
                m, c = u @ uh[:, :q] @ a, lagged((uh.T @ own)[:q].T @ a).mean(axis=0)
                n = m0.shape[1]
                order, sign = [0] * n, [1.0] * n
                if by_course:
                    free = set(range(n))
                    for i in np.argsort(-c0.std(axis=0), kind="stable"):
                        order[i] = min(free, key=lambda j, i=i: min(((c[:, j] - c0[:, i]) ** 2).sum(), ((c[:, j] + c0[:, i]) ** 2).sum()))
                        free.remove(order[i])
                        sign[i] = 1.0 if ((c[:, order[i]] - c0[:, i]) ** 2).sum() <= ((c[:, order[i]] + c0[:, i]) ** 2).sum() else -1.0
                else:
                    r = np.corrcoef(m0.T, m.T)[:n, n:]
                    left = np.abs(r)
                    for _ in range(n):
                        i, j = np.unravel_index(left.argmax(), left.shape)
                        order[i], sign[i] = j, np.sign(r[i, j])
                        left[i], left[:, j] = -1, -1
                sides.append((own, uh, a[:, order] * sign, m[:, order] * sign, c[:, order] * sign))
            (o1, u1, a1, m1, c1), (o2, u2, a2, m2, c2) = sides
            r = np.asarray([np.corrcoef(m1[:, i], m2[:, i])[0, 1] for i in range(m1.shape[1])])
            spm = (m1 / m1.std(axis=0, ddof=1) + m2 / m2.std(axis=0, ddof=1)) / math.sqrt(2) / np.sqrt(1 - r)
            p, far = [], []
            for ut, at, ct, own, other in ((u1, a1, c1, o1, o2), (u2, a2, c2, o2, o1)):
                scores, mine = (ut.T @ other)[:q].T @ at, (ut.T @ own)[:q].T @ at
                for i, v in enumerate(scores):
                    e = np.exp(-0.5 * ((v - ct) ** 2).sum(axis=1))
                    p.append((e / e.sum())[i % lags] if e.sum() > 0 else 1 / lags)
                far.append(np.abs(lagged(z(scores)) - lagged(z(mine)).mean(axis=0)).reshape(-1, scores.shape[1]))
            found.append((r, np.mean(p), np.concatenate(far).mean(axis=0), (c1 + c2) / 2, spm))
        for i in range(m0.shape[1]):
            out[q, i + 1] = (np.median([f[0][i] for f in found]), np.median([f[1] for f in found]), (math.sqrt(2) - np.median([f[2][i] for f in found])) / math.sqrt(2), np.mean([f[3][:, i] for f in found], axis=0), np.mean([f[4][:, i] for f in found], axis=0))
    return out


def _windows(units: int, blocks: int, lags: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    shape = np.exp(-((np.arange(lags) - 2) ** 2) / 2)
    return np.outer(r.normal(size=units) * (np.arange(units) < units // 3), shape)[:, None, :] * 4 + r.normal(size=(units, blocks, lags)) + 3


def _window_rows(spark, x: np.ndarray):
    rows = [("s", u, b, k, float(x[u, b, k])) for u in range(x.shape[0]) for b in range(x.shape[1]) for k in range(x.shape[2])]
    return spark.createDataFrame(rows, "subject string, unit long, block long, lag int, y double").repartition(4)


@pytest.mark.parametrize("blocks,by_course", [(4, False), (5, True), (6, False), (7, True)])
def test_event_variates_against_whole_matrices(spark, blocks, by_course):
    lags, x = 5, _windows(60, blocks, 5, blocks)
    packed = C.packed_windows(_window_rows(spark, x), K)
    x = x - x.mean(axis=2, keepdims=True)
    x = x / x.std(axis=2, ddof=1).mean(axis=0)[None, :, None]
    assert np.allclose([r.y for r in packed.orderBy("unit").collect()], x.reshape(60, -1))
    share = 0.4 if blocks == 5 else 0.5  # with more, two correlations of a half are 1 and their variates arbitrary
    variates = C.all_variates(packed, K, lags, share, by_course)
    splits = R.block_resamples(blocks)
    assert len(splits) == {4: 3, 5: 10, 6: 10, 7: 30}[blocks]
    expected = _variates(x, lags, splits, by_course, share)
    maps = {}
    for row in variates.collect():
        r, p, rms, course, spm = expected.pop((row.q, row.component))
        assert (row.R, row.P, row.rms) == pytest.approx((r, p, rms), abs=1e-6)
        sign = np.sign(np.dot(row.course, course))
        assert np.allclose(np.asarray(row.course) * sign, course, atol=1e-6)
        own = x.reshape(60, -1) @ np.asarray(row.w)
        assert np.allclose(own * sign, spm, atol=1e-5)
        maps[row.q, row.component] = (row, own)
    assert not expected
    d = {q: math.hypot(1 - row.R, 1 - row.P) for (q, c), (row, _) in maps.items() if c == 1}
    (best,) = C.model_ercva(variates, K).collect()
    assert best.q == min(d, key=lambda q: (d[q], q)) and best.dPR == pytest.approx(-d[best.q]) and best.R > 0.5 and best.P > 1.5 / lags
    shape = np.exp(-((np.arange(lags) - 2) ** 2) / 2)
    (matched,) = C.model_ercva(variates, K, shape).collect()
    assert np.corrcoef(matched.course, shape)[0, 1] > 0.8
    summary, spm = C.model_ercva_multi(packed, variates, K, lags)
    score = {}
    for q in d:
        kept = []
        for (qq, c), (row, z) in maps.items():
            p = np.sort([1 - special.norm_cdf(abs(v)) for v in z])
            if qq == q and (p / np.arange(1, len(p) + 1) <= 0.05 / len(p)).any():
                kept.append((c, row.R))
        score[q] = (sum(r * r for _, r in kept) / (lags - 1) if kept else -1.0, [c for c, _ in kept])
    (multi,) = summary.collect()
    p_of = {q: row.P for (q, _), (row, _) in maps.items()}
    far = {q: math.hypot(1 - score[q][0], 1 - p_of[q]) for q in score}
    assert multi.q == min(far, key=lambda q: (far[q], q)) and multi.R == pytest.approx(score[multi.q][0]) and [c.component for c in multi.components] == score[multi.q][1]
    assert {r.component for r in spm.collect()} == set(score[multi.q][1])


def test_too_few_blocks_give_nothing(spark):
    assert C.all_variates(C.packed_windows(_window_rows(spark, _windows(10, 3, 4, 0)), K), K, 4).collect() == []


@pytest.mark.parametrize("onsets", [[2, 11, 21, 30, 33], [1, 2, 3, 4, 5, 6, 35, 99, -3, 37], [5, 6]])
def test_block_windows(spark, onsets):
    r, times, window, blocks = np.random.default_rng(4), 40, 4, 4
    y = r.normal(size=(3, times))
    series = spark.createDataFrame([("s", u, t, float(y[u, t])) for u in range(3) for t in range(times)], "subject string, unit long, t long, y double")
    table = spark.createDataFrame([("s", o) for o in onsets], "subject string, onset_t long")
    good = sorted(o for o in onsets if 0 <= o <= times - window)
    part = times // blocks
    by_time = [[o for o in good if k * part + 1 < o + 1 + window / 2 < (k + 1) * part] for k in range(blocks)]
    if not all(by_time):
        q = len(good) // blocks
        by_time = [good[k * q : (k + 1) * q] if k < blocks - 1 else good[k * q :] for k in range(blocks)] if q else []
    expected = {(u, k, lag): np.mean([y[u, o + lag] - y[u, o] for o in own]) for k, own in enumerate(by_time) for u in range(3) for lag in range(window)}
    got = {(x.unit, x.block, x.lag): x.y for x in C.block_windows(series, table, window, blocks, K).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(v) for k, v in expected.items())


def test_spike_and_edge_components_go_and_smooth_ones_stay(spark):
    r, side, times = np.random.default_rng(3), 10, 40
    places = [(x, y, z) for z in range(3) for y in range(side) for x in range(side)]
    mean = np.asarray([100.0 if x >= 5 else 0.0 for x, _, _ in places])
    edge = np.asarray([30.0 if x in (4, 5) else 0.0 for x, _, _ in places])
    course = lambda k: np.sin(2 * np.pi * k * np.arange(times) / times)
    maps = np.linalg.qr(np.hstack([edge[:, None], r.normal(size=(len(places), 13))]))[0][:, 1:] * math.sqrt(len(places))
    smooth = [np.outer(maps[:, k] * (3 + 0.3 * k), course(k + 1)) for k in range(12)]
    spike = np.zeros(times)
    spike[17] = 1.0
    bump = np.outer(maps[:, 12] * 40, spike)
    data = mean[:, None] + np.outer(edge, course(15)) + bump + sum(smooth) + 0.01 * r.normal(size=(len(places), times))
    packed = _packed(spark, {"s": data})
    gradients = np.gradient(mean.reshape(3, side, side))
    rows = [("s", i, float(gradients[2].ravel()[i]), float(gradients[1].ravel()[i]), float(gradients[0].ravel()[i])) for i in range(len(places))]
    spikes = C.component_spikes(packed, G.gram(packed, K), spark.createDataFrame(rows, "subject string, unit long, fx double, fy_ double, fz double"), K)
    found = spikes.collect()
    like = lambda w, v: abs(np.dot(w, v - v.mean()) / np.linalg.norm(v - v.mean()))
    assert [like(x.w, course(15)) > 0.95 for x in found if x.spatial] == [True]
    assert [x.component for x in found if x.temporal] == [max(found, key=lambda x: like(x.w, spike)).component]
    for x in found:  # the measures themselves
        value = ((data - data.mean(axis=1, keepdims=True)) @ np.asarray(x.w)) ** 2
        squares = np.asarray([[g * g for g in row[2:]] for row in rows])
        design = np.hstack([np.ones((len(rows), 1)), squares])
        rest = value - design @ np.linalg.pinv(design) @ value
        assert x.edge == pytest.approx(math.sqrt(max(0.0, 1 - rest.var() / value.var())), abs=1e-6)
        near = [max(0, t - 7) for t in range(times)]
        assert x.spike == pytest.approx(max((x.w[t] - np.median([x.w[u] for u in range(near[t], min(times, t + 8)) if u != t])) ** 2 for t in range(times)))
    clean = np.asarray([x.y for x in C.component_spike_filter(packed, spikes, K).orderBy("unit").collect()])
    w = np.stack([x.w for x in found if x.temporal or x.spatial], axis=1)
    assert np.allclose(clean, data - (data - data.mean(axis=1, keepdims=True)) @ w @ w.T, atol=1e-8) and np.allclose(clean.mean(axis=1), data.mean(axis=1))
    assert np.linalg.norm(clean @ course(15)) < 0.1 * np.linalg.norm(data @ course(15)) and np.linalg.norm(clean @ course(2)) > 0.8 * np.linalg.norm(data @ course(2))
    few = spikes.filter("component < 3")
    assert np.allclose([x.y for x in C.component_spike_filter(packed, few.withColumn("temporal", few.component * 0).withColumn("spatial", few.component * 0), K).orderBy("unit").collect()], data)


@pytest.mark.parametrize("times", [30, 47, 64])
def test_sliding_amplitudes(spark, times):
    y = np.random.default_rng(times).normal(size=(9, times))
    y[4] = 0.0
    half = times // 2
    size = 2 ** math.ceil(math.log2(half))
    f = 0.25 * np.linspace(0, 1, size // 2 + 1)
    shares = []
    for t in range(0, half, 10):
        a = np.abs(np.fft.fft(y[:, t : t + half + 1], size, axis=1))[:, : size // 2 + 1]
        with np.errstate(invalid="ignore"):
            shares.append(np.nan_to_num(a[:, (f > 0.015) & (f < 0.08)].sum(axis=1) / a[:, f > 0.0001].sum(axis=1), nan=2.0**-52))
    one, two = shares[0], shares[-1]
    r = np.corrcoef(one, two)[0, 1]
    got = G.model_falff(_packed(spark, {"s": y}), K, 2.0).orderBy("unit").collect()
    assert np.allclose([x.falff for x in got], np.mean(shares, axis=0)) and all(x.R == pytest.approx(r) for x in got)
    assert np.allclose([x.z for x in got], (one / one.std(ddof=1) + two / two.std(ddof=1)) / math.sqrt(2) / math.sqrt(1 - r))


def test_repeated_measures_over_groups(spark):
    # a small table worked by hand: two groups of two subjects at two times
    y = {("a", 1): (1.0, 3.0), ("a", 2): (3.0, 7.0), ("b", 3): (6.0, 6.0), ("b", 4): (8.0, 10.0)}
    rows = [(0, g, s, t, v) for (g, s), own in y.items() for t, v in enumerate(own)]
    table = spark.createDataFrame(rows, "unit long, team string, who long, time int, y double")
    (row,) = groups.anova_repeated_groups(table, "y", "unit", "team", "who", "time").collect()
    # means: all 5.5; a 3.5, b 7.5; times 4.5, 6.5; cells 2, 5, 7, 8; subjects 2, 5, 6, 9
    ss_g, ss_s, ss_t, ss_gt, ss_r = 8 * 4.0, 2 * (2.25 * 4), 8 * 1.0, 8 * 0.25, 8 * 0.25
    assert (row.f_g, row.f_t, row.f_gt) == pytest.approx((ss_g / (ss_s / 2), ss_t / (ss_r / 2), ss_gt / (ss_r / 2)))
    assert (row.df_t, row.df_g, row.df_s, row.df_r) == (1, 1, 2, 2)
    (tail,) = groups.with_tails(groups.anova_repeated_groups(table, "y", "unit", "team", "who", "time")).collect()
    assert tail.p_g == pytest.approx(1 - special.f_cdf(row.f_g, 1, 2)) and tail.p_gt == pytest.approx(1 - special.f_cdf(row.f_gt, 1, 2))
    single = table.withColumn("team", table.unit)
    (one,) = groups.anova_repeated_groups(single, "y", "unit", "team", "who", "time").collect()
    (plain,) = groups.anova_repeated(table, "y", "unit", "who", "time").collect()
    assert one.f_t == pytest.approx(plain.F) and one.f_g is None and one.f_gt is None


def test_applied_optimum_equals_each_pipeline_alone(spark):
    r, t, units = np.random.default_rng(5), 24, 6
    data = {s: r.normal(size=(units, t)) * 2 + 50 for s in "abc"}
    flat, task = {s: r.normal(size=t) for s in "abc"}, {s: r.normal(size=t) for s in "abc"}
    weight = r.random(units)
    kinds = spark.createDataFrame([(s, k, 1, v[s].tolist()) for k, v in (("flat", flat), ("task", task)) for s in "abc"], "subject string, kind string, k long, w array<double>")
    pipelines = {1: (1, [], [], 0), 2: (2, ["flat"], [], 0), 3: (1, ["flat"], ["task"], 1)}
    table = spark.createDataFrame([(p, *v) for p, v in pipelines.items()], "pipeline_id long, drift int, remove array<string>, keep array<string>, lowpass int")
    chosen = {"CON": dict.fromkeys("abc", 1), "FIX": dict.fromkeys("abc", 3), "IND": {"a": 2, "b": 1, "c": 3}, "MIN": dict.fromkeys("abc", 2), "MAX": dict.fromkeys("abc", 2)}
    choices = spark.createDataFrame([(s, n, p) for n, own in chosen.items() for s, p in own.items()], "subject string, scheme string, pipeline_id long")
    weights = spark.createDataFrame([(s, i, float(w)) for s in "abc" for i, w in enumerate(weight)], "subject string, unit long, weight double")
    low = G.zero_phase_operator(t, *G.butterworth(*G.lowpass_order(2.0)))

    def alone(s: str, p: int) -> np.ndarray:
        drift, remove, keep, lowpass = pipelines[p]
        noise = np.hstack([G.legendre(t, drift), *([flat[s][:, None]] if remove else [])])
        both = np.hstack([noise, *([task[s][:, None]] if keep else [])])
        b = data[s] @ np.linalg.pinv(both).T
        rest = data[s] - b[:, : noise.shape[1]] @ noise.T
        return (rest @ low if lowpass else rest) * weight[:, None] + data[s].mean(axis=1, keepdims=True)

    for scheme, names in (("ALL", ("CON", "FIX", "IND")), ("con", ("CON",)), ("FIX", ("FIX",)), ("IND", ("IND",))):
        got = R.apply_optimum(_packed(spark, data), choices, table, kinds, K, 2.0, scheme, weights, keep_mean=True).collect()
        assert len(got) == len(names) * 3 * units and {x.scheme for x in got} == set(names)
        for x in got:
            assert x.pipeline_id == chosen[x.scheme][x.subject] and np.allclose(x.y, alone(x.subject, x.pipeline_id)[x.unit], atol=1e-8)
    plain = R.apply_optimum(_packed(spark, data), choices, table, kinds, K, 2.0, "CON").filter("subject = 'a' AND unit = 0").collect()
    assert np.allclose(plain[0].y, data["a"][0] @ G.remove_columns(G.legendre(t, 1)), atol=1e-8)


def test_one_subject_overrides_the_group(spark):
    rows = [(7, p, p // 2 % 2, p % 2, 0, 0.1 * p, 0.5, -1 / p, 0.1, 0.5, 10.0) for p in range(1, 5)]
    table = spark.createDataFrame(rows, "subject long, pipeline_id long, motcor long, gspc long, censor long, P double, R double, dPR double, MOT_corr double, GS_fract double, XCond double")
    got = {x.scheme: x.pipeline_id for x in selection.optimum_summary(table, {"motcor": 1.0, "gspc": 0.0, "censor": 0.0}).collect()}
    assert got == {"CON": 2, "FIX": 4, "MIN": 4, "MAX": 4, "IND": 4}
