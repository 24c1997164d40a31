"""Compromise of similarity matrices against a plain version that makes every resample's matrices."""

from __future__ import annotations

import numpy as np
import pytest

from gridwise.operators import compromise as P

N, K, B = 7, 5, 40


def plain(matrices):
    c = np.eye(K) - 1 / K
    s = np.stack([0.5 * c @ m @ c for m in matrices])
    s = s / np.linalg.svd(s, compute_uv=False)[:, :1, None]

    def compromise(s):
        rv = np.array([[np.trace(a @ b) / np.sqrt(np.trace(a @ a) * np.trace(b @ b)) for b in s] for a in s])
        values, vectors = np.linalg.eigh(rv)
        w = vectors[:, -1] / vectors[:, -1].sum()
        return w, values[-1] / values.sum(), (s * w[:, None, None]).sum(axis=0)

    weight, share, whole = compromise(s)
    values, vectors = np.linalg.eigh(whole)
    v, size = vectors[:, ::-1][:, :2], values[::-1][:2]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), [0, 1]])
    boot = np.stack([compromise(s[np.random.default_rng((42, b)).integers(N, size=N)])[2] @ (v / np.sqrt(size)) for b in range(B)])
    return weight, share, v * np.sqrt(size), size / np.abs(values).sum(), boot


@pytest.fixture(scope="module")
def matrices():
    r = np.random.default_rng(0)
    common = r.standard_normal((K, 3))
    x = common + 0.6 * r.standard_normal((N, K, 3))
    return x @ x.transpose(0, 2, 1)


def table(spark, matrices):
    return spark.createDataFrame([(f"s{n}", i, j, float(matrices[n, i, j])) for n in range(len(matrices)) for i in range(K) for j in range(K)], "subject string, i long, j long, value double").repartition(4)


def test_distatis(spark, matrices):
    weight, share, f, shares, boot = plain(matrices)
    # an item that one subject lacks is left out
    more = spark.createDataFrame([("s0", 9, j, 1.0) for j in (0, 9)] + [("s0", 0, 9, 1.0)], "subject string, i long, j long, value double")
    subjects, items = P.distatis(table(spark, matrices).unionByName(more), B)
    got = {r.subject: r for r in subjects.collect()}
    assert len(got) == N and all(got[f"s{n}"].weight == pytest.approx(weight[n]) and got[f"s{n}"].explained == pytest.approx(share) for n in range(N))
    rows = items.orderBy("item").collect()
    assert [r.item for r in rows] == list(range(K))
    for k, r in enumerate(rows):
        assert (r.f1, r.f2, r.share1, r.share2) == pytest.approx((*f[k], *shares))
        assert (r.x, r.y) == pytest.approx(tuple(boot[:, k].mean(axis=0)))
        assert (r.major, r.minor) == pytest.approx(P.ellipse(boot[:, k])[2:4])


def test_ellipse_holds_its_share():
    r = np.random.default_rng(3)
    points = r.standard_normal((400, 2)) * [3, 1] @ np.array([[np.cos(0.5), np.sin(0.5)], [-np.sin(0.5), np.cos(0.5)]]) + [10, -4]
    x, y, major, minor, angle = P.ellipse(points)
    assert angle == pytest.approx(0.5, abs=0.1) and major / minor == pytest.approx(3, rel=0.2)
    d = points - [x, y]
    along, across = d @ [np.cos(angle), np.sin(angle)], d @ [-np.sin(angle), np.cos(angle)]
    assert ((along / major) ** 2 + (across / minor) ** 2 <= 1 + 1e-9).sum() == 380


def test_degenerate_points():
    assert P.ellipse(np.ones((5, 2)))[2:] == (0.0, 0.0, 0.0)
    line = P.ellipse(np.stack([np.arange(20.0), np.arange(20.0)], axis=1))
    assert line[3] == 0.0 and line[4] == pytest.approx(np.pi / 4) and line[2] > 0
    assert P.ellipse(np.ones((1, 2)))[2] is None


def test_equal_subjects_and_no_rows(spark, matrices):
    subjects, items = P.distatis(table(spark, matrices[[0, 0, 0]]), 5)
    assert [r.weight for r in subjects.collect()] == pytest.approx([1 / 3] * 3)
    assert all(r.x == pytest.approx(r.f1) and r.major == pytest.approx(0, abs=1e-6) for r in items.collect())
    assert all(t.count() == 0 for t in P.distatis(table(spark, matrices).limit(0), 3))
