"""Whitening against numpy's eigenvectors and an exact polynomial found another way."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from gridwise.llm import whitening


def _polynomial(matrix: list[list[int]]) -> list[int]:
    """Coefficients, lowest first, by the recurrence over traces of powers."""
    d = len(matrix)
    a = np.asarray(matrix, dtype=object)
    one = np.asarray([[int(i == j) for j in range(d)] for i in range(d)], dtype=object)
    m, c = one * 0, [0] * d + [1]
    for k in range(1, d + 1):
        m = a @ m + c[d - k + 1] * one
        c[d - k] = int(Fraction(-sum((a @ m)[i, i] for i in range(d)), k))
    return c


def _scatter(rows: list[list[int]]) -> list[list[int]]:
    x = np.asarray(rows, dtype=object)
    return [[int(v) for v in row] for row in len(rows) * x.T @ x - np.outer(x.sum(axis=0), x.sum(axis=0))]


@pytest.mark.parametrize("case", ["plain", "low rank", "blocks", "one"])
def test_polynomial_is_exact(spark, case):
    r = random.Random(5)
    rows = [[r.randrange(-9000, 9000) for _ in range(1 if case == "one" else 7)] for _ in range(40)]
    if case == "low rank":
        rows = [[*x[:3], 2 * x[0], x[1] - x[2], 5, 5] for x in rows]
    if case == "blocks":  # a zero below the diagonal where a pivot is looked for
        rows = [[x[0], 0, 0, x[0], 0, x[0], 0] for x in rows]
    matrix = _scatter(rows)
    assert whitening.characteristic_polynomial(spark, matrix) == _polynomial(matrix)


def test_products_are_exact_beyond_doubles():
    r = random.Random(1)
    for top in (1000, 1 << 30, 1 << 61):
        rows = [[float(r.randrange(-top, top)) for _ in range(3)] for _ in range(600)]
        expected = [[sum(int(x[i]) * int(x[j]) for x in rows) for j in range(3)] for i in range(3)]
        assert whitening.exact_products(np.asarray(rows)).tolist() == expected


def test_roots_and_null_vectors():
    # eigenvalues 9, 4, 4, 4 and 0 of an integer matrix
    base = np.asarray([[1, 1, 1, 1, 0], [1, -1, 0, 0, 0], [1, 1, -2, 0, 0], [1, 1, 1, -3, 0], [0, 0, 0, 0, 1]], dtype=object)
    values = (9, 4, 4, 4, 0)
    unit = 12  # least common multiple of the squared lengths 4, 2, 6, 12, 1
    matrix = sum((v * unit // int(b @ b)) * np.outer(b, b) for v, b in zip(values, base, strict=True)).tolist()
    roots = whitening.Roots(_polynomial(matrix))
    assert roots.zeros == 1 and roots.positive == 4
    found = [roots.find(k) for k in (1, 2, 3, 4)]
    assert [f[2:] for f in found] == [(1, 1), (2, 4), (2, 4), (2, 4)]
    assert [round(f[0] / 2 ** f[1], 9) for f in found] == [9 * unit, 4 * unit, 4 * unit, 4 * unit]
    vectors = np.asarray([[float(x) / 2**whitening.FRACTION_BITS for x in v] for v in whitening.null_vectors(matrix, *found[1][:2], 3)])
    assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-15)
    assert np.allclose(np.asarray(matrix, float) @ vectors.T, 4 * unit * vectors.T, atol=1e-12)


def test_close_eigenvalues_are_told_apart():
    c = [1]
    wanted = [10**12, 10**12 - 1, 10**12 - 1, 3, 1]
    for v in wanted:
        c = [a - v * b for a, b in zip([0, *c], [*c, 0], strict=True)]
    roots = whitening.Roots(c)
    found = [roots.find(k) for k in range(1, 6)]
    assert [round(Fraction(a, 1 << bits)) for a, bits, _, _ in found] == wanted
    assert [f[2:] for f in found] == [(1, 1), (2, 3), (2, 3), (4, 4), (5, 5)]


def _checked(rows: list[tuple], got: list) -> None:
    """rows: (vec_id, vector) of the usable vectors."""
    x = np.floor(np.asarray([v for _, v in rows], float) * 1024)
    e, u = np.linalg.eigh(np.cov(x.T, bias=True).reshape(x.shape[1], -1))
    e, u = e[::-1], u[:, ::-1]
    rank = min(8, int((e > 1e-6).sum()))
    assert len(got) == rank * len(rows)
    n, s = len(rows), x.sum(axis=0)
    deviation = {i: int(((n * v - s) ** 2).sum()) for (i, _), v in zip(rows, x, strict=True)}
    table = {(r.vec_id, r.component): r for r in got}
    for k in range(rank):
        expected = (x - x.mean(axis=0)) @ u[:, k] / math.sqrt(e[k])
        have = np.asarray([table[i, k + 1].whitened for i, _ in rows])
        assert min(np.abs(have - expected).max(), np.abs(have + expected).max()) < 1e-6
        assert all(abs(table[i, k + 1].explained - e[k] / e.sum()) < 1e-9 for i, _ in rows)
    assert all(r.n == n and r.deviation == deviation[r.vec_id] and r.identity_error < 1e-9 for r in got)


def test_whiten_holds_against_numpy(spark):
    r = np.random.default_rng(3)
    mix = r.normal(size=(12, 12))
    rows = [(i, v) for i, v in enumerate((r.normal(size=(300, 12)) @ mix / 10).tolist())]
    odd = [(1000, None), (1001, []), (1002, [float("nan")] + [0.0] * 11), (1003, [float("inf")] + [0.0] * 11), (1004, [None] + [0.0] * 11), (1005, [1.0, 2.0]), (1006, [1e300] * 12)]
    table = spark.createDataFrame([(i, v, "x", 0, 0) for i, v in rows + odd], "vec_id long, embedding array<double>, n string, component int, w0 int").repartition(7)
    _checked(rows, whitening.whiten(table).collect())


def test_whiten_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    _checked([(r.vec_id, r.embedding) for r in table.collect()], whitening.whiten(table).collect())


def test_whiten_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], kind)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(None, [0.0, 0.5]), (None, [0.0, 0.5]), (7, [1.0, 0.5])], kind)).collect()  # one component, null and repeated ids
    assert len(same) == 3 and {r.component for r in same} == {1} and sorted(round(abs(r.whitened), 9) for r in same) == [round(math.sqrt(0.5), 9)] * 2 + [round(math.sqrt(2), 9)]
    ties = whitening.whiten(spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]])], kind)).collect()  # equal eigenvalues
    assert len(ties) == 8 and all(abs(r.explained - 0.5) < 1e-12 and r.identity_error < 1e-12 for r in ties)


def test_usable_vectors_of_a_slice():
    column = pa.array([[9.0, 9.0], None, [1.0, 2.0], [3.0], [None, 1.0], [4.0, 5.0]], pa.list_(pa.float32())).slice(1)
    found = whitening.integer_vectors(column)
    assert found[2][0].tolist() == [1, 4] and found[2][1].tolist() == [[1024.0, 2048.0], [4096.0, 5120.0]] and found[1][0].tolist() == [2]
