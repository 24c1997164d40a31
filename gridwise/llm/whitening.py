"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers, so the scatter n * sum(z z') - s s' is exact.  Its characteristic polynomial is found modulo many primes by
Hessenberg reduction, a task a share of the primes, and put together by Chinese remainders, a group a coefficient.  All its roots are
real and none is negative, so the sign changes of its coefficients shifted by a count the roots above a exactly: bisection isolates
the wanted roots.  Inverse iteration with fixed-point integers gives each one's null vector, a task a component.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bits of an eigenvalue, of a fixed-point fraction, and apart from which two eigenvalues count as one.
ROOT_BITS, FRACTION_BITS, CLUSTER_BITS = 160, 384, 120
#: An exact sum travels as so many 32-bit limbs, the last one signed, so that Spark adds longs.
LIMBS = 5
LIMB_NAMES = [f"l{i}" for i in range(LIMBS)]


def integer_vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (places in the batch, floor(SCALE * c) as whole doubles) of the usable vectors: not null, not empty, without null or
    non-finite entries or entries of 2^62 / SCALE and over, whose integers pass a long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    place = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.take(pa.array(place))
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        z = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
        bad = ~(np.abs(z) < 2.0**62)
    usable = size > 0
    usable[np.repeat(np.arange(len(size)), size)[bad]] = False
    of = np.repeat(size * usable, size)
    return {d: (place[usable & (size == d)], z[of == d].reshape(-1, d)) for d in np.unique(size[usable]).tolist()}


def exact_products(z: np.ndarray) -> np.ndarray:
    """z' z of whole doubles below 2^62, as Python integers."""
    if len(z) == 0 or float(np.abs(z).max()) ** 2 * len(z) < 2.0**53:
        return (z.T @ z).astype(np.int64).astype(object)
    total, whole = 0, z.astype(np.int64)
    for rows in np.array_split(whole, -(-len(z) // 256)):
        parts = [(rows & 0x3FFFFF).astype(float), ((rows >> 22) & 0x3FFFFF).astype(float), (rows >> 44).astype(float)]
        for i, a in enumerate(parts):
            for j, b in enumerate(parts):
                total = total + ((a.T @ b).astype(np.int64).astype(object) << 22 * (i + j))
    return total


def scatter(vectors: DataFrame, column: str = "embedding") -> tuple[int, list[int], list[list[int]]]:
    """n, the sums s of z and the products sum(z z') of the usable vectors of the most common length (the greater on ties), exactly;
    n is 0 without any.  The driver sees as many numbers as such a matrix has."""
    names = ["d", "i", "j", *LIMB_NAMES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for d, (_, z) in integer_vectors(batch.column(0)).items():
                rows, sums, products = held.get(d, (0, 0, 0))
                with_one = np.concatenate([z.astype(np.int64).astype(object).sum(axis=0)[None], exact_products(z)])
                held[d] = [rows + len(z), sums + with_one[0], products + with_one[1:]]
        for d, (rows, sums, products) in held.items():
            i, j = np.triu_indices(d)
            values = [rows, *sums, *products[i, j]]
            limbs = [[(v >> 32 * k) & 0xFFFFFFFF for v in values] for k in range(LIMBS - 1)] + [[v >> 32 * (LIMBS - 1) for v in values]]
            i, j = np.concatenate([[-1], np.full(d, -1), i]), np.concatenate([[-1], np.arange(d), j])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(i), d), i, j, *limbs)], names=names)

    parts = vectors.select(column).mapInArrow(run, ", ".join(f"{n} long" for n in names))
    found = parts.groupBy("d", "i", "j").agg(*(F.sum(n).alias(n) for n in LIMB_NAMES))
    counts = found.filter("i = -1 AND j = -1").select("d", "l0", "l1").collect()  # a row a length
    if not counts:
        return 0, [], []
    d = max(counts, key=lambda r: (r.l0 + (r.l1 << 32), r.d)).d
    n, sums, products = 0, [0] * d, [[0] * d for _ in range(d)]
    for r in found.filter(F.col("d") == d).collect():
        value = sum(r[name] << 32 * k for k, name in enumerate(LIMB_NAMES))
        if r.j == -1:
            n = value
        elif r.i == -1:
            sums[r.j] = value
        else:
            products[r.i][r.j] = products[r.j][r.i] = value
    return n, sums, products


def primes_below(top: int, bits: int) -> list[int]:
    """The largest primes below `top` whose product has at least so many bits."""
    found, have, p = [], 0.0, top - 1 - top % 2
    while have < bits:
        if all(pow(b, p - 1, p) == 1 for b in (2, 3, 5, 7)) and all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            have += math.log2(p) - 1e-9
        p -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo a prime under 2^31, lowest first, by reduction to Hessenberg form."""
    h, d = matrix.copy(), len(matrix)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    leading = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks
    leading[0, 0] = 1
    for k in range(d):
        step, weights = 1, np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):
            step = step * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k]) * step % p
        leading[k + 1, 1:] = leading[k, :-1]
        leading[k + 1] = (leading[k + 1] - h[k, k] * leading[k] % p - (weights[:, None] * leading[:k] % p).sum(axis=0)) % p
    return leading[d]


def chinese_remainder(residues: list[int], primes: list[int]) -> int:
    """The number below the product of the primes with these residues."""
    value, modulus = 0, 1
    for r, p in zip(residues, primes, strict=True):
        value += modulus * ((r - value) * pow(modulus, -1, p) % p)
        modulus *= p
    return value


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), lowest first, of a symmetric integer matrix without negative eigenvalues.

    The size of the k-th symmetric function of such eigenvalues is at most C(d, k) (trace / d)^k, which says how many primes suffice.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    mean = -(-trace // d) + 1
    primes = primes_below(1 << 31, max((math.comb(d, k) * mean**k).bit_length() for k in range(d + 1)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.asarray(matrix, dtype=object)
        for batch in batches:
            for p in batch.column(0).to_pylist():
                signed = polynomial_modulo((whole % p).astype(np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d + 1, p)), pa.array(np.arange(d + 1)), pa.array(signed * (-1) ** (d - np.arange(d + 1)) % p)], names=["prime", "k", "residue"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [group["k"].iloc[0]], "value": [hex(chinese_remainder(group["residue"].tolist(), group["prime"].tolist()))]})

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    residues = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(tasks).mapInArrow(run, "prime long, k long, residue long")
    rows = residues.groupBy("k").applyInPandas(merge, "k long, value string").collect()  # a row a coefficient
    size = {r.k: int(r.value, 16) for r in rows}
    return [(-1) ** (d - k) * size[k] for k in range(d + 1)]


class Roots:
    """The roots of a polynomial all of whose roots are real and not negative."""

    def __init__(self, coefficients: list[int]):
        self.zeros = next(i for i, c in enumerate(coefficients) if c)
        self.c = coefficients[self.zeros :]
        self.positive = len(self.c) - 1

    def above(self, a: int, bits: int) -> int:
        """How many roots are greater than a / 2^bits: sign changes after a shift by it, as all roots are real."""
        d = self.positive
        shifted = [c << bits * (d - k) for k, c in enumerate(self.c)]
        for i in range(d):
            for k in range(d - 1, i - 1, -1):
                shifted[k] += a * shifted[k + 1]
        signs = [c > 0 for c in shifted if c]
        return sum(x != y for x, y in zip(signs, signs[1:], strict=False))

    def value(self, a: int, bits: int) -> int:
        total = 0
        for k in range(self.positive, -1, -1):
            total = total * a + (self.c[k] << bits * (self.positive - k))
        return total

    def find(self, rank: int) -> tuple[int, int, int, int]:
        """(a, bits, first, last): the positive root of that rank (1: greatest) is in [a, a + 1] / 2^bits, and the roots of the ranks
        first to last are too near to it to be told apart."""
        low = (abs(self.c[0]) // abs(self.c[1])).bit_length() - 1 - (abs(self.c[1]) // abs(self.c[0])).bit_length() - 1
        high = (abs(self.c[-2]) // abs(self.c[-1])).bit_length() + 1
        floor = max(0, -low)
        while high - low > 1:  # the power of two below the root
            middle = (low + high) // 2
            low, high = (middle, high) if self.above(1 << (middle + floor), floor) >= rank else (low, middle)
        bits = max(0, ROOT_BITS - low)
        a, b = 1 << (low + bits), 1 << (high + bits)
        over_a, over_b = self.above(a, bits), self.above(b, bits)
        while b - a > 1 and over_a - over_b > 1:
            middle = (a + b) // 2
            over = self.above(middle, bits)
            a, over_a, b, over_b = (middle, over, b, over_b) if over >= rank else (a, over_a, middle, over)
        positive = (self.value(b, bits) > 0) - (self.value(b, bits) < 0)
        while b - a > 1:  # alone in there: its sign tells the side
            middle = (a + b) // 2
            sign = self.value(middle, bits)
            a, b = (a, middle) if positive and (sign == 0 or (sign > 0) == (positive > 0)) else (middle, b)
        near = 1 << max(0, ROOT_BITS - CLUSTER_BITS)
        return a, bits, self.above(a + near, bits) + 1, self.above(max(0, a - near), bits)


def null_vectors(matrix: list[list[int]], a: int, bits: int, many: int) -> list[list[int]]:
    """`many` orthonormal fixed-point vectors for the eigenvalues of the matrix nearest to a / 2^bits: inverse iteration on a block."""
    d, one = len(matrix), 1 << FRACTION_BITS
    scale = max(1, max(abs(x) for row in matrix for x in row), (a >> bits) + 1)
    h = np.asarray([[(x << FRACTION_BITS) // scale for x in row] for row in matrix], dtype=object)
    for i in range(d):
        h[i, i] -= (a << FRACTION_BITS) // (scale << bits)
    swaps, factors = [], []
    for m in range(d):
        i = m + max(range(d - m), key=lambda k: abs(h[m + k, m]))
        h[[i, m]] = h[[m, i]]
        h[m, m] = h[m, m] or 1  # an exact root: any tiny pivot does
        f = np.asarray([(x << FRACTION_BITS) // h[m, m] for x in h[m + 1 :, m]], dtype=object)
        if len(f):
            h[m + 1 :, m:] -= (f[:, None] * h[m, m:]) >> FRACTION_BITS
        swaps.append(i)
        factors.append(f)
    r = random.Random(d)
    block = [[r.randrange(-one, one) for _ in range(d)] for _ in range(many)]
    for _ in range(3):
        solved = []
        for v in block:
            x = np.asarray(v, dtype=object)
            for m in range(d):
                x[[swaps[m], m]] = x[[m, swaps[m]]]
                if m + 1 < d:
                    x[m + 1 :] -= (factors[m] * x[m]) >> FRACTION_BITS
            for m in range(d - 1, -1, -1):
                x[m] = ((x[m] - (int((h[m, m + 1 :] * x[m + 1 :]).sum()) >> FRACTION_BITS if m + 1 < d else 0)) << FRACTION_BITS) // h[m, m]
            for _ in range(2):
                x = (x << FRACTION_BITS) // (math.isqrt(int((x * x).sum())) or 1)
                for y in solved:
                    x = x - ((y * (int((x * y).sum()) >> FRACTION_BITS)) >> FRACTION_BITS)
            solved.append((x << FRACTION_BITS) // (math.isqrt(int((x * x).sum())) or 1))
        block = [list(x) for x in solved]
    return block


def components(spark, n: int, sums: list[int], products: list[list[int]], most: int = COMPONENTS) -> list[tuple[float, float, list[float]]]:
    """(eigenvalue of the covariance, its share of the trace, unit vector) of the components with an eigenvalue above 0, at most
    `most`, greatest first; of either sign, the entry of greatest size is positive."""
    d = len(sums)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(matrix[i][i] for i in range(d))
    if trace == 0:
        return []
    roots = Roots(characteristic_polynomial(spark, matrix))
    wanted = min(most, roots.positive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rank in batch.column(0).to_pylist():
                a, bits, first, last = roots.find(rank)
                v = null_vectors(matrix, a, bits, last - first + 1)[rank - first]
                sign = 1 if max(v, key=abs) > 0 else -1
                row = [[rank], [float(Fraction(a, n * n << bits))], [float(Fraction(a, trace << bits))], [[float(Fraction(sign * x, 1 << FRACTION_BITS)) for x in v]]]
                yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1]), pa.array(row[2]), pa.array(row[3], pa.list_(pa.float64()))], names=["rank", "value", "share", "vector"])

    ranks = spark.createDataFrame([(r,) for r in range(1, wanted + 1)], "rank long").repartition(wanted)
    found = ranks.mapInArrow(run, "rank long, value double, share double, vector array<double>").collect()  # a row a component
    return [(r.value, r.share, r.vector) for r in sorted(found)]


def whiten(vectors: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each usable vector and component.

    Vectors that are null, empty, hold null or non-finite entries or entries whose integers pass a long (2^62), and vectors of another
    than the most common length, are dropped.  There are as many components as eigenvalues above 0, at most `most`: none, and so no
    rows, if all vectors are equal or none is left.  Repeated vectors count as often as they occur; vec_id may be null or repeated.
    A deviation beyond a long is null.  Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    n, sums, products = scatter(vectors, column)
    parts = components(spark, n, sums, products, most) if n else []
    if not parts:
        return spark.createDataFrame([], schema)
    d, many = len(sums), len(parts)
    axes = np.asarray([v for _, _, v in parts]).T / np.sqrt([e for e, _, _ in parts])
    mean = np.asarray([float(Fraction(s, n)) for s in sums])
    shares = [s for _, s, _ in parts]

    def deviation(z: np.ndarray) -> list[int | None]:
        whole = z.astype(np.int64)
        if n * float(np.abs(z).max(initial=0)) + max(map(abs, sums)) < math.sqrt(2.0**62 / d):
            return ((n * whole - np.asarray(sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((n * whole.astype(object) - np.asarray(sums, dtype=object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]

    def projected(error: float | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place, z = integer_vectors(batch.column(1)).get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
                w = (z - mean) @ axes
                if error is None:
                    yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(many)], names=[f"w{i}" for i in range(many)])
                    continue
                ids = batch.column(0).take(pa.array(np.repeat(place, many)))
                far = deviation(z)
                columns = [ids, pa.array(np.tile(np.arange(1, many + 1), len(z)), pa.int32()), pa.array(np.full(len(z) * many, n)), pa.array([x for x in far for _ in range(many)], pa.int64()), pa.array(w.ravel()), pa.array(np.tile(shares, len(z))), pa.array(np.full(len(z) * many, error))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return run

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), column)
    spread = rows.mapInArrow(projected(None), ", ".join(f"w{i} double" for i in range(many)))
    pairs = [(i, j) for i in range(many) for j in range(i, many)]
    seen = spread.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()  # one row
    return rows.mapInArrow(projected(max(abs(seen[f"c{i}_{j}"] - (i == j)) for i, j in pairs)), schema)
