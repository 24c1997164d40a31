"""Canonical analysis of two blocks of columns, and what rests on it: physiological components and event-locked canonical variates.

Blocks of columns enter through sums of products, series of many units through their Gram matrix over time; what is found there are weights
over time, and units are seen again only to be projected on them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gridwise.functions import special
from gridwise.operators import gram as G
from gridwise.operators.resampled import block_resamples
from gridwise.operators.stats import fdr
from gridwise.shared import BROADCAST_BYTES, stored


def canonical(sxx: np.ndarray, syy: np.ndarray, sxy: np.ndarray, n: int, tolerance: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Correlations (falling), coefficients of both blocks (variates of variance 1) and their ranks, from centred sums of squares and
    products of n rows.  Directions whose share of a block of unit columns is under the tolerance do not count."""

    def whitened(s: np.ndarray) -> np.ndarray:
        length = np.sqrt(np.diag(s))
        live = length > 0
        scale = np.where(live, length, 1.0)
        values, vectors = np.linalg.eigh(s / np.outer(scale, scale))
        keep = values > tolerance * max(1.0, values[-1]) if len(values) else values > 0
        return vectors[:, keep] / np.sqrt(values[keep]) / scale[:, None]

    wx, wy = whitened(sxx), whitened(syy)
    if not wx.shape[1] or not wy.shape[1]:
        return np.zeros(0), np.zeros((len(sxx), 0)), np.zeros((len(syy), 0)), wx.shape[1], wy.shape[1]
    u, r, v = np.linalg.svd(wx.T @ sxy @ wy, full_matrices=False)
    a, b = wx @ u * math.sqrt(n - 1), wy @ v.T * math.sqrt(n - 1)
    signs = np.sign(a[np.abs(a).argmax(axis=0), np.arange(a.shape[1])])
    return np.clip(r, 0, 1), a * signs, b * signs, wx.shape[1], wy.shape[1]


def canonical_tests(r: np.ndarray, n: int, rank_x: int, rank_y: int, cutoff: float = 0.001) -> list[dict]:
    """For each k: tests that the correlations from the k-th on are 0: Wilks' lambda, Rao's F and its p, and the chi-squared statistic with
    its p.  The latter is worked out from the last k on until one is under the cut-off; those before are 0."""
    d, out = len(r), []
    with np.errstate(divide="ignore"):
        logs = np.cumsum(np.log(1 - np.minimum(r, 1.0) ** 2)[::-1])[::-1]
    for k in range(d):
        d1, d2 = rank_x - k, rank_y - k
        s = math.sqrt((d1 * d1 * d2 * d2 - 4) / (d1 * d1 + d2 * d2 - 5)) if d1 * d2 > 2 else 1.0
        df1, df2 = d1 * d2, (n - (rank_x + rank_y + 3) / 2) * s - d1 * d2 / 2 + 1
        power = math.exp(logs[k] / s) if np.isfinite(logs[k]) else 0.0
        f = (1 - power) / power * df2 / df1 if power > 0 else math.inf
        p = 0.0 if math.isinf(f) else (1 - special.f_cdf(f, df1, df2) if df2 > 0 and f >= 0 else math.nan)
        before = sum(1 / max(x, 1e-150) ** 2 for x in r[:k])
        out.append({"wilks": math.exp(logs[k]) if np.isfinite(logs[k]) else 0.0, "F": f, "df1": float(df1), "df2": float(df2), "p_f": p, "chi2": float(-(n - k - (rank_x + rank_y + 3) / 2 + before) * logs[k]), "p_chi2": 0.0})
    for row in reversed(out):
        row["p_chi2"] = 0.0 if math.isinf(row["chi2"]) else 1 - special.chi2_cdf(max(row["chi2"], 0.0), row["df1"])
        if row["p_chi2"] < cutoff:
            break
    return out


CANONICAL = "component int, r double, wilks double, F double, df1 double, df2 double, p_f double, chi2 double, p_chi2 double, rank_x int, rank_y int, a array<double>, b array<double>"


def canoncorr(table: DataFrame, left: Sequence[str], right: Sequence[str], keys: Sequence[str], cutoff: float = 0.001) -> DataFrame:
    """Canonical correlations of two sets of columns in each group, with their tests and coefficients.

    Rows with a null among the columns are left out.  Columns that depend on others, and constant ones, lower a block's rank; a group of one row,
    or with a block of constants, gives no rows.  The groups enter through one aggregate of sums of products.
    """
    names = list(dict.fromkeys([*left, *right]))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = table.dropna(subset=names).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.covar_pop(a, b).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.schema.fields if f.name in keys)
    columns = [*keys, *(c.split()[0] for c in CANONICAL.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.to_dict("records"):
                n = row["_n"]
                if n < 2:
                    continue
                c = {p: row[f"_{i}"] * n for i, p in enumerate(pairs)}
                s = lambda p, q, c=c: np.asarray([[c[a, b] if (a, b) in c else c[b, a] for b in q] for a in p], float)
                r, a, b, rank_x, rank_y = canonical(s(left, left), s(right, right), s(left, right), n)
                for k, t in enumerate(canonical_tests(r, n, rank_x, rank_y, cutoff)):
                    rows.append((*(row[x] for x in keys), k + 1, float(r[k]), t["wilks"], t["F"], t["df1"], t["df2"], t["p_f"], t["chi2"], t["p_chi2"], rank_x, rank_y, a[:, k], b[:, k]))
            yield pd.DataFrame(rows, columns=columns)

    return sums.mapInPandas(run, f"{spec}, {CANONICAL}" if spec else CANONICAL)


def lagged_courses(g: np.ndarray, most: int, cutoff: float = 0.05) -> list[tuple]:
    """(k, component, course) for k = 3..most principal components: time courses, centred and of length 1, of the significant canonical variates
    between the components' courses and the same a time later.  A course is the first variate's first value, then the first variate plus
    half of the second where both stand for a time, then the second's last value."""
    values, vectors = G.eigen(G.centred(g))
    rows = []
    for k in range(3, min(most, len(values)) + 1):
        x, y = vectors[:-1, :k], vectors[1:, :k]
        x, y = x - x.mean(axis=0), y - y.mean(axis=0)
        r, a, b, rank_x, rank_y = canonical(x.T @ x, y.T @ y, x.T @ y, len(x))
        u, v = x @ a, y @ b
        course = np.vstack([u[:1], u[1:] + v[:-1] / 2, v[-1:]])
        course -= course.mean(axis=0)
        course /= np.maximum(np.linalg.norm(course, axis=0), 1e-300)
        for i, test in enumerate(canonical_tests(r, len(x), rank_x, rank_y)):
            if test["p_chi2"] < cutoff:
                rows.append((k, i + 1, course[:, i]))
    return rows


def largest_dimension(times: int, limit: int = 50) -> int:
    """Most principal components: half the times less one (halves rounded up), three at least."""
    return max(3, min(limit, math.floor(times / 2 - 1 + 0.5)))


def without_task(packed: DataFrame, maps: DataFrame, tissue: DataFrame, keys: Sequence[str], run: str = "run") -> DataFrame:
    """Takes the courses of task maps (keys, unit, component, value) out of each run: the maps' z-scores times the units' weights and series."""
    by = [*keys, "component"]
    spread = maps.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = maps.join(spread, by).join(tissue, [*keys, "unit"]).select(*by, "unit", ((F.col("value") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)) * F.col("weight")).alias("_z"))
    mean = F.aggregate("y", F.lit(0.0), lambda s, v: s + v) / F.size("y")
    parts = packed.withColumn("_mean", mean).join(z, [*keys, "unit"]).select(*by, run, F.posexplode(F.transform("y", lambda v: (v - F.col("_mean")) * F.col("_z"))).alias("t", "v"))
    course = parts.groupBy(*by, run, "t").agg(F.sum("v").alias("v"))
    course = course.groupBy(*by, run).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("w"))
    return regress_out(packed, course, [*keys, run], keep_mean=False)


def regress_out(packed: DataFrame, regressors: DataFrame, keys: Sequence[str], keep_mean: bool) -> DataFrame:
    """Residuals of each unit after a mean and the regressors (keys, w) of its group, with the mean put back if wanted.  Groups without
    regressors lose their mean alone."""
    names = list(keys)
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields if f.name in names)
    times = packed.groupBy(*names).agg(F.first(F.size("y")).alias("_t"))
    held = times.join(regressors.groupBy(*names).agg(F.collect_list("w").alias("_w")), names, "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                t, w = row["_t"], row["_w"]
                mean = np.full((t, t), 1 / t)
                x = np.stack([np.asarray(v, float) for v in w], axis=1) if w is not None and len(w) else np.zeros((t, 0))
                x = x - x.mean(axis=0) if x.size else x
                m = (G.remove_columns(x) if x.size and np.abs(x).max() > 0 else np.eye(t)) - (0 if keep_mean else mean)
                out.append((*(row[k] for k in names), m.ravel()))
            yield pd.DataFrame(out, columns=[*names, "m"])

    return G.apply_operators(packed, stored(held.mapInPandas(run, f"{spec}, m array<double>"), "regress-out"), names)


#: Bins of the shares of variance, even in their square root, that place the medians.
SHARE_BINS = 1024
#: Values that a task holds before equal ones are put together.
HELD_VALUES = 4_000_000


def _by_group(units: DataFrame, table: DataFrame, names: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, Callable[[pa.RecordBatch], Iterator[tuple]]]:
    """Units (keys, unit, runs, weight) beside the rows of their group in `table`; and a function that gives for each group of a batch its key, the
    places of its units and those rows.  Small tables go to every task; larger ones are joined."""
    rows = stored(table.groupBy(*names).agg(F.collect_list(F.struct(*columns)).alias("_rows")), "group-rows")
    sized = F.aggregate("_rows", F.lit(0), lambda s, r: s + 64 + (F.size(r["w"]) * 8 if "w" in columns else 0))
    many = (rows.agg(F.sum(sized)).first()[0] or 0) > BROADCAST_BYTES
    held = None if many else units.sparkSession.sparkContext.broadcast({tuple(r[k] for k in names): r["_rows"] for r in rows.collect()})
    units = units.join(rows, list(names)) if many else units

    def groups(batch: pa.RecordBatch) -> Iterator[tuple]:
        at: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in names), strict=True) if names else [()] * len(batch)):
            at.setdefault(key, []).append(i)
        for key, places in at.items():
            own = batch.column("_rows")[places[0]].as_py() if held is None else held.value.get(key)
            if own:
                yield key, np.asarray(places), own

    return units, groups


class _Runs:
    """The runs of a batch of units, without an object a unit."""

    def __init__(self, batch: pa.RecordBatch, run: str):
        runs = batch.column("runs")
        self.unit = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
        flat = runs.flatten()
        series = flat.field("y")
        self.name, self.ends, self.first = np.asarray(flat.field(run).to_pylist(), object), series.offsets.to_numpy(), series.offsets.to_numpy()[0]
        self.y = series.flatten().to_numpy(zero_copy_only=False)

    def shares(self, places: np.ndarray, courses: dict) -> Iterator[tuple]:
        """For each run in `courses` (run: times by courses): the run, its units among `places`, and their shares of variance on each course."""
        mine = np.isin(self.unit, places)
        for name, m in courses.items():
            at = np.flatnonzero(mine & (self.name == name))
            if len(at):
                y = self.y[(self.ends[at] - self.first)[:, None] + np.arange(len(m))]
                energy = (y * y).sum(axis=1) - y.sum(axis=1) ** 2 / len(m)
                yield name, self.unit[at], (y @ m) ** 2 / np.maximum(energy, 2.0**-52)[:, None]


def _matrices(rows: list, run: str) -> tuple[dict, dict]:
    """Of course rows: times by courses of each run, and the rows of these courses, both in order of place."""
    own: dict = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        own.setdefault(r[run], []).append(r)
    return {name: np.stack([np.asarray(r["w"], float) for r in x], axis=1) for name, x in own.items()}, own


def _schema(spec: str) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in T.StructType.fromDDL(spec).fields])


def _table(schema: pa.Schema, keys: list[tuple], values: dict) -> pa.RecordBatch:
    """A batch whose first columns are the keys of each row; `values` names the others."""
    named = [n for n in schema.names if n not in values]
    return pa.RecordBatch.from_pydict({n: [k[i] for k in keys] for i, n in enumerate(named)} | values, schema=schema)


def _bins(shares: np.ndarray) -> np.ndarray:
    return np.minimum(np.sqrt(shares) * SHARE_BINS, SHARE_BINS - 1).astype(np.int64)


def _median_shares(units: DataFrame, courses: DataFrame, names: Sequence[str], run: str, margin: float) -> DataFrame:
    """keys, run, place, outside, inside: exact medians of the shares of units of low and of high weight on each course.

    One pass counts shares by bins, which tells the bins that hold the middle values and how many lie before them; another brings the values
    of these bins together, equal ones as one with their count.
    """
    each = [*names, run]
    beside, groups = _by_group(units, courses, names, [run, "place", "w"])
    keyed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for c in each for f in courses.schema.fields if f.name == c)
    one, two = f"{keyed}, place int, side int, counts array<bigint>", f"{keyed}, place int, side int, value array<double>, n array<bigint>"

    of_one, of_two = _schema(one), _schema(two)

    def sides(weight: np.ndarray) -> list[np.ndarray]:
        with np.errstate(invalid="ignore"):
            return [weight < 0.5 - margin / 2, weight > 0.5 + margin / 2]

    def weights(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("weight").cast(pa.float64()).to_numpy(zero_copy_only=False)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        known: dict[tuple, dict] = {}

        def rows() -> pa.RecordBatch:
            flat = [((*key,), p, s, c[s, p]) for key, c in held.items() for s in (0, 1) for p in range(c.shape[1])]
            return _table(of_one, [x[0] for x in flat], {"place": [x[1] for x in flat], "side": [x[2] for x in flat], "counts": [x[3] for x in flat]})

        for batch in batches:
            runs, weight = _Runs(batch, run), weights(batch)
            for key, places, own in groups(batch):
                matrices = known.get(key) or _matrices(own, run)[0]
                known = {**known, key: matrices} if len(known) < 64 else {key: matrices}
                for name, at, v in runs.shares(places, matrices):
                    bins, p = _bins(v), v.shape[1]
                    total = held.setdefault((*key, name), np.zeros((2, p, SHARE_BINS), np.int64))
                    for s, side in enumerate(sides(weight[at])):
                        total[s] += np.bincount((bins[side] + np.arange(p) * SHARE_BINS).ravel(), minlength=p * SHARE_BINS).reshape(p, SHARE_BINS)
            if sum(c.nbytes for c in held.values()) > BROADCAST_BYTES:  # many groups
                yield rows()
                held.clear()
        yield rows()

    def place_middle(key: tuple, table: pa.Table) -> pa.Table:
        counts = np.sum([np.asarray(c, np.int64) for c in table.column("counts").to_pylist()], axis=0)
        ends, n = counts.cumsum(), int(counts.sum())
        low, high = (int(np.searchsorted(ends, k, side="right")) if n else 0 for k in ((n - 1) // 2, n // 2))
        picked = table.slice(0, 1).select([*each, "place", "side"])
        for c, v in (("low", low), ("high", high), ("n", n), ("before", int(ends[low] - counts[low]))):
            picked = picked.append_column(c, pa.array([v], pa.int64()))
        return picked

    bounds = stored(beside.mapInArrow(count, one).groupBy(*each, "place", "side").applyInArrow(place_middle, f"{keyed}, place int, side int, low long, high long, n long, before long"), "physio-bounds")
    with_bounds = courses.select(*each, "place", "w").join(bounds.groupBy(*each, "place").agg(F.map_from_entries(F.collect_list(F.struct("side", F.struct("low", "high")))).alias("_b")), [*each, "place"], "left")
    with_bounds = with_bounds.select(*each, "place", "w", *(F.coalesce(F.try_element_at("_b", F.lit(s))[c], F.lit(-1)).alias(f"{c}{s}") for s in (0, 1) for c in ("low", "high")))
    beside_two, groups_two = _by_group(units, with_bounds, names, [run, "place", "w", "low0", "high0", "low1", "high1"])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        known: dict[tuple, tuple] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            flat = [(key, *np.unique(np.concatenate(v), return_counts=True)) for key, v in held.items()]
            return _table(of_two, [x[0][:-2] for x in flat], {"place": [x[0][-2] for x in flat], "side": [x[0][-1] for x in flat], "value": [x[1] for x in flat], "n": [x[2] for x in flat]})

        for batch in batches:
            runs, weight = _Runs(batch, run), weights(batch)
            for key, places, own in groups_two(batch):
                if key not in known:
                    matrices, listed = _matrices(own, run)
                    limits = {name: np.asarray([[r[f"{c}{s}"] for c in ("low", "high") for s in (0, 1)] for r in x]).T.reshape(2, 2, -1) for name, x in listed.items()}
                    known = {**known, key: (matrices, limits)} if len(known) < 64 else {key: (matrices, limits)}
                matrices, limits = known[key]
                for name, at, v in runs.shares(places, matrices):
                    bins = _bins(v)
                    for s, side in enumerate(sides(weight[at])):
                        low, high = limits[name][:, s]
                        values, mine = v[side], bins[side]
                        r, p = np.nonzero((mine == low) | (mine == high))
                        order = np.argsort(p, kind="stable")
                        r, p = r[order], p[order]
                        size += len(p)
                        starts = np.flatnonzero(np.diff(p, prepend=-1))
                        for a, b in zip(starts, np.append(starts, len(p))[1:], strict=True):  # none without a value in those bins
                            held.setdefault((*key, name, int(p[a]), s), []).append(values[r[a:b], p[a]])
            if size > HELD_VALUES:
                yield rows()
                held.clear()
                size = 0
        yield rows()

    def middle(key: tuple, table: pa.Table) -> pa.Table:
        before, n = table.column("before")[0].as_py(), table.column("_total")[0].as_py()
        value, count = (np.concatenate([np.asarray(x) for x in table.column(c).to_pylist()]) for c in ("value", "n"))
        order = np.argsort(value)
        ends = count[order].cumsum()
        low, high = (float(value[order][np.searchsorted(ends, k - before, side="right")]) for k in ((n - 1) // 2, n // 2))
        return table.slice(0, 1).select([*each, "place", "side"]).append_column("median", pa.array([0.5 * low + 0.5 * high]))

    near = beside_two.mapInArrow(pick, two).join(bounds.select(*each, "place", "side", "before", F.col("n").alias("_total")), [*each, "place", "side"])
    found = near.groupBy(*each, "place", "side").applyInArrow(middle, f"{keyed}, place int, side int, median double")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("median")))
    return found.groupBy(*each, "place").agg(side(0).alias("outside"), side(1).alias("inside"))


def _summed_shares(runs: _Runs, places: np.ndarray, matrices: dict, listed: dict, ks: list) -> dict:
    """For each run its units and the sums of shares over the courses of each k."""
    return {name: (at, v @ np.asarray([[float(r["k"] == k) for k in ks] for r in listed[name]])) for name, at, v in runs.shares(places, matrices)}


def _agreement(units: DataFrame, courses: DataFrame, names: Sequence[str], run: str) -> DataFrame:
    """keys, k, _i, _j, _r, _sa, _sb: for each pair of runs the correlation over units of the summed shares of the courses of a k, and the deviations of both."""
    beside, groups = _by_group(units, courses, names, [run, "k", "place", "w"])
    of = {f.name: f.dataType.simpleString() for f in courses.schema.fields}
    sums = ["n", "ma", "mb", "aa", "bb", "ab"]
    by = [*names, "k", "_i", "_j"]
    spec = ", ".join([*(f"`{c}` {of[c]}" for c in names), "k int", *(f"`{c}` {of[run]}" for c in ("_i", "_j")), *(f"{c} double" for c in sums)])

    schema = _schema(spec)

    def moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ma, mb = a.mean(axis=0), b.mean(axis=0)
        return np.stack([np.full(a.shape[1], float(len(a))), ma, mb, ((a - ma) ** 2).sum(axis=0), ((b - mb) ** 2).sum(axis=0), ((a - ma) * (b - mb)).sum(axis=0)])

    def merged(x: np.ndarray | None, y: np.ndarray) -> np.ndarray:
        if x is None:
            return y
        n, da, db = x[0] + y[0], y[1] - x[1], y[2] - x[2]
        f = x[0] * y[0] / n
        return np.stack([n, x[1] + da * y[0] / n, x[2] + db * y[0] / n, x[3] + y[3] + da * da * f, x[4] + y[4] + db * db * f, x[5] + y[5] + da * db * f])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            runs = _Runs(batch, run)
            for key, places, own in groups(batch):
                ks = sorted({r["k"] for r in own})
                maps = _summed_shares(runs, places, *_matrices(own, run), ks)
                for i, j in itertools.combinations(sorted(maps), 2):
                    _, a, b = np.intersect1d(maps[i][0], maps[j][0], return_indices=True)
                    if len(a):
                        before = held.get((*key, i, j))
                        held[(*key, i, j)] = (ks, merged(before and before[1], moments(maps[i][1][a], maps[j][1][b])))
        flat = [(key, k, *m[:, c]) for key, (ks, m) in held.items() for c, k in enumerate(ks)]
        values = {"k": [x[1] for x in flat], "_i": [x[0][-2] for x in flat], "_j": [x[0][-1] for x in flat]}
        yield _table(schema, [x[0] for x in flat], values | {c: [x[2 + i] for x in flat] for i, c in enumerate(sums)})

    def whole(table: pa.Table) -> pa.Table:
        rows, total = np.stack([table.column(c).to_numpy() for c in sums], axis=1), None
        for row in rows:
            total = merged(total, row[:, None])
        n, _, _, aa, bb, ab = total[:, 0]
        r = ab / math.sqrt(aa) / math.sqrt(bb) if aa > 0 and bb > 0 else None
        deviation = [math.sqrt(x / (n - 1)) if n > 1 else None for x in (aa, bb)]
        out = table.slice(0, 1).select(by)
        for c, v in zip(("_r", "_sa", "_sb"), (r, *deviation), strict=True):
            out = out.append_column(c, pa.array([v], pa.float64()))
        return out

    keyed = ", ".join(spec.split(", ")[: len(by)])
    return beside.mapInArrow(partial, spec).groupBy(*by).applyInArrow(whole, f"{keyed}, _r double, _sa double, _sb double")


def _reproducible_map(units: DataFrame, courses: DataFrame, agreement: DataFrame, names: Sequence[str], run: str) -> DataFrame:
    """keys, unit, z: mean over pairs of runs of the reproducible map of the courses; a pair that does not vary, or agrees in full, has none."""
    pairs = agreement.groupBy(*names).agg(F.collect_list(F.struct("_i", "_j", "_r", "_sa", "_sb")).alias("pairs"))
    beside, groups = _by_group(units, courses.join(pairs, list(names)), names, [run, "k", "place", "w", "pairs"])
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for c in [*names, "unit"] for f in units.schema.fields if f.name == c) + ", z double"

    def run_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = _Runs(batch, run)
            for _, places, own in groups(batch):
                maps = _summed_shares(runs, places, *_matrices(own, run), [own[0]["k"]])
                total, n, met = np.zeros(len(batch)), np.zeros(len(batch)), np.zeros(len(batch), bool)
                for p in own[0]["pairs"]:
                    if p["_i"] not in maps or p["_j"] not in maps:
                        continue
                    at, a, b = np.intersect1d(maps[p["_i"]][0], maps[p["_j"]][0], return_indices=True)
                    met[at] = True
                    if p["_r"] is not None and p["_r"] < 1 and p["_sa"] and p["_sb"]:
                        total[at] += (maps[p["_i"]][1][a, 0] / p["_sa"] + maps[p["_j"]][1][b, 0] / p["_sb"]) / math.sqrt(2) / math.sqrt(1 - p["_r"])
                        n[at] += 1
                at = np.flatnonzero(met)
                z = pa.array(total[at] / np.maximum(n[at], 1), mask=n[at] == 0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in [*names, "unit"]), z], names=[*names, "unit", "z"])

    return beside.mapInArrow(run_map, spec)


def physio_components(packed: DataFrame, tissue: DataFrame, keys: Sequence[str], run: str = "run", limit: int = 50, cutoff: float = 0.05, margin: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Physiological components of the runs (keys, run, unit, y) of each group; `tissue` (keys, unit, weight) is low where a unit is not
    neuronal.  Gives (summary, regressors, map).

    For every number k of principal components each run's autocorrelated courses are found, all in one pass over its Gram matrix.  A unit's share
    of variance on each of them is worked out anew wherever it is asked for, from the unit's stored series: there are some hundred to a run, and
    only counts, sums and the values about a median leave a task.  A course is kept if the median share of units under 0.5 - margin / 2 is not
    less than that of units over 0.5 + margin / 2.  The k wins whose maps of summed shares agree best over the pairs of runs; a k without kept
    courses in some run does not take part.  summary: keys, k, R, components (mean over runs); regressors: keys, run, component, w; map:
    keys, unit, z (mean over pairs of runs of the reproducible map).  A group of one run, or where no k takes part, gives no rows.
    """
    names, each = list(keys), [*keys, run]
    series = packed.groupBy(*names, "unit").agg(F.sort_array(F.collect_list(F.struct(F.col(run), "y"))).alias("runs"))
    units = stored(series.join(tissue.select(*names, "unit", "weight"), [*names, "unit"], "left"), "physio-units")  # all runs of a unit
    each_run = units.select(*names, "unit", F.explode("runs").alias("_r")).select(*names, F.col("_r")[run].alias(run), "unit", F.col("_r.y").alias("y"))
    grams = stored(G.gram(each_run, each), "physio-grams")
    shortest = grams.groupBy(*names).agg(F.min(F.size("sums")).alias("_t"))
    sized = grams.join(shortest, names)
    found = None
    for t in sorted(r["_t"] for r in shortest.select("_t").distinct().collect()):  # different lengths of series
        part = G.per_group(sized.filter(F.col("_t") == t), each, "k int, component int, w array<double>", lambda g, _s, _n, t=t: lagged_courses(g, largest_dimension(t, limit), cutoff))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = G.per_group(grams, each, "k int, component int, w array<double>", lambda g, _s, _n: lagged_courses(g, 3, cutoff))
    place = F.row_number().over(Window.partitionBy(*each).orderBy("k", "component")) - 1  # some hundreds a run
    courses = stored(found.withColumn("place", place), "physio-courses")

    own = [*each, "k", "component"]
    medians = _median_shares(units, courses, names, run, margin)
    kept = stored(courses.drop("w").join(medians, [*each, "place"]).filter((F.col("outside") >= F.col("inside")) & (F.col("outside") > 0)).select(*own, "place"), "physio-kept")
    runs = grams.groupBy(*names).agg(F.count(F.lit(1)).alias("_runs"))
    whole = kept.groupBy(*names, "k").agg(F.countDistinct(run).alias("_have"), F.count(F.lit(1)).alias("_kept")).join(runs, names).filter("_have = _runs AND _runs > 1")
    taking = kept.join(whole.select(*names, "k"), [*names, "k"]).select(*own, "place")
    agreement = stored(_agreement(units, courses.join(taking, [*own, "place"]), names, run), "physio-agreement")
    best = agreement.groupBy(*names, "k").agg(F.avg("_r").alias("R")).groupBy(*names).agg(F.max_by(F.struct("k", "R"), F.struct("R", -F.col("k"))).alias("_best")).select(*names, "_best.*")
    summary = stored(best.join(whole.select(*names, "k", (F.col("_kept") / F.col("_runs")).alias("components")), [*names, "k"]), "physio-summary")
    chosen = courses.join(kept, [*own, "place"]).join(summary.select(*names, "k"), [*names, "k"])
    regressors = chosen.select(*each, "component", "w")
    spm = _reproducible_map(units, chosen, agreement.join(summary.select(*names, "k"), [*names, "k"]), names, run)
    return summary, regressors, spm


def physio_denoise(packed: DataFrame, regressors: DataFrame, tissue: DataFrame, keys: Sequence[str], run: str = "run", weighted: bool = True, keep_mean: bool = False) -> DataFrame:
    """Takes the regressors of each run out and, if `weighted`, multiplies each unit by its tissue weight."""
    out = regress_out(packed, regressors, [*keys, run], keep_mean)
    return out.join(tissue.select(*keys, "unit", "weight"), [*keys, "unit"]).withColumn("y", F.transform("y", lambda v: v * F.col("weight"))).drop("weight") if weighted else out


def block_windows(series: DataFrame, onsets: DataFrame, window: int, blocks: int, keys: Sequence[str]) -> DataFrame:
    """keys, unit, block, lag, y: means over a block's onsets of the series at each lag less that at the onset.

    Onsets (keys, onset_t) whose window leaves the series do not count.  A block is an even part of the times that holds the middle of a window;
    if one would be empty, blocks are even runs of onsets, the last with the rest.  Groups with fewer onsets than blocks have no rows.
    With one block all onsets are in it.
    """
    names = list(keys)
    length = series.groupBy(*names).agg((F.max("t") + 1).alias("_t"))
    rank = F.row_number().over(Window.partitionBy(*names).orderBy("onset_t"))
    on = onsets.select(*names, F.col("onset_t").cast("long").alias("onset_t")).distinct().join(length, names).filter((F.col("onset_t") >= 0) & (F.col("onset_t") + window <= F.col("_t")))
    on = on.withColumn("_k", rank - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*names)))
    middle, part = F.col("onset_t") + 1 + window / 2, F.floor(F.col("_t") / blocks)
    at = F.floor((middle - 1) / part)
    inside = (middle > at * part + 1) & (middle < (at + 1) * part) & (at < blocks)
    on = on.withColumn("_even", F.when(inside, at)).withColumn("_filled", F.size(F.collect_set("_even").over(Window.partitionBy(*names))))
    run = F.least(F.floor(F.col("_k") / F.floor(F.col("_n") / blocks)), F.lit(blocks - 1))
    on = on.filter(F.col("_n") >= blocks).withColumn("block", F.lit(0).cast("long") if blocks == 1 else F.when(F.col("_filled") == blocks, F.col("_even")).otherwise(run)).filter("block IS NOT NULL")
    lags = on.select(*names, "onset_t", "block", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("lag"))
    first = series.select(*names, "unit", F.col("t").alias("onset_t"), F.col("y").alias("_first"))
    here = lags.withColumn("t", F.col("onset_t") + F.col("lag")).join(series.select(*names, "unit", "t", "y"), [*names, "t"]).join(first, [*names, "unit", "onset_t"])
    return here.groupBy(*names, "unit", "block", "lag").agg(F.avg(F.col("y") - F.col("_first")).alias("y"))


def packed_windows(windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a unit: its window averages by block and lag, centred within each block and scaled by the block's mean deviation over lags.
    Units that lack a lag of some block are left out."""
    by = [*keys, "unit", "block"]
    own = windows.groupBy(*by).agg(F.avg("y").alias("_m"), F.stddev_samp("y").alias("_s"))
    scale = own.groupBy(*keys, "block").agg(F.avg("_s").alias("_scale"))
    x = windows.join(own, by).join(scale, [*keys, "block"])
    x = x.withColumn("y", F.coalesce((F.col("y") - F.col("_m")) / F.nullif(F.col("_scale"), F.lit(0.0)), F.lit(0.0)))
    packed = x.groupBy(*keys, "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "lag", "y"))), lambda p: p["y"]).alias("y"))
    full = windows.groupBy(*keys).agg((F.countDistinct("block") * F.countDistinct("lag")).alias("_full"))
    return packed.join(full, list(keys)).filter(F.size("y") == F.col("_full")).drop("_full")


def _matched(reference: np.ndarray, own: np.ndarray, by_course: bool) -> tuple[list[int], list[int]]:
    """For each column of the reference the place and sign of its own: greatest correlation first (`own`: correlations, reference by own), or
    the most varied course first and its nearest, of either sign (`own`: courses)."""
    if not by_course:
        left, place, sign = np.abs(own).copy(), [0] * len(own), [1] * len(own)
        for _ in range(len(own)):
            i, j = np.unravel_index(left.argmax(), left.shape)
            place[i], sign[i] = int(j), int(np.sign(own[i, j]) or 1)
            left[i], left[:, j] = -1, -1
        return place, sign
    k = reference.shape[1]
    plus = np.stack([((own - reference[:, [i]]) ** 2).sum(axis=0) for i in range(k)])
    minus = np.stack([((own + reference[:, [i]]) ** 2).sum(axis=0) for i in range(k)])
    cost, place = np.minimum(plus, minus), [0] * k
    for i in np.argsort(-reference.std(axis=0), kind="stable"):
        place[i] = int(cost[i].argmin())
        cost[:, place[i]] = np.inf
    return place, [1 if plus[i, place[i]] <= minus[i, place[i]] else -1 for i in range(k)]


def event_variates(g: np.ndarray, sums: np.ndarray, n: int, lags: int, share: float = 0.5, by_course: bool = False, splits: list[list[int]] | None = None) -> list[tuple]:
    """(q, component, R, P, rms, course, w): canonical variates between components of window averages and indicators of the lag, for q
    components, scored over halves of the blocks.

    g is the Gram matrix over (block, lag).  R is the median over splits of the correlation of the halves' maps, P that of the mean posterior
    of the true lag of each half under the other's variates (the same for all components of a q), rms 1 - (median of the mean distance of a
    half's standardised variates to the other's lag means) / sqrt(2).  Halves are matched to the whole by their maps, or by their courses.
    course is the mean course over lags, w the time weights whose projection is the mean reproducible map over splits.
    """
    blocks = len(g) // lags
    if blocks < 4:
        return []
    values, vectors = G.eigen(g)
    first = min(len(values), math.floor(share * blocks * lags))
    most = min(first, math.floor(first / 2 + 0.5))
    to_map, q_all = vectors[:, :first] / np.sqrt(values[:first]), (vectors[:, :first] * np.sqrt(values[:first])).T.reshape(first, blocks, lags)

    def side(picked: list[int]) -> tuple[np.ndarray, np.ndarray]:
        own = q_all[:, picked].reshape(first, -1)
        own = own - own.mean(axis=1, keepdims=True)
        return own, np.linalg.svd(own)[0]

    def fit(scores: np.ndarray) -> np.ndarray:
        x = scores.T - scores.T.mean(axis=0)
        y = np.tile(np.eye(lags), (len(x) // lags, 1)) - 1 / lags
        return canonical(x.T @ x, y.T @ y, x.T @ y, len(x))[1][:, : lags - 1]

    by_lag = lambda v: v.reshape(-1, lags, v.shape[1])
    cov = lambda a, b: a.T @ g @ b - np.outer(a.T @ sums, sums @ b) / n
    standard = lambda v: (v - v.mean(axis=0)) / np.maximum(v.std(axis=0, ddof=1), 1e-300)

    def posterior(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        d = -0.5 * ((points[:, None, :] - centres[None]) ** 2).sum(axis=2)
        e = np.exp(d)
        total = e.sum(axis=1, keepdims=True)
        e = np.where(total > 0, e / np.where(total > 0, total, 1), 1 / lags)
        return e[np.arange(len(points)), np.arange(len(points)) % lags]

    whole, u_whole = side(list(range(blocks)))
    halves = []
    for split in splits or block_resamples(blocks):
        parts = [[b for b in range(blocks) if split[b] == h] for h in (1, 2)]
        halves.append([side(p) for p in parts])
    rows = []
    for q in range(1, most + 1):
        scores = (u_whole.T @ whole)[:q]
        a0 = fit(scores)
        ncap = a0.shape[1]
        maps0, course0 = to_map @ u_whole[:, :q] @ a0, by_lag(scores.T @ a0).mean(axis=0)
        r_all, rms_all, p_all, courses, weights = [], [], [], np.zeros((lags, ncap)), np.zeros((len(g), ncap))
        for pair in halves:
            fitted = []
            for own, u in pair:
                s = (u.T @ own)[:q]
                a = fit(s)
                a = np.hstack([a, np.zeros((q, ncap - a.shape[1]))]) if a.shape[1] < ncap else a[:, :ncap]
                maps, course = to_map @ u[:, :q] @ a, by_lag(s.T @ a).mean(axis=0)
                c = cov(maps0, maps)
                length = np.sqrt(np.maximum(np.outer(np.diag(cov(maps0, maps0)), np.diag(cov(maps, maps))), 1e-300))
                place, sign = _matched(course0, course if by_course else c / length, by_course)
                fitted.append((a[:, place] * sign, maps[:, place] * sign, course[:, place] * sign))
            (a1, m1, c1), (a2, m2, c2) = fitted
            s1, s2 = np.sqrt(np.maximum(np.diag(cov(m1, m1)), 1e-300) / (n - 1)), np.sqrt(np.maximum(np.diag(cov(m2, m2)), 1e-300) / (n - 1))
            r = np.diag(cov(m1, m2)) / (n - 1) / s1 / s2
            r_all.append(r)
            weights += (m1 / s1 + m2 / s2) / math.sqrt(2) / np.sqrt(np.maximum(1 - r, 1e-12))
            courses += (c1 + c2) / 2
            (own1, u1), (own2, u2) = pair
            in1, in2 = lambda own, u1=u1, a1=a1: (u1.T @ own)[:q].T @ a1, lambda own, u2=u2, a2=a2: (u2.T @ own)[:q].T @ a2
            p_all.append(np.concatenate([posterior(in1(own2), c1), posterior(in2(own1), c2)]).mean())
            far = [np.abs(by_lag(standard(at(other))) - by_lag(standard(at(own))).mean(axis=0)).reshape(-1, ncap) for at, own, other in ((in1, own1, own2), (in2, own2, own1))]
            rms_all.append(np.concatenate(far).mean(axis=0))
        r, rms, p = np.median(r_all, axis=0), (math.sqrt(2) - np.median(rms_all, axis=0)) / math.sqrt(2), float(np.median(p_all))
        rows += [(q, i + 1, float(r[i]), p, float(rms[i]), courses[:, i] / len(halves), weights[:, i] / len(halves)) for i in range(ncap)]
    return rows


VARIATES = "q int, component int, R double, P double, rms double, course array<double>, w array<double>"


def all_variates(packed: DataFrame, keys: Sequence[str], lags: int, share: float = 0.5, by_course: bool = False) -> DataFrame:
    """`event_variates` of each group of packed windows (at least four blocks; others have no rows)."""
    return stored(G.per_group(G.gram(packed, keys), keys, VARIATES, lambda g, s, n: event_variates(g, s, n, lags, share, by_course)), "event-variates")


def model_ercva(variates: DataFrame, keys: Sequence[str], reference: Sequence[float] | None = None) -> DataFrame:
    """One component: keys, q, component, R, P, dPR, rms, course, w of the q that comes nearest to perfect.  The component is each q's first, or
    with a reference course over lags the one whose course correlates best with it, of the sign that agrees."""
    names = list(keys)
    one = variates
    if reference is not None:
        ref = np.asarray(reference, float)

        def agree(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                c = [np.nan_to_num(np.corrcoef(np.asarray(v, float), ref)[0, 1]) for v in frame["course"]]
                turned = lambda column, c=c, frame=frame: [np.asarray(v, float) * (np.sign(x) or 1) for v, x in zip(frame[column], c, strict=True)]
                yield frame.assign(course=turned("course"), w=turned("w"), _c=np.abs(c))

        spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in variates.schema.fields)
        one = variates.mapInPandas(agree, f"{spec}, _c double")
        one = one.groupBy(*names, "q").agg(F.max_by(F.struct(*variates.columns), F.struct("_c", -F.col("component"))).alias("_x")).select("_x.*")
    else:
        one = one.filter("component = 1")
    d = -F.sqrt(F.pow(1 - F.col("R"), 2) + F.pow(1 - F.col("P"), 2))
    one = one.withColumn("dPR", d)
    return one.groupBy(*names).agg(F.max_by(F.struct("q", "component", "R", "P", "dPR", "rms", "course", "w"), F.struct("dPR", -F.col("q"))).alias("_x")).select(*names, "_x.*")


@F.pandas_udf(T.DoubleType())
def _upper_tail(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else float(1 - special.norm_cdf(abs(v))) for v in z])


def model_ercva_multi(packed: DataFrame, variates: DataFrame, keys: Sequence[str], lags: int, level: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(summary, map) of the components that have a unit which passes false-discovery control; of a q their squared R, summed, over lags - 1
    stands for R (-1 without any).  summary: keys, q, R, P, dPR, components (component, R, rms, course); map: keys, unit, component, z."""
    names = list(keys)
    each = [*names, "q", "component"]
    labelled = variates.withColumn("_label", F.row_number().over(Window.partitionBy(*names).orderBy("q", "component")))  # some tens a group
    z = G.back_project(packed, labelled.select(*names, F.col("_label").alias("component"), "w"), names).withColumnRenamed("component", "_label")
    z = stored(z.join(labelled.select(*each, "_label"), [*names, "_label"]).select(*each, "unit", F.col("value").alias("z")), "ercva-maps")
    passed = fdr(z.withColumn("p", _upper_tail("z")), "p", each, level).groupBy(*each).agg(F.max("passed").alias("_any"))
    kept = variates.join(passed.filter("_any = 1").select(*each), each)
    sums = variates.select(*names, "q", "P").distinct().join(kept.groupBy(*names, "q").agg((F.sum(F.col("R") * F.col("R")) / (lags - 1)).alias("_r"), F.sort_array(F.collect_list(F.struct("component", "R", "rms", "course"))).alias("components")), [*names, "q"], "left")
    sums = sums.withColumn("R", F.coalesce("_r", F.lit(-1.0))).withColumn("dPR", -F.sqrt(F.pow(1 - F.col("R"), 2) + F.pow(1 - F.col("P"), 2)))
    summary = stored(sums.groupBy(*names).agg(F.max_by(F.struct("q", "R", "P", "dPR", "components"), F.struct("dPR", -F.col("q"))).alias("_x")).select(*names, "_x.*"), "ercva-multi")
    chosen = summary.select(*names, "q", F.explode("components.component").alias("component"))
    return summary, z.join(chosen, each).select(*names, "unit", "component", "z")


def map_edges(packed: DataFrame, parts: DataFrame, gradients: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, component, edge: multiple correlation over units of the squared map of each component (`parts`: keys, component, w) with the squared
    gradients.  All maps of a unit are made together and enter the sums of their task; a row a group, component and task meets."""
    names, axes = list(keys), ["fx", "fy_", "fz"]
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema.fields if f.name in names)
    moments = f"{spec}, component int, n long, m array<double>, c array<double>"

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        w = np.stack(frame.sort_values("component")["w"].to_numpy(), axis=1)
        return pd.DataFrame([(*frame.iloc[0][names].tolist(), w.ravel())], columns=[*names, "m"])

    def merged(a: list | None, b: list) -> list:
        """Count, means and centred products (component by 4 by 4) of two sets of rows together."""
        if a is None:
            return b
        n, d = a[0] + b[0], b[1] - a[1]
        return [n, a[1] + d * (b[0] / n), a[2] + b[2] + d[:, :, None] * d[:, None, :] * (a[0] * b[0] / n)]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for frame in frames:
            for key, rows in frame.groupby(names, dropna=False):
                v, g = np.stack(rows["y"].to_numpy()) ** 2, rows[axes].to_numpy(float)
                mv, mg = v.mean(axis=0), g.mean(axis=0)
                v, g = v - mv, g - mg
                c = np.empty((v.shape[1], 4, 4))
                c[:, 0, 0], c[:, 1:, 1:] = (v * v).sum(axis=0), g.T @ g
                c[:, 0, 1:] = c[:, 1:, 0] = v.T @ g
                held[key] = merged(held.get(key), [len(v), np.hstack([mv[:, None], np.tile(mg, (len(mv), 1))]), c])
        yield pd.DataFrame([(*key, i + 1, n, m[i], c[i].ravel()) for key, (n, m, c) in held.items() for i in range(len(m))], columns=[*names, "component", "n", "m", "c"])

    def edge(frame: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for n, m, c in zip(frame["n"], frame["m"], frame["c"], strict=True):
            whole = merged(whole, [n, np.asarray(m, float)[None], np.asarray(c, float).reshape(1, 4, 4)])
        c = whole[2][0]
        scale = np.sqrt(np.diag(c))
        r = np.divide(c, np.outer(scale, scale), out=np.zeros((4, 4)), where=np.outer(scale, scale) > 0)
        np.fill_diagonal(r, 1.0)
        inner = np.linalg.det(r[1:, 1:])
        share = 1 - np.linalg.det(r) / inner if inner > 1e-12 else 0.0
        return pd.DataFrame([(*frame.iloc[0][[*names, "component"]].tolist(), float(np.sqrt(min(1.0, max(0.0, share)))))], columns=[*names, "component", "edge"])

    operators = parts.groupBy(*names).applyInPandas(together, f"{spec}, m array<double>")
    units = packed.select(*names, "unit", "y").join(gradients.select(*names, "unit", *(F.pow(a, 2).alias(a) for a in axes)), [*names, "unit"])
    sums = G.apply_operators(units, operators, names).mapInPandas(partial, moments)
    return sums.groupBy(*names, "component").applyInPandas(edge, f"{spec}, component int, edge double")


def component_spikes(packed: DataFrame, grams: DataFrame, gradients: DataFrame, keys: Sequence[str], share: float = 0.95) -> DataFrame:
    """keys, component, w, spike, edge, temporal, spatial of the components of each group.

    spike is the greatest squared distance of a course to the median of the times around it; edge the canonical correlation of the squared
    map with the squared gradients of the mean image (`gradients`: keys, unit, fx, fy_, fz).  temporal and spatial are 1 where these pass the
    95% quantile of a gamma distribution over the group's components (never with fewer than three).
    """
    names = list(keys)

    def use(g, _s, _n):
        values, vectors = G.eigen(G.centred(g))
        rows = []
        for i in range(G.components_for(values, share) if len(values) else 0):
            v = vectors[:, i]
            rows.append((i + 1, v, max(float((v[t] - np.median(np.delete(v[max(0, t - 7) : t + 8], min(t, 7)))) ** 2) for t in range(len(v)))))
        return rows

    parts = stored(G.per_group(grams, names, "component int, w array<double>, spike double", use), "spike-components")
    edges = map_edges(packed, parts, gradients, names)
    both = parts.join(edges, [*names, "component"], "left").fillna({"edge": 0.0})
    for value, flag in (("spike", "temporal"), ("edge", "spatial")):
        both = G.gamma_threshold(both, value, names).withColumn(flag, ((F.col(value) > F.col("threshold"))).cast("int")).drop("p", "threshold")
    enough = F.count(F.lit(1)).over(Window.partitionBy(*names)) >= 3
    return both.withColumns({c: F.when(enough, F.col(c)).otherwise(0) for c in ("temporal", "spatial")})


def component_spike_filter(packed: DataFrame, spikes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Takes the flagged components of `component_spikes` out of their group's units; unit means stay."""
    return regress_out(packed, spikes.filter("temporal = 1 OR spatial = 1"), keys, keep_mean=True)
