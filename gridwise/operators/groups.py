"""Group statistics for each unit, comparison of result sets, and label-control imaging."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwise.functions import special
from gridwise.operators.stats import correlation, fdr


@F.pandas_udf(T.DoubleType())
def t_two_tailed(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else 2 * (1 - special.t_cdf(abs(a), b)) for a, b in zip(t, dof, strict=True)])


@F.pandas_udf(T.DoubleType())
def f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else 1 - special.f_cdf(a, b, c) for a, b, c in zip(f, d1, d2, strict=True)])


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _keys(unit: str | Sequence[str]) -> list[str]:
    return [unit] if isinstance(unit, str) else list(unit)


def ttest_1sample(table: DataFrame, value: str, unit: str | Sequence[str]) -> DataFrame:
    """t, degrees of freedom and two-tailed p of each unit's mean against 0."""
    m = table.groupBy(*_keys(unit)).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), F.count(value).alias("n"))
    return m.select(*_keys(unit), _ratio(F.col("m"), F.col("s") / F.sqrt("n")).alias("t"), (F.col("n") - 1).alias("dof")).withColumn("p", t_two_tailed("t", "dof"))


def ttest_2sample(table: DataFrame, value: str, unit: str | Sequence[str], group: str, one, two) -> DataFrame:
    """Pooled t of group `two` minus group `one`."""
    at = lambda g: F.when(F.col(group) == g, F.col(value))
    m = table.groupBy(*_keys(unit)).agg(*(f(at(g)).alias(f"{n}{i}") for i, g in ((1, one), (2, two)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))))
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    t = _ratio(F.col("m2") - F.col("m1"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))))
    return m.select(*_keys(unit), t.alias("t"), (F.col("n1") + F.col("n2") - 2).alias("dof")).withColumn("p", t_two_tailed("t", "dof"))


def paired_differences(table: DataFrame, value: str, unit: str | Sequence[str], group: str, one, two, pair: str) -> DataFrame:
    """unit, pair and `_d`: group `two` minus group `one`, for pairs that have both."""
    d = table.groupBy(*_keys(unit), pair).agg(F.avg(F.when(F.col(group) == one, F.col(value))).alias("_1"), F.avg(F.when(F.col(group) == two, F.col(value))).alias("_2"))
    return d.filter("_1 IS NOT NULL AND _2 IS NOT NULL").withColumn("_d", F.col("_2") - F.col("_1"))


def ttest_paired(table: DataFrame, value: str, unit: str | Sequence[str], group: str, one, two, pair: str) -> DataFrame:
    """t of the differences two minus one over pairs that have both."""
    return ttest_1sample(paired_differences(table, value, unit, group, one, two, pair), "_d", unit)


#: Rows that meet at a time, groups of which a task holds sums (16 bytes for each resample) before it hands them on, and resamples
#: whose sums travel in one row.
RESAMPLED_ROWS, RESAMPLED_GROUPS, RESAMPLED_BLOCK = 2048, 4096, 50


def poisson_draws(hashes: np.ndarray, resamples: int) -> np.ndarray:
    """How often each sample (a row, by its hash) is drawn in each resample (a column): Poisson counts of mean 1."""
    chances = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 19)]))
    with np.errstate(over="ignore"):
        z = hashes.view(np.uint64)[:, None] + np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(chances, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right").astype(float)


def resampled_sums(table: DataFrame, value: str, keys: Sequence[str], sample: str, resamples: int, seed: int) -> DataFrame:
    """(keys, r, _s, _n): sum of the values and number of draws of each group in each resample; null values are left out.

    A task adds up its own rows by a product of their values with their samples' draws, so no row is repeated for a resample; the sums
    of all tasks meet by group and block of resamples.
    """
    rows = table.filter(F.col(value).isNotNull()).select(*keys, F.xxhash64(F.lit(seed), sample).alias("_h"), F.col(value).cast("double").alias("_v"))
    names, k = [*keys, "r", "_s", "_n"], len(keys)
    edges = [*range(0, resamples, RESAMPLED_BLOCK), resamples]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[tuple, int] = {}
        held = np.zeros((2, 0, resamples))
        kinds: list[pa.DataType] = []

        def sums() -> Iterator[pa.RecordBatch]:
            groups = list(index)
            for at in range(0, len(groups), 64):
                part = groups[at : at + 64]
                columns = [pa.array([g[i] for g in part], kind) for i, kind in enumerate(kinds)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    ends = pa.array(np.arange(0, len(part) * (b - a) + 1, b - a, dtype=np.int32))
                    packed = [pa.ListArray.from_arrays(ends, pa.array(x[at : at + len(part), a:b].ravel())) for x in held]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([a] * len(part), pa.int32()), *packed], names=names)

        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(k)]
            for at in range(0, batch.num_rows, RESAMPLED_ROWS):
                part = batch.slice(at, RESAMPLED_ROWS)
                if len(index) + part.num_rows > RESAMPLED_GROUPS:
                    yield from sums()
                    index, held = {}, np.zeros((2, 0, resamples))
                of_row = [index.setdefault(g, len(index)) for g in zip(*(part.column(i).to_pylist() for i in range(k)), strict=True)]
                if len(index) > held.shape[1]:
                    held = np.concatenate([held, np.zeros((2, len(index) - held.shape[1], resamples))], axis=1)
                groups, g = np.unique(of_row, return_inverse=True)
                hashes, h = np.unique(part.column(k).to_numpy(), return_inverse=True)
                weights = np.zeros((2, len(groups), len(hashes)))
                np.add.at(weights[0], (g, h), part.column(k + 1).to_numpy())
                np.add.at(weights[1], (g, h), 1.0)
                held[:, groups] += weights @ poisson_draws(hashes, resamples)
        yield from sums()

    def total(table: pa.Table) -> pa.Table:
        s, n = (table.column(c).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(axis=0) for c in ("_s", "_n"))
        first = pa.array([0] * len(s))
        return pa.table([*(table.column(i).take(first) for i in range(k)), pa.array(table.column("r")[0].as_py() + np.arange(len(s), dtype=np.int32)), pa.array(s), pa.array(n)], names=names)

    schema = lambda kind: T.StructType([*rows.schema.fields[:k], T.StructField("r", T.IntegerType()), T.StructField("_s", kind), T.StructField("_n", kind)])
    return rows.mapInArrow(run, schema(T.ArrayType(T.DoubleType()))).groupBy(*keys, "r").applyInArrow(total, schema(T.DoubleType()))


def _resampled_ratio(means: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ratio of the mean of the resampled values `m` to their deviation, and the smaller one-sided tail."""
    low = F.avg((F.col("m") < 0).cast("int"))
    return means.filter("m IS NOT NULL").groupBy(*keys).agg(_ratio(F.avg("m"), F.stddev_samp("m")).alias("ratio"), F.least(low, 1 - low).alias("p"))


def bootstrap_1sample(table: DataFrame, value: str, unit: str | Sequence[str], sample: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Ratio of mean to deviation of resampled means, and the smaller one-sided tail.

    Each sample is drawn a Poisson number of times in each resample (by a hash of both, so that every unit sees the same draws), which
    makes a resample a weighted sum; no sample is repeated as a row.
    """
    keys = _keys(unit)
    means = resampled_sums(table, value, keys, sample, resamples, seed).select(*keys, (F.col("_s") / F.nullif("_n", F.lit(0.0))).alias("m"))
    return _resampled_ratio(means, keys)


def bootstrap_2sample(table: DataFrame, value: str, unit: str | Sequence[str], sample: str, group: str, one, two, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """The same of resampled means of group `two` minus those of group `one`; the groups are drawn apart, also where they share samples."""
    keys = _keys(unit)
    own = table.filter((F.col(group) == one) | (F.col(group) == two)).withColumn("_sample", F.xxhash64(group, sample))
    sums = resampled_sums(own, value, [*keys, group], "_sample", resamples, seed)
    mean = lambda g: F.max(F.when(F.col(group) == g, F.col("_s") / F.nullif("_n", F.lit(0.0))))
    return _resampled_ratio(sums.groupBy(*keys, "r").agg((mean(two) - mean(one)).alias("m")), keys)


def bootstrap_paired(table: DataFrame, value: str, unit: str | Sequence[str], group: str, one, two, pair: str, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """The same of resampled mean differences two minus one over pairs that have both."""
    return bootstrap_1sample(paired_differences(table, value, unit, group, one, two, pair), "_d", unit, pair, resamples, seed)


#: Tests of `posthoc` by name.
POSTHOC = tuple(f"{test},{kind}" for test in ("ttest", "boots") for kind in ("1sample", "2sample", "paired"))


def posthoc(table: DataFrame, test: str, value: str, component: str, unit: str, sample: str, group: str | None = None, one=None, two=None, q: float = 0.05) -> DataFrame:
    """component, unit, raw, p, critical, passed, thresholded: the test that is named (one of POSTHOC) of each unit of each component,
    with its map as it is (`raw`: t or bootstrap ratio) and with 0 where false discovery control of the component does not let it pass.

    Paired tests take `sample` as the pair.  A unit without variance or with too few samples has null raw, p and thresholded, and never
    passes.  Raises ValueError for another name, or a test of two groups without them.
    """
    if test not in POSTHOC:
        raise ValueError(f"{test!r} is none of {', '.join(POSTHOC)}")
    family, kind = test.split(",")
    if kind != "1sample" and None in (group, one, two):
        raise ValueError(f"{test} needs a group column and two groups")
    at = [component, unit]
    if family == "ttest":
        out = ttest_1sample(table, value, at) if kind == "1sample" else ttest_2sample(table, value, at, group, one, two) if kind == "2sample" else ttest_paired(table, value, at, group, one, two, sample)
        out = out.select(*at, F.col("t").alias("raw"), "p")
    else:
        out = bootstrap_1sample(table, value, at, sample) if kind == "1sample" else bootstrap_2sample(table, value, at, sample, group, one, two) if kind == "2sample" else bootstrap_paired(table, value, at, group, one, two, sample)
        out = out.select(*at, F.col("ratio").alias("raw"), F.when(F.col("ratio").isNotNull(), F.col("p")).alias("p"))
    return fdr(out, "p", [component], q).withColumn("thresholded", F.when(F.col("passed") == 1, F.col("raw")).when(F.col("raw").isNotNull(), 0.0))


def anova_oneway(table: DataFrame, value: str, unit: str, group: str) -> DataFrame:
    """F, its degrees of freedom, p and omega squared of each unit over groups."""
    cells = table.groupBy(unit, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    total = cells.withColumn("_g", F.sum(F.col("n") * F.col("m")).over(Window.partitionBy(unit)) / F.sum("n").over(Window.partitionBy(unit)))
    sums = total.groupBy(unit).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("_g"), 2)).alias("ssb"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ssw"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    d1, d2 = F.col("k") - 1, F.col("n") - F.col("k")
    msw = F.col("ssw") / d2
    out = sums.select(unit, _ratio(F.col("ssb") / d1, msw).alias("F"), d1.alias("df1"), d2.alias("df2"), _ratio(F.col("ssb") - d1 * msw, F.col("ssb") + F.col("ssw") + msw).alias("omega2"))
    return out.withColumn("p", f_tail("F", "df1", "df2"))


def anova_repeated(table: DataFrame, value: str, unit: str, subject: str, time: str) -> DataFrame:
    """F and p of time with subjects as blocks (balanced tables: one value for each unit, subject and time)."""
    w = lambda *k: F.avg(value).over(Window.partitionBy(unit, *k))
    parts = table.withColumn("_g", w()).withColumn("_s", w(subject)).withColumn("_t", w(time))
    sums = parts.groupBy(unit).agg(F.sum(F.pow(F.col("_t") - F.col("_g"), 2)).alias("sst"), F.sum(F.pow(F.col(value) - F.col("_s") - F.col("_t") + F.col("_g"), 2)).alias("sse"), F.countDistinct(subject).alias("n"), F.countDistinct(time).alias("k"))
    d1 = F.col("k") - 1
    d2 = d1 * (F.col("n") - 1)
    return sums.select(unit, _ratio(F.col("sst") / d1, F.col("sse") / d2).alias("F"), d1.alias("df1"), d2.alias("df2")).withColumn("p", f_tail("F", "df1", "df2"))


def anova_repeated_groups(table: DataFrame, value: str, unit: str, group: str, subject: str, time: str) -> DataFrame:
    """F of time, group and group by time, with their degrees of freedom: subjects are nested in groups and are the error of group, residuals that
    of the others.  One value for each unit, subject and time; groups may differ in size.  One group has no f_g and f_gt (null)."""
    cells = {"_y": (), "_g": (group,), "_t": (time,), "_c": (group, time), "_s": (group, subject)}
    x = table
    for name, by in cells.items():
        x = x.join(table.groupBy(unit, *by).agg(F.avg(value).alias(name)), [unit, *by])
    square = lambda e: F.sum(F.pow(e, 2))
    c = F.col
    sums = x.groupBy(unit).agg(
        square(c("_g") - c("_y")).alias("g"), square(c("_s") - c("_g")).alias("s"), square(c("_t") - c("_y")).alias("t"), square(c("_c") - c("_g") - c("_t") + c("_y")).alias("gt"),
        square(c(value) - c("_c") - c("_s") + c("_g")).alias("r"), F.countDistinct(group).alias("ng"), F.countDistinct(group, subject).alias("ns"), F.countDistinct(time).alias("nt"),
    )
    several, dg, dt, ds = c("ng") > 1, c("ng") - 1, c("nt") - 1, c("ns") - c("ng")
    rest = F.nullif(c("r") / F.nullif(ds * dt, F.lit(0)), F.lit(0.0))
    f_g, f_gt = F.when(several, _ratio(c("g") / dg, c("s") / F.nullif(ds, F.lit(0)))), F.when(several, c("gt") / (dg * dt) / rest)
    return sums.select(unit, (c("t") / dt / rest).alias("f_t"), f_g.alias("f_g"), f_gt.alias("f_gt"), dt.alias("df_t"), dg.alias("df_g"), ds.alias("df_s"), (ds * dt).alias("df_r"))


def with_tails(anova: DataFrame) -> DataFrame:
    """Adds p_t, p_g and p_gt to `anova_repeated_groups`."""
    return anova.withColumns({"p_t": f_tail("f_t", "df_t", "df_r"), "p_g": f_tail("f_g", "df_g", "df_s"), "p_gt": f_tail("f_gt", F.col("df_g") * F.col("df_t"), "df_r")})


def anova_twoway(table: DataFrame, value: str, unit: str, a: str, b: str) -> DataFrame:
    """F of both factors and their interaction from cell and margin means (balanced or nearly so), with p."""
    w = lambda *k: F.avg(value).over(Window.partitionBy(unit, *k))
    parts = table.withColumn("_g", w()).withColumn("_a", w(a)).withColumn("_b", w(b)).withColumn("_c", w(a, b))
    square = lambda e: F.sum(F.pow(e, 2))
    sums = parts.groupBy(unit).agg(
        square(F.col("_a") - F.col("_g")).alias("ssa"), square(F.col("_b") - F.col("_g")).alias("ssb"), square(F.col("_c") - F.col("_a") - F.col("_b") + F.col("_g")).alias("ssi"), square(F.col(value) - F.col("_c")).alias("sse"),
        F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"), F.count(F.lit(1)).alias("n"),
    )
    d2 = F.col("n") - F.col("ka") * F.col("kb")
    mse = F.col("sse") / d2
    da, db = F.col("ka") - 1, F.col("kb") - 1
    out = sums.select(unit, _ratio(F.col("ssa") / da, mse).alias("f_a"), _ratio(F.col("ssb") / db, mse).alias("f_b"), _ratio(F.col("ssi") / (da * db), mse).alias("f_ab"), da.alias("da"), db.alias("db"), (da * db).alias("dab"), d2.alias("d2"))
    return out.withColumn("p_a", f_tail("f_a", "da", "d2")).withColumn("p_b", f_tail("f_b", "db", "d2")).withColumn("p_ab", f_tail("f_ab", "dab", "d2")).drop("da", "db", "dab", "d2")


def group_map_stats(maps: DataFrame, value: str, unit: str) -> DataFrame:
    return maps.groupBy(unit).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg((F.col(value) > 0).cast("int")).alias("fraction"))


def map_similarity(maps: DataFrame, item: str, unit: str, value: str) -> DataFrame:
    """Correlation of every pair of maps over the units both have."""
    a, b = maps.select(F.col(item).alias("a"), unit, F.col(value).alias("_x")), maps.select(F.col(item).alias("b"), unit, F.col(value).alias("_y"))
    return a.join(b, unit).filter("a < b").groupBy("a", "b").agg(correlation("_x", "_y").alias("r"))


def metric_distance(metrics: DataFrame, item: str, values: Sequence[str]) -> DataFrame:
    """Euclidean distance of every pair of items in z-scored metrics (means over other keys)."""
    means = metrics.groupBy(item).agg(*(F.avg(v).alias(v) for v in values))
    spread = means.agg(*(x for v in values for x in (F.avg(v).alias(f"m_{v}"), F.stddev_samp(v).alias(f"s_{v}"))))  # one row
    z = means.crossJoin(F.broadcast(spread)).select(item, *(_ratio(F.col(v) - F.col(f"m_{v}"), F.col(f"s_{v}")).alias(v) for v in values))
    a, b = z.toDF("a", *(f"a_{v}" for v in values)), z.toDF("b", *(f"b_{v}" for v in values))
    d = sum((F.pow(F.coalesce(F.col(f"a_{v}") - F.col(f"b_{v}"), F.lit(0.0)), 2) for v in values), F.lit(0.0))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.sqrt(d).alias("distance"))


def step_influence(distances: DataFrame, pipelines: DataFrame, steps: Sequence[str]) -> DataFrame:
    """For each step, the mean distance of pairs of pipelines that differ in it, scaled to 0..1 over all pairs."""
    low, high = F.min("distance").over(Window.partitionBy()), F.max("distance").over(Window.partitionBy())
    scaled = distances.withColumn("distance", _ratio(F.col("distance") - low, high - low))
    x = scaled.join(pipelines.toDF("a", *(f"a_{s}" for s in steps)), "a").join(pipelines.toDF("b", *(f"b_{s}" for s in steps)), "b")
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("step"), (F.col(f"a_{s}") != F.col(f"b_{s}")).alias("differs")) for s in steps)))
    return x.select("distance", each.alias("e")).filter("e.differs").groupBy("e.step").agg(F.avg("distance").alias("influence"), F.count(F.lit(1)).alias("pairs"))


def compare_consistency(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one of two result sets has."""
    left = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    right = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, list(keys), "full_outer")
    return both.filter("_a IS NULL OR _b IS NULL").select(*keys, F.when(F.col("_a").isNull(), "second").otherwise("first").alias("only_in"))


def compare_all(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """For each metric: rows in both, rows that differ by more than the tolerance, and the greatest difference."""
    joined = a.select(*keys, *(F.col(v).alias(f"a_{v}") for v in values)).join(b.select(*keys, *(F.col(v).alias(f"b_{v}") for v in values)), list(keys))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")).alias("d")) for v in values)))
    return joined.select(each.alias("e")).groupBy("e.metric").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("e.d") > tolerance).cast("bigint")).alias("changed"), F.max("e.d").alias("greatest"))


def compare_optima(a: DataFrame, b: DataFrame, keys: Sequence[str], choice: str) -> DataFrame:
    """Rows whose choice differs."""
    x = a.select(*keys, F.col(choice).alias("first")).join(b.select(*keys, F.col(choice).alias("second")), list(keys))
    return x.filter(~F.col("first").eqNullSafe(F.col("second")))


def compare_scorecard(checks: DataFrame, run: str, passed: str) -> DataFrame:
    """'n/m' and OK where all checks of a run passed."""
    n, m = F.sum(passed), F.count(F.lit(1))
    return checks.groupBy(run).agg(F.concat(n.cast("string"), F.lit("/"), m.cast("string"), F.when(n == m, " [OK]").otherwise("")).alias("score"))


def perfusion_pairs(frames: DataFrame) -> DataFrame:
    """Simple difference: for each pair of frames (control even, label odd) control minus label, and their mean."""
    pair = F.floor(F.col("t") / 2)
    at = lambda k: F.max(F.when(F.col("t") % 2 == k, F.col("y")))
    p = frames.groupBy("unit", pair.alias("pair")).agg(at(0).alias("_c"), at(1).alias("_l")).filter("_c IS NOT NULL AND _l IS NOT NULL")
    return p.select("unit", "pair", (F.col("_c") - F.col("_l")).alias("perfusion"), ((F.col("_c") + F.col("_l")) / 2).alias("bold"))


def perfusion_pairs_packed(packed: DataFrame) -> DataFrame:
    """`perfusion_pairs` of packed frames (unit, times, y): the packed rows with `pairs`, (pair, c, l) in order, made in place."""
    time = lambda i: F.get("times", i)
    next_to = lambda i: (time(i) % 2 == 0) & (time(i + 1) % 2 == 1) & (time(i + 1) == time(i) + 1)
    places = F.when(F.size("times") > 1, F.filter(F.sequence(F.lit(0), F.size("times") - 2), next_to)).otherwise(F.array().cast("array<int>"))
    return packed.withColumn("pairs", F.transform(places, lambda i: F.struct(F.floor(time(i) / 2).alias("pair"), F.get("y", i).alias("c"), F.get("y", i + 1).alias("l"))))


def perfusion_rows(pairs: DataFrame) -> DataFrame:
    """unit, pair, perfusion and bold of packed pairs."""
    p = pairs.select("unit", F.explode("pairs").alias("_p"))
    return p.select("unit", "_p.pair", (F.col("_p.c") - F.col("_p.l")).alias("perfusion"), ((F.col("_p.c") + F.col("_p.l")) / 2).alias("bold"))


def perfusion_surround(frames: DataFrame) -> DataFrame:
    """Each label frame against the mean of the control frames beside it (one at the ends)."""
    w = Window.partitionBy("unit").orderBy("t")
    near = frames.withColumn("_a", F.lag("y").over(w)).withColumn("_b", F.lead("y").over(w)).filter("t % 2 = 1")
    control = (F.coalesce("_a", "_b") + F.coalesce("_b", "_a")) / 2
    return near.select("unit", F.floor(F.col("t") / 2).alias("pair"), (control - F.col("y")).alias("perfusion"), ((control + F.col("y")) / 2).alias("bold"))


def perfusion_sinc(frames: DataFrame) -> DataFrame:
    """Each label frame against the control at its time by six-point sinc interpolation of control frames; end controls repeat."""
    controls = frames.filter("t % 2 = 0").withColumn("pair", F.floor(F.col("t") / 2))
    w = Window.partitionBy("unit").orderBy("pair")
    whole = Window.partitionBy("unit")
    first, last = F.min_by("y", "pair").over(whole), F.max_by("y", "pair").over(whole)
    import math

    at = lambda k: F.coalesce(F.lag("y", -k).over(w) if k < 0 else F.lead("y", k).over(w), first if k < 0 else last)
    weights = {k: math.sin(math.pi * (0.5 - k)) / (math.pi * (0.5 - k)) for k in range(-2, 4)}
    control = sum((at(k) * v for k, v in weights.items()), F.lit(0.0)) / sum(weights.values())
    c = controls.select("unit", "pair", control.alias("_c"))
    labels = frames.filter("t % 2 = 1").select("unit", F.floor(F.col("t") / 2).alias("pair"), F.col("y").alias("_l"))
    return c.join(labels, ["unit", "pair"]).select("unit", "pair", (F.col("_c") - F.col("_l")).alias("perfusion"), ((F.col("_c") + F.col("_l")) / 2).alias("bold"))


def perfusion_order_check(frames: DataFrame) -> DataFrame:
    """Whether odd frames are brighter than even ones in the median unit: labels come first then."""
    d = frames.groupBy("unit").agg((F.avg(F.when(F.col("t") % 2 == 1, F.col("y"))) - F.avg(F.when(F.col("t") % 2 == 0, F.col("y")))).alias("d"))
    return d.agg(F.percentile("d", F.lit(0.5)).alias("median_difference")).withColumn("label_first", (F.col("median_difference") > 0).cast("bigint"))


def perfusion_cbf(perfusion: DataFrame, m0: DataFrame, slice_time: float = 0.05, ti1: float = 0.7, ti2: float = 1.8, t1: float = 1.66, efficiency: float = 0.95, blood: float = 0.9, decay: float = 1.0) -> DataFrame:
    """Mean flow of each unit (`m0`: unit, z, m0)."""
    return _flow(perfusion.groupBy("unit").agg(F.avg("perfusion").alias("_d")).join(m0, "unit"), slice_time, ti1, ti2, t1, efficiency, blood, decay)


def perfusion_cbf_packed(pairs: DataFrame, slice_time: float = 0.05, ti1: float = 0.7, ti2: float = 1.8, t1: float = 1.66, efficiency: float = 0.95, blood: float = 0.9, decay: float = 1.0) -> DataFrame:
    """`perfusion_cbf` of packed pairs (unit, z, m0, pairs), a row a unit at a time; units without a pair have no row."""
    mean = F.aggregate("pairs", F.lit(0.0), lambda s, p: s + (p["c"] - p["l"])) / F.size("pairs")
    return _flow(pairs.filter("unit IS NOT NULL AND size(pairs) > 0").withColumn("_d", mean), slice_time, ti1, ti2, t1, efficiency, blood, decay)


def _flow(p: DataFrame, slice_time: float, ti1: float, ti2: float, t1: float, efficiency: float, blood: float, decay: float) -> DataFrame:
    flow = 6e6 * blood * F.col("_d") / (2 * F.col("m0") * F.exp(-(ti2 + F.col("z") * slice_time) / t1) * ti1 * efficiency * decay)
    return p.select("unit", flow.alias("cbf"))


def simple_mask(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units whose mean is over a fifth of the greatest mean."""
    m = series.groupBy(*keys, "unit").agg(F.avg("y").alias("mean"))
    top = m.groupBy(*keys).agg(F.max("mean").alias("_top"))
    return m.join(top, list(keys)).filter(F.col("mean") > 0.2 * F.col("_top")).select(*keys, "unit") if keys else m.crossJoin(F.broadcast(top)).filter(F.col("mean") > 0.2 * F.col("_top")).select("unit")
