"""Series of many units in long form (keys, unit, t, y): filters, centring, norms, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_packed(series: DataFrame, keys: Sequence[str], t: str = "t", y: str = "y") -> DataFrame:
    """One row a unit with its values in order of t."""
    return series.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(t, y))), lambda p: p[y]).alias(y))


def to_long(packed: DataFrame, keys: Sequence[str], t: str = "t", y: str = "y") -> DataFrame:
    return packed.select(*keys, F.posexplode(y).alias(t, y))


def drop_scans(series: DataFrame, first: int, last: int, keys: Sequence[str]) -> DataFrame:
    """Keeps [first, n - last - 1] of each run and counts t from 0 again."""
    n = F.max("t").over(Window.partitionBy(*keys)) + 1
    return series.withColumn("_n", n).filter((F.col("t") >= first) & (F.col("t") <= F.col("_n") - last - 1)).withColumn("t", F.col("t") - first).drop("_n")


def mask_gather(series: DataFrame, mask: DataFrame, on: Sequence[str]) -> DataFrame:
    return series.join(mask.select(*on), list(on), "left_semi")


def mask_scatter(grid: DataFrame, values: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Values on the full grid, 0 where there is none."""
    return grid.join(values, list(on), "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def center_units(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series.withColumn("y", F.col("y") - F.avg("y").over(Window.partitionBy(*keys)))


def zscore(table: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """(x - mean) / sample deviation inside each group; null where there is no spread."""
    w = Window.partitionBy(*keys)
    return table.withColumn(value, (F.col(value) - F.avg(value).over(w)) / F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)))


def variance_normalise(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Divides each unit by its sample deviation; units without spread become null."""
    return series.withColumn("y", F.col("y") / F.nullif(F.stddev_samp("y").over(Window.partitionBy(*keys)), F.lit(0.0)))


def unit_norm(table: DataFrame, value: str, keys: Sequence[str], centred: bool = False) -> DataFrame:
    """Scales each group's vector to length 1, optionally after centring."""
    w = Window.partitionBy(*keys)
    base = table.withColumn(value, F.col(value) - F.avg(value).over(w)) if centred else table
    return base.withColumn(value, F.col(value) / F.nullif(F.sqrt(F.sum(F.col(value) * F.col(value)).over(w)), F.lit(0.0)))


def finite_guard(table: DataFrame, value: str, instead: float = 0.0) -> DataFrame:
    """Replaces null, NaN and infinite values."""
    x = F.col(value)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return table.withColumn(value, F.when(bad, instead).otherwise(x))


def drop_constant_units(series: DataFrame, unit: Sequence[str], split: str) -> DataFrame:
    """Drops units without variance in any split."""
    spread = series.groupBy(*unit, split).agg(F.stddev_samp("y").alias("s")).groupBy(*unit).agg(F.min(F.coalesce("s", F.lit(0.0))).alias("s"))
    return series.join(spread.filter("s > 0").select(*unit), list(unit), "left_semi")


def spatial_weight(series: DataFrame, weights: DataFrame, on: Sequence[str], weight: str = "w", use: bool = True) -> DataFrame:
    """Multiplies each unit by its weight; `use=False` leaves the series as it is."""
    return series.join(weights.select(*on, weight), list(on)).withColumn("y", F.col("y") * F.col(weight)).drop(weight) if use else series


def keep_mean(series: DataFrame, means: DataFrame, on: Sequence[str]) -> DataFrame:
    """Adds unit means (`mean`) back."""
    return series.join(means, list(on)).withColumn("y", F.col("y") + F.col("mean")).drop("mean")


def split_half_time(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """half 1 for the first ceil(T/2) times (t from 0), else 2."""
    n = F.max("t").over(Window.partitionBy(*keys)) + 1
    return series.withColumn("half", F.when(F.col("t") < F.ceil(n / 2), 1).otherwise(2).cast("bigint"))


def concat_runs(series: DataFrame, run: str, keys: Sequence[str]) -> DataFrame:
    """Runs laid end to end: t plus the lengths of earlier runs."""
    lengths = series.groupBy(*keys, run).agg((F.max("t") + 1).alias("_len"))
    before = F.coalesce(F.sum("_len").over(Window.partitionBy(*keys).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return series.join(lengths.withColumn("_before", before).drop("_len"), [*keys, run]).withColumn("t", F.col("t") + F.col("_before")).drop("_before")


def temporal_mean_std(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    return series.groupBy(*keys).agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"))


def global_signal(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """z-scored mean over units for each t."""
    return zscore(series.groupBy(*keys, "t").agg(F.avg("y").alias("signal")), "signal", keys)


def detrend_linear(series: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Residual of a straight line over t."""
    w = Window.partitionBy(*keys)
    fit = series.withColumn("_a", F.regr_slope("y", "t").over(w)).withColumn("_b", F.regr_intercept("y", "t").over(w))
    return fit.withColumn("y", F.col("y") - F.col("_a") * F.col("t") - F.col("_b")).drop("_a", "_b")


def roi_regressor(series: DataFrame, roi: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over a region (unit, weight) of weighted series."""
    return series.join(roi, "unit").groupBy(*keys, "t").agg((F.sum(F.col("y") * F.col("weight")) / F.count(F.lit(1))).alias("signal"))


def event_window_average(series: DataFrame, onsets: DataFrame, window: int, keys: Sequence[str]) -> DataFrame:
    """Mean of each unit at each lag 0..window-1 after the onsets (keys, onset_t): an equality join on exploded times, not a range join."""
    lags = onsets.select(*keys, "onset_t", F.explode(F.sequence(F.lit(0), F.lit(window - 1))).alias("lag")).withColumn("t", F.col("onset_t") + F.col("lag"))
    return lags.join(series, [*keys, "t"]).groupBy(*dict.fromkeys([*keys, "unit"]), "lag").agg(F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
