"""Statistical primitives over maps and tables of values; keys are column names throughout."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwise.functions import special


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Rounds columns; never gives a negative zero."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def tied_rank(df: DataFrame, value: str, keys: Sequence[str], out: str = "rank") -> DataFrame:
    """Ranks from 1 inside each group, ties sharing the average of their places."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0)


def midpoint_percentile(df: DataFrame, value: str, percent: Column, keys: Sequence[str], out: str) -> DataFrame:
    """One row a group: the percentile by the midpoint rule (the k-th of n values is percentile 100 (k - .5) / n), interpolated between
    and clamped beyond.  `percent` may use the group's columns."""
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = df.select(*keys, value, F.row_number().over(w).alias("_k"), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"), percent.alias("_p"))
    place = F.greatest(F.lit(1.0), F.least(F.col("_n") * 1.0, F.col("_p") * F.col("_n") / 100 + 0.5))
    near = ranked.withColumn("_at", place).withColumn("_w", F.greatest(F.lit(0.0), 1 - F.abs(F.col("_k") - F.col("_at"))))
    return near.filter("_w > 0").groupBy(*keys).agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias(out))


def correlation(one: str | Column, two: str | Column) -> Column:
    """Correlation of two columns in an aggregate, over rows that have both; null where one is constant (`corr` raises there)."""
    one, two = (F.col(c) if isinstance(c, str) else c for c in (one, two))
    one, two = F.when(two.isNotNull(), one), F.when(one.isNotNull(), two)
    return F.covar_pop(one, two) / F.nullif(F.sqrt(F.var_pop(one) * F.var_pop(two)), F.lit(0.0))


def rspm(df: DataFrame, one: str, two: str, keys: Sequence[str], keep_mean: bool = False) -> DataFrame:
    """Reproducibility of two maps: R (their correlation) and, for each row, z: the sum of the z-scored maps over the spread of
    their difference, which is sqrt(1 - R) times sqrt(2)/sqrt(2); with `keep_mean` the maps over their deviations stand for z-scores.  One aggregate
    row a group is joined to the rows."""
    parts = df.groupBy(*keys).agg(*(f(c).alias(f"_{n}{i}") for i, c in enumerate((one, two)) for n, f in (("m", F.avg), ("s", F.stddev_samp))), correlation(one, two).alias("R"))
    out = df.join(parts, list(keys)) if keys else df.crossJoin(F.broadcast(parts))  # one row
    score = lambda c, i: (F.col(c) - (F.lit(0.0) if keep_mean else F.col(f"_m{i}"))) / F.nullif(F.col(f"_s{i}"), F.lit(0.0))
    spread = F.sqrt(F.lit(2.0)) * F.sqrt(1 - F.col("R"))
    return out.withColumn("z", (score(one, 0) + score(two, 1)) / F.nullif(spread, F.lit(0.0))).drop("_m0", "_m1", "_s0", "_s1")


def distance_to_perfect(p: Column, r: Column) -> Column:
    return -F.sqrt(F.pow(1 - r, 2) + F.pow(1 - p, 2))


def fdr(df: DataFrame, p: str, keys: Sequence[str], q: float = 0.05, dependent: bool = False) -> DataFrame:
    """Benjamini-Hochberg (or, `dependent`, the approximate Benjamini-Yekutieli) control: adds `critical` (null if nothing passes) and
    `passed`.  As many of the smallest p as there are p[k]/k <= q/(n c) pass, with their ties.  Null and NaN p never do."""
    ok = F.col(p).isNotNull() & ~F.isnan(p)
    w = Window.partitionBy(*keys, ok)
    c = (F.log(F.col("_n")) + 0.5772 + 1 / F.col("_n")) if dependent else F.lit(1.0)
    out = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy(p)))
    out = out.withColumn("_r", F.sum((ok & (F.col(p) / F.col("_k") <= q / (F.col("_n") * c))).cast("int")).over(Window.partitionBy(*keys)))
    out = out.withColumn("critical", F.max(F.when(ok & (F.col("_k") == F.col("_r")), F.col(p))).over(Window.partitionBy(*keys)))
    return out.withColumn("passed", F.coalesce((ok & (F.col(p) <= F.col("critical"))).cast("int"), F.lit(0))).drop("_n", "_k", "_r")


def signed_rank(df: DataFrame, difference: str, keys: Sequence[str]) -> DataFrame:
    """Wilcoxon signed-rank test of a column of differences in each group: n (non-zero), w (ranks of positive ones), p (two-sided)."""
    ranked = tied_rank(df.filter(F.col(difference) != 0).withColumn("_size", F.abs(difference)), "_size", keys, "_rank")
    ties = ranked.groupBy(*keys, "_size").agg(F.count(F.lit(1)).alias("_t")).groupBy(*keys).agg(F.sum((F.pow("_t", 3) - F.col("_t")) / 2).alias("_ties"))
    sums = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(difference) > 0, F.col("_rank")).otherwise(0.0)).alias("w"), F.sort_array(F.collect_list("_rank")).alias("_ranks"))
    joined = df.select(*keys).distinct().join(sums.join(ties, list(keys)), list(keys), "left").fillna({"n": 0, "w": 0.0})

    @F.pandas_udf("double")
    def p(ranks: pd.Series, w: pd.Series, ties: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series([special.signed_rank_p(np.asarray(r if r is not None else [], float), b, 0.0 if pd.isna(t) else t) for r, b, t in zip(ranks, w, ties, strict=True)])

    return joined.withColumn("p", p("_ranks", "w", "_ties")).select(*keys, "n", "w", "p")


def friedman(df: DataFrame, value: str, treatment: str, block: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Friedman test over blocks: n_blocks, n_treatments, q, p and the critical difference of mean ranks.

    One block has no critical difference (null), one treatment neither that nor p."""
    ranked = tied_rank(df, value, [*keys, block], "_rank")
    means = ranked.groupBy(*keys, treatment).agg(F.avg("_rank").alias("_mean"), F.count(F.lit(1)).alias("_blocks"))
    sums = means.groupBy(*keys).agg(F.max("_blocks").alias("n_blocks"), F.count(F.lit(1)).alias("n_treatments"), F.sum(F.pow(F.col("_mean"), 2)).alias("_squares"), F.sum("_mean").alias("_sum"))
    s, n = F.col("n_treatments"), F.col("n_blocks")
    middle = (s + 1) / 2
    q = 12 * n / (s * (s + 1)) * (F.col("_squares") - 2 * middle * F.col("_sum") + s * middle * middle)

    # what the ranks vary within blocks, less what the treatments explain (q is that in units of s (s + 1) / 12), by degree of freedom
    freedom = F.nullif((n - 1) * (s - 1), F.lit(0))
    residual = F.greatest(F.lit(0.0), s * (s + 1) / 12 * (n * (s - 1) - q)) / freedom

    @F.pandas_udf("double")
    def p_value(q: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([1 - special.chi2_cdf(a, b - 1) if b > 1 else None for a, b in zip(q, s, strict=True)], dtype=float)

    @F.pandas_udf("double")
    def t_limit(freedom: pd.Series) -> pd.Series:
        return pd.Series([special.t_ppf(1 - alpha / 2, x) if x > 0 else None for x in freedom], dtype=float)

    least = t_limit(freedom) * F.sqrt(2 * residual / n)  # a difference of two means over n blocks
    return sums.select(*keys, "n_blocks", "n_treatments", q.alias("q"), p_value(q, s).alias("p"), least.alias("critical"))


def jaccard_pairs(df: DataFrame, item: str, unit: str, flag: str) -> DataFrame:
    """Overlap of every pair of binary columns (long form: item, unit, flag of 0 or 1); 0 where both are empty.

    Pairs meet on the units that both hold; sizes come from an aggregate each, so a pair costs its common units.
    """
    ones = df.filter(F.col(flag) == 1).select(item, unit)
    sizes = df.groupBy(item).agg(F.sum(flag).alias("size"))
    a, b = ones.select(F.col(item).alias("a"), unit), ones.select(F.col(item).alias("b"), unit)
    common = a.join(b, unit).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    names = sizes.select(F.col(item).alias("a"), F.col("size").alias("size_a")).join(sizes.select(F.col(item).alias("b"), F.col("size").alias("size_b")), F.col("a") < F.col("b"))
    joined = names.join(common, ["a", "b"], "left").fillna({"common": 0})
    union = F.col("size_a") + F.col("size_b") - F.col("common")
    return joined.select("a", "b", F.when(union > 0, F.col("common") / union).otherwise(0.0).alias("overlap"))


def leave_self_median(pairs: DataFrame, value: str = "overlap") -> DataFrame:
    """1 minus the median similarity of each item to all others, from pairs (a, b)."""
    both = pairs.select(F.col("a").alias("item"), value).union(pairs.select("b", value))
    return both.groupBy("item").agg((1 - F.percentile(value, F.lit(0.5))).alias("distance"))
