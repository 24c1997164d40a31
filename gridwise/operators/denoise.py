"""Denoising in successive steps, motion parameters, and regression over several runs.

All steps of a chain act along time, so a chain is one T x T matrix a group.  It is solved from one row a group (the Gram matrix of the
weighted units, the course of the noise region, the regressors); the units are seen once more, to be multiplied by it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwise.operators import canonical as C
from gridwise.operators import design as D
from gridwise.operators import gram as G
from gridwise.operators import series as S


def by_parts(x: np.ndarray, cuts: Sequence[int], least: float = 0.0) -> np.ndarray:
    """Each column once for each stretch of time between cuts, 0 outside it; those that vary less than `least` inside a stretch go."""
    out = [np.zeros((len(x), 0))]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        block = np.zeros(x.shape)
        block[a:b] = x[a:b]
        spread = x[a:b].std(axis=0, ddof=1) if b - a > 1 else np.zeros(x.shape[1])
        out.append(block[:, spread >= least])
    return np.hstack(out)


def remove_keeping(noise: np.ndarray, signal: np.ndarray) -> np.ndarray:
    """The T x T matrix that takes out what noise columns explain in a regression on noise and signal (y @ M): the part that
    only the signal explains stays.  Of columns that depend on each other the shortest coefficients are taken."""
    both = np.hstack([noise, signal])
    if not noise.shape[1]:
        return np.eye(len(both))
    return np.eye(len(both)) - np.linalg.pinv(both.T)[:, : noise.shape[1]] @ noise.T


def chain_operator(gram: np.ndarray, order: int, halves: bool, motion: np.ndarray, signal: np.ndarray, region: np.ndarray | None, physio: np.ndarray, first_component: bool) -> np.ndarray:
    """Product of the steps, in this order: drift and motion; the course of a noise region; the first component of the weighted units;
    physiological courses.  All but the last keep the signal.  Both the course and the component are those of the series as the steps before left
    them; with `halves`, every regressor but the physiological ones is one for each half, else the component's step takes the mean as well."""
    t = len(gram)
    cuts = [0, -(-t // 2), t] if halves and t > 1 else [0, t]
    signal = by_parts(signal, cuts, 1e-4 / t)
    drift = np.zeros((t, (order + 1) * (len(cuts) - 1)))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        drift[a:b, i * (order + 1) : (i + 1) * (order + 1)] = G.legendre(b - a, order)
    m = remove_keeping(np.hstack([by_parts(motion, cuts), drift]), signal)
    if region is not None:
        m = m @ remove_keeping(by_parts((region @ m)[:, None], cuts), signal)
    if first_component:
        left, courses = m.T @ gram @ m, np.zeros((t, 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            values, vectors = G.eigen(left[a:b, a:b])
            if len(values):
                courses[a:b] = vectors[:, :1]
        m = m @ remove_keeping(by_parts(courses, cuts) if halves else np.hstack([np.ones((t, 1)), courses]), signal)
    return m @ remove_keeping(physio, np.zeros((t, 0)))


def automatic_order(times: int, tr: float) -> int:
    """Drift polynomials for half a run of `times` scans, `tr` seconds apart."""
    return 1 + int(tr * (times / 2) // 150)


def region_course(packed: DataFrame, region: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, y: the mean over a region (unit, weight) of its weighted series; units of weight 0 or below, or null, are not in it."""
    at = packed.join(region.filter("weight > 0").select("unit", "weight"), "unit").select(*keys, "weight", F.posexplode("y").alias("t", "y"))
    return S.to_packed(at.groupBy(*keys, "t").agg((F.sum(F.col("y") * F.col("weight")) / F.sum("weight") / F.count(F.lit(1))).alias("y")), keys)


def chain_operators(
    packed: DataFrame, keys: Sequence[str], order: int, halves: bool = True, *, motion: DataFrame | None = None, signal: DataFrame | None = None, region: DataFrame | None = None,
    physio: DataFrame | None = None, first_component: bool = False, weights: DataFrame | None = None, tr: float = 1.0,
) -> DataFrame:
    """keys and m (T*T) of `chain_operator` for each group of packed units (keys, unit, y), for `gram.apply_operators`.

    `motion`, `signal` and `physio` are regressors (keys, k, y); a group without any has none.  `region` and `weights` are (unit, weight): the first
    component is that of the units times their weight, those without one left out.  An order of -1 is chosen by the length of the run.  An empty
    table gives an empty one."""
    names = list(keys)
    units = packed
    if weights is not None and first_component:
        scaled = F.transform("y", lambda v: v * F.col("weight"))
        units = packed.join(weights.select("unit", "weight"), "unit").withColumn("y", scaled)
    rows = G.gram(units, names)
    for label, table in (("motion", motion), ("signal", signal), ("physio", physio)):
        if table is not None:
            own = table.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "y"))), lambda r: r["y"]).alias(label))
            rows = rows.join(own, names, "left")
    if region is not None:
        rows = rows.join(region_course(packed, region, names).withColumnRenamed("y", "region"), names, "left")
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                t = len(row["sums"])
                columns = lambda label, row=row, t=t: np.stack([np.asarray(v, float) for v in row[label]], axis=1) if isinstance(row.get(label), (list, np.ndarray)) and len(row[label]) else np.zeros((t, 0))
                course = row.get("region")
                drift = automatic_order(t, tr) if order < 0 else order
                m = chain_operator(np.asarray(row["gram"], float).reshape(t, t), drift, halves, columns("motion"), columns("signal"), np.asarray(course, float) if isinstance(course, (list, np.ndarray)) else None, columns("physio"), first_component)
                out.append((*(row[n] for n in names), m.ravel()))
            yield pd.DataFrame(out, columns=[*names, "m"])

    return rows.mapInPandas(run, f"{spec}, m array<double>")


def motion_components(parameters: DataFrame, keys: Sequence[str], share: float = 0.85) -> DataFrame:
    """keys, component (from 1), t, y: components of motion parameters (keys, t, k, y; every k at each t), scaled by their singular values: one
    more than those whose shares of the variance, added up, do not pass `share`.  The loading that is largest in size is positive.

    Only sums of products of the parameters meet; times are then projected where they lie.  A group whose parameters never change has none."""
    names = list(keys)
    means = parameters.groupBy(*names, "k").agg(F.avg("y").alias("_mean"))
    wide = parameters.join(means, [*names, "k"]).groupBy(*names, "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", (F.col("y") - F.col("_mean")).alias("y")))), lambda r: r["y"]).alias("_p"))
    own = wide.select(*names, F.posexplode("_p").alias("_i", "_a"), "_p").select(*names, "_i", "_a", F.posexplode("_p").alias("_j", "_b"))
    products = own.groupBy(*names, "_i", "_j").agg(F.sum(F.col("_a") * F.col("_b")).alias("_s"))
    table = products.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_i", "_j", "_s"))).alias("_g"))
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields if f.name in names)

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                n = int(round(len(row["_g"]) ** 0.5))
                values, vectors = G.eigen(np.asarray([r["_s"] for r in row["_g"]], float).reshape(n, n))
                if len(values):
                    many = min(len(values), int((np.cumsum(values) / values.sum() <= share).sum()) + 1)
                    out += [(*(row[k] for k in names), i + 1, vectors[:, i]) for i in range(many)]
            yield pd.DataFrame(out, columns=[*names, "component", "_v"])

    loadings = table.mapInPandas(run, f"{spec}, component int, _v array<double>")
    dot = F.aggregate(F.zip_with("_p", "_v", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return wide.join(loadings, names).select(*names, "component", "t", dot.alias("y"))


def joined_blocks(events: DataFrame, runs: DataFrame, keys: Sequence[str], tr: float, dropped: int) -> DataFrame:
    """Events (keys, run, onset_s, duration_s and further columns) as keys, those columns and t: the scans of the line of all runs (from 0) that are on.

    `runs`: keys, run, scans after `dropped` ones went.  Onsets before a run's first scan move there and shorten, durations end with their run.  A
    block is on from the scan that its onset lies in to its rounded length after it, both included, as far as its run's line goes."""
    before = F.coalesce(F.sum("scans").over(Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = runs.withColumns({"_before": before, "_all": F.sum("scans").over(Window.partitionBy(*keys))})
    rest = [c for c in events.columns if c not in (*keys, "run", "onset_s", "duration_s")]
    onset = F.col("onset_s") - dropped * tr
    start = F.greatest(onset, F.lit(0.0))
    lasts = F.least(onset + F.col("duration_s"), F.col("scans") * tr) - start
    x = events.join(placed, [*keys, "run"]).select(*keys, *rest, "_all", (F.col("_before") + F.greatest(F.ceil(start / tr), F.lit(1)) - 1).cast("bigint").alias("_first"), lasts.alias("_lasts"))
    end = F.least(F.col("_first") + F.round(F.col("_lasts") / tr), F.col("_all") - 1).cast("bigint")
    return x.filter("_lasts >= 0").withColumn("_end", end).filter("_first <= _end").select(*keys, *rest, F.explode(F.sequence("_first", "_end")).alias("t")).distinct()


def multirun_glm(series: DataFrame, events: DataFrame, keys: Sequence[str], tr: float, dropped: int = 0, censored: DataFrame | None = None) -> DataFrame:
    """keys, unit, cond, beta, t: regression of units on the responses to conditions, over all runs end to end, next to a constant and one
    column of censored times.

    `series`: keys, run, unit, t (from 0, dropped scans gone), y.  `events`: keys, run, cond, onset_s, duration_s, in seconds from the run's start
    with the dropped scans; `censored` the same without cond.  Conditions without any time in the runs have no rows."""
    names = list(keys)
    runs = series.groupBy(*names, "run").agg((F.max("t") + 1).alias("scans"))
    total = runs.groupBy(*names).agg(F.sum("scans").alias("scans"))
    on = joined_blocks(events.select(*names, "run", "cond", "onset_s", "duration_s"), runs, names, tr, dropped)
    longest = total.agg(F.max("scans")).first()[0] or 0
    response = D.hrf_convolve(on.withColumnRenamed("t", "sample"), [*names, "cond"], int(longest), tr).join(total, names).filter("sample < scans").select(*names, "cond", F.col("sample").alias("t"), "v")
    every = total.select(*names, "scans", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("scans") - 1)).alias("t"))
    conditions = response.groupBy(*names).agg(F.sort_array(F.collect_set("cond")).alias("_c")).select(*names, F.posexplode("_c").alias("_k", "cond")).select(*names, "cond", (F.col("_k") + 1).cast("bigint").alias("k"))
    columns = every.join(conditions, names).join(response, [*names, "cond", "t"], "left").select(*names, "k", "t", F.coalesce("v", F.lit(0.0)).alias("y"))
    if censored is not None:
        out = joined_blocks(censored.select(*names, "run", "onset_s", "duration_s"), runs, names, tr, dropped)
        marked = every.join(out.select(*names).distinct(), names).join(out.select(*names, "t", F.lit(1.0).alias("y")), [*names, "t"], "left")
        columns = columns.unionByName(marked.select(*names, F.lit(0).cast("bigint").alias("k"), "t", F.coalesce("y", F.lit(0.0)).alias("y")))
    packed = S.to_packed(S.concat_runs(series, "run", names), [*names, "unit"])
    fit = G.glm_fit(packed, S.to_packed(columns, [*names, "k"]), names, order=0)
    return fit.join(conditions, [*names, "k"]).select(*names, "unit", "cond", "beta", "t")


def task_motion_corr(response: DataFrame, components: DataFrame, conditions: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, r: canonical correlation between the responses to all conditions (keys, cond, t, v; absent times are 0) and the first motion component
    (keys, component, t, y).  0 where there is no response, or none that varies; groups without a component have no row."""
    first = components.filter("component = 1").select(*keys, "t", "y")
    names = {f"_c{i}": c for i, c in enumerate(conditions)}
    wide = response.groupBy(*keys, "t").agg(*(F.sum(F.when(F.col("cond") == c, F.col("v"))).alias(n) for n, c in names.items()))
    table = first.join(wide, [*keys, "t"], "left").fillna(0.0, list(names))
    found = C.canoncorr(table, list(names), ["y"], keys).filter("component = 1").select(*keys, "r")
    return first.select(*keys).distinct().join(found, list(keys), "left").select(*keys, F.coalesce("r", F.lit(0.0)).alias("r"))
