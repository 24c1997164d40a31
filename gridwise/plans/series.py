"""Queries over series and grids, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwise.fixtures import fixture, lattice_means
from gridwise.operators import lattice as L
from gridwise.operators import series as S
from gridwise.operators.stats import rounded
from gridwise.shared import stored

U = ["subject", "unit"]
SD, LS = "WITH sd AS ({series_daily}) ", "WITH ls AS ({lattice_series}) "


def _sd(s, d):
    return fixture(s, d, "series_daily")


def _map(s, d):
    """Mean over time of each cell."""
    return lattice_means(s, d).withColumn("v", F.round("v", 4))


def _stored_map(s, d):
    return stored(_map(s, d), "map")  # read more than once


MAP = "WITH m AS (SELECT subject, unit, x, y_, z, round(avg(y), 4) AS v FROM ({lattice_series}) ls GROUP BY subject, unit, x, y_, z) "
SEED = MAP + ", seed AS (SELECT subject, x, y_, z FROM m WHERE v > 12)"


def _diff(axis, others):
    w = f"OVER (PARTITION BY subject, {others} ORDER BY {axis})"
    return f"round(CASE WHEN lag(v) {w} IS NULL AND lead(v) {w} IS NULL THEN 0 WHEN lag(v) {w} IS NULL THEN lead(v) {w} - v WHEN lead(v) {w} IS NULL THEN v - lag(v) {w} ELSE (lead(v) {w} - lag(v) {w}) / 2 END, 6) + 0 AS f{axis}"


def _weights(s, d):
    return _sd(s, d).select("unit").distinct().withColumn("w", 1.0 / (1 + F.col("unit") % 5))


def _scattered(m):
    return S.mask_scatter(m.select("subject", "unit"), m.filter("v > 5").select("subject", "unit", "v"), U, "v")


QUERIES = {
    "drop_scans": (lambda s, d: S.drop_scans(_sd(s, d), 2, 3, ["subject"]), SD + "SELECT subject, unit, t - 2 AS t, y FROM (SELECT *, max(t) OVER (PARTITION BY subject) + 1 AS n FROM sd) q WHERE t >= 2 AND t <= n - 3 - 1"),
    "mask_gather": (
        lambda s, d: S.mask_gather(_sd(s, d), fixture(s, d, "binary_maps").filter("b = 1"), U),
        "WITH sd AS ({series_daily}), bm AS ({binary_maps}) SELECT * FROM sd WHERE EXISTS (SELECT 1 FROM bm WHERE b = 1 AND bm.subject = sd.subject AND bm.unit = sd.unit)",
    ),
    "mask_scatter": (
        lambda s, d: _scattered(_stored_map(s, d)),
        MAP + "SELECT subject, unit, CASE WHEN v > 5 THEN v ELSE 0 END AS v FROM m",
    ),
    "center_units": (lambda s, d: rounded(S.center_units(_sd(s, d), U), "y"), SD + "SELECT subject, unit, t, round(y - avg(y) OVER (PARTITION BY subject, unit), 6) + 0 AS y FROM sd"),
    "zscore": (lambda s, d: rounded(S.zscore(_sd(s, d), "y", ["subject", "t"]), "y", digits=5), SD + "SELECT subject, unit, t, round((y - avg(y) OVER w) / nullif(stddev_samp(y) OVER w, 0), 5) + 0 AS y FROM sd WINDOW w AS (PARTITION BY subject, t)"),
    "variance_normalise": (lambda s, d: rounded(S.variance_normalise(_sd(s, d), U), "y", digits=5), SD + "SELECT subject, unit, t, round(y / nullif(stddev_samp(y) OVER (PARTITION BY subject, unit), 0), 5) + 0 AS y FROM sd"),
    "unit_norm": (lambda s, d: rounded(S.unit_norm(_sd(s, d), "y", U), "y"), SD + "SELECT subject, unit, t, round(y / nullif(sqrt(sum(y * y) OVER (PARTITION BY subject, unit)), 0), 6) + 0 AS y FROM sd"),
    "finite_guard": (
        lambda s, d: rounded(S.finite_guard(_sd(s, d).withColumn("v", F.nullif(F.col("y"), F.lit(0.0))).withColumn("v", 1 / F.col("v")), "v", 0.5), "v").select("subject", "unit", "t", "v"),
        SD + "SELECT subject, unit, t, round(CASE WHEN y = 0 THEN 0.5 ELSE 1 / y END, 6) AS v FROM sd",
    ),
    "drop_constant_units": (
        lambda s, d: S.drop_constant_units(S.split_half_time(_sd(s, d), ["subject"]), U, "half").select("subject", "unit").distinct(),
        SD + ", h AS (SELECT subject, unit, t < 15 AS half, stddev_samp(y) AS s FROM sd GROUP BY 1, 2, 3) SELECT subject, unit FROM h GROUP BY subject, unit HAVING min(coalesce(s, 0)) > 0",
    ),
    "spatial_weight": (lambda s, d: rounded(S.spatial_weight(_sd(s, d), _weights(s, d), ["unit"]), "y"), SD + "SELECT subject, unit, t, round(y * (1.0 / (1 + unit % 5)), 6) + 0 AS y FROM sd"),
    "keep_mean": (
        lambda s, d: rounded(S.keep_mean(S.detrend_linear(_sd(s, d), U), S.temporal_mean_std(_sd(s, d), U).drop("std"), U), "y"),
        SD + "SELECT subject, unit, t, round(y - regr_slope(y, t) OVER w * t - regr_intercept(y, t) OVER w + avg(y) OVER w, 6) + 0 AS y FROM sd WINDOW w AS (PARTITION BY subject, unit)",
    ),
    "split_half_time": (
        lambda s, d: S.split_half_time(_sd(s, d), ["subject"]).groupBy("subject", "half").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("mean")),
        SD + "SELECT subject, cast(CASE WHEN t < ceil(30 / 2.0) THEN 1 ELSE 2 END AS bigint) AS half, count(*) AS n, round(avg(y), 6) AS mean FROM sd GROUP BY 1, 2",
    ),
    "concat_runs": (
        lambda s, d: S.concat_runs(_sd(s, d).withColumn("run", F.floor(F.col("t") / 12)).withColumn("t", F.col("t") % 12), "run", ["subject"]),
        SD + "SELECT subject, unit, t, y, cast(floor(t / 12) AS bigint) AS run FROM sd",
    ),
    "temporal_mean_std": (lambda s, d: rounded(S.temporal_mean_std(_sd(s, d), U), "mean", "std"), SD + "SELECT subject, unit, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std FROM sd GROUP BY subject, unit"),
    "global_signal": (
        lambda s, d: rounded(S.global_signal(S.center_units(_sd(s, d), U), ["subject"]), "signal"),
        SD + ", c AS (SELECT subject, t, y - avg(y) OVER (PARTITION BY subject, unit) AS y FROM sd), g AS (SELECT subject, t, avg(y) AS v FROM c GROUP BY subject, t) SELECT subject, t, round((v - avg(v) OVER (PARTITION BY subject)) / stddev_samp(v) OVER (PARTITION BY subject), 6) + 0 AS signal FROM g",
    ),
    "detrend_linear": (lambda s, d: rounded(S.detrend_linear(_sd(s, d), U), "y"), SD + "SELECT subject, unit, t, round(y - regr_slope(y, t) OVER w * t - regr_intercept(y, t) OVER w, 6) + 0 AS y FROM sd WINDOW w AS (PARTITION BY subject, unit)"),
    "roi_regressor": (
        lambda s, d: rounded(S.roi_regressor(_sd(s, d), _weights(s, d).join(fixture(s, d, "binary_maps").filter("b = 1 AND subject = 'signup'"), "unit", "left_semi").withColumnRenamed("w", "weight"), ["subject"]), "signal"),
        SD + "SELECT subject, t, round(sum(y * (1.0 / (1 + unit % 5))) / count(*), 6) AS signal FROM sd WHERE unit IN (SELECT unit FROM ({binary_maps}) bm WHERE b = 1 AND subject = 'signup') GROUP BY subject, t",
    ),
    "event_window_average": (
        lambda s, d: rounded(S.event_window_average(_sd(s, d), fixture(s, d, "task_onsets").select("unit", "onset_t").distinct(), 4, ["unit"]), "y"),
        "WITH sd AS ({series_daily}), o AS (SELECT DISTINCT unit, onset_t FROM ({task_onsets}) k), l AS (SELECT unit, onset_t, lag FROM o, (VALUES (0), (1), (2), (3)) v(lag)) SELECT unit, lag, round(avg(y), 6) AS y, count(*) AS n FROM sd JOIN l USING (unit) WHERE sd.t = l.onset_t + l.lag GROUP BY unit, lag",
    ),
    "frame_collapse": (
        lambda s, d: S.to_packed(_sd(s, d), U).select("subject", "unit", F.size("y").cast("bigint").alias("n"), F.round(F.get("y", F.lit(0)), 6).alias("first"), F.round(F.element_at("y", -1), 6).alias("last")),
        SD + "SELECT subject, unit, count(*) AS n, round(min(CASE WHEN t = 0 THEN y END), 6) AS first, round(min(CASE WHEN t = 29 THEN y END), 6) AS last FROM sd GROUP BY subject, unit",
    ),
    "frame_expand": (lambda s, d: S.to_long(S.to_packed(_sd(s, d), U), U).withColumn("t", F.col("t").cast("bigint")), SD + "SELECT subject, unit, t, y FROM sd"),
    "lattice_gradient": (
        lambda s, d: rounded(L.lattice_gradient(_map(s, d), "v", ["subject"]), "fx", "fy_", "fz").select("subject", "unit", "fx", "fy_", "fz"),
        MAP + f"SELECT subject, unit, {_diff('x', 'y_, z')}, {_diff('y_', 'x, z')}, {_diff('z', 'x, y_')} FROM m",
    ),
    "lattice_dilate": (
        lambda s, d: L.lattice_dilate(_map(s, d).filter("v > 12").select("subject", "x", "y_", "z"), ["subject"], (8, 8)),
        SEED + " SELECT DISTINCT subject, x + dx AS x, y_ + dy AS y_, z FROM seed, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy) WHERE x + dx BETWEEN 0 AND 7 AND y_ + dy BETWEEN 0 AND 7",
    ),
    "lattice_crop": (lambda s, d: L.lattice_crop(_map(s, d).drop("unit"), {"x": 1, "y_": 2}, {"x": 6, "y_": 5}), MAP + "SELECT subject, x - 1 AS x, y_ - 2 AS y_, z, v FROM m WHERE x BETWEEN 1 AND 6 AND y_ BETWEEN 2 AND 5"),
    "lattice_pad": (
        lambda s, d: L.lattice_pad(_stored_map(s, d).drop("unit"), "v", ["subject"], "x", 1, 2),
        MAP + "SELECT subject, x + 1 AS x, y_, z, v FROM m UNION ALL SELECT DISTINCT subject, p, y_, z, 0 FROM m, (VALUES (0), (9), (10)) q(p)",
    ),
    "lattice_flip": (lambda s, d: L.lattice_flip(_stored_map(s, d).drop("unit"), ["subject"]), MAP + "SELECT subject, 7 - x AS x, y_, z, v FROM m"),
    "symmetric_template": (
        lambda s, d: rounded(L.symmetric_template(_map(s, d), "v", "subject"), "v"),
        MAP + ", a AS (SELECT x, y_, z, avg(v) AS v FROM m GROUP BY x, y_, z) SELECT a.x, a.y_, a.z, round((a.v + b.v) / 2, 6) AS v FROM a JOIN a b ON b.x = 7 - a.x AND b.y_ = a.y_ AND b.z = a.z",
    ),
    "lattice_smooth": (lambda s, d: rounded(L.lattice_smooth(_map(s, d), "v", ["subject"], 2.0), "v"), None),
    "slice_time_shift": (
        lambda s, d: rounded(L.slice_time_shift(fixture(s, d, "lattice_series"), ["subject", "unit"], (F.col("z") % 4) / 5.0).select("subject", "unit", "t", "y"), "y", digits=3),
        LS + ", o AS (SELECT subject, unit, t, y, (z % 4) / 5.0 AS s, coalesce(lead(y) OVER (PARTITION BY subject, unit ORDER BY t), y) AS a FROM ls) SELECT subject, unit, t, round(y + s * (a - y), 3) AS y FROM o",
    ),
}
