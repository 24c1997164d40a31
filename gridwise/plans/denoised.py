"""Queries of denoising chains, motion components and regressions over runs.  None fits SQL; tests/test_denoise.py holds them against formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwise.fixtures import fixture, in_spark
from gridwise.operators import denoise as N
from gridwise.operators import design as D
from gridwise.operators import gram as G
from gridwise.operators import series as S
from gridwise.operators.stats import rounded
from gridwise.plans.linear import K, _energy, _packed, _regressors

TR = 2.0
CONDITIONS = ["high", "rise"]
#: Six numbers of each kind of event and day, as motion parameters; days without events have 0.
MOTION = """SELECT s.subject, s.t, cast(v.k AS bigint) AS k, coalesce(CASE v.k WHEN 0 THEN a.n WHEN 1 THEN a.mean WHEN 2 THEN a.most WHEN 3 THEN a.least WHEN 4 THEN a.spread ELSE a.users END, 0e0) AS y
  FROM (SELECT DISTINCT subject, t FROM ({series_daily}) q) s CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) v(k)
  LEFT JOIN (SELECT event_type AS subject, cast(dayofyear(ts) - 1 AS bigint) AS t, count(*) * 1e0 AS n, avg(value) AS mean, max(value) AS most, min(value) AS least, coalesce(stddev_samp(value), 0e0) AS spread, count(DISTINCT user_id) * 1e0 AS users
    FROM {events} GROUP BY 1, 2) a ON a.subject = s.subject AND a.t = s.t"""
#: Days whose total is over the median of their kind, and days whose total is over the day before.
BLOCKS = """WITH d AS (SELECT subject, t, sum(y) AS y FROM ({series_daily}) q GROUP BY subject, t), m AS (SELECT *, median(y) OVER (PARTITION BY subject) AS mid, lag(y) OVER (PARTITION BY subject ORDER BY t) AS before, row_number() OVER (PARTITION BY subject ORDER BY y DESC, t) AS place FROM d)
  SELECT subject, 'high' AS cond, t AS onset_t FROM m WHERE y > mid UNION ALL SELECT subject, 'rise', t FROM m WHERE y > before UNION ALL SELECT subject, 'top', t FROM m WHERE place <= 3"""
#: Share of days on which a unit has any event, over all kinds; and the units of a region: those with more than the average total.
WEIGHTS = "SELECT unit, avg(CASE WHEN y <> 0 THEN 1e0 ELSE 0e0 END) AS weight FROM ({series_daily}) q GROUP BY unit"
REGION = "SELECT unit, total / mean - 1 AS weight FROM (SELECT unit, total, avg(total) OVER () AS mean FROM (SELECT unit, sum(y) AS total FROM ({series_daily}) q GROUP BY unit) u) v WHERE total > mean"


def _blocks(s, d):
    return in_spark(s, d, BLOCKS)


def _motion(s, d):
    return N.motion_components(in_spark(s, d, MOTION), K)


def _response(s, d):
    """Response of each kind's two conditions, a value a day."""
    events = _blocks(s, d).filter(F.col("cond").isin(CONDITIONS)).withColumn("duration", F.lit(1))
    on = D.design_block(D.onset_normalise(events, TR * 1000, 0), ["subject", "cond"], TR * 1000, 30)
    per_scan = int(TR * 10)
    return D.design_finish(D.hrf_response(on, ["subject", "cond"], 30 * per_scan, 0.1), ["subject", "cond"], 30 * per_scan, per_scan).withColumnRenamed("scan", "t")


def _columns(df, number):
    """Packed regressors (subject, k, y) of a long table (subject, t, k or what gives it, v)."""
    return S.to_packed(df.select("subject", number.cast("bigint").alias("k"), "t", F.col(df.columns[-1]).alias("y")), ["subject", "k"])


def _chain(s, d, **parts):
    return G.apply_operators(_packed(s, d), N.chain_operators(_packed(s, d), K, tr=TR, **parts), K)


def _whole_chain(s, d):
    """Drift of automatic order and motion components, the region's course, the first component and the least daily value, with two conditions kept."""
    physio = S.to_packed(fixture(s, d, "series_daily").groupBy("subject", "t").agg(F.stddev_samp("y").alias("y")).withColumn("k", F.lit(1).cast("bigint")), ["subject", "k"])
    signal = _columns(_dense(s, d, _response(s, d)), F.when(F.col("cond") == "high", 1).otherwise(2))
    return _chain(s, d, order=-1, motion=_columns(_motion(s, d), F.col("component")), signal=signal, region=in_spark(s, d, REGION), physio=physio, first_component=True, weights=in_spark(s, d, WEIGHTS))


def _dense(s, d, response):
    """A value for each day of a condition."""
    days = fixture(s, d, "series_daily").select("subject", "t").distinct().join(response.select("subject", "cond").distinct(), "subject")
    return days.join(response, ["subject", "cond", "t"], "left").select("subject", "cond", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def _per_unit(df):
    dot = lambda a, b: F.round(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v), 3) + F.lit(0.0)
    return df.select("subject", "unit", dot("y", "y").alias("energy"))


def _multirun(s, d):
    """Three runs of ten days; a scan is dropped before each, conditions last two scans, the three greatest days are censored."""
    series = fixture(s, d, "series_daily").select("subject", F.floor(F.col("t") / 10).cast("bigint").alias("run"), "unit", (F.col("t") % 10).alias("t"), "y")
    events = _blocks(s, d).select("subject", F.floor(F.col("onset_t") / 10).cast("bigint").alias("run"), "cond", ((F.col("onset_t") % 10 + 1) * TR).alias("onset_s"), F.lit(2 * TR).alias("duration_s"))
    return N.multirun_glm(series, events.filter(F.col("cond").isin(CONDITIONS)), K, TR, 1, events.filter("cond = 'top'").withColumn("duration_s", F.lit(0.0)))


QUERIES = {
    "glm_denoise_chain": (lambda s, d: _per_unit(_whole_chain(s, d)), None),
    "global_pc_regressor": (lambda s, d: _energy(_chain(s, d, order=0, signal=_columns(_dense(s, d, _response(s, d)), F.when(F.col("cond") == "high", 1).otherwise(2)), first_component=True, weights=in_spark(s, d, WEIGHTS))), None),
    "global_pc_runs": (lambda s, d: _energy(_chain(s, d, order=1, halves=False, motion=_regressors(s, d), first_component=True)), None),
    "motion_pcs": (lambda s, d: rounded(_motion(s, d), "y", digits=4), None),
    "multirun_glm": (lambda s, d: rounded(_multirun(s, d), "beta", "t", digits=4), None),
    "task_motion_corr": (lambda s, d: rounded(N.task_motion_corr(_response(s, d), _motion(s, d), CONDITIONS, K), "r", digits=5), None),
}
