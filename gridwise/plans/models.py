"""Queries of the models and quality checks that are sums, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwise.fixtures import fixture
from gridwise.operators import models as M
from gridwise.operators import series as S
from gridwise.operators.stats import rounded

SD = "WITH sd AS (SELECT *, CASE WHEN t < 15 THEN 1 ELSE 2 END AS half FROM ({series_daily}) q)"
SM = "WITH sm AS (SELECT sample, half, CASE WHEN class = 0 THEN -1 ELSE 1 END AS class, unit, y FROM ({sample_matrix}) q)"
MO = SM + """, m0 AS (SELECT unit, half, avg(y) FILTER (class = -1) AS m1, var_samp(y) FILTER (class = -1) AS v1, count(*) FILTER (class = -1) AS n1, avg(y) FILTER (class = 1) AS m2, var_samp(y) FILTER (class = 1) AS v2, count(*) FILTER (class = 1) AS n2, stddev_samp(y) AS s FROM sm GROUP BY unit, half),
  m AS (SELECT * FROM m0 WHERE unit NOT IN (SELECT unit FROM m0 WHERE coalesce(s, 0) <= 0))"""


def _sd(s, d):
    return S.split_half_time(fixture(s, d, "series_daily"), ["subject"])


def _sm(s, d):
    """Class 0 against all others."""
    return fixture(s, d, "sample_matrix").withColumn("class", F.when(F.col("class") == 0, -1).otherwise(1))


def _gnb(spread, like):
    own = lambda i: like.format(i=i)
    return MO + f""", t AS (SELECT unit, half, (m2 - m1) / nullif({spread}, 0) AS t FROM m), mp AS (SELECT unit, max(t) FILTER (half = 1) AS one, max(t) FILTER (half = 2) AS two FROM t GROUP BY unit),
    sc AS (SELECT sm.sample, sm.class, sum({own(1)}) AS l1, sum({own(2)}) AS l2 FROM sm JOIN m ON m.unit = sm.unit AND m.half = 3 - sm.half GROUP BY 1, 2),
    p AS (SELECT avg(CASE WHEN class = -1 AND l1 > l2 OR class = 1 AND l2 > l1 THEN 1e0 ELSE 0e0 END) AS P, count(*) AS n FROM sc), r AS (SELECT corr(one, two) AS R FROM mp)
    SELECT round(R, 6) AS R, round(P, 6) AS P, n, round(-sqrt(power(1 - R, 2) + power(1 - P, 2)), 6) AS dPR FROM r, p"""


SEEDS = "(SELECT unit FROM ({binary_maps}) bm WHERE b = 1 AND subject = 'signup')"


def _seed(s, d):
    return fixture(s, d, "binary_maps").filter("b = 1 AND subject = 'signup'").select("unit")


def _points(s, d):
    """Series of all units as dimensions."""
    return fixture(s, d, "series_daily").select("subject", F.col("unit").alias("k"), "t", "y")


def _displacement(s, d):
    points = _points(s, d)
    dimensions = points.groupBy("subject").agg(F.countDistinct("k").alias("n"))
    moved = M.window_median_displacement(points, ["subject"]).join(dimensions, "subject")
    return rounded(moved.select("subject", "t", (F.col("displacement") / F.col("n")).alias("displacement")), "displacement", digits=3)


PTS = "WITH pt AS (SELECT subject, unit AS k, t, y FROM ({series_daily}) sd)"
FLAGS = "WITH sd AS ({series_daily}), o AS (SELECT subject, t, round(percent_rank() OVER (PARTITION BY subject ORDER BY v DESC), 9) AS p_motion, round(percent_rank() OVER (PARTITION BY subject ORDER BY w DESC), 9) AS p_volume FROM (SELECT subject, t, round(sum(y), 4) AS v, round(max(y), 4) AS w FROM sd GROUP BY subject, t) q), f AS (SELECT subject, t, CASE WHEN p_motion <= 0.05 THEN 1 ELSE 0 END AS mot, CASE WHEN p_volume <= 0.05 THEN 1 ELSE 0 END AS vol FROM o), g AS (SELECT subject, t, mot, vol, vol * greatest(mot, coalesce(lag(mot) OVER (PARTITION BY subject ORDER BY t), 0)) AS volmot FROM f)"


def _flags(s, d):
    from pyspark.sql import Window

    sums = fixture(s, d, "series_daily").groupBy("subject", "t").agg(F.round(F.sum("y"), 4).alias("v"), F.round(F.max("y"), 4).alias("w"))
    w = Window.partitionBy("subject")
    out = sums.withColumn("p_motion", F.round(F.percent_rank().over(w.orderBy(F.desc("v"))), 9)).withColumn("p_volume", F.round(F.percent_rank().over(w.orderBy(F.desc("w"))), 9))
    return M.censor_flags(out, ["subject"]).select("subject", "t", "mot", "vol", "volmot")


def _reg(s, d):
    return fixture(s, d, "series_daily").groupBy("subject", "t").agg(F.round(F.avg("y"), 6).alias("x"))


QUERIES = {
    "model_gnb_linear": (lambda s, d: rounded(M.model_gnb(_sm(s, d)), "R", "P", "dPR"), _gnb("((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)", "-power(sm.y - m{i}, 2)")),
    "model_gnb_nonlinear": (lambda s, d: rounded(M.model_gnb(_sm(s, d), False), "R", "P", "dPR"), _gnb("v1 + v2", "-0.5 * ln(v{i}) - power(sm.y - m{i}, 2) / (2 * v{i})")),
    "model_glm": (
        lambda s, d: rounded(M.model_glm(_sd(s, d), _reg(s, d), ["subject"]).select("subject", "unit", "R", "z"), "R", "z", digits=5),
        SD + """, rg AS (SELECT subject, t, round(avg(y), 6) AS x FROM sd GROUP BY subject, t), m AS (SELECT subject, unit, regr_slope(y, x) FILTER (half = 1) AS one, regr_slope(y, x) FILTER (half = 2) AS two FROM sd JOIN rg USING (subject, t) GROUP BY subject, unit),
        s AS (SELECT subject, avg(one) AS m1, stddev_samp(one) AS s1, avg(two) AS m2, stddev_samp(two) AS s2, corr(one, two) AS R FROM m GROUP BY subject) SELECT subject, unit, round(R, 5) AS R, round(((one - m1) / s1 + (two - m2) / s2) / sqrt(2) / sqrt(1 - R), 5) AS z FROM m JOIN s USING (subject)""",
    ),
    "model_seed_corr": (
        lambda s, d: rounded(M.model_seed_corr(_sd(s, d), _seed(s, d), ["subject"]), "one", "two", "R", digits=5),
        SD + f""", se AS {SEEDS}, x AS (SELECT subject, t, avg(y) AS x FROM sd WHERE unit IN (SELECT unit FROM se) GROUP BY subject, t),
        v AS (SELECT subject, unit, half, CASE WHEN stddev_samp(y) > 0 AND stddev_samp(x) > 0 THEN corr(y, x) ELSE 0 END AS c FROM sd JOIN x USING (subject, t) GROUP BY 1, 2, 3), m AS (SELECT subject, unit, max(c) FILTER (half = 1) AS one, max(c) FILTER (half = 2) AS two FROM v GROUP BY 1, 2),
        r AS (SELECT subject, corr(one, two) AS R FROM m WHERE unit NOT IN (SELECT unit FROM se) GROUP BY subject) SELECT subject, unit, round(one, 5) + 0 AS one, round(two, 5) + 0 AS two, round(R, 5) AS R FROM m JOIN r USING (subject)""",
    ),
    "model_gconn": (
        lambda s, d: rounded(M.model_gconn(fixture(s, d, "series_daily"), ["subject"]), "gconn", digits=5),
        SD + ", c AS (SELECT subject, unit, t, y - avg(y) OVER (PARTITION BY subject, unit) AS y FROM sd), m AS (SELECT subject, t, avg(y) AS m, count(*) AS n FROM c GROUP BY subject, t) SELECT subject, unit, round(sum(y * m) / (max(n) - 1), 5) + 0 AS gconn FROM c JOIN m USING (subject, t) GROUP BY subject, unit",
    ),
    "model_hurst": (
        lambda s, d: rounded(M.model_hurst(fixture(s, d, "lattice_series"), ["subject", "unit"], [5, 8, 13, 20, 27]), "hurst", digits=5),
        """WITH ls AS ({lattice_series}), b AS (SELECT subject, unit, t, y - regr_slope(y, t) OVER w * t - regr_intercept(y, t) OVER w AS r FROM ls WINDOW w AS (PARTITION BY subject, unit)),
        p AS (SELECT subject, unit, sum(r) OVER (PARTITION BY subject, unit ORDER BY t) AS c, row_number() OVER (PARTITION BY subject, unit ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY subject, unit) AS len FROM b),
        g AS (SELECT *, cast(floor(k / size) AS bigint) AS seg FROM p, (VALUES (5), (8), (13), (20), (27)) v(size)), f AS (SELECT subject, unit, size, seg, regr_syy(c, k) - power(regr_sxy(c, k), 2) / regr_sxx(c, k) AS rss, count(*) AS n FROM g WHERE (seg + 1) * size <= len GROUP BY 1, 2, 3, 4),
        q AS (SELECT subject, unit, size, sqrt(sum(greatest(rss, 0)) / sum(n)) AS f FROM f GROUP BY 1, 2, 3) SELECT subject, unit, round(regr_slope(ln(f), ln(size)), 5) AS hurst FROM q WHERE f > 0 GROUP BY subject, unit""",
    ),
    "cv_timecourse": (
        lambda s, d: rounded(M.cv_timecourse(fixture(s, d, "series_daily"), S.temporal_mean_std(fixture(s, d, "series_daily"), ["subject", "unit"]).select("subject", "unit", F.col("mean").alias("w")), ["subject"]), "cv", digits=5),
        SD + ", w AS (SELECT subject, unit, avg(y) AS w FROM sd GROUP BY 1, 2), n AS (SELECT subject, sqrt(sum(w * w)) AS n FROM w GROUP BY subject) SELECT subject, t, round(sum(y * w / n), 5) AS cv FROM sd JOIN w USING (subject, unit) JOIN n USING (subject) GROUP BY subject, t",
    ),
    "tissue_weight": (lambda s, d: rounded(M.tissue_weight(fixture(s, d, "lattice_series"), ["subject"]), "w", digits=5), None),
    "prior_threshold_search": (
        lambda s, d: rounded(M.prior_threshold_search(fixture(s, d, "series_daily").groupBy("subject", "unit").agg(F.round(F.max("y"), 4).alias("v")).join(fixture(s, d, "binary_maps"), ["subject", "unit"]), "v", "b", ["subject"]).withColumns({c: F.round(c, 1) for c in ("pct", "used")}), "overlap"),
        """WITH v AS (SELECT subject, unit, round(max(y), 4) AS v FROM ({series_daily}) q GROUP BY 1, 2), r AS (SELECT v.subject, b, floor(500.0 * (row_number() OVER (PARTITION BY v.subject ORDER BY v, v.unit) - 1) / count(*) OVER (PARTITION BY v.subject)) AS pct FROM v JOIN ({binary_maps}) bm ON bm.subject = v.subject AND bm.unit = v.unit),
        j AS (SELECT subject, p.pct, sum(CASE WHEN r.pct >= p.pct THEN 1 ELSE 0 END) AS above, sum(CASE WHEN r.pct >= p.pct THEN b ELSE 0 END) AS hits, sum(b) AS mask FROM r, (SELECT unnest(range(250, 498)) AS pct) p GROUP BY 1, 2),
        s AS (SELECT subject, pct, round(sum(hits / nullif(above + mask - hits, 0)) OVER (PARTITION BY subject ORDER BY pct ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 9) AS s FROM j)
        SELECT subject, round(pct / 5e0, 1) AS pct, round(s, 6) AS overlap, round(greatest(pct / 5e0, 90), 1) AS used FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY s DESC, pct) AS k FROM s) q WHERE k = 1""",
    ),
    "window_median_displacement": (
        _displacement,
        PTS + ", m AS (SELECT a.subject, a.k, a.t, a.y, median(b.y) AS m FROM pt a JOIN pt b ON a.subject = b.subject AND a.k = b.k AND abs(a.t - b.t) <= 7 AND a.t <> b.t GROUP BY 1, 2, 3, 4) SELECT subject, t, round(sum(power(y - m, 2)) / count(*), 3) AS displacement FROM m GROUP BY subject, t",
    ),
    "trajectory": (
        lambda s, d: rounded(M.trajectory(_points(s, d), ["subject", "k"]).select("subject", "k", "t", "path"), "path"),
        PTS + " SELECT a.subject, a.k, a.t, round(avg(b.y), 6) AS path FROM pt a JOIN pt b ON a.subject = b.subject AND a.k = b.k AND abs(a.t - b.t) <= 7 AND a.t <> b.t GROUP BY 1, 2, 3",
    ),
    "censor_flags": (_flags, FLAGS + " SELECT * FROM g"),
    "spike_counts": (lambda s, d: M.spike_counts(_flags(s, d), ["subject"]), FLAGS + " SELECT subject, sum(mot)::bigint AS mot, sum(vol)::bigint AS vol, sum(volmot)::bigint AS volmot, count(*) AS n FROM g GROUP BY subject"),
    "resume_filter": (
        lambda s, d: M.resume_filter(fixture(s, d, "metric_grid").select("subject", "pipeline_id"), fixture(s, d, "metric_grid").filter("XCond < 700").select("subject", "pipeline_id"), ["subject", "pipeline_id"]),
        "WITH mg AS ({metric_grid}) SELECT subject, pipeline_id FROM mg WHERE XCond >= 700",
    ),
    "status_report": (
        lambda s, d: M.status_report(fixture(s, d, "metric_grid").select("subject", F.col("censor").cast("string").alias("stage"), F.col("pipeline_id").alias("output")), fixture(s, d, "metric_grid").filter("GS_fract < 0.3").select("subject", F.col("censor").cast("string").alias("stage"), F.col("pipeline_id").alias("output")), ["subject"]),
        "WITH mg AS ({metric_grid}), c AS (SELECT subject, cast(censor AS varchar) AS stage, count(*) AS expected, count(*) FILTER (GS_fract < 0.3) AS found FROM mg GROUP BY 1, 2) SELECT *, CASE WHEN expected = found THEN 'done' ELSE 'incomplete' END AS status FROM c",
    ),
}
