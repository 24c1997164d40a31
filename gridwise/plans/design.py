"""Queries over designs and grids, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwise.fixtures import fixture, in_spark
from gridwise.operators import design as D
from gridwise.operators.stats import rounded

CE = "WITH ce AS ({cond_events})"
MS = CE + ", ms AS (SELECT subject, cond, onset_t, duration, (onset_t - 2) * 300 AS onset_ms, duration * 300 AS duration_ms FROM ce WHERE onset_t >= 2)"
OPTIONS = "SELECT DISTINCT step, value FROM (SELECT 'motcor' AS step, motcor AS value FROM ({metric_grid}) a UNION ALL SELECT 'gspc', gspc FROM ({metric_grid}) b UNION ALL SELECT 'censor', censor FROM ({metric_grid}) c UNION ALL SELECT 'detrend', cast(l_linenumber AS bigint) FROM {lineitem}) o"


def _ce(s, d):
    return fixture(s, d, "cond_events")


def _ms(s, d):
    return D.onset_normalise(_ce(s, d), 300.0, 2)


SC = ["subject", "cond"]
BLOCK = MS + ", bl AS (SELECT DISTINCT subject, cond, cast(u.sample AS bigint) AS sample FROM (SELECT subject, cond, cast(round(onset_ms / 100.0) AS int) AS st, least(cast(round(onset_ms / 100.0) AS int) + cast(round(duration_ms / 100.0) AS int), 89) AS ed FROM ms) q, unnest(range(st, ed + 1)) u(sample))"
HRF = BLOCK + ", k AS (SELECT i AS lag, exp(-(i * 0.1)) * (0.0083333 * power(i * 0.1, 5.0) - 1.274527e-13 * power(i * 0.1, 15.0)) AS w FROM unnest(range(0, 201)) u(i)), h AS (SELECT subject, cond, sample + lag AS sample, sum(w) AS v FROM bl, k WHERE sample + lag < 90 GROUP BY 1, 2, 3)"
SCANS = MS + ", sc AS (SELECT DISTINCT subject, cond, cast(u.scan AS bigint) AS scan FROM (SELECT subject, cond, cast(ceil(onset_ms / 300.0) AS int) AS st, cast(round(duration_ms / 300.0) AS int) AS n FROM ms) q, unnest(range(st, st + n)) u(scan) WHERE u.scan BETWEEN 1 AND 28)"
CLASSES = SCANS + ", cl AS (SELECT DISTINCT subject, CASE WHEN cond IN ('click', 'view') THEN 1 ELSE 2 END AS class, scan FROM sc)"


def _hrf(s, d):
    return D.hrf_convolve(D.design_block(_ms(s, d), SC, 300.0, 30), SC, 90, 0.1)


def _scans(s, d):
    return D.block_scans(_ms(s, d), SC, 300.0, 28)


def _classes(s, d):
    return _scans(s, d).select("subject", F.when(F.col("cond").isin("click", "view"), 1).otherwise(2).alias("class"), "scan").distinct()


def _conditions(s, d):
    from pyspark.sql import Window

    return _ce(s, d).select("subject", "cond").distinct().withColumn("cond_id", F.row_number().over(Window.partitionBy("subject").orderBy("cond")).cast("bigint"))


CONDS = ", cn AS (SELECT subject, cond, row_number() OVER (PARTITION BY subject ORDER BY cond) AS cond_id FROM (SELECT DISTINCT subject, cond FROM ce) q)"

QUERIES = {
    "pipeline_grid": (
        lambda s, d: D.pipeline_grid(in_spark(s, d, OPTIONS), ["motcor", "censor", "lowpass"], ["detrend", "gspc"]),
        f"WITH o AS ({OPTIONS}) SELECT m.value AS motcor, c.value AS censor, 0 AS lowpass, d.value AS detrend, g.value AS gspc, row_number() OVER (ORDER BY c.value, m.value, d.value, g.value) AS pipeline_id FROM o m, o c, o d, o g WHERE m.step = 'motcor' AND c.step = 'censor' AND d.step = 'detrend' AND g.step = 'gspc'",
    ),
    "pipeline_grid_phyplus": (
        lambda s, d: D.pipeline_grid(in_spark(s, d, OPTIONS), ["motcor", "censor"]).crossJoin(F.broadcast(s.range(2).withColumnRenamed("id", "phyplus"))),
        f"WITH o AS ({OPTIONS}), g AS (SELECT m.value AS motcor, c.value AS censor, row_number() OVER (ORDER BY c.value, m.value) AS pipeline_id FROM o m, o c WHERE m.step = 'motcor' AND c.step = 'censor') SELECT g.*, p AS phyplus FROM g, (VALUES (0), (1)) v(p)",
    ),
    "gs_code": (lambda s, d: fixture(s, d, "metric_grid").select("subject", "pipeline_id", D.gs_code(F.col("gspc"), F.col("motcor")).alias("code")), "WITH mg AS ({metric_grid}) SELECT subject, pipeline_id, gspc + 2 * motcor AS code FROM mg"),
    "pipeline_name": (
        lambda s, d: fixture(s, d, "metric_grid").select("pipeline_id", "motcor", "censor", (F.col("gspc") - 1).alias("detrend")).distinct().select("pipeline_id", D.pipeline_name({"motcor": "m", "censor": "c", "detrend": "d"}).alias("name")),
        "WITH mg AS ({metric_grid}) SELECT DISTINCT pipeline_id, 'm' || motcor || 'c' || censor || 'd' || CASE WHEN gspc - 1 = -1 THEN 'A' ELSE cast(gspc - 1 AS varchar) END AS name FROM mg",
    ),
    "default_contrast": (lambda s, d: D.default_contrast(_ce(s, d), ["subject"]), CE + " SELECT subject, string_agg(cond, '+' ORDER BY cond) || '-baseline' AS contrast FROM (SELECT DISTINCT subject, cond FROM ce) q GROUP BY subject"),
    "contrast_parse": (
        lambda s, d: D.contrast_parse(_ce(s, d).groupBy("subject").agg(F.concat(F.min("cond"), F.lit("-"), F.max("cond"), F.lit(","), F.max("cond")).alias("contrast")), _conditions(s, d), ["subject"]),
        CE + CONDS + ", e AS (SELECT subject, min(cond_id) AS lo, max(cond_id) AS hi FROM cn GROUP BY subject) SELECT subject, 1 AS contrast_id, lo AS cond_pos, hi AS cond_neg FROM e UNION ALL SELECT subject, 2, hi, 0 FROM e",
    ),
    "combined_condition": (lambda s, d: D.combined_condition(_ce(s, d), ["click", "view"]), CE + " SELECT * FROM ce UNION ALL SELECT subject, 'click+view', onset_t, duration FROM ce WHERE cond IN ('click', 'view')"),
    "param_override": (
        lambda s, d: _ce(s, d).groupBy("subject").agg(F.max("duration").alias("m")).select("subject", D.param_override(F.create_map(F.lit("drf"), F.lit("0.5"), F.lit("wind"), F.lit("10")), F.create_map(F.lit("drf"), F.lit("NONE"), F.lit("wind"), F.col("m").cast("string"))).alias("p")).select("subject", F.col("p")["drf"].alias("drf"), F.col("p")["wind"].alias("wind")),
        CE + " SELECT subject, '0.5' AS drf, cast(max(duration) AS varchar) AS wind FROM ce GROUP BY subject",
    ),
    "onset_normalise": (lambda s, d: _ms(s, d).select("subject", "cond", "onset_ms", "duration_ms"), MS + " SELECT subject, cond, cast(onset_ms AS double) AS onset_ms, cast(duration_ms AS double) AS duration_ms FROM ms"),
    "design_block": (lambda s, d: D.design_block(_ms(s, d), SC, 300.0, 30), BLOCK + " SELECT * FROM bl"),
    "design_event": (lambda s, d: D.design_event(_ce(s, d), SC, 28), CE + " SELECT DISTINCT subject, cond, greatest(1, least(28, onset_t)) AS scan FROM ce"),
    "hrf_convolve": (lambda s, d: rounded(_hrf(s, d), "v"), HRF + " SELECT subject, cond, sample, round(v, 6) AS v FROM h"),
    "design_finish": (
        lambda s, d: rounded(D.design_finish(D.hrf_response(D.design_block(_ms(s, d), SC, 300.0, 30), SC, 90, 0.1), SC, 90, 3), "v"),
        HRF + ", f AS (SELECT subject, cond, sample, v - sum(v) OVER (PARTITION BY subject, cond) / 90 AS v FROM h) SELECT subject, cond, cast((sample - 1) / 3 AS bigint) AS scan, round(v, 6) + 0 AS v FROM f WHERE sample >= 1 AND (sample - 1) % 3 = 0",
    ),
    "block_scans": (lambda s, d: _scans(s, d), SCANS + " SELECT * FROM sc"),
    "baseline_complement": (
        lambda s, d: D.baseline_complement(_scans(s, d), ["subject"], 28),
        SCANS + " SELECT subject, cast(u.scan AS bigint) AS scan FROM (SELECT DISTINCT subject FROM sc) s, unnest(range(1, 29)) u(scan) WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.subject = s.subject AND sc.scan = u.scan)",
    ),
    "split_half_classes": (
        lambda s, d: D.split_half_classes(_classes(s, d), 28).groupBy("subject", "class", "half").agg(F.count(F.lit(1)).alias("n")),
        CLASSES + " SELECT subject, class, CASE WHEN scan <= 14 THEN 1 ELSE 2 END AS half, count(*) AS n FROM cl GROUP BY 1, 2, 3",
    ),
    "class_balance": (
        lambda s, d: D.class_balance(_classes(s, d), ["subject"]),
        CLASSES + """, f AS (SELECT a.subject, a.class, a.scan, min(abs(a.scan - b.scan)) AS far FROM cl a JOIN cl b ON a.subject = b.subject AND a.class <> b.class GROUP BY 1, 2, 3),
        k AS (SELECT *, row_number() OVER (PARTITION BY subject, class ORDER BY far, scan DESC) AS k, count(*) OVER (PARTITION BY subject, class) AS n FROM f), m AS (SELECT *, min(n) OVER (PARTITION BY subject) AS least FROM k)
        SELECT subject, class, scan FROM m WHERE k <= least""",
    ),
    "legendre_basis": (
        lambda s, d: rounded(D.legendre_basis(_ce(s, d).groupBy("subject").agg((F.max("onset_t") + 1).alias("n")), ["subject"], "n", 3), "p1", "p2", "p3"),
        CE + ", r AS (SELECT subject, max(onset_t) + 1 AS n FROM ce GROUP BY subject), x AS (SELECT subject, cast(u.t AS bigint) AS t, CASE WHEN n > 1 THEN 2.0 * u.t / (n - 1) - 1 ELSE 1 END AS x FROM r, unnest(range(0, n)) u(t)) SELECT subject, t, 1.0 AS p0, round(x, 6) + 0 AS p1, round((3 * x * x - 1) / 2, 6) + 0 AS p2, round((5 * x * x * x - 3 * x) / 2, 6) + 0 AS p3 FROM x",
    ),
    "detrend_order_auto": (
        lambda s, d: _ce(s, d).groupBy("subject").agg(F.max("onset_t").alias("n"), F.sum("duration").alias("w")).select("subject", D.detrend_order_auto(F.col("w") / 10.0, F.col("n") + 1).cast("bigint").alias("k")),
        CE + " SELECT subject, cast(1 + floor(sum(duration) / 10.0 * ((max(onset_t) + 1) / 2.0) / 150) AS bigint) AS k FROM ce GROUP BY subject",
    ),
    "multirun_onsets": (
        lambda s, d: D.multirun_onsets(_ce(s, d).withColumn("run", F.floor(F.col("onset_t") / 10)).withColumn("onset_t", F.col("onset_t") % 10 - 1), _ce(s, d).select("subject", F.floor(F.col("onset_t") / 10).alias("run")).distinct().withColumn("length", F.lit(10).cast("bigint")), ["subject"]),
        CE + """, r AS (SELECT subject, run, 10 * (row_number() OVER (PARTITION BY subject ORDER BY run) - 1) AS before FROM (SELECT DISTINCT subject, cast(floor(onset_t / 10) AS bigint) AS run FROM ce) q),
        e AS (SELECT subject, cond, cast(floor(onset_t / 10) AS bigint) AS run, onset_t % 10 - 1 AS o, duration FROM ce)
        SELECT subject, run, cond, greatest(o, 0) + before AS onset_t, least(o + duration, 10) - greatest(o, 0) AS duration FROM e JOIN r USING (subject, run) WHERE least(o + duration, 10) - greatest(o, 0) > 0""",
    ),
}
