"""Queries over text that is derived from the given tables, and group models over resamples, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwise.fixtures import fixture, in_spark, lattice_means
from gridwise.operators import models as M

from gridwise.operators.stats import rounded
from gridwise.shared import stored
from gridwise.sources import text as X

#: A manifest line for each supplier: two runs, one of them short in every seventh line.
LINES = """SELECT cast(s_suppkey AS bigint) AS line, concat('IN=/d/s', s_suppkey, '_r1.nii,/d/s', s_suppkey, '_r2.nii OUT=/o/s', s_suppkey, '_r1', CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE concat(',/o/s', s_suppkey, '_r2') END,
  ' DROP=[', s_suppkey % 4, ',', s_suppkey % 3, '] TASK=/t/a.txt,/t/b.txt', CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE concat(' STRUCT=/s/', s_nationkey, '.nii') END) AS value FROM {supplier}"""
ML = f"WITH ln AS ({LINES})"
MF = ML + """, mf AS (SELECT line, nullif(regexp_extract(value, 'IN=(\\S+)', 1), '') AS "in", nullif(regexp_extract(value, 'OUT=(\\S+)', 1), '') AS "out", nullif(regexp_extract(value, 'TASK=(\\S+)', 1), '') AS task, nullif(regexp_extract(value, 'STRUCT=(\\S+)', 1), '') AS struct,
  cast(regexp_extract(value, 'DROP=\\[(\\d+)', 1) AS bigint) AS drop_first, cast(regexp_extract(value, 'DROP=\\[\\d+,(\\d+)', 1) AS bigint) AS drop_last FROM ln)"""
#: A task file for each user: one group of a name, onsets and durations for each kind of event.
TASKS = """SELECT subject AS file, concat('UNIT=[TR] TR_MSEC=[2000] TYPE=[event]', string_agg(concat(' NAME=[', cond, '] ONSETS=[', onsets, '] DURATION=[', durations, ']'), '')) AS value
  FROM (SELECT subject, cond, string_agg(cast(onset_t AS varchar(9)), ',') AS onsets, string_agg(cast(duration AS varchar(9)), ',') AS durations FROM ({cond_events}) ce GROUP BY subject, cond) g GROUP BY subject"""
OPTIONS = "SELECT cast(n_nationkey AS bigint) AS file, concat('MOTCOR=[0,1]\\nSMOOTH=[', n_nationkey % 7, ',6]\\nDETREND=[', CASE WHEN n_regionkey = 0 THEN 'A' ELSE cast(n_regionkey AS varchar(2)) END, ']\\n') AS value FROM {nation}"
PATHS = "SELECT concat('/d/sub-', lpad(cast(o_custkey % 50 AS varchar(4)), 2, '0'), '/ses-', o_orderkey % 2, '/func/sub-', o_custkey % 50, '_task-t_run-', o_orderkey % 3, CASE o_orderstatus WHEN 'F' THEN '_bold.nii.gz' WHEN 'O' THEN '_events.tsv' ELSE '_bold.json' END) AS path FROM {orders}"

#: Violations of the manifest: a run's output missing, and structural images that only some lines have.
FAULTS = """, fa AS (SELECT line, 'in_out_differ' AS rule FROM mf WHERE len(string_split("in", ',')) <> len(string_split("out", ',')) UNION ALL SELECT line, 'partial_struct' FROM mf WHERE struct IS NULL AND EXISTS (SELECT 1 FROM mf q WHERE q.struct IS NOT NULL))"""
#: Files that are there: first runs of all suppliers, second runs of those with a balance, images of nations with a customer, one of two task files.
LISTING = "SELECT concat('/d/s', s_suppkey, '_r1.nii') AS path FROM {supplier} UNION ALL SELECT concat('/d/s', s_suppkey, '_r2.nii') FROM {supplier} WHERE s_acctbal > 0 UNION ALL SELECT DISTINCT concat('/s/', c_nationkey, '.nii') FROM {customer} WHERE c_acctbal > 9000 UNION ALL SELECT '/t/a.txt' FROM {region} WHERE r_regionkey = 0"
LISTED_TASKS = "SELECT '/t/a.txt' AS file, 'UNIT=[TR] TR_MSEC=[2000] TYPE=[block] NAME=[rest] ONSETS=[1] DURATION=[2] NAME=[move] ONSETS=[3] DURATION=[2]' AS value FROM {region} WHERE r_regionkey = 0"
#: Task files of users, one fault each by the kinds of events they have.
ODD_TASKS = """SELECT cast(user_id AS bigint) AS file, concat('UNIT=[TR]', CASE WHEN max(value) > 480 THEN ' TR_MSEC=[fast]' ELSE ' TR_MSEC=[2000]' END, CASE WHEN min(value) < 1 THEN '' ELSE ' TYPE=[event]' END, CASE WHEN avg(value) > 50 THEN ' NAME=[a+b]' ELSE ' NAME=[a]' END, ' ONSETS=[1]',
  CASE WHEN count(*) > 15 THEN ' DURATION=[1,2]' ELSE ' DURATION=[1]' END, CASE WHEN min(event_type) = 'click' THEN ' NAME=[c]' ELSE '' END) AS value FROM {events} GROUP BY user_id"""
ODD_OPTIONS = "SELECT cast(n_nationkey AS bigint) AS file, concat('MOTCOR=[0,', n_nationkey % 12, ']\\nSMOOTH=[', n_nationkey % 7, '.5, 6]\\nDETREND=[', CASE n_regionkey WHEN 0 THEN 'A' WHEN 1 THEN '-1, 2' ELSE '12' END, ']\\n', CASE n_regionkey WHEN 2 THEN 'BLUR=[1]' ELSE 'task=[1]' END) AS value FROM {nation}"


def _manifest(s, d):
    return X.manifest_scan(in_spark(s, d, LINES))


def _resampled(s, d, n=6):
    return M.split_half_resamples(fixture(s, d, "series_daily").select("subject").distinct(), n)


def _samples(s, d):
    """Days of the second half of each week against the others."""
    return fixture(s, d, "series_daily").withColumn("class", F.when(F.col("t") % 7 >= 4, 1).otherwise(-1))


def _mean(s, d):
    return fixture(s, d, "series_daily").groupBy("subject", "t").agg(F.avg("y").alias("x"))


QUERIES = {
    "manifest_scan": (lambda s, d: _manifest(s, d).select("line", "in", "out", "task", "struct", "drop_first", "drop_last"), MF + " SELECT * FROM mf"),
    "manifest_explode_runs": (
        lambda s, d: X.manifest_explode_runs(_manifest(s, d)).select("line", "subject", "run", "in", "out", "drop_first", "drop_last"),
        MF + """, p AS (SELECT *, string_split("in", ',') AS a, string_split("out", ',') AS b, string_split(task, ',') AS c FROM mf), r AS (SELECT *, unnest(range(1, len(a) + 1)) AS run FROM p WHERE len(a) = len(b) AND len(a) = len(c))
        SELECT line, b[1] AS subject, run, a[run] AS "in", b[run] AS "out", drop_first, drop_last FROM r""",
    ),
    "manifest_merge_runs": (
        lambda s, d: X.manifest_merge_runs(_manifest(s, d).filter("struct IS NOT NULL")),
        MF + """ SELECT struct, min(line) AS line, string_agg("in", ',' ORDER BY line) AS "in", string_agg("out", ',' ORDER BY line) AS "out", string_agg(task, ',' ORDER BY line) AS task, arg_min(drop_first, line) AS drop_first, arg_min(drop_last, line) AS drop_last FROM mf WHERE struct IS NOT NULL GROUP BY struct""",
    ),
    "manifest_validate": (lambda s, d: X.manifest_validate(_manifest(s, d)), MF + FAULTS + " SELECT * FROM fa"),
    "manifest_validate_files": (
        lambda s, d: X.manifest_validate(_manifest(s, d), in_spark(s, d, LISTING), X.task_scan(in_spark(s, d, LISTED_TASKS)), ["rest", "move"]),
        MF + FAULTS + f""", l AS ({LISTING}), f AS (SELECT line, 'no_file_in' AS rule, unnest(string_split("in", ',')) AS path FROM mf UNION ALL SELECT line, 'no_file_task', unnest(string_split(task, ',')) FROM mf UNION ALL SELECT line, 'no_file_struct', struct FROM mf WHERE struct IS NOT NULL)
        SELECT * FROM fa UNION ALL SELECT DISTINCT line, rule FROM f WHERE path NOT IN (SELECT path FROM l) UNION ALL SELECT line, 'unknown_condition' FROM mf""",
    ),
    "manifest_unique_struct": (lambda s, d: X.manifest_unique_struct(_manifest(s, d)), MF + " SELECT struct, min(line) AS line FROM mf WHERE struct IS NOT NULL GROUP BY struct"),
    "task_scan": (
        lambda s, d: X.task_scan(in_spark(s, d, TASKS)).select("file", "tr_ms", F.explode("cond").alias("c")).select("file", "tr_ms", F.col("c.name").alias("name"), F.size("c.onset").cast("bigint").alias("n"), F.aggregate("c.onset", F.lit(0.0), lambda a, b: a + b).alias("onsets"), F.aggregate("c.duration", F.lit(0.0), lambda a, b: a + b).alias("durations")),
        "WITH ce AS ({cond_events}) SELECT subject AS file, 2000.0 AS tr_ms, cond AS name, count(*) AS n, cast(sum(onset_t) AS double) AS onsets, cast(sum(duration) AS double) AS durations FROM ce GROUP BY subject, cond",
    ),
    "pipeline_scan": (
        lambda s, d: X.pipeline_scan(in_spark(s, d, OPTIONS)).filter("step IN ('motcor', 'smooth', 'detrend', 'lowpass')"),
        "WITH n AS (SELECT cast(n_nationkey AS bigint) AS file, n_nationkey, n_regionkey FROM {nation}) SELECT file, 'motcor' AS step, v AS value FROM n, (VALUES (0e0), (1e0)) q(v) UNION ALL SELECT file, 'smooth', n_nationkey % 7 FROM n UNION ALL SELECT file, 'smooth', 6 FROM n UNION ALL SELECT file, 'detrend', CASE WHEN n_regionkey = 0 THEN -1 ELSE n_regionkey END FROM n UNION ALL SELECT file, 'lowpass', 0 FROM n",
    ),
    "task_validate": (
        lambda s, d: X.task_validate(in_spark(s, d, ODD_TASKS)),
        f"WITH t AS ({ODD_TASKS}) SELECT file, 'missing_type' AS rule FROM t WHERE NOT contains(value, 'TYPE=') UNION ALL SELECT file, 'tr_not_numeric' FROM t WHERE contains(value, '[fast]') UNION ALL SELECT file, 'sign_in_name' FROM t WHERE contains(value, 'a+b') UNION ALL SELECT file, 'lengths_differ' FROM t WHERE contains(value, 'DURATION=[1,2]') UNION ALL SELECT file, 'groups_differ' FROM t WHERE contains(value, 'NAME=[c]')",
    ),
    "pipeline_validate": (
        lambda s, d: X.pipeline_validate(in_spark(s, d, ODD_OPTIONS)),
        "WITH n AS (SELECT cast(n_nationkey AS bigint) AS file, n_nationkey, n_regionkey FROM {nation}) SELECT file, 'motcor' AS step, 'not_a_value' AS rule FROM n WHERE n_nationkey % 12 >= 10 UNION ALL SELECT file, 'detrend', 'automatic_not_alone' FROM n WHERE n_regionkey = 1 UNION ALL SELECT file, 'blur', 'unknown_step' FROM n WHERE n_regionkey = 2",
    ),
    "layout_discover": (
        lambda s, d: X.layout_discover(in_spark(s, d, PATHS)).select("subject", "session", "task", "run", "bold", "events"),
        f"WITH p AS (SELECT path, regexp_extract(path, 'sub-([A-Za-z0-9]+)', 1) AS subject, regexp_extract(path, 'ses-([0-9]+)', 1) AS session, regexp_extract(path, 'run-([0-9]+)', 1) AS run FROM ({PATHS}) q) SELECT subject, session, 't' AS task, run, min(path) FILTER (path LIKE '%bold.nii%') AS bold, min(path) FILTER (path LIKE '%events.tsv') AS events FROM p GROUP BY subject, session, run HAVING bold IS NOT NULL",
    ),
    "split_half_resamples": (lambda s, d: _resampled(s, d).groupBy("resample").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("half") == 1).cast("bigint")).alias("first")), "WITH sd AS (SELECT DISTINCT subject FROM ({series_daily}) q) SELECT unnest(range(0, 6)) AS resample, count(*) AS n, cast(floor(count(*) / 2) AS bigint) AS first FROM sd"),
    "model_gnb_group": (lambda s, d: rounded(M.model_gnb_group(_samples(s, d), _resampled(s, d)), "R"), None),
    "model_glm_group": (lambda s, d: rounded(M.model_glm_group(fixture(s, d, "series_daily"), _mean(s, d), _resampled(s, d)), "R"), None),
    "model_seed_corr_group": (lambda s, d: rounded(M.model_seed_corr_group(fixture(s, d, "series_daily"), fixture(s, d, "binary_maps").filter("b = 1 AND subject = 'signup'").select("unit"), _resampled(s, d)), "R"), None),
    "artifact_priors": (
        lambda s, d: _priors(_gradients(s, d)),
        None,
    ),
    "canoncorr_single": (
        lambda s, d: rounded(M.multiple_correlation(fixture(s, d, "metric_grid"), "P", ["R", "MOT_corr"], ["pipeline_id"]), "r", digits=5),
        "WITH mg AS ({metric_grid}), c AS (SELECT pipeline_id, corr(P, R) AS a, corr(P, MOT_corr) AS b, corr(R, MOT_corr) AS c FROM mg GROUP BY pipeline_id) SELECT pipeline_id, round(sqrt((a * a + b * b - 2 * a * b * c) / (1 - c * c)), 5) AS r FROM c",
    ),
    "model_ergnb": (
        lambda s, d: rounded(M.model_ergnb(_windows(s, d), []), "ratio", digits=5),
        "WITH sd AS ({series_daily}), o AS (SELECT DISTINCT unit, onset_t, onset_t % 4 AS block FROM ({task_onsets}) k), l AS (SELECT unit, onset_t, block, lag FROM o, (VALUES (0), (1), (2), (3)) v(lag)), w AS (SELECT unit, lag, block, avg(y) AS y FROM sd JOIN l USING (unit) WHERE sd.t = l.onset_t + l.lag GROUP BY 1, 2, 3), g AS (SELECT unit, lag, avg(y) AS m, var_samp(y) AS v FROM w GROUP BY 1, 2) SELECT unit, round(var_samp(m) / nullif(avg(v), 0), 5) AS ratio FROM g GROUP BY unit",
    ),
    "rv_coefficient": (
        lambda s, d: rounded(M.rv_coefficient(fixture(s, d, "metric_grid"), ["P", "R"], ["MOT_corr", "GS_fract"], ["subject"]), "rv"),
        """WITH c AS (SELECT subject, covar_samp(P, P) AS pp, covar_samp(P, R) AS pr, covar_samp(R, R) AS rr, covar_samp(MOT_corr, MOT_corr) AS mm, covar_samp(MOT_corr, GS_fract) AS mg, covar_samp(GS_fract, GS_fract) AS gg, covar_samp(P, MOT_corr) AS pm, covar_samp(P, GS_fract) AS pg, covar_samp(R, MOT_corr) AS rm, covar_samp(R, GS_fract) AS rg FROM ({metric_grid}) q GROUP BY subject)
        SELECT subject, round((pm * pm + pg * pg + rm * rm + rg * rg) / sqrt((pp * pp + 2 * pr * pr + rr * rr) * (mm * mm + 2 * mg * mg + gg * gg)), 6) AS rv FROM c""",
    ),
}


def _gradients(s, d):
    from gridwise.operators.lattice import lattice_gradient

    return stored(lattice_gradient(lattice_means(s, d), "v", ["subject"]), "gradients")  # read twice


def _priors(g):
    fraction = g.groupBy("subject").agg(F.avg((F.col("v") > 10).cast("int")).alias("fraction"))
    return rounded(M.multiple_correlation(g, "v", ["fx", "fy_", "fz"], ["subject"]).join(fraction, "subject"), "r", "fraction", digits=5)


def _windows(s, d):
    onsets = fixture(s, d, "task_onsets").select("unit", "onset_t").distinct().withColumn("block", F.col("onset_t") % 4)
    lags = onsets.select("unit", "onset_t", "block", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("lag")).withColumn("t", F.col("onset_t") + F.col("lag"))
    return lags.join(fixture(s, d, "series_daily"), ["unit", "t"]).groupBy("unit", "lag", "block").agg(F.avg("y").alias("y"))
