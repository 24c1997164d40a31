"""Queries of pipeline selection and rank statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwise.fixtures import fixture
from gridwise.operators import selection as S
from gridwise.operators import stats as T
from gridwise.operators.stats import rounded

STEPS = ["motcor", "gspc", "censor"]
IDEAL = {"motcor": 1.0, "censor": 1.0, "gspc": 0.0}


def _grid(spark, d):
    return fixture(spark, d, "metric_grid")


_PEN = "dPR - CASE WHEN XCond >= 1000 THEN 1e6 ELSE 0e0 END"
_KEPT = "kept AS (SELECT * FROM mg WHERE pipeline_id IN (SELECT pipeline_id FROM mg GROUP BY pipeline_id HAVING max(XCond) < 1000))"
_RANKED = "ranked AS (SELECT pipeline_id, subject, rank() OVER (PARTITION BY subject ORDER BY dPR) + (count(*) OVER (PARTITION BY subject, dPR) - 1) / 2.0 AS r FROM kept)"
_MED = "med AS (SELECT pipeline_id, median(r) AS median_rank FROM ranked GROUP BY pipeline_id)"
_WITH = "WITH mg AS ({metric_grid})"


def _controlled_sql(step: str, artifact: str, score: str = _PEN, source: str = "mg", more: str = "") -> str:
    return f"""{_WITH}{more},
      s AS (SELECT *, {score} AS score, {artifact} AS a FROM {source}),
      free AS (SELECT subject, pipeline_id, a FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, pipeline_id) AS k FROM s) q WHERE k = 1),
      held AS (SELECT subject, pipeline_id, a FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score - 1e6 * (1 - {step}) DESC, pipeline_id) AS k FROM s) q WHERE k = 1),
      lim AS (SELECT avg(a) + 2.3 * stddev_samp(a) AS v FROM held)
      SELECT free.subject, CASE WHEN free.a > lim.v THEN held.pipeline_id ELSE free.pipeline_id END AS ind FROM free JOIN held USING (subject), lim"""


_FOLD = "abs(GS_fract - 0.5) + 0.5"
_MOTION_LIMIT = f""",
      h0 AS (SELECT MOT_corr AS a FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY {_PEN} - 1e6 * (1 - motcor) DESC, pipeline_id) AS k FROM mg) q WHERE k = 1),
      l0 AS (SELECT avg(a) + 2.3 * stddev_samp(a) AS v FROM h0),
      mg2 AS (SELECT mg.*, l0.v AS lim0 FROM mg, l0)"""

#: The optimal set holds what differs from the best median rank by less than a difference of two means; the 97.5 % point of t by its expansion in
#: the degrees of freedom (55 at least here, where it is right to six places).
CHOSEN = f"""{_WITH}, {_KEPT}, {_RANKED}, {_MED}, n AS (SELECT count(DISTINCT subject) AS n, count(DISTINCT pipeline_id) AS s FROM kept),
      q AS (SELECT n, s, 12 * n / (s * (s + 1)) * (SELECT sum(power(m - (s + 1) / 2, 2)) FROM (SELECT avg(r) AS m FROM ranked GROUP BY pipeline_id) a) AS q FROM n),
      e AS (SELECT n, (n - 1) * (s - 1) AS df, greatest(0, s * (s + 1) / 12 * (n * (s - 1) - q)) / ((n - 1) * (s - 1)) AS residual FROM q),
      z AS (SELECT *, 1.959963984540054e0 AS z FROM e),
      c AS (SELECT (z + (power(z, 3) + z) / (4 * df) + (5 * power(z, 5) + 16 * power(z, 3) + 3 * z) / (96 * power(df, 2)) + (3 * power(z, 7) + 19 * power(z, 5) + 17 * power(z, 3) - 15 * z) / (384 * power(df, 3))) * sqrt(2 * residual / n) AS least FROM z),
      o AS (SELECT med.pipeline_id, median_rank, (SELECT max(motcor + gspc + censor) FROM mg WHERE mg.pipeline_id = med.pipeline_id) AS done FROM med, c WHERE median_rank >= (SELECT max(median_rank) FROM med) - least),
      g AS (SELECT DISTINCT pipeline_id, CASE WHEN motcor = 1 THEN 1 ELSE 0 END + CASE WHEN censor = 1 THEN 1 ELSE 0 END + CASE WHEN gspc = 0 THEN 1 ELSE 0 END AS agree FROM mg),
      one AS (SELECT 'CON' AS scheme, (SELECT pipeline_id FROM g ORDER BY agree DESC, pipeline_id LIMIT 1) AS pipeline_id UNION ALL SELECT 'FIX', (SELECT pipeline_id FROM o ORDER BY median_rank DESC, pipeline_id LIMIT 1)
        UNION ALL SELECT 'MIN', (SELECT pipeline_id FROM o ORDER BY done, pipeline_id LIMIT 1) UNION ALL SELECT 'MAX', (SELECT pipeline_id FROM o ORDER BY done DESC, pipeline_id LIMIT 1)),
      p AS (SELECT scheme, subject, one.pipeline_id FROM (SELECT DISTINCT subject FROM mg) s, one
        UNION ALL SELECT 'IND', subject, pipeline_id FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY {_PEN} DESC, pipeline_id) AS k FROM mg) q WHERE k = 1)"""
_OPTIMA = f"""{CHOSEN} SELECT scheme, subject, pipeline_id, motcor, gspc, censor, round(P, 6) AS P, round(R, 6) AS R, round(dPR, 6) AS dPR, round(MOT_corr, 6) AS MOT_corr FROM p JOIN mg USING (subject, pipeline_id)"""

QUERIES = {
    "metric_collapse": (
        lambda s, d: rounded(S.metric_collapse(_grid(s, d)), "P", "R", "dPR", "MOT_corr", "GS", "XCond"),
        _WITH + f" SELECT subject, pipeline_id, round(avg(P), 6) AS P, round(avg(R), 6) AS R, round(avg(dPR), 6) AS dPR, round(avg(MOT_corr), 6) AS MOT_corr, round({_FOLD.replace('GS_fract', 'avg(GS_fract)')}, 6) AS GS, round(max(XCond), 6) AS XCond FROM mg GROUP BY subject, pipeline_id",
    ),
    "tied_rank": (
        lambda s, d: T.tied_rank(_grid(s, d).withColumn("v", F.round("P", 2)), "v", ["subject"]).select("subject", "pipeline_id", "rank"),
        _WITH + " SELECT subject, pipeline_id, rank() OVER (PARTITION BY subject ORDER BY round(P, 2)) + (count(*) OVER (PARTITION BY subject, round(P, 2)) - 1) / 2.0 AS rank FROM mg",
    ),
    "keepfix_condition": (lambda s, d: S.keepfix_condition(_grid(s, d)), _WITH + " SELECT pipeline_id FROM mg GROUP BY pipeline_id HAVING max(XCond) < 1000"),
    "keepfix_motion": (lambda s, d: rounded(S.keepfix_step(_grid(s, d), "motcor", "MOT_corr", ["gspc", "censor"]), "p"), None),
    "keepfix_global": (lambda s, d: rounded(S.keepfix_step(S._folded(_grid(s, d)), "gspc", "GS", ["motcor", "censor"]), "p"), None),
    "signed_rank": (
        lambda s, d: T.signed_rank(_grid(s, d).withColumn("diff", F.round(F.col("P") - F.col("R"), 4)), "diff", ["pipeline_id"]).select("pipeline_id", "n", "w"),
        _WITH + """, x AS (SELECT pipeline_id, round(P - R, 4) AS diff FROM mg), k AS (SELECT pipeline_id, diff, rank() OVER (PARTITION BY pipeline_id ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY pipeline_id, abs(diff)) - 1) / 2.0 AS r FROM x WHERE diff <> 0)
        SELECT p.pipeline_id, count(k.r) AS n, cast(coalesce(sum(CASE WHEN diff > 0 THEN r ELSE 0 END), 0) AS double) AS w FROM (SELECT DISTINCT pipeline_id FROM x) p LEFT JOIN k USING (pipeline_id) GROUP BY p.pipeline_id""",
    ),
    "friedman": (
        lambda s, d: rounded(T.friedman(_grid(s, d), "dPR", "pipeline_id", "subject").select("n_blocks", "n_treatments", "q"), "q"),
        _WITH + """, r AS (SELECT pipeline_id, rank() OVER (PARTITION BY subject ORDER BY dPR) + (count(*) OVER (PARTITION BY subject, dPR) - 1) / 2.0 AS r FROM mg),
        m AS (SELECT pipeline_id, avg(r) AS m, count(*) AS n FROM r GROUP BY pipeline_id), t AS (SELECT max(n) AS n, count(*) AS s FROM m)
        SELECT t.n AS n_blocks, t.s AS n_treatments, round(12.0 * t.n / (t.s * (t.s + 1)) * sum(power(m.m - (t.s + 1) / 2.0, 2)), 6) AS q FROM m, t GROUP BY t.n, t.s""",
    ),
    "fixed_rank": (lambda s, d: S.fixed_rank(_grid(s, d)), f"{_WITH}, {_KEPT}, {_RANKED}, {_MED} SELECT * FROM med"),
    "select_fix": (lambda s, d: S.select_fix(_grid(s, d), STEPS), None),
    "select_con": (
        lambda s, d: S.select_con(_grid(s, d).groupBy("pipeline_id").agg(*(F.first(c).alias(c) for c in STEPS)), IDEAL),
        _WITH + """, g AS (SELECT DISTINCT pipeline_id, motcor, gspc, censor FROM mg), a AS (SELECT pipeline_id, CASE WHEN motcor = 1 THEN 1 ELSE 0 END + CASE WHEN censor = 1 THEN 1 ELSE 0 END + CASE WHEN gspc = 0 THEN 1 ELSE 0 END AS agree FROM g)
        SELECT pipeline_id AS con, cast(agree AS bigint) AS agree FROM a ORDER BY agree DESC, pipeline_id LIMIT 1""",
    ),
    "select_ind": (lambda s, d: S.select_ind(_grid(s, d)), f"{_WITH} SELECT subject, pipeline_id AS ind FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY {_PEN} DESC, pipeline_id) AS k FROM mg) q WHERE k = 1"),
    "select_ind_motion": (lambda s, d: S.select_ind_motion(_grid(s, d)), _controlled_sql("motcor", "MOT_corr")),
    "select_ind_global": (lambda s, d: S.select_ind_global(_grid(s, d)), _controlled_sql("gspc", _FOLD)),
    "select_ind_both": (lambda s, d: S.select_ind_both(_grid(s, d)), _controlled_sql("gspc", _FOLD, _PEN + " - CASE WHEN MOT_corr > lim0 THEN 1e6 ELSE 0e0 END", "mg2", _MOTION_LIMIT)),
    "optimum_summary": (lambda s, d: rounded(S.optimum_summary(_grid(s, d), IDEAL), "P", "R", "dPR", "MOT_corr"), _OPTIMA),
    "dpr_select": (
        lambda s, d: _grid(s, d).withColumn("_d", T.distance_to_perfect(F.col("P"), F.col("R"))).groupBy("subject").agg(F.min_by("pipeline_id", F.struct(F.round(-F.col("_d"), 9), "pipeline_id")).alias("best")),
        _WITH + " SELECT subject, pipeline_id AS best FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(sqrt(power(1 - R, 2) + power(1 - P, 2)), 9), pipeline_id) AS k FROM mg) q WHERE k = 1",
    ),
    "fdr": (
        lambda s, d: T.fdr(_grid(s, d).withColumn("p", F.round(F.pow("GS_fract", 6), 9)), "p", ["subject"], 0.05).select("subject", "pipeline_id", F.round("critical", 9).alias("critical"), F.col("passed").cast("bigint").alias("passed")),
        _WITH + """, a AS (SELECT subject, pipeline_id, round(power(GS_fract, 6), 9) AS p FROM mg), k AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY p) AS k, count(*) OVER (PARTITION BY subject) AS n FROM a),
        r AS (SELECT *, sum(CASE WHEN p / k <= 0.05 / n THEN 1 ELSE 0 END) OVER (PARTITION BY subject) AS r FROM k), c AS (SELECT *, max(CASE WHEN k = r THEN p END) OVER (PARTITION BY subject) AS critical FROM r)
        SELECT subject, pipeline_id, round(critical, 9) AS critical, cast(CASE WHEN p <= critical THEN 1 ELSE 0 END AS bigint) AS passed FROM c""",
    ),
    "rspm": (
        lambda s, d: rounded(_two_maps(s, d).transform(lambda x: T.rspm(x, "one", "two", ["subject"])).select("subject", "unit", "R", "z"), "R", "z", digits=5),
        """WITH m AS (SELECT subject, unit, avg(CASE WHEN t < 15 THEN y END) AS one, avg(CASE WHEN t >= 15 THEN y END) AS two FROM ({series_daily}) sd GROUP BY subject, unit),
        s AS (SELECT subject, avg(one) AS m1, stddev_samp(one) AS s1, avg(two) AS m2, stddev_samp(two) AS s2, corr(one, two) AS R FROM m GROUP BY subject)
        SELECT m.subject, m.unit, round(s.R, 5) AS R, round(((one - m1) / s1 + (two - m2) / s2) / sqrt(2) / sqrt(1 - s.R), 5) AS z FROM m JOIN s USING (subject)""",
    ),
    "jaccard_matrix": (
        lambda s, d: rounded(T.jaccard_pairs(fixture(s, d, "binary_maps"), "subject", "unit", "b"), "overlap"),
        """WITH m AS ({binary_maps}) SELECT x.subject AS a, y.subject AS b, round(CASE WHEN sum(greatest(x.b, y.b)) > 0 THEN sum(x.b * y.b) / sum(greatest(x.b, y.b)) ELSE 0 END, 6) AS overlap
        FROM m x JOIN m y ON x.unit = y.unit AND x.subject < y.subject GROUP BY 1, 2""",
    ),
    "leave_self_median": (
        lambda s, d: rounded(T.leave_self_median(T.jaccard_pairs(fixture(s, d, "binary_maps"), "subject", "unit", "b")), "distance"),
        """WITH m AS ({binary_maps}), o AS (SELECT x.subject AS a, CASE WHEN sum(greatest(x.b, y.b)) > 0 THEN sum(x.b * y.b) / sum(greatest(x.b, y.b)) ELSE 0 END AS v FROM m x JOIN m y ON x.unit = y.unit AND x.subject <> y.subject GROUP BY x.subject, y.subject)
        SELECT a AS item, round(1 - median(v), 6) AS distance FROM o GROUP BY a""",
    ),
}


def _two_maps(spark, d):
    """Mean of each unit in the first and second half of the time."""
    return fixture(spark, d, "series_daily").groupBy("subject", "unit").agg(F.avg(F.when(F.col("t") < 15, F.col("y"))).alias("one"), F.avg(F.when(F.col("t") >= 15, F.col("y"))).alias("two"))
