"""Queries of models over contrasts and resamples, and of design checks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from gridwise.fixtures import CELLS, dense, fixture, in_spark, lines
from gridwise.operators import compromise as P
from gridwise.operators import gram as G
from gridwise.operators import groups
from gridwise.operators import halves as H
from gridwise.operators import models as M
from gridwise.operators import resampled as R
from gridwise.operators import selection as C
from gridwise.operators import series as S
from gridwise.operators.stats import rounded
from gridwise.shared import shared_folder
from gridwise.plans.linear import K, _classes, _energy, _grams, _half, _packed, _regressors
from gridwise.sources import text as X
from gridwise.sources import volumes

SLICE = CELLS[2].removesuffix(" AS z")
SUBJECTS = ("click", "error", "purchase", "signup", "view")


def _contrasts():
    """Thirds of each three days against each other."""
    pair = lambda a, b: lambda t: np.where(np.arange(t) % 3 == a, -1, np.where(np.arange(t) % 3 == b, 1, 0))
    return {"0-1": pair(0, 1), "0-2": pair(0, 2), "1-2": pair(1, 2)}


def _across(s, d):
    return G.gram(R.concatenated(fixture(s, d, "series_daily"), SUBJECTS), ["all"])


def _shared_units(s, d):
    """Maps of the units that every subject has, a value a subject."""
    m = fixture(s, d, "subject_maps").groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("subject", "value"))), lambda p: p["value"]).alias("y"), F.count(F.lit(1)).alias("n"))
    top = m.agg(F.max("n").alias("top"))  # units that every subject has
    return m.crossJoin(F.broadcast(top)).filter("n = top").select(F.lit(1).alias("all"), "unit", "y")


def _one_pipeline(s, d):
    """Metrics of each subject over the whole grid, as those of one pipeline."""
    return fixture(s, d, "metric_grid").groupBy("subject").agg(F.lit(1).cast("bigint").alias("pipeline_id"), *(F.avg(c).alias(c) for c in ("P", "R", "MOT_corr")))


def _compromise(s, d):
    return P.distatis(P.feature_similarity(fixture(s, d, "metric_grid"), "pipeline_id", "subject", ["P", "R", "MOT_corr"]))


#: Cells of a volume file: an axis holds 32,767 at most, and a file is one value of a row.
SLAB = 4096


def _volumes(s, d):
    """Each subject's grid as the bytes of volume files, one for each slab of its cells, and their path."""
    packed = S.to_packed(fixture(s, d, "lattice_series"), ["subject", "unit"]).withColumn("slab", F.floor(F.col("unit") / SLAB))

    def run(frame):
        import pandas as pd

        y = np.stack(frame.sort_values("unit")["y"].to_numpy())
        return pd.DataFrame({"path": [f"/d/{frame['subject'].iloc[0]}.nii"], "content": [volumes.encode_volume(y, (len(y), 1, 1))]})

    return packed.groupBy("subject", "slab").applyInPandas(run, "path string, content binary")


#: pipeline_id, order of drift, regressors to take out and to fit but keep, low-pass.
PIPELINES = [(1, 1, [], [], 0), (2, 2, ["flat"], [], 0), (3, 1, ["flat"], ["task"], 0), (4, 3, ["flat"], ["task"], 1)]


def _optimum(s, d):
    """Subjects by name: two pipelines for all, one by name."""
    own = fixture(s, d, "series_daily").select("subject").distinct().withColumn("ind", 1 + F.length("subject") % 4)
    chosen = {"CON": F.lit(2), "FIX": F.lit(3), "MIN": F.lit(1), "MAX": F.lit(4), "IND": F.col("ind")}
    schemes = F.array(*(F.struct(F.lit(n).alias("scheme"), c.cast("long").alias("pipeline_id")) for n, c in chosen.items()))
    return own.select("subject", F.explode(schemes).alias("c")).select("subject", "c.*")


def _kinds(s, d):
    """The mean of all units as `flat`, the response to busy days as `task`."""
    flat = _regressors(s, d).filter("k = 1").select("subject", F.lit("flat").alias("kind"), "k", F.col("y").alias("w"))
    task = S.to_packed(_regressor(s, d), K, y="x").select("subject", F.lit("task").alias("kind"), F.lit(1).cast("long").alias("k"), F.col("x").alias("w"))
    return flat.unionByName(task)


def _applied(s, d, scheme):
    pipelines = s.createDataFrame(PIPELINES, "pipeline_id long, drift int, remove array<string>, keep array<string>, lowpass int")
    weights = fixture(s, d, "binary_maps").select("subject", "unit", ((1 + F.col("b")) / 2).alias("weight"))
    return R.apply_optimum(_packed(s, d), _optimum(s, d), pipelines, _kinds(s, d), K, 2.0, scheme, weights, keep_mean=True)


def _drift(s, d, order):
    return lambda df: G.apply_operators(df, G.denoise_operators(_regressors(s, d).filter("k = 1"), K, order, False), K)


def _busy(s, d):
    """Onsets of each subject: days with more events than its days have on average."""
    from pyspark.sql import Window

    n = fixture(s, d, "cond_events").groupBy(F.col("cond").alias("subject"), "onset_t").agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") > 0).withColumn("m", F.avg("n").over(Window.partitionBy("subject"))).filter("n > m")


def _regressor(s, d):
    return R.event_regressor(_busy(s, d), K, 30, 2.0)


def _resamples(s, d):
    return M.split_half_resamples(fixture(s, d, "series_daily").select("subject").distinct(), 6)


def _whole_slices(s, d):
    """Series of whole slices: the given rows are dealt out by slice, so that its units meet without an exchange of what is dense."""
    series, times = lines(s, d, "lattice_series", deal=SLICE)
    return dense(series, times, ["_deal"]).withColumnRenamed("_deal", "z")


def _event_windows(s, d):
    """Window averages around each subject's busy days, the subject as block."""
    lags = _busy(s, d).select("subject", "onset_t", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("lag")).withColumn("t", F.col("onset_t") + F.col("lag"))
    return lags.join(fixture(s, d, "series_daily"), ["subject", "t"]).groupBy("unit", "lag", F.col("subject").alias("block")).agg(F.avg("y").alias("y"))


def _group_pairs(s, d):
    out = None
    for name, classes in _contrasts().items():
        one = R.model_lda_group(_across(s, d), len(SUBJECTS), 30, classes, R.block_resamples(len(SUBJECTS))).withColumn("contrast", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("all").agg(F.avg("R").alias("R"), F.avg("P").alias("P"), F.count(F.lit(1)).alias("pairs"))


#: Three numbers of each order line as whitespace-separated text.
MATRIX = "SELECT cast(l_orderkey * 10 + l_linenumber AS bigint) AS line, concat(cast(cast(l_quantity AS int) AS varchar(9)), '  ', cast(l_linenumber AS varchar(2)), ' -', cast(l_suppkey AS varchar(9))) AS value FROM {lineitem}"
ONSETS = "SELECT subject AS line, string_agg(concat(cond, '=', onset_t, ':', duration), ' ') AS value FROM ({cond_events}) ce GROUP BY subject"
SIDECAR = """SELECT cast(n_nationkey AS bigint) AS file, concat(chr(123), '"RepetitionTime": ', n_regionkey + 1, '.5, "TaskName": "', n_name, '"', chr(125)) AS value FROM {nation}"""


def _written(s, d):
    path = f"{shared_folder(s)}/results-{uuid.uuid4().hex}"
    volumes.write_results(fixture(s, d, "metric_grid").select("subject", "pipeline_id", "P"), path, "subject")
    return s.read.parquet(path)


def _written_maps(s, d):
    path = f"{shared_folder(s)}/maps-{uuid.uuid4().hex}"
    maps = fixture(s, d, "subject_maps").withColumn("item", F.col("subject").cast("string"))
    volumes.write_maps(maps.select("item", "unit", "value"), s.range(200).withColumnRenamed("id", "unit"), path, (200, 1, 1), "item", "value")
    return volumes.decoded(s.read.parquet(path).select(F.col("item").alias("path"), "content")).filter(F.get("y", F.lit(0)) != 0)


QUERIES = {
    "model_erglm": (lambda s, d: rounded(M.model_glm(S.split_half_time(fixture(s, d, "series_daily"), K), _regressor(s, d), K).select("subject", "unit", "R", "z"), "R", "z", digits=4), None),
    "model_erglm_group": (lambda s, d: rounded(M.model_glm_group(fixture(s, d, "series_daily"), _regressor(s, d), _resamples(s, d)), "R", digits=5), None),
    "model_ergnb_group": (lambda s, d: rounded(M.model_ergnb(_event_windows(s, d), []), "ratio", digits=5), None),
    "model_multi_lda_group": (lambda s, d: rounded(_group_pairs(s, d), "R", "P", digits=5), None),
    "model_gconn_partial": (lambda s, d: rounded(R.model_gconn_partial(_packed(s, d), _grams(s, d), K), "gconn"), None),
    "censor_interpolate_slice": (
        lambda s, d: _energy(G.censor_busiest(_whole_slices(s, d), ["subject", "z"])),
        None,
    ),
    "matrix_scan": (
        lambda s, d: X.matrix_scan(in_spark(s, d, MATRIX)).groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).withColumn("column", F.col("column").cast("bigint")),
        "SELECT 0 AS column, count(*) AS n, cast(sum(cast(l_quantity AS int)) AS double) AS total FROM {lineitem} UNION ALL SELECT 1, count(*), cast(sum(l_linenumber) AS double) FROM {lineitem} UNION ALL SELECT 2, count(*), cast(-sum(l_suppkey) AS double) FROM {lineitem}",
    ),
    "onset_list_scan": (lambda s, d: X.onset_list_scan(in_spark(s, d, ONSETS)), "WITH ce AS ({cond_events}) SELECT subject AS line, cond, cast(onset_t AS double) AS onset, cast(duration AS double) AS duration FROM ce"),
    "sidecar_events_scan": (lambda s, d: X.sidecar_scan(in_spark(s, d, SIDECAR)), "SELECT cast(n_nationkey AS bigint) AS file, n_regionkey + 1.5 AS tr, n_name AS task FROM {nation}"),
    "result_sink": (lambda s, d: _written(s, d).select(F.col("subject").cast("bigint").alias("subject"), "pipeline_id", F.round("P", 6).alias("P")), "WITH mg AS ({metric_grid}) SELECT subject, pipeline_id, round(P, 6) AS P FROM mg"),
    "map_sink_grid": (lambda s, d: _written_maps(s, d).select(F.col("path").alias("item"), "unit", F.round(F.get("y", F.lit(0)), 9).alias("value")), "WITH mp AS ({subject_maps}) SELECT cast(subject AS varchar) AS item, unit, round(value, 9) AS value FROM mp WHERE value <> 0"),
    "independent_columns": (lambda s, d: R.independent_columns(_regressors(s, d).unionByName(_regressors(s, d).filter("k = 1").withColumn("k", F.lit(3).cast("bigint")).withColumn("y", F.transform("y", lambda v: 2 * v))), K), None),
    "design_condition": (lambda s, d: rounded(R.design_condition(_regressors(s, d), K, 2), "condition", digits=4), None),
    "multi_contrast": (lambda s, d: rounded(R.multi_contrast(_grams(s, d), K, _contrasts(), _half), "R", "P", "Acc", "dPR", digits=5), None),
    "model_multi_lda": (lambda s, d: rounded(R.model_multi_lda(_grams(s, d), K, _contrasts(), _half), "R", "P", "dPR_avg", digits=5), None),
    "model_svm": (lambda s, d: rounded(R.model_svm(_grams(s, d), K, _classes, _half), "R", "Acc", "dPR", digits=4), None),
    "model_lda_group": (lambda s, d: rounded(R.model_lda_group(_across(s, d), len(SUBJECTS), 30, _classes, R.block_resamples(len(SUBJECTS))), "R", "P", "Acc", "dPR", digits=5), None),
    "component_match": (lambda s, d: rounded(R.component_match(_grams(s, d), K, 4, _half), "r", digits=5), None),
    "gaussian_gen_error": (lambda s, d: rounded(R.gaussian_gen_error(_grams(s, d), K, 3, _half), "error", digits=3), None),
    "split_half_pca": (lambda s, d: rounded(H.split_half_pca(_shared_units(s, d), ["all"], 3)[0].drop("all"), "R", "positive", "variance", digits=5), None),
    "split_half_pca_map": (lambda s, d: rounded(H.split_half_pca(_shared_units(s, d), ["all"], 3, level=0.05)[1].drop("all"), "z", digits=4), None),
    "split_half_pca_subjects": (lambda s, d: rounded(H.split_half_pca(_shared_units(s, d), ["all"], 3)[2].drop("all"), "weight", digits=5), None),
    "apply_optimum": (lambda s, d: _applied(s, d, "ALL").select("subject", "scheme", "pipeline_id", F.explode("y").alias("v")).groupBy("subject", "scheme", "pipeline_id").agg(F.round(F.sum(F.col("v") * F.col("v")), 3).alias("energy")), None),
    "single_pipeline_output": (
        # the grid of one step alone, which one pipeline tests, beside the whole grid, which is left to selection
        lambda s, d: C.single_pipeline_output(_one_pipeline(s, d)).unionByName(C.single_pipeline_output(fixture(s, d, "metric_grid").select("subject", "pipeline_id", "P", "R", "MOT_corr"))).select("subject", "pipeline_id", *(F.round(c, 6).alias(c) for c in ("P", "R", "MOT_corr"))),
        "WITH mg AS ({metric_grid}) SELECT subject, cast(1 AS bigint) AS pipeline_id, round(avg(P), 6) AS P, round(avg(R), 6) AS R, round(avg(MOT_corr), 6) AS MOT_corr FROM mg GROUP BY subject",
    ),
    "single_pipeline_data": (lambda s, d: _energy(_drift(s, d, 1)(_packed(s, d))), None),
    "single_subject_override": (lambda s, d: C.single_subject_override(C.select_ind(fixture(s, d, "metric_grid")).withColumns({c: F.lit(v).cast("bigint") for c, v in (("fix", 1), ("min", 2), ("max", 3))})), "WITH mg AS ({metric_grid}) SELECT subject, pipeline_id AS ind, 1 AS fix, 2 AS min, 3 AS max FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY dPR - CASE WHEN XCond >= 1000 THEN 1e6 ELSE 0e0 END DESC, pipeline_id) AS k FROM mg) q WHERE k = 1"),
    "bootstrap_2sample": (lambda s, d: rounded(groups.bootstrap_2sample(fixture(s, d, "sample_matrix"), "y", "unit", "sample", "class", 0, 1), "ratio", "p"), None),
    "bootstrap_paired": (
        lambda s, d: rounded(groups.bootstrap_1sample(fixture(s, d, "sample_matrix").groupBy("unit", "class").agg((F.avg(F.when(F.col("half") == 2, F.col("y"))) - F.avg(F.when(F.col("half") == 1, F.col("y")))).alias("d")).filter("d IS NOT NULL"), "d", "unit", "class"), "ratio", "p"),
        None,
    ),
    "distatis": (lambda s, d: rounded(_compromise(s, d)[0], "weight", "explained", digits=5), None),
    "distatis_scores": (lambda s, d: rounded(_compromise(s, d)[1], "f1", "f2", "share1", "share2", "x", "y", "major", "minor", digits=4).drop("angle"), None),
    "model_param_check": (
        lambda s, d: R.model_param_check(fixture(s, d, "cond_events").groupBy("subject").agg(F.max("duration").alias("m"), F.min("cond").alias("c")).select("subject", F.create_map(F.lit("wind"), F.nullif(F.col("m"), F.lit(1)).cast("string"), F.lit("seed"), F.nullif(F.col("c"), F.lit("click"))).alias("params")), {"wind": (False, "10"), "seed": (True, None), "drf": (False, "0.5")}),
        "WITH ce AS ({cond_events}), p AS (SELECT subject, max(duration) AS m, min(cond) AS c FROM ce GROUP BY subject) SELECT subject, 'wind' AS param, CASE WHEN m = 1 THEN '10' ELSE cast(m AS varchar) END AS value, 0 AS violation FROM p UNION ALL SELECT subject, 'seed', CASE WHEN c = 'click' THEN NULL ELSE c END, CASE WHEN c = 'click' THEN 1 ELSE 0 END FROM p UNION ALL SELECT subject, 'drf', '0.5', 0 FROM p",
    ),
    "volume_scan": (
        lambda s, d: volumes.decoded(_volumes(s, d)).select("path", F.aggregate("y", F.lit(0.0), lambda a, b: a + b).alias("v")).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("total")),
        "WITH ls AS ({lattice_series}) SELECT '/d/' || subject || '.nii' AS path, count(DISTINCT unit) AS n, round(sum(y), 3) AS total FROM ls GROUP BY subject",
    ),
    "volume_frames": (lambda s, d: volumes.frames(_volumes(s, d)).groupBy("path").agg(F.max("frames").alias("frames")), "WITH ls AS ({lattice_series}) SELECT '/d/' || subject || '.nii' AS path, count(DISTINCT t) AS frames FROM ls GROUP BY subject"),
}
