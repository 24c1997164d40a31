"""What larger tables showed: units without spread, grids beyond a file's axis, and memory and rows that grew too fast."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise.fixtures import FIXTURES, TABLES, fixture, in_duckdb
from gridwise.operators import models as M
from gridwise.plans import resampled

SF = "/root/testdata/sf0.001"


def test_seed_correlation_of_maps_without_spread_is_undefined(spark):
    rows = [("s", u, h, t, float(u)) for u in range(4) for h in (1, 2) for t in range(5)]
    series = spark.createDataFrame(rows, "subject string, unit long, half long, t long, y double")
    got = M.model_seed_corr(series, spark.createDataFrame([(0,)], "unit long"), ["subject"]).collect()
    assert sorted((r.unit, r.one, r.two, r.R) for r in got) == [(u, 0.0, 0.0, None) for u in range(4)]


def test_correlation_leaves_out_rows_that_lack_a_value(spark):
    from gridwise.operators.stats import correlation

    table = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (None, 9.0), (50.0, None)], "a double, b double")
    assert table.agg(correlation("a", "b").alias("r")).first().r == pytest.approx(np.corrcoef([1, 2, 3], [2, 1, 5])[0, 1])


def test_series_without_fluctuation_have_no_hurst_row(spark):
    r = np.random.default_rng(5)
    rows = [("s", u, t, float(r.normal()) if u == 0 else 0.0) for u in range(2) for t in range(40)] + [("s", 2, 0, 1.0)]
    got = M.model_hurst(spark.createDataFrame(rows, "subject string, unit long, t long, y double"), ["subject", "unit"], [5, 8, 13]).collect()
    assert [x.unit for x in got] == [0] and np.isfinite(got[0].hurst)


def test_volumes_of_more_cells_than_an_axis_holds(spark, monkeypatch):
    rows = [("A", u, t, float(u + t)) for u in range(40_000) for t in range(2)]
    monkeypatch.setattr(resampled, "fixture", lambda *_: spark.createDataFrame(rows, "subject string, unit long, t long, y double"))
    scan = resampled.QUERIES["volume_scan"][0](spark, SF).collect()
    assert [(x.n, x.total) for x in scan] == [(40_000, float(sum(2 * u + 1 for u in range(40_000))))]
    assert [tuple(x) for x in resampled.QUERIES["volume_frames"][0](spark, SF).collect()] == [("/d/A.nii", 2)]


@pytest.mark.parametrize("name", ["series_daily", "lattice_series"])
def test_dense_fixtures_have_the_rows_of_their_sql_after_one_exchange(spark, name, tmp_path):
    import shutil

    import duckdb

    for t in TABLES:
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    with duckdb.connect() as c:  # a kind, a unit and values that are missing
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        c.execute(f"COPY (SELECT * REPLACE (nullif(event_type, 'view') AS event_type, nullif(user_id, 3) AS user_id, CASE WHEN event_id % 5 > 0 THEN value END AS value) FROM events) TO '{tmp_path}/events.parquet'")
        c.execute(f"COPY (SELECT * REPLACE (nullif(l_returnflag, 'R') AS l_returnflag, nullif(l_partkey, 3) AS l_partkey, CASE WHEN l_linenumber > 1 THEN l_tax END AS l_tax) FROM lineitem) TO '{tmp_path}/lineitem.parquet'")
        for t in ("events", "lineitem"):
            c.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        expected = c.sql(in_duckdb(FIXTURES[name])).fetchall()
        columns = [x[0] for x in c.sql(in_duckdb(FIXTURES[name])).description]
    got = fixture(spark, str(tmp_path), name)
    assert got.columns == columns
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r[:-1])
    a, b = sorted(map(tuple, got.collect()), key=lambda r: [(x is None, str(x)) for x in r]), sorted(expected, key=lambda r: [(x is None, str(x)) for x in r])
    assert [x[:-1] for x in a] == [x[:-1] for x in b] and np.allclose([x[-1] for x in a], [x[-1] for x in b], atol=1e-9)
    plan = got.groupBy("subject", "unit").agg(F.avg("y"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_slices_meet_before_their_matrices(spark):
    from gridwise.operators import gram as G

    r = np.random.default_rng(2)
    rows = [("s", z, u, r.normal(size=6).tolist()) for z in range(5) for u in range(7)]
    packed = spark.createDataFrame(rows, "subject string, z long, unit long, y array<double>").repartition(9)
    keys = ["subject", "z"]
    one, two = ({x.z: x for x in f(packed, keys).collect()} for f in (G.gram, G.gram_of_small_groups))
    assert one.keys() == two.keys() and all(np.allclose(one[z].gram, two[z].gram) and np.allclose(one[z].sums, two[z].sums) and one[z].n == two[z].n for z in one)
    assert "MapInPandas" not in G.gram_of_small_groups(packed, keys)._jdf.queryExecution().executedPlan().toString()


def test_responses_are_one_row_a_design(spark):
    from gridwise.operators import design as D

    on = spark.createDataFrame([(1, 3), (1, 4), (2, 80), (3, 95)], "subject long, sample long")
    got = {(x.subject, x.sample): x.v for x in D.hrf_convolve(on, ["subject"], 90, 0.1).collect()}
    w = lambda lag: np.exp(-0.1 * lag) * (D.RISE * (0.1 * lag) ** 5 - D.FALL * (0.1 * lag) ** 15) if lag >= 0 else 0.0
    assert got.keys() == {(1, s) for s in range(3, 90)} | {(2, s) for s in range(80, 90)}
    assert all(v == pytest.approx((w(s - 3) + w(s - 4)) if k == 1 else w(s - 80)) for (k, s), v in got.items())
    assert D.hrf_response(on, ["subject"], 90, 0.1).groupBy("subject").count().filter("count > 1").count() == 0
    plan = D.design_finish(D.hrf_response(on, ["subject"], 90, 0.1), ["subject"], 90, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_medians_of_times_without_a_row_a_pair(spark):
    r = np.random.default_rng(4)
    y = r.normal(size=(6, 20))
    rows = [("s", k, t, float(y[k, t])) for k in range(6) for t in range(20) if not (k == 5 and t in (3, 11))] + [("s", 9, 15, 1.0)]
    got = {x.t: x.displacement for x in M.window_median_displacement(spark.createDataFrame(rows, "subject string, k long, t long, y double"), ["subject"]).collect()}
    has = lambda k, t: not (k == 5 and t in (3, 11))
    for t in range(20):
        expected = sum((y[k, t] - np.median([y[k, u] for u in range(max(0, t - 7), min(20, t + 8)) if u != t and has(k, u)])) ** 2 for k in range(6) if has(k, t))
        assert got[t] == pytest.approx(expected)
    plan = M.window_median_displacement(spark.createDataFrame(rows, "subject string, k long, t long, y double"), ["subject"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_interpolation_of_many_rows_at_once():
    from gridwise.operators import gram as G

    y = np.random.default_rng(6).normal(size=(50, 30)).cumsum(axis=1)
    gone = {0, 7, 8, 20, 29}
    assert np.allclose(G._cubic(y, gone), [G._cubic(v, gone) for v in y])


def test_edges_of_all_maps_from_sums_of_tasks(spark):
    from gridwise.operators import canonical as C
    from gridwise.operators import gram as G

    r = np.random.default_rng(8)
    y, w, g = r.normal(size=(60, 9)), r.normal(size=(9, 3)), r.normal(size=(60, 3)) + 5
    packed = spark.createDataFrame([("s", u, y[u].tolist()) for u in range(60)], "subject string, unit long, y array<double>").repartition(7)
    parts = spark.createDataFrame([("s", i + 1, w[:, i].tolist()) for i in range(3)], "subject string, component int, w array<double>")
    slopes = spark.createDataFrame([("s", u, *map(float, g[u])) for u in range(60)], "subject string, unit long, fx double, fy_ double, fz double")
    edges = C.map_edges(packed, parts, slopes, ["subject"])
    x = np.hstack([np.ones((60, 1)), g**2])
    for row in edges.collect():
        v = (y @ w[:, row.component - 1]) ** 2
        rest = v - x @ np.linalg.lstsq(x, v, rcond=None)[0]
        assert row.edge == pytest.approx(np.sqrt(1 - (rest**2).sum() / ((v - v.mean()) ** 2).sum()))
    assert edges.count() == 3
    flat = spark.createDataFrame([("s", u, 1.0, 1.0, 1.0) for u in range(60)], "subject string, unit long, fx double, fy_ double, fz double")
    assert [row.edge for row in C.map_edges(packed, parts, flat, ["subject"]).collect()] == [0.0] * 3
    assert G.displacement(G.gram(packed, ["subject"]), ["subject"]).count() == 9
