"""Series that are held without their zeros, and what is made of them in place."""

from __future__ import annotations

import shutil

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwise import fixtures as X
from gridwise.operators import gram as G
from gridwise.operators import groups
from gridwise.operators import lattice as L
from gridwise.plans import groups as group_plans
from gridwise.plans import resampled, series, sources

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def odd(tmp_path):
    """A kind, units, months and amounts that are missing."""
    for t in X.TABLES:
        if t != "lineitem":
            shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    with duckdb.connect() as c:
        c.execute(f"COPY (SELECT * REPLACE (nullif(l_returnflag, 'R') AS l_returnflag, nullif(l_partkey, 3) AS l_partkey, CASE WHEN l_orderkey % 9 > 0 THEN l_shipdate END AS l_shipdate, CASE WHEN l_linenumber > 1 THEN l_tax END AS l_tax, CASE WHEN l_linenumber <> 2 THEN l_discount END AS l_discount) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("dealt", ["unit", "cast(floor(unit / 64) AS bigint)"])
def test_lines_are_the_packed_series_without_zeros(spark, odd, dealt):
    got, times = X.lines(spark, odd, "lattice_series", dealt)
    whole = X.packed(spark, odd, "lattice_series")
    assert whole.first().times == times and times[-1] is None
    a, b = rows(X.dense(got, times)), rows(whole.select("subject", "unit", "y"))
    assert [x[:2] for x in a] == [x[:2] for x in b] and np.allclose([x[2] for x in a], [x[2] for x in b], atol=1e-12)


def test_means_and_spread_need_no_entry_a_time(spark, odd):
    got = rows(X.lattice_means(spark, odd).select("subject", "unit", "v"))
    long = X.fixture(spark, odd, "lattice_series")
    expected = rows(long.groupBy("subject", "unit").agg(F.avg("y")))
    assert [x[:2] for x in got] == [x[:2] for x in expected] and np.allclose([x[2] for x in got], [x[2] for x in expected])
    s, times = X.lines(spark, odd, "lattice_series")
    spread = rows(s.select("subject", "unit", X.spread("line", times)[1]))
    assert np.allclose([x[2] for x in spread], [x[2] for x in rows(long.groupBy("subject", "unit").agg(F.var_samp("y")))])
    text = plan(X.lattice_means(spark, odd))
    assert "transform(" not in text and text.count("Exchange hashpartitioning") == 1


def test_perfusion_of_packed_pairs(spark, odd):
    frames = X.fixture(spark, odd, "label_control")
    pairs = group_plans._pairs(spark, odd)
    assert rows(groups.perfusion_rows(pairs)) == rows(groups.perfusion_pairs(frames.filter("t IS NOT NULL")))
    named = rows(groups.perfusion_cbf_packed(pairs).select("unit"))
    assert named == rows(frames.select("unit").filter("unit IS NOT NULL").distinct())
    for name in ("perfusion_simple", "perfusion_cbf"):
        text = plan(group_plans.QUERIES[name][0](spark, SF))
        assert "Window" not in text and "Join" not in text


def test_pairs_need_both_frames_of_even_and_odd_time(spark):
    packed = spark.createDataFrame([(1, [-2, -1, 0, 1, 3, 4, 6, 7], [float(v) for v in range(8)]), (2, [5], [1.0])], "unit long, times array<long>, y array<double>")
    long = packed.select("unit", F.explode(F.arrays_zip("times", "y")).alias("p")).select("unit", F.col("p.times").alias("t"), F.col("p.y").alias("y"))
    assert rows(groups.perfusion_rows(groups.perfusion_pairs_packed(packed))) == rows(groups.perfusion_pairs(long))


def test_busiest_time_of_a_slice_is_filled_where_its_units_meet(spark, odd):
    whole = resampled._whole_slices(spark, odd)
    keys = ["subject", "z"]
    long = X.packed(spark, odd, "lattice_series").select("subject", F.floor(F.col("unit") / 64).alias("z"), "unit", "y")
    sums = long.select(*keys, F.posexplode("y").alias("t", "v")).groupBy(*keys, "t").agg(F.sum("v").alias("v")).groupBy(*keys).agg(F.array(F.max_by("t", F.struct("v", "t"))).alias("times"))
    expected = rows(G.censor_interpolate(long, sums, keys).filter("subject IS NOT NULL AND z IS NOT NULL").select("subject", "unit", "y"))
    got = rows(G.censor_busiest(whole, keys).filter("subject IS NOT NULL AND z IS NOT NULL").select("subject", "unit", "y"))
    assert [x[:2] for x in got] == [x[:2] for x in expected] and np.allclose([x[2] for x in got], [x[2] for x in expected])


def test_layers_and_mirrors_keep_a_group_spread_over_tasks(spark):
    grid = spark.createDataFrame([(k, x, y, 0, float(x + 10 * y)) for k in ("a", None) for x in range(3 if k else 2) for y in range(2)], "k string, x long, y_ long, z long, v double")
    padded, flipped = L.lattice_pad(grid, "v", ["k"], "x", 1, 2), L.lattice_flip(grid, ["k"])
    assert "Window" not in plan(padded) and "Window" not in plan(flipped)
    assert rows(padded) == sorted([(k, x, y, 0, float(x - 1 + 10 * y) if 1 <= x <= n else 0.0) for k, n in (("a", 3), (None, 2)) for x in range(n + 3) for y in range(2)], key=lambda r: [(x is None, str(x)) for x in r])
    assert rows(flipped) == sorted([(k, x, y, 0, float(n - 1 - x + 10 * y)) for k, n in (("a", 3), (None, 2)) for x in range(n) for y in range(2)], key=lambda r: [(x is None, str(x)) for x in r])


def test_maps_that_are_read_twice_are_made_once(spark):
    for made in (series.QUERIES["mask_scatter"][0](spark, SF), sources.QUERIES["artifact_priors"][0](spark, SF)):
        assert "lineitem" not in plan(made)


def test_shares_of_units_are_not_stored_a_row_a_course(spark, monkeypatch):
    from gridwise.operators import canonical as C

    r = np.random.default_rng(3)
    runs = [r.normal(size=(9, 12)), r.normal(size=(9, 12))]
    weight = [0.1, 0.2, 0.3, 0.4, 0.9, 0.9, 0.8, 0.5, None]
    for y in runs:
        y[1] = y[0]  # equal shares
    packed = spark.createDataFrame([("s", k, u, y[u].tolist()) for k, y in enumerate(runs) for u in range(9)], "subject string, run long, unit long, y array<double>")
    tissue = spark.createDataFrame([("s", u, w) for u, w in enumerate(weight)], "subject string, unit long, weight double")
    w = np.linalg.qr(np.hstack([np.ones((12, 1)), r.normal(size=(12, 4))]))[0][:, 1:]
    courses = spark.createDataFrame([("s", k, p, w[:, p].tolist()) for k in range(2) for p in range(4)], "subject string, run long, place int, w array<double>")
    units = packed.groupBy("subject", "unit").agg(F.sort_array(F.collect_list(F.struct("run", "y"))).alias("runs")).join(tissue, ["subject", "unit"], "left").repartition(9)  # tasks without a middle value
    for row in C._median_shares(units, courses, ["subject"], "run", 0.0).collect():
        x = runs[row.run] - runs[row.run].mean(axis=1, keepdims=True)
        v = (x @ w[:, row.place]) ** 2 / (x**2).sum(axis=1)
        assert (row.outside, row.inside) == (pytest.approx(np.median(v[:4])), pytest.approx(np.median(v[4:7])))
    seen, stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, label: seen.append(df.columns) or stored(df, label))
    C.physio_components(packed, tissue, ["subject"])
    assert seen and not any("unit" in c and ("place" in c or "k" in c) for c in seen)
