"""Files written by the tests and read back."""

from __future__ import annotations

import gzip

import numpy as np

from gridwise.sources import text, volumes


def test_volume_round_trip(spark, tmp_path):
    y = np.arange(2 * 3 * 4 * 5, dtype=float).reshape(24, 5)
    (tmp_path / "a.nii").write_bytes(volumes.encode_volume(y, (2, 3, 4)))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(volumes.encode_volume(y[:, :2], (2, 3, 4))))
    rows = volumes.volume_scan(spark, f"{tmp_path}/*").collect()
    a = {r.unit: r for r in rows if r.path.endswith("a.nii")}
    assert len(rows) == 48 and [a[i].y for i in range(24)] == y.tolist()
    assert (a[23].x, a[23].y_, a[23].z) == (1, 2, 3)
    assert sorted(r.frames for r in volumes.volume_frames(spark, f"{tmp_path}/*").collect()) == [2, 5]


def test_big_endian_and_scaled(tmp_path):
    head = bytearray(352)
    import struct

    struct.pack_into(">i", head, 0, 348)
    struct.pack_into(">8h", head, 40, 4, 2, 1, 1, 2, 1, 1, 1)
    struct.pack_into(">2h", head, 70, 4, 16)
    struct.pack_into(">3f", head, 108, 352.0, 2.0, 1.0)
    y, shape = volumes.decode_volume(bytes(head) + np.array([1, 2, 3, 4], ">i2").tobytes())
    assert shape == (2, 1, 1, 2) and y.tolist() == [[3.0, 7.0], [5.0, 9.0]]


def test_maps_to_volumes(spark, tmp_path):
    maps = spark.createDataFrame([("p", 1, 2.5), ("q", 0, 1.0)], "item string, unit long, v double")
    volumes.write_maps(maps, spark.range(4).withColumnRenamed("id", "unit"), f"{tmp_path}/m", (2, 2, 1), "item", "v")
    got = {r.item: volumes.decode_volume(bytes(r.content))[0][:, 0].tolist() for r in spark.read.parquet(f"{tmp_path}/m").collect()}
    assert got == {"p": [0, 2.5, 0, 0], "q": [1.0, 0, 0, 0]}
    volumes.write_results(maps, f"{tmp_path}/r", "item")
    assert spark.read.parquet(f"{tmp_path}/r").count() == 2


def test_text_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text("in=/a.nii OUT=/o drop=[2,3]\n\nIN=/b.nii,/c.nii OUT=/p,/q STRUCT=/s\n")
    m = {r.line: r for r in text.manifest_scan(text.read_lines(spark, f"{tmp_path}/m.txt")).collect()}
    assert (m[0]["in"], m[0].drop_first, m[0].drop_last, m[0].struct) == ("/a.nii", 2, 3, None)
    assert m[2].out == "/p,/q" and m[2].drop_first == 0
    (tmp_path / "p.1D").write_text("1 2.5\n -3  4e1\n")
    assert [(r.row, r.column, r.value) for r in text.matrix_scan(text.read_lines(spark, f"{tmp_path}/p.1D")).orderBy("row", "column").collect()] == [(0, 0, 1.0), (0, 1, 2.5), (1, 0, -3.0), (1, 1, 40.0)]
    (tmp_path / "e.tsv").write_text("onset\tduration\ttrial_type\n1.5\t2\ta\nn/a\t2\ta\n0.5\t1\ta\n")
    assert [tuple(x) for x in text.events_scan(spark, f"{tmp_path}/e.tsv").first().events] == [(0.5, 1.0), (1.5, 2.0)]


def test_task_groups_must_agree(spark):
    rows = [("a", "UNIT=[sec] TR_MSEC=[2000] NAME=[x] ONSETS=[1,2] DURATION=[3,4]"), ("b", "NAME=[x] ONSETS=[1]")]
    got = {r.file: r for r in text.task_scan(spark.createDataFrame(rows, "file string, value string")).collect()}
    assert got["a"].cond[0].onset == [1.0, 2.0] and got["a"].unit == "sec" and got["b"].cond is None


def test_task_rules(spark):
    good = "UNIT=[sec] TR_MSEC=[2000] TYPE=[Block] SEED=[/s.nii] SPM=[corr] CONN_METRIC=[r] NAME=[x] ONSETS=[1, 2] DURATION=[3,4]"
    texts = {"good": good, "sign": good.replace("[x]", "[x-y]"), "lengths": good.replace("[3,4]", "[3]"), "groups": good + " NAME=[z]", "tr": good.replace("2000", "?"), "onset": good.replace("1, 2", "1, b"), "bare": "", "null": None}
    table = spark.createDataFrame(list(texts.items()), "file string, value string")
    scan = {r.file: r for r in text.task_scan(table).collect()}
    assert (scan["good"].type, scan["good"].seed, scan["good"].spm, scan["good"].conn_metric) == ("block", "/s.nii", "corr", "r")
    assert scan["good"].cond[0].onset == [1.0, 2.0] and all(scan[k].cond is None for k in ("sign", "lengths", "groups"))
    assert scan["tr"].tr_ms is None and scan["onset"].cond[0].onset == [1.0, None] and scan["bare"].cond == []
    found = {(r.file, r.rule) for r in text.task_validate(table).collect()}
    missing = {(f, f"missing_{k}") for f in ("bare", "null") for k in ("unit", "type", "tr_msec")}
    assert found == missing | {("sign", "sign_in_name"), ("lengths", "lengths_differ"), ("groups", "groups_differ"), ("tr", "tr_not_numeric"), ("onset", "time_not_numeric")}


def test_option_rules(spark):
    texts = {"good": "MOTCOR=[0,1]\nSMOOTH=[0, 6.5]\nDETREND=[A]", "unknown": "BLUR=[1]", "beside": "detrend=[a,2]", "digits": "CENSOR=[10]\nSMOOTH=[x]\nTASK=[]", "null": None}
    found = {(r.file, r.step, r.rule) for r in text.pipeline_validate(spark.createDataFrame(list(texts.items()), "file string, value string")).collect()}
    assert found == {("unknown", "blur", "unknown_step"), ("beside", "detrend", "automatic_not_alone"), ("digits", "censor", "not_a_value"), ("digits", "smooth", "not_a_value"), ("digits", "task", "not_a_value")}


def test_manifest_rules(spark):
    lines = ["IN=/a OUT=/o DROP=[1,0] TASK=/t PHYSIO=/p", "IN=/b OUT=/o DROP=[x,0] TASK=/u STRUCT=/s", "OUT=/q,/r DROP=[1]", "IN=/a,/a,/a,/a OUT=/w CUSTOMREG=/m", "TASK=/t"]
    manifest = text.manifest_scan(spark.createDataFrame(list(enumerate(lines)), "line long, value string"))
    found = sorted((r.line, r.rule) for r in text.manifest_validate(manifest).collect())
    assert found == sorted([
        (0, "partial_struct"), (1, "repeated_out"), (1, "drop_not_numeric"), (1, "partial_physio"), (2, "missing_in"), (2, "drop_not_numeric"), (2, "partial_task"), (2, "partial_struct"), (2, "partial_physio"),
        (3, "in_out_differ"), (3, "many_runs"), (3, "missing_drop"), (3, "partial_task"), (3, "partial_struct"), (3, "partial_physio"), (4, "missing_in"), (4, "missing_out"), (4, "missing_drop"), (4, "partial_struct"), (4, "partial_physio"),
    ])
    files = spark.createDataFrame([("/a",), ("/t",), ("/t",), ("/p.puls.1D",)], "path string")
    tasks = text.task_scan(spark.createDataFrame([("/t", "NAME=[x] ONSETS=[1] DURATION=[1]"), ("/u", "NAME=[y] ONSETS=[1] DURATION=[1]")], "file string, value string"))
    more = sorted((r.line, r.rule) for r in text.manifest_validate(manifest, files, tasks, ["x"]).collect())
    assert sorted(set(more) - set(found)) == [(0, "no_file_physio"), (1, "no_file_in"), (1, "no_file_struct"), (1, "no_file_task"), (1, "unknown_condition"), (3, "no_file_customreg")]
    assert text.manifest_validate(manifest.limit(0)).count() == 0
