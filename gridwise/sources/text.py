"""Manifests, task files and option files: bracketed text to tables, by built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of a manifest line that may be lists; steps of an options file, and those among them that take any number.
LISTED = ("in", "out", "task", "physio", "customreg")
STEPS = ("MOTCOR", "CENSOR", "RETROICOR", "TIMECOR", "SMOOTH", "DETREND", "MOTREG", "TASK", "GSPC1", "PHYPLUS", "CUSTOMREG", "LOWPASS")
NUMBER_STEPS = ("SMOOTH", "DETREND")
#: Keys that every task file has; endings of the two files that PHYSIO stands for.
TASK_KEYS = ("UNIT", "TYPE", "TR_MSEC")
PHYSIO_ENDINGS = (".puls.1D", ".resp.1D")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line (from 0, in order of file and place) of text files; each file is one split, so its lines stay in order."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    return lines.filter(F.trim("value") != "")


def _field(name: str) -> Column:
    text = F.regexp_extract("value", rf"(?i)(?:^|\s){name}=(\[[^\]]*\]|\S+)", 1)
    return F.when(text != "", F.regexp_replace(text, r"[\[\] ]", ""))


def manifest_scan(lines: DataFrame) -> DataFrame:
    """One row a line: IN, OUT, TASK, STRUCT, PHYSIO, CUSTOMREG DROP as text and its two numbers (0 by default); keys in any case."""
    drop = F.split(_field("DROP"), ",")
    number = lambda i: F.coalesce(F.get(drop, F.lit(i)).try_cast("bigint"), F.lit(0))
    fields = {n: _field(n.upper()) for n in (*LISTED, "struct")}
    return lines.select("line", *(c.alias(n) for n, c in fields.items()), _field("DROP").alias("drop"), number(0).alias("drop_first"), number(1).alias("drop_last"))


def manifest_explode_runs(manifest: DataFrame) -> DataFrame:
    """One row a run; the first run's output names the subject.  Lines whose lists differ in length are left to `manifest_validate`."""
    parts = {n: F.split(n, ",") for n in LISTED}
    n = F.size(parts["in"])
    agree = [(F.col(k).isNull() | (F.size(parts[k]) == n)) for k in LISTED if k != "in"]
    ok = agree[0]
    for a in agree[1:]:
        ok = ok & a
    runs = manifest.filter(ok & F.col("in").isNotNull()).select("line", "struct", "drop_first", "drop_last", F.split("out", ",")[0].alias("subject"), F.posexplode(F.arrays_zip(*(F.coalesce(p, F.array_repeat(F.lit(None).cast("string"), n)).alias(k) for k, p in parts.items()))).alias("run", "r"))
    return runs.select("line", "subject", (F.col("run") + 1).cast("bigint").alias("run"), *(F.col(f"r.{k}").alias(k) for k in LISTED), "struct", "drop_first", "drop_last")


def manifest_merge_runs(manifest: DataFrame) -> DataFrame:
    """Lines of one structural image become one line: lists joined in order of line, the rest from the first."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("line", c)))), lambda x: x[c]), ",")
    return manifest.groupBy("struct").agg(F.min("line").alias("line"), *(joined(c).alias(c) for c in ("in", "out", "task")), F.min_by("drop_first", "line").alias("drop_first"), F.min_by("drop_last", "line").alias("drop_last"))


def manifest_validate(manifest: DataFrame, files: DataFrame | None = None, tasks: DataFrame | None = None, contrast: Sequence[str] = ()) -> DataFrame:
    """(line, rule) of each violation, each pair once: a required field is missing, lists differ in length, more than three runs, an output that
    an earlier line has, DROP is not two whole numbers from 0 on, or TASK, STRUCT or PHYSIO is missing here but given elsewhere.

    With `files` (path), also files that are not there, by field (PHYSIO stands for two).  With `tasks` (file, cond, as `task_scan` gives them) and
    the condition names of a `contrast`, also lines one of whose task files lacks one of them; a task file that was not scanned lacks all."""
    length = lambda c: F.size(F.split(c, ","))
    given = manifest.agg(*(F.max(F.col(c).isNotNull()).alias(f"_any_{c}") for c in ("task", "struct", "physio")))
    repeated = manifest.filter("out IS NOT NULL").groupBy("out").agg(F.min("line").alias("_first"))
    x = manifest.join(repeated, "out", "left").crossJoin(F.broadcast(given))  # one row
    rules = {
        "missing_in": F.col("in").isNull(), "missing_out": F.col("out").isNull(), "missing_drop": F.col("drop").isNull(), "in_out_differ": length("in") != length("out"), "many_runs": length("in") > 3,
        "repeated_out": F.col("line") > F.col("_first"), "drop_not_numeric": ~F.col("drop").rlike("^[0-9]+,[0-9]+$"), **{f"partial_{c}": F.col(c).isNull() & F.col(f"_any_{c}") for c in ("task", "struct", "physio")},
    }
    out = x.select("line", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("rule"))
    parts = lambda c: manifest.filter(F.col(c).isNotNull()).select("line", F.explode(F.split(c, ",")).alias("path"))
    if files is not None:
        known = files.select("path").distinct()
        for field in ("in", "task", "struct", "customreg", "physio"):
            named = parts(field)
            if field == "physio":
                named = named.select("line", F.explode(F.array(*(F.concat("path", F.lit(e)) for e in PHYSIO_ENDINGS))).alias("path"))
            out = out.unionByName(named.join(known, "path", "left_anti").select("line", F.lit(f"no_file_{field}").alias("rule")))
    if tasks is not None and contrast:
        names = F.array(*map(F.lit, contrast))
        complete = tasks.filter(F.size(F.array_except(names, F.coalesce(F.transform("cond", lambda c: c["name"]), F.array().cast("array<string>")))) == 0).select(F.col("file").alias("path")).distinct()
        out = out.unionByName(parts("task").join(complete, "path", "left_anti").select("line", F.lit("unknown_condition").alias("rule")))
    return out.distinct()


def manifest_unique_struct(manifest: DataFrame) -> DataFrame:
    """The first line of each structural image; lines without one go."""
    return manifest.filter("struct IS NOT NULL").groupBy("struct").agg(F.min("line").alias("line"))


def _task_fields() -> tuple[dict[str, Column], dict[str, Column]]:
    """Texts of a task file's keys (the first of each, null without one) and of those that its conditions repeat."""
    find = lambda n: F.regexp_extract_all("value", F.lit(rf"(?i)\b{n}=\[([^\]]*)\]"), 1)
    return {n.lower(): F.get(find(n), F.lit(0)) for n in (*TASK_KEYS, "SEED", "SPM", "CONN_METRIC")}, {n.lower(): find(n) for n in ("NAME", "ONSETS", "DURATION")}


def _task_faults() -> dict[str, Column]:
    """Rules on the conditions of a task file."""
    _, lists = _task_fields()
    n = F.size(lists["name"])
    uneven = F.exists(F.arrays_zip(lists["onsets"].alias("a"), lists["duration"].alias("b")), lambda z: F.size(F.split(z["a"], ",")) != F.size(F.split(z["b"], ",")))
    return {"groups_differ": (n != F.size(lists["onsets"])) | (n != F.size(lists["duration"])), "sign_in_name": F.exists(lists["name"], lambda v: v.rlike("[-+]")), "lengths_differ": F.coalesce(uneven, F.lit(False))}


def task_scan(texts: DataFrame) -> DataFrame:
    """`value`: a whole task file.  unit, tr_ms, type, seed, spm, conn_metric and conditions (name, onsets, durations); the conditions are null where
    names, onsets and durations do not agree in number, or a name has a + or - (which contrasts are made of)."""
    one, lists = _task_fields()
    numbers = lambda s: F.transform(F.split(s, ","), lambda x: F.trim(x).try_cast("double"))
    zipped = F.arrays_zip(lists["name"].alias("name"), lists["onsets"].alias("onsets"), lists["duration"].alias("durations"))
    conditions = F.transform(zipped, lambda z: F.struct(z["name"].alias("name"), numbers(z["onsets"]).alias("onset"), numbers(z["durations"]).alias("duration")))
    faulty = F.greatest(*(c for c in _task_faults().values()))
    return texts.select("file", one["unit"].alias("unit"), one["tr_msec"].try_cast("double").alias("tr_ms"), F.lower(one["type"]).alias("type"), one["seed"].alias("seed"), one["spm"].alias("spm"), one["conn_metric"].alias("conn_metric"), F.when(~faulty, conditions).alias("cond"))


def task_validate(texts: DataFrame) -> DataFrame:
    """(file, rule) of each violation of a task file: a key that is missing, a repetition time or an onset or duration that is no number, and the rules that make
    `task_scan` leave out the conditions."""
    one, lists = _task_fields()
    bad = lambda v: F.exists(F.split(v, ","), lambda x: F.trim(x).try_cast("double").isNull())
    rules = {f"missing_{k.lower()}": one[k.lower()].isNull() for k in TASK_KEYS}
    rules |= {"tr_not_numeric": one["tr_msec"].isNotNull() & one["tr_msec"].try_cast("double").isNull(), "time_not_numeric": F.exists(F.concat(lists["onsets"], lists["duration"]), bad), **_task_faults()}
    return texts.select("file", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("rule"))


def _named(step: str):
    return lambda v: F.struct(F.lit(step).alias("step"), v.alias("value"))


def pipeline_scan(texts: DataFrame) -> DataFrame:
    """(step, value) of an options file; a step that is missing has 0, A stands for automatic drift (-1)."""
    rows = []
    for step in STEPS:
        text = F.regexp_extract("value", rf"(?i)(?:^|\s){step}=\[([^\]]*)\]", 1)
        values = F.transform(F.split(F.when(text == "", "0").otherwise(text), ","), lambda x: F.when(F.upper(F.trim(x)) == "A", -1.0).otherwise(F.trim(x).cast("double")))
        rows.append(F.transform(values, _named(step.lower())))
    return texts.select("file", F.explode(F.flatten(F.array(*rows))).alias("o")).select("file", "o.step", "o.value")


def pipeline_validate(texts: DataFrame) -> DataFrame:
    """(file, step, rule) of each violation of an options file: a step of unknown name; A (or -1) for DETREND beside other values; a value that is no number (SMOOTH,
    DETREND) or no single digit (all others)."""
    found = texts.select("file", F.explode(F.regexp_extract_all("value", F.lit(r"([A-Za-z0-9_]+=\[[^\]]*\])"), 1)).alias("_s"))
    x = found.select("file", F.upper(F.regexp_extract("_s", "^([^=]+)=", 1)).alias("step"), F.transform(F.split(F.regexp_extract("_s", r"\[([^\]]*)\]", 1), ","), lambda v: F.upper(F.trim(v))).alias("_v"))
    automatic = lambda v: (F.col("step") == "DETREND") & v.isin("A", "-1")
    number = lambda v: F.when(F.col("step").isin(*NUMBER_STEPS), automatic(v) | v.rlike(r"^[0-9]+(\.[0-9]+)?$")).otherwise(v.rlike("^[0-9]$"))
    known = F.col("step").isin(*STEPS)
    rules = {"unknown_step": ~known, "automatic_not_alone": F.exists("_v", automatic) & (F.size("_v") > 1), "not_a_value": known & F.exists("_v", lambda v: ~number(v))}
    marked = x.select("file", "step", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("rule"))
    return marked.withColumn("step", F.lower("step")).distinct()


def layout_discover(files: DataFrame) -> DataFrame:
    """subject, session, task and run of paths (`path`) laid out as sub-*/[ses-*/]func/*_bold.*, with their events and sidecar files."""
    tag = lambda n: F.nullif(F.regexp_extract("path", rf"{n}-([A-Za-z0-9]+)", 1), F.lit(""))
    kind = F.when(F.col("path").rlike(r"_bold\.nii"), "bold").when(F.col("path").rlike(r"_events\.tsv$"), "events").when(F.col("path").rlike(r"_bold\.json$"), "sidecar").when(F.col("path").rlike(r"/anat/"), "anat")
    x = files.select("path", tag("sub").alias("subject"), tag("ses").alias("session"), tag("task").alias("task"), F.coalesce(tag("run"), F.lit("1")).alias("run"), kind.alias("kind")).filter("subject IS NOT NULL AND kind IS NOT NULL")
    at = lambda k: F.min(F.when(F.col("kind") == k, F.col("path")))
    runs = x.filter("kind <> 'anat'").groupBy("subject", "session", "task", "run").agg(at("bold").alias("bold"), at("events").alias("events"), at("sidecar").alias("sidecar"))
    anat = x.groupBy("subject").agg(at("anat").alias("anat"))
    return runs.filter("bold IS NOT NULL").join(anat, "subject", "left")


def matrix_scan(lines: DataFrame) -> DataFrame:
    """Whitespace-separated numbers of lines (line, value) to (row, column, value)."""
    return lines.select(F.col("line").alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("column", "v")).select("row", "column", F.col("v").cast("double").alias("value"))


def events_scan(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated events (onset, duration, trial_type) by condition, in order of onset; rows whose onset is no number go."""
    table = spark.read.csv(path, sep="\t", header=True)
    clean = table.select("trial_type", F.col("onset").try_cast("double").alias("onset"), F.col("duration").try_cast("double").alias("duration")).filter("onset IS NOT NULL")
    return clean.groupBy("trial_type").agg(F.array_sort(F.collect_list(F.struct("onset", "duration"))).alias("events"))


def onset_list_scan(lines: DataFrame) -> DataFrame:
    """Lines of `condition=onset:duration` entries (a line a run) to (line, cond, onset, duration)."""
    entry = F.explode(F.regexp_extract_all("value", F.lit(r"(\S+=[-0-9.]+:[-0-9.]+)"), 1))
    x = lines.select("line", entry.alias("e"))
    return x.select("line", F.regexp_extract("e", r"^(.+)=", 1).alias("cond"), F.regexp_extract("e", r"=([-0-9.]+):", 1).cast("double").alias("onset"), F.regexp_extract("e", r":([-0-9.]+)$", 1).cast("double").alias("duration"))


def sidecar_scan(texts: DataFrame) -> DataFrame:
    """Repetition time and task name of JSON sidecars (file, value)."""
    parsed = F.from_json("value", "RepetitionTime double, TaskName string")
    return texts.select("file", parsed.alias("j")).select("file", F.col("j.RepetitionTime").alias("tr"), F.col("j.TaskName").alias("task"))
