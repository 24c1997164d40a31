"""Grids of pipelines, contrasts, and designs made of onsets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shape of the response to an impulse, as a difference of two gamma curves.
RISE, RISE_POWER, FALL, FALL_POWER, RESPONSE_SECONDS = 0.0083333, 5.0, 1.274527e-13, 15.0, 20.0


def pipeline_grid(options: DataFrame, steps: Sequence[str], inner: Sequence[str] = ()) -> DataFrame:
    """Every combination of the allowed values (step, value); a step without values has only 0.

    Numbered so that the first of `steps` changes fastest; `inner` steps run inside each of those combinations, the last fastest.
    The tables crossed hold a step's few values each.
    """
    grid = None
    for step in [*steps, *inner]:
        values = options.filter(F.col("step") == step).agg(F.sort_array(F.collect_set("value")).alias("v"))
        one = values.select(F.explode(F.when(F.size("v") > 0, F.col("v")).otherwise(F.array(F.lit(0).cast("bigint")))).alias(step))
        grid = one if grid is None else grid.crossJoin(F.broadcast(one))
    order = [*reversed(list(steps)), *inner]
    return grid.withColumn("pipeline_id", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # the grid is small


def gs_code(gspc: Column, custom: Column) -> Column:
    """0 none, 1 global, 2 custom, 3 both."""
    return gspc + 2 * custom


def pipeline_name(steps: dict[str, str]) -> Column:
    """Letters and values of a pipeline's steps, automatic drift order shown as A; `steps`: column -> letter."""
    return F.concat(*(F.concat(F.lit(letter), F.when(F.col(c) == -1, "A").otherwise(F.col(c).cast("string"))) for c, letter in steps.items()))


def default_contrast(conditions: DataFrame, keys: Sequence[str], baseline: str = "baseline") -> DataFrame:
    """All conditions but the baseline, joined by +, minus the baseline."""
    names = F.array_sort(F.collect_set(F.when(F.lower("cond") != baseline, F.col("cond"))))
    return conditions.groupBy(*keys).agg(F.concat(F.array_join(names, "+"), F.lit(f"-{baseline}")).alias("contrast"))


def contrast_parse(contrasts: DataFrame, conditions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`contrast` text like "a-b,c-d" to (contrast_id, cond_pos, cond_neg): places in the list of conditions (cond, cond_id); the
    baseline, and a missing side, are 0."""
    parts = contrasts.select(*keys, F.posexplode(F.split(F.regexp_replace("contrast", " ", ""), ",")).alias("contrast_id", "text"))
    sides = parts.withColumn("pos", F.lower(F.split("text", "-")[0])).withColumn("neg", F.lower(F.coalesce(F.get(F.split("text", "-"), F.lit(1)), F.lit("baseline"))))
    one = conditions.select(*keys, F.lower("cond").alias("pos"), F.col("cond_id").alias("cond_pos"))
    two = conditions.select(*keys, F.lower("cond").alias("neg"), F.col("cond_id").alias("cond_neg"))
    found = sides.join(one, [*keys, "pos"], "left").join(two, [*keys, "neg"], "left")
    return found.select(*keys, (F.col("contrast_id") + 1).cast("bigint").alias("contrast_id"), F.coalesce("cond_pos", F.lit(0)).alias("cond_pos"), F.coalesce("cond_neg", F.lit(0)).alias("cond_neg"))


def combined_condition(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """The events, and those of the named conditions again under their joined name."""
    merged = events.filter(F.col("cond").isin(*names)).withColumn("cond", F.lit("+".join(names).lower()))
    return events.unionByName(merged)


def param_override(params: Column, pairs: Column) -> Column:
    """Named parameters (map) with those of another map on top, values NONE passed over."""
    return F.map_concat(F.map_filter(params, lambda k, _: ~F.array_contains(F.map_keys(F.map_filter(pairs, lambda _, v: v != "NONE")), k)), F.map_filter(pairs, lambda _, v: v != "NONE"))


def onset_normalise(events: DataFrame, tr_ms: float, drop_first: int) -> DataFrame:
    """Onsets and durations in repetition times to milliseconds after the dropped scans; earlier onsets go."""
    ms = events.withColumn("onset_ms", (F.col("onset_t") - drop_first) * tr_ms).withColumn("duration_ms", F.col("duration") * tr_ms)
    return ms.filter(F.col("onset_ms") >= 0)


def design_block(events: DataFrame, keys: Sequence[str], tr_ms: float, scans: int) -> DataFrame:
    """Samples (from 0) that are on: max(1, round(tr/100)) samples a scan; a block covers its end sample too; cut at the run's end."""
    per_scan = max(1, int(tr_ms / 100 + 0.5))
    step, last = tr_ms / per_scan, scans * per_scan - 1
    start = F.round(F.col("onset_ms") / step).cast("int")
    end = F.least(start + F.round(F.col("duration_ms") / step).cast("int"), F.lit(last))
    spans = events.select(*keys, start.alias("st"), end.alias("ed")).filter("st <= ed")
    return spans.select(*keys, F.explode(F.sequence(F.col("st").cast("bigint"), F.col("ed").cast("bigint"))).alias("sample")).distinct()


def design_event(events: DataFrame, keys: Sequence[str], scans: int) -> DataFrame:
    """Impulses at the distinct rounded onsets, kept within 1..scans."""
    at = F.greatest(F.lit(1), F.least(F.lit(scans), F.round("onset_t").cast("bigint")))
    return events.select(*keys, at.cast("bigint").alias("scan")).distinct()


def hrf_response(on: DataFrame, keys: Sequence[str], samples: int, dt: float) -> DataFrame:
    """keys and `response`, an array of (sample, v): each sample that is on spreads over the lags of the response; samples that none reaches
    are absent.  One row a design, all worked out on batches of packed rows."""
    names, lags = list(keys), int(RESPONSE_SECONDS / dt + 1e-9)
    t = np.arange(lags + 1) * dt
    weight = np.exp(-t) * (RISE * t**RISE_POWER - FALL * t**FALL_POWER)
    packed = on.groupBy(*names).agg(F.collect_list("sample").alias("_on"))
    spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in on.schema.fields if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("_on"))
            at, row = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            row, at = row[at < samples], at[at < samples]
            first = int(at.min(initial=0))
            n = samples - first
            hit = np.zeros((batch.num_rows, n))
            np.add.at(hit, (row, at - first), 1)
            lag = np.arange(n)[None] - np.arange(n)[:, None]
            inside = (lag >= 0) & (lag <= lags)
            v, there = hit @ np.where(inside, weight[np.clip(lag, 0, lags)], 0), hit @ inside.astype(float) > 0
            _, sample = np.nonzero(there)
            ends = np.concatenate([[0], np.cumsum(there.sum(axis=1))])
            pairs = pa.StructArray.from_arrays([pa.array(sample + first, pa.int64()), pa.array(v[there])], names=["sample", "v"])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=[*names, "response"])

    return packed.mapInArrow(run, f"{spec}, response array<struct<sample: bigint, v: double>>")


def hrf_convolve(on: DataFrame, keys: Sequence[str], samples: int, dt: float) -> DataFrame:
    """Response of a design (keys, sample, v), a row a sample."""
    return hrf_response(on, keys, samples, dt).select(*keys, F.inline("response"))


def design_finish(response: DataFrame, keys: Sequence[str], samples: int, per_scan: int) -> DataFrame:
    """Demeaned over all samples (absent ones are 0) and taken at one sample of each scan, from round(per_scan/2).  `response`: keys, response
    of `hrf_response`."""
    first = int(per_scan / 2 + 0.5) - 1
    mean = F.aggregate("response", F.lit(0.0), lambda s, p: s + p["v"]) / samples
    out = response.withColumn("_mean", mean).select(*keys, "_mean", F.inline("response")).filter((F.col("sample") >= first) & ((F.col("sample") - first) % per_scan == 0))
    return out.select(*keys, ((F.col("sample") - first) / per_scan).cast("bigint").alias("scan"), (F.col("v") - F.col("_mean")).alias("v"))


def block_scans(events: DataFrame, keys: Sequence[str], tr_ms: float, scans: int) -> DataFrame:
    """Scans (from 1) of each block: from ceil(onset/tr), round(duration/tr) of them."""
    st = F.ceil(F.col("onset_ms") / tr_ms).cast("int")
    n = F.round(F.col("duration_ms") / tr_ms).cast("int")
    rows = events.filter(n > 0).select(*keys, F.explode(F.sequence(st.cast("bigint"), (st + n - 1).cast("bigint"))).alias("scan"))
    return rows.filter(F.col("scan").between(1, scans)).distinct()


def baseline_complement(blocks: DataFrame, keys: Sequence[str], scans: int) -> DataFrame:
    """Scans that are in no block of any condition."""
    every = blocks.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(scans).cast("bigint"))).alias("scan"))
    return every.join(blocks.select(*keys, "scan"), [*keys, "scan"], "left_anti")


def split_half_classes(classes: DataFrame, scans: int) -> DataFrame:
    """half 1 up to ceil(scans/2), then 2."""
    return classes.withColumn("half", F.when(F.col("scan") <= -(-scans // 2), 1).otherwise(2).cast("bigint"))


def class_balance(classes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cuts the larger of two classes (class 1 and 2) to the size of the smaller: scans farthest from any scan of the other class go first, of equally far
    ones the earlier.  A group holds the scans of one run, so its pairs are few."""
    other = classes.select(*keys, (3 - F.col("class")).alias("class"), F.col("scan").alias("other"))
    far = classes.join(other, [*keys, "class"]).groupBy(*keys, "class", "scan").agg(F.min(F.abs(F.col("scan") - F.col("other"))).alias("far"))
    w = Window.partitionBy(*keys, "class")
    sized = far.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy("far", F.desc("scan"))))
    return sized.withColumn("_least", F.min("_n").over(Window.partitionBy(*keys))).filter("_k <= _least").select(*keys, "class", "scan")


def legendre_basis(runs: DataFrame, keys: Sequence[str], length: str, order: int) -> DataFrame:
    """Legendre polynomials P_0..P_order on an even grid of -1..1 for each run."""
    t = runs.select(*keys, F.col(length).alias("_n"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(length).cast("bigint") - 1)).alias("t"))
    x = F.when(F.col("_n") > 1, 2.0 * F.col("t") / (F.col("_n") - 1) - 1).otherwise(1.0)
    out = t.withColumn("_x", x).withColumn("p0", F.lit(1.0))
    if order > 0:
        out = out.withColumn("p1", F.col("_x"))
    for k in range(2, order + 1):
        out = out.withColumn(f"p{k}", ((2 * k - 1) * F.col("_x") * F.col(f"p{k - 1}") - (k - 1) * F.col(f"p{k - 2}")) / k)
    return out.drop("_x", "_n")


def detrend_order_auto(tr_s: Column, scans: Column) -> Column:
    return 1 + F.floor(tr_s * (scans / 2) / 150)


def multirun_onsets(events: DataFrame, runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Onsets in the line of all runs (`runs`: keys, run, length): negative onsets shorten their duration, durations end with
    their run."""
    before = F.coalesce(F.sum("length").over(Window.partitionBy(*keys).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = events.join(runs.withColumn("_before", before), [*keys, "run"])
    start = F.greatest(F.col("onset_t"), F.lit(0))
    end = F.least(F.col("onset_t") + F.col("duration"), F.col("length"))
    return joined.select(*keys, "run", "cond", (start + F.col("_before")).alias("onset_t"), (end - start).alias("duration")).filter("duration > 0")
