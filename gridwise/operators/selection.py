"""Choosing pipelines from a table of metrics: one row for each subject and pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwise.operators.stats import friedman, signed_rank, tied_rank

BAD_CONDITION, PENALTY, SPREADS = 1000.0, 1e6, 2.3


def metric_collapse(metrics: DataFrame) -> DataFrame:
    """Means of the metrics over what a pipeline was scored on, GS folded to its distance from a half, XCond its maximum."""
    return metrics.groupBy("subject", "pipeline_id").agg(
        F.avg("P").alias("P"), F.avg("R").alias("R"), F.avg("dPR").alias("dPR"), F.avg("MOT_corr").alias("MOT_corr"),
        (F.abs(F.avg("GS_fract") - 0.5) + 0.5).alias("GS"), F.max("XCond").alias("XCond"),
    )


def keepfix_condition(metrics: DataFrame) -> DataFrame:
    """Pipelines whose design is well conditioned for every subject."""
    return metrics.groupBy("pipeline_id").agg(F.max("XCond").alias("XCond")).filter(F.col("XCond") < BAD_CONDITION).select("pipeline_id")


def keepfix_step(metrics: DataFrame, step: str, artifact: str, others: list[str], level: float = 0.05) -> DataFrame:
    """For each pipeline without `step`: the paired signed-rank test of its artifact against the pipeline that differs in that step only;
    kept (1) where p is over `level`."""
    off, on = metrics.filter(F.col(step) == 0), metrics.filter(F.col(step) == 1)
    pairs = off.alias("o").join(on.alias("n"), ["subject", *others]).select(F.col("o.pipeline_id").alias("pipeline_id"), (F.col(f"o.{artifact}") - F.col(f"n.{artifact}")).alias("d"))
    return signed_rank(pairs, "d", ["pipeline_id"]).withColumn("kept", (F.col("p") > level).cast("bigint"))


def fixed_rank(metrics: DataFrame, value: str = "dPR") -> DataFrame:
    """Median over subjects of each kept pipeline's rank (higher is better)."""
    kept = metrics.join(keepfix_condition(metrics), "pipeline_id", "left_semi")
    return tied_rank(kept, value, ["subject"]).groupBy("pipeline_id").agg(F.percentile("rank", F.lit(0.5)).alias("median_rank"))


def select_fix(metrics: DataFrame, steps: list[str], value: str = "dPR") -> DataFrame:
    """One row: the best, least and most processed pipelines of the set that does not differ from the best one."""
    kept = metrics.join(keepfix_condition(metrics), "pipeline_id", "left_semi")
    ranks = fixed_rank(metrics, value)
    limit = friedman(kept, value, "pipeline_id", "subject").select("critical")
    done = sum((F.col(s) for s in steps), F.lit(0))
    amount = kept.groupBy("pipeline_id").agg(F.first(done).alias("done"))
    top = ranks.agg(F.max("median_rank").alias("top")).crossJoin(limit)  # one row
    optimal = ranks.join(amount, "pipeline_id").crossJoin(F.broadcast(top)).filter(F.col("median_rank") >= F.col("top") - F.col("critical"))
    first = lambda order: F.min_by("pipeline_id", F.struct(order, "pipeline_id"))
    return optimal.agg(first(-F.col("median_rank")).alias("fix"), first(F.col("done")).alias("min"), first(-F.col("done")).alias("max"), F.count(F.lit(1)).alias("n_optimal"))


def _best(metrics: DataFrame, score, out: str, extra: dict) -> DataFrame:
    """The first pipeline with the highest score of each subject."""
    ordered = Window.partitionBy("subject").orderBy(F.desc("_score"), "pipeline_id")
    rows = metrics.withColumn("_score", score).withColumn("_k", F.row_number().over(ordered)).filter("_k = 1")
    return rows.select("subject", F.col("pipeline_id").alias(out), *(F.col(c).alias(a) for c, a in extra.items()))


def _penalised(value: str):
    return F.col(value) - F.when(F.col("XCond") >= BAD_CONDITION, PENALTY).otherwise(0.0)


def select_ind(metrics: DataFrame, value: str = "dPR") -> DataFrame:
    """The best pipeline of each subject, badly conditioned ones only if there is no other."""
    return _best(metrics, _penalised(value), "ind", {})


def _controlled(metrics: DataFrame, score, step: str, artifact: str) -> DataFrame:
    """The free optimum, or the optimum with `step` on where the free one's artifact is high for the group."""
    free = _best(metrics, score, "free", {artifact: "free_artifact"})
    held = _best(metrics, score - PENALTY * (1 - F.col(step)), "held", {artifact: "held_artifact"})
    limit = held.agg((F.avg("held_artifact") + SPREADS * F.stddev_samp("held_artifact")).alias("limit"))
    both = free.join(held, "subject").crossJoin(F.broadcast(limit))  # one row
    return both.select("subject", F.when(F.col("free_artifact") > F.col("limit"), F.col("held")).otherwise(F.col("free")).alias("ind"))


def select_ind_motion(metrics: DataFrame, value: str = "dPR") -> DataFrame:
    return _controlled(metrics, _penalised(value), "motcor", "MOT_corr")


def _folded(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("GS", F.abs(F.col("GS_fract") - 0.5) + 0.5)


def select_ind_global(metrics: DataFrame, value: str = "dPR") -> DataFrame:
    return _controlled(_folded(metrics), _penalised(value), "gspc", "GS")


def select_ind_both(metrics: DataFrame, value: str = "dPR") -> DataFrame:
    """First motion: entries over the limit are penalised; then the global-signal rule among what is left."""
    held = _best(metrics, _penalised(value) - PENALTY * (1 - F.col("motcor")), "held", {"MOT_corr": "a"})
    limit = held.agg((F.avg("a") + SPREADS * F.stddev_samp("a")).alias("motion_limit"))
    limited = _folded(metrics).crossJoin(F.broadcast(limit))  # one row
    score = _penalised(value) - F.when(F.col("MOT_corr") > F.col("motion_limit"), PENALTY).otherwise(0.0)
    return _controlled(limited, score, "gspc", "GS")


def select_con(pipelines: DataFrame, ideal: dict[str, float]) -> DataFrame:
    """The first pipeline that agrees with the conservative one in most steps; a numeric step that is missing from the grid counts by its
    nearest value on it (the smaller one on ties)."""
    target = pipelines
    for step, wanted in ideal.items():
        nearest = pipelines.agg(F.min_by(step, F.struct(F.abs(F.col(step) - wanted), step)).alias(f"_{step}"))
        target = target.crossJoin(F.broadcast(nearest))  # one row
    agree = sum(((F.col(s) == F.col(f"_{s}")).cast("bigint") for s in ideal), F.lit(0))
    return target.withColumn("agree", agree).agg(F.min_by("pipeline_id", F.struct(-F.col("agree"), "pipeline_id")).alias("con"), F.max("agree").alias("agree"))


def optimum_choices(metrics: DataFrame, steps: list[str], ideal: dict[str, float], value: str = "dPR") -> DataFrame:
    """subject, con, fix, min, max, ind: the conservative pipeline, the best, least and most processed ones of the optimal set, and each
    subject's own best.  With one subject the middle three are its own; they are also where no optimal set exists."""
    grid = metrics.groupBy("pipeline_id").agg(*(F.first(c).alias(c) for c in steps))
    group = select_fix(metrics, steps, value).crossJoin(F.broadcast(select_con(grid, ideal))).select("con", "fix", "min", "max")  # one row
    own = select_ind(metrics, value)
    return single_subject_override(own.crossJoin(F.broadcast(group))).select("subject", "con", *(F.coalesce(c, "ind").alias(c) for c in ("fix", "min", "max")), "ind")


def optimum_summary(metrics: DataFrame, ideal: dict[str, float], value: str = "dPR", steps: tuple[str, ...] = ("motcor", "gspc", "censor"), values: tuple[str, ...] = ("P", "R", "dPR", "MOT_corr")) -> DataFrame:
    """Steps and metrics of every subject under its choice by each scheme: CON, FIX, MIN, MAX and IND."""
    choices = optimum_choices(metrics, list(steps), ideal, value)
    schemes = F.explode(F.array(*(F.struct(F.lit(n.upper()).alias("scheme"), F.col(n).alias("pipeline_id")) for n in ("con", "fix", "min", "max", "ind"))))
    chosen = choices.select("subject", schemes.alias("_c")).select("subject", "_c.*")
    return chosen.join(metrics, ["subject", "pipeline_id"]).select("scheme", "subject", "pipeline_id", *steps, *values)


def single_pipeline_output(metrics: DataFrame) -> DataFrame:
    """The rows of `metrics` where all of them name one pipeline, which then needs no selection; no rows where there are several.  Null pipelines
    count as none."""
    ends = metrics.agg(F.min("pipeline_id").alias("_low"), F.max("pipeline_id").alias("_high"))  # one row
    return metrics.crossJoin(F.broadcast(ends)).filter("_low = _high AND pipeline_id = _low").drop("_low", "_high")


def single_subject_override(choices: DataFrame) -> DataFrame:
    """With one subject, the fixed, least and most processed choices are its individual one."""
    n = choices.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return choices.crossJoin(F.broadcast(n)).withColumns({c: F.when(F.col("_n") == 1, F.col("ind")).otherwise(F.col(c)) for c in ("fix", "min", "max")}).drop("_n")
