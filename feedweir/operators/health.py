"""Health scores and other ordered folds over attempt logs.

Every step of the score is ``s → min(hi, max(lo, s + a))``. Such steps compose into one step of the same form, so a
source's log can be cut into time slices, each slice folded on its own, and the slices folded in order. No task ever
holds the whole log of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.operators.partitioning import time_chunk

STEP = "struct<a:int,lo:int,hi:int,fails:int,won:boolean>"


def _clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.least(hi, F.greatest(lo, x))


def _identity() -> Column:
    return F.struct(
        F.lit(0).alias("a"), F.lit(0).alias("lo"), F.lit(S.HEALTH_MAX).alias("hi"), F.lit(0).alias("fails"),
        F.lit(False).alias("won"),
    ).cast(STEP)


def _then(f: Column, g: Column) -> Column:
    """First ``f``, then ``g``; ``fails`` counts failures since the last success, ``won`` marks one."""
    return F.struct(
        (f["a"] + g["a"]).alias("a"),
        _clamp(f["lo"] + g["a"], g["lo"], g["hi"]).alias("lo"),
        _clamp(f["hi"] + g["a"], g["lo"], g["hi"]).alias("hi"),
        F.when(g["won"], g["fails"]).otherwise(f["fails"] + g["fails"]).alias("fails"),
        (f["won"] | g["won"]).alias("won"),
    ).cast(STEP)


def _step(status: Column, error: Column) -> Column:
    ok = status == "success"
    drop = F.when(error.isin(S.HEALTH_SOFT_ERRORS), F.lit(S.HEALTH_SOFT_DROP)).otherwise(F.lit(S.HEALTH_HARD_DROP))
    return F.struct(
        F.when(ok, F.lit(S.HEALTH_GAIN)).otherwise(-drop).alias("a"),
        F.when(ok, F.lit(S.HEALTH_FLOOR + S.HEALTH_GAIN)).otherwise(F.lit(0)).alias("lo"),
        F.lit(S.HEALTH_MAX).alias("hi"),
        F.when(ok, F.lit(0)).otherwise(F.lit(1)).alias("fails"),
        ok.alias("won"),
    ).cast(STEP)


def _fold(sorted_steps: Column) -> Column:
    return F.aggregate(sorted_steps, _identity(), lambda acc, e: _then(acc, e["f"]))


def health_scores(attempts: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Score and consecutive failures per source after replaying its successes and failures in time order."""
    steps = attempts.where(F.col("status").isin("success", "failed")).select(
        "source_id",
        time_chunk("started_at", slice_seconds).alias("chunk"),
        F.struct(
            F.col("started_at"), F.col("id"), _step(F.col("status"), F.coalesce("error_type", F.lit(""))).alias("f")
        ).alias("e"),
        "status",
        "http_status",
        "started_at",
        "id",
    )
    last = F.struct("status", "http_status")
    slices = steps.groupBy("source_id", "chunk").agg(
        _fold(F.array_sort(F.collect_list("e"))).alias("f"), F.max_by(last, F.struct("started_at", "id")).alias("last")
    )
    whole = slices.groupBy("source_id").agg(
        _fold(F.array_sort(F.collect_list(F.struct("chunk", "f")))).alias("f"), F.max_by("last", "chunk").alias("last")
    )
    start = F.lit(S.HEALTH_START)
    return whole.select(
        "source_id",
        _clamp(start + F.col("f.a"), F.col("f.lo"), F.col("f.hi")).alias("health_score"),
        F.col("f.fails").alias("consecutive_failures"),
        F.col("last.status").alias("last_status"),
        F.col("last.http_status").alias("last_http_status"),
    )


def state_by_score(score: Column) -> Column:
    return F.when(score >= 80, "healthy").when(score >= 55, "degraded").when(score >= 35, "repairing").otherwise("broken")


def health_states(health: DataFrame) -> DataFrame:
    """State that belongs to the replayed score."""
    score, fails = F.col("health_score"), F.col("consecutive_failures")
    after_failure = (
        F.when(F.col("last_http_status").isin(403, 429), "blocked")
        .when((fails >= 5) | (score < 25), "broken")
        .when(fails >= 2, "repairing")
        .otherwise(state_by_score(score))
    )
    return health.select(
        "source_id",
        "health_score",
        F.when(F.col("last_status") == "success", state_by_score(score)).otherwise(after_failure).alias("health_state"),
    )


def failure_streaks(attempts: DataFrame) -> DataFrame:
    return health_scores(attempts).select("source_id", F.col("consecutive_failures").alias("streak"))


def last_stage_meta(attempts: DataFrame) -> DataFrame:
    """Latest stage, attempt, success and the error still standing per source."""
    order = F.struct("started_at", "id")
    failed, ok = F.col("status") == "failed", F.col("status") == "success"
    decided = F.when(failed | ok, order)
    return attempts.groupBy("source_id").agg(
        F.max_by("stage", order).alias("last_stage"),
        F.max("started_at").alias("last_attempt_at"),
        F.max(F.when(ok, F.col("started_at"))).alias("last_success_at"),
        F.max(F.when(failed, F.col("started_at"))).alias("last_failure_at"),
        F.max_by(F.when(failed, F.col("error_type")), decided).alias("last_error_type"),
    )


# --- validation runs ---------------------------------------------------------------------------------
RUN = "struct<lead:int,tail:int,n:int,best:int>"


def _run(passed: Column) -> Column:
    one = F.when(passed, F.lit(1)).otherwise(F.lit(0))
    return F.struct(one.alias("lead"), one.alias("tail"), F.lit(1).alias("n"), one.alias("best")).cast(RUN)


def _join_runs(f: Column, g: Column) -> Column:
    return F.struct(
        F.when(f["lead"] == f["n"], f["n"] + g["lead"]).otherwise(f["lead"]).alias("lead"),
        F.when(g["tail"] == g["n"], g["n"] + f["tail"]).otherwise(g["tail"]).alias("tail"),
        (f["n"] + g["n"]).alias("n"),
        F.greatest(f["best"], g["best"], f["tail"] + g["lead"]).alias("best"),
    ).cast(RUN)


def _fold_runs(sorted_runs: Column) -> Column:
    empty = F.struct(F.lit(0).alias("lead"), F.lit(0).alias("tail"), F.lit(0).alias("n"), F.lit(0).alias("best")).cast(RUN)
    return F.aggregate(sorted_runs, empty, lambda acc, e: _join_runs(acc, e["r"]))


def shadow_activation(
    runs: DataFrame, required: int = S.SHADOW_RUNS, threshold: int = S.ACTIVATE_SCORE, slice_seconds: int = 3600
) -> DataFrame:
    """Passing runs in a row per schema, and whether any row of runs was long enough to activate it."""
    one = runs.select(
        "schema_id",
        time_chunk("run_at", slice_seconds).alias("chunk"),
        F.struct("run_at", "id", _run(F.col("avg_score") >= threshold).alias("r")).alias("e"),
        "avg_score",
        "run_at",
        "id",
    )
    slices = one.groupBy("schema_id", "chunk").agg(
        _fold_runs(F.array_sort(F.collect_list("e"))).alias("r"),
        F.max_by("avg_score", F.struct("run_at", "id")).alias("latest"),
    )
    whole = slices.groupBy("schema_id").agg(
        _fold_runs(F.array_sort(F.collect_list(F.struct("chunk", "r")))).alias("r"),
        F.max_by("latest", "chunk").alias("validation_score"),
    )
    return whole.select(
        "schema_id",
        "validation_score",
        F.col("r.tail").alias("success_runs"),
        (F.col("r.best") >= required).alias("activated"),
    )
