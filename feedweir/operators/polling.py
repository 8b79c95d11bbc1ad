"""Which sources are due, in what order, and where they go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import blank_to_null
from feedweir.functions.urls import url_host
from feedweir.operators.catalog import stable_jitter
from feedweir.operators.partitioning import top_per_key
from feedweir.session import stage


def active_counts(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.where("is_active").groupBy(F.col("source_id").alias("id")).agg(
        F.count("*").alias("active_subscriptions")
    )


def with_active_counts(sources: DataFrame, subscriptions: DataFrame) -> DataFrame:
    return sources.join(active_counts(subscriptions), "id", "left").withColumn(
        "active_subscriptions", F.coalesce("active_subscriptions", F.lit(0))
    )


def active_sources(sources: DataFrame, subscriptions: DataFrame, include_idle: bool = False) -> DataFrame:
    """Sources somebody listens to; optionally the inactive and cold ones too."""
    counted = with_active_counts(sources, subscriptions)
    wanted = F.col("active_subscriptions") > 0
    if include_idle:
        wanted = wanted | F.col("usage_state").isin("inactive", "cold")
    return counted.where(wanted)


def usage_states(sources: DataFrame, subscriptions: DataFrame, now: Column, cold_days: int = S.COLD_AFTER_DAYS) -> DataFrame:
    """active while bound, cold when nothing happened for ``cold_days``, else inactive."""
    reference = F.coalesce("last_success_at", "updated_at", "created_at")
    cold = reference <= now - F.make_dt_interval(days=F.lit(cold_days))
    state = F.when(F.col("active_subscriptions") > 0, "active").when(cold, "cold").otherwise("inactive")
    return with_active_counts(sources, subscriptions).select(F.col("id").alias("source_id"), state.alias("usage_state"))


def polling_state() -> Column:
    """State the poll cycle works with: an unbound cold source stays cold."""
    return (
        F.when(F.col("active_subscriptions") > 0, "active").when(F.col("usage_state") == "cold", "cold").otherwise("inactive")
    )


def interval_minutes(state: Column, own: Column) -> Column:
    return (
        F.when(state == "active", F.greatest(F.lit(S.ACTIVE_INTERVAL_MIN), own))
        .when(state == "cold", F.lit(max(S.IDLE_INTERVAL_MIN, S.COLD_INTERVAL)))
        .otherwise(F.lit(max(S.IDLE_INTERVAL_MIN, S.INACTIVE_INTERVAL)))
    )


def next_check(now: Column, minutes: Column, key: Column) -> Column:
    """now + interval + a jitter of 0..120 s that is stable per source."""
    jitter = stable_jitter(F.sha2(key.cast("string"), 256), 0, S.JITTER_SECONDS)
    return now + F.make_dt_interval(secs=(minutes * 60 + jitter).cast("decimal(18,6)"))


def poll_intervals(sources: DataFrame, states: DataFrame, now: Column) -> DataFrame:
    """Interval per source; the next check is set anew when missing or when the usage state changed."""
    joined = sources.join(states.select(F.col("source_id").alias("id"), F.col("usage_state").alias("_state")), "id")
    minutes = interval_minutes(F.col("_state"), F.col("polling_interval_minutes")).cast("bigint")
    reset = F.col("next_check_at").isNull() | (F.col("usage_state") != F.col("_state"))
    return joined.select(
        F.col("id").alias("source_id"),
        F.col("_state").alias("usage_state"),
        minutes.alias("interval_minutes"),
        F.when(reset, next_check(now, minutes, F.col("id"))).otherwise(F.col("next_check_at")).alias("next_check_at"),
    )


def is_due(state: Column, now: Column) -> Column:
    minutes = interval_minutes(state, F.col("polling_interval_minutes"))
    elapsed = F.unix_timestamp(now) - F.unix_timestamp("last_fetched_at")
    return (
        F.when(F.col("next_check_at").isNotNull(), F.col("next_check_at") <= now)
        .when(F.col("last_fetched_at").isNull(), F.lit(True))
        .otherwise(elapsed >= minutes * 60)
    )


def due_sources(sources: DataFrame, subscriptions: DataFrame, now: Column, include_idle: bool = False) -> DataFrame:
    return active_sources(sources, subscriptions, include_idle).where(is_due(polling_state(), now))


def source_domain() -> Column:
    host = F.coalesce(blank_to_null("host"), url_host(F.coalesce(blank_to_null("canonical_url"), F.col("source_url"))))
    return F.lower(F.coalesce(blank_to_null(F.trim(host)), F.lit("unknown")))


def route(source_type: Column, status: Column) -> Column:
    discover = source_type.isin("unknown", "html") | (status == "discovery_failed")
    return F.when(discover, "discover").otherwise("fetch")


# fixed values: states after which a manual retry starts over with discovery
RETRY_STATUSES = ["pending", "discovery_failed", "parse_failed", "normalize_failed", "detect_failed"]


def retry_route(source_type: Column, status: Column, canonical: Column) -> Column:
    discover = source_type.isin("unknown", "html") | status.isin(RETRY_STATUSES) | canonical.isNull()
    return F.when(discover, "discover").otherwise("fetch")


def poll_batch(
    sources: DataFrame,
    subscriptions: DataFrame,
    now: Column,
    per_domain: int = S.MAX_PER_DOMAIN,
    per_cycle: int = S.MAX_PER_CYCLE,
) -> DataFrame:
    """One poll cycle: dispatched and deferred sources; sources beyond the cycle limit stay untouched.

    The first ``per_domain`` due sources of each domain are cut out map-side, the first ``per_cycle`` of those by id are
    a top-k, and whatever is due, not among them and before the last dispatched id is deferred. The due list is staged
    because every one of these steps reads it.
    """
    due = stage(
        due_sources(sources, subscriptions, now).select(
            F.col("id").alias("source_id"),
            source_domain().alias("domain"),
            route(F.col("source_type"), F.col("status")).alias("route"),
        ),
        "due",
    )
    allowed = top_per_key(due, ["domain"], [F.col("source_id").asc()], per_domain).drop("rn")
    sent = allowed.orderBy("source_id").limit(per_cycle)
    full = sent.agg((F.count("*") >= per_cycle).alias("f"), F.max("source_id").alias("m")).select(
        F.when(F.col("f"), F.col("m")).alias("cutoff")
    )
    deferred = due.join(allowed.select("source_id"), "source_id", "left_anti")
    cutoff = full.scalar()
    deferred = deferred.where(cutoff.isNull() | (F.col("source_id") < cutoff))
    return sent.withColumn("action", F.lit("dispatch")).unionByName(deferred.withColumn("action", F.lit("defer")))


def route_sources(sources: DataFrame) -> DataFrame:
    t, s = F.col("source_type"), F.col("status")
    return sources.select(
        F.col("id").alias("source_id"), route(t, s).alias("route"), retry_route(t, s, F.col("canonical_url")).alias("retry_route")
    )


def repair_candidates(parse_empty: DataFrame, schemas: DataFrame, now: Column) -> DataFrame:
    """What to do about sources whose parse came back empty: revalidate a shadow schema, or request a repair."""
    shadows = schemas.where("is_shadow").groupBy(F.col("source_id").alias("id")).agg(F.max("id").alias("shadow_schema_id"))
    cooled = F.coalesce(
        F.col("repair_requested_at") <= now - F.make_dt_interval(mins=F.lit(S.REPAIR_COOLDOWN_MINUTES)), F.lit(True)
    )
    eligible = F.col("source_type").isin("unknown", "html") & (F.col("consecutive_failures") >= S.REPAIR_FAILURES) & cooled
    action = F.when(F.col("shadow_schema_id").isNotNull(), "revalidate_shadow").when(eligible, "repair")
    return (
        parse_empty.join(shadows, "id", "left")
        .select(F.col("id").alias("source_id"), "shadow_schema_id", action.alias("action"))
        .where("action IS NOT NULL")
    )


def stale_generations(
    generations: DataFrame, now: Column, timeout_seconds: int = S.GENERATION_TIMEOUT_SECONDS, limit: int = S.STALE_GENERATIONS_MAX
) -> DataFrame:
    """Pending generations past the timeout, oldest ids first, as failed rows."""
    timeout = max(S.GENERATION_TIMEOUT_FLOOR, timeout_seconds)
    stale = F.coalesce("started_at", "created_at") <= now - F.make_dt_interval(secs=F.lit(timeout).cast("decimal(18,6)"))
    picked = generations.where(F.col("status").isin(S.PENDING_STATUSES) & stale).orderBy("id").limit(max(1, limit))
    return picked.select(
        "id",
        F.lit("failed").alias("status"),
        F.lit(f"Generation timed out after {timeout} seconds. Escalated to admin debug.").alias("message"),
        now.alias("finished_at"),
        F.lit(True).alias("timed_out"),
    )
