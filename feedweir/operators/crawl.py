"""Crawl-log jobs: fetch planning, classification, change detection, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import blank_to_null, col
from feedweir.functions.text import cut_utf8, parse_date, repair_utf8
from feedweir.functions.urls import trim_ascii
from feedweir.operators.partitioning import time_chunk


def latest(log: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """Newest row per key as flat columns; combined map-side, nothing is sorted."""
    row = F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")
    return log.groupBy(key).agg(row).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])


def conditional_fetch_plan(sources: DataFrame, fetches: DataFrame) -> DataFrame:
    """Validators of each source's last fetch for the next conditional request."""
    last = latest(fetches, "source_id", ["fetched_at", "id"], "etag", "last_modified")
    return sources.select(F.col("id").alias("source_id")).join(last, "source_id", "left").select(
        "source_id", F.col("etag").alias("if_none_match"), F.col("last_modified").alias("if_modified_since")
    )


def fetch_status(code: Column | str) -> Column:
    c = col(code)
    return F.when(c == 304, "not_modified").when(c.between(200, 299), "fetched").otherwise("fetch_failed")


def fetch_error(code: Column | str) -> Column:
    """Error type of an unsuccessful status, null for 2xx and 3xx."""
    c = col(code)
    return F.when(c.between(200, 399), None).otherwise(
        F.when(c == 429, "http_429")
        .when(c == 403, "http_403")
        .when(c >= 500, "http_5xx")
        .when(c >= 400, "http_4xx")
        .otherwise(F.concat(F.lit("http_"), c.cast("string")))
    )



def classify_fetches(fetches: DataFrame) -> DataFrame:
    return fetches.groupBy(
        fetch_status("http_status").alias("status"), fetch_error("http_status").alias("error_type")
    ).agg(F.count("*").alias("n"))


def content_changes(fetches: DataFrame) -> DataFrame:
    """Previous known content hash per fetch and whether the content changed.

    A busy source is cut into time slices; each slice looks back inside itself and otherwise takes the last hash of
    the slices before it (one row per slice).
    """
    sliced = fetches.withColumn("_chunk", time_chunk("fetched_at"))
    before = W.partitionBy("source_id", "_chunk").orderBy("fetched_at", "id").rowsBetween(W.unboundedPreceding, -1)
    tails = sliced.groupBy("source_id", "_chunk").agg(
        F.max_by("content_hash", F.when(F.col("content_hash").isNotNull(), F.struct("fetched_at", "id"))).alias("_tail")
    )
    earlier = W.partitionBy("source_id").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carry = tails.select("source_id", "_chunk", F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    local = sliced.withColumn("_local", F.last("content_hash", ignorenulls=True).over(before))
    prev = F.coalesce("_local", "_carry")
    return local.join(carry, ["source_id", "_chunk"]).select(
        "id",
        "source_id",
        "fetched_at",
        "content_hash",
        prev.alias("prev_hash"),
        (F.col("content_hash").isNotNull() & ~F.col("content_hash").eqNullSafe(prev)).alias("changed"),
        F.coalesce("content_hash", prev).alias("latest_content_hash"),
    )


def parse_gate(fetches: DataFrame) -> DataFrame:
    return fetches.where((F.col("http_status") == 200) & F.col("content_hash").isNotNull())


def retry_seconds(header: Column | str, now: Column) -> Column:
    """Seconds to wait from a Retry-After value: digits or a date, at least one second, else null."""
    value = trim_ascii(header)
    until = F.unix_timestamp(parse_date(value)) - F.unix_timestamp(now)
    return F.when(value.rlike(r"^\d+$"), F.greatest(F.lit(1), value.try_cast("bigint"))).when(
        until.isNotNull(), F.greatest(F.lit(1), until)
    )


def retry_after(fetches: DataFrame, now: Column) -> DataFrame:
    """Next check per source whose latest rate-limited fetch says when to come back."""
    limited = fetches.where(F.col("http_status") == 429).withColumn("_wait", retry_seconds("retry_after", now)).where(
        "_wait IS NOT NULL"
    )
    return limited.groupBy("source_id").agg(F.max_by("_wait", F.struct("fetched_at", "id")).alias("wait_seconds")).select(
        "source_id",
        "wait_seconds",
        (now + F.make_dt_interval(secs=F.col("wait_seconds").cast("decimal(18,6)"))).alias("next_check_at"),
    )


def domain_rate_window(
    fetches: DataFrame, sources: DataFrame, limit: int = S.DOMAIN_FETCHES_PER_MINUTE, width: str = "1 minute"
) -> DataFrame:
    """Fetches per domain and minute and how many exceed the limit."""
    per_source = fetches.groupBy("source_id", F.window("fetched_at", width).alias("w")).agg(F.count("*").alias("n"))
    domains = sources.select(
        F.col("id").alias("source_id"), F.lower(F.coalesce(blank_to_null(F.trim("host")), F.lit("unknown"))).alias("domain")
    )
    return (
        per_source.join(domains, "source_id")
        .groupBy("domain", F.col("w.start").alias("minute"))
        .agg(F.sum("n").alias("n"))
        .select("domain", "minute", "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("over_limit"))
    )


def with_durations(attempts: DataFrame) -> DataFrame:
    elapsed = F.round((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000).cast("bigint")
    return attempts.withColumn(
        "response_time_ms",
        F.when(F.col("started_at").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), elapsed)),
    ).withColumn("retry_count", F.greatest(F.lit(0), F.col("retry_count")))


def attempt_durations(attempts: DataFrame) -> DataFrame:
    """Response times per stage; quantiles come from mergeable summaries."""
    timed = with_durations(attempts)
    return timed.groupBy("stage").agg(
        F.count("*").alias("n"),
        F.percentile_approx("response_time_ms", 0.5, 1_000_000).alias("p50_ms"),
        F.percentile_approx("response_time_ms", 0.95, 1_000_000).alias("p95_ms"),
        F.max("response_time_ms").alias("max_ms"),
        F.sum("retry_count").alias("retries"),
    )


def attempt_lifecycle(events: DataFrame) -> DataFrame:
    """Attempt events (start, then success / skip / failure) → one row per attempt.

    The context maps are merged in event order, later keys winning; an attempt has a handful of events.
    """
    order = F.struct("at", "seq")
    merged = F.aggregate(
        F.array_sort(F.collect_list(F.struct("at", "seq", F.map_entries("context").alias("entries")))),
        F.create_map().cast("map<string,string>"),
        lambda acc, e: F.map_concat(acc, F.map_from_entries(e["entries"])),
    )
    done = F.col("status") != "running"
    error = blank_to_null(cut_utf8(repair_utf8("error_message"), S.ERROR_MESSAGE_BYTES))
    return (
        events.groupBy("attempt_id")
        .agg(
            F.max_by("status", order).alias("status"),
            F.max_by("error_type", order).alias("error_type"),
            F.max_by(error, order).alias("error_message"),
            F.min("at").alias("started_at"),
            F.max(F.when(done, F.col("at"))).alias("finished_at"),
            merged.alias("context"),
        )
        .withColumn(
            "response_time_ms",
            F.greatest(F.lit(0), F.round((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000)).cast("bigint"),
        )
    )
