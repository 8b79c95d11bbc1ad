"""Reporting aggregates and source diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import blank_to_null
from feedweir.functions.text import iso_date
from feedweir.operators.crawl import latest
from feedweir.operators.partitioning import number_rows, time_chunk, top_per_key
from feedweir.operators.polling import active_counts, with_active_counts


def user_dashboard(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions, active ones and distinct sources per user, pre-aggregated per (user, source)."""
    per_source = subscriptions.groupBy("user_id", "source_id").agg(
        F.count("*").alias("n"), F.count_if("is_active").alias("a")
    )
    return per_source.groupBy("user_id").agg(
        F.sum("n").alias("subscriptions"), F.sum("a").alias("active_subscriptions"), F.count("*").alias("sources")
    )


def paged_subscriptions(subscriptions: DataFrame, sources: DataFrame, page: int = 1, per_page: int = 12) -> DataFrame:
    """One page of every user's subscriptions, newest first."""
    first, last = (page - 1) * per_page + 1, page * per_page
    kept = top_per_key(
        subscriptions.select("user_id", "id", "source_id", "channel"), ["user_id"], [F.col("id").desc()], last, "pos"
    ).where(F.col("pos") >= first)
    named = sources.select(F.col("id").alias("source_id"), "source_url", "status")
    return kept.join(named, "source_id", "left")


def article_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("articles"))


def source_profile(articles: DataFrame, fetches: DataFrame, n_articles: int = 25, n_fetches: int = 20) -> DataFrame:
    """Latest articles and fetches of every source in one tall table."""
    a = top_per_key(
        articles.select("source_id", "id", "published_at"), ["source_id"],
        [F.col("published_at").desc_nulls_last(), F.col("id").desc()], n_articles, "pos",
    )
    f = top_per_key(
        fetches.select("source_id", "id", "fetched_at"), ["source_id"],
        [F.col("fetched_at").desc_nulls_last(), F.col("id").desc()], n_fetches, "pos",
    )
    return a.select(
        "source_id", F.lit("article").alias("kind"), "pos", F.col("id").alias("item_id"), F.col("published_at").alias("at")
    ).unionByName(
        f.select("source_id", F.lit("fetch").alias("kind"), "pos", F.col("id").alias("item_id"), F.col("fetched_at").alias("at"))
    )


def source_status_row(sources: DataFrame, articles: DataFrame, fetches: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Counts, latest fetch and latest article of every source in one row."""
    a = articles.groupBy("source_id").agg(
        F.count("*").alias("articles"),
        F.max_by(F.struct("title", "canonical_url", "published_at"), F.struct("published_at", "id")).alias("a"),
    )
    f = fetches.groupBy("source_id").agg(
        F.count("*").alias("fetches"),
        F.max_by(F.struct("http_status", "fetched_at", "payload_bytes"), F.struct("fetched_at", "id")).alias("f"),
    )
    base = with_active_counts(sources.select("id", "status", "source_type"), subscriptions)
    return (
        base.withColumnRenamed("id", "source_id")
        .join(a, "source_id", "left")
        .join(f, "source_id", "left")
        .select(
            "source_id", "status", "source_type", "active_subscriptions",
            F.coalesce("articles", F.lit(0)).alias("articles"), F.coalesce("fetches", F.lit(0)).alias("fetches"),
            F.col("f.http_status").alias("last_http_status"), F.col("f.fetched_at").alias("last_fetched_at"),
            F.col("f.payload_bytes").alias("last_payload_bytes"), F.col("a.title").alias("last_title"),
            F.col("a.canonical_url").alias("last_url"), F.col("a.published_at").alias("last_published_at"),
        )
    )


def latest_of_many(fetches: DataFrame, attempts: DataFrame) -> DataFrame:
    f = latest(fetches, "source_id", ["fetched_at", "id"], "id", "http_status").withColumnsRenamed(
        {"id": "fetch_id", "http_status": "fetch_status"}
    )
    a = latest(attempts, "source_id", ["started_at", "id"], "id", "stage", "status").withColumnsRenamed(
        {"id": "attempt_id", "stage": "attempt_stage", "status": "attempt_status"}
    )
    return f.join(a, "source_id", "full_outer")


def source_overview(sources: DataFrame, articles: DataFrame, subscriptions: DataFrame, limit: int = 120) -> DataFrame:
    """Most recently updated sources with their counts; the counts are taken for those sources only."""
    top = sources.orderBy(F.col("updated_at").desc_nulls_last(), F.col("id").desc()).limit(limit)
    ids = top.select("id")
    n_articles = article_counts(articles.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi"))
    return (
        top.join(n_articles, "id", "left")
        .join(active_counts(subscriptions), "id", "left")
        .select(
            F.col("id").alias("source_id"), "source_url", "status", "updated_at",
            F.coalesce("articles", F.lit(0)).alias("articles"),
            F.coalesce("active_subscriptions", F.lit(0)).alias("active_subscriptions"),
        )
    )


def failed_jobs_by_source(failed_jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest failure per source, of all failed jobs or of the last ``limit``."""
    recent = failed_jobs if limit is None else failed_jobs.orderBy(F.col("id").desc()).limit(limit)
    command = F.get_json_object("payload", "$.data.command")
    source = F.regexp_extract(command, r'sourceId";s:\d+:"([^"]+)"', 1).try_cast("bigint")
    return (
        recent.withColumn("source_id", source)
        .where(F.col("source_id") >= 1)
        .groupBy("source_id")
        .agg(
            F.max("id").alias("id"),
            F.max_by(F.coalesce(F.get_json_object("payload", "$.displayName"), F.lit("unknown")), "id").alias("display_name"),
            F.max_by("failed_at", "id").alias("failed_at"),
            F.max_by(
                F.when(F.col("exception") == "", "Unknown failure").otherwise(F.substring_index("exception", "\n", 1)), "id"
            ).alias("exception_head"),
        )
    )


# fixed values: codes, severities and texts shown to operators
DIAGNOSES = {
    "source_cold": ("ok", "Source is in cold state and is excluded from frequent polling.", None),
    "source_inactive": ("warn", "Source has no active bindings/subscriptions; regular polling is paused.", None),
    "failed_job": ("error", None, "Open failed jobs/Horizon for stack trace."),
    "parse_attempt_failed": ("error", None, "Retry source and inspect parse attempts."),
    "parse_attempt_skipped": ("warn", None, "Check source payload/cache availability and retry."),
    "no_queue_workers": ("error", "No active workers. Queued jobs are not being processed.", "Start queue workers and retry source."),
    "pending_never_fetched": (
        "warn", "Source is pending and was never fetched.", "Retry source pipeline. Verify ingestion worker/scheduler is running."),
    "discovery_failed": ("error", "Discovery failed for this source.", "Check URL accessibility and feed autodiscovery tags."),
    "fetch_failed": ("error", None, "Source may block bot traffic or URL may be invalid."),
    "source_blocked": ("error", None, "Try browser fallback strategy or reduce request frequency."),
    "pipeline_failed": ("error", "Pipeline stage failed for this source.", "Retry the source and inspect failed jobs if issue repeats."),
    "not_modified_without_articles": (
        "warn", "Source returned 304, but no articles are stored yet.", "Force a fresh fetch to obtain first baseline payload."),
    "never_fetched": ("warn", "Source has not been fetched yet.", "Retry source pipeline."),
    "parsed_zero_items": (
        "warn", "Fetch succeeded but parser returned zero feed items.", "Resolved URL may not be a valid RSS/Atom/JSON feed."),
    "all_duplicates": ("ok", "No new articles: all parsed items were duplicates.", None),
    "new_articles_detected": ("ok", None, None),
    "healthy_idle": ("ok", "Ingestion healthy. Waiting for source updates.", None),
}


def _text(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("n/a"))


def source_diagnostics(
    sources: DataFrame, subscriptions: DataFrame, articles: DataFrame, fetches: DataFrame, attempts: DataFrame,
    failed_jobs: DataFrame, has_workers: bool = True,
) -> DataFrame:
    """First matching diagnosis per source over its latest fetch, attempt and failed job.

    Optional columns: ``fetch_status_code`` of a source (what its last fetch stage noted; goes before the fetch log) and
    ``snapshot_reference`` of an attempt. A source without a usage state counts as active while it has active subscriptions.
    """
    if "fetch_status_code" not in sources.columns:
        sources = sources.withColumn("fetch_status_code", F.lit(None).cast("int"))
    if "snapshot_reference" not in attempts.columns:
        attempts = attempts.withColumn("snapshot_reference", F.lit(None).cast("string"))
    j = with_active_counts(sources, subscriptions).join(article_counts(articles), "id", "left")
    j = j.join(
        latest(fetches, "source_id", ["fetched_at", "id"], "http_status").withColumnsRenamed({"source_id": "id", "http_status": "_http"}),
        "id", "left",
    )
    j = j.join(
        latest(attempts, "source_id", ["started_at", "id"], "status", "error_type", "error_message", "snapshot_reference").withColumnsRenamed(
            {"source_id": "id", "status": "_attempt", "error_type": "_error_type", "error_message": "_error", "snapshot_reference": "_snapshot"}
        ),
        "id", "left",
    )
    j = j.join(
        failed_jobs.select(
            F.col("source_id").alias("id"), F.col("display_name").alias("_job"), F.col("failed_at").alias("_job_at"),
            F.col("exception_head").alias("_job_error"),
        ),
        "id", "left",
    )
    c = F.col
    by_use = F.when(c("active_subscriptions") > 0, "active").otherwise("inactive")
    usage = F.coalesce(blank_to_null("usage_state"), by_use)
    idle = (usage != "active") & (c("active_subscriptions") == 0)
    rules = [
        ("source_cold", idle & (usage == "cold")),
        ("source_inactive", idle),
        ("failed_job", c("_job").isNotNull()),
        ("parse_attempt_failed", c("_attempt") == "failed"),
        ("parse_attempt_skipped", c("_attempt") == "skipped"),
        ("no_queue_workers", F.lit(not has_workers) & c("last_parsed_at").isNull()),
        ("pending_never_fetched", (c("status") == "pending") & c("last_fetched_at").isNull()),
        ("discovery_failed", c("status") == "discovery_failed"),
        ("fetch_failed", c("status") == "fetch_failed"),
        ("source_blocked", c("health_state") == "blocked"),
        ("pipeline_failed", F.contains(c("status"), F.lit("failed"))),
        ("not_modified_without_articles", (c("status") == "not_modified") & c("articles").isNull()),
        ("never_fetched", c("last_fetched_at").isNull()),
        ("parsed_zero_items", c("parsed_count") == 0),
        ("all_duplicates", (c("new_articles") == 0) & (c("duplicates_skipped") > 0)),
        ("new_articles_detected", c("new_articles") > 0),
    ]
    code = F.lit("healthy_idle")
    for name, hit in reversed(rules):
        code = F.when(F.coalesce(hit, F.lit(False)), F.lit(name)).otherwise(code)
    j = j.withColumn("code", code)

    def fixed(i: int) -> Column:
        out = F.lit(None).cast("string")
        for name, row in DIAGNOSES.items():
            out = F.when(c("code") == name, F.lit(row[i]).cast("string")).otherwise(out)
        return out

    error = blank_to_null(F.trim("_error"))
    reason = (
        F.when(c("code") == "failed_job", F.concat(F.lit("Last failed job: "), c("_job"), F.lit(" at "), F.coalesce(iso_date(c("_job_at")), F.lit("n/a")), F.lit(".")))
        .when(
            c("code") == "parse_attempt_failed",
            F.coalesce(error, F.concat(F.lit("Latest parse attempt failed ("), F.coalesce(F.trim("_error_type"), F.lit("pipeline_error")), F.lit(").")))
        )
        .when(c("code") == "parse_attempt_skipped", F.coalesce(blank_to_null("_error"), F.lit("Latest parse attempt was skipped.")))
        .when(c("code") == "discovery_failed", F.coalesce("discovery_warning", fixed(1)))
        .when(c("code") == "fetch_failed", F.concat(F.lit("Fetch failed with HTTP "), _text(F.coalesce("fetch_status_code", "_http")), F.lit(".")))
        .when(
            c("code") == "source_blocked",
            F.concat(F.lit("Source appears blocked (health "), c("health_state"), F.lit(", score "), F.coalesce("health_score", F.lit(0)).cast("string"), F.lit(").")),
        )
        .when(c("code") == "pipeline_failed", F.coalesce(blank_to_null("stage_error"), fixed(1)))
        .when(
            c("code") == "new_articles_detected",
            F.concat(F.lit("Ingestion healthy. New articles detected: "), c("new_articles").cast("string"), F.lit(".")),
        )
        .otherwise(fixed(1))
    )
    hint = (
        F.when(
            c("code").isin("source_cold", "source_inactive"),
            F.when(
                c("next_check_at").isNotNull(),
                F.concat(F.lit("Next check at "), iso_date(c("next_check_at")), F.lit(". Source refreshes immediately on demand.")),
            ).otherwise(F.lit("Source refreshes on demand or when an active binding is created.")),
        )
        .when(c("code") == "failed_job", F.coalesce("_job_error", fixed(2)))
        .when((c("code") == "parse_attempt_failed") & c("_snapshot").isNotNull(), F.concat(F.lit("Latest snapshot: "), c("_snapshot"), F.lit(".")))
        .otherwise(fixed(2))
    )
    return j.select(F.col("id").alias("source_id"), fixed(0).alias("severity"), "code", reason.alias("reason"), hint.alias("hint"))


def generation_stats(generations: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    timed_out = F.get_json_object("meta", "$.timed_out") == "true"
    return generations.agg(
        F.count_if(F.col("status").isin(S.PENDING_STATUSES)).alias("pending"),
        F.count_if(failed).alias("failed"),
        F.count_if(failed & F.coalesce(timed_out, F.lit(False))).alias("failed_timed_out"),
        F.count_if(F.col("status") == "ready").alias("ready"),
    )


def generation_lists(generations: DataFrame, now: Column, timeout_seconds: int = S.GENERATION_TIMEOUT_SECONDS) -> DataFrame:
    """The three admin lists: stale pending (40), recent failed (60), recent (120)."""
    cutoff = now - F.make_dt_interval(secs=F.lit(timeout_seconds).cast("decimal(18,6)"))
    stale = F.col("status").isin(S.PENDING_STATUSES) & (F.coalesce("started_at", "created_at") <= cutoff)
    lists = [
        ("stale_pending", generations.where(stale), "created_at", 40),
        ("recent_failed", generations.where(F.col("status") == "failed"), "updated_at", 60),
        ("recent", generations, "created_at", 120),
    ]
    out = None
    for name, rows, column, limit in lists:
        order = [F.col(column).desc_nulls_last(), F.col("id").desc()]
        top = rows.select("id", "user_id", "status", column).orderBy(*order).limit(limit)
        ranked = top.withColumn("pos", F.row_number().over(W.partitionBy(F.lit(name)).orderBy(*order))).select(
            F.lit(name).alias("list"), "pos", "id", "user_id", "status", F.col(column).alias("at")
        )
        out = ranked if out is None else out.unionByName(ranked)
    return out


def webhook_usage(webhooks: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Active subscriptions behind each saved webhook."""
    counts = (
        subscriptions.where("is_active")
        .groupBy("user_id", "channel", F.sha2(F.lower("target"), 256).alias("url_hash"))
        .agg(F.count("*").alias("n"))
    )
    return webhooks.join(counts, ["user_id", "channel", "url_hash"], "left").select(
        F.col("id").alias("webhook_id"), F.coalesce("n", F.lit(0)).alias("feed_count")
    )


GROUP_KINDS = ["group", "supergroup"]


def integration_stats(webhooks: DataFrame, chats: DataFrame) -> DataFrame:
    """Webhooks per channel, linked chats, active providers and ready destinations per user."""
    channels = ["slack", "discord", "teams", "email"]
    hooks = webhooks.groupBy("user_id").pivot("channel", channels).count()
    linked = chats.where("bot_is_member").groupBy(F.col("owner_user_id").alias("user_id")).agg(
        F.count_if(F.col("chat_type").isin(GROUP_KINDS)).alias("linked_groups"),
        F.count_if(F.col("chat_type") == "channel").alias("linked_channels"),
    )
    joined = hooks.join(linked, "user_id", "full_outer")
    numbers = {c: F.coalesce(F.col(c), F.lit(0)) for c in [*channels, "linked_groups", "linked_channels"]}
    providers = sum((F.when(numbers[c] > 0, F.lit(1)).otherwise(F.lit(0)) for c in channels), F.lit(0))
    chats_linked = numbers["linked_groups"] + numbers["linked_channels"]
    return joined.select(
        "user_id",
        *[numbers[c].alias(c) for c in numbers],
        (providers + F.when(chats_linked > 0, F.lit(1)).otherwise(F.lit(0))).alias("active_providers"),
        (chats_linked + sum((numbers[c] for c in channels), F.lit(0))).cast("bigint").alias("ready_destinations"),
    )


def linked_chats(chats: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Member chats per owner and kind with their subscription counts, most recently linked first."""
    counts = (
        subscriptions.where("channel = 'telegram'").groupBy(F.col("target").alias("telegram_chat_id")).agg(F.count("*").alias("n"))
    )
    kind = F.when(F.col("chat_type").isin(GROUP_KINDS), "group").when(F.col("chat_type") == "channel", "channel")
    members = chats.where("bot_is_member").withColumn("kind", kind).where("kind IS NOT NULL")
    order = [F.col("linked_at").desc(), F.col("title").asc(), F.col("id").asc()]
    numbered = number_rows(
        members.select("id", "owner_user_id", "kind", "telegram_chat_id", "title", "linked_at"),
        ["owner_user_id", "kind"], order, time_chunk("linked_at"), descending=True, out="pos",
    )
    return numbered.join(counts, "telegram_chat_id", "left").select(
        F.col("owner_user_id").alias("user_id"), "kind", "pos", F.col("id").alias("chat_id"), F.coalesce("n", F.lit(0)).alias("n")
    )


MEMBER = ["member", "administrator"]


def chat_membership_state(events: DataFrame) -> DataFrame:
    """Latest membership per chat; the adder is whoever caused the last change from outside to member."""
    order = F.struct("seen_at", "id")
    joined_in = ~F.col("old_status").isin(MEMBER) & F.col("new_status").isin(MEMBER) & (F.col("actor_id") > 0)
    return (
        events.where(F.trim("chat_type") != "")
        .groupBy("chat_id")
        .agg(
            F.max_by("chat_type", order).alias("chat_type"),
            blank_to_null(F.max_by("new_status", order)).alias("bot_membership_status"),
            F.max_by(F.col("new_status").isin(MEMBER), order).alias("bot_is_member"),
            F.max_by("actor_id", F.when(joined_in, order)).alias("added_by"),
            F.min("seen_at").alias("discovered_at"),
            F.max("seen_at").alias("last_seen_at"),
        )
    )
