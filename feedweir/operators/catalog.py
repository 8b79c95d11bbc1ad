"""Source catalogue: URL identity, aliases, new sources, delivery targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import blank_to_null, col
from feedweir.functions.urls import (
    canonical_url,
    host_in_domain,
    is_http_url,
    trim_ascii,
    url_hash,
    url_host,
    url_path,
    url_query,
)


def stable_jitter(key_hash: Column, low: int, high: int) -> Column:
    """Spread of ``low..high`` derived from a hex hash, so a re-run gives the same value."""
    return F.conv(F.left(key_hash, F.lit(7)), 16, 10).cast("bigint") % (high - low + 1) + low


def hosts(df: DataFrame, url: str) -> DataFrame:
    return (
        df.groupBy(F.coalesce(url_host(url), F.lit("unknown")).alias("domain"))
        .agg(F.count("*").alias("n_urls"))
    )


def url_identity(df: DataFrame, url: str, key: str) -> DataFrame:
    """One row per canonical URL: spellings seen and the first key carrying it."""
    return (
        df.select(F.col(key).alias("k"), url_hash(canonical_url(url)).alias("canonical_url_hash"))
        .groupBy("canonical_url_hash")
        .agg(F.count("*").alias("n_variants"), F.min("k").alias("first_id"))
    )


def source_keys(sources: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """hash → lowest source id over the submitted, the canonical and (optionally) the alias hashes."""
    keys = sources.select(F.col("source_url_hash").alias("hash"), F.col("id").alias("source_id")).unionByName(
        sources.select(F.col("canonical_url_hash").alias("hash"), F.col("id").alias("source_id"))
    )
    if aliases is not None:
        keys = keys.unionByName(aliases.select(F.col("normalized_alias_hash").alias("hash"), "source_id"))
    return keys.where("hash IS NOT NULL").groupBy("hash").agg(F.min("source_id").alias("source_id"))


def resolve_sources(submitted: DataFrame, sources: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Source of every submitted URL; null where unknown or not an http(s) URL.

    Three keyed projections and one equi-join replace an OR over three columns, which would plan as a nested loop.
    """
    hashed = submitted.select("id", "url").withColumn("_url", canonical_url("url")).withColumn(
        "hash", F.when(is_http_url("_url"), url_hash("_url"))
    )
    # URLs without a hash get keys of their own, which match nothing and spread over all tasks
    keyed = hashed.withColumn("hash", F.coalesce("hash", F.concat(F.lit("-"), F.col("id").cast("string"))))
    return keyed.join(source_keys(sources, aliases), "hash", "left").select(
        "id", "url", F.col("_url").alias("canonical_url"), "source_id"
    )


def find_or_create_sources(
    submitted: DataFrame, sources: DataFrame, now: Column, aliases: DataFrame | None = None
) -> DataFrame:
    """Rows to insert for URLs no source claims yet; the first submission of a URL sets its interval."""
    fresh = (
        submitted.withColumn("source_url", canonical_url("url"))
        .where(F.col("source_url") != "")
        .withColumn("source_url_hash", url_hash("source_url"))
        .groupBy("source_url_hash")
        .agg(
            F.min_by(F.struct("source_url", "polling_interval_minutes"), "id").alias("first"),
        )
        .join(source_keys(sources, aliases).withColumnRenamed("hash", "source_url_hash"), "source_url_hash", "left_anti")
    )
    host = url_host("first.source_url")
    return fresh.select(
        "source_url_hash",
        F.col("first.source_url").alias("source_url"),
        host.alias("host"),
        host.alias("domain"),
        F.lit("unknown").alias("source_type"),
        F.lit("pending").alias("status"),
        F.lit("inactive").alias("usage_state"),
        F.lit(S.HEALTH_START).alias("health_score"),
        F.lit("unknown").alias("health_state"),
        F.greatest(F.lit(S.ACTIVE_INTERVAL_MIN), F.col("first.polling_interval_minutes")).cast("bigint").alias(
            "polling_interval_minutes"
        ),
        (
            now
            + F.make_dt_interval(
                secs=stable_jitter(F.col("source_url_hash"), 30, max(30, S.JITTER_SECONDS)).cast("decimal(18,6)")
            )
        ).alias("next_check_at"),
    )


def alias_registry(submissions: DataFrame) -> DataFrame:
    """Aliases with their owner (the first source to submit them) and the owner's first and last sighting."""
    order = F.struct("seen_at", "id")
    per_source = (
        submissions.withColumn("_url", canonical_url("url"))
        .where(is_http_url("_url"))
        .withColumn("alias_hash", url_hash("_url"))
        .groupBy("alias_hash", "source_id")
        .agg(
            F.min(order).alias("first"),
            F.max(order).alias("last"),
            F.max_by(trim_ascii("url"), order).alias("alias_url"),
        )
    )
    return (
        per_source.groupBy("alias_hash")
        .agg(
            F.min_by(F.struct("source_id", "alias_url", "last"), F.col("first")).alias("o"),
            F.min("first").alias("first"),
        )
        .select(
            "alias_hash",
            "o.source_id",
            "o.alias_url",
            F.col("first.seen_at").alias("first_seen_at"),
            F.col("o.last.seen_at").alias("last_seen_at"),
        )
    )


def fill_host_meta(sources: DataFrame) -> DataFrame:
    host = url_host(F.coalesce(blank_to_null("canonical_url"), F.col("source_url")))
    return sources.select(
        "id",
        F.coalesce(blank_to_null("host"), host).alias("host"),
        F.coalesce(blank_to_null("domain"), host).alias("domain"),
    )


def valid_teams_target(url: Column | str) -> Column:
    """Workflow endpoints accepted for the adaptive-card channel."""
    u = col(url)
    host, path, query = url_host(u), url_path(u), url_query(u)
    platform = host_in_domain(host, "environment.api.powerplatform.com") | host_in_domain(
        host, "api.powerplatform.com"
    )
    accepted = (
        host_in_domain(host, "logic.azure.com")
        | host_in_domain(host, "office.com")
        | host_in_domain(host, "webhook.office.com")
        | (
            platform
            & F.contains(path, F.lit("/powerautomate/automations/direct/workflows/"))
            & F.contains(query, F.lit("sig="))
        )
    )
    return F.coalesce(u.rlike("(?i)^https://") & accepted, F.lit(False))


EMAIL = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+$"

# fixed values: messages shown for a rejected target
TARGET_ERRORS = {
    "slack": "Slack webhook URLs must start with https://hooks.slack.com/",
    "discord": "Discord webhook URLs must start with https://discord.com/api/webhooks/",
    "teams": "Teams webhook URLs must be Power Automate / Power Platform / Office workflow URLs.",
    "email": "Please enter a valid email address.",
    "other": "Unsupported channel.",
}


def target_error(channel: Column | str, target: Column | str) -> Column:
    c, t = col(channel), col(target)
    accepted = {
        "slack": F.startswith(t, F.lit("https://hooks.slack.com/")),
        "discord": F.startswith(t, F.lit("https://discord.com/api/webhooks/")),
        "teams": valid_teams_target(t),
        "email": t.rlike(EMAIL),
    }
    error = F.lit(TARGET_ERRORS["other"])
    for name, ok in accepted.items():
        error = F.when(c == name, F.when(~F.coalesce(ok, F.lit(False)), F.lit(TARGET_ERRORS[name]))).otherwise(error)
    return error


def audit_targets(subscriptions: DataFrame) -> DataFrame:
    return (
        subscriptions.groupBy("channel", target_error("channel", "target").alias("error"))
        .agg(F.count("*").alias("n"))
    )
