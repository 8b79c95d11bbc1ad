"""Keyed merges over plain tables: insert-if-absent and update-or-create."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir import settings as S


def insert_if_absent(existing: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` whose key is not stored, one per key."""
    return wanted.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def update_or_create(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    keep_stored: Sequence[str] = (),
) -> DataFrame:
    """Stored rows overwritten by the last incoming row of the same key, plus the new keys.

    Columns in ``keep_stored`` survive from the stored row. One full outer join on the key; ``is_new`` marks inserts.
    """
    values = [c for c in existing.columns if c not in keys]
    last = incoming.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct(*order) if len(order) > 1 else F.col(order[0])).alias("_new")
    )
    stored = existing.select(*keys, F.struct(*values).alias("_old"))
    merged = stored.join(last, list(keys), "full_outer")

    def pick(c: str) -> Column:
        old, new = F.col(f"_old.{c}"), F.col(f"_new.{c}")
        taken = F.when(F.col("_new").isNotNull(), new).otherwise(old)
        return (F.when(F.col("_old").isNotNull(), old).otherwise(new) if c in keep_stored else taken).alias(c)

    return merged.select(*keys, *[pick(c) for c in values], F.col("_old").isNull().alias("is_new"))


def upsert_articles(articles: DataFrame, incoming: DataFrame) -> DataFrame:
    """Overwrite the seven mutable fields of stored articles, insert the rest."""
    usable = incoming.where((F.trim("canonical_url") != "") & (F.trim("title") != ""))
    return update_or_create(
        articles, usable, ["canonical_url_hash"], ["id"],
        keep_stored=["id", "external_id", "canonical_url", "discovered_at"],
    )


def upsert_subscriptions(subscriptions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Update-or-create by (user, source, channel, target), re-activating what is submitted again."""
    return update_or_create(
        subscriptions,
        incoming.withColumn("is_active", F.lit(True)),
        ["user_id", "source_id", "channel", "target_hash"],
        ["id"],
        keep_stored=["id", "created_at"],
    )


def lowered_intervals(sources: DataFrame, incoming: DataFrame) -> DataFrame:
    """Polling interval per source after new submissions: it only ever goes down."""
    asked = incoming.groupBy(F.col("source_id").alias("id")).agg(F.min("polling_interval_minutes").alias("asked"))
    return sources.join(asked, "id", "left").select(
        "id", F.least("polling_interval_minutes", F.col("asked")).cast("bigint").alias("polling_interval_minutes")
    )


def capture_snapshots(payloads: DataFrame, body: str, max_bytes: int = S.SNAPSHOT_BYTES) -> DataFrame:
    """Payloads → repaired, byte-bounded snapshots with their hash."""
    from feedweir.functions.text import repair_utf8

    kept = F.nullif(repair_utf8(body, max(S.SNAPSHOT_BYTES_FLOOR, max_bytes)), F.lit(""))
    return payloads.withColumn("html_snapshot", kept).select(
        *[c for c in payloads.columns if c != body],
        F.lit("fetch_payload").alias("snapshot_kind"),
        "html_snapshot",
        F.octet_length("html_snapshot").cast("bigint").alias("body_bytes"),
        F.sha2("html_snapshot", 256).alias("content_hash"),
    )
