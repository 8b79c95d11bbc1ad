"""Extraction-schema registry: versions, activation, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import blank_to_null
from feedweir.operators.partitioning import top_per_key


def active_schema(schemas: DataFrame) -> DataFrame:
    """Latest active schema per source."""
    rest = [c for c in schemas.columns if c != "source_id"]
    row = F.max_by(F.struct(*rest), F.col("id")).alias("s")
    return schemas.where("is_active").groupBy("source_id").agg(row).select("source_id", "s.*")


def next_schema_version(sources: DataFrame, schemas: DataFrame) -> DataFrame:
    known = schemas.groupBy("source_id").agg(F.max("version").alias("v"))
    return sources.select(F.col("id").alias("source_id")).join(known, "source_id", "left").select(
        "source_id", F.greatest(F.lit(1), F.coalesce("v", F.lit(0)) + 1).cast("bigint").alias("next_version")
    )


def strategy_for(source_type: Column) -> Column:
    out = F.lit(S.STRATEGY_OTHER)
    for name, strategy in S.STRATEGIES.items():
        out = F.when(source_type == name, F.lit(strategy)).otherwise(out)
    return out


def activate_schema(schemas: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """Apply one candidate per source: refresh the active schema of the same strategy, else retire it and append a version.

    ``candidates`` holds source_id, source_type, confidence (0..1) and schema_payload; new rows come without an id.
    """
    wanted = candidates.select(
        "source_id",
        strategy_for(F.col("source_type")).alias("_strategy"),
        F.round(F.col("confidence") * 100, 2).alias("_score"),
        F.col("schema_payload").alias("_payload"),
    )
    current = active_schema(schemas).select(
        "source_id", F.col("id").alias("_active_id"), F.col("strategy_type").alias("_active_strategy")
    )
    top = schemas.groupBy("source_id").agg(F.max("version").alias("_top"))
    plan = wanted.join(current, "source_id", "left").join(top, "source_id", "left").withColumn(
        "_refresh", F.coalesce(F.col("_active_strategy") == F.col("_strategy"), F.lit(False))
    )
    is_active_row = F.coalesce(F.col("id") == F.col("_active_id"), F.lit(False))
    refreshed = is_active_row & F.coalesce("_refresh", F.lit(False))
    retired = is_active_row & ~F.coalesce("_refresh", F.lit(False))
    updated = schemas.join(plan, "source_id", "left").select(
        "id",
        "source_id",
        "version",
        "strategy_type",
        F.when(refreshed, F.coalesce("_payload", F.col("schema_payload"))).otherwise(F.col("schema_payload")).alias("schema_payload"),
        F.when(refreshed, F.coalesce("_score", "confidence_score")).otherwise(F.col("confidence_score")).alias("confidence_score"),
        F.when(refreshed, F.coalesce("validation_score", "_score")).otherwise(F.col("validation_score")).alias("validation_score"),
        F.when(retired, F.lit(False)).otherwise(F.col("is_active")).alias("is_active"),
        F.when(refreshed, F.lit(False)).otherwise(F.col("is_shadow")).alias("is_shadow"),
        F.when(refreshed, now).otherwise(F.col("last_validated_at")).alias("last_validated_at"),
    )
    appended = plan.where("NOT _refresh").select(
        F.lit(None).cast("bigint").alias("id"),
        "source_id",
        (F.coalesce("_top", F.lit(0)) + 1).cast("bigint").alias("version"),
        F.col("_strategy").alias("strategy_type"),
        F.col("_payload").alias("schema_payload"),
        F.col("_score").alias("confidence_score"),
        F.col("_score").alias("validation_score"),
        F.lit(True).alias("is_active"),
        F.lit(False).alias("is_shadow"),
        now.alias("last_validated_at"),
    )
    return updated.unionByName(appended)


def selector(payload: Column, part: str) -> Column:
    return F.coalesce(F.get_json_object(payload, f"$.{part}_xpath"), F.get_json_object(payload, f"$.{part}_selector"))


def validate_schema_shape(schemas: DataFrame) -> DataFrame:
    """Missing selectors per schema."""
    problems = [
        F.when(
            blank_to_null(F.trim(selector(F.col("schema_payload"), part))).isNull(),
            F.lit(f"Missing or invalid {part}_xpath/{part}_selector."),
        )
        for part in ("article", "title", "link")
    ]
    errors = F.array_compact(F.array(*problems))
    return schemas.select("id", (F.size(errors) == 0).alias("valid"), F.concat_ws(" ", errors).alias("errors"))


def snapshot_score(items: Column, valid: Column, min_items: int = S.VALIDATION_MIN_ITEMS) -> Column:
    """Coverage (70 points) plus number of valid items (30 points)."""
    coverage = F.when(items > 0, F.round(valid / items * 70)).otherwise(F.lit(0))
    amount = F.when(valid >= min_items, F.least(F.lit(30), valid * 5)).otherwise(F.round(valid / min_items * 30))
    return F.greatest(F.lit(0), F.least(F.lit(100), coverage.cast("int") + amount.cast("int")))


def score_schema_on_snapshots(results: DataFrame, snapshots: int = S.VALIDATION_SNAPSHOTS) -> DataFrame:
    """Average score of each schema over its newest snapshots."""
    newest = top_per_key(
        results, ["schema_id"], [F.col("captured_at").desc(), F.col("snapshot_id").desc()], max(1, snapshots)
    )
    score = F.when(F.col("item_count") > 0, snapshot_score(F.col("item_count"), F.col("valid_items"))).otherwise(F.lit(0))
    return newest.groupBy("schema_id").agg(
        F.round(F.sum(score) / F.count("*")).cast("int").alias("avg_score"), F.count("*").alias("snapshots")
    )


def schemas_due_revalidation(
    schemas: DataFrame, sources: DataFrame, now: Column, hours: int = S.REVALIDATE_HOURS, limit: int = S.REVALIDATE_MAX
) -> DataFrame:
    """Active HTML schemas of active HTML sources not validated lately, longest waiting first."""
    cutoff = now - F.make_dt_interval(hours=F.lit(hours))
    candidates = schemas.where(
        F.col("is_active")
        & ~F.col("is_shadow")
        & F.col("strategy_type").isin(S.HTML_STRATEGIES)
        & (F.col("last_validated_at").isNull() | (F.col("last_validated_at") <= cutoff))
    )
    eligible = sources.where((F.col("source_type") == "html") & (F.col("usage_state") == "active")).select(
        F.col("id").alias("source_id")
    )
    return (
        candidates.join(eligible, "source_id", "left_semi")
        .orderBy(F.col("last_validated_at").asc_nulls_first(), "id")
        .limit(limit)
        .select(F.col("id").alias("schema_id"), "source_id", "last_validated_at")
    )


def rollback_empty_schema(schemas: DataFrame, trials: DataFrame, min_items: int = 1, restore: bool = True) -> DataFrame:
    """Undo activations that yielded fewer than ``min_items``: the schema turns shadow, the previous one comes back.

    ``trials`` holds schema_id, previous_id and parsed_count.
    """
    failed = trials.where(F.col("parsed_count") < min_items)
    changes = failed.select(F.col("schema_id").alias("id"), F.lit("shadow").alias("_to"))
    if restore:
        back = failed.where("previous_id IS NOT NULL").select(F.col("previous_id").alias("id"), F.lit("active").alias("_to"))
        changes = changes.unionByName(back).groupBy("id").agg(F.min("_to").alias("_to"))
    joined = schemas.join(changes, "id", "left")
    to = F.col("_to")
    return joined.select(
        *[c for c in schemas.columns if c not in ("is_active", "is_shadow")],
        F.when(to == "shadow", False).when(to == "active", True).otherwise(F.col("is_active")).alias("is_active"),
        F.when(to == "shadow", True).when(to == "active", False).otherwise(F.col("is_shadow")).alias("is_shadow"),
    )


def listing_schema_fallback(pages: DataFrame) -> DataFrame:
    """Generic extraction rule for pages without a detected pattern."""
    html = F.lower("html")
    has_article = F.contains(html, F.lit("<article"))
    anchors = F.regexp_count(html, F.lit("<a "))
    return pages.select(
        "page_id",
        (has_article | (anchors >= 10)).alias("valid"),
        F.when(has_article, F.lit(0.58)).otherwise(F.lit(0.41)).alias("confidence"),
        F.when(has_article, F.lit("//article[.//a[@href]]"))
        .otherwise(F.lit("//main//*[self::article or self::li or self::div][.//a[@href]]"))
        .alias("article_rule"),
    )
