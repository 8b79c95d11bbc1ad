"""Articles: normalise, find new ones, enrich, preview, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import blank_to_null, col, contains_any, let
from feedweir.functions.images import acceptable_image
from feedweir.functions.text import (
    clean_text,
    iso_date,
    nullable_summary,
    parse_date,
    title_or_default,
    truncate_text,
)
from feedweir.functions.urls import canonical_url, is_http_url, trim_ascii, url_hash
from feedweir.operators.partitioning import id_chunk, number_rows, spread, top_per_key


def normalize_articles(items: DataFrame) -> DataFrame:
    """Parsed items → canonical URL, cleaned texts, and the two identity hashes.

    The published date may be a timestamp or text. Items without URL or title are left out (see
    :func:`normalize_batch_stats`).
    """
    published = (
        F.col("published_at")
        if items.schema["published_at"].dataType.typeName().startswith("timestamp")
        else parse_date("published_at")
    )
    base = items.where((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    named = base.select(
        *[c for c in items.columns if c not in ("url", "title", "summary", "image_url", "published_at", "external_id")],
        "external_id",
        canonical_url("url").alias("canonical_url"),
        title_or_default("title").alias("title"),
        nullable_summary("summary").alias("summary"),
        F.when(F.col("image_url").isNotNull(), canonical_url("image_url")).alias("image_url"),
        published.alias("published_at"),
    )
    content = F.concat_ws(
        "|",
        "canonical_url",
        "title",
        F.coalesce("summary", F.lit("")),
        F.coalesce("image_url", F.lit("")),
        F.coalesce(iso_date(F.col("published_at")), F.lit("")),
        F.coalesce("external_id", F.lit("")),
    )
    # never null here; saying so keeps joins from re-evaluating the URL in an inferred null filter
    return named.withColumn("canonical_url_hash", F.coalesce(url_hash("canonical_url"), F.lit(""))).withColumn(
        "content_hash", F.coalesce(F.sha2(F.lower(content), 256), F.lit(""))
    )


def normalize_batch_stats(items: DataFrame) -> DataFrame:
    usable = (F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")
    return items.groupBy("source_id").agg(
        F.count("*").alias("input_count"),
        F.count_if(usable).alias("normalized_count"),
        F.count_if(~usable).alias("invalid_rows"),
    )


def valid_normalized() -> Column:
    ok = F.lit(True)
    for c in ("canonical_url", "canonical_url_hash", "content_hash", "title"):
        ok = ok & (F.coalesce(F.col(c), F.lit("")) != "")
    return ok


def detect_new_articles(normalized: DataFrame, articles: DataFrame, order: str) -> DataFrame:
    """Rows whose URL and content are neither stored nor seen earlier in the batch.

    First row per URL hash, minus stored URL hashes, then the same on content hashes: four equi-keyed steps, each cut
    down before its shuffle, in place of an OR anti-join.
    """
    fresh = normalized.withColumn("_invalid", ~valid_normalized())
    for key in ("canonical_url_hash", "content_hash"):
        fresh = top_per_key(fresh, [key], [F.col("_invalid").asc(), F.col(order).asc()], 1).drop("rn")
        fresh = fresh.where("NOT _invalid").join(articles.select(key), key, "left_anti")
    return fresh.drop("_invalid")


def detect_stats(normalized: DataFrame, new_articles: DataFrame) -> DataFrame:
    """Per source: input, new, duplicate and invalid rows with the reason when nothing is new."""
    seen = normalized.groupBy("source_id").agg(
        F.count("*").alias("input_count"), F.count_if(~valid_normalized()).alias("invalid_rows")
    )
    new = new_articles.groupBy("source_id").agg(F.count("*").alias("new_articles"))
    n_new = F.coalesce("new_articles", F.lit(0))
    duplicates = F.col("input_count") - F.col("invalid_rows") - n_new
    return seen.join(new, "source_id", "left").select(
        "source_id",
        "input_count",
        n_new.alias("new_articles"),
        duplicates.alias("duplicates_skipped"),
        "invalid_rows",
        F.when(
            n_new == 0,
            F.when(duplicates > 0, F.lit("All normalized rows are duplicates; no new articles.")).otherwise(
                F.lit("No valid new articles detected from normalized rows.")
            ),
        ).alias("reason"),
    )


def _missing(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")) == ""


def enrich_articles(articles: DataFrame, metadata: DataFrame) -> DataFrame:
    """Fill summary, image and (for listing-sourced rows) title from page metadata keyed by URL hash.

    An unacceptable stored image is replaced, or cleared when the page offers none.
    """
    found = metadata.select(
        "canonical_url_hash",
        F.col("title").alias("_title"),
        F.col("image_url").alias("_image"),
        F.col("description").alias("_description"),
    )
    joined = articles.join(found, "canonical_url_hash", "left")
    has_image = ~_missing("image_url")
    needs_image = ~has_image | ~acceptable_image("image_url")
    needs_summary = _missing("summary")
    prefers_page = F.col("source_type").isin("html_schema", "html")
    offered = F.when(acceptable_image("_image"), F.col("_image"))
    image = F.when(needs_image & offered.isNotNull(), offered).when(needs_image & has_image, None).otherwise(
        F.col("image_url")
    )
    summary = F.when(needs_summary & F.col("_description").isNotNull(), F.col("_description")).otherwise(F.col("summary"))
    title = F.when(prefers_page & ~_missing("_title"), F.col("_title")).otherwise(F.col("title"))
    touched = (
        (needs_image & (offered.isNotNull() | has_image))
        | (needs_summary & F.col("_description").isNotNull())
        | (prefers_page & ~_missing("_title"))
    )
    return joined.select(
        *[c for c in articles.columns if c not in ("image_url", "summary", "title")],
        image.alias("image_url"),
        summary.alias("summary"),
        title.alias("title"),
        F.coalesce(touched, F.lit(False)).alias("enriched"),
    )


def articles_needing_enrichment(articles: DataFrame, source_id: int | None = None, force: bool = False) -> DataFrame:
    picked = articles if source_id is None else articles.where(F.col("source_id") == source_id)
    return picked if force else picked.where(_missing("summary") | _missing("image_url"))


def enrichment_batches(articles: DataFrame, size: int = S.ENRICH_BATCH) -> DataFrame:
    """Article ids per source in id order, ``size`` per batch."""
    numbered = number_rows(articles.select("source_id", "id"), ["source_id"], [F.col("id").asc()], id_chunk("id"))
    return (
        numbered.groupBy("source_id", F.floor((F.col("rn") - 1) / size).alias("batch_no"))
        .agg(F.array_sort(F.collect_list("id")).alias("article_ids"))
    )


def backfill_images(articles: DataFrame, images: DataFrame, lookups: int = S.IMAGE_LOOKUPS) -> DataFrame:
    """Fill the image of the first ``lookups`` newest image-less articles per source."""
    asked = top_per_key(
        articles.where(_missing("image_url")).select("id", "source_id", "canonical_url_hash", "published_at"),
        ["source_id"],
        [F.col("published_at").desc_nulls_last(), F.col("id").desc()],
        lookups,
    )
    found = asked.join(images.select("canonical_url_hash", F.col("image_url").alias("_image")), "canonical_url_hash")
    return articles.join(found.select("id", "_image"), "id", "left").select(
        *[c for c in articles.columns if c != "image_url"],
        F.coalesce("_image", F.col("image_url")).alias("image_url"),
    )


def preview_items(articles: DataFrame, limit: int = S.PREVIEW_ITEMS) -> DataFrame:
    """Newest articles per source as preview rows."""
    newest = top_per_key(
        articles.select("source_id", "id", "title", "canonical_url", "summary", "image_url", "published_at"),
        ["source_id"],
        [F.col("published_at").desc_nulls_last(), F.col("id").desc()],
        max(1, limit),
        "pos",
    )
    return newest.select(
        "source_id",
        "pos",
        "title",
        F.col("canonical_url").alias("url"),
        clean_text("summary").alias("summary"),
        "image_url",
        "published_at",
    )


def fresh_sources(sources: DataFrame, articles: DataFrame, now: Column, minutes: int = S.FRESH_MINUTES) -> DataFrame:
    """Sources with stored articles whose last success (else last parse) is recent enough."""
    cutoff = now - F.make_dt_interval(mins=F.lit(max(1, minutes)))
    recent = sources.where(F.coalesce("last_success_at", "last_parsed_at") >= cutoff)
    return recent.select(F.col("id").alias("source_id")).join(articles.select("source_id"), "source_id", "left_semi")


def serve_preview(
    requests: DataFrame, cached: DataFrame, fresh: DataFrame, live: DataFrame, limit: int = S.PREVIEW_ITEMS
) -> DataFrame:
    """Answer every preview request: fresh cache, else live items, else stale cache, else failed."""
    stored = cached.groupBy("source_id").agg(F.count("*").alias("n_cached"))
    parsed = live.groupBy("source_id").agg(F.count("*").alias("n_live"))
    marked = (
        requests.join(stored, "source_id", "left")
        .join(fresh.select("source_id", F.lit(True).alias("is_fresh")), "source_id", "left")
        .join(parsed, "source_id", "left")
    )
    has_cache = F.coalesce("n_cached", F.lit(0)) > 0
    has_live = F.coalesce("n_live", F.lit(0)) > 0
    mode = (
        F.when(has_cache & F.coalesce("is_fresh", F.lit(False)), "fresh")
        .when(has_live, "live")
        .when(has_cache, "stale_fallback")
        .otherwise("failed")
    )
    items = (
        F.when(mode == "live", F.least("n_live", F.lit(limit)))
        .when(mode == "failed", F.lit(0))
        .otherwise(F.col("n_cached"))
    )
    return marked.select(
        "request_id",
        "source_id",
        mode.alias("cache_mode"),
        F.when(mode == "failed", "failed").otherwise("ready").alias("status"),
        items.cast("bigint").alias("items"),
    )


PREVIEW_SCHEMA = "array<struct<title:string,url:string,summary:string,image_url:string,image:string,published_at:string>>"


def sanitize_preview(generations: DataFrame) -> DataFrame:
    """Stored preview JSON → one clean row per item. Generations lie in few splits, so they are dealt out before the work on their items."""
    items = spread(generations.select("id", "preview_items"), "id").select(
        F.col("id").alias("generation_id"),
        F.posexplode(F.from_json("preview_items", PREVIEW_SCHEMA)).alias("pos", "item"),
    )
    given = F.coalesce("item.url", F.lit(""))
    url = let(
        F.struct(given.alias("given"), canonical_url(given).alias("normal")),
        lambda x: F.when(is_http_url(x["normal"]), x["normal"]).otherwise(x["given"]),
    )
    return items.select(
        "generation_id",
        "pos",
        truncate_text(
            F.coalesce(blank_to_null(clean_text("item.title")), F.lit(S.PREVIEW_DEFAULT_TITLE)), S.TITLE_LIMIT
        ).alias("title"),
        let(url, lambda u: F.when(trim_ascii(u) != "", u).otherwise(F.lit("#"))).alias("url"),
        nullable_summary("item.summary").alias("summary"),
        blank_to_null(trim_ascii(F.coalesce("item.image_url", "item.image"))).alias("image_url"),
        parse_date("item.published_at").alias("published_at"),
    )


def enrichment_audit(sources: DataFrame, articles: DataFrame, metadata: DataFrame) -> DataFrame:
    """Newest article per source, stored values beside what its page says now."""
    latest = articles.groupBy("source_id").agg(
        F.max_by(
            F.struct("id", "canonical_url", "canonical_url_hash", "title", "summary", "image_url"),
            F.struct("published_at", "id"),
        ).alias("a")
    )
    page = metadata.select(
        F.col("canonical_url_hash").alias("_hash"),
        F.col("title").alias("fresh_title"),
        F.col("description").alias("fresh_summary"),
        F.col("image_url").alias("fresh_image"),
    )
    return (
        sources.select(F.col("id").alias("source_id"), "source_url", F.col("source_type"), "status")
        .join(latest, "source_id", "left")
        .join(page, F.col("a.canonical_url_hash") == F.col("_hash"), "left")
        .select(
            "source_id", "source_url", "source_type", "status",
            F.col("a.id").alias("article_id"), F.col("a.canonical_url").alias("article_url"),
            F.col("a.title").alias("db_title"), F.col("a.summary").alias("db_summary"), F.col("a.image_url").alias("db_image"),
            "fresh_title", "fresh_summary", "fresh_image",
            F.when(F.trim(F.coalesce("a.canonical_url", F.lit(""))) == "", "No article available for audit.").alias("error"),
        )
    )


# fixed values: words that make a stored image look like a portrait
PORTRAIT_WORDS = ["avatar", "profile", "author", "gravatar", "face", "width=64", "height=64", "crop"]


def channel_preview_audit(
    subscriptions: DataFrame, articles: DataFrame, metadata: DataFrame, channel: str = "teams", per_source: int = 2
) -> DataFrame:
    """What the latest two articles of every subscription of a channel would look like when sent."""
    latest = top_per_key(
        articles.select("source_id", "id", "canonical_url_hash", "title", "summary", "image_url"),
        ["source_id"], [F.col("id").desc()], per_source,
    ).drop("rn")
    page = metadata.select(
        "canonical_url_hash", F.col("image_url").alias("page_image"), F.col("description").alias("page_summary")
    )
    no_image, no_summary = F.trim(F.coalesce("image_url", F.lit(""))) == "", F.trim(F.coalesce("summary", F.lit(""))) == ""
    looked_up = no_image | no_summary
    page_image = F.when(looked_up, F.col("page_image"))
    page_summary = F.when(looked_up, F.col("page_summary"))
    portrait = ~no_image & contains_any(F.lower("image_url"), PORTRAIT_WORDS)
    final_image = (
        F.when(no_image, page_image).when(portrait & page_image.isNotNull(), page_image).otherwise(F.col("image_url"))
    )
    cards = latest.join(page, "canonical_url_hash", "left").select(
        "source_id",
        F.col("id").alias("article_id"),
        "title",
        blank_to_null("image_url").alias("db_image"),
        final_image.alias("final_image"),
        F.when(no_summary, page_summary).otherwise(F.col("summary")).alias("final_summary"),
        portrait.alias("looks_like_portrait"),
        F.when(
            page_image.isNotNull() & ~F.coalesce(final_image == F.col("image_url"), F.lit(False)), "enriched"
        ).otherwise("db").alias("image_source"),
    )
    wanted = subscriptions.where(F.col("channel") == channel).select(
        F.col("id").alias("subscription_id"),
        "source_id",
        F.when(F.col("translate_enabled"), F.col("translate_language")).alias("translate"),
    )
    return wanted.join(cards, "source_id")
