"""Delivery planning: who gets which article, in which form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import blank_to_null, col
from feedweir.functions.images import acceptable_image
from feedweir.operators.catalog import EMAIL
from feedweir.operators.partitioning import id_chunk, number_rows, time_chunk, top_per_key
from feedweir.operators.upserts import insert_if_absent

KEY = ["article_id", "subscription_id", "channel"]


def active_subscriptions(subscriptions: DataFrame, channel: str | None = None) -> DataFrame:
    active = subscriptions.where("is_active")
    return active if channel is None else active.where(F.col("channel") == channel)


def latest_article_per_batch(articles: DataFrame, batch: list[str]) -> DataFrame:
    """Only the newest article of a batch is sent out (ties: highest id)."""
    return articles.groupBy(*batch).agg(F.max_by("id", F.struct("published_at", "id")).alias("article_id"))


def fan_out_deliveries(newest: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One wanted delivery per (batch article, active real-time subscription of its source)."""
    recipients = active_subscriptions(subscriptions).where(F.col("channel").isin(S.REALTIME_CHANNELS))
    return newest.select("source_id", "article_id").distinct().join(
        recipients.select(
            "source_id", F.col("id").alias("subscription_id"), "channel", "translate_enabled", "translate_language"
        ),
        "source_id",
    )


def requeue_rules(wanted: DataFrame, deliveries: DataFrame) -> DataFrame:
    """created / requeued / skipped: telegram skips what is delivered or queued, webhooks only what is delivered."""
    stored = deliveries.select(*KEY, F.col("id").alias("delivery_id"), F.col("status").alias("_status"))
    status = F.col("_status")
    action = (
        F.when(status.isNull(), "create")
        .when(status == "delivered", "skip")
        .when((status == "queued") & (F.col("channel") == "telegram"), "skip")
        .otherwise("requeue")
    )
    return wanted.join(stored, KEY, "left").withColumn("action", action).drop("_status")


def needs_translation() -> Column:
    return (
        F.col("channel").isin(S.TRANSLATABLE_CHANNELS)
        & F.coalesce("translate_enabled", F.lit(False))
        & (F.coalesce("translate_language", F.lit("")) != "")
    )


def translation_batches(queued: DataFrame, width: int = 10_000) -> DataFrame:
    """Recipients per (channel, article, language), listed in parts of at most ``width`` subscription ids.

    A popular article's recipients never meet in one row: the part number is the subscription's id range.
    """
    wanted = queued.where(F.col("action").isin("create", "requeue") & needs_translation())
    return (
        wanted.groupBy(
            "channel", "article_id", F.col("translate_language").alias("language"), id_chunk("subscription_id", width).alias("part")
        )
        .agg(F.array_sort(F.collect_list("subscription_id")).alias("recipients"))
    )


def missing_translations(batches: DataFrame, translated: DataFrame) -> DataFrame:
    """(article, language) pairs asked for and not stored yet."""
    keys = ["article_id", "language"]
    return batches.select(*keys).distinct().join(translated.select(*keys), keys, "left_anti")


def flag(language: Column | str) -> Column:
    code = col(language)
    out = F.lit(S.OTHER_FLAG)
    for name, symbol in S.LANGUAGE_FLAGS.items():
        out = F.when(code == name, F.lit(symbol)).otherwise(out)
    return out


def translated_messages(batches: DataFrame, translated: DataFrame, articles: DataFrame) -> DataFrame:
    """Stored translation → one message per recipient."""
    texts = translated.select(
        "article_id", "language", F.col("title").alias("_title"), F.col("public_url").alias("url"), F.col("image_url").alias("_image")
    ).join(
        articles.select(F.col("id").alias("article_id"), F.col("image_url").alias("_article_image"), F.col("summary").alias("_summary")),
        "article_id",
    )
    return (
        batches.where(F.col("channel").isin(S.TRANSLATABLE_CHANNELS))
        .join(texts, ["article_id", "language"])
        .select(
            F.explode("recipients").alias("subscription_id"),
            "article_id",
            "channel",
            F.concat(flag("language"), F.lit(" "), F.col("_title")).alias("title"),
            "url",
            F.coalesce("_summary", F.lit("")).alias("body"),
            F.coalesce("_image", "_article_image").alias("image_url"),
        )
    )


def email_digests(
    subscriptions: DataFrame, articles: DataFrame, deliveries: DataFrame, now: Column,
    days: int = S.DIGEST_DAYS, items: int = S.DIGEST_ITEMS,
) -> DataFrame:
    """Newest ``items`` recent articles per e-mail subscription that were not mailed to it yet.

    With d articles already mailed, the digest lies within the first ``items + d`` recent articles of the source. Each
    subscription therefore asks for those positions by number: the work is ``items`` per subscription plus one row per
    past delivery, never subscriptions × articles.
    """
    recent = articles.where(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days))).select(
        "id", "source_id", "published_at"
    )
    ranked = number_rows(
        recent, ["source_id"], [F.col("published_at").desc_nulls_last(), F.col("id").desc()],
        F.coalesce(time_chunk("published_at"), F.lit(-(2**62))), descending=True, out="place",
    ).select("source_id", "place", F.col("id").alias("article_id"))
    readers = active_subscriptions(subscriptions, "email").where(F.col("target").rlike(EMAIL)).select(
        F.col("id").alias("subscription_id"), "source_id"
    )
    mailed = deliveries.where((F.col("channel") == "email") & (F.col("status") == "delivered")).select(
        "subscription_id", "article_id"
    )
    known = mailed.join(recent.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    counts = known.groupBy("subscription_id").agg(F.count("*").alias("_d"))
    asked = readers.join(counts, "subscription_id", "left").select(
        "subscription_id",
        "source_id",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("_d", F.lit(0)) + items)).alias("place"),
    )
    open_ = asked.join(ranked, ["source_id", "place"]).join(known, ["subscription_id", "article_id"], "left_anti")
    return top_per_key(open_, ["subscription_id"], [F.col("place").asc()], items, "pos").select(
        "subscription_id", "pos", "article_id"
    )


def initial_samples(new_subscriptions: DataFrame, articles: DataFrame, deliveries: DataFrame) -> DataFrame:
    """The latest article for every freshly created active telegram subscription, unless already delivered."""
    newest = latest_article_per_batch(articles, ["source_id"])
    wanted = active_subscriptions(new_subscriptions, "telegram").select(
        F.col("id").alias("subscription_id"), "source_id", "channel"
    ).join(newest, "source_id")
    stored = deliveries.select(*KEY, F.col("status").alias("_status"))
    return (
        wanted.join(stored, KEY, "left")
        .where(~F.col("_status").eqNullSafe("delivered"))
        .select(*KEY, F.lit("queued").alias("status"), F.col("_status").isNull().alias("is_new"))
    )



def delivery_outcomes(deliveries: DataFrame, results: DataFrame) -> DataFrame:
    """Apply send results: attempts counted up to the first success, nothing is resent after it."""
    order = F.struct("tried_at", "seq")
    first_ok = results.where("ok").groupBy("delivery_id").agg(F.min(order).alias("_ok"))
    tried = (
        results.join(first_ok, "delivery_id", "left")
        .where(F.col("_ok").isNull() | (order <= F.col("_ok")))
        .groupBy("delivery_id")
        .agg(
            F.count("*").alias("_tries"),
            F.max(F.when(F.col("ok"), F.col("tried_at"))).alias("_delivered"),
            F.max(F.when(~F.col("ok"), F.col("tried_at"))).alias("_failed"),
            F.max_by("error", order).alias("_error"),
        )
    )
    open_ = F.col("status") != "delivered"
    hit = open_ & F.col("_tries").isNotNull()
    delivered = hit & F.col("_delivered").isNotNull()
    return deliveries.join(tried, deliveries["id"] == tried["delivery_id"], "left").select(
        F.col("id").alias("delivery_id"),
        "subscription_id",
        F.when(delivered, "delivered").when(hit, "failed").otherwise(F.col("status")).alias("status"),
        F.when(hit, F.col("attempts") + F.col("_tries")).otherwise(F.col("attempts")).cast("bigint").alias("attempts"),
        F.when(delivered, F.col("_delivered")).alias("delivered_at"),
        F.when(hit & F.col("_delivered").isNull(), F.col("_failed")).alias("failed_at"),
        F.when(hit & F.col("_delivered").isNull(), F.col("_error")).alias("error_message"),
    )


def message_payload(
    channel: Column | str, target: Column | str, title: Column | str, body: Column | str, url: Column | str, image: Column | str
) -> Column:
    """Request body per channel as JSON text."""
    ch, to, head, text, link, img = col(channel), col(target), col(title), F.coalesce(col(body), F.lit("")), col(url), blank_to_null(image)
    message = F.trim(
        F.concat(head, F.lit("\n"), link, F.when(text != "", F.concat(F.lit("\n\n"), text)).otherwise(F.lit("")))
    )
    photo = F.to_json(F.struct(to.alias("chat_id"), img.alias("photo"), F.left(message, F.lit(S.CAPTION_LIMIT)).alias("caption")))
    plain = F.to_json(
        F.struct(to.alias("chat_id"), message.alias("text"), F.lit(False).alias("disable_web_page_preview"))
    )

    def section(value: Column) -> Column:
        return F.struct(
            F.lit("section").alias("type"), F.struct(F.lit("mrkdwn").alias("type"), value.alias("text")).alias("text")
        )

    link_block = section(F.concat(F.lit("*<"), link, F.lit("|"), head, F.lit(">*")))
    blocks = F.array(link_block, F.when(text != "", section(F.left(text, F.lit(S.BODY_LIMIT)))))
    slack = F.to_json(F.struct(F.array_compact(blocks).alias("blocks"), F.lit(True).alias("unfurl_links")))
    embed = F.struct(
        F.left(head, F.lit(S.HEADING_LIMIT)).alias("title"),
        link.alias("url"),
        F.lit(S.EMBED_COLOR).alias("color"),
        F.left(blank_to_null(text), F.lit(S.EMBED_LIMIT)).alias("description"),
    )
    discord = F.to_json(F.struct(F.array(embed).alias("embeds")))
    short = F.left(head, F.lit(S.HEADING_LIMIT))
    none = F.lit(None).cast("string")

    def part(type_: str, size=none, weight=none, text_=none, wrap=F.lit(None).cast("boolean"), url_=none, alt=none) -> Column:
        return F.struct(
            F.lit(type_).alias("type"), size.alias("size"), weight.alias("weight"), text_.alias("text"), wrap.alias("wrap"),
            url_.alias("url"), alt.alias("altText"),
        )

    card_body = F.array_compact(
        F.array(
            part("TextBlock", size=F.lit("Medium"), weight=F.lit("Bolder"), text_=short),
            F.when(blank_to_null(F.trim(img)).isNotNull(), part("Image", size=F.lit("Stretch"), url_=img, alt=short)),
            F.when(text != "", part("TextBlock", text_=F.left(text, F.lit(S.BODY_LIMIT)), wrap=F.lit(True))),
        )
    )
    card = F.struct(
        F.lit("http://adaptivecards.io/schemas/adaptive-card.json").alias("$schema"),
        F.lit("AdaptiveCard").alias("type"),
        F.lit("1.4").alias("version"),
        card_body.alias("body"),
        F.array(
            F.struct(F.lit("Action.OpenUrl").alias("type"), F.lit("Read Article").alias("title"), link.alias("url"))
        ).alias("actions"),
    )
    attachment = F.struct(F.lit("application/vnd.microsoft.card.adaptive").alias("contentType"), card.alias("content"))
    teams = F.to_json(F.struct(F.lit("message").alias("type"), F.array(attachment).alias("attachments")))
    return (
        F.when(ch == "telegram", F.when(img.isNotNull(), photo).otherwise(plain))
        .when(ch == "slack", slack)
        .when(ch == "discord", discord)
        .when(ch == "teams", teams)
    )


def message_payloads(deliveries: DataFrame, articles: DataFrame, subscriptions: DataFrame) -> DataFrame:
    texts = articles.select(
        F.col("id").alias("article_id"), "title", F.col("summary").alias("body"), F.col("canonical_url").alias("url"), "image_url"
    )
    targets = subscriptions.select(F.col("id").alias("subscription_id"), "target")
    return (
        deliveries.where(F.col("channel").isin(S.REALTIME_CHANNELS))
        .select(F.col("id").alias("delivery_id"), "article_id", "subscription_id", "channel")
        .join(texts, "article_id")
        .join(targets, "subscription_id")
        .select(
            "delivery_id", "channel", message_payload("channel", "target", "title", "body", "url", "image_url").alias("payload_json")
        )
    )


def delivery_image_choice(messages: DataFrame, articles: DataFrame, translated: DataFrame) -> DataFrame:
    """Image of the translation, else of the article, else of the message; dropped when unacceptable."""
    by_translation = translated.select("article_id", "language", F.col("image_url").alias("_t"))
    by_article = articles.select(F.col("id").alias("article_id"), F.col("image_url").alias("_a"))
    chosen = F.coalesce("_t", "_a", "image_url")
    return (
        messages.join(by_translation, ["article_id", "language"], "left")
        .join(by_article, "article_id", "left")
        .select("delivery_id", F.when((chosen == "") | acceptable_image(chosen), chosen).alias("image_url"))
    )
