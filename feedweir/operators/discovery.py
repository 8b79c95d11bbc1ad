"""Where is the feed? Candidates, probes, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import col, contains_any, let
from feedweir.functions.urls import absolute_url, canonical_url, host_in_domain, url_hash, url_host, url_origin
from feedweir.operators import feeds, listings, pages
from feedweir.session import stage
from feedweir.sources.html import shred_pages

#: What discovery knows of a candidate; ``stage`` and ``n`` are the order in which it was found.
CANDIDATE = "struct<stage:int,n:int,url:string,type:string,confidence:double,strategy:string,has_schema:boolean,title:string>"


def url_type(url: Column | str) -> Column:
    lower = F.lower(col(url))
    return (
        F.when(F.contains(lower, F.lit("atom")), "atom")
        .when(contains_any(lower, ["json", ".feed"]), "json_feed")
        .when(contains_any(lower, ["rss", "feed"]), "rss")
        .otherwise("unknown")
    )


def url_type_heuristic(urls: DataFrame) -> DataFrame:
    """Guess for URLs without any candidate."""
    return urls.withColumn("type", url_type("url")).withColumn(
        "confidence", F.when(F.col("type") == "unknown", 0.35).otherwise(0.6)
    )


def feed_probe_plan(urls: DataFrame, with_feed: DataFrame | None = None, limit: int = S.PROBE_MAX) -> DataFrame:
    """The first places to look for a feed: host-specific addresses, then common paths. Built inside each row."""
    open_ = urls if with_feed is None else urls.join(with_feed.select("url"), "url", "left_anti")
    host = url_host("url")
    special = F.array_compact(
        F.array(*[F.when(host_in_domain(host, d), F.lit(u)) for d, u in S.PROBE_HOSTS.items()])
    )
    common = F.transform(F.array(*[F.lit(p) for p in S.PROBE_PATHS]), lambda p: absolute_url(p, F.col("url")))
    probes = F.slice(F.array_distinct(F.concat(F.transform(special, canonical_url), common)), 1, limit)
    return (
        open_.where(host.isNotNull())
        .select("url", F.posexplode_outer(probes).alias("n", "probe_url"))
        .where("n IS NOT NULL")
    )


def _candidate(stage_no: int, n: Column, url: Column, kind: Column, confidence: Column, strategy: Column | str, has_schema: bool = False, title: Column | None = None) -> Column:
    fields = [F.lit(stage_no), n, url, kind, confidence, F.lit(strategy), F.lit(has_schema), F.lit(None) if title is None else title]
    return F.struct(*fields).cast(CANDIDATE)


def latest_answers(answers: DataFrame) -> DataFrame:
    """Type of what each address answers: of its payloads (``payload_id, url, type, confidence``) the one with the greatest id."""
    last = F.max_by(F.struct("type", "confidence"), "payload_id")
    return answers.groupBy(canonical_url("url").alias("url")).agg(last.alias("a")).select("url", "a.type", "a.confidence")


def probe_answers(urls: DataFrame, answers: DataFrame) -> DataFrame:
    """Feeds that answer at the probe addresses of each origin: ``origin, probed`` (candidates in probing order, few by the plan's limit).

    Origins are probed once, however many URLs share them.
    """
    origins = urls.select(url_origin("url").alias("url")).where("url IS NOT NULL").distinct()
    plan = feed_probe_plan(origins).withColumnRenamed("url", "origin")
    hits = plan.join(answers.where(F.col("type").isin(S.FEED_TYPES)).withColumnRenamed("url", "probe_url"), "probe_url")
    found = _candidate(4, F.col("n"), F.col("probe_url"), F.col("type"), F.greatest(F.lit(0.72), "confidence"), "common_feed_probe")
    return hits.groupBy("origin").agg(F.array_sort(F.collect_list(found)).alias("probed"))


def html_candidates(shredded: DataFrame, answers: DataFrame) -> DataFrame:
    """What HTML pages offer, one row per page (``page_id, linked``): their own listing, announced feeds, links labelled as feeds.

    ``shredded`` is read four times: pass a written table.
    """
    sites = shredded.select("page_id", F.col("url").alias("site"))
    pattern = listings.detect_listing_patterns(shredded).join(sites, "page_id").select(
        "page_id",
        _candidate(
            1, F.lit(0), F.col("site"), F.lit("html"), F.greatest(F.lit(0.62), F.least(F.lit(0.99), "confidence")), "html_pattern_detector", True
        ).alias("c"),
    )
    announced = pages.announced_feeds(shredded).select(
        "page_id", _candidate(2, F.col("pos"), F.col("url"), F.col("type"), F.col("confidence"), "html_autodiscovery", title=F.col("title")).alias("c")
    )
    labelled = pages.feed_action_links(shredded, answers).select(
        "page_id", _candidate(3, F.col("pos"), F.col("url"), F.col("type"), F.col("confidence"), "html_action_link").alias("c")
    )
    every = pattern.union(announced).union(labelled)
    return every.groupBy("page_id").agg(F.array_sort(F.collect_list("c")).alias("linked"))


def discover(responses: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates of every requested URL, in the order of finding: ``requested_url, pos, url, type, confidence, strategy, has_schema, title``.

    ``responses`` holds one row per URL: ``id, url, body`` and perhaps ``content_type``; a null body is a request that failed. ``answers``
    tells what other addresses answered (``payload_id, url, type, confidence``). The payload itself comes first, then what an HTML page
    offers; URLs without a feed by then get the feeds that answer at their origin's probe addresses, URLs without any candidate a guess.
    Candidates of a URL are an array in its row: bodies are never shuffled, only the few links that may be feeds meet the answers.
    """
    content_type = F.col("content_type") if "content_type" in responses.columns else None
    known = stage(latest_answers(answers), "answers")
    markup = F.left("body", F.lit(2048)).rlike("(?i)<(?:html|head|body)")
    markup = markup if content_type is None else markup | F.contains(F.lower(content_type), F.lit("text/html"))
    html = responses.where(markup).select(F.col("id").alias("page_id"), "url", F.col("body").alias("html"))
    linked = html_candidates(stage(shred_pages(html), "nodes"), known)

    none = F.array().cast(f"array<{CANDIDATE}>")

    def own(kind: Column) -> Column:
        return _candidate(0, F.lit(0), F.col("url"), kind, feeds.kind_confidence(kind), "content_inspection")

    sites = responses.select(
        F.col("id").alias("page_id"), F.col("url").alias("requested_url"), F.coalesce(url_origin("url"), "url").alias("origin"),
        let(feeds.payload_kind("body", content_type), lambda kind: F.when(kind.isNotNull(), F.array(own(kind))).otherwise(none)).alias("own"),
    )
    guess = url_type("requested_url")
    guessed = _candidate(
        5, F.lit(0), F.col("requested_url"), guess, F.when(guess == "unknown", 0.35).otherwise(0.6),
        F.when(guess == "unknown", "fallback_unknown").otherwise("url_heuristic"),
    )
    joined = (
        sites.join(linked, "page_id", "left")
        .withColumn("found", F.concat("own", F.coalesce("linked", none)))
        .join(probe_answers(responses, known), "origin", "left")
    )

    def settled(found: Column) -> Column:
        has_feed = F.exists(found, lambda c: c["type"].isin(S.FEED_TYPES))
        with_probed = let(F.when(has_feed, found).otherwise(F.concat(found, F.coalesce("probed", none))), lambda x: F.when(F.size(x) > 0, x))
        return F.coalesce(with_probed, F.array(guessed))

    rows = joined.select("requested_url", F.posexplode(let(F.col("found"), settled)).alias("pos", "c"))
    return rows.select("requested_url", "pos", *[f"c.{x}" for x in ("url", "type", "confidence", "strategy", "has_schema", "title")])


def candidate_points(kind: Column, confidence: Column, has_schema: Column) -> Column:
    weight = F.lit(S.TYPE_WEIGHT_OTHER)
    for name, value in S.TYPE_WEIGHTS.items():
        weight = F.when(kind == name, F.lit(value)).otherwise(weight)
    bonus = F.when((kind == "html") & has_schema, F.lit(S.HTML_SCHEMA_BONUS)).otherwise(F.lit(0))
    return weight * 1000 + F.round(confidence * 100).cast("int") + bonus


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Order the candidates of each requested URL; rank 1 is the primary. A URL has a page's worth of candidates."""
    scored = candidates.withColumn("score", candidate_points(F.col("type"), F.col("confidence"), F.col("has_schema")))
    order = W.partitionBy("requested_url").orderBy(F.col("score").desc(), F.col("pos").asc())
    return scored.withColumn("rank", F.row_number().over(order))


def apply_discovery(sources: DataFrame, ranked: DataFrame) -> DataFrame:
    """Write the primary candidate onto its source and keep the others, in order, as fallbacks."""
    entry = F.struct("rank", "url", "type", "confidence", "strategy")
    per_url = ranked.groupBy("requested_url").agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    primary = F.element_at("_all", 1)
    others = F.filter("_all", lambda c: (c["url"] != primary["url"]) | (c["type"] != primary["type"]))
    return sources.join(per_url, sources["source_url"] == per_url["requested_url"]).select(
        F.col("id").alias("source_id"),
        primary["type"].alias("source_type"),
        F.lit("discovered").alias("status"),
        primary["url"].alias("canonical_url"),
        url_hash(primary["url"]).alias("canonical_url_hash"),
        F.transform(others, lambda c: F.concat_ws(" ", c["type"], c["url"])).alias("fallback_candidates"),
    )


def ingestion_probe(requests: DataFrame, ranked: DataFrame, item_counts: DataFrame) -> DataFrame:
    """One row per requested URL: primary candidate, its items, and the first alternative feed that has items."""
    counted = ranked.join(
        item_counts.select(url_hash("url").alias("_h"), F.col("n_items")), url_hash("url") == F.col("_h"), "left"
    ).withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    usable = F.col("type").isin(S.FEED_TYPES) & (F.col("n_items") > 0) & (F.col("rank") > 1)
    per_url = counted.groupBy("requested_url").agg(
        F.min_by(F.struct("type", "url", "strategy", "n_items"), "rank").alias("p"),
        F.min_by(F.when(usable, F.struct("type", "url", "n_items")), F.when(usable, F.col("rank"))).alias("f"),
    )
    empty = F.coalesce(F.col("p.n_items"), F.lit(0)) == 0
    used = F.col("p").isNotNull() & empty & F.col("f").isNotNull() & (F.col("f.url") != F.col("p.url"))
    return requests.join(per_url, "requested_url", "left").select(
        "requested_url",
        F.col("p.type").alias("primary_type"), F.col("p.url").alias("primary_url"), F.col("p.strategy").alias("primary_strategy"),
        F.col("p.n_items").alias("primary_count"),
        F.coalesce(used, F.lit(False)).alias("fallback_used"),
        F.when(used, F.col("f.type")).alias("fallback_type"), F.when(used, F.col("f.url")).alias("fallback_url"),
        F.when(used, F.col("f.n_items")).alias("fallback_count"),
        F.when(F.col("p").isNull(), "no_candidate").alias("error"),
    )
