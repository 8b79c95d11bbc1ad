"""Listing pages: repeated cards, their pattern, and rule-driven item extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import contains_any, let, let_sql
from feedweir.functions.images import feed_image_or_null
from feedweir.functions.links import likely_href
from feedweir.functions.text import CLEAN, clean_summary, clean_text, likely_listing_title, likely_summary, likely_title, parse_date
from feedweir.functions.urls import absolute_url, canonical_url, resolved_url, trim_ascii, url_hash, url_host, url_path
from feedweir.operators.pages import WS, below, text_of
from feedweir.session import stage

HEADINGS = "('h1', 'h2', 'h3', 'h4')"
TITLED = "(y.tag = 'a' AND (contains(lower(y.attrs['class']), 'title') OR contains(lower(y.attrs['class']), 'headline')))"
LINKED = "(y.tag = 'a' AND y.attrs['href'] IS NOT NULL)"
IN_HEADING = "concat(substring(y.path, length(n.path) + length(n.tag) + 2), '/') RLIKE '/h[1-4]/'"
DATED = "(y.tag = 'time' OR y.attrs['datetime'] IS NOT NULL OR y.attrs['data-datetime'] IS NOT NULL)"
BLOCKED_IMAGE = " OR ".join(f"contains(s, '{w}')" for w in S.LISTING_IMAGE_BLOCKED)


NOT_WS = WS.replace("[", "[^", 1)


def _normal(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, r'{WS}+', ' '), r'^ | $', '')"


def _first(condition: str, nodes: str = "d") -> str:
    return f"try_element_at(filter({nodes}, y -> coalesce({condition}, false)), 1)"


def _text(node: str) -> str:
    """Text content of the node expression, null without a node."""
    return let_sql(node, "z", f"CASE WHEN z IS NOT NULL THEN {text_of('z')} END")


def _first_non_blank(values: list[str]) -> str:
    return f"coalesce(try_element_at(filter(array({', '.join(values)}), v -> v RLIKE r'{NOT_WS}'), 1), '')"


#: What a card is read from, picked out of its nodes ``d`` once: links and headings, dated elements, images, long paragraphs.
_PARTS = f"""named_struct(
    'heads', filter(d, y -> y.tag IN {HEADINGS} OR y.tag = 'a'),
    'dated', filter(d, y -> coalesce({DATED}, false)),
    'images', filter(d, y -> y.tag = 'img'),
    'ps', filter(transform(filter(d, y -> y.tag = 'p'), y -> {text_of('y')}), t -> length({_normal('t')}) >= {S.LISTING_SUMMARY_MIN}))"""
_TITLE_NODES = [TITLED, f"{LINKED} AND {IN_HEADING}", f"y.tag IN {HEADINGS}", LINKED]
_HREF_NODES = [TITLED, f"{LINKED} AND {IN_HEADING}", LINKED]
_DATE = let_sql(
    "try_element_at(k.dated, 1)", "z",
    f"CASE WHEN z.tag = 'time' THEN {text_of('z')} ELSE coalesce(z.attrs['datetime'], z.attrs['data-datetime']) END",
)
CARD = f"""named_struct(
    'node_id', n.id, 'tag', n.tag, 'classes', coalesce(n.attrs['class'], ''),
    'in_main', contains(concat(n.path, '/'), '/main/'),
    'title', {let_sql(_first_non_blank([_text(_first(c, 'k.heads')) for c in _TITLE_NODES]), 't', CLEAN)},
    'href', {_first_non_blank([_first(c, 'k.heads') + ".attrs['href']" for c in _HREF_NODES])},
    'has_heading', exists(k.heads, y -> y.tag <> 'a'),
    'has_time', exists(k.dated, y -> y.tag = 'time'),
    'has_date', size(k.dated) > 0,
    'summary', coalesce(try_element_at(k.ps, 1), ''),
    'has_image', exists(k.images, y -> trim(y.attrs['src']) <> '' AND NOT {let_sql("lower(y.attrs['src'])", 's', BLOCKED_IMAGE)}),
    'rule_title', coalesce({_text(_first(f"{TITLED} OR ({LINKED} AND {IN_HEADING}) OR y.tag <> 'a'", 'k.heads'))}, ''),
    'rule_href', coalesce(trim({_first(LINKED, 'k.heads')}.attrs['href']), ''),
    'rule_summary', coalesce(try_element_at(filter(k.ps, t -> NOT contains(lower(t), 'subscribe') AND NOT contains(lower(t), 'privacy')), 1), ''),
    'rule_date', coalesce(trim({_DATE}), ''))"""
#: Null for an element without a link.
_CARD_OR_NULL = let_sql(below("n"), "d", f"CASE WHEN exists(d, y -> {LINKED}) THEN {let_sql(_PARTS, 'k', CARD)} END")
CARDS = f"""transform(filter(nodes, n -> n.tag IN ({', '.join(f"'{t}'" for t in S.CARD_TAGS)}) OR n.attrs['class'] IS NOT NULL),
    n -> {_CARD_OR_NULL})"""


def preferred_class(classes: Column) -> Column:
    """First class name that is neither generic nor a utility or state class."""
    return F.try_element_at(
        F.filter(
            F.split(F.trim(classes), r"\s+"),
            lambda c: (c != "") & ~F.lower(c).isin(S.SIGNATURE_CLASSES_BLOCKED) & ~F.lower(c).rlike(S.SIGNATURE_CLASS_PREFIXES),
        ),
        F.lit(1),
    )


def signature(tag: Column, classes: Column) -> Column:
    name = preferred_class(classes)
    return F.when(name.isNotNull(), F.concat(tag, F.lit(":"), name)).when(tag.isin(S.CARD_TAGS), tag)


def node_signatures(shredded: DataFrame) -> DataFrame:
    """Signature of every card-like element."""
    tags = ", ".join(f"'{t}'" for t in S.CARD_TAGS)
    rows = shredded.select("page_id", F.explode_outer(F.expr(f"filter(nodes, n -> n.tag IN ({tags}))")).alias("n")).where("n IS NOT NULL")
    return rows.select(
        "page_id", F.col("n.id").alias("node_id"), signature(F.col("n.tag"), F.coalesce(F.col("n.attrs")["class"], F.lit(""))).alias("signature")
    )


def card_rows(shredded: DataFrame) -> DataFrame:
    """One row per element that holds a link, with everything detection and validation need."""
    pages = shredded.select("page_id", canonical_url("url").alias("base"), "nodes")
    rows = pages.select("page_id", "base", F.explode_outer(F.expr(CARDS)).alias("c")).where("c IS NOT NULL").select("page_id", "base", "c.*")
    return rows.withColumn("class", preferred_class(F.col("classes"))).withColumn(
        "signature", signature(F.col("tag"), F.col("classes"))
    )


def blocked_copy(value: Column) -> Column:
    return let(F.lower(F.trim(value)), lambda t: contains_any(t, S.LISTING_COPY_BLOCKED))


def card_fields(shredded: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """Likely article cards of a page with title, target and what else they carry; ``cards``: written :func:`card_rows`."""
    cards = (card_rows(shredded) if cards is None else cards).where(
        ((F.col("tag").isin(S.CARD_TAGS) & F.col("in_main")) | (F.col("tag") == "article"))
        & F.col("signature").isNotNull()
    )
    return cards.where(likely_listing_title("title") & likely_href("href", "base", resolved_url)).select(
        "page_id", "node_id", "signature", "tag", "class", "title", "href", "has_date",
        ((F.col("summary") != "") & ~blocked_copy(clean_text("summary"))).alias("has_summary"), "has_image",
    )


def detect_patterns(cards: DataFrame) -> DataFrame:
    """Best repeated card signature per page with its confidence (before validation)."""
    groups = cards.groupBy("page_id", "signature", "tag", "class").agg(
        F.count("*").alias("items"),
        F.avg(F.col("has_date").cast("int")).alias("date_ratio"),
        F.avg(F.col("has_summary").cast("int")).alias("summary_ratio"),
        F.avg(F.col("has_image").cast("int")).alias("image_ratio"),
        F.avg(F.length("title")).alias("title_length"),
        F.min("node_id").alias("_first"),
    ).where(F.col("items") >= S.PATTERN_MIN_ITEMS)
    classed = F.col("class").isNotNull()
    score = (
        F.col("items") * 10
        + F.round(F.col("date_ratio") * 8)
        + F.round(F.col("summary_ratio") * 5)
        + F.round(F.col("image_ratio") * 3)
        + F.when(classed, 4).otherwise(0)
        + F.round(F.least(F.lit(4.0), F.col("title_length") / 32))
    ).cast("int")
    confidence = F.least(
        F.lit(0.95),
        F.lit(0.46)
        + F.least(F.lit(0.24), F.col("items") * 0.035)
        + F.col("date_ratio") * 0.12
        + F.col("summary_ratio") * 0.09
        + F.col("image_ratio") * 0.04
        + F.when(classed, 0.08).otherwise(0.0),
    )
    scored = groups.withColumn("score", score).withColumn("confidence", confidence)
    fields = ["signature", "tag", "class", "items", "score", "confidence"]
    best = scored.groupBy("page_id").agg(F.max_by(F.struct(*fields), F.struct("score", -F.col("_first"))).alias("b"))
    return best.select("page_id", "b.*").where(F.col("confidence") >= S.PATTERN_MIN_CONFIDENCE)


def pattern_validation(cards: DataFrame, patterns: DataFrame) -> DataFrame:
    """Items the chosen pattern's rule really yields, of written :func:`card_rows`; accepted when enough of them are valid."""
    wanted = patterns.select("page_id", F.col("tag").alias("_tag"), F.col("class").alias("_class"), "items")
    headed = F.col("has_heading")
    loose = F.col("in_main") & (headed | F.col("has_time"))
    member = (
        F.when(F.col("_class").isNotNull(), F.array_contains(F.split("classes", r"\s+"), F.col("_class")) & headed)
        .when(F.col("_tag") == "article", (F.col("tag") == "article") & headed)
        .when(F.col("_tag") == "li", (F.col("tag") == "li") & loose)
        .otherwise(F.col("tag").isin("div", "section") & loose)
    )
    valid = (
        likely_listing_title(clean_text("rule_title"))
        & likely_href("rule_href", "base", resolved_url)
        & ~((F.col("rule_summary") != "") & blocked_copy(clean_text("rule_summary")))
        & ((F.col("rule_summary") != "") | (F.col("rule_date") != ""))
    )
    counted = cards.join(wanted, "page_id").where(member).groupBy("page_id").agg(
        F.count_if(valid).alias("valid_items")
    )
    need = F.greatest(F.lit(3), F.least(F.lit(5), F.col("items")))
    return wanted.join(counted, "page_id", "left").select(
        "page_id",
        F.coalesce("valid_items", F.lit(0)).alias("valid_items"),
        (F.coalesce("valid_items", F.lit(0)) >= need).alias("accepted"),
    )


def detect_listing_patterns(shredded: DataFrame) -> DataFrame:
    """Accepted pattern per page. Cards are read from the nodes once and written, and so are the patterns, one row per page."""
    cards = stage(card_rows(shredded), "cards")
    patterns = stage(detect_patterns(card_fields(shredded, cards)), "patterns")
    checked = pattern_validation(cards, patterns)
    return patterns.join(checked.where("accepted"), "page_id").select(
        "page_id", "signature", "items", "valid_items", "score", F.round(F.round("confidence", 9), 2).alias("confidence")
    )


# --- rule-driven extraction --------------------------------------------------------------------------
RULE = "url_hash STRING, schema_id BIGINT, version INT, within STRING, item_tags ARRAY<STRING>, item_class STRING, needs_heading BOOLEAN, title_tags ARRAY<STRING>"
_MATCH = """(within IS NULL OR contains(concat(n.path, '/'), concat('/', within, '/')))
    AND (item_tags IS NULL OR array_contains(item_tags, n.tag))
    AND (item_class IS NULL OR contains(concat(' ', n.attrs['class'], ' '), concat(' ', item_class, ' ')))"""
_HAS = f"exists(d, y -> {LINKED}) AND (NOT needs_heading OR exists(d, y -> y.tag IN {HEADINGS}))"
EXTRACT = f"""filter(transform(filter(nodes, n -> n.tag <> '#text' AND coalesce({_MATCH}, false)),
    n -> element_at(transform(array({below('n')}), d -> CASE WHEN {_HAS} THEN named_struct(
        'title', coalesce({_text(_first("array_contains(title_tags, y.tag) AND (y.tag <> 'a' OR y.attrs['href'] IS NOT NULL)"))}, ''),
        'href', coalesce(trim({_first(LINKED)}.attrs['href']), ''),
        'summary', coalesce({_text(_first("y.tag = 'p'"))}, ''),
        'image', coalesce(trim({_first("y.tag = 'img'")}.attrs['src']), ''),
        'date', coalesce(trim({_text(_first("y.tag = 'time'"))}), '')) END), 1)), x -> x IS NOT NULL)"""


def _items_of_page(extracted: Column, url: Column) -> Column:
    """Extracted fields of a page's items → its items: one per URL, weak ones gone where there are better ones."""

    def made(i: Column) -> Column:
        image = F.when(i["image"] != "", feed_image_or_null(absolute_url(i["image"], url)))
        return F.struct(
            i["href"].alias("href"), absolute_url(i["href"], url).alias("url"), clean_text(i["title"]).alias("title"),
            clean_summary(i["summary"]).alias("summary"), image.alias("listing_image_url"), parse_date(i["date"]).alias("published_at"),
        )

    def shown(x: Column) -> Column:
        summary = F.when(likely_summary(x["summary"]), x["summary"]).alias("listing_summary")
        rest = [x[c].alias(c) for c in ("url", "title", "listing_image_url", "published_at")]
        score = candidate_score(x["url"], url, x["title"], F.lit(None).cast("string"), x["published_at"])
        return F.struct(*rest, summary, score.alias("score"))

    usable = F.filter(F.transform(extracted, made), lambda x: (x["href"] != "") & likely_title(x["title"]))
    once = F.map_values(F.map_from_entries(F.transform(usable, lambda x: F.struct(url_hash(x["url"]), x))))
    good = lambda x: x["score"] >= S.CANDIDATE_MIN_SCORE
    return let(F.transform(once, shown), lambda xs: F.when(F.exists(xs, good), F.filter(xs, good)).otherwise(xs))


def schema_extract_items(shredded: DataFrame, rules: DataFrame, limit: int | None = None) -> DataFrame:
    """Items of every page whose source has an active rule, numbered from 0; weak candidates go when better ones exist.

    A page is one row: its items are found, de-duplicated (the last one's values at the first one's place), judged and cut to
    ``limit`` within it.
    """
    keyed = shredded.withColumn("url_hash", url_hash(canonical_url("url"))).join(rules, "url_hash")
    items = _items_of_page(F.expr(EXTRACT), F.col("url"))
    items = items if limit is None else F.slice(items, 1, limit)
    rows = keyed.select("page_id", "url", "schema_id", "version", F.posexplode_outer(items).alias("pos", "i")).where("pos IS NOT NULL")
    return rows.select(
        "page_id", F.col("url").alias("source_url"), "schema_id", "version", "pos", "i.url", "i.title", "i.listing_image_url", "i.published_at",
        F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("image_url"), "i.listing_summary", "i.score",
    )


def candidate_score(url: Column, source_url: Column, title: Column, summary: Column, published: Column) -> Column:
    """Points for looking like an article rather than a section, file or foreign page. Each part of the URL is worked out once."""

    def points(hit: Column, value: int) -> Column:
        return F.when(F.coalesce(hit, F.lit(False)), F.lit(value)).otherwise(F.lit(0))

    def scored(x: Column) -> Column:
        host, own, path, segments = x["host"], x["own"], x["path"], x["segments"]
        depth = F.size(segments)
        related = (host == own) | F.endswith(host, F.concat(F.lit("."), own)) | F.endswith(own, F.concat(F.lit("."), host))
        known = (host != "") & (own != "")
        section = F.lower(F.regexp_replace(path, "^/", "")).isin(S.CANDIDATE_PATHS_BLOCKED)
        return (
            points(known & related, 1)
            + points(known & ~related, -2)
            + points(depth >= 2, 2)
            + points(depth == 0, -5)
            + points(section, -3)
            + points(section & (depth <= 1), -2)
            + points(path.rlike(rf"(?i)\.({'|'.join(S.CANDIDATE_EXTENSIONS_BLOCKED)})$"), -4)
            + points(x["published"], 2)
            + points(x["summary"] >= 40, 1)
            + points(x["title"] >= 24, 1)
            + points(x["title"] < 10, -1)
            + points(path.rlike(r"/(20\d{2}|19\d{2})/"), 1)
            + points((depth >= 2) & F.contains(F.try_element_at(segments, F.lit(-1)), F.lit("-")), 1)
        )

    def parts(x: Column) -> Column:
        path = F.concat(F.lit("/"), F.regexp_replace(url_path(x["url"]), "^/+|/+$", ""))
        own = F.coalesce(url_host(x["source"]), F.lit("")).alias("own")
        host = F.coalesce(url_host(x["url"]), F.lit("")).alias("host")
        rest = [x[c].alias(c) for c in ("title", "summary", "published")]
        return let(path, lambda p: F.struct(host, own, p.alias("path"), F.filter(F.split(p, "/"), lambda s: s != "").alias("segments"), *rest))

    given = F.struct(
        canonical_url(url).alias("url"), source_url.alias("source"), F.length(trim_ascii(title)).alias("title"),
        F.length(trim_ascii(summary)).alias("summary"), published.isNotNull().alias("published"),
    )
    return let(given, lambda x: let(parts(x), scored))


def score_article_candidates(items: DataFrame, key: str) -> DataFrame:
    """Keep items scoring at least 2; where a listing has none, keep all of it.

    Items are scored once and written; good ones stay as they are, and only low ones are held against the keys that have a good one.
    """
    score = candidate_score(F.col("url"), F.col("source_url"), F.col("title"), F.col("summary"), F.col("published_at"))
    scored = stage(items.withColumn("score", score), "scored")
    good = F.col("score") >= S.CANDIDATE_MIN_SCORE
    better = scored.where(good).select(key).distinct()
    return scored.where(good).unionByName(scored.where(~good).join(better, key, "left_anti"))
