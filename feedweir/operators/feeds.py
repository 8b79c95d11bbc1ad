"""Feed payloads → items (RSS / RDF, Atom, JSON Feed).

A payload is one row and its items one array, so parsing, de-duplication inside a payload and the item cap all happen
within the row: the job has no shuffle. ``items`` arrays hold :data:`ITEM` structs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from feedweir import settings as S
from feedweir.functions.core import blank_to_null, col, let, sha256_ci
from feedweir.functions.images import feed_image_or_null
from feedweir.functions.text import clean_summary, clean_text, parse_date, strip_tags, truncate_text
from feedweir.functions.urls import BLANKS, canonical_url, resolved_url, trim_ascii, url_hash
from feedweir.operators.partitioning import top_per_key
from feedweir.session import stage
from feedweir.sources.html import shred_pages

ITEM = "struct<url:string,title:string,external_id:string,summary:string,image_url:string,published_at:timestamp>"
FIELDS = ("url", "title", "external_id", "summary", "image_url", "published_at")

_RSS_ITEM = (
    "STRUCT<title: STRING, link: STRING, description: STRING, guid: STRING, pubDate: STRING, `content:encoded`: STRING, "
    "`media:content`: ARRAY<STRUCT<_url: STRING>>, `media:thumbnail`: ARRAY<STRUCT<_url: STRING>>, "
    "enclosure: ARRAY<STRUCT<_url: STRING, _type: STRING>>>"
)
RSS_SCHEMA = f"channel STRUCT<item: ARRAY<{_RSS_ITEM}>>, item ARRAY<{_RSS_ITEM}>"
ATOM_SCHEMA = (
    "entry ARRAY<STRUCT<title: STRING, id: STRING, summary: STRING, content: STRING, published: STRING, updated: STRING, "
    "link: ARRAY<STRUCT<_href: STRING, _rel: STRING, _type: STRING>>>>"
)
JSON_SCHEMA = (
    "version STRING, title STRING, items ARRAY<STRUCT<url: STRING, external_url: STRING, title: STRING, content_text: STRING, "
    "content_html: STRING, summary: STRING, id: STRING, date_published: STRING, date_modified: STRING, image: STRING, "
    "banner_image: STRING, attachments: ARRAY<STRUCT<url: STRING, mime_type: STRING>>>>"
)
ROOT = r"^(?:\s+|<\?[^>]*\?>|<!--(?:[^-]|-(?!->))*-->|<!DOCTYPE[^>\[]*>|\x{FEFF})*<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)"


def payload_kind(body: Column | str, content_type: Column | None = None) -> Column:
    """json_feed, rss, atom or html by inspecting the payload, null for anything else."""
    text = F.ltrim(col(body), F.lit(BLANKS))  # what follows the payload decides nothing

    def decide(t: Column) -> Column:
        root = F.lower(F.regexp_extract(t, ROOT, 1))
        json_version = F.when(F.startswith(t, F.lit("{")), F.get_json_object(t, "$.version"))
        is_json = F.contains(F.lower(F.coalesce(json_version, F.lit(""))), F.lit("jsonfeed.org/version"))
        markup = t.rlike("(?i)<(?:html|head|body)")
        if content_type is not None:
            markup = markup | F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html"))
        return (
            F.when(t == "", F.lit(None).cast("string"))
            .when(is_json, "json_feed")
            .when(root.isin("rss", "rdf"), "rss")
            .when(root == "feed", "atom")
            .when(markup, "html")
        )

    return let(text, decide)


def kind_confidence(kind: Column) -> Column:
    return F.when(kind == "json_feed", 0.98).when(kind.isin("rss", "atom"), 0.99).when(kind == "html", 0.45)


def first_image(html: Column, base: Column) -> Column:
    """First ``<img src>`` of an HTML fragment, resolved against the canonical ``base`` and filtered."""
    src = trim_ascii(F.regexp_extract(html, r"""(?is)<img\b[^>]*?\ssrc\s*=\s*["']?([^"'\s>]+)""", 1))
    return let(src, lambda s: F.when(s != "", let(resolved_url(s, base), feed_image_or_null)))


def _first_text(values: Column) -> Column:
    return F.try_element_at(F.filter(values, lambda x: x.isNotNull() & (x != "")), F.lit(1))


def _is_image(kind: Column) -> Column:
    return let(F.lower(trim_ascii(F.coalesce(kind, F.lit("")))), lambda k: (k == "") | F.startswith(k, F.lit("image/")))


def rss_image(i: Column, base: Column) -> Column:
    """media:content, media:thumbnail, an image enclosure, else the first picture of the body."""
    content = trim_ascii(F.coalesce(i["content:encoded"], F.lit("")))
    media = _first_text(
        F.concat(
            F.coalesce(F.transform(i["media:content"], lambda m: trim_ascii(m["_url"])), F.array()),
            F.coalesce(F.transform(i["media:thumbnail"], lambda m: trim_ascii(m["_url"])), F.array()),
            F.coalesce(
                F.transform(F.filter(i["enclosure"], lambda e: _is_image(e["_type"])), lambda e: trim_ascii(e["_url"])), F.array()
            ),
        )
    )
    body = F.when(content != "", content).otherwise(F.coalesce(i["description"], F.lit("")))
    return let(media, lambda m: F.when(m.isNotNull(), resolved_url(m, base)).otherwise(first_image(body, base)))


def atom_image(e: Column, base: Column) -> Column:
    link = _first_text(
        F.transform(
            F.filter(e["link"], lambda k: F.lower(k["_rel"]).isin("enclosure", "preview") & _is_image(k["_type"])),
            lambda k: trim_ascii(k["_href"]),
        )
    )
    body = F.coalesce(e["content"], e["summary"], F.lit(""))
    return let(link, lambda m: F.when(m.isNotNull(), resolved_url(m, base)).otherwise(first_image(body, base)))


def json_image(i: Column, base: Column) -> Column:
    attached = _first_text(
        F.transform(
            F.filter(i["attachments"], lambda a: F.startswith(F.lower(a["mime_type"]), F.lit("image/"))),
            lambda a: trim_ascii(a["url"]),
        )
    )
    direct = F.coalesce(blank_to_null(trim_ascii(F.coalesce(i["image"], i["banner_image"]))), attached)
    return let(
        direct,
        lambda m: F.when(m.isNotNull(), resolved_url(m, base)).otherwise(
            first_image(F.coalesce(i["content_html"], F.lit("")), base)
        ),
    )


def _item(fields: Sequence[str], **values: Column) -> Column:
    return F.struct(*[values[name].alias(name) for name in fields])


def rss_items(body: Column, base: Column, fields: Sequence[str] = FIELDS) -> Column:
    xml = F.from_xml(body, RSS_SCHEMA)

    def item(i: Column) -> Column:
        description = F.coalesce(i["description"], F.lit(""))
        content = trim_ascii(F.coalesce(i["content:encoded"], F.lit("")))
        return _item(
            fields,
            url=F.when(trim_ascii(i["link"]) != "", resolved_url(i["link"], base)),
            title=clean_text(F.coalesce(i["title"], F.lit(""))),
            external_id=blank_to_null(trim_ascii(i["guid"])),
            summary=blank_to_null(clean_summary(F.when(description != "", description).otherwise(content))),
            image_url=rss_image(i, base),
            published_at=parse_date(i["pubDate"]),
        )

    return let(
        xml, lambda x: F.transform(F.coalesce(x["channel"]["item"], x["item"]), item)
    )


def atom_items(body: Column, base: Column, fields: Sequence[str] = FIELDS) -> Column:
    xml = F.from_xml(body, ATOM_SCHEMA)

    def item(e: Column) -> Column:
        linked = F.filter(e["link"], lambda k: trim_ascii(k["_href"]) != "")
        alternate = F.filter(linked, lambda k: F.lower(F.coalesce(k["_rel"], F.lit("alternate"))).isin("", "alternate"))
        href = F.coalesce(
            F.try_element_at(alternate, F.lit(1))["_href"], F.try_element_at(linked, F.lit(1))["_href"]
        )
        return _item(
            fields,
            url=F.when(href.isNotNull(), resolved_url(href, base)),
            title=clean_text(F.coalesce(e["title"], F.lit(""))),
            external_id=blank_to_null(trim_ascii(e["id"])),
            summary=blank_to_null(clean_summary(F.coalesce(e["summary"], e["content"], F.lit("")))),
            image_url=atom_image(e, base),
            published_at=parse_date(F.coalesce(e["published"], e["updated"])),
        )

    return F.transform(xml["entry"], item)


def json_items(body: Column, base: Column, fields: Sequence[str] = FIELDS) -> Column:
    feed = F.from_json(body, JSON_SCHEMA)

    def item(i: Column) -> Column:
        fallback = truncate_text(
            strip_tags(F.coalesce(i["content_text"], i["content_html"], F.lit(S.JSON_DEFAULT_TITLE))), S.JSON_TITLE_LIMIT, ""
        )
        title = F.coalesce(F.when(trim_ascii(i["title"]) != "", i["title"]), fallback)
        link = F.coalesce(i["url"], i["external_url"])
        summary = F.coalesce(i["summary"], i["content_text"], i["content_html"])
        return _item(
            fields,
            url=F.when(trim_ascii(link) != "", resolved_url(link, base)),
            title=trim_ascii(title),
            external_id=blank_to_null(trim_ascii(i["id"])),
            summary=F.when(trim_ascii(summary) != "", clean_summary(summary)),
            image_url=json_image(i, base),
            published_at=parse_date(F.coalesce(i["date_published"], i["date_modified"])),
        )

    return F.transform(feed["items"], item)


PARSERS = {"rss": rss_items, "atom": atom_items, "json_feed": json_items}


def usable(items: Column) -> Column:
    """Items that have both a URL and a title."""
    return F.filter(items, lambda i: i["url"].isNotNull() & (i["title"] != ""))


def dedupe_items(items: Column) -> Column:
    """One item per URL: the last one's values at the first one's place.

    Building a map keeps the first position of a key and, under the LAST_WIN policy of the session, its last value.
    """
    return F.map_values(F.map_from_entries(F.transform(items, lambda i: F.struct(sha256_ci(i["url"]), i))))


def cap_items(items: Column, limit: int = S.PARSE_MAX_ITEMS) -> Column:
    return F.slice(items, 1, limit)


def parsed(
    payloads: DataFrame, kinds: list[str] | None = None, cap: bool = False, dedupe: bool = True, fields: Sequence[str] = FIELDS
) -> DataFrame:
    """Add ``parsed_as`` and the ``items`` array of every payload.

    ``fields``: what a caller needs of an item, ``url`` and ``title`` among it; the engine does not leave out unread fields of an array.

    A payload has one root, so at most one of the parsers can yield items whatever order they are tried in; looking at
    the root first gives the same answer as trying them one after the other.
    """
    kinds = kinds or S.FEED_TYPES
    base = F.col("_base")
    kept = StructType([f for name in fields for f in StructType.fromDDL(ITEM[7:-1]) if f.name == name])
    item = ArrayType(kept)
    items = F.lit(None).cast(item)
    for kind in kinds:
        found = usable(PARSERS[kind](F.col("body"), base, fields))
        found = dedupe_items(found) if dedupe else found
        found = cap_items(found) if cap else found
        items = F.when(F.col("_kind") == kind, found.cast(item)).otherwise(items)
    return (
        payloads.withColumns({"_kind": payload_kind("body"), "_base": canonical_url("final_url")})
        .withColumn("items", F.coalesce(items, F.array().cast(item)))
        .withColumn("parsed_as", F.when(F.size("items") > 0, F.col("_kind")))
        .drop("_kind", "_base", "body")
    )


def item_rows(parsed_payloads: DataFrame, *extra: str) -> DataFrame:
    """One row per item.

    The outer explode keeps the optimizer from adding a ``size(items) > 0`` filter below, which would parse twice.
    """
    return (
        parsed_payloads.select("payload_id", *extra, F.posexplode_outer("items").alias("pos", "i"))
        .where("pos IS NOT NULL")
        .select("payload_id", *extra, "pos", "i.*")
    )


def parse_items(payloads: DataFrame, kind: str, cap: bool = False) -> DataFrame:
    return item_rows(parsed(payloads, [kind], cap=cap))


def parse_with_fallback_order(payloads: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Items of every payload whatever its declared type, with the format that yielded them and its attempt number.

    ``rules`` (as for :func:`listings.schema_extract_items`: the active extraction rule of a source by the hash of its URL) are tried
    fourth, on payloads that no feed format finds items in. The feed items are written once; only payloads of sources with a rule that
    have none are shredded and searched. Rows that a rule yields carry its id and version and what the listing shows of an item.
    """
    order = {
        "rss": ["rss", "atom", "json_feed"],
        "atom": ["atom", "rss", "json_feed"],
        "json_feed": ["json_feed", "rss", "atom"],
    }
    attempt = F.lit(None).cast("int")
    for declared in ("rss", "atom", "json_feed", None):
        tried = order.get(declared, order["rss"])
        nth = F.array_position(F.array(*[F.lit(t) for t in tried]), F.col("parsed_as")).cast("int")
        hit = F.col("source_type") == declared if declared else ~F.coalesce(F.col("source_type"), F.lit("")).isin(list(order))
        attempt = F.when(hit, nth).otherwise(attempt)
    found = item_rows(parsed(payloads, cap=rules is not None).withColumn("attempt", attempt), "parsed_as", "attempt")
    if rules is None:
        return found
    found = stage(found, "feed-items")
    return found.unionByName(_schema_stage(payloads, found, rules), allowMissingColumns=True)


def _schema_stage(payloads: DataFrame, found: DataFrame, rules: DataFrame) -> DataFrame:
    """Items that the active rule of its source finds in a payload that has none in ``found``, in page order, numbered from 0."""
    from feedweir.operators import listings  # listings builds on the feed functions

    keyed = payloads.withColumn("_hash", url_hash(canonical_url("final_url")))
    ruled = keyed.join(rules.select(F.col("url_hash").alias("_hash")), "_hash", "left_semi")
    html = ruled.join(found.select("payload_id").distinct(), "payload_id", "left_anti")
    pages = shred_pages(html.select(F.col("payload_id").alias("page_id"), F.col("final_url").alias("url"), F.col("body").alias("html")))
    items = listings.schema_extract_items(pages, rules, S.PARSE_MAX_ITEMS)
    return items.select(
        F.col("page_id").alias("payload_id"), "pos", "url", "title", "summary", "image_url", "published_at",
        F.lit("html_schema").alias("parsed_as"), F.lit(len(S.FEED_TYPES) + 1).alias("attempt"),
        "listing_summary", "listing_image_url", "schema_id", F.col("version").alias("schema_version"),
    )


def dedupe_item_rows(items: DataFrame) -> DataFrame:
    """Row form of :func:`dedupe_items` for items that no longer sit in one payload row."""
    values = [c for c in items.columns if c not in ("payload_id", "pos")]
    return (
        items.groupBy("payload_id", url_hash("url").alias("_key"))
        .agg(F.min("pos").alias("pos"), F.max_by(F.struct(*values), F.col("pos")).alias("_v"))
        .select("payload_id", "pos", "_v.*")
    )


def cap_item_rows(items: DataFrame, limit: int = S.PARSE_MAX_ITEMS) -> DataFrame:
    return top_per_key(items, ["payload_id"], [F.col("pos").asc()], limit).drop("rn")


def fallback_candidate_items(payloads: DataFrame, candidates: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """For payloads without items: items of the first alternative feed that yields some.

    ``candidates`` holds payload_id, rank, url and type; alternatives are looked up in the payload table by URL. ``fields`` as for :func:`parsed`.
    """
    own = stage(parsed(payloads, fields=fields).select("payload_id", "final_url", "items"), "parsed")
    empty = own.where(F.size("items") == 0).select("payload_id")
    feeds = own.where(F.size("items") > 0).select(url_hash("final_url").alias("_hash"), F.col("final_url").alias("candidate_url"), "items")
    wanted = candidates.where(F.col("type").isin(S.FEED_TYPES)).join(empty, "payload_id", "left_semi").withColumn(
        "_hash", url_hash("url")
    )
    first = wanted.join(feeds, "_hash").groupBy("payload_id").agg(
        F.min_by(F.struct("candidate_url", "items"), "rank").alias("c")
    )
    return item_rows(first.select("payload_id", "c.*"), "candidate_url")


def parse_outcomes(payloads: DataFrame) -> DataFrame:
    n = F.size("items").cast("bigint")
    return parsed(payloads, fields=("url", "title")).select(
        "payload_id",
        "source_id",
        n.alias("parsed_count"),
        F.when(n > 0, "parsed").otherwise("active").alias("status"),
        F.when(n == 0, "parse_empty").alias("error_type"),
    )


def sniff_payloads(payloads: DataFrame) -> DataFrame:
    kind = payload_kind("body", F.col("content_type") if "content_type" in payloads.columns else None)
    return payloads.withColumn("type", kind).select("payload_id", "type", kind_confidence(F.col("type")).alias("confidence"))
