"""Sample payloads: every document rendered as one feed, one item per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SITE = "https://feed.example.org"


def _xml(x: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def _s(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(x)


def payloads(docs: DataFrame) -> DataFrame:
    """doc_id % 4: RSS, Atom, JSON Feed, an HTML listing; the declared type is wrong for every fifth."""
    doc = F.col("doc_id")
    lines = F.split("text", "\n")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")

    def at(i: Column) -> Column:
        return start + F.make_dt_interval(mins=i)

    def url(i: Column) -> Column:
        return F.concat(_s("/d/"), _s(doc), _s("/"), _s(i % 7))

    def guid(i: Column) -> Column:
        return F.concat(_s("g-"), _s(doc), _s("-"), _s(i))

    def rss(line: Column, i: Column) -> Column:
        return F.concat(
            _s("<item><title>"), _xml(line), _s("</title><link>"), url(i), _s("</link><guid isPermaLink=\"false\">"), guid(i),
            _s("</guid><description>"), _xml(line), _s("</description><pubDate>"),
            F.date_format(at(i), "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), _s("</pubDate>"),
            F.when(i % 3 == 0, F.concat(_s("<enclosure type=\"image/png\" url=\"https://cdn.example.org/i/"), _s(i), _s(".png\"/>")))
            .when(i % 3 == 1, F.concat(_s("<content:encoded><![CDATA[<p><img src=\"/img/"), _s(i), _s(".png\"/></p>]]></content:encoded>")))
            .otherwise(_s("")),
            _s("</item>"),
        )

    def atom(line: Column, i: Column) -> Column:
        return F.concat(
            _s("<entry><title>"), _xml(line), _s("</title><link rel=\"self\" href=\"/self\"/><link href=\""), url(i), _s("\"/>"),
            F.when(i % 3 == 0, F.concat(_s("<link rel=\"enclosure\" type=\"image/png\" href=\"https://cdn.example.org/i/"), _s(i), _s(".png\"/>")))
            .otherwise(_s("")),
            _s("<id>"), guid(i), _s("</id><summary>"), _xml(line), _s("</summary><content type=\"html\">"),
            F.when(i % 3 == 1, F.concat(_s("&lt;img src=\"/img/"), _s(i), _s(".png\"&gt;"))).otherwise(_s("text")),
            _s("</content><updated>"), F.date_format(at(i), "yyyy-MM-dd'T'HH:mm:ss'Z'"), _s("</updated></entry>"),
        )

    def json_item(line: Column, i: Column) -> Column:
        return F.struct(
            guid(i).alias("id"), url(i).alias("url"), line.alias("title"), line.alias("content_text"),
            F.when(i % 3 == 0, F.concat(_s("https://cdn.example.org/i/"), _s(i), _s(".png"))).alias("image"),
            F.when(
                i % 3 == 1,
                F.array(F.struct(F.concat(_s("/img/"), _s(i), _s(".png")).alias("url"), F.lit("image/png").alias("mime_type"))),
            ).alias("attachments"),
            F.date_format(at(i), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_published"),
        )

    def story(line: Column, i: Column) -> Column:
        return F.concat(
            _s("<article class=\"lead story\">"),
            F.when(i % 2 == 0, F.concat(_s("<time>"), F.date_format(at(i), "yyyy-MM-dd HH:mm:ss"), _s("</time>"))).otherwise(_s("")),
            _s("<h2><a href=\""), F.when(i % 7 == 6, _s("/tag")).otherwise(url(i)), _s("\">"), _xml(line), _s("</a></h2><p>"), _xml(line), _s("</p><img src=\"/img/"),
            F.when(i % 3 == 1, F.concat(_s(i), _s(".png"))).otherwise(_s("avatar.jpg")), _s("\"></article>"),
        )

    kind = doc % 4
    body = (
        F.when(
            kind == 0,
            F.concat(
                _s("<?xml version=\"1.0\"?><rss version=\"2.0\" xmlns:content=\"http://purl.org/rss/1.0/modules/content/\"><channel><title>t</title>"),
                F.array_join(F.transform(lines, rss), ""), _s("</channel></rss>"),
            ),
        )
        .when(
            kind == 1,
            F.concat(
                _s("<feed xmlns=\"http://www.w3.org/2005/Atom\"><title>t</title>"), F.array_join(F.transform(lines, atom), ""), _s("</feed>")
            ),
        )
        .when(
            kind == 2,
            F.to_json(F.struct(F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.transform(lines, json_item).alias("items"))),
        )
        .otherwise(
            F.concat(
                _s("<html><body><nav><ul><li><a href=\"/about\">About this site</a></li></ul></nav><main>"),
                F.array_join(F.transform(lines, story), ""), _s("</main></body></html>"),
            )
        )
    )
    declared = F.when(doc % 5 == 0, "unknown").otherwise(
        F.element_at(F.array(*[F.lit(x) for x in ("rss", "atom", "json_feed", "html")]), (kind + 1).cast("int"))
    )
    return docs.select(
        doc.alias("payload_id"),
        (doc % 20).alias("source_id"),
        F.concat(F.lit(f"{SITE}/p/"), _s(doc)).alias("final_url"),
        declared.alias("source_type"),
        body.alias("body"),
    )


def listing_pages(docs: DataFrame) -> DataFrame:
    """Listing page per document: feed announcements, page metadata and one card per line."""
    doc = F.col("doc_id")
    number = doc.cast("string")

    def card(line: Column, i: Column) -> Column:
        return F.concat(
            _s("<article"), F.when(doc % 2 == 0, _s(" class=\"card news-card\"")).otherwise(_s(" class=\"item\"")), _s(">"),
            F.when(i % 2 == 0, _s("<time datetime=\"2024-01-05\">5 Jan</time>")).otherwise(_s("")),
            _s("<h2><a href=\"/story/"), number, _s("/"), _s(i), _s("\">"), _xml(line), _s("</a></h2><p>"), _xml(line), _s("</p>"),
            F.when(i % 3 == 0, F.concat(_s("<img src=\"/img/"), _s(i), _s(".jpg\">"))).otherwise(_s("<img src=\"/img/avatar.jpg\">")),
            _s("</article>"),
        )

    head = F.concat(
        _s("<html><head><link rel=\"alternate\" type=\"application/rss+xml\" title=\"Feed\" href=\"https://feed.example.org/p/"), number,
        _s("\"><meta property=\"og:description\" content=\"A description of the listing number "), number, _s("\">"),
        F.when(doc % 3 == 0, F.concat(_s("<meta property=\"og:image\" content=\"https://cdn.example.org/lead/"), number, _s(".png\">"))).otherwise(_s("")),
        _s("</head><body><a href=\"https://feed.example.org/p/"), number, _s("?format=rss.xml\" title=\"RSS feed\">Follow</a><main>"),
    )
    body = F.array_join(F.transform(F.split("text", "\n"), card), "")
    return docs.select(
        doc.alias("page_id"),
        F.concat(F.lit("https://list.example.org/s/"), number).alias("url"),
        F.concat(head, body, _s("</main></body></html>")).alias("html"),
    )
