"""Queries over the text, date, title, image and slug expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions import images, links, text
from feedweir.operators import upserts
from feedweir.operators.partitioning import spread
from feedweir.plans.oracle_parts import absolute, any_of, clean, limit, path
from feedweir.plans.registry import query


@query("clean_text", f"SELECT page_id AS id, {clean('html')} AS clean FROM v_pages")
def clean_text(v):
    return spread(v.pages).select(F.col("page_id").alias("id"), text.clean_text("html").alias("clean"))


@query("truncate_text", f"SELECT doc_id AS id, {limit('text', 420)} AS short FROM v_docs")
def truncate_text(v):
    return v.docs.select(F.col("doc_id").alias("id"), text.truncate_text("text", S.SUMMARY_LIMIT).alias("short"))


LINES = "(SELECT doc_id AS id, unnest(range(len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS line FROM v_docs)"


def lines(v):
    """Every line of every document by its number."""
    return spread(v.docs).select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(
    "title_or_default",
    f"""SELECT id, pos, {limit('coalesce(nullif(' + clean('line') + ", ''), 'Untitled article')", 240)} AS title
        FROM (SELECT id, pos, CASE WHEN (id + pos) % 7 = 0 THEN ' <p> </p>' ELSE line END AS line FROM {LINES} l) m""",
)
def title_or_default(v):
    """Every line as a title; every seventh is blank markup."""
    line = F.when((F.col("id") + F.col("pos")) % 7 == 0, F.lit(" <p> </p>")).otherwise(F.col("line"))
    return lines(v).select("id", "pos", text.title_or_default(line).alias("title"))


@query("nullable_summary", f"SELECT doc_id AS id, {limit('nullif(' + clean('text') + chr(44) + chr(39)*2 + ')', 420)} AS summary FROM v_docs")
def nullable_summary(v):
    return spread(v.docs).select(F.col("doc_id").alias("id"), text.nullable_summary("text").alias("summary"))


@query(
    "parse_dates",
    """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 6 THEN NULL WHEN 5 THEN o_orderdate
            WHEN 2 THEN o_orderdate + (o_orderkey % 86400) * INTERVAL '1' SECOND - INTERVAL '2' HOUR
            WHEN 3 THEN o_orderdate + CAST(floor((o_orderkey % 86400) / 60) AS BIGINT) * INTERVAL '1' MINUTE + INTERVAL '5' HOUR
            ELSE o_orderdate + (o_orderkey % 86400) * INTERVAL '1' SECOND END AS published_at FROM orders""",
)
def parse_dates(v):
    """Order times rendered in seven feed spellings, then parsed back."""
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    kind = F.col("o_orderkey") % 7
    spelled = (
        F.when(kind == 0, F.date_format(at, "EEE, d MMM yyyy HH:mm:ss 'GMT'"))
        .when(kind == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(kind == 3, F.date_format(at, "EEEE, dd MMM yyyy HH:mm 'EST'"))
        .when(kind == 4, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 5, F.date_format(at, "yyyy-MM-dd"))
        .otherwise(F.concat(F.lit("around "), F.date_format(at, "yyyy-MM-dd")))
    )
    return v.table("orders").select(F.col("o_orderkey").alias("id"), text.parse_date(spelled).alias("published_at"))


@query("repair_utf8", "SELECT doc_id AS id, text || CASE WHEN doc_id % 3 = 0 THEN chr(65533) ELSE '' END || ' end' AS text FROM v_docs")
def repair_utf8(v):
    """Documents come back as written: two of three with a broken byte spliced in, one of three with a replacement mark of their own."""
    doc = F.col("doc_id")
    mark = F.when(doc % 3 == 0, F.unhex(F.lit("EFBFBD"))).otherwise(F.unhex(F.lit("")))
    byte = F.when(doc % 3 != 1, F.unhex(F.lit("D1"))).otherwise(F.unhex(F.lit("")))
    broken = F.concat(F.encode("text", "UTF-8"), mark, byte, F.encode(F.lit(" end"), "UTF-8"))
    return v.docs.select(F.col("doc_id").alias("id"), text.repair_utf8(broken).alias("text"))


BLANKS = " || chr(9) || chr(10) || chr(11) || chr(13) || chr(0)"
TRIMMED = f"lower(trim(line, ' '{BLANKS}))"


@query(
    "likely_titles",
    f"""SELECT id, pos, line AS title FROM {LINES} l WHERE length({TRIMMED}) BETWEEN 12 AND 220 AND NOT {any_of(TRIMMED, S.FEED_TITLE_BLOCKED)}""",
)
def likely_titles(v):
    return lines(v).where(text.likely_title("line")).withColumnRenamed("line", "title")


@query(
    "likely_summaries",
    f"""SELECT id, pos, line AS summary FROM {LINES} l WHERE length({TRIMMED}) >= 24 AND NOT {any_of(TRIMMED, S.FEED_SUMMARY_BLOCKED)}""",
)
def likely_summaries(v):
    return lines(v).where(text.likely_summary("line")).withColumnRenamed("line", "summary")


HREFS = """SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM v_pages
    UNION ALL SELECT page_id, url, CASE page_id % 8 WHEN 0 THEN '#top' WHEN 1 THEN 'mailto:a@b.org' WHEN 2 THEN '/tag/x'
        WHEN 3 THEN '/img/a.PNG' WHEN 4 THEN 'story.html' WHEN 5 THEN ' ' WHEN 6 THEN 'https://e.org/about-us'
        ELSE 'JavaScript:void(0)' END FROM v_pages"""


@query(
    "likely_hrefs",
    f"""SELECT page_id, href FROM (SELECT *, lower({absolute('href', 'base')}) AS a FROM ({HREFS}) l) x
        WHERE trim(href) <> '' AND NOT regexp_matches(lower(trim(href)), '^(#|javascript:|mailto:|tel:)')
          AND NOT regexp_matches({path('a')}, '\\.(jpg|jpeg|png|gif|svg|webp|ico|pdf|xml)$') AND NOT {any_of('a', S.HREF_PATHS_BLOCKED)}""",
)
def likely_hrefs(v):
    extra = ["#top", "mailto:a@b.org", "/tag/x", "/img/a.PNG", "story.html", " ", "https://e.org/about-us", "JavaScript:void(0)"]
    pages = v.pages.withColumn(
        "href",
        F.explode(
            F.concat(
                F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)),
                F.array(F.element_at(F.array(*[F.lit(e) for e in extra]), (F.col("page_id") % 8 + 1).cast("int"))),
            )
        ),
    ).select("page_id", "href", "url")
    return pages.where(links.likely_href("href", "url")).select("page_id", "href")


IMAGE_SQL = f"""NOT (({any_of('lower(url)', S.PAGE_IMAGE_BLOCKED)})
    OR (contains(url, 'cdn-cgi/image/') AND (contains(url, 'fit=crop') OR contains(url, 'gravity=face')))
    OR regexp_matches(url, '[?&](s|size|w|width|h|height)=([1-9]|[1-5][0-9])(&|$)', 'i')
    OR trim({path('url')}) = '' OR (regexp_matches({path('url')}, '/is/(content|image)/') AND NOT regexp_matches({path('url')}, '\\.[^./]+$'))
    OR regexp_matches({path('url')}, '/[0-9]+/?$'))"""
IMAGES = """SELECT o_orderkey AS id, 'https://cdn.example.org' || CASE o_orderkey % 12 WHEN 0 THEN '/img/' || o_custkey || '.png'
    WHEN 1 THEN '/avatar/a.png' WHEN 2 THEN '/cdn-cgi/image/fit=crop,width=900/a.png' WHEN 3 THEN '/a.png?w=48'
    WHEN 4 THEN '/a.png?w=480&h=' || o_custkey WHEN 5 THEN '' WHEN 6 THEN '/is/image/abc' WHEN 7 THEN '/is/image/abc.jpg'
    WHEN 8 THEN '/photos/' || o_custkey WHEN 9 THEN '/user/' || o_custkey || '.jpg' WHEN 10 THEN '/cdn-cgi/image/gravity=auto/a.png'
    ELSE '/b/' || o_custkey || '/c.webp' END AS url FROM orders"""


@query("acceptable_images", f"SELECT id, url, coalesce({IMAGE_SQL}, false) AS ok FROM ({IMAGES}) i")
def acceptable_images(v):
    rows = v.spark.sql(IMAGES.replace("FROM orders", f"FROM parquet.`{v.dir}/orders.parquet`"))
    return rows.select("id", "url", images.acceptable_image("url").alias("ok"))


@query(
    "extract_json_object",
    """SELECT event_id AS id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE props END AS json FROM events""",
)
def extract_json_object(v):
    kind = F.col("event_id") % 5
    wrapped = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" as asked.")))
        .when(kind == 2, F.col("props"))
        .when(kind == 3, F.concat(F.lit("{ broken "), F.col("props")))
        .otherwise(F.lit("nothing here"))
    )
    return v.table("events").select(F.col("event_id").alias("id"), text.extract_json_object(wrapped).alias("json"))


@query(
    "article_slugs",
    """SELECT id, coalesce(nullif(rtrim(ltrim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s-]+', '', 'g'), '[-\\s]+', '-', 'g'), '-'), '-'), ''), 'article')
        || '-uk-' || left(md5(CAST(id AS VARCHAR) || '-uk'), 8) AS slug FROM v_articles""",
)
def article_slugs(v):
    return v.articles.select(
        "id", text.article_slug("title", F.lit("uk"), F.concat(F.col("id").cast("string"), F.lit("-uk"))).alias("slug")
    )


@query(
    "capture_snapshots",
    """SELECT page_id, url, 'fetch_payload' AS snapshot_kind, html AS html_snapshot, CAST(strlen(html) AS BIGINT) AS body_bytes,
        sha256(html) AS content_hash FROM v_pages""",
)
def capture_snapshots(v):
    return upserts.capture_snapshots(v.pages, "html")
