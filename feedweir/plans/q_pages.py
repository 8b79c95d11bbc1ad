"""Queries over pages, listings, discovery and documents."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.urls import canonical_url, url_origin
from feedweir.operators import discovery, documents, feeds, listings
from feedweir.operators import pages as P
from feedweir.operators.partitioning import spread
from feedweir.plans.oracle_parts import absolute, any_of, canon, clean, host, let, limit, path, quoted
from feedweir.plans.q_feeds import RAW, corpus
from feedweir.plans.payloads import listing_pages, payloads
from feedweir.plans.registry import query
from feedweir.session import stage
from feedweir.sources.html import shred_pages


def shredded(v):
    return shred_pages(v.pages)


def listing(v):
    """Listing pages rendered from the documents, one card per line, shredded."""
    return shred_pages(listing_pages(spread(v.docs)))


CARDS_SQL = f"""raw AS (SELECT doc_id AS page_id, g - 1 AS i, string_split(text, chr(10))[g] AS line FROM v_docs,
        unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(g)),
    norm AS (SELECT *, {clean('line')} AS t, page_id % 2 = 0 AS classed, regexp_replace(regexp_replace(line, '[ \\t\\n\\r]+', ' ', 'g'), '^ | $', '', 'g') AS nrm FROM raw),
    cards AS (SELECT page_id, i, t AS title, '/story/' || page_id || '/' || i AS href, i % 2 = 0 AS has_date, i % 3 = 0 AS has_image,
            length(nrm) >= 40 AND NOT {any_of('lower(t)', S.LISTING_COPY_BLOCKED)} AS has_summary,
            CASE WHEN classed THEN 'article:news-card' ELSE 'article' END AS signature, classed, nrm
        FROM norm WHERE length(t) BETWEEN 12 AND 220 AND NOT {any_of('lower(t)', S.LISTING_COPY_BLOCKED)}),
    pat AS (SELECT page_id, signature, classed, count(*) AS items, avg(has_date::INT) AS d, avg(has_summary::INT) AS s, avg(has_image::INT) AS m, avg(length(title)) AS tl
        FROM cards GROUP BY ALL HAVING count(*) >= 3),
    scored AS (SELECT *, CAST(items * 10 + round(d * 8) + round(s * 5) + round(m * 3) + CASE WHEN classed THEN 4 ELSE 0 END + round(least(4.0, tl / 32)) AS INT) AS score,
        least(0.95::DOUBLE, 0.46::DOUBLE + least(0.24::DOUBLE, items * 0.035::DOUBLE) + d * 0.12::DOUBLE + s * 0.09::DOUBLE + m * 0.04::DOUBLE
            + CASE WHEN classed THEN 0.08::DOUBLE ELSE 0 END) AS confidence FROM pat),
    good AS (SELECT * FROM scored WHERE confidence >= 0.62),
    valid AS (SELECT page_id, count(*) AS valid_items FROM cards WHERE (length(nrm) >= 40 AND NOT contains(lower(nrm), 'subscribe')) OR has_date GROUP BY 1)"""


ENT = "replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


def referenced(x: str) -> str:
    """The references of the sample pages as HTML decodes them in text: these four names also without a semicolon, each once."""
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


_TAGS = "html head meta title style script body nav ul li a div article h1 p b br footer".split()
# text: the markup stripped; the sample's scripts hold one end tag, which is text there
# (references are decoded before: none reaches over a tag, and none of the four makes one)
_TEXT = f"regexp_replace(regexp_replace({referenced('html')}, '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'g')"


@query(
    "page_nodes",
    "WITH t AS (" + " UNION ALL ".join(f"SELECT page_id, '{t}' AS tag, len(regexp_extract_all(html, '<{t}[ >]')) AS size FROM v_pages" for t in _TAGS)
    + f""" UNION ALL SELECT page_id, '#text', strlen({_TEXT}) + CASE WHEN contains(html, 'var t="</p>"') THEN 4 ELSE 0 END FROM v_pages)
        SELECT page_id, tag, CAST(size AS BIGINT) AS size FROM t WHERE size > 0""",
)
def page_nodes(v):
    """Elements of each kind and bytes of text per page."""
    nodes = P.page_nodes(shredded(v))
    size = F.sum(F.when(F.col("tag") == "#text", F.octet_length("text")).otherwise(1))
    return nodes.groupBy("page_id", "tag").agg(size.cast("bigint").alias("size"))


@query(
    "link_candidates",
    f"""WITH a AS (SELECT page_id, url AS base, g, regexp_extract(m, 'href="([^"]*)"', 1) AS href, trim({ENT.format(x="regexp_extract(m, '>([^<]*)', 1)")}) AS title
            FROM (SELECT page_id, url, g, ms[g] AS m FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="[^"]*">[^<]*') AS ms FROM v_pages) x,
                unnest(range(1, len(ms) + 1)) AS u(g)) y),
        k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY g) - 1 AS pos FROM a WHERE href <> '' AND title <> '')
        SELECT page_id, CAST(pos AS INT) AS pos, {absolute('href', 'base')} AS url, title FROM k WHERE pos < 50""",
)
def link_candidates(v):
    return P.link_candidates(shredded(v))


@query(
    "feed_autodiscovery",
    """SELECT doc_id AS page_id, 'https://feed.example.org/p/' || doc_id AS url, 'rss' AS type, 'Feed' AS title, 0.87::DOUBLE AS confidence FROM v_docs""",
)
def feed_autodiscovery(v):
    return P.feed_autodiscovery(listing(v))


@query(
    "feed_action_links",
    """SELECT doc_id AS page_id, 'https://feed.example.org/p/' || doc_id || '?format=rss.xml' AS url, ['rss', 'atom', 'json_feed'][doc_id % 4 + 1] AS type,
        CASE WHEN doc_id % 4 = 2 THEN 0.98::DOUBLE ELSE 0.99::DOUBLE END AS confidence FROM v_docs WHERE doc_id % 4 < 3""",
)
def feed_action_links(v):
    types = feeds.sniff_payloads(corpus(v)).join(v.docs.select(F.col("doc_id").alias("payload_id"), F.concat(F.lit("https://feed.example.org/p/"), F.col("doc_id").cast("string"), F.lit("?format=rss.xml")).alias("url")), "payload_id")
    return P.feed_action_links(listing(v), types).drop("pos")


TYPE = """CASE WHEN contains(lower(url), 'atom') THEN 'atom' WHEN contains(lower(url), 'json') OR contains(lower(url), '.feed') THEN 'json_feed'
    WHEN contains(lower(url), 'rss') OR contains(lower(url), 'feed') THEN 'rss' ELSE 'unknown' END"""


@query("url_type_heuristic", f"SELECT page_id, url, {TYPE} AS type, CASE WHEN {TYPE} = 'unknown' THEN 0.35::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM v_pages")
def url_type_heuristic(v):
    return discovery.url_type_heuristic(v.pages.select("page_id", "url"))


PATHS = ["/rss", "/rss.xml", "/feed", "/feed.xml", "/atom.xml", "/index.xml"]


@query(
    "feed_probe_plan",
    f"""WITH u AS (SELECT DISTINCT {canon('url')} AS url FROM v_pages)
        SELECT url, CAST(g - 1 AS INT) AS n, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || [{quoted(PATHS)}][g] AS probe_url FROM u, unnest(range(1, 7)) AS t(g)""",
)
def feed_probe_plan(v):
    from feedweir.functions.urls import canonical_url

    return discovery.feed_probe_plan(v.pages.select(canonical_url("url").alias("url")).distinct())


# Requested addresses: every crawled page, and every document as a listing page, as a feed or as an address that does not answer. The
# documents' feeds answer at their own addresses and, at one of eight paths, on the host of the page with their number.
_WEB_PATHS = PATHS + ["/news/rss.xml", "/no-feed"]
_MODE = "CASE WHEN doc_id % 5 = 4 THEN 'down' WHEN doc_id % 5 < 2 OR doc_id % 4 = 3 THEN 'list' ELSE 'feed' END"
_SITE_URL = """CASE {mode} WHEN 'list' THEN 'https://list.example.org/s/' || CAST(doc_id AS STRING) WHEN 'feed' THEN 'https://feed.example.org/p/' || CAST(doc_id AS STRING)
    ELSE 'https://down.example.org/' || CASE doc_id % 4 WHEN 0 THEN 'atom' WHEN 1 THEN 'x.feed' WHEN 2 THEN 'rss' ELSE 'news' END || '/' || CAST(doc_id AS STRING) END""".replace("{mode}", _MODE)
KINDS = "['rss', 'atom', 'json_feed', 'html'][{x} % 4 + 1]"
SURE = "[0.99::DOUBLE, 0.99, 0.98, 0.45][{x} % 4 + 1]::DOUBLE"
DISCOVERED = f"""{CARDS_SQL},
    req AS (SELECT page_id * 2 + 1 AS id, page_id AS of, url, 'page' AS mode, regexp_matches(html, '(?i)<(html|head|body)') AS answers FROM v_pages
        UNION ALL SELECT doc_id * 2, doc_id, {_SITE_URL}, {_MODE}, {_MODE} <> 'down' FROM v_docs),
    addr AS (SELECT doc_id AS payload_id, 'https://feed.example.org/p/' || doc_id AS url FROM v_docs
        UNION ALL SELECT doc_id, 'https://feed.example.org/p/' || doc_id || '?format=rss.xml' FROM v_docs
        UNION ALL SELECT page_id, regexp_extract({canon('url')}, '^([a-z]+://[^/]+)', 1) || [{quoted(_WEB_PATHS)}][page_id % 8 + 1] FROM v_pages JOIN v_docs ON doc_id = page_id),
    ans AS (SELECT url, {KINDS.format(x='max(payload_id)')} AS type, {SURE.format(x='max(payload_id)')} AS confidence FROM addr GROUP BY url),
    found AS (SELECT id, url AS requested_url, 0 AS stage, 0 AS n, url, CASE WHEN mode = 'feed' THEN {KINDS.format(x='of')} ELSE 'html' END AS type,
            CASE WHEN mode = 'feed' THEN {SURE.format(x='of')} ELSE 0.45::DOUBLE END AS confidence, 'content_inspection' AS strategy, false AS has_schema FROM req WHERE answers
        UNION ALL SELECT id, url, 1, 0, url, 'html', greatest(0.62::DOUBLE, least(0.99::DOUBLE, round(round(confidence, 9), 2))), 'html_pattern_detector', true
            FROM req JOIN good ON good.page_id = of JOIN valid ON valid.page_id = of WHERE mode = 'list' AND valid_items >= greatest(3, least(5, items))
        UNION ALL SELECT id, url, 2, 0, 'https://feed.example.org/p/' || of, 'rss', 0.87::DOUBLE, 'html_autodiscovery', false FROM req WHERE mode = 'list'
        UNION ALL SELECT id, r.url, 3, 0, a.url, a.type, greatest(0.84::DOUBLE, a.confidence), 'html_action_link', false
            FROM req r JOIN ans a ON a.url = 'https://feed.example.org/p/' || of || '?format=rss.xml' WHERE mode = 'list' AND a.type <> 'html'),
    probed AS (SELECT id, r.url AS requested_url, 4, g, a.url, a.type, greatest(0.72::DOUBLE, a.confidence), 'common_feed_probe', false
        FROM (SELECT *, unnest(range(1, 7)) AS g FROM req WHERE id NOT IN (SELECT id FROM found WHERE type <> 'html')) r
        JOIN ans a ON a.url = regexp_extract({canon('r.url')}, '^([a-z]+://[^/]+)', 1) || [{quoted(PATHS)}][g] WHERE a.type <> 'html'),
    cands AS (SELECT * FROM found UNION ALL SELECT * FROM probed UNION ALL SELECT id, url, 5, 0, url, {TYPE}, CASE WHEN {TYPE} = 'unknown' THEN 0.35::DOUBLE ELSE 0.6::DOUBLE END,
        CASE WHEN {TYPE} = 'unknown' THEN 'fallback_unknown' ELSE 'url_heuristic' END, false
        FROM req WHERE id NOT IN (SELECT id FROM found) AND id NOT IN (SELECT id FROM probed))"""
RANKED = f"""{DISCOVERED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY requested_url ORDER BY score DESC, stage, n) AS rank FROM (SELECT *,
    CASE type WHEN 'rss' THEN 6 WHEN 'atom' THEN 5 WHEN 'json_feed' THEN 4 WHEN 'html' THEN 2 ELSE 1 END * 1000 + CAST(round(confidence * 100) AS INT)
    + CASE WHEN type = 'html' AND has_schema THEN 5500 ELSE 0 END AS score FROM cands) s)"""


def requests(v):
    """id, url and body of every requested address."""
    crawled = v.pages.select((F.col("page_id") * 2 + 1).alias("id"), "url", F.col("html").alias("body"))
    docs = spread(v.docs)
    sites = docs.withColumn("mode", F.expr(_MODE)).withColumn("site", F.expr(_SITE_URL))
    number, site = (F.col("page_id") * 2).alias("id"), ["doc_id", "text", "site", "mode"]
    sites = sites.select(*site)
    lists = listing_pages(sites.where("mode = 'list'")).select(number, "url", F.col("html").alias("body"))
    own = payloads(sites.where("mode = 'feed'")).select((F.col("payload_id") * 2).alias("id"), F.col("final_url").alias("url"), "body")
    down = sites.where("mode = 'down'").select((F.col("doc_id") * 2).alias("id"), F.col("site").alias("url"), F.lit(None).cast("string").alias("body"))
    return crawled.union(lists).union(own).union(down)


def web_addresses(v):
    """payload_id and url of every address where a document's feed answers."""
    own = F.concat(F.lit("https://feed.example.org/p/"), F.col("doc_id").cast("string"))
    ours = v.docs.select(F.col("doc_id").alias("payload_id"), F.explode(F.array(own, F.concat(own, F.lit("?format=rss.xml")))).alias("url"))
    place = F.element_at(F.array(*[F.lit(p) for p in _WEB_PATHS]), (F.col("page_id") % 8 + 1).cast("int"))
    hosts = v.pages.select(F.col("page_id").alias("payload_id"), F.concat(url_origin(canonical_url("url")), place).alias("url"))
    return ours.union(hosts)


def ranked(v):
    answers = feeds.sniff_payloads(corpus(v)).join(web_addresses(v), "payload_id")
    return discovery.rank_candidates(discovery.discover(requests(v), answers))


def sites(v):
    """Every requested address as a source."""
    return v.pages.select((F.col("page_id") * 2 + 1).alias("id"), F.col("url").alias("source_url")).union(
        v.docs.select((F.col("doc_id") * 2).alias("id"), F.expr(_SITE_URL).alias("source_url"))
    )


@query(
    "rank_candidates",
    f"WITH {RANKED} SELECT requested_url, url, type, strategy, score, CAST(rank AS INT) AS rank FROM ranked",
)
def rank_candidates(v):
    return ranked(v).select("requested_url", "url", "type", "strategy", "score", "rank")


@query(
    "apply_discovery",
    f"""WITH {RANKED}, p AS (SELECT * FROM ranked WHERE rank = 1), f AS (SELECT r.requested_url, list(r.type || ' ' || r.url ORDER BY r.rank) AS fb
            FROM ranked r JOIN p ON p.requested_url = r.requested_url WHERE r.url <> p.url OR r.type <> p.type GROUP BY 1)
        SELECT s.id AS source_id, p.type AS source_type, 'discovered' AS status, p.url AS canonical_url, sha256(lower(p.url)) AS canonical_url_hash,
            coalesce(f.fb, []) AS fallback_candidates FROM req s JOIN p ON p.requested_url = s.url LEFT JOIN f ON f.requested_url = s.url""",
)
def apply_discovery(v):
    return discovery.apply_discovery(sites(v), ranked(v))


@query(
    "ingestion_probe",
    f"""WITH {re.sub(chr(92) + 'braw' + chr(92) + 'b', 'feed_lines', RAW)}, {RANKED},
        k AS (SELECT payload_id, count(*) AS n FROM items GROUP BY payload_id), n AS (SELECT url, max_by(n, payload_id) AS n FROM addr JOIN k USING (payload_id) GROUP BY url),
        c AS (SELECT r.*, coalesce(n.n, 0) AS n_items FROM ranked r LEFT JOIN n ON n.url = r.url), p AS (SELECT * FROM c WHERE rank = 1),
        f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY requested_url ORDER BY rank) AS rn FROM c
            WHERE rank > 1 AND n_items > 0 AND type IN ('rss', 'atom', 'json_feed')) x WHERE rn = 1)
        SELECT s.url AS requested_url, p.type AS primary_type, p.url AS primary_url, p.strategy AS primary_strategy, p.n_items AS primary_count,
            coalesce(p.n_items = 0 AND f.url IS NOT NULL AND f.url <> p.url, false) AS fallback_used, CASE WHEN p.n_items = 0 THEN f.type END AS fallback_type,
            CASE WHEN p.n_items = 0 THEN f.url END AS fallback_url, CASE WHEN p.n_items = 0 THEN f.n_items END AS fallback_count,
            CASE WHEN p.url IS NULL THEN 'no_candidate' END AS error
        FROM req s LEFT JOIN p ON p.requested_url = s.url LEFT JOIN f ON f.requested_url = s.url""",
)
def ingestion_probe(v):
    counts = feeds.parsed(corpus(v), fields=("url", "title")).select("payload_id", F.size("items").cast("bigint").alias("n"))
    some = F.col("n") > 0  # not a filter: it would be pushed below the counting and parse everything a second time
    last = F.max_by(F.when(some, F.col("n")), F.when(some, F.col("payload_id")))
    per_url = counts.join(web_addresses(v), "payload_id").groupBy("url").agg(last.alias("n_items"))
    return discovery.ingestion_probe(sites(v).select(F.col("source_url").alias("requested_url")), ranked(v), per_url)


@query(
    "node_signatures",
    """SELECT page_id, signature, n FROM (
        SELECT page_id, 'article' AS signature, CAST(len(regexp_extract_all(html, '<article>')) AS BIGINT) AS n FROM v_pages
        UNION ALL SELECT page_id, 'li', CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) FROM v_pages
        UNION ALL SELECT page_id, 'div:ad', CAST(len(regexp_extract_all(html, '<div class="ad">')) AS BIGINT) FROM v_pages) s WHERE n > 0""",
)
def node_signatures(v):
    return listings.node_signatures(shredded(v)).groupBy("page_id", "signature").agg(F.count("*").alias("n"))


@query("card_fields", f"WITH {CARDS_SQL} SELECT page_id, signature, title, href, has_date, has_summary, has_image FROM cards")
def card_fields(v):
    return listings.card_fields(listing(v)).select("page_id", "signature", "title", "href", "has_date", "has_summary", "has_image")


@query(
    "detect_listing_patterns",
    f"""WITH {CARDS_SQL} SELECT g.page_id, signature, items, valid_items, score, round(round(confidence, 9), 2) AS confidence FROM good g
        JOIN valid v ON v.page_id = g.page_id WHERE valid_items >= greatest(3, least(5, items))""",
)
def detect_listing_patterns(v):
    return listings.detect_listing_patterns(listing(v))


@query(
    "pattern_validation",
    f"""WITH {CARDS_SQL} SELECT g.page_id, coalesce(valid_items, 0) AS valid_items, coalesce(valid_items, 0) >= greatest(3, least(5, items)) AS accepted
        FROM good g LEFT JOIN valid v ON v.page_id = g.page_id""",
)
def pattern_validation(v):
    pages = listing(v)
    cards = stage(listings.card_rows(pages), "cards")
    patterns = stage(listings.detect_patterns(listings.card_fields(pages, cards)), "patterns")  # read twice below
    return listings.pattern_validation(cards, patterns)


@query(
    "schema_extract_items",
    f"""WITH a AS (SELECT page_id, url AS base, g - 1 AS pos, regexp_extract(ms[g], 'href="([^"]*)"', 1) AS href,
            regexp_extract(ms[g], 'href="[^"]*">([^<]*)', 1) AS raw FROM (SELECT page_id, url, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*') AS ms FROM v_pages) x,
            unnest(range(1, len(ms) + 1)) AS u(g)),
        b AS (SELECT page_id, base, pos, {absolute('href', 'base')} AS url, {clean('raw')} AS title FROM a),
        c AS (SELECT * FROM b WHERE length(lower(trim(title))) BETWEEN 12 AND 220 AND NOT {any_of('lower(title)', S.FEED_TITLE_BLOCKED)}),
        d AS (SELECT page_id, url, min(pos) AS place, arg_max(title, pos) AS title FROM c GROUP BY page_id, url)
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS INT) AS pos, url, title FROM d""",
)
def schema_extract_items(v):
    """Navigation entries of every page through a one-rule registry keyed by URL hash."""
    from feedweir.functions.urls import canonical_url, url_hash

    rules = v.pages.select(
        url_hash(canonical_url("url")).alias("url_hash"), F.lit(1).cast("bigint").alias("schema_id"), F.lit(1).alias("version"),
        F.lit("nav").alias("within"), F.array(F.lit("li")).alias("item_tags"), F.lit(None).cast("string").alias("item_class"),
        F.lit(False).alias("needs_heading"), F.array(F.lit("a")).alias("title_tags"),
    ).dropDuplicates(["url_hash"])
    return listings.schema_extract_items(shredded(v), rules).select("page_id", "pos", "url", "title")


def _pts(cond, n):
    return f"CASE WHEN {cond} THEN {n} ELSE 0 END"


_SP = "'/' || trim(pth, '/')"
SCORE = " + ".join(
    [
        _pts("h = o OR ends_with(h, '.' || o) OR ends_with(o, '.' || h)", 1), _pts("NOT (h = o OR ends_with(h, '.' || o) OR ends_with(o, '.' || h))", -2),
        _pts("depth >= 2", 2), _pts("depth = 0", -5), _pts(f"lower(trim(pth, '/')) IN ({quoted(S.CANDIDATE_PATHS_BLOCKED)})", -3),
        _pts(f"lower(trim(pth, '/')) IN ({quoted(S.CANDIDATE_PATHS_BLOCKED)}) AND depth <= 1", -2),
        _pts("regexp_matches(lower(pth), '\\.(jpg|jpeg|png|gif|svg|webp|pdf|xml)$')", -4), _pts("published_at IS NOT NULL", 2),
        _pts("length(trim(coalesce(summary, ''))) >= 40", 1), _pts("length(title) >= 24", 1), _pts("length(title) < 10", -1),
        _pts(f"regexp_matches({_SP}, '/(20[0-9][0-9]|19[0-9][0-9])/')", 1), _pts("depth >= 2 AND contains(split_part(trim(pth, '/'), '/', -1), '-')", 1),
    ]
)
SCORED_ITEMS = """SELECT a.id, a.source_id, 'https://' || CASE a.id % 3 WHEN 0 THEN 'www.' || s.host WHEN 1 THEN s.host ELSE 'other.org' END
        || CASE a.id % 8 WHEN 0 THEN '' WHEN 1 THEN '/news' WHEN 2 THEN '/2024/01/some-story' WHEN 3 THEN '/a/photo.JPG' WHEN 4 THEN '/tag'
            WHEN 5 THEN '/b/story' WHEN 6 THEN '/x/y/long-slug-' || CAST(a.id AS STRING) ELSE '/plain' END AS url, s.source_url,
        CASE a.id % 5 WHEN 0 THEN 'Tiny' ELSE a.title END AS title, a.summary, CASE WHEN a.id % 4 > 1 THEN a.published_at END AS published_at
    FROM v_articles a JOIN v_sources s ON s.id = a.source_id"""


@query(
    "score_article_candidates",
    f"""WITH i AS (SELECT *, {host('url')} AS h, {host('source_url')} AS o, {path('url')} AS pth FROM ({SCORED_ITEMS}) x),
        j AS (SELECT *, len(list_filter(string_split(pth, '/'), lambda p: p <> '')) AS depth FROM i), k AS (SELECT *, {SCORE} AS score FROM j)
        SELECT id, score FROM (SELECT *, max(score) OVER (PARTITION BY source_id) AS best FROM k) z WHERE score >= 2 OR best < 2""",
)
def score_article_candidates(v):
    items = v.spark.sql(
        SCORED_ITEMS.replace("v_articles", "{a_}").replace("v_sources", "{s_}"), a_=v.articles, s_=v.sources
    )
    return listings.score_article_candidates(items, "source_id").select("id", "score")


_HOST = f"coalesce({host('url')}, '')"
_BARE = f"regexp_replace({_HOST}, '^www\\.', '')"
_LABEL = f"replace(replace(split_part({_BARE}, '.', 1), '-', ' '), '_', ' ')"


def _unsuffixed(t: str) -> str:
    """A trailing site name set off by a dash, bar or colon is dropped: the host, its plain and spoken forms, known sites, in this order."""
    for label in (_HOST, _BARE, _LABEL, *[quoted([x]) for x in S.TITLE_SUFFIX_LABELS]):
        cut = "regexp_extract(left(p.t, length(p.t) - length(p.l)), '(?s)^(.*?)\\s*[-|:\\x{2013}\\x{2014}]\\s*$', 1)"
        t = let(f"{{'t': {t}, 'l': {label}}}", "p", f"CASE WHEN p.l <> '' AND ends_with(lower(p.t), lower(p.l)) THEN coalesce(nullif({cut}, ''), p.t) ELSE p.t END")
    return f"trim({t})"


# the title's text is decoded as HTML, cleaned like any text, and loses the site's name; short and generic titles are none
_GENERIC = " OR ".join([f"lower(t) IN ({_HOST}, {_LABEL}, {quoted(S.GENERIC_TITLES)})", *[f"contains(lower(t), {quoted([w + ' |'])})" for w in S.GENERIC_TITLES]])
def _page_titles(more: str = "") -> str:
    """CTEs up to ``titled``, which keeps the columns ``more`` of the pages."""
    return f"""c AS (SELECT page_id, url{more}, {clean(referenced("regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"))} AS c FROM v_pages),
        t AS (SELECT page_id, url{more}, {_unsuffixed('c')} AS t FROM c),
        titled AS (SELECT page_id{more}, CASE WHEN length(t) >= {S.PAGE_TITLE_MIN} AND NOT ({_GENERIC}) THEN {limit('t', 240)} END AS title FROM t)"""


_PAGE_TITLES = _page_titles()


@query("page_titles", f"WITH {_PAGE_TITLES} SELECT page_id, title FROM titled")
def page_titles(v):
    return P.page_titles(shredded(v))


@query(
    "page_descriptions",
    "SELECT doc_id AS page_id, 'A description of the listing number ' || doc_id AS description FROM v_docs",
)
def page_descriptions(v):
    return P.page_descriptions(listing(v))


@query(
    "page_images",
    """SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN 'https://cdn.example.org/lead/' || doc_id || '.png' ELSE 'https://list.example.org/img/0.jpg' END AS image_url,
        CASE WHEN doc_id % 3 = 0 THEN 100 ELSE 74 END AS score FROM v_docs""",
)
def page_images(v):
    return P.page_images(listing(v))


_BODY = "regexp_replace(" + referenced("{x}") + ", '<[^>]*>', '', 'g')"
# the sample pages announce no description: the first long paragraph is taken. All their paragraphs lie in the article; one ends at its end tag, the next paragraph or the article's end
_PARAGRAPHS = f"""list_transform(string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')[2:],
            lambda p: {_BODY.format(x="split_part(p, '</p>', 1)")})"""
_LONG = f"""list_filter({_PARAGRAPHS},
            lambda t: length(regexp_replace(regexp_replace(t, '[ \\t\\n\\r\\x0B\\x0C]+', ' ', 'g'), '^ | $', '', 'g')) > {S.PAGE_PARAGRAPH_MIN})[1]"""
_DESCRIPTION = let(
    clean(_LONG), "d",
    f"CASE WHEN length(d) >= {S.PAGE_DESCRIPTION_MIN} AND NOT {any_of('lower(d)', S.GENERIC_DESCRIPTIONS)} THEN {limit('d', S.SUMMARY_LIMIT)} END",
)


@query(
    "page_metadata",
    f"""WITH {_page_titles(', html')} SELECT 'page' AS kind, page_id, title, NULL AS image_url, {_DESCRIPTION} AS description FROM titled
        UNION ALL SELECT 'listing', doc_id, NULL, CASE WHEN doc_id % 3 = 0 THEN 'https://cdn.example.org/lead/' || doc_id || '.png' ELSE 'https://list.example.org/img/0.jpg' END,
            'A description of the listing number ' || doc_id FROM v_docs""",
)
def page_metadata(v):
    """Titles, images and descriptions of the crawled pages and of the listing pages."""
    kinds = {"page": shredded(v), "listing": listing(v)}
    own, listed = (P.page_metadata(p).select(F.lit(kind).alias("kind"), "page_id", "title", "image_url", "description") for kind, p in kinds.items())
    return own.unionByName(listed)


@query(
    "article_bodies",
    f"""WITH a AS (SELECT page_id, {_BODY.format(x="regexp_extract(html, '(?s)<article>(.*)</article>', 1)")} AS article,
            {_BODY.format(x="regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS ad FROM v_pages)
        SELECT page_id, CASE WHEN strlen(trim(article)) > 200 THEN 12 ELSE 15 END AS selector_rank,
            CASE WHEN strlen(trim(article)) > 200 THEN trim(article) ELSE trim(ad || article) END AS body_text FROM a""",
)
def article_bodies(v):
    return P.article_bodies(shredded(v)).drop("body_html")


@query(
    "clean_body_html",
    """SELECT page_id, trim(regexp_replace(regexp_replace(html, '\\s+(style|class)="[^"]*"', '', 'gi'), '\\n{3,}', chr(10) || chr(10), 'g')) AS html FROM v_pages""",
)
def clean_body_html(v):
    return spread(v.pages).select("page_id", P.clean_body_html(F.col("html")).alias("html"))


@query(
    "absolutize_body_urls",
    "SELECT page_id, regexp_replace(html, 'href=\"/', 'href=\"' || regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/', 'g') AS html FROM v_pages",
)
def absolutize_body_urls(v):
    return spread(v.pages).select("page_id", P.absolutize_body_urls(F.col("html"), F.col("url")).alias("html"))


@query(
    "raw_html_title_image",
    f"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')), ''),
        nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), {host('url')}) AS title,
        nullif(regexp_extract(html, '(?i)<img[^>]+src="([^"]+)"', 1), '') AS image_url FROM v_pages""",
)
def raw_html_title_image(v):
    return P.raw_html_title_image(spread(v.pages))


def markdown(v):
    """Documents as fetched Markdown: site title, byline, article, footer."""
    lead = F.concat(F.lit("# Site "), F.col("doc_id").cast("string"), F.lit("\nBy someone\n5 min read\n## Story\n"))
    tail = F.lit("\n![x](https://e.org/icon.png) ![y](https://e.org/fill/w_90/a.png) ![z](https://e.org/lead.png)\nShare\n## Comments\nbye")
    return spread(v.docs).select("doc_id", F.concat(lead, F.col("text"), tail).alias("markdown"))


@query(
    "clean_markdown_lines",
    """SELECT doc_id, '## Story' || chr(10) || text || chr(10) || '![x](https://e.org/icon.png) ![y](https://e.org/fill/w_90/a.png) ![z](https://e.org/lead.png)'
        AS markdown FROM v_docs""",
)
def clean_markdown_lines(v):
    return markdown(v).select("doc_id", documents.clean_markdown("markdown").alias("markdown"))


@query("markdown_title_image", "SELECT doc_id, 'Site ' || doc_id AS title, 'https://e.org/lead.png' AS image_url FROM v_docs")
def markdown_title_image(v):
    return markdown(v).select(
        "doc_id", documents.markdown_title("markdown", F.lit("https://e.org/")).alias("title"), documents.markdown_image("markdown").alias("image_url")
    )


@query(
    "verify_language",
    """WITH p AS (SELECT doc_id, doc_id % 2 AS fold, lang, text, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ' AS s FROM v_docs),
        g AS (SELECT doc_id, fold, lang, length(text) AS chars, length(s) - 2 AS total, s[i:i+2] AS trigram FROM p, unnest(range(1, length(s) - 1)) AS u(i)),
        c AS (SELECT fold, lang, trigram, count(*) AS n FROM g GROUP BY ALL),
        pr AS (SELECT fold, lang, trigram, (301 - rn) / 300 AS weight FROM (SELECT *, row_number() OVER (PARTITION BY fold, lang ORDER BY n DESC, trigram) AS rn FROM c) x
            WHERE rn <= 300),
        s AS (SELECT g.doc_id, pr.lang, round(sum(weight) / max(total), 6) AS score FROM g JOIN pr ON pr.trigram = g.trigram AND pr.fold <> g.fold WHERE chars >= 60 GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC) AS rn, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, lang DESC)
            AS second FROM s)
        SELECT d.doc_id, d.lang AS target, r.lang AS top_lang, r.score AS top_score, CASE WHEN r.score < 0.04 THEN NULL WHEN r.lang = d.lang THEN true
            WHEN r.score - coalesce(second, 0) < 0.03 THEN NULL WHEN r.score IS NOT NULL THEN false END AS verdict
        FROM v_docs d LEFT JOIN r ON r.doc_id = d.doc_id AND r.rn = 1""",
)
def verify_language(v):
    """Each half of the documents is judged by profiles of the other half."""
    docs = spread(v.docs)
    halves = [docs.where(F.col("doc_id") % 2 == i) for i in (0, 1)]
    judged = [documents.verify_language(halves[i], documents.language_profiles(halves[1 - i]), F.col("lang")) for i in (0, 1)]
    return judged[0].union(judged[1])
