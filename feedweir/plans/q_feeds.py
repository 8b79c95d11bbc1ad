"""Queries over feed payloads: each payload is rendered from a document and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.urls import canonical_url, url_hash
from feedweir.operators import feeds
from feedweir.operators.partitioning import spread
from feedweir.plans.oracle_parts import any_of, clean, limit
from feedweir.plans.payloads import payloads
from feedweir.plans.registry import query

RAW = f"""raw AS (SELECT doc_id AS payload_id, doc_id % 4 AS kind, g - 1 AS i, string_split(text, chr(10))[g] AS line
        FROM v_docs, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(g)),
    cleaned AS (SELECT *, {clean('line')} AS c, regexp_replace(line, '^[ \\t\\n\\r\\x00\\x0B]+|[ \\t\\n\\r\\x00\\x0B]+$', '', 'g') AS t FROM raw),
    named AS (SELECT *, CASE WHEN kind <> 2 THEN c WHEN t <> '' THEN t ELSE '' END AS title FROM cleaned),
    kept AS (SELECT payload_id, kind, i, 'https://feed.example.org/d/' || payload_id || '/' || (i % 7) AS url, title, 'g-' || payload_id || '-' || i AS external_id,
            CASE WHEN kind = 2 AND t = '' THEN NULL WHEN kind = 2 THEN {limit('c', 420)} ELSE nullif({limit('c', 420)}, '') END AS summary,
            CASE i % 3 WHEN 0 THEN 'https://cdn.example.org/i/' || i || '.png' WHEN 1 THEN 'https://feed.example.org/img/' || i || '.png' END AS image_url,
            TIMESTAMP '2024-01-01 00:00:00' + i * INTERVAL '1' MINUTE AS published_at FROM named WHERE title <> '' AND kind < 3),
    dedup AS (SELECT payload_id, kind, min(i) AS first_i, arg_max({{'u': url, 't': title, 'e': external_id, 's': coalesce(summary, chr(1)), 'm': coalesce(image_url, ''),
            'p': published_at}}, i) AS v FROM kept GROUP BY payload_id, kind, url),
    items AS (SELECT payload_id, kind, CAST(row_number() OVER (PARTITION BY payload_id ORDER BY first_i) - 1 AS INT) AS pos, v.u AS url, v.t AS title,
        v.e AS external_id, nullif(v.s, chr(1)) AS summary, nullif(v.m, '') AS image_url, v.p AS published_at FROM dedup)"""
COLS = "payload_id, pos, url, title, external_id, summary, image_url, published_at"


def corpus(v):
    return payloads(spread(v.docs))


@query(
    "feed_payload_scan",
    """SELECT doc_id AS payload_id, doc_id % 20 AS source_id, 'https://feed.example.org/p/' || doc_id AS final_url,
        CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE ['rss', 'atom', 'json_feed', 'html'][doc_id % 4 + 1] END AS source_type FROM v_docs""",
)
def feed_payload_scan(v):
    hashed = corpus(v).withColumn("content_hash", F.sha2("body", 256))
    return hashed.where("content_hash IS NOT NULL").select("payload_id", "source_id", "final_url", "source_type")


@query(
    "sniff_payload_type",
    """SELECT doc_id AS payload_id, ['rss', 'atom', 'json_feed', 'html'][doc_id % 4 + 1] AS type,
        [0.99::DOUBLE, 0.99, 0.98, 0.45][doc_id % 4 + 1]::DOUBLE AS confidence FROM v_docs""",
)
def sniff_payload_type(v):
    return feeds.sniff_payloads(corpus(v))


@query("parse_rss_items", f"WITH {RAW} SELECT {COLS} FROM items WHERE kind = 0")
def parse_rss_items(v):
    return feeds.parse_items(corpus(v), "rss")


@query("parse_atom_entries", f"WITH {RAW} SELECT {COLS} FROM items WHERE kind = 1")
def parse_atom_entries(v):
    return feeds.parse_items(corpus(v), "atom")


@query("parse_json_feed_items", f"WITH {RAW} SELECT {COLS} FROM items WHERE kind = 2")
def parse_json_feed_items(v):
    return feeds.parse_items(corpus(v), "json_feed")


STORIES = f"""shown AS (SELECT payload_id, i, c AS title, {limit('c', 420)} AS s, CASE WHEN i % 7 = 6 THEN 'https://feed.example.org/tag'
            ELSE 'https://feed.example.org/d/' || payload_id || '/' || (i % 7) END AS url FROM cleaned
        WHERE kind = 3 AND payload_id % 3 <> 1 AND length(c) BETWEEN 12 AND 220 AND NOT {any_of('lower(c)', S.FEED_TITLE_BLOCKED)}),
    stories AS (SELECT payload_id, url, min(i) AS first_i, arg_max(title, i) AS title, max(i) AS i, arg_max(coalesce(CASE WHEN length(s) >= 24
            AND NOT {any_of('lower(s)', S.FEED_SUMMARY_BLOCKED)} THEN s END, chr(1)), i) AS s FROM shown GROUP BY ALL),
    listed AS (SELECT *, count(*) FILTER (WHERE NOT ends_with(url, '/tag')) OVER (PARTITION BY payload_id) AS better FROM stories),
    ruled AS (SELECT payload_id, CAST(row_number() OVER (PARTITION BY payload_id ORDER BY first_i) - 1 AS INT) AS pos, url, title, NULL::VARCHAR AS external_id,
        NULL::VARCHAR AS summary, NULL::VARCHAR AS image_url, CASE WHEN i % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + i * INTERVAL '1' MINUTE END AS published_at,
        'html_schema' AS parsed_as, 4::INT AS attempt, nullif(s, chr(1)) AS listing_summary,
        CASE WHEN i % 3 = 1 THEN 'https://feed.example.org/img/' || i || '.png' END AS listing_image_url, payload_id AS schema_id, CAST(payload_id % 5 + 1 AS INT) AS schema_version
        FROM listed WHERE better = 0 OR NOT ends_with(url, '/tag'))"""


@query(
    "parse_with_fallback_order",
    f"""WITH {RAW}, {STORIES} SELECT {COLS}, ['rss', 'atom', 'json_feed'][kind + 1] AS parsed_as,
            CASE WHEN payload_id % 5 = 0 THEN kind + 1 ELSE 1 END::INT AS attempt, NULL::VARCHAR AS listing_summary, NULL::VARCHAR AS listing_image_url,
            NULL::BIGINT AS schema_id, NULL::INT AS schema_version FROM items
        UNION ALL SELECT {COLS}, parsed_as, attempt, listing_summary, listing_image_url, schema_id, schema_version FROM ruled""",
)
def parse_with_fallback_order(v):
    """Two of three sources have an active rule; it counts only where their payload is no feed."""
    doc = F.col("doc_id")
    rules = v.docs.where(doc % 3 != 1).select(
        url_hash(canonical_url(F.concat(F.lit("https://feed.example.org/p/"), doc.cast("string")))).alias("url_hash"), doc.alias("schema_id"),
        (doc % 5 + 1).cast("int").alias("version"), F.lit("main").alias("within"), F.array(F.lit("article")).alias("item_tags"),
        F.lit("story").alias("item_class"), F.lit(True).alias("needs_heading"), F.array(F.lit("h2")).alias("title_tags"),
    )
    return feeds.parse_with_fallback_order(corpus(v), rules)


@query("feed_item_images", f"WITH {RAW} SELECT payload_id, pos, image_url FROM items")
def feed_item_images(v):
    return feeds.item_rows(feeds.parsed(corpus(v), cap=False, fields=("url", "title", "image_url"))).select("payload_id", "pos", "image_url")


def raw_items(v):
    return feeds.item_rows(feeds.parsed(corpus(v), cap=False, dedupe=False))


@query(
    "dedupe_items_in_payload",
    f"""WITH {RAW}, n AS (SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY i) - 1 AS p FROM kept)
        SELECT payload_id, CAST(min(p) AS INT) AS pos, url, arg_max(title, p) AS title, arg_max(external_id, p) AS external_id FROM n GROUP BY payload_id, url""",
)
def dedupe_items_in_payload(v):
    return feeds.dedupe_item_rows(raw_items(v)).select("payload_id", "pos", "url", "title", "external_id")


@query(
    "cap_items_per_payload",
    f"""WITH {RAW}, n AS (SELECT *, CAST(row_number() OVER (PARTITION BY payload_id ORDER BY i) - 1 AS INT) AS pos FROM kept)
        SELECT payload_id, pos, external_id FROM n WHERE pos < 100""",
)
def cap_items_per_payload(v):
    return feeds.cap_item_rows(raw_items(v)).select("payload_id", "pos", "external_id")


CAND = """SELECT doc_id AS payload_id, r AS rank, 'https://feed.example.org/p/' || CAST(doc_id - r AS STRING) AS url,
    CASE WHEN r = 1 AND doc_id % 3 = 0 THEN 'html' ELSE 'rss' END AS type FROM {docs} d CROSS JOIN (VALUES (0), (1), (2)) AS k(r)"""


@query(
    "fallback_candidate_items",
    f"""WITH {RAW}, cand AS ({CAND.replace('{docs}', 'v_docs')}), n AS (SELECT payload_id, count(*) AS n FROM items GROUP BY 1),
        c AS (SELECT cand.payload_id, cand.rank, CAST(split_part(url, '/p/', 2) AS BIGINT) AS other, url FROM cand WHERE type = 'rss'
            AND NOT EXISTS (SELECT 1 FROM n WHERE n.payload_id = cand.payload_id)),
        f AS (SELECT c.payload_id, arg_min(other, rank) AS other FROM c JOIN n ON n.payload_id = c.other GROUP BY 1)
        SELECT f.payload_id, 'https://feed.example.org/p/' || f.other AS candidate_url, pos, i.url, title FROM f JOIN items i ON i.payload_id = f.other""",
)
def fallback_candidate_items(v):
    doc = F.col("doc_id")
    candidates = v.docs.select(doc.alias("payload_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("rank")).select(
        "payload_id",
        "rank",
        F.concat(F.lit("https://feed.example.org/p/"), (F.col("payload_id") - F.col("rank")).cast("string")).alias("url"),
        F.when((F.col("rank") == 1) & (F.col("payload_id") % 3 == 0), "html").otherwise("rss").alias("type"),
    )
    return feeds.fallback_candidate_items(corpus(v), candidates, ("url", "title")).select("payload_id", "candidate_url", "pos", "url", "title")


@query(
    "parse_outcomes",
    f"""WITH {RAW}, n AS (SELECT payload_id, count(*) AS n FROM items GROUP BY 1)
        SELECT doc_id AS payload_id, doc_id % 20 AS source_id, coalesce(n, 0) AS parsed_count, CASE WHEN n > 0 THEN 'parsed' ELSE 'active' END AS status,
            CASE WHEN n > 0 THEN NULL ELSE 'parse_empty' END AS error_type FROM v_docs LEFT JOIN n ON n.payload_id = doc_id""",
)
def parse_outcomes(v):
    return feeds.parse_outcomes(corpus(v))
