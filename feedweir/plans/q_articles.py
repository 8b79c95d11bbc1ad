"""Queries over articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweir.operators import articles as A
from feedweir.plans.oracle_parts import any_of, canon, clean, iso, limit
from feedweir.plans.q_text import IMAGE_SQL
from feedweir.plans.registry import query
from feedweir.plans.views import NOW, now_column

# parsed items: every document, its first line as title; a document id collision by text stands for re-published items
ITEMS = """SELECT doc_id AS pos, doc_id % 20 AS source_id,
        CASE WHEN doc_id % 50 = 3 THEN '' ELSE 'HTTPS://News.Example.org//a/' || CAST(length(text) % 400 AS STRING) || '/?utm_source=x&id='
            || CAST(length(text) AS STRING) || '#c' END AS url,
        CASE WHEN doc_id % 40 = 7 THEN '' ELSE ' <b>Item</b> &amp; ' || CAST(length(text) AS STRING) END AS title,
        CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END AS summary,
        CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'cdn.example.org/i/' || CAST(doc_id % 9 AS STRING) || '.png' END AS image_url,
        TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS published_at,
        CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'g' || CAST(length(text) AS STRING) END AS external_id
    FROM {documents}"""
ITEMS_DB = ITEMS.replace("{documents}", "documents")


def items(v):
    return v.sql(ITEMS.replace("{documents}", f"parquet.`{v.dir}/documents.parquet`"))


def _title(x):
    return limit(f"coalesce(nullif({clean(x)}, ''), 'Untitled article')", 240)


NORMAL = f"""items AS ({ITEMS_DB}), n0 AS (
    SELECT pos, source_id, external_id, {canon('url')} AS canonical_url, {_title('title')} AS title,
        {limit(f"nullif({clean('summary')}, '')", 420)} AS summary,
        CASE WHEN image_url IS NOT NULL THEN {canon('image_url')} END AS image_url, published_at
    FROM items WHERE url <> '' AND title <> ''),
  normalized AS (SELECT *, sha256(lower(canonical_url)) AS canonical_url_hash,
    sha256(lower(canonical_url || '|' || title || '|' || coalesce(summary, '') || '|' || coalesce(image_url, '') || '|'
        || {iso('published_at')} || '|' || coalesce(external_id, ''))) AS content_hash FROM n0)"""


@query("normalize_articles", f"WITH {NORMAL} SELECT * FROM normalized")
def normalize_articles(v):
    return A.normalize_articles(items(v))


@query(
    "normalize_batch_stats",
    f"""WITH items AS ({ITEMS_DB}) SELECT source_id, count(*) AS input_count, count(*) FILTER (url <> '' AND title <> '') AS normalized_count,
        count(*) FILTER (url = '' OR title = '') AS invalid_rows FROM items GROUP BY 1""",
)
def normalize_batch_stats(v):
    return A.normalize_batch_stats(items(v))


# the items without a guid were stored by an earlier run
STORED = "SELECT canonical_url_hash, content_hash FROM normalized WHERE external_id IS NULL"
DETECT = f"""{NORMAL}, stored AS ({STORED}),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url_hash ORDER BY pos) AS rn FROM normalized) x
        WHERE rn = 1 AND canonical_url_hash NOT IN (SELECT canonical_url_hash FROM stored)),
    new_rows AS (SELECT * FROM (SELECT * EXCLUDE rn, row_number() OVER (PARTITION BY content_hash ORDER BY pos) AS rn FROM u) x
        WHERE rn = 1 AND content_hash NOT IN (SELECT content_hash FROM stored))"""


def detected(v):
    normalized = A.normalize_articles(items(v))
    stored = normalized.where("external_id IS NULL").select("canonical_url_hash", "content_hash")
    return normalized, A.detect_new_articles(normalized, stored, "pos")


@query("detect_new_articles", f"WITH {DETECT} SELECT * EXCLUDE rn FROM new_rows")
def detect_new_articles(v):
    return detected(v)[1]


@query(
    "detect_stats",
    f"""WITH {DETECT}, c AS (SELECT source_id, count(*) AS input_count FROM normalized GROUP BY 1),
        n AS (SELECT source_id, count(*) AS new_articles FROM new_rows GROUP BY 1)
        SELECT c.source_id, input_count, coalesce(new_articles, 0) AS new_articles, input_count - coalesce(new_articles, 0) AS duplicates_skipped,
            0::BIGINT AS invalid_rows, CASE WHEN coalesce(new_articles, 0) = 0 THEN CASE WHEN input_count - coalesce(new_articles, 0) > 0
                THEN 'All normalized rows are duplicates; no new articles.' ELSE 'No valid new articles detected from normalized rows.' END END AS reason
        FROM c LEFT JOIN n ON n.source_id = c.source_id""",
)
def detect_stats(v):
    normalized, new = detected(v)
    return A.detect_stats(normalized, new)


# page metadata as the enrichment operators receive it
META = """SELECT canonical_url_hash, CASE WHEN id % 7 <> 2 THEN 'Page title of ' || CAST(id AS STRING) END AS title,
        CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'https://cdn.example.org/profile/' || CAST(id AS STRING) || '.png'
            ELSE 'https://cdn.example.org/page/' || CAST(id AS STRING) || '.png' END AS image_url,
        CASE WHEN id % 5 = 0 THEN NULL ELSE 'Description of the page number ' || CAST(id AS STRING) END AS description
    FROM v_articles"""


def metadata(v):
    n = F.col("id").cast("string")
    return v.articles.select(
        "canonical_url_hash",
        F.when(F.col("id") % 7 != 2, F.concat(F.lit("Page title of "), n)).alias("title"),
        F.when(F.col("id") % 4 == 0, None)
        .when(F.col("id") % 4 == 1, F.concat(F.lit("https://cdn.example.org/profile/"), n, F.lit(".png")))
        .otherwise(F.concat(F.lit("https://cdn.example.org/page/"), n, F.lit(".png")))
        .alias("image_url"),
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("Description of the page number "), n)).alias("description"),
    )


def _ok(x):
    return f"coalesce({IMAGE_SQL.replace('url', x)}, false)"


@query(
    "enrich_articles",
    f"""WITH m AS ({META}), j AS (SELECT a.*, m.title AS mt, m.image_url AS mi, m.description AS md,
            coalesce(a.image_url, '') <> '' AS has_image, coalesce(a.summary, '') = '' AS needs_summary,
            coalesce(a.image_url, '') = '' OR NOT {_ok('a.image_url')} AS needs_image,
            CASE WHEN {_ok('m.image_url')} THEN m.image_url END AS offered
        FROM v_articles a LEFT JOIN m ON m.canonical_url_hash = a.canonical_url_hash)
        SELECT canonical_url_hash, id, source_id, external_id, canonical_url, source_type, published_at, created_at, discovered_at, content_hash,
            CASE WHEN needs_image AND offered IS NOT NULL THEN offered WHEN needs_image AND has_image THEN NULL ELSE image_url END AS image_url,
            CASE WHEN needs_summary AND md IS NOT NULL THEN md ELSE summary END AS summary,
            CASE WHEN source_type = 'html_schema' AND mt IS NOT NULL THEN mt ELSE title END AS title,
            (needs_image AND (offered IS NOT NULL OR has_image)) OR (needs_summary AND md IS NOT NULL)
                OR (source_type = 'html_schema' AND mt IS NOT NULL) AS enriched FROM j""",
)
def enrich_articles(v):
    return A.enrich_articles(v.articles, metadata(v))


@query(
    "articles_needing_enrichment",
    "SELECT id, source_id FROM v_articles WHERE coalesce(summary, '') = '' OR coalesce(image_url, '') = ''",
)
def articles_needing_enrichment(v):
    return A.articles_needing_enrichment(v.articles).select("id", "source_id")


@query(
    "enrichment_batches",
    """SELECT source_id, CAST(floor((rn - 1) / 20) AS BIGINT) AS batch_no, list(id ORDER BY id) AS article_ids FROM (
        SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY id) AS rn FROM v_articles
        WHERE coalesce(summary, '') = '' OR coalesce(image_url, '') = '') x GROUP BY 1, 2""",
)
def enrichment_batches(v):
    return A.enrichment_batches(A.articles_needing_enrichment(v.articles))


@query(
    "backfill_images",
    f"""WITH m AS ({META}), asked AS (SELECT * FROM (SELECT id, canonical_url_hash, row_number() OVER (PARTITION BY source_id
            ORDER BY published_at DESC NULLS LAST, id DESC) AS rn FROM v_articles WHERE coalesce(image_url, '') = '') x WHERE rn <= 12)
        SELECT a.id, coalesce(f.image_url, a.image_url) AS image_url FROM v_articles a LEFT JOIN
            (SELECT asked.id, m.image_url FROM asked JOIN m ON m.canonical_url_hash = asked.canonical_url_hash) f ON f.id = a.id""",
)
def backfill_images(v):
    return A.backfill_images(v.articles, metadata(v)).select("id", "image_url")


@query(
    "preview_items",
    f"""SELECT source_id, CAST(rn AS INT) AS pos, title, canonical_url AS url, {clean('summary')} AS summary, image_url, published_at FROM (
        SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC NULLS LAST, id DESC) AS rn FROM v_articles) x WHERE rn <= 12""",
)
def preview_items(v):
    return A.preview_items(v.articles)


FRESH = f"""SELECT id AS source_id FROM v_sources s WHERE coalesce(last_success_at, last_parsed_at) >= {NOW} - INTERVAL '60' MINUTE
    AND EXISTS (SELECT 1 FROM v_articles a WHERE a.source_id = s.id)"""


@query("fresh_sources", FRESH)
def fresh_sources(v):
    return A.fresh_sources(v.sources, v.articles, now_column())


@query(
    "serve_preview",
    f"""WITH fresh AS ({FRESH}), cached AS (SELECT source_id, least(count(*), 12) AS n_cached FROM v_articles GROUP BY 1),
        live AS (SELECT doc_id % 20 AS source_id, count(*) AS n_live FROM v_docs GROUP BY 1),
        j AS (SELECT r.id AS request_id, r.source_id, n_live, n_cached, CASE WHEN n_cached > 0 AND f.source_id IS NOT NULL THEN 'fresh'
            WHEN n_live > 0 THEN 'live' WHEN n_cached > 0 THEN 'stale_fallback' ELSE 'failed' END AS cache_mode
            FROM v_generations r LEFT JOIN cached c ON c.source_id = r.source_id LEFT JOIN fresh f ON f.source_id = r.source_id
            LEFT JOIN live l ON l.source_id = r.source_id)
        SELECT request_id, source_id, cache_mode, CASE WHEN cache_mode = 'failed' THEN 'failed' ELSE 'ready' END AS status,
            CASE cache_mode WHEN 'live' THEN least(n_live, 12) WHEN 'failed' THEN 0 ELSE n_cached END AS items FROM j""",
)
def serve_preview(v):
    requests = v.generations.select(F.col("id").alias("request_id"), "source_id")
    cached = A.preview_items(v.articles)
    live = v.docs.select((F.col("doc_id") % 20).alias("source_id"))
    fresh = A.fresh_sources(v.sources, v.articles, now_column())
    return A.serve_preview(requests, cached, fresh, live)


@query(
    "sanitize_preview",
    f"""WITH i AS (SELECT id AS generation_id, CAST(g - 1 AS INT) AS pos, json_extract(preview_items, '$[' || (g - 1) || ']') AS j
            FROM v_generations, unnest(range(1, json_array_length(preview_items)::BIGINT + 1)) AS u(g)),
        e AS (SELECT generation_id, pos, j ->> 'title' AS title, j ->> 'url' AS url, j ->> 'summary' AS summary,
            coalesce(j ->> 'image_url', j ->> 'image') AS image, j ->> 'published_at' AS p FROM i)
        SELECT generation_id, pos, coalesce(nullif({clean('title')}, ''), 'Untitled') AS title,
            CASE WHEN url = '' THEN '#' ELSE {canon('url')} END AS url, nullif({clean('summary')}, '') AS summary,
            nullif(trim(image), '') AS image_url, try_cast(replace(replace(p, 'T', ' '), 'Z', '') AS TIMESTAMP) AS published_at FROM e""",
)
def sanitize_preview(v):
    return A.sanitize_preview(v.generations)


@query(
    "enrichment_audit",
    f"""WITH m AS ({META}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, id DESC) AS rn
            FROM v_articles) x WHERE rn = 1)
        SELECT s.id AS source_id, s.source_url, s.source_type, s.status, l.id AS article_id, l.canonical_url AS article_url, l.title AS db_title,
            l.summary AS db_summary, l.image_url AS db_image, m.title AS fresh_title, m.description AS fresh_summary, m.image_url AS fresh_image,
            CASE WHEN trim(coalesce(l.canonical_url, '')) = '' THEN 'No article available for audit.' END AS error
        FROM v_sources s LEFT JOIN l ON l.source_id = s.id LEFT JOIN m ON m.canonical_url_hash = l.canonical_url_hash""",
)
def enrichment_audit(v):
    return A.enrichment_audit(v.sources, v.articles, metadata(v))


@query(
    "channel_preview_audit",
    f"""WITH m AS ({META}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS rn FROM v_articles) x
            WHERE rn <= 2),
        c AS (SELECT l.source_id, l.id AS article_id, l.title, nullif(l.image_url, '') AS db_image, trim(coalesce(l.image_url, '')) = '' AS ni,
            trim(coalesce(l.summary, '')) = '' AS ns, l.image_url, l.summary, m.image_url AS mi, m.description AS md,
            trim(coalesce(l.image_url, '')) <> '' AND {any_of("lower(l.image_url)", A.PORTRAIT_WORDS)} AS portrait
            FROM l LEFT JOIN m ON m.canonical_url_hash = l.canonical_url_hash),
        d AS (SELECT *, CASE WHEN ni OR ns THEN mi END AS pi, CASE WHEN ni OR ns THEN md END AS ps FROM c),
        e AS (SELECT *, CASE WHEN ni THEN pi WHEN portrait AND pi IS NOT NULL THEN pi ELSE image_url END AS final_image FROM d)
        SELECT s.id AS subscription_id, s.source_id, CASE WHEN translate_enabled THEN translate_language END AS translate, article_id, title, db_image,
            final_image, CASE WHEN ns THEN ps ELSE summary END AS final_summary, coalesce(portrait, false) AS looks_like_portrait,
            CASE WHEN pi IS NOT NULL AND NOT coalesce(final_image = image_url, false) THEN 'enriched' ELSE 'db' END AS image_source
        FROM v_subscriptions s JOIN e ON e.source_id = s.source_id WHERE s.channel = 'teams'""",
)
def channel_preview_audit(v):
    return A.channel_preview_audit(v.subscriptions, v.articles, metadata(v))
