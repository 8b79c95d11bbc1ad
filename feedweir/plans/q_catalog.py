"""Queries over sources, URLs, targets and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweir.functions import urls
from feedweir.operators import catalog, upserts
from feedweir.plans.oracle_parts import absolute, canon, host, jitter, path, valid
from feedweir.plans.registry import query
from feedweir.plans.views import NOW, now_column
from feedweir.sources import tables


def _profile_sql() -> str:
    """One row per column of every table, worked out per kind of column."""
    mass = {
        "whole": "sum({c})", "real": "sum(floor({c} * 1000))", "text": "sum(strlen({c}))", "time": "sum(epoch_us({c}) % 1000003)", "list": "sum(len({c}))",
    }
    rows = []
    for name, columns in tables.SAMPLE_TABLES.items():
        for column, kind in tables.columns_of(columns):
            total = mass[tables.kind_of(kind)].format(c=column)
            rows.append(f"SELECT '{name}' AS table_name, '{column}' AS column_name, count(*) AS n_rows, count(*) - count({column}) AS n_nulls, coalesce({total}, 0)::BIGINT AS mass FROM {name}")
    return " UNION ALL ".join(rows)


@query("scan_tables", _profile_sql())
def scan_tables(v):
    """Profile of every column of every table."""
    return tables.profiles(tables.scan_tables(v.spark, v.dir))


@query("canonicalize_urls", f"SELECT page_id, url, {canon('url')} AS canonical_url FROM v_pages")
def canonicalize_urls(v):
    return v.pages.select("page_id", "url", urls.canonical_url("url").alias("canonical_url"))


LINKS = "SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM v_pages"


@query("resolve_urls", f"SELECT href, base, {absolute('href', 'base')} AS absolute_url FROM ({LINKS}) l")
def resolve_urls(v):
    links = v.pages.select(
        F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"),
        F.col("url").alias("base"),
    )
    return links.select("href", "base", urls.absolute_url("href", "base").alias("absolute_url"))


@query(
    "valid_http_urls",
    f"SELECT id, u AS url FROM (SELECT id, {canon('url')} AS u FROM v_submitted) s WHERE {valid('u')}",
)
def valid_http_urls(v):
    return v.submitted.select("id", urls.canonical_url("url").alias("url")).where(urls.is_http_url("url"))


@query("url_hosts", f"SELECT coalesce({host('url')}, 'unknown') AS domain, count(*) AS n_urls FROM v_pages GROUP BY 1")
def url_hosts(v):
    return catalog.hosts(v.pages, "url")


@query(
    "url_identity",
    f"""SELECT sha256(lower({canon('url')})) AS canonical_url_hash, count(*) AS n_variants, min(page_id) AS first_id
        FROM v_pages GROUP BY 1""",
)
def url_identity(v):
    return catalog.url_identity(v.pages, "url", "page_id")


KEYS = """keys AS (SELECT hash, min(source_id) AS source_id FROM (
    SELECT source_url_hash AS hash, id AS source_id FROM v_sources
    UNION ALL SELECT canonical_url_hash, id FROM v_sources
    UNION ALL SELECT normalized_alias_hash, source_id FROM v_aliases) k WHERE hash IS NOT NULL GROUP BY hash)"""


@query(
    "resolve_sources",
    f"""WITH {KEYS}, s AS (SELECT id, url, {canon('url')} AS canonical_url FROM v_submitted)
        SELECT s.id, s.url, s.canonical_url, k.source_id FROM s
        LEFT JOIN keys k ON {valid('s.canonical_url')} AND k.hash = sha256(lower(s.canonical_url))""",
)
def resolve_sources(v):
    return catalog.resolve_sources(v.submitted, v.sources, v.aliases)


@query(
    "find_or_create_sources",
    f"""WITH s AS (SELECT id, polling_interval_minutes, {canon('url')} AS u FROM v_submitted),
        f AS (SELECT sha256(lower(u)) AS source_url_hash, arg_min(u, id) AS source_url,
            arg_min(polling_interval_minutes, id) AS p FROM s WHERE u <> '' GROUP BY 1)
        SELECT source_url_hash, source_url, {host('source_url')} AS host, {host('source_url')} AS domain,
            'unknown' AS source_type, 'pending' AS status, 'inactive' AS usage_state, 50 AS health_score,
            'unknown' AS health_state, CAST(greatest(5, p) AS BIGINT) AS polling_interval_minutes,
            {NOW} + {jitter('source_url_hash', 30, 120)} * INTERVAL '1' SECOND AS next_check_at
        FROM f WHERE NOT EXISTS (SELECT 1 FROM v_sources x
            WHERE x.source_url_hash = f.source_url_hash OR x.canonical_url_hash = f.source_url_hash)
          AND NOT EXISTS (SELECT 1 FROM v_aliases a WHERE a.normalized_alias_hash = f.source_url_hash)""",
)
def find_or_create_sources(v):
    return catalog.find_or_create_sources(v.submitted, v.sources, now_column(), v.aliases)


@query(
    "alias_registry",
    f"""WITH s AS (SELECT *, {canon('url')} AS u FROM v_submitted), h AS (SELECT *, sha256(lower(u)) AS alias_hash FROM s WHERE {valid('u')}),
        o AS (SELECT alias_hash, source_id, seen_at AS first_seen_at FROM
            (SELECT *, row_number() OVER (PARTITION BY alias_hash ORDER BY seen_at, id) AS rn FROM h) x WHERE rn = 1)
        SELECT o.alias_hash, o.source_id, o.first_seen_at, max(h.seen_at) AS last_seen_at,
            arg_max(trim(h.url), (h.seen_at, h.id)) AS alias_url
        FROM o JOIN h ON h.alias_hash = o.alias_hash AND h.source_id = o.source_id GROUP BY ALL""",
)
def alias_registry(v):
    return catalog.alias_registry(v.submitted)


@query(
    "fill_host_meta",
    f"""SELECT id, coalesce(nullif(host, ''), {host("coalesce(nullif(canonical_url, ''), source_url)")}) AS host,
        coalesce(nullif(domain, ''), {host("coalesce(nullif(canonical_url, ''), source_url)")}) AS domain FROM v_sources""",
)
def fill_host_meta(v):
    return catalog.fill_host_meta(v.sources)


def _in(h, d):
    return f"({h} = '{d}' OR ends_with({h}, '.{d}'))"


_H = host("target")
_TEAMS = f"""(starts_with(lower(target), 'https://') AND ({_in(_H, 'logic.azure.com')} OR {_in(_H, 'office.com')}
    OR ({_in(_H, 'api.powerplatform.com')} AND contains({path('target')}, '/powerautomate/automations/direct/workflows/')
        AND contains(target, 'sig='))))"""


@query(
    "audit_webhook_targets",
    f"""SELECT channel, CASE
            WHEN channel = 'slack' THEN CASE WHEN NOT starts_with(target, 'https://hooks.slack.com/') THEN '{catalog.TARGET_ERRORS["slack"]}' END
            WHEN channel = 'discord' THEN CASE WHEN NOT starts_with(target, 'https://discord.com/api/webhooks/') THEN '{catalog.TARGET_ERRORS["discord"]}' END
            WHEN channel = 'teams' THEN CASE WHEN NOT coalesce({_TEAMS}, false) THEN '{catalog.TARGET_ERRORS["teams"]}' END
            WHEN channel = 'email' THEN CASE WHEN NOT regexp_matches(target, '^[^@ ]+@[^@ ]+\\.[a-z]+$') THEN '{catalog.TARGET_ERRORS["email"]}' END
            ELSE '{catalog.TARGET_ERRORS["other"]}' END AS error, count(*) AS n
        FROM v_subscriptions GROUP BY 1, 2""",
)
def audit_webhook_targets(v):
    return catalog.audit_targets(v.subscriptions)


# --- merges ------------------------------------------------------------------------------------------
ARTICLE_COLS = "id, source_id, external_id, canonical_url_hash, canonical_url, content_hash, title, summary, image_url, published_at, discovered_at"
INCOMING = f"""SELECT id + 1000000000 AS id, source_id + 1 AS source_id, external_id,
        CASE WHEN id % 3 = 0 THEN canonical_url_hash ELSE sha256(canonical_url_hash) END AS canonical_url_hash,
        canonical_url, sha256(content_hash) AS content_hash, title || ' (updated)' AS title, summary,
        image_url, published_at, {NOW} AS discovered_at FROM v_articles"""


@query(
    "upsert_articles",
    f"""WITH incoming AS ({INCOMING})
        SELECT coalesce(a.id, i.id) AS id, coalesce(i.source_id, a.source_id) AS source_id,
            coalesce(a.external_id, i.external_id) AS external_id, coalesce(a.canonical_url_hash, i.canonical_url_hash) AS canonical_url_hash,
            coalesce(a.canonical_url, i.canonical_url) AS canonical_url, coalesce(i.content_hash, a.content_hash) AS content_hash,
            coalesce(i.title, a.title) AS title, CASE WHEN i.id IS NULL THEN a.summary ELSE i.summary END AS summary,
            CASE WHEN i.id IS NULL THEN a.image_url ELSE i.image_url END AS image_url,
            CASE WHEN i.id IS NULL THEN a.published_at ELSE i.published_at END AS published_at,
            CASE WHEN a.id IS NULL THEN i.discovered_at ELSE a.discovered_at END AS discovered_at, a.id IS NULL AS is_new
        FROM v_articles a FULL JOIN incoming i ON a.canonical_url_hash = i.canonical_url_hash""",
)
def upsert_articles(v):
    stored = v.articles.select(*ARTICLE_COLS.split(", "))
    incoming = stored.select(
        (F.col("id") + 1000000000).alias("id"),
        (F.col("source_id") + 1).alias("source_id"),
        "external_id",
        F.when(F.col("id") % 3 == 0, F.col("canonical_url_hash"))
        .otherwise(F.sha2("canonical_url_hash", 256))
        .alias("canonical_url_hash"),
        "canonical_url",
        F.sha2("content_hash", 256).alias("content_hash"),
        F.concat("title", F.lit(" (updated)")).alias("title"),
        "summary",
        "image_url",
        "published_at",
        now_column().alias("discovered_at"),
    )
    return upserts.upsert_articles(stored, incoming)


@query(
    "insert_if_absent_deliveries",
    """SELECT w.article_id, w.subscription_id, w.channel FROM (
        SELECT a.id AS article_id, s.id AS subscription_id, s.channel FROM (SELECT max(id) AS id, source_id FROM v_articles GROUP BY 2) a
        JOIN v_subscriptions s ON s.source_id = a.source_id) w
        WHERE NOT EXISTS (SELECT 1 FROM v_deliveries d WHERE d.article_id = w.article_id
            AND d.subscription_id = w.subscription_id AND d.channel = w.channel)""",
)
def insert_if_absent_deliveries(v):
    newest = v.articles.groupBy("source_id").agg(F.max("id").alias("article_id"))
    wanted = newest.join(v.subscriptions.select("source_id", F.col("id").alias("subscription_id"), "channel"), "source_id")
    return upserts.insert_if_absent(
        v.deliveries, wanted.select("article_id", "subscription_id", "channel"), ["article_id", "subscription_id", "channel"]
    )


@query(
    "upsert_webhooks",
    """WITH stored AS (SELECT user_id, channel, url_hash, min(id) AS id, arg_min(label, id) AS label FROM v_webhooks GROUP BY ALL),
        incoming AS (SELECT user_id + id % 2 AS user_id, channel, url_hash, max(id) AS id, arg_max('new ' || label, id) AS label
            FROM v_webhooks GROUP BY ALL)
        SELECT coalesce(s.user_id, i.user_id) AS user_id, coalesce(s.channel, i.channel) AS channel,
            coalesce(s.url_hash, i.url_hash) AS url_hash, coalesce(s.id, i.id) AS id, coalesce(i.label, s.label) AS label, s.id IS NULL AS is_new
        FROM stored s FULL JOIN incoming i ON s.user_id = i.user_id AND s.channel = i.channel AND s.url_hash = i.url_hash""",
)
def upsert_webhooks(v):
    keys = ["user_id", "channel", "url_hash"]
    hooks = v.webhooks
    stored = hooks.groupBy(*keys).agg(F.min("id").alias("id"), F.min_by("label", "id").alias("label"))
    incoming = hooks.select(
        (F.col("user_id") + F.col("id") % 2).alias("user_id"), "channel", "url_hash", "id",
        F.concat(F.lit("new "), "label").alias("label"),
    )
    return upserts.update_or_create(stored, incoming, keys, ["id"], keep_stored=["id"])


@query(
    "upsert_subscriptions",
    """WITH incoming AS (SELECT user_id, source_id, channel, sha256(lower(target)) AS target_hash, max(id) AS id,
            arg_max(translate_language, id) FILTER (translate_language IS NOT NULL) AS x FROM v_subscriptions WHERE NOT is_active GROUP BY ALL),
        asked AS (SELECT source_id, min(polling_interval_minutes) AS asked FROM v_submitted GROUP BY 1)
        SELECT s.user_id, s.source_id, s.channel, sha256(lower(s.target)) AS target_hash, s.id, s.created_at,
            true AS is_active, s.is_active AS was_active, false AS is_new, CAST(least(q.polling_interval_minutes, asked) AS BIGINT) AS polling_interval_minutes
        FROM v_subscriptions s JOIN v_sources q ON q.id = s.source_id LEFT JOIN asked a ON a.source_id = s.source_id""",
)
def upsert_subscriptions(v):
    subs = v.subscriptions.select(
        "user_id", "source_id", "channel", F.sha2(F.lower("target"), 256).alias("target_hash"), "id", "created_at",
        "is_active", F.col("is_active").alias("was_active"),
    )
    merged = upserts.upsert_subscriptions(subs, subs.where("NOT is_active"))
    intervals = upserts.lowered_intervals(v.sources, v.submitted).withColumnRenamed("id", "source_id")
    return merged.join(intervals, "source_id")
