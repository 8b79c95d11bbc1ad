"""Entity views over the sample tables.

The sample data holds no news tables, so each entity is a projection of a sample table that grows with it. The
projections are plain SQL in the subset Spark and DuckDB share, so the operators and their oracles start from
the same rows; the operators themselves are written twice, independently.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

from feedweir.session import prepare

NOW = "TIMESTAMP '2024-02-01 00:00:00'"
NOW_TEXT = "2024-02-01 00:00:00"

MINUTE, HOUR, DAY, SECOND, MILLI = (
    "INTERVAL '1' MINUTE", "INTERVAL '1' HOUR", "INTERVAL '1' DAY", "INTERVAL '1' SECOND",
    "INTERVAL '0.001' SECOND",
)
N_SOURCES = "(SELECT count(*) FROM {supplier})"
N_SUBS = "(SELECT count(*) FROM {customer})"
LANGS = "CASE {x} % 6 WHEN 0 THEN 'uk' WHEN 1 THEN 'en' WHEN 2 THEN 'de' WHEN 3 THEN 'hi' WHEN 4 THEN 'fr' ELSE 'es' END"
K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

VIEWS: dict[str, str] = {
    "v_sources": f"""
        SELECT s.*, {{sha:lower(source_url)}} AS source_url_hash, {{sha:lower(canonical_url)}} AS canonical_url_hash
        FROM (
            SELECT s_suppkey AS id, replace(lower(n_name), '_', '-') || '.example.org' AS host,
                CASE WHEN s_suppkey % 9 = 4 THEN '' ELSE replace(lower(n_name), '_', '-') || '.example.org' END AS domain,
                'https://' || replace(lower(n_name), '_', '-') || '.example.org/site/' || CAST(s_suppkey AS STRING)
                    AS source_url,
                CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'https://' || replace(lower(n_name), '_', '-')
                    || '.example.org/site/' || CAST(s_suppkey AS STRING) || '/rss' END AS canonical_url,
                CASE s_suppkey % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'atom' WHEN 2 THEN 'json_feed' WHEN 3 THEN 'html'
                    ELSE 'unknown' END AS source_type,
                CASE s_suppkey % 8 WHEN 0 THEN 'pending' WHEN 1 THEN 'active' WHEN 2 THEN 'discovery_failed'
                    WHEN 3 THEN 'fetch_failed' WHEN 4 THEN 'not_modified' WHEN 5 THEN 'parse_failed'
                    ELSE 'active' END AS status,
                CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' ELSE 'cold' END AS usage_state,
                CAST(abs(floor(s_acctbal)) AS BIGINT) % 101 AS health_score,
                CASE s_suppkey % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'healthy' WHEN 2 THEN 'degraded'
                    ELSE 'repairing' END AS health_state,
                s_suppkey % 6 AS consecutive_failures,
                5 * (s_suppkey % 13) AS polling_interval_minutes,
                CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE {NOW} - (s_suppkey * 37 % 3000) * {MINUTE} END
                    AS last_fetched_at,
                CASE WHEN s_suppkey % 6 < 3 THEN NULL ELSE {NOW} + ((s_suppkey * 53 % 400) - 200) * {MINUTE} END
                    AS next_check_at,
                CASE WHEN s_suppkey % 5 = 1 THEN NULL ELSE {NOW} - (s_suppkey * 11 % 60) * {DAY} + 1 * {MINUTE} END
                    AS last_success_at,
                CASE WHEN s_suppkey % 4 = 1 THEN NULL ELSE {NOW} - (s_suppkey * 7 % 200) * {MINUTE} END
                    AS last_parsed_at,
                {NOW} - (s_suppkey * 13 % 1000) * {HOUR} AS updated_at,
                {NOW} - (s_suppkey % 90) * {DAY} AS created_at,
                CASE WHEN s_suppkey % 10 < 2 THEN {NOW} - (s_suppkey * 17 % 150) * {MINUTE} END AS repair_requested_at,
                CASE WHEN s_suppkey % 11 = 0 THEN 0 WHEN s_suppkey % 11 < 8 THEN s_suppkey % 30 END AS parsed_count,
                CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN s_suppkey % 5 END AS new_articles,
                CASE s_suppkey % 3 WHEN 0 THEN s_suppkey % 4 END AS duplicates_skipped,
                CASE WHEN s_suppkey % 16 = 2 THEN 'No feed found on page.' END AS discovery_warning,
                CASE WHEN s_suppkey % 16 = 5 THEN 'Unexpected end of document.' END AS stage_error
            FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey
        ) s""",
    "v_subscriptions": f"""
        SELECT c_custkey AS id, CAST(floor(c_custkey / 7) AS BIGINT) AS user_id,
            c_custkey % {N_SOURCES} AS source_id,
            CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'telegram' WHEN 'BUILDING' THEN 'slack'
                WHEN 'FURNITURE' THEN 'discord' WHEN 'HOUSEHOLD' THEN 'teams' ELSE 'email' END AS channel,
            CASE c_mktsegment WHEN 'AUTOMOBILE' THEN CAST(c_custkey % 40 AS STRING)
                WHEN 'BUILDING' THEN CASE WHEN c_custkey % 4 = 0 THEN 'https://example.com/hook/'
                    ELSE 'https://hooks.slack.com/services/' END || CAST(c_custkey % 40 AS STRING)
                WHEN 'FURNITURE' THEN CASE WHEN c_custkey % 5 = 0 THEN 'https://discord.com/hooks/'
                    ELSE 'https://discord.com/api/webhooks/' END || CAST(c_custkey % 40 AS STRING)
                WHEN 'HOUSEHOLD' THEN CASE c_custkey % 7 WHEN 0 THEN 'https://prod-1.logic.azure.com/workflows/'
                    WHEN 1 THEN 'https://acme.webhook.office.com/hook/' WHEN 2 THEN 'http://acme.webhook.office.com/'
                    WHEN 3 THEN 'https://x.api.powerplatform.com/powerautomate/automations/direct/workflows/1?sig=a'
                    WHEN 4 THEN 'https://x.api.powerplatform.com/other/1?sig=a' WHEN 5 THEN 'https://notoffice.com/'
                    ELSE 'https://office.com/' END || CAST(c_custkey % 40 AS STRING)
                ELSE CASE WHEN c_custkey % 6 = 0 THEN 'not an address' ELSE 'user' || CAST(c_custkey % 40 AS STRING)
                    || '@example.com' END END AS target,
            c_acctbal > 0 AND (c_custkey % {N_SOURCES}) % 3 <> 1 AS is_active, c_nationkey % 3 <> 1 AS translate_enabled,
            CASE WHEN c_nationkey % 4 <> 3 THEN {LANGS.format(x="c_nationkey")} END AS translate_language,
            CASE WHEN c_custkey % 3 = 0 THEN {NOW} - (c_custkey % 50) * {DAY} END AS last_delivered_at,
            {NOW} - (c_custkey * 7 % 5000) * {MINUTE} AS created_at
        FROM {{customer}}""",
    "v_articles": f"""
        SELECT a.*, {{sha:lower(canonical_url)}} AS canonical_url_hash,
            {{sha:lower(canonical_url || '|' || title)}} AS content_hash
        FROM (
            SELECT o_orderkey AS id, o_custkey % {N_SOURCES} AS source_id, 'guid-' || CAST(o_orderkey AS STRING) AS external_id,
                'https://site' || CAST(o_custkey % 40 AS STRING) || '.example.org/news/'
                    || CAST(o_orderkey % 9000000 AS STRING) AS canonical_url,
                CASE o_orderkey % 5 WHEN 0 THEN 'Story ' WHEN 1 THEN 'Quarterly report on order ' ELSE 'Update about item ' END
                    || CAST(o_orderkey AS STRING) AS title,
                CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Priority ' || o_orderpriority
                    || ' &amp; <b>total</b>  of ' || CAST(o_custkey AS STRING) END AS summary,
                CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'https://cdn.example.org/avatar/1.png'
                    WHEN 3 THEN 'https://cdn.example.org/face/width=64.png'
                    ELSE 'https://cdn.example.org/img/' || CAST(o_custkey AS STRING) || '.png' END AS image_url,
                CASE WHEN o_orderkey % 3 = 0 THEN 'html_schema' ELSE 'rss' END AS source_type,
                CAST(o_orderdate AS TIMESTAMP) + (o_orderkey % 1440) * {MINUTE} AS published_at,
                {NOW} - (o_orderkey % 20) * {DAY} AS created_at,
                {NOW} - (o_orderkey % 20) * {DAY} AS discovered_at
            FROM {{orders}}
        ) a""",
    "v_deliveries": f"""
        SELECT min(id) AS id, article_id, subscription_id, channel, min(status) AS status, max(attempts) AS attempts,
            min(queued_at) AS queued_at
        FROM (
            SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS article_id, c_custkey AS subscription_id,
                CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'telegram' WHEN 'BUILDING' THEN 'slack'
                    WHEN 'FURNITURE' THEN 'discord' WHEN 'HOUSEHOLD' THEN 'teams' ELSE 'email' END AS channel,
                CASE WHEN l_linestatus = 'F' THEN 'delivered' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'queued' END AS status,
                CAST(l_quantity AS INT) % 5 AS attempts, CAST(l_shipdate AS TIMESTAMP) AS queued_at
            FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
                JOIN {{customer}} ON c_custkey = (o_custkey + l_linenumber * {N_SOURCES}) % {N_SUBS}
        ) d GROUP BY article_id, subscription_id, channel""",
    "v_fetches": f"""
        SELECT f.*, CASE WHEN http_status = 200 THEN {{sha:'body ' || CAST(source_id AS STRING) || ' ' || CAST(bucket AS STRING)}} END
                AS content_hash,
            CASE WHEN http_status = 200 AND k % 3 <> 0 THEN '"e' || CAST(k AS STRING) || '"' END AS etag,
            CASE WHEN k % 4 = 1 THEN 'Wed, 31 Jan 2024 12:00:00 GMT' END AS last_modified,
            CASE WHEN http_status = 429 THEN CASE k % 4 WHEN 0 THEN CAST(k AS STRING) WHEN 1 THEN 'Thu, 01 Feb 2024 00:30:00 GMT'
                WHEN 2 THEN 'soon' ELSE 'Wed, 31 Jan 2024 12:00:00 GMT' END END AS retry_after
        FROM (
            SELECT event_id AS id, user_id % {N_SOURCES} AS source_id, {K} AS k, CAST(floor({K} / 34) AS BIGINT) AS bucket,
                CASE event_type WHEN 'error' THEN CASE {K} % 6 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN 503
                    WHEN 4 THEN 404 ELSE 301 END WHEN 'view' THEN 304 ELSE 200 END AS http_status,
                CAST(floor(value * 100) AS BIGINT) AS payload_bytes, CAST(ts AS TIMESTAMP) AS fetched_at
            FROM {{events}}
        ) f""",
    "v_attempts": f"""
        SELECT event_id AS id, user_id % {N_SOURCES} AS source_id,
            CASE {K} % 4 WHEN 0 THEN 'fetch' WHEN 1 THEN 'parse' WHEN 2 THEN 'normalize' ELSE 'deduplicate' END AS stage,
            CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'success' END AS status,
            CASE WHEN event_type = 'error' THEN CASE {K} % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network' WHEN 2 THEN 'http_5xx'
                WHEN 3 THEN 'http_429' WHEN 4 THEN 'http_403' WHEN 5 THEN 'parse_empty' ELSE 'http_4xx' END END AS error_type,
            CASE WHEN event_type = 'error' THEN CASE {K} % 7 WHEN 2 THEN 500 WHEN 3 THEN 429 WHEN 4 THEN 403 WHEN 6 THEN 404 END END
                AS http_status,
            CASE WHEN event_type <> 'error' THEN NULL WHEN {K} % 5 = 0 THEN '' ELSE 'error ' || CAST({K} AS STRING) END AS error_message,
            {K} % 4 - 1 AS retry_count, CAST(ts AS TIMESTAMP) AS started_at,
            CAST(ts AS TIMESTAMP) + (CAST(floor(value * 10) AS BIGINT) - 100) * {MILLI} AS finished_at
        FROM {{events}}""",
    "v_generations": f"""
        SELECT c_custkey AS id, CAST(floor(c_custkey / 7) AS BIGINT) AS user_id, c_custkey % {N_SOURCES} AS source_id,
            CASE c_custkey % 8 WHEN 0 THEN 'queued' WHEN 1 THEN 'discovering' WHEN 2 THEN 'fetching' WHEN 3 THEN 'parsing'
                WHEN 4 THEN 'failed' WHEN 5 THEN 'failed' ELSE 'ready' END AS status,
            CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {NOW} - (c_custkey * 19 % 600) * {SECOND} END AS started_at,
            {NOW} - (c_custkey * 23 % 900) * {SECOND} AS created_at, {NOW} - (c_custkey * 29 % 700) * {SECOND} AS updated_at,
            CASE c_custkey % 8 WHEN 4 THEN '{{{{"timed_out": true, "confidence": 0.5}}}}' WHEN 5 THEN '{{{{"timed_out": false}}}}'
                ELSE '{{{{"cache_mode": "fresh"}}}}' END AS meta,
            '[{{{{"title": "  <b>Item</b> &amp; ' || c_name || '", "url": "HTTP://Example.com//x/' || CAST(c_custkey AS STRING)
                || '/?utm_source=a", "summary": " ", "image_url": " https://cdn.example.org/i.png ", '
                || '"published_at": "2024-01-05T10:00:00Z"}}}}, {{{{"title": "", "url": "", "image": "https://cdn.example.org/j.png", '
                || '"summary": "Line  ' || c_mktsegment || '", "published_at": "whenever"}}}}]' AS preview_items
        FROM {{customer}}""",
    "v_schemas": f"""
        SELECT p_partkey AS id, p_partkey % {N_SOURCES} AS source_id,
            CAST(floor(p_partkey / {N_SOURCES}) AS BIGINT) + 1 AS version,
            CASE p_size % 5 WHEN 0 THEN 'deterministic_rss' WHEN 1 THEN 'deterministic_html_schema' WHEN 2 THEN 'ai_xpath_schema'
                WHEN 3 THEN 'deterministic_atom' ELSE 'deterministic_html_schema' END AS strategy_type,
            CASE p_size % 4 WHEN 0 THEN '{{{{"article_xpath": "//article", "title_xpath": ".//h2", "link_xpath": ".//a/@href"}}}}'
                WHEN 1 THEN '{{{{"article_selector": "//div", "title_xpath": " ", "link_xpath": ".//a/@href"}}}}'
                WHEN 2 THEN '{{{{"source_type": "rss"}}}}' ELSE '{{{{"article_xpath": "//li", "title_selector": ".//h3"}}}}' END AS schema_payload,
            CAST(p_size AS DOUBLE) AS confidence_score, CASE WHEN p_size % 3 > 0 THEN CAST(p_size AS DOUBLE) END AS validation_score,
            (p_partkey + CAST(floor(p_partkey / {N_SOURCES}) AS BIGINT)) % 4 = 0 AS is_active, p_partkey % 89 = 1 AS is_shadow,
            CASE WHEN p_size % 6 = 0 THEN NULL ELSE {NOW} - (p_partkey * 31 % 2000) * {MINUTE} END AS last_validated_at
        FROM {{part}}""",
    "v_validations": f"""
        SELECT event_id AS id, user_id AS schema_id, CAST(floor(value) AS BIGINT) % 101 AS avg_score, CAST(ts AS TIMESTAMP) AS run_at
        FROM {{events}}""",
    "v_webhooks": f"""
        SELECT w.*, {{sha:lower(target)}} AS url_hash
        FROM (
            SELECT c_custkey AS id, CAST(floor(c_custkey / 7) AS BIGINT) AS user_id,
                CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'slack' WHEN 'BUILDING' THEN 'slack' WHEN 'FURNITURE' THEN 'discord'
                    WHEN 'HOUSEHOLD' THEN 'teams' ELSE 'email' END AS channel,
                'https://hooks.slack.com/services/' || CAST(c_custkey % 40 AS STRING) AS target, c_name AS label,
                {NOW} - (c_custkey * 7 % 5000) * {MINUTE} AS created_at
            FROM {{customer}}
        ) w""",
    "v_chats": f"""
        SELECT c_custkey AS id, CAST(floor(c_custkey / 7) AS BIGINT) AS owner_user_id,
            CAST(c_custkey % 40 AS STRING) AS telegram_chat_id,
            CASE c_nationkey % 4 WHEN 0 THEN 'group' WHEN 1 THEN 'supergroup' WHEN 2 THEN 'channel' ELSE 'private' END AS chat_type,
            c_name AS title, c_acctbal > 2000 AS bot_is_member, {NOW} - (c_custkey * 11 % 300) * {HOUR} AS linked_at
        FROM {{customer}}""",
    "v_membership": f"""
        SELECT event_id AS id, user_id AS chat_id, {K} AS actor_id, CAST(ts AS TIMESTAMP) AS seen_at,
            CASE WHEN {K} % 9 = 0 THEN '' WHEN {K} % 2 = 0 THEN 'group' ELSE 'channel' END AS chat_type,
            CASE event_type WHEN 'click' THEN 'left' WHEN 'view' THEN 'member' WHEN 'error' THEN 'administrator' WHEN 'signup' THEN 'left'
                ELSE 'kicked' END AS old_status,
            CASE event_type WHEN 'click' THEN 'member' WHEN 'view' THEN 'left' WHEN 'error' THEN 'member'
                WHEN 'signup' THEN 'administrator' ELSE '' END AS new_status
        FROM {{events}}""",
    "v_failed_jobs": f"""
        SELECT event_id AS id,
            CASE WHEN {K} % 10 = 0 THEN 'not json' ELSE '{{{{"displayName": "Job' || CAST({K} % 4 AS STRING)
                || '", "data": {{{{"command": "O:8:sourceId\\\\";s:2:\\\\"' || CAST(user_id % {N_SOURCES} AS STRING)
                || '\\\\";"}}}}}}}}' END AS payload,
            CASE WHEN {K} % 8 = 0 THEN '' ELSE 'Error ' || CAST({K} AS STRING) || {{nl}} || 'at line 1' END AS exception,
            CAST(ts AS TIMESTAMP) AS failed_at
        FROM {{events}} WHERE event_type = 'error'""",
    "v_translated": f"""
        SELECT o_orderkey AS id, o_orderkey AS article_id, {LANGS.format(x="o_custkey")} AS language,
            'Translated ' || CAST(o_orderkey AS STRING) AS title,
            'https://reader.example.org/t/' || CAST(o_orderkey AS STRING) AS public_url,
            CASE o_orderkey % 3 WHEN 0 THEN 'https://cdn.example.org/t/' || CAST(o_orderkey AS STRING) || '.png'
                WHEN 1 THEN 'https://cdn.example.org/user/7.png' END AS image_url
        FROM {{orders}} WHERE o_orderstatus <> 'P'""",
    "v_submitted": f"""
        SELECT c_custkey AS id, CASE c_custkey % 5
                WHEN 0 THEN 'HTTPS://' || upper(replace(n_name, '_', '-')) || '.Example.org:443//site/' || CAST(s_suppkey AS STRING)
                    || '/?utm_source=n&gclid=1#top'
                WHEN 1 THEN replace(lower(n_name), '_', '-') || '.example.org/site/' || CAST(s_suppkey AS STRING) || '/rss'
                WHEN 2 THEN 'https://alias' || CAST(c_custkey % 150 AS STRING) || '.example.org/?b=2&a=1'
                WHEN 3 THEN 'https://new' || CAST(c_custkey % 50 AS STRING) || '.example.net/feed/'
                ELSE 'not a url' END AS url,
            c_custkey % {N_SOURCES} AS source_id, {NOW} - (c_custkey * 7 % 5000) * {MINUTE} AS seen_at,
            5 * (c_custkey % 4) AS polling_interval_minutes
        FROM {{customer}} JOIN {{supplier}} ON s_suppkey = (c_custkey * 3) % {N_SOURCES} JOIN {{nation}} ON s_nationkey = n_nationkey""",
    "v_aliases": f"""
        SELECT s_suppkey AS source_id,
            {{sha:'https://alias' || CAST(s_suppkey AS STRING) || '.example.org/?a=1&b=2'}} AS normalized_alias_hash
        FROM {{supplier}}""",
    "v_pages": "SELECT page_id, url, html FROM {pages}",
    "v_docs": "SELECT doc_id, text, lang, source FROM {documents}",
}

_REF = re.compile(r"\bv_[a-z_]+\b")
_TABLE = re.compile(r"\{(region|nation|customer|supplier|part|orders|lineitem|events|documents|pages)\}")


def _expand_sha(sql: str, spark: bool) -> str:
    out, pos = [], 0
    while (start := sql.find("{sha:", pos)) >= 0:
        end = sql.index("}", start)
        body = sql[start + 5 : end]
        out.append(sql[pos:start] + (f"sha2({body}, 256)" if spark else f"sha256({body})"))
        pos = end + 1
    return "".join(out) + sql[pos:]


def _render(sql: str, sf_dir: str | None) -> str:
    text = _expand_sha(sql, sf_dir is not None)
    text = _TABLE.sub(lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`" if sf_dir else m[1], text)
    text = text.replace("{nl}", "'\\n'" if sf_dir else "chr(10)").replace("{{", "{").replace("}}", "}")
    return text if sf_dir else text.replace('\\\\"', '\\"')


def duckdb_sql(body: str) -> str:
    """Oracle text: the views the body needs as CTEs, then the body."""
    needed = [name for name in VIEWS if name in set(_REF.findall(body))]
    ctes = ",\n".join(f"{name} AS ({_render(VIEWS[name], None).strip()})" for name in needed)
    if not ctes:
        return body
    stripped = body.strip()
    if stripped.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{stripped[15:]}"
    if stripped.upper().startswith("WITH "):
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{stripped}"


class Views:
    """Entity views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._stream = prepare(spark), sf_dir, None

    def __getattr__(self, name: str) -> DataFrame:
        if f"v_{name}" not in VIEWS:
            raise AttributeError(name)
        return self.sql(_render(VIEWS[f"v_{name}"], self.dir))

    def streaming(self, table: str) -> Views:
        """The same views with one sample table read as a stream."""
        other = Views(self.spark, self.dir)
        other._stream = table
        return other

    def sql(self, text: str) -> DataFrame:
        if self._stream is None:
            return self.spark.sql(text)
        stream = self.table_stream(self._stream)
        name = f"parquet.`{self.dir}/{self._stream}.parquet`"
        view = f"feedweir_stream_{self._stream}"
        stream.createOrReplaceTempView(view)
        # inside a scalar subquery (row counts that scale the keys) the table stays a batch table
        return self.spark.sql(text.replace(f"FROM {name}", f"FROM {view}").replace(f"SELECT count(*) FROM {view}", f"SELECT count(*) FROM {name}"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def table_stream(self, name: str) -> DataFrame:
        """A sample table, one file or a folder of them, as a stream."""
        from feedweir.sources.tables import SAMPLE_TABLES
        from feedweir.streaming.jobs import read_stream

        # a stream reads folders and patterns; as a pattern the path may also be that of one file
        return read_stream(self.spark, f"{self.dir}/{name}[.]parquet", "*", SAMPLE_TABLES[name])


@functools.lru_cache(maxsize=1)
def now_column():
    from pyspark.sql import functions as F

    return F.lit(NOW_TEXT).cast("timestamp")
