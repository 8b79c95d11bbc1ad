"""Streaming queries: the sample tables are read as streams and drained; results equal the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweir.plans.oracle_parts import limit
from feedweir.plans.payloads import payloads
from feedweir.plans.q_articles import NORMAL, items
from feedweir.plans.q_crawl import BY_SCORE, LOG
from feedweir.plans.q_feeds import RAW
from feedweir.plans.registry import query
from feedweir.plans.views import now_column
from feedweir.streaming import jobs


@query(
    "stream_ingest",
    f"WITH {RAW} SELECT url AS canonical_url, {limit('title', 240)} AS title FROM items",
)
def stream_ingest(v):
    return jobs.ingest(payloads(v.table_stream("documents"))).select("canonical_url", "title")


@query("stream_dedupe", f"WITH {NORMAL} SELECT DISTINCT canonical_url_hash FROM normalized")
def stream_dedupe(v):
    from feedweir.operators.articles import normalize_articles

    stream = normalize_articles(items(v.streaming("documents")))
    return jobs.dedupe_articles(stream.select("canonical_url_hash"))


@query("stream_health", f"WITH {LOG} SELECT source_id, health_score, consecutive_failures, CASE WHEN last_status = 'success' THEN {BY_SCORE} "
       f"WHEN last_http IN (403, 429) THEN 'blocked' WHEN consecutive_failures >= 5 OR health_score < 25 THEN 'broken' "
       f"WHEN consecutive_failures >= 2 THEN 'repairing' ELSE {BY_SCORE} END AS health_state FROM score")
def stream_health(v):
    return jobs.running_health(v.streaming("events").attempts)


@query(
    "stream_watchdog",
    """WITH g AS (SELECT id, status, coalesce(started_at, created_at) AS pending_since FROM v_generations)
        SELECT id, 'failed' AS status, pending_since, true AS timed_out FROM g WHERE status IN ('queued', 'discovering', 'fetching', 'parsing')
        AND pending_since + INTERVAL '180' SECOND < TIMESTAMP '2024-02-01 00:00:00'""",
)
def stream_watchdog(v):
    events = v.streaming("customer").generations.select("id", "status", F.coalesce("started_at", "created_at").alias("at"))
    return jobs.watchdog(events, now_column())


@query(
    "stream_domain_rate",
    """WITH w AS (SELECT host AS domain, date_trunc('minute', fetched_at) AS minute, count(*) AS n FROM v_fetches f JOIN v_sources s ON s.id = f.source_id GROUP BY 1, 2)
        SELECT *, greatest(n - 12, 0) AS over_limit FROM w""",
)
def stream_domain_rate(v):
    domains = v.sources.select(F.col("id").alias("source_id"), F.col("host").alias("domain"))
    return jobs.domain_rate(v.streaming("events").fetches.join(domains, "source_id").select("domain", "fetched_at"))


@query(
    "stream_status_changes",
    """SELECT source_id, id, status, started_at AS changed_at FROM (SELECT *, lag(status) OVER (PARTITION BY source_id ORDER BY started_at, id) AS before
        FROM v_attempts) x WHERE status IS DISTINCT FROM before""",
)
def stream_status_changes(v):
    events = v.streaming("events").attempts.select("source_id", "id", "status", F.col("started_at").alias("at"))
    return jobs.status_changes(events).withColumnRenamed("at", "changed_at")


@query("stream_delivery_once", "SELECT DISTINCT l_orderkey AS article_id, l_suppkey AS subscription_id, 'telegram' AS channel FROM lineitem")
def stream_delivery_once(v):
    wanted = v.table_stream("lineitem").select(
        F.col("l_orderkey").alias("article_id"), F.col("l_suppkey").alias("subscription_id"), F.lit("telegram").alias("channel"),
    )
    return jobs.deliver_once(wanted)


@query(
    "stream_freshness",
    """WITH s AS (SELECT DISTINCT source_id, started_at AS t FROM v_attempts WHERE status = 'success'),
        n AS (SELECT *, lag(t) OVER w AS before, coalesce(lead(t) OVER w, TIMESTAMP '2024-02-01 00:00:00') AS later FROM s WINDOW w AS (PARTITION BY source_id ORDER BY t))
        SELECT source_id, t AS at, true AS fresh FROM n WHERE before IS NULL OR t > before + INTERVAL '60' MINUTE
        UNION ALL SELECT source_id, t + INTERVAL '60' MINUTE, false FROM n WHERE later > t + INTERVAL '60' MINUTE""",
)
def stream_freshness(v):
    events = v.streaming("events").attempts.where("status = 'success'").select("source_id", F.col("started_at").alias("at"))
    return jobs.freshness(events, now_column())
