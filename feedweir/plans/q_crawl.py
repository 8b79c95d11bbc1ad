"""Queries over fetch and attempt logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweir.operators import crawl, health
from feedweir.plans.registry import query
from feedweir.plans.views import NOW, now_column


@query(
    "conditional_fetch_plan",
    """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, id DESC) AS rn FROM v_fetches) x
        WHERE rn = 1) SELECT s.id AS source_id, l.etag AS if_none_match, l.last_modified AS if_modified_since
        FROM v_sources s LEFT JOIN l ON l.source_id = s.id""",
)
def conditional_fetch_plan(v):
    return crawl.conditional_fetch_plan(v.sources, v.fetches)


@query(
    "classify_fetches",
    """SELECT CASE WHEN http_status = 304 THEN 'not_modified' WHEN http_status BETWEEN 200 AND 299 THEN 'fetched' ELSE 'fetch_failed' END AS status,
        CASE WHEN http_status < 400 THEN NULL WHEN http_status IN (403, 429) THEN 'http_' || http_status WHEN http_status >= 500 THEN 'http_5xx'
            ELSE 'http_4xx' END AS error_type, count(*) AS n FROM v_fetches GROUP BY 1, 2""",
)
def classify_fetches(v):
    return crawl.classify_fetches(v.fetches)


@query(
    "content_changes",
    """SELECT id, source_id, fetched_at, content_hash, prev_hash, content_hash IS NOT NULL AND content_hash IS DISTINCT FROM prev_hash AS changed,
            coalesce(content_hash, prev_hash) AS latest_content_hash
        FROM (SELECT *, last_value(content_hash IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY fetched_at, id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_hash FROM v_fetches) x""",
)
def content_changes(v):
    return crawl.content_changes(v.fetches)


@query("parse_gate", "SELECT id, source_id, content_hash FROM v_fetches WHERE http_status = 200 AND content_hash IS NOT NULL")
def parse_gate(v):
    return crawl.parse_gate(v.fetches).select("id", "source_id", "content_hash")


@query(
    "retry_after",
    f"""WITH w AS (SELECT *, CASE WHEN regexp_full_match(retry_after, '[0-9]+') THEN greatest(1, CAST(retry_after AS BIGINT))
            WHEN starts_with(retry_after, 'Thu') THEN 1800 WHEN starts_with(retry_after, 'Wed') THEN 1 END AS wait FROM v_fetches WHERE http_status = 429),
        l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, id DESC) AS rn FROM w WHERE wait IS NOT NULL) x
            WHERE rn = 1)
        SELECT source_id, CAST(wait AS BIGINT) AS wait_seconds, {NOW} + wait * INTERVAL '1' SECOND AS next_check_at FROM l""".replace(
        "CAST(retry_after AS BIGINT)", "try_cast(retry_after AS BIGINT)"
    ),
)
def retry_after(v):
    return crawl.retry_after(v.fetches, now_column())


@query(
    "domain_rate_window",
    """SELECT lower(host) AS domain, date_trunc('minute', fetched_at) AS minute, CAST(count(*) AS BIGINT) AS n,
        CAST(greatest(count(*) - 12, 0) AS BIGINT) AS over_limit
        FROM v_fetches f JOIN v_sources s ON s.id = f.source_id GROUP BY 1, 2""",
)
def domain_rate_window(v):
    return crawl.domain_rate_window(v.fetches, v.sources)


MS = "greatest(0, CAST(round((epoch_us(finished_at) - epoch_us(started_at)) / 1000) AS BIGINT))"


@query(
    "attempt_durations",
    f"""SELECT stage, count(*) AS n, quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms, max(ms) AS max_ms,
        CAST(sum(greatest(0, retry_count)) AS BIGINT) AS retries FROM (SELECT *, {MS} AS ms FROM v_attempts) a GROUP BY 1""",
)
def attempt_durations(v):
    return crawl.attempt_durations(v.attempts)


@query(
    "attempt_lifecycle",
    """SELECT id AS attempt_id, status, error_type, nullif(error_message, '') AS error_message, started_at, greatest(started_at, finished_at) AS finished_at,
        CAST(round((epoch_us(greatest(started_at, finished_at)) - epoch_us(started_at)) / 1000) AS BIGINT) AS response_time_ms,
        stage, CASE WHEN http_status IS NULL THEN 'none' ELSE CAST(http_status AS VARCHAR) END AS http_status, status AS state FROM v_attempts""",
)
def attempt_lifecycle(v):
    a = v.attempts
    none_s = F.lit(None).cast("string")
    started = a.select(
        F.col("id").alias("attempt_id"), F.lit(0).alias("seq"), F.col("started_at").alias("at"), F.lit("running").alias("status"),
        none_s.alias("error_type"), none_s.alias("error_message"),
        F.create_map(F.lit("stage"), "stage", F.lit("state"), F.lit("running")).alias("context"),
    )
    finished = a.select(
        F.col("id").alias("attempt_id"), F.lit(1).alias("seq"), F.greatest("started_at", "finished_at").alias("at"), "status", "error_type",
        "error_message",
        F.create_map(
            F.lit("http_status"), F.coalesce(F.col("http_status").cast("string"), F.lit("none")), F.lit("state"), F.col("status")
        ).alias("context"),
    )
    rows = crawl.attempt_lifecycle(started.unionByName(finished))
    return rows.select(
        *[c for c in rows.columns if c != "context"], *[F.col("context")[k].alias(k) for k in ("stage", "http_status", "state")]
    )


LOG = """log AS (SELECT source_id, list(CASE WHEN status = 'success' THEN 8 WHEN error_type IN ('timeout', 'network', 'http_5xx') THEN -10 ELSE -15 END
        ORDER BY started_at, id) AS steps, arg_max(status, (started_at, id)) AS last_status, arg_max(coalesce(http_status, 0), (started_at, id)) AS last_http
        FROM v_attempts WHERE status IN ('success', 'failed') GROUP BY 1),
    ok AS (SELECT source_id, max((started_at, id)) AS last_ok FROM v_attempts WHERE status = 'success' GROUP BY 1),
    fails AS (SELECT a.source_id, count(*) AS n FROM v_attempts a LEFT JOIN ok ON ok.source_id = a.source_id
        WHERE a.status = 'failed' AND (ok.last_ok IS NULL OR (a.started_at, a.id) > ok.last_ok) GROUP BY 1),
    score AS (SELECT log.source_id, CAST(list_reduce(steps, lambda s, d: CASE WHEN d > 0 THEN least(100, greatest(40, s) + 8)
        ELSE greatest(0, s + d) END, 50) AS INT) AS health_score, CAST(coalesce(n, 0) AS INT) AS consecutive_failures, last_status, last_http
        FROM log LEFT JOIN fails ON fails.source_id = log.source_id)"""


@query("health_scores", f"WITH {LOG} SELECT source_id, health_score, consecutive_failures FROM score")
def health_scores(v):
    return health.health_scores(v.attempts).select("source_id", "health_score", "consecutive_failures")


BY_SCORE = "CASE WHEN health_score >= 80 THEN 'healthy' WHEN health_score >= 55 THEN 'degraded' WHEN health_score >= 35 THEN 'repairing' ELSE 'broken' END"


@query(
    "health_states",
    f"""WITH {LOG} SELECT source_id, health_score, CASE WHEN last_status = 'success' THEN {BY_SCORE} WHEN last_http IN (403, 429) THEN 'blocked'
        WHEN consecutive_failures >= 5 OR health_score < 25 THEN 'broken' WHEN consecutive_failures >= 2 THEN 'repairing' ELSE {BY_SCORE} END
        AS health_state FROM score""",
)
def health_states(v):
    return health.health_states(health.health_scores(v.attempts))


@query("failure_streaks", f"WITH {LOG} SELECT source_id, consecutive_failures AS streak FROM score")
def failure_streaks(v):
    return health.failure_streaks(v.attempts)


@query(
    "last_stage_meta",
    """WITH d AS (SELECT source_id, error_type AS last_error_type FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC)
            AS rn FROM v_attempts WHERE status <> 'skipped') x WHERE rn = 1)
        SELECT a.source_id, arg_max(stage, (started_at, id)) AS last_stage, max(started_at) AS last_attempt_at,
            max(started_at) FILTER (status = 'success') AS last_success_at, max(started_at) FILTER (status = 'failed') AS last_failure_at,
            any_value(d.last_error_type) AS last_error_type FROM v_attempts a LEFT JOIN d ON d.source_id = a.source_id GROUP BY 1""",
)
def last_stage_meta(v):
    return health.last_stage_meta(v.attempts)
