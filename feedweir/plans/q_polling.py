"""Queries over source selection and generation state."""

from __future__ import annotations

from feedweir.operators import polling
from feedweir.plans.oracle_parts import jitter
from feedweir.plans.registry import query
from feedweir.plans.views import NOW, now_column

COUNTED = "c AS (SELECT s.*, (SELECT count(*) FROM v_subscriptions b WHERE b.source_id = s.id AND b.is_active) AS n FROM v_sources s)"


@query("active_sources", f"WITH {COUNTED} SELECT id, n AS active_subscriptions FROM c WHERE n > 0")
def active_sources(v):
    return polling.active_sources(v.sources, v.subscriptions).select("id", "active_subscriptions")


STATES = f"""st AS (SELECT *, CASE WHEN n > 0 THEN 'active' WHEN coalesce(last_success_at, updated_at, created_at) <= {NOW} - INTERVAL '30' DAY
    THEN 'cold' ELSE 'inactive' END AS state FROM c)"""


@query("usage_states", f"WITH {COUNTED}, {STATES} SELECT id AS source_id, state AS usage_state FROM st")
def usage_states(v):
    return polling.usage_states(v.sources, v.subscriptions, now_column())


@query(
    "poll_intervals",
    f"""WITH {COUNTED}, {STATES}, i AS (SELECT *, CASE state WHEN 'active' THEN greatest(5, polling_interval_minutes) WHEN 'cold' THEN 10080 ELSE 1440 END AS m FROM st)
        SELECT id AS source_id, state AS usage_state, CAST(m AS BIGINT) AS interval_minutes,
            CASE WHEN next_check_at IS NULL OR usage_state <> state THEN {NOW} + (m * 60 + {jitter("sha256(CAST(id AS VARCHAR))", 0, 120)}) * INTERVAL '1' SECOND
            ELSE next_check_at END AS next_check_at FROM i""",
)
def poll_intervals(v):
    now = now_column()
    return polling.poll_intervals(v.sources, polling.usage_states(v.sources, v.subscriptions, now), now)


DUE = f"""due AS (SELECT id AS source_id, lower(host) AS domain, CASE WHEN source_type IN ('unknown', 'html') OR status = 'discovery_failed' THEN 'discover'
    ELSE 'fetch' END AS route FROM c WHERE n > 0 AND CASE WHEN next_check_at IS NOT NULL THEN next_check_at <= {NOW} WHEN last_fetched_at IS NULL THEN true
    ELSE epoch({NOW}) - epoch(last_fetched_at) >= 60 * greatest(5, polling_interval_minutes) END)"""


@query("due_sources", f"WITH {COUNTED}, {DUE} SELECT source_id FROM due")
def due_sources(v):
    return polling.due_sources(v.sources, v.subscriptions, now_column()).selectExpr("id AS source_id")


def _batch_oracle(limit):
    return f"""WITH {COUNTED}, {DUE}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY source_id) <= 2 AS ok FROM due),
        k AS (SELECT *, count(*) FILTER (ok) OVER (ORDER BY source_id) AS taken FROM r)
        SELECT source_id, domain, route, CASE WHEN ok THEN 'dispatch' ELSE 'defer' END AS action FROM k
        WHERE CASE WHEN ok THEN taken <= {limit} ELSE taken < {limit} END"""


@query("poll_batch", _batch_oracle(180))
def poll_batch(v):
    return polling.poll_batch(v.sources, v.subscriptions, now_column())


@query(
    "route_sources",
    """SELECT id AS source_id, CASE WHEN source_type IN ('unknown', 'html') OR status = 'discovery_failed' THEN 'discover' ELSE 'fetch' END AS route,
        CASE WHEN source_type IN ('unknown', 'html') OR status IN ('pending', 'discovery_failed', 'parse_failed', 'normalize_failed', 'detect_failed')
            OR canonical_url IS NULL THEN 'discover' ELSE 'fetch' END AS retry_route FROM v_sources""",
)
def route_sources(v):
    return polling.route_sources(v.sources)


@query(
    "repair_candidates",
    f"""WITH sh AS (SELECT source_id, max(id) AS shadow_schema_id FROM v_schemas WHERE is_shadow GROUP BY 1),
        j AS (SELECT s.id AS source_id, shadow_schema_id, CASE WHEN shadow_schema_id IS NOT NULL THEN 'revalidate_shadow'
            WHEN source_type IN ('unknown', 'html') AND consecutive_failures >= 3
                AND (repair_requested_at IS NULL OR repair_requested_at <= {NOW} - INTERVAL '60' MINUTE) THEN 'repair' END AS action
            FROM v_sources s LEFT JOIN sh ON sh.source_id = s.id)
        SELECT * FROM j WHERE action IS NOT NULL""",
)
def repair_candidates(v):
    return polling.repair_candidates(v.sources, v.schemas, now_column())


@query(
    "stale_generations",
    f"""SELECT id, 'failed' AS status, 'Generation timed out after 180 seconds. Escalated to admin debug.' AS message, {NOW} AS finished_at, true AS timed_out
        FROM v_generations WHERE status IN ('queued', 'discovering', 'fetching', 'parsing') AND coalesce(started_at, created_at) <= {NOW} - INTERVAL '180' SECOND
        ORDER BY id LIMIT 200""",
)
def stale_generations(v):
    return polling.stale_generations(v.generations, now_column())
