"""Queries over reports and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedweir.operators import reports as R
from feedweir.plans.oracle_parts import iso
from feedweir.plans.registry import query
from feedweir.plans.views import NOW, now_column


@query(
    "user_dashboard",
    """SELECT user_id, CAST(count(*) AS BIGINT) AS subscriptions, CAST(count(*) FILTER (is_active) AS BIGINT) AS active_subscriptions,
        count(DISTINCT source_id) AS sources FROM v_subscriptions GROUP BY 1""",
)
def user_dashboard(v):
    return R.user_dashboard(v.subscriptions)


@query(
    "paged_subscriptions",
    """SELECT x.user_id, x.id, x.source_id, x.channel, CAST(rn AS INT) AS pos, s.source_url, s.status FROM (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY id DESC) AS rn FROM v_subscriptions) x LEFT JOIN v_sources s ON s.id = x.source_id WHERE rn <= 12""",
)
def paged_subscriptions(v):
    return R.paged_subscriptions(v.subscriptions, v.sources)


@query(
    "source_profile",
    """SELECT source_id, 'article' AS kind, CAST(rn AS INT) AS pos, id AS item_id, published_at AS at FROM (SELECT *, row_number() OVER
            (PARTITION BY source_id ORDER BY published_at DESC, id DESC) AS rn FROM v_articles) x WHERE rn <= 25
        UNION ALL SELECT source_id, 'fetch', CAST(rn AS INT), id, fetched_at FROM (SELECT *, row_number() OVER
            (PARTITION BY source_id ORDER BY fetched_at DESC, id DESC) AS rn FROM v_fetches) y WHERE rn <= 20""",
)
def source_profile(v):
    return R.source_profile(v.articles, v.fetches)


@query(
    "source_status_row",
    """WITH a AS (SELECT source_id, count(*) AS n, arg_max({'t': title, 'u': canonical_url, 'p': published_at}, (published_at, id)) AS r FROM v_articles GROUP BY 1),
        f AS (SELECT source_id, count(*) AS n, arg_max({'h': http_status, 'f': fetched_at, 'b': payload_bytes}, (fetched_at, id)) AS r FROM v_fetches GROUP BY 1)
        SELECT s.id AS source_id, status, source_type, (SELECT count(*) FROM v_subscriptions b WHERE b.source_id = s.id AND b.is_active) AS active_subscriptions,
            coalesce(a.n, 0) AS articles, coalesce(f.n, 0) AS fetches, f.r.h AS last_http_status, f.r.f AS last_fetched_at, f.r.b AS last_payload_bytes,
            a.r.t AS last_title, a.r.u AS last_url, a.r.p AS last_published_at
        FROM v_sources s LEFT JOIN a ON a.source_id = s.id LEFT JOIN f ON f.source_id = s.id""",
)
def source_status_row(v):
    return R.source_status_row(v.sources, v.articles, v.fetches, v.subscriptions)


LATEST = """lf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, id DESC) AS rn FROM v_fetches) x WHERE rn = 1),
    la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) AS rn FROM v_attempts) x WHERE rn = 1)"""


@query(
    "latest_of_many",
    f"""WITH {LATEST} SELECT coalesce(lf.source_id, la.source_id) AS source_id, lf.id AS fetch_id, lf.http_status AS fetch_status, la.id AS attempt_id,
        la.stage AS attempt_stage, la.status AS attempt_status FROM lf FULL JOIN la ON la.source_id = lf.source_id""",
)
def latest_of_many(v):
    return R.latest_of_many(v.fetches, v.attempts)


@query(
    "source_overview",
    """SELECT id AS source_id, source_url, status, updated_at, (SELECT count(*) FROM v_articles a WHERE a.source_id = s.id) AS articles,
        (SELECT count(*) FROM v_subscriptions b WHERE b.source_id = s.id AND b.is_active) AS active_subscriptions
        FROM v_sources s ORDER BY updated_at DESC, id DESC LIMIT 120""",
)
def source_overview(v):
    return R.source_overview(v.sources, v.articles, v.subscriptions)


JOBS = """jobs AS (SELECT source_id, max(id) AS id, arg_max(display_name, id) AS display_name, arg_max(failed_at, id) AS failed_at, arg_max(head, id) AS exception_head
    FROM (SELECT id, failed_at, CASE WHEN json_valid(payload) THEN payload ->> '$.displayName' END AS display_name,
        CASE WHEN exception = '' THEN 'Unknown failure' ELSE split_part(exception, chr(10), 1) END AS head,
        try_cast(regexp_extract(CASE WHEN json_valid(payload) THEN payload ->> '$.data.command' END, 'sourceId";s:[0-9]+:"([^"]+)"', 1) AS BIGINT) AS source_id
        FROM v_failed_jobs) k WHERE source_id >= 1 GROUP BY 1)"""


@query("failed_jobs_by_source", f"WITH {JOBS} SELECT * FROM jobs")
def failed_jobs_by_source(v):
    return R.failed_jobs_by_source(v.failed_jobs)


def _case(i):
    def lit(x):
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'"

    return "CASE code " + " ".join(f"WHEN '{k}' THEN {lit(r[i])}" for k, r in R.DIAGNOSES.items()) + " END"


@query(
    "source_diagnostics",
    f"""WITH {LATEST}, {JOBS}, b0 AS (SELECT s.*, CASE WHEN s.id % 5 = 3 THEN 451 END AS noted, CASE WHEN la.id % 2 = 0 THEN 'snapshots/' || la.id || '.html' END AS snapshot, (SELECT count(*) FROM v_subscriptions x WHERE x.source_id = s.id AND x.is_active) AS n,
            (SELECT count(*) FROM v_articles a WHERE a.source_id = s.id) AS n_articles, lf.http_status AS http, la.status AS attempt, la.error_type AS et,
            la.error_message AS em, jobs.display_name AS job, jobs.failed_at AS job_at, jobs.exception_head AS job_error
            FROM v_sources s LEFT JOIN lf ON lf.source_id = s.id LEFT JOIN la ON la.source_id = s.id LEFT JOIN jobs ON jobs.source_id = s.id),
        b AS (SELECT * EXCLUDE usage_state, coalesce(CASE WHEN id % 7 <> 3 THEN usage_state END, CASE WHEN n > 0 THEN 'active' ELSE 'inactive' END) AS usage_state FROM b0),
        d AS (SELECT *, CASE WHEN usage_state <> 'active' AND n = 0 THEN CASE WHEN usage_state = 'cold' THEN 'source_cold' ELSE 'source_inactive' END
            WHEN job IS NOT NULL THEN 'failed_job' WHEN attempt = 'failed' THEN 'parse_attempt_failed' WHEN attempt = 'skipped' THEN 'parse_attempt_skipped'
            WHEN status = 'pending' AND last_fetched_at IS NULL THEN 'pending_never_fetched' WHEN status = 'discovery_failed' THEN 'discovery_failed'
            WHEN status = 'fetch_failed' THEN 'fetch_failed' WHEN health_state = 'blocked' THEN 'source_blocked' WHEN contains(status, 'failed') THEN 'pipeline_failed'
            WHEN status = 'not_modified' AND n_articles = 0 THEN 'not_modified_without_articles' WHEN last_fetched_at IS NULL THEN 'never_fetched'
            WHEN parsed_count = 0 THEN 'parsed_zero_items' WHEN new_articles = 0 AND duplicates_skipped > 0 THEN 'all_duplicates'
            WHEN new_articles > 0 THEN 'new_articles_detected' ELSE 'healthy_idle' END AS code FROM b)
        SELECT id AS source_id, {_case(0)} AS severity, code, CASE code WHEN 'failed_job' THEN 'Last failed job: ' || job || ' at ' || {iso('job_at')} || '.'
            WHEN 'parse_attempt_failed' THEN coalesce(nullif(trim(em), ''), 'Latest parse attempt failed (' || coalesce(et, 'pipeline_error') || ').')
            WHEN 'parse_attempt_skipped' THEN coalesce(nullif(em, ''), 'Latest parse attempt was skipped.')
            WHEN 'discovery_failed' THEN coalesce(discovery_warning, {_case(1)}) WHEN 'fetch_failed' THEN 'Fetch failed with HTTP ' || coalesce(CAST(noted AS VARCHAR), CAST(http AS VARCHAR), 'n/a') || '.'
            WHEN 'source_blocked' THEN 'Source appears blocked (health ' || health_state || ', score ' || health_score || ').'
            WHEN 'pipeline_failed' THEN coalesce(stage_error, {_case(1)})
            WHEN 'new_articles_detected' THEN 'Ingestion healthy. New articles detected: ' || new_articles || '.' ELSE {_case(1)} END AS reason,
            CASE WHEN code IN ('source_cold', 'source_inactive') THEN CASE WHEN next_check_at IS NOT NULL
                THEN 'Next check at ' || {iso('next_check_at')} || '. Source refreshes immediately on demand.'
                ELSE 'Source refreshes on demand or when an active binding is created.' END WHEN code = 'failed_job' THEN job_error
                WHEN code = 'parse_attempt_failed' AND snapshot IS NOT NULL THEN 'Latest snapshot: ' || snapshot || '.' ELSE {_case(2)} END AS hint
        FROM d""",
)
def source_diagnostics(v):
    sources = v.sources.withColumn("usage_state", F.when(F.col("id") % 7 == 3, "").otherwise(F.col("usage_state"))).withColumn(
        "fetch_status_code", F.when(F.col("id") % 5 == 3, F.lit(451))
    )
    number = F.col("id").cast("string")
    attempts = v.attempts.withColumn("snapshot_reference", F.when(F.col("id") % 2 == 0, F.concat(F.lit("snapshots/"), number, F.lit(".html"))))
    return R.source_diagnostics(sources, v.subscriptions, v.articles, v.fetches, attempts, R.failed_jobs_by_source(v.failed_jobs))


@query(
    "generation_stats",
    """SELECT count(*) FILTER (status IN ('queued', 'discovering', 'fetching', 'parsing')) AS pending, count(*) FILTER (status = 'failed') AS failed,
        count(*) FILTER (status = 'failed' AND CAST(meta ->> '$.timed_out' AS BOOLEAN)) AS failed_timed_out, count(*) FILTER (status = 'ready') AS ready
        FROM v_generations""",
)
def generation_stats(v):
    return R.generation_stats(v.generations)


def _list(name, where, column, limit):
    return f"""SELECT '{name}' AS list, CAST(row_number() OVER (ORDER BY {column} DESC, id DESC) AS INT) AS pos, id, user_id, status, {column} AS at
        FROM v_generations WHERE {where} QUALIFY pos <= {limit}"""


@query(
    "generation_lists",
    " UNION ALL ".join(
        "SELECT * FROM (" + q + ") t"
        for q in (
            _list("stale_pending", "status IN ('queued', 'discovering', 'fetching', 'parsing') AND coalesce(started_at, created_at) <= "
                  f"{NOW} - INTERVAL '180' SECOND", "created_at", 40),
            _list("recent_failed", "status = 'failed'", "updated_at", 60),
            _list("recent", "true", "created_at", 120),
        )
    ),
)
def generation_lists(v):
    return R.generation_lists(v.generations, now_column())


@query(
    "webhook_usage",
    """SELECT w.id AS webhook_id, (SELECT count(*) FROM v_subscriptions s WHERE s.user_id = w.user_id AND s.channel = w.channel
        AND sha256(lower(s.target)) = w.url_hash AND s.is_active) AS feed_count FROM v_webhooks w""",
)
def webhook_usage(v):
    return R.webhook_usage(v.webhooks, v.subscriptions)


@query(
    "integration_stats",
    """WITH h AS (SELECT user_id, count(*) FILTER (channel = 'slack') AS slack, count(*) FILTER (channel = 'discord') AS discord,
            count(*) FILTER (channel = 'teams') AS teams, count(*) FILTER (channel = 'email') AS email FROM v_webhooks GROUP BY 1),
        c AS (SELECT owner_user_id AS user_id, count(*) FILTER (chat_type IN ('group', 'supergroup')) AS linked_groups,
            count(*) FILTER (chat_type = 'channel') AS linked_channels FROM v_chats WHERE bot_is_member GROUP BY 1),
        j AS (SELECT coalesce(h.user_id, c.user_id) AS user_id, coalesce(slack, 0) AS slack, coalesce(discord, 0) AS discord, coalesce(teams, 0) AS teams,
            coalesce(email, 0) AS email, coalesce(linked_groups, 0) AS linked_groups, coalesce(linked_channels, 0) AS linked_channels
            FROM h FULL JOIN c ON c.user_id = h.user_id)
        SELECT *, (slack > 0)::INT + (discord > 0)::INT + (teams > 0)::INT + (email > 0)::INT + (linked_groups + linked_channels > 0)::INT AS active_providers,
            slack + discord + teams + email + linked_groups + linked_channels AS ready_destinations FROM j""",
)
def integration_stats(v):
    return R.integration_stats(v.webhooks, v.chats)


@query(
    "linked_chats",
    """WITH m AS (SELECT *, CASE WHEN chat_type IN ('group', 'supergroup') THEN 'group' WHEN chat_type = 'channel' THEN 'channel' END AS kind FROM v_chats
            WHERE bot_is_member)
        SELECT owner_user_id AS user_id, kind, row_number() OVER (PARTITION BY owner_user_id, kind ORDER BY linked_at DESC, title, id) AS pos, id AS chat_id,
            (SELECT count(*) FROM v_subscriptions s WHERE s.channel = 'telegram' AND s.target = m.telegram_chat_id) AS n FROM m WHERE kind IS NOT NULL""",
)
def linked_chats(v):
    return R.linked_chats(v.chats, v.subscriptions)


@query(
    "chat_membership_state",
    """WITH e AS (SELECT *, new_status IN ('member', 'administrator') AS is_in, old_status NOT IN ('member', 'administrator')
            AND new_status IN ('member', 'administrator') AND actor_id > 0 AS joined FROM v_membership WHERE chat_type <> '')
        SELECT chat_id, arg_max(chat_type, (seen_at, id)) AS chat_type, nullif(arg_max(new_status, (seen_at, id)), '') AS bot_membership_status,
            arg_max(is_in, (seen_at, id)) AS bot_is_member, arg_max(actor_id, (seen_at, id)) FILTER (joined) AS added_by,
            min(seen_at) AS discovered_at, max(seen_at) AS last_seen_at FROM e GROUP BY 1""",
)
def chat_membership_state(v):
    return R.chat_membership_state(v.membership)
