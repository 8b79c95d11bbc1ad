"""Each diagnosis of a source, on hand-made rows."""

from __future__ import annotations

import datetime as dt

from feedweir.operators import reports as R

T = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SOURCE = dict(
    usage_state="active", status="active", health_state="healthy", health_score=80, last_fetched_at=T, last_parsed_at=T, next_check_at=None, parsed_count=3,
    new_articles=None, duplicates_skipped=None, discovery_warning=None, stage_error=None, fetch_status_code=None,
)
SCHEMA = """id bigint, usage_state string, status string, health_state string, health_score bigint, last_fetched_at timestamp, last_parsed_at timestamp,
    next_check_at timestamp, parsed_count bigint, new_articles bigint, duplicates_skipped bigint, discovery_warning string, stage_error string, fetch_status_code int"""
CASES = {
    1: (dict(usage_state="cold", next_check_at=T), "source_cold", "Next check at 2024-01-01T00:00:00+00:00. Source refreshes immediately on demand."),
    2: (dict(usage_state="inactive"), "source_inactive", "Source refreshes on demand or when an active binding is created."),
    3: (dict(usage_state=""), "source_inactive", "Source refreshes on demand or when an active binding is created."),
    4: (dict(usage_state="", status="fetch_failed", fetch_status_code=451), "fetch_failed", "Source may block bot traffic or URL may be invalid."),  # subscribed
    5: (dict(usage_state=None, status="fetch_failed"), "fetch_failed", "Source may block bot traffic or URL may be invalid."),  # subscribed
    6: ({}, "failed_job", "Boom"),
    7: ({}, "failed_job", "Open failed jobs/Horizon for stack trace."),
    8: ({}, "parse_attempt_failed", "Latest snapshot: s/8.html."),
    9: ({}, "parse_attempt_failed", "Retry source and inspect parse attempts."),
    10: ({}, "parse_attempt_skipped", "Check source payload/cache availability and retry."),
    11: (dict(status="discovery_failed"), "discovery_failed", "Check URL accessibility and feed autodiscovery tags."),
    12: (dict(health_state="blocked", health_score=None), "source_blocked", "Try browser fallback strategy or reduce request frequency."),
    13: (dict(status="parse_failed", stage_error="Bad"), "pipeline_failed", "Retry the source and inspect failed jobs if issue repeats."),
    14: (dict(status="not_modified"), "not_modified_without_articles", "Force a fresh fetch to obtain first baseline payload."),
    15: (dict(last_fetched_at=None), "never_fetched", "Retry source pipeline."),
    16: (dict(parsed_count=0), "parsed_zero_items", "Resolved URL may not be a valid RSS/Atom/JSON feed."),
    17: (dict(new_articles=0, duplicates_skipped=2), "all_duplicates", None),
    18: (dict(new_articles=4), "new_articles_detected", None),
    19: ({}, "healthy_idle", None),
    20: (dict(status="pending", last_fetched_at=None), "pending_never_fetched", "Retry source pipeline. Verify ingestion worker/scheduler is running."),
}
REASONS = {
    4: "Fetch failed with HTTP 451.",
    5: "Fetch failed with HTTP 503.",
    6: "Last failed job: Fetch at 2024-01-01T00:00:00+00:00.",
    7: "Last failed job: Parse at n/a.",
    8: "broken",
    9: "Latest parse attempt failed (pipeline_error).",
    10: "Latest parse attempt was skipped.",
    12: "Source appears blocked (health blocked, score 0).",
    13: "Bad",
    18: "Ingestion healthy. New articles detected: 4.",
}


def test_every_diagnosis(spark):
    names = [f.split()[0] for f in SCHEMA.replace("\n", " ").split(",")]
    rows = [{**SOURCE, **change, "id": i} for i, (change, _, _) in CASES.items()]
    sources = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)
    subscriptions = spark.createDataFrame([(1, 4, True), (2, 5, True), (3, 3, False)], "id bigint, source_id bigint, is_active boolean")
    articles = spark.createDataFrame([(1, 19)], "id bigint, source_id bigint")
    fetches = spark.createDataFrame(
        [(1, 4, T, 500), (2, 5, T, 404), (3, 5, T, 503)], "id bigint, source_id bigint, fetched_at timestamp, http_status int"
    )
    attempts = spark.createDataFrame(
        [
            (1, 8, T, "failed", "x", " broken ", "s/8.html"), (2, 9, T, "failed", None, " ", None), (3, 10, T, "success", None, None, None),
            (4, 10, T, "skipped", None, "", "s/10.html"), (5, 19, T, "success", None, None, "s/19.html"),
        ],
        "id bigint, source_id bigint, started_at timestamp, status string, error_type string, error_message string, snapshot_reference string",
    )
    jobs = spark.createDataFrame(
        [(6, 1, "Fetch", T, "Boom"), (7, 2, "Parse", None, None), (1, 3, "Fetch", T, "Boom")],
        "source_id bigint, id bigint, display_name string, failed_at timestamp, exception_head string",
    )
    got = {r.source_id: r for r in R.source_diagnostics(sources, subscriptions, articles, fetches, attempts, jobs).collect()}
    assert {i: (r.code, r.hint) for i, r in got.items()} == {i: (code, hint) for i, (_, code, hint) in CASES.items()}
    assert {i: got[i].reason for i in REASONS} == REASONS
