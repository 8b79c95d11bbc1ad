"""Named queries against their DuckDB oracles. ``ORACLE_TESTS=all`` covers every query instead of the default sample."""

from __future__ import annotations

import os

import pytest
from oracle_harness import compare, connect

from feedweir.plans import all_queries, bound, oracles

SAMPLE = """scan_tables canonicalize_urls resolve_sources alias_registry upsert_articles clean_text parse_dates normalize_articles
detect_new_articles enrich_articles enrichment_batches content_changes attempt_lifecycle health_states poll_batch activate_schema
shadow_activation requeue_rules email_digests delivery_outcomes message_payloads source_diagnostics chat_membership_state
parse_rss_items link_candidates rank_candidates card_fields clean_markdown_lines stream_health stream_domain_rate""".split()
NAMES = all_queries() if os.environ.get("ORACLE_TESTS") == "all" else SAMPLE


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, sf_dir, name):
    _, error = compare(duck, spark, sf_dir, bound(name), oracles().get(name))
    assert error is None, error


def test_every_oracle_has_a_query():
    assert set(oracles()) <= set(all_queries()) and len(all_queries()) == 142
