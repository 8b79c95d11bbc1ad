"""The discovery chain on hand-made responses."""

from __future__ import annotations

import pytest

from feedweir.operators import discovery

RSS = "<rss version='2.0'><channel><title>t</title></channel></rss>"
JSON = '{"version": "https://jsonfeed.org/version/1.1", "items": []}'
PAGE = """<html><head><link rel="Alternate" type="application/atom+xml" href="/b.atom" title="B"><link rel="alternate" type="text/css" href="/x">
<link rel="alternate" type="application/rss+xml" href="/a.rss"></head><body><a href="/feed/all">RSS</a> <a href="/feed/all#top">Feed again</a>
<a href="/feed/gone">Subscribe</a> <a href="/about">Our feed</a></body></html>"""
EMPTY = "<html><body><p>Nothing here.</p></body></html>"


@pytest.fixture(scope="module")
def found(spark):
    responses = spark.createDataFrame(
        [
            (1, "https://direct.example.org/x", RSS),
            (2, "https://page.example.org/news", PAGE),
            (3, "https://probe.example.org/a", EMPTY),
            (4, "https://probe.example.org/b", None),
            (5, "https://down.example.org/atom/1", None),
            (6, "https://down.example.org/plain", ""),
            (7, "not a url", None),
            (8, "https://json.example.org/", JSON),
            (9, "https://www.tsn.ua/", EMPTY),
        ],
        "id bigint, url string, body string",
    )
    answers = spark.createDataFrame(
        [
            (1, "https://page.example.org/feed/all", "json_feed", 0.98),
            (2, "https://page.example.org/feed/gone", "html", 0.45),
            (3, "https://probe.example.org/feed", "rss", 0.99),
            (4, "https://probe.example.org/rss", "atom", 0.99),
            (5, "https://probe.example.org/rss.xml", "rss", 0.99),
            (6, "https://probe.example.org/rss.xml", "html", 0.45),  # a later answer of the same address
            (7, "https://tsn.ua/rss/full.rss", "rss", 0.5),
            (8, "https://page.example.org/rss", "rss", 0.99),  # the page announces feeds, so nobody asks here
        ],
        "payload_id bigint, url string, type string, confidence double",
    )
    rows = discovery.rank_candidates(discovery.discover(responses, answers)).orderBy("requested_url", "pos").collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r.requested_url, []).append(r)
    return out


def shown(rows):
    return [(r.url, r.type, r.confidence, r.strategy) for r in rows]


def test_payload_itself(found):
    assert shown(found["https://direct.example.org/x"]) == [("https://direct.example.org/x", "rss", 0.99, "content_inspection")]
    assert shown(found["https://json.example.org/"]) == [("https://json.example.org/", "json_feed", 0.98, "content_inspection")]


def test_page_offers_feeds_in_order(found):
    rows = found["https://page.example.org/news"]
    assert shown(rows) == [
        ("https://page.example.org/news", "html", 0.45, "content_inspection"),
        ("https://page.example.org/b.atom", "atom", 0.87, "html_autodiscovery"),
        ("https://page.example.org/a.rss", "rss", 0.87, "html_autodiscovery"),
        ("https://page.example.org/feed/all", "json_feed", 0.98, "html_action_link"),
    ]
    assert [r.url for r in sorted(rows, key=lambda r: r["rank"])][0] == "https://page.example.org/a.rss"
    assert [r.title for r in rows] == [None, "B", None, None]


def test_probes_only_without_a_feed_and_latest_answer_counts(found):
    probed = [
        ("https://probe.example.org/rss", "atom", 0.99, "common_feed_probe"),
        ("https://probe.example.org/feed", "rss", 0.99, "common_feed_probe"),
    ]
    assert shown(found["https://probe.example.org/a"])[1:] == probed
    assert shown(found["https://probe.example.org/b"]) == probed
    assert ("https://tsn.ua/rss/full.rss", "rss", 0.72, "common_feed_probe") in shown(found["https://www.tsn.ua/"])


def test_guess_without_candidates(found):
    assert shown(found["https://down.example.org/atom/1"]) == [("https://down.example.org/atom/1", "atom", 0.6, "url_heuristic")]
    assert shown(found["https://down.example.org/plain"]) == [("https://down.example.org/plain", "unknown", 0.35, "fallback_unknown")]
    assert shown(found["not a url"]) == [("not a url", "unknown", 0.35, "fallback_unknown")]
