"""The last stage of parsing: items of html payloads by their source's active rule."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from feedweir.functions.urls import canonical_url, url_hash
from feedweir.operators import feeds, listings

RSS = "<rss><channel><item><title>A title from the feed</title><link>/feed-item</link></item></channel></rss>"


def card(href, title, more=""):
    return f'<div class="row entry"><h3><a href="{href}">{title}</a></h3>{more}</div>'


def page(*cards):
    return f"<html><body><main>{''.join(cards)}</main></body></html>"


@pytest.fixture(scope="module")
def items(spark):
    weak = [card("/tag", "A listing of all the tags"), card("/news", "The latest of all our news")]
    bodies = [
        ("https://a.org/list", "html", page(
            card("/2024/one-story", "First story of the page", "<time>2024-01-02</time><p>What the first story is about, in a sentence.</p><img src='/i/1.png'>"),
            card("/2024/two-stories", "Second story of the page", "<p>short</p><img src='/i/avatar.png'>"),
            card("/2024/one-story", "First story, told again"), card("/x", "tiny"), card("/about", "Subscribe to our letters"), *weak)),
        ("https://b.org/weak", "html", page(*weak)),
        ("https://c.org/feed", "html", RSS),
        ("https://d.org/none", "html", page(card("/2024/no-rule", "A story without any rule"))),
        ("https://e.org/many", "unknown", page(*[card(f"/2024/story-{i}", f"Story number {i:04d} of many") for i in range(130)])),
        ("https://f.org/null", None, None),
        ("https://g.org/wide", None, page("<p>No element fits the rule.</p>")),
    ]
    payloads = spark.createDataFrame([(i, i, *b) for i, b in enumerate(bodies)], "payload_id long, source_id long, final_url string, source_type string, body string")
    rules = payloads.where("payload_id <> 3").select(
        url_hash(canonical_url(F.upper("final_url"))).alias("unused"), url_hash(canonical_url("final_url")).alias("url_hash"), (F.col("payload_id") + 70).alias("schema_id"),
        F.lit(3).alias("version"), F.lit("main").alias("within"), F.array(F.lit("div")).alias("item_tags"), F.lit("entry").alias("item_class"),
        F.lit(True).alias("needs_heading"), F.array(F.lit("h3")).alias("title_tags"),
    ).drop("unused")
    assert rules.columns == [c.split()[0] for c in listings.RULE.split(", ")]
    rows = feeds.parse_with_fallback_order(payloads, rules).collect()
    return {p: sorted((r for r in rows if r.payload_id == p), key=lambda r: r.pos) for p in range(len(bodies))}


def test_rule_finds_the_items_of_an_html_payload(items):
    first, second = items[0]
    assert (first.url, first.title, first.pos) == ("https://a.org/2024/one-story", "First story, told again", 0)
    assert (second.url, second.pos, second.summary, second.listing_summary, second.listing_image_url) == ("https://a.org/2024/two-stories", 1, None, None, None)
    assert all((r.parsed_as, r.attempt, r.schema_id, r.schema_version, r.external_id) == ("html_schema", 4, 70, 3, None) for r in items[0])


def test_weak_candidates_stay_where_nothing_better_is_listed(items):
    assert [r.url for r in items[1]] == ["https://b.org/tag", "https://b.org/news"]


def test_feeds_do_not_use_the_rule(items):
    (r,) = items[2]
    assert (r.parsed_as, r.attempt, r.schema_id, r.url) == ("rss", 1, None, "https://c.org/feed-item")


def test_no_rule_no_body_or_no_fit_gives_nothing(items):
    assert items[3] == items[5] == items[6] == []


def test_items_are_capped_in_page_order(items):
    assert [r.url for r in items[4]] == [f"https://e.org/2024/story-{i}" for i in range(100)]
    assert [r.pos for r in items[4]] == list(range(100))


def test_what_the_listing_shows_is_kept(spark):
    html = page(card("/2024/a-story", "A story with everything", "<time>2024-01-02</time><p>What the story is about, in one sentence.</p><img src='/i/1.png'>"))
    payloads = spark.createDataFrame([(1, "https://a.org/", "html", html)], "payload_id long, final_url string, source_type string, body string")
    rules = spark.sql(f"SELECT sha2('https://a.org/', 256) AS url_hash, 5L AS schema_id, 1 AS version, CAST(NULL AS STRING) AS within, array('div') AS item_tags, "
                      "CAST(NULL AS STRING) AS item_class, false AS needs_heading, array('a') AS title_tags")  # fmt: skip
    (r,) = feeds.parse_with_fallback_order(payloads, rules).collect()
    assert r.listing_summary == "What the story is about, in one sentence." and r.listing_image_url == "https://a.org/i/1.png" and r.published_at.day == 2
