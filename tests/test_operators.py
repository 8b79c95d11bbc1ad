"""Golden cases and invariants of the operators on small hand-made tables."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from feedweir.functions.urls import canonical_url, url_hash
from feedweir.operators import articles, catalog, crawl, delivery, feeds, health, listings, partitioning, polling, schemas
from feedweir.sources.html import shred_pages

T0 = dt.datetime(2026, 3, 14, 10)
BOATS = ["Harbour reopens after the spring storms", "Two ferries swap their winter routes", "Lighthouse keeper counts seabirds again"]
LISTING = "<html><head></head><body><main>" + "".join(
    f"""<article class="news-card"><h2><a href="/boats/{i}">{boat}</a></h2><time datetime="2026-02-0{i + 1}">day {i + 1}</time>
    <p>What the crews told us about it, in the order in which it happened, part {i}.</p></article>"""
    for i, boat in enumerate(BOATS)
) + "</main></body></html>"


def pages(spark, url, html):
    return shred_pages(spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string"))


def rule(spark, url, **kw):
    base = {"schema_id": 1, "version": 1, "within": None, "item_tags": None, "item_class": None, "needs_heading": False, "title_tags": ["h2", "a"]}
    base.update(kw)
    df = spark.createDataFrame([(url, *base.values())], "u string, schema_id bigint, version int, within string, item_tags array<string>, "
                               "item_class string, needs_heading boolean, title_tags array<string>")
    return df.withColumn("url_hash", url_hash(canonical_url("u"))).drop("u")


def test_listing_pattern(spark):
    got = listings.detect_listing_patterns(pages(spark, "https://boats.example/log", LISTING)).first()
    assert (got.signature, got.items, got.valid_items) == ("article:news-card", 3, 3)
    assert got.confidence == 0.86


def test_rule_extraction_drops_noise(spark):
    """An avatar is no image, a call to action no item, a long paragraph a listing summary."""
    cards = [
        ("/garden/pears", "How the old pear trees were saved", "The orchard was cut back in winter and by June every second tree bore leaves.", '<img src="/pic/avatar-anna.png">'),
        ("/garden/more", "Read more", "Go", ""),
    ]
    html = "<body><main>" + "".join(f'<div class="card"><h2><a href="{u}">{t}</a></h2><p>{p}</p>{i}</div>' for u, t, p, i in cards) + "</main></body>"
    u = "https://garden.example/list"
    rows = listings.schema_extract_items(pages(spark, u, html), rule(spark, u, item_class="card", needs_heading=True)).collect()
    assert [r.title for r in rows] == [cards[0][1]]
    assert rows[0].summary is None and rows[0].image_url is None and rows[0].listing_image_url is None
    assert rows[0].listing_summary == cards[0][2]


def test_rule_extraction_prefers_articles_over_navigation(spark):
    """Section links score below an article with a date, whatever their order."""
    html = """<body><main><div class="menu"><a href="/sport">Усі новини спорту</a></div><div class="menu"><a href="/music">Музика і театр</a></div>
      <article><h2>Міст відкрили після ремонту</h2><p>Рух через річку відновили зранку, автобуси знову ходять.</p>
      <a href="/city/2025/11/02/bridge-is-open">далі</a><time datetime="2025-11-02T07:30:00+00:00">2 листопада</time></article></main></body>"""
    u = "https://city.example/"
    rows = listings.schema_extract_items(pages(spark, u, html), rule(spark, u, within="main", item_tags=["article", "div"])).collect()
    assert [r.url for r in rows] == ["https://city.example/city/2025/11/02/bridge-is-open"]


def payload(spark, *bodies, kind="rss"):
    rows = [(i, 1, "https://example.com/feed.xml", kind, b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "payload_id bigint, source_id bigint, final_url string, source_type string, body string")


RSS = """<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><item><pubDate>Sat, 14 Mar 2026 10:00:00 GMT</pubDate>
<link>https://example.com/pears/1</link><title>Pear harvest</title><content:encoded><![CDATA[<p>Long text</p><img src="/pears/basket.jpg">]]></content:encoded>
<description><![CDATA[<em>Ripe</em> early this year]]></description></item></channel></rss>"""


def test_rss_item(spark):
    r = feeds.parse_with_fallback_order(payload(spark, RSS)).first()
    assert (r.summary, r.image_url, r.published_at) == ("Ripe early this year", "https://example.com/pears/basket.jpg", T0)


def test_malformed_and_empty_payloads(spark):
    out = feeds.parse_outcomes(payload(spark, "<rss><channel><item><title>x", "", "{}", '{"version": "https://jsonfeed.org/version/1", "items": []}')).collect()
    assert all(r.error_type == "parse_empty" for r in out)


def test_atom_and_rdf_and_json(spark):
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">A &amp;lt;b&amp;gt; c</title><link rel="self" href="/s"/>
    <link href="/a"/><updated>2026-03-14T10:00:00Z</updated></entry></feed>"""
    rdf = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><channel/><item><title>R</title>
    <link>https://example.com/r</link></item></rdf:RDF>"""
    js = '{"version": "https://jsonfeed.org/version/1.1", "items": [{"external_url": "https://example.com/j", "content_text": "Body <b>only</b>"}]}'
    got = {r.payload_id: (r.parsed_as, r.url, r.title, r.attempt) for r in feeds.parse_with_fallback_order(payload(spark, atom, rdf, js)).collect()}
    assert got[0][:2] == ("atom", "https://example.com/a") and got[0][3] == 2
    assert got[1] == ("rss", "https://example.com/r", "R", 1)
    assert got[2] == ("json_feed", "https://example.com/j", "Body only", 3)


def test_duplicate_items_keep_first_place_and_last_value(spark):
    items = "".join(f"<item><title>{t}</title><link>https://example.com/{u}</link></item>" for t, u in (("one", "a"), ("two", "b"), ("three", "A")))
    rows = feeds.parse_items(payload(spark, f"<rss><channel>{items}</channel></rss>"), "rss").orderBy("pos").collect()
    assert [(r.pos, r.title) for r in rows] == [(0, "three"), (1, "two")]


def normalized(spark):
    item = "<item><title>{0} News</title><link>https://example.com/{0}</link><pubDate>Sat, 14 Mar 2026 1{1}:00:00 GMT</pubDate></item>"
    body = "<rss><channel>" + item.format("First", 2) + item.format("Second", 3) + "</channel></rss>"
    return articles.normalize_articles(feeds.item_rows(feeds.parsed(payload(spark, body)), "source_id"))


def test_ingest_twice_adds_nothing_and_one_delivery_per_batch(spark):
    rows = normalized(spark)
    none = rows.select("canonical_url_hash", "content_hash").limit(0)
    first = articles.detect_new_articles(rows, none, "pos")
    assert first.count() == 2
    assert articles.detect_new_articles(rows, first.select("canonical_url_hash", "content_hash"), "pos").count() == 0
    stats = articles.detect_stats(rows, first.limit(0)).first()
    assert stats.reason.startswith("All normalized rows are duplicates") and stats.duplicates_skipped == 2
    stored = first.select("source_id", F.col("pos").cast("bigint").alias("id"), "published_at")
    subs = spark.createDataFrame([(7, 1, "telegram", True, False, None)], "id bigint, source_id bigint, channel string, is_active boolean, "
                                 "translate_enabled boolean, translate_language string")
    sent = delivery.fan_out_deliveries(delivery.latest_article_per_batch(stored, ["source_id"]), subs).collect()
    assert [(r.article_id, r.subscription_id) for r in sent] == [(1, 7)]


def test_alias_variants_are_one_source(spark):
    subs = spark.createDataFrame([(1, "https://github.blog/?utm_source=test", 5, T0), (2, "https://github.blog/#top", 5, T0)],
                                 "id bigint, url string, source_id bigint, seen_at timestamp")
    assert catalog.alias_registry(subs).count() == 1


def test_alias_arm_is_optional(spark):
    src = spark.createDataFrame([(1, "https://e.org/feed", None)], "id bigint, source_url string, canonical_url string").select(
        "id", url_hash("source_url").alias("source_url_hash"), url_hash("canonical_url").alias("canonical_url_hash"))
    alias = spark.createDataFrame([(1, "https://e.org/changelog")], "source_id bigint, u string").select("source_id", url_hash("u").alias("normalized_alias_hash"))
    asked = spark.createDataFrame([(1, "https://e.org/changelog")], "id bigint, url string")
    assert catalog.resolve_sources(asked, src, alias).first().source_id == 1
    assert catalog.resolve_sources(asked, src).first().source_id is None


def test_health_fold_equals_sequential_replay(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for source in range(12):
        score, fails = 50, 0
        for i in range(rng.randint(1, 60)):
            ok = rng.random() < 0.5
            error = None if ok else rng.choice(["timeout", "http_4xx", "network", "parse_empty"])
            rows.append((len(rows), source, "success" if ok else "failed", error, None, T0 + dt.timedelta(minutes=37 * i)))
            if ok:
                score, fails = min(100, max(40, score) + 8), 0
            else:
                score, fails = max(0, score - (10 if error in ("timeout", "network") else 15)), fails + 1
        want[source] = (score, fails)
    df = spark.createDataFrame(rows, "id bigint, source_id bigint, status string, error_type string, http_status int, started_at timestamp")
    for width in (60, 3600, 10**9):
        got = {r.source_id: (r.health_score, r.consecutive_failures) for r in health.health_scores(df, width).collect()}
        assert got == want


def test_shadow_activation_needs_two_passing_runs(spark):
    runs = [(1, 1, 80, 0), (2, 1, 85, 1), (3, 2, 80, 0), (4, 2, 10, 1), (5, 2, 90, 2), (6, 3, 90, 0), (7, 3, 90, 500), (8, 3, 1, 900)]
    df = spark.createDataFrame([(i, s, x, T0 + dt.timedelta(minutes=m)) for i, s, x, m in runs], "id bigint, schema_id bigint, avg_score int, run_at timestamp")
    got = {r.schema_id: (r.success_runs, r.activated) for r in health.shadow_activation(df).collect()}
    assert got == {1: (2, True), 2: (1, False), 3: (0, True)}


def test_content_changes_across_slices(spark):
    hashes = ["a", None, "a", "b", None, None, "b", "c"]
    df = spark.createDataFrame([(i, 1, h, T0 + dt.timedelta(hours=i * 5)) for i, h in enumerate(hashes)], "id bigint, source_id bigint, content_hash string, fetched_at timestamp")
    got = [r.changed for r in crawl.content_changes(df).orderBy("id").collect()]
    assert got == [True, False, False, True, False, False, False, True]


def test_numbering_in_slices_equals_row_number(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id"))
    got = partitioning.number_rows(df, ["k"], [F.col("id").desc()], partitioning.id_chunk("id", 100), descending=True)
    want = df.withColumn("w", F.row_number().over(W.partitionBy("k").orderBy(F.col("id").desc())))
    assert got.join(want, ["k", "id"]).where("rn = w").count() == 5000


def source_rows(spark, rows):
    return spark.createDataFrame(
        [(i, f"https://{h}/x", None, h, t, "active", "active", None, None, 30) for i, h, t in rows],
        "id bigint, source_url string, canonical_url string, host string, source_type string, status string, usage_state string, next_check_at timestamp, "
        "last_fetched_at timestamp, polling_interval_minutes int")


def test_poll_batch_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    now = F.lit(T0)
    for cap in (3, 10, 50):
        rows = [(i, f"h{rng.randint(0, 4)}.org", "rss") for i in range(25)]
        subs = spark.createDataFrame([(i, True) for i in range(25)], "source_id bigint, is_active boolean")
        want, per, total = {}, {}, 0
        for i, h, _ in rows:
            if total >= cap:
                break
            if per.get(h, 0) >= 2:
                want[i] = "defer"
            else:
                per[h] = per.get(h, 0) + 1
                total += 1
                want[i] = "dispatch"
        got = {r.source_id: r.action for r in polling.poll_batch(source_rows(spark, rows), subs, now, 2, cap).collect()}
        assert got == want


def test_unknown_and_inactive_sources(spark):
    rows = source_rows(spark, [(1, "a.org", "rss"), (2, "b.org", "unknown"), (3, "c.org", "rss")])
    subs = spark.createDataFrame([(1, True), (2, True), (3, False)], "source_id bigint, is_active boolean")
    got = {r.source_id: r.route for r in polling.poll_batch(rows, subs, F.lit(T0)).collect()}
    assert got == {1: "fetch", 2: "discover"}


def test_snapshot_score(spark):
    df = spark.createDataFrame([(10, 10), (10, 2), (4, 0), (3, 3)], "i int, v int")
    assert [r[0] for r in df.select(schemas.snapshot_score(F.col("i"), F.col("v"))).collect()] == [100, 34, 0, 85]


def test_translation_batch(spark):
    q = spark.createDataFrame([("teams", 9, 1, "create", True, "uk"), ("slack", 9, 2, "create", True, "uk"), ("teams", 9, 3, "skip", True, "uk")],
                              "channel string, article_id bigint, subscription_id bigint, action string, translate_enabled boolean, translate_language string")
    rows = delivery.translation_batches(q).collect()
    assert [(r.channel, r.article_id, r.language, r.recipients) for r in rows] == [("teams", 9, "uk", [1])]
