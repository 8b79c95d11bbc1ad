"""What is asked of feed items, and links on a canonical base."""

from feedweir.functions.urls import absolute_url, canonical_url, resolved_url
from feedweir.operators import feeds


def test_a_canonical_base_resolves_alike(spark):
    hrefs = ["", " a/b ", "/x//y/", "//Other.org:443/q?b=1&a=2", "http://u@h.org:80/p#f", "../../up", "http://h:x/", "mailto:a@b", "?q=1", "a:b//c"]
    bases = ["https://Site.example:443/a/b/?utm_source=x&z=1", "site.example/p", "", "http://[::1]:8080/d/e"]
    rows = spark.createDataFrame([(h, b) for h in hrefs for b in bases], "h string, b string")
    both = rows.select("h", "b", absolute_url("h", "b").alias("x"), resolved_url("h", canonical_url("b")).alias("y")).collect()
    assert len(both) == 40 and all(r.x == r.y for r in both)


def test_unread_fields_of_items_are_not_parsed(spark):
    item = "<item><title>T</title><link>/a</link><guid>g</guid><description>d</description><pubDate>2024-01-01</pubDate></item>"
    rows = [(1, 1, "https://e.org/f", "rss", f"<rss><channel>{item}{item}<item><title>no link</title></item></channel></rss>")]
    payloads = spark.createDataFrame(rows, "payload_id long, source_id long, final_url string, source_type string, body string")
    few = feeds.parsed(payloads, fields=("url", "title"))
    assert few.schema["items"].dataType.elementType.names == ["url", "title"]
    assert [tuple(i) for i in few.first()["items"]] == [tuple(i)[:2] for i in feeds.parsed(payloads).first()["items"]] == [("https://e.org/a", "T")]
    assert feeds.parse_outcomes(payloads).first()["parsed_count"] == 1
