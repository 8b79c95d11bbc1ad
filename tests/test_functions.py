"""Golden cases for the URL, text, date and image expressions."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedweir.functions import images, text, urls


def test_canonical_url(one):
    cases = {
        "HTTPS://GitHub.blog:443/?utm_source=test&gclid=123&x=1#top": "https://github.blog/?x=1",
        "github.blog/path/?page=2&sort=desc&utm_medium=email": "https://github.blog/path?page=2&sort=desc",
        "http://user:pw@Example.COM.:80//a//b/": "http://example.com/a/b",
        "http://example.com:8080": "http://example.com:8080/",
        "https://e.org/?b=2&a=1&b=3": "https://e.org/?a=1&b=3",
        "https://e.org/?q=a+b%2Bc&7=x": "https://e.org/?q=a%20b%2Bc",
        "https://e.org/?flag": "https://e.org/?flag=",
        "": "",
        "https://é.org/ü": "https://é.org/ü",
        "https://e.org:bad/x": "https://e.org:bad/x",
    }
    assert one(urls.canonical_url, list(cases)) == list(cases.values())


def test_valid_http_urls(one):
    values = ["https://github.blog/", "http://example.com/news", "ftp://example.com/file", "not-a-url",
              "http://a_b.com/", "https://e.org/é", "https://"]
    assert one(urls.is_http_url, values) == [True, True, False, False, False, False, False]


def test_absolute_url(spark):
    cases = [
        ("", "https://e.org/a/b", "https://e.org/a/b"),
        ("https://x.org/z/", "https://e.org/a", "https://x.org/z"),
        ("//cdn.org/i.png", "http://e.org/a", "http://cdn.org/i.png"),
        ("/images/demo.jpg", "https://example.com/feed.xml", "https://example.com/images/demo.jpg"),
        ("next", "https://e.org/a/b", "https://e.org/a/next"),
        ("../up", "https://e.org/a/b/c", "https://e.org/a/up"),
        ("../../../up", "https://e.org/a", "https://e.org/up"),
        ("c/./d", "https://e.org:8443/a/b?q=1", "https://e.org:8443/a/c/d"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, h string, b string, want string")
    got = rows.orderBy("i").select(urls.absolute_url("h", "b")).collect()
    assert [r[0] for r in got] == [c[2] for c in cases]


@settings(max_examples=5, deadline=None, phases=[Phase.generate],
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcXYZ019:/?#&=.%+-_~@é", min_size=1, max_size=40), min_size=20, max_size=20))
def test_canonical_url_is_a_fixed_point(one, values):
    first = one(urls.canonical_url, ["https://e.org/" + v for v in values])
    assert one(urls.canonical_url, first) == first


def test_clean_text(one):
    cases = {
        "<h1>Hello &amp; <em>world</em></h1>": "Hello & world",
        "<p>Line <strong>one</strong>.</p> <p>Line two.</p>": "Line one. Line two.",
        "a < b and c &gt; d": "a < b and c > d",
        "&#233;&#xE9;&eacute;&nbsp;&bogus; &copy 5": "ééé &bogus; &copy 5",
        '<a title="x>y">z</a>': "z",
        "x<!-- c -->y": "xy",
        "0": "",
        "&#x1F600;": "😀",
        "&bsol;&mdash;&CounterClockwiseContourIntegral;&Tab;x": "\\—∳ x",
    }
    assert one(text.clean_text, list(cases)) == list(cases.values())


def test_titles_and_summaries(one):
    assert one(text.title_or_default, [None, " ", "0", "x" * 300]) == [
        "Untitled article", "Untitled article", "Untitled article", "x" * 240 + "..."]
    assert one(text.nullable_summary, [None, "<p> </p>", "ok"]) == [None, None, "ok"]


def test_parse_date(one):
    def at(*a):
        return dt.datetime(*a)

    cases = {
        "Sat, 14 Mar 2026 10:00:00 GMT": at(2026, 3, 14, 10),
        "14 Mar 2026 10:00:00 +0200": at(2026, 3, 14, 8),
        "2026-03-14T10:00:00+00:00": at(2026, 3, 14, 10),
        "2026-03-14T10:00:00.5Z": at(2026, 3, 14, 10, 0, 0, 500000),
        "2026-03-14 10:00:00": at(2026, 3, 14, 10),
        "2026-03-14": at(2026, 3, 14),
        "Sat, 14 Mar 2026 10:00 EST": at(2026, 3, 14, 15),
        "yesterday": None,
        "2026-13-40": None,
        "": None,
    }
    assert one(text.parse_date, list(cases)) == list(cases.values())
    assert one(lambda v: text.iso_date(text.parse_date(v)), ["2026-03-14T10:00:00Z"]) == ["2026-03-14T10:00:00+00:00"]


def test_repair_utf8(spark):
    rows = spark.createDataFrame([(b"Valid prefix \xd1 invalid byte",), ("é".encode() * 5,)], "b binary")
    got = [r[0] for r in rows.select(text.repair_utf8("b", 13)).collect()]
    assert got == ["Valid prefix ", "ééééé"]
    assert [r[0] for r in rows.select(text.repair_utf8("b", 3)).collect()] == ["Val", "é"]
    assert rows.select(text.repair_utf8("b")).first()[0] == "Valid prefix  invalid byte"


def test_long_error_is_cut(one):
    assert len(one(lambda v: text.repair_utf8(v, 4000), ["nested sql error " * 800])[0].encode()) <= 4000


def test_json_object(one):
    cases = {
        '```json\n{"a": 1}\n```': '{"a": 1}',
        'Sure: {"a": {"b": 2}} done': '{"a": {"b": 2}}',
        "no json": None,
        "{broken": None,
    }
    assert one(text.extract_json_object, list(cases)) == list(cases.values())


def test_slug(one):
    assert one(text.slug, ["Héllo, Wörld_of @ Spark!", "---", "日本"]) == ["hello-world-of-at-spark", "", ""]
    got = one(lambda v: text.article_slug(v, F.lit("uk"), F.lit("7-uk")), ["", "Big News"])
    assert got[0].startswith("article-uk-") and got[1].startswith("big-news-uk-") and len(got[1]) == 20


def test_titles_and_hrefs(one):
    assert one(text.likely_title, ["Read more now please", "A proper article title", "short"]) == [False, True, False]
    assert one(text.likely_summary, ["Short", "This summary is long enough to be kept."]) == [False, True]


@pytest.mark.parametrize(
    "url,ok",
    [
        ("https://cdn.example.com/images/demo.jpg", True),
        ("https://cdn.example.com/images/avatar-author.png", False),
        ("https://e.org/cdn-cgi/image/fit=crop,width=64/x.png", False),
        ("https://e.org/x.png?w=48", False),
        ("https://e.org/x.png?w=480", True),
        ("https://e.org/is/content/abc", False),
        ("https://e.org/is/content/abc.png", True),
        ("https://e.org/photos/12345", False),
        ("https://e.org", False),
        ("https://secure.gravatar.com/x.png", False),
    ],
)
def test_acceptable_image(one, url, ok):
    assert one(images.acceptable_image, [url]) == [ok]


def test_image_penalty(spark):
    rows = spark.createDataFrame(
        [("https://e.org/img/logo.png", "https://e.org/"), ("https://e.org/a.png?w=100", "https://e.org/"),
         ("https://github.blog/img/logo.png", "https://github.blog/"), ("https://e.org/author/x.png", "https://e.org/")],
        "u string, b string")
    got = [r[0] for r in rows.select(images.image_penalty(F.col("u"), F.col("b"))).collect()]
    assert got == [45, 40, 0, 120]
