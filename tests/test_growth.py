"""Work per page: in proportion to its size."""

import random
import re

import pytest

from feedweir.operators import articles, listings, pages
from feedweir.plans import bound
from feedweir.sources.html import _PLAIN, _Shredder, shred_page, shred_pages

PARTS = """<p>|</p>|<br/>|<br>|<a href="x&amp;y">|<a HREF="q" href="r">|</a>|text|a &amp; b|&lt|&|<|< |<!-- c -->|<!-- |<script>|</script>|if (a<b)|<title>
|</title>|<li>|<ul>|</ul>|<div class="a b">|</div>|<i id='x'>|<img src=a/>|<img src="a"/>|<td>|</ p>|</p >|"|<a b="1"c="2">|\x00|<![CDATA[x]]>|<?pi?>|&#x41;
|</|<a|<a href="|&amp|<textarea>|<P CLASS="Q">|</DIV>|<a b="">|<a b>|<!doctype html>""".replace("\n", "").split("|")


def full(html):
    parser = _Shredder()
    parser.feed(html)
    parser.close()
    parser._close_to(0)
    return parser.rows


def test_plain_markup_is_read_as_the_full_parser_reads_it():
    draw = random.Random(5)
    for _ in range(5000):
        html = "".join(draw.choice(PARTS) for _ in range(draw.randint(0, 12)))
        assert shred_page(html) == full(html), html


def test_a_listing_needs_no_full_parser():
    html = '<main><article class="item"><h2><a href="/a">A &amp; b</a></h2><img src="/i.png"></article></main>'
    assert _Shredder().read_plain(html) == len(html) and _PLAIN.match("<script>")


@pytest.mark.parametrize("sql", [listings.CARDS, listings.EXTRACT, pages.text_of("n")])
def test_no_subtree_is_cut_out_of_the_whole_array(sql):
    """``slice`` unpacks all nodes of a page for every element of it."""
    assert "slice(nodes" not in sql and not re.search(r"filter\(nodes.*filter\(nodes", sql, re.S)


def test_previews_of_one_split_are_worked_on_by_many_tasks(spark):
    """An item's address is made canonical once, not wherever its result is used."""
    preview = """[{"title": "a", "url": "HTTP://E.org//x/?utm_source=a"}, {"title": "", "url": "", "image": " i "}, {"url": " not a url "}, {"title": null}]"""
    rows = spark.createDataFrame([(i, preview if i else None) for i in range(200)], "id long, preview_items string").coalesce(1)
    clean = articles.sanitize_preview(rows)
    assert {r[0] for r in clean.selectExpr("spark_partition_id()").distinct().collect()} == set(range(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    got = clean.where("generation_id = 7").orderBy("pos").select("title", "url", "image_url").collect()
    assert [tuple(r) for r in got[:2]] == [("a", "http://e.org/x", None), ("Untitled", "#", "i")] and got[3].url == "#"
    assert clean.count() == 199 * 4
    assert clean._jdf.queryExecution().optimizedPlan().toString().count("utm_") == 1


def test_places_of_images_search_the_few_nodes_that_may_name_one(spark):
    html = '<article><p>text</p><img data-src="/lazy.png"></article><main><img src="/a/late.png"></main><meta name="twitter:image" content="/card.png">'
    found = pages.page_images(pages_of(spark, html))
    assert len(re.findall(r"filter\(nodes#\d+", found._jdf.queryExecution().analyzed().toString())) == 1
    assert found.first()["image_url"] == "https://e.org/card.png"
    assert pages.page_images(pages_of(spark, html.split("<meta")[0])).first()["image_url"] == "https://e.org/lazy.png"


def pages_of(spark, html):
    return shred_pages(spark.createDataFrame([(1, "https://e.org/x", html)], "page_id long, url string, html string"))


def test_patterns_are_detected_once(spark, sf_dir):
    """The rule's check reads them twice."""
    plan = bound("pattern_validation")(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
