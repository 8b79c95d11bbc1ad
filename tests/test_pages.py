"""Golden cases for page metadata, listings and bodies."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from feedweir.operators import pages as P
from feedweir.sources.html import shred_page, shred_pages

LONG = "The kiln was fired for three days before the first of the blue tiles came out whole, and the glaze held through the frost of that year."
DEEP = f"""<html><head><meta property="og:title" content="Tiles from the blue kiln - Example.com">
<meta property="og:description" content="Learn more about Example.com and all it makes."><meta property="og:image" content="https://img.example.com/tiles/blue.jpg">
</head><body><main><article><p>{LONG}</p></article></main></body></html>"""
GENERIC = """<html><head><meta property="og:title" content="Azure updates | Microsoft Azure">
<meta property="og:description" content="Learn more about Example.com and all it makes."></head><body><main><p>Too short.</p></main></body></html>"""


def frame(spark, *pages):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")


def test_tree_shape():
    rows = shred_page("<div><p>a<b>x<p>b</div><ul><li>1<li>2</ul><br>t")
    tags = [(r[4], r[7]) for r in rows if r[4] != "#text"]
    assert tags == [("div", ""), ("p", "/div"), ("b", "/div/p"), ("p", "/div"), ("ul", ""), ("li", "/ul"), ("li", "/ul"), ("br", "")]
    by = {r[0]: r for r in rows}
    assert all(by[r[1]][0] < r[0] <= by[r[1]][2] for r in rows if r[1])


def test_page_metadata(spark):
    pages = frame(spark, ("https://example.com/posts/demo", DEEP), ("https://azure.example.com/updates?id=1", GENERIC))
    got = {r.page_id: r for r in P.page_metadata(shred_pages(pages)).collect()}
    assert got[0].title == "Tiles from the blue kiln"
    assert got[0].description == LONG
    assert got[0].image_url == "https://img.example.com/tiles/blue.jpg"
    assert (got[1].title, got[1].description, got[1].image_url) == (None, None, None)


def test_image_choice(spark):
    html = """<head><meta property="og:image" content="/static/logo.png"></head><body><article>
    <img srcset="/a-300.jpg 300w, /a-900.jpg 900w" src="/a.jpg"><img data-src="/avatar.png"></article></body>"""
    got = P.page_images(shred_pages(frame(spark, ("https://e.org/x", html)))).first()
    assert (got.image_url, got.score) == ("https://e.org/a-900.jpg", 80)


def test_autodiscovery_and_action_links(spark):
    html = """<head><link rel="alternate" type="application/rss+xml" title="Feed" href="/changelog/feed/">
    <link rel="ALTERNATE" type="text/html" href="/de"></head><body>
    <a href="https://www.example.com/api/rss" aria-label="Subscribe via RSS">Subscribe via RSS</a><a href="/rss">News</a></body>"""
    s = shred_pages(frame(spark, ("https://e.org/changelog", html)))
    got = [tuple(r) for r in P.feed_autodiscovery(s).collect()]
    assert got == [(0, "https://e.org/changelog/feed", "rss", "Feed", 0.87)]
    types = spark.createDataFrame([("https://www.example.com/api/rss", "rss", 0.99)], "url string, type string, confidence double")
    assert [tuple(r)[2:] for r in P.feed_action_links(s, types).collect()] == [("https://www.example.com/api/rss", "rss", 0.99)]


def test_article_bodies(spark):
    text = "word " * 60
    html = f"""<body><nav>{text}{text}</nav><article><div class="post-content"><p>{text}</p><div class="share">{text}</div></div>
    </article></body>"""
    short = "<body><article>tiny</article><p>rest</p></body>"
    got = {r.page_id: r for r in P.article_bodies(shred_pages(frame(spark, ("https://e.org", html), ("https://e.org", short)))).collect()}
    assert got[0].selector_rank == 1 and got[0].body_text == text.strip()
    assert got[1].selector_rank == 15 and got[1].body_text == "tinyrest"


def test_body_markup(spark):
    html = """<div class="x" data-id="1"><span> </span><a href="/p?q=1">r</a><img src="i.png"><a href="#t">t</a><a href="https://o.org/">o</a>
<a href="mailto:a@b.org">m</a><img src="//c.org/i.png"></div>"""
    row = frame(spark, ("https://e.org/a/b", html)).select(
        P.clean_body_html(F.col("html")).alias("c"), P.absolutize_body_urls(F.col("html"), F.col("url")).alias("a")).first()
    assert row.c.startswith("<div><a href=") and "data-id" not in row.c
    for part in ('href="https://e.org/p?q=1"', 'src="https://e.org/a/i.png"', 'href="#t"', 'href="https://o.org/"',
                 'href="mailto:a@b.org"', 'src="//c.org/i.png"'):
        assert part in row.a, part


def test_body_is_text_and_markup_without_noise(spark):
    html = (
        "<html><body><nav>menu<div class='share'>x</div></nav><div class='outer'><div class='post-content'><h2>Head &amp; tail</h2>"
        "<p class='lead'>" + "long words " * 30 + "<br><img src='/a.png'></p><aside><p>aside</p></aside><p>end</p></div></div><footer>foot</footer></body></html>"
    )
    row = P.article_bodies(shred_pages(spark.createDataFrame([(1, "https://h.example/", html)], "page_id bigint, url string, html string"))).first()
    assert row.selector_rank == 1 and "aside" not in row.body_text and row.body_text.endswith("end")
    assert row.body_html.startswith('<div class="post-content"><h2>Head &amp; tail</h2><p class="lead">') and "<aside>" not in row.body_html
    assert row.body_html.endswith('<br><img src="/a.png"></p><p>end</p></div>')


def test_body_time_is_linear(spark):
    def seconds(n):
        cards = "".join(f"<div class='share'>s</div><article><p>card {i} text</p></article>" for i in range(n))
        df = spark.createDataFrame([(1, "https://h.example/", f"<html><body>{cards}</body></html>")], "page_id bigint, url string, html string")
        start = time.perf_counter()
        assert P.article_bodies(shred_pages(df)).count() == 1
        P.article_bodies(shred_pages(df)).collect()
        return time.perf_counter() - start

    seconds(50)
    assert seconds(4000) < 4 * seconds(1000) + 4


def test_page_sql_decodes_references_cut_before_the_semicolon(spark, tmp_path):
    from oracle_harness import compare

    import duckdb

    from feedweir.plans import bound, oracles

    text = "Bread &amp; butter &amp"
    html = f"""<!DOCTYPE html><html><head><title>{text}</title></head><body><article><h1>{text}</h1><p>{'Long lines of a story. ' * 12} &copy</p></article></body></html>"""
    style = "</title><style>p{margin:0}</style>"
    named = html.replace(text, "Bread and butter | my site", 1), html.replace(text, "Azure updates | of today", 1)
    pages = [("https://example.org/a", html), ("https://example.org/b", html.replace("&amp<", "&am<").replace("</title>", style))]
    pages += [("https://www.my-site.org/c", named[0]), ("https://my-site.org/d", named[1]), ("https://example.org/e", html.replace(text, "Trade -  Example.org", 1))]
    frame(spark, *pages).toPandas().to_parquet(tmp_path / "pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet'")
    for name in ("page_nodes", "page_titles", "article_bodies"):
        _, error = compare(duck, spark, str(tmp_path), bound(name), oracles()[name])
        assert error is None, error


def test_page_metadata_describes_the_crawled_pages(spark, tmp_path):
    """The query leaves no description of a crawled page out, and its SQL states them."""
    from oracle_harness import compare

    import duckdb

    from feedweir.plans import bound, oracles

    page = "<!DOCTYPE html><html><head><title>A title of this page</title></head><body><article><h1>A heading</h1>{}</article></body></html>"
    bodies = [
        f"<p>Short.</p><p>{LONG}</p><p>{'Later lines. ' * 20}</p>", f"<p><b>Open {'line and &amp;copy; line, ' * 30}<br><p>{LONG}</p>",
        f"<p>Learn more about {LONG}</p><p>{LONG}</p>", "<p>" + "x " * 40 + " \n </p><p>Too short.</p>", "", f"<p>{LONG}",
    ]
    frame(spark, *[(f"https://example.org/{i}", page.format(b)) for i, b in enumerate(bodies)]).toPandas().to_parquet(tmp_path / "pages.parquet")
    docs = [(3, "The first line of a text of the list.\nThe second line of it.", "en", "src0"), (4, "One line of another text, and more.", "en", "src1")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").toPandas().to_parquet(tmp_path / "documents.parquet")
    got = {r.page_id: r.description for r in bound("page_metadata")(spark, str(tmp_path)).where("kind = 'page'").collect()}
    assert [got[i] for i in (0, 2, 3, 4, 5)] == [LONG, None, None, None, LONG]
    assert got[1].startswith("Open line and © line,") and got[1].endswith("...") and len(got[1]) <= 423
    duck = duckdb.connect()
    for table in ("pages", "documents"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    _, error = compare(duck, spark, str(tmp_path), bound("page_metadata"), oracles()["page_metadata"])
    assert error is None, error
