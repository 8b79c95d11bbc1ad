"""Page metadata, links and bodies from node arrays (see :mod:`feedweir.sources.html`); no operator here shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import blank_to_null, contains_any, let, let_sql
from feedweir.functions.images import acceptable_image, image_penalty
from feedweir.functions.text import clean_text, truncate_text
from feedweir.functions.urls import absolute_url, is_http_url, trim_ascii, url_host, url_origin
from feedweir.sources.html import VOID

WS = r"[ \t\n\r\x0B\x0C]"


def text_of(x: str) -> str:
    """SQL: text content of node ``x`` (only texts have one). Nodes are read by place: ``slice`` unpacks the whole array at every call."""
    return f"array_join(transform(sequence({x}.id - 1, {x}.end - 1), i -> nodes[i].text), '')"


def below(x: str) -> str:
    """SQL: the nodes inside node ``x``, read by place."""
    return f"CASE WHEN {x}.end > {x}.id THEN transform(sequence({x}.id, {x}.end - 1), i -> nodes[i]) ELSE array() END"


def inside(x: str, tag: str) -> str:
    return f"contains(concat({x}.path, '/'), '/{tag}/')"


def page_nodes(shredded: DataFrame) -> DataFrame:
    """Node rows: one per element or text."""
    return shredded.select("page_id", F.inline("nodes")).withColumnsRenamed({"id": "node_id", "parent": "parent_id", "end": "end_id"})


def link_candidates(shredded: DataFrame, limit: int = S.LINK_CANDIDATES_MAX) -> DataFrame:
    """First anchors of a page that have both a target and a text."""
    anchors = f"""slice(filter(transform(filter(nodes, n -> n.tag = 'a' AND n.attrs['href'] IS NOT NULL),
        a -> named_struct('href', trim(a.attrs['href']), 'title', regexp_replace({text_of('a')}, r'^\\s+|\\s+$', ''))),
        l -> l.href <> '' AND l.title <> ''), 1, {limit})"""
    rows = shredded.select("page_id", "url", F.posexplode_outer(F.expr(anchors)).alias("pos", "l")).where("pos IS NOT NULL")
    return rows.select("page_id", "pos", absolute_url("l.href", "url").alias("url"), F.col("l.title").alias("title"))


def feed_autodiscovery(shredded: DataFrame) -> DataFrame:
    """``<link rel=alternate>`` entries that announce a feed."""
    return announced_feeds(shredded).drop("pos")


def announced_feeds(shredded: DataFrame) -> DataFrame:
    """:func:`feed_autodiscovery` with the place ``pos`` of each entry in its page."""
    links = """filter(nodes, n -> n.tag = 'link' AND contains(lower(n.attrs['rel']), 'alternate') AND trim(n.attrs['href']) <> '')"""
    rows = shredded.select("page_id", F.col("url").alias("base"), F.posexplode_outer(F.expr(links)).alias("pos", "l")).where("l IS NOT NULL")
    kind = F.lit(None).cast("string")
    for mime, name in S.AUTODISCOVERY_TYPES.items():
        kind = F.when(F.lower(F.col("l.attrs")["type"]) == mime, F.lit(name)).otherwise(kind)
    return rows.withColumn("type", kind).where("type IS NOT NULL").select(
        "page_id",
        "pos",
        absolute_url(F.col("l.attrs")["href"], F.col("base")).alias("url"),
        "type",
        blank_to_null(F.trim(F.col("l.attrs")["title"])).alias("title"),
        F.lit(0.87).alias("confidence"),
    )


def feed_action_links(shredded: DataFrame, payload_types: DataFrame) -> DataFrame:
    """Anchors labelled as a feed whose target is a known feed payload (url, type, confidence)."""
    label = f"""concat_ws(' ', {text_of('a')}, a.attrs['aria-label'], a.attrs['title'], a.attrs['data-bi-cn'], a.attrs['data-bi-ecn'])"""
    aimed = " OR ".join(f"contains(h, '{s}')" for s in S.FEED_HREF_SIGNALS)
    aimed = let_sql("lower(trim(n.attrs['href']))", "h", f"h <> '' AND ({aimed})")
    anchors = f"""transform(filter(nodes, n -> n.tag = 'a' AND {aimed}),
        a -> named_struct('id', a.id, 'href', trim(a.attrs['href']), 'label', lower({label})))"""
    rows = shredded.select("page_id", F.col("url").alias("base"), F.explode_outer(F.expr(anchors)).alias("l")).where("l IS NOT NULL")
    hits = rows.where(contains_any(F.col("l.label"), S.FEED_LABEL_SIGNALS)).select("page_id", "l.id", absolute_url("l.href", "base").alias("url"))
    feeds = payload_types.where(F.col("type").isin(S.FEED_TYPES)).select("url", "type", F.greatest(F.lit(0.84), "confidence").alias("confidence"))
    once = hits.groupBy("page_id", "url").agg(F.min("id").alias("pos"))
    return once.join(feeds, "url").select("page_id", "pos", "url", "type", "confidence")


# --- titles ------------------------------------------------------------------------------------------
def _attr(node: Column, name: str) -> Column:
    return F.trim(node["attrs"][name])


def _meta(attribute: str, name: str) -> str:
    return f"try_element_at(filter(nodes, n -> n.tag = 'meta' AND n.attrs['{attribute}'] = '{name}' AND n.attrs['content'] IS NOT NULL), 1).attrs['content']"


def host_label(url: Column) -> Column:
    """www.my-site.org → my site"""
    return F.translate(F.substring_index(F.regexp_replace(F.coalesce(url_host(url), F.lit("")), r"^www\.", ""), ".", 1), "-_", "  ")


def strip_title_suffix(title: Column, url: Column) -> Column:
    """Drop a trailing site name set off by a dash, bar or colon."""
    host = F.coalesce(url_host(url), F.lit(""))
    labels = [host, F.regexp_replace(host, r"^www\.", ""), host_label(url), *[F.lit(x) for x in S.TITLE_SUFFIX_LABELS]]
    out = title
    for label in labels:
        out = let(
            F.struct(out.alias("t"), label.alias("l")),
            lambda p: F.when(
                (p["l"] != "") & F.endswith(F.lower(p["t"]), F.lower(p["l"])),
                let(
                    F.regexp_extract(
                        F.left(p["t"], F.length(p["t"]) - F.length(p["l"])), r"(?s)^(.*?)\s*[-|:\x{2013}\x{2014}]\s*$", 1
                    ),
                    lambda cut: F.when(cut != "", cut).otherwise(p["t"]),
                ),
            ).otherwise(p["t"]),
        )
    return F.trim(out)


def generic_title(title: Column, url: Column) -> Column:
    lower = F.lower(title)
    hit = (lower == F.coalesce(url_host(url), F.lit(""))) | (lower == host_label(url))
    for word in S.GENERIC_TITLES:
        hit = hit | (lower == word) | F.contains(lower, F.lit(word + " |"))
    return hit


def usable_title(raw: Column, url: Column) -> Column:
    """Cleaned page title, null when too short or generic."""
    return let(
        strip_title_suffix(clean_text(raw), url),
        lambda t: F.when((F.length(t) >= S.PAGE_TITLE_MIN) & ~generic_title(t, url), truncate_text(t, S.TITLE_LIMIT)),
    )


def page_title(url: Column) -> Column:
    title_text = f"trim(try_element_at(filter(nodes, n -> n.tag = '#text' AND n.path RLIKE '/title$'), 1).text)"
    raws = [_meta("property", "og:title"), _meta("name", "og:title"), _meta("name", "twitter:title"), title_text]
    return F.coalesce(*[usable_title(F.expr(r), url) for r in raws])


# --- descriptions ------------------------------------------------------------------------------------
def usable_description(raw: Column) -> Column:
    return let(
        clean_text(raw),
        lambda t: F.when(
            (F.length(t) >= S.PAGE_DESCRIPTION_MIN) & ~contains_any(F.lower(t), S.GENERIC_DESCRIPTIONS), truncate_text(t, S.SUMMARY_LIMIT)
        ),
    )


def _long_paragraph(scope: str) -> str:
    """First paragraph in scope whose white-space-normalised text is long enough; the text is kept as it is."""
    paragraphs = f"transform(filter(nodes, n -> n.tag = 'p'{scope}), p -> {text_of('p')})"
    normal = rf"regexp_replace(regexp_replace(t, r'{WS}+', ' '), r'^ | $', '')"
    return f"try_element_at(filter({paragraphs}, t -> length({normal}) > {S.PAGE_PARAGRAPH_MIN}), 1)"


def page_description() -> Column:
    metas = [_meta("property", "og:description"), _meta("name", "description"), _meta("name", "twitter:description")]
    scopes = [f" AND {inside('n', 'article')}", f" AND {inside('n', 'main')}", ""]
    return F.coalesce(*[usable_description(F.expr(x)) for x in metas + [_long_paragraph(s) for s in scopes]])


# --- images ------------------------------------------------------------------------------------------
def _first_attr(condition: str, attribute: str) -> str:
    return f"try_element_at(filter(nodes, n -> {condition} AND n.attrs['{attribute}'] IS NOT NULL), 1).attrs['{attribute}']"


def _image_sources() -> list[tuple[str, int]]:
    """Where lead images are looked for, with the points each place is worth (fixed values)."""
    def scoped(tag: str, points: tuple[int, ...]) -> list[tuple[str, int]]:
        near = inside("n", tag)
        rows = [
            (f"substring_index(trim(substring_index(rtrim(', ', {_first_attr(f'{chr(110)}.tag IN ({chr(39)}img{chr(39)}, {chr(39)}source{chr(39)}) AND {near}', 'srcset')}), ',', -1)), ' ', 1)", points[0]),
            (_first_attr(f"n.tag = 'img' AND {near}", "data-src"), points[1]),
            (_first_attr(f"n.tag = 'img' AND {near}", "data-lazy-src"), points[2]),
            (_first_attr(f"n.tag = 'img' AND {near}", "src"), points[3]),
        ]
        if tag == "article":
            rows.insert(1, (_first_attr(f"n.tag = 'img' AND {near} AND contains(n.attrs['class'], 'wp-post-image')", "src"), 79))
        return rows

    return [
        (_meta("property", "og:image"), 100),
        (_meta("property", "og:image:url"), 95),
        (_meta("property", "OG:IMAGE"), 95),
        (_meta("name", "og:image"), 92),
        (_meta("name", "twitter:image"), 88),
        (_meta("name", "twitter:image:src"), 88),
        (_first_attr("n.tag = 'link' AND contains(n.attrs['rel'], 'image_src')", "href"), 84),
        (_meta("itemprop", "image"), 82),
        *scoped("article", (80, 76, 76, 74)),
        *scoped("main", (72, 70, 70, 68)),
    ]


#: The few nodes of a page that may name an image are picked once for all places.
_IMAGE_TAGS = "('meta', 'link', 'img', 'source')"
_IMAGE_PLACES = "array({})".format(
    ", ".join(f"named_struct('place', {i}, 'points', {points}, 'v', trim({sql}))" for i, (sql, points) in enumerate(_image_sources()))
)


def best_image(url: Column) -> Column:
    """struct(score, image_url) of the best acceptable candidate; the earlier place wins a tie."""
    rows = F.expr(let_sql(f"filter(nodes, n -> n.tag IN {_IMAGE_TAGS})", "nodes", _IMAGE_PLACES))
    named = F.filter(
        rows, lambda c: c["v"].isNotNull() & (c["v"] != "") & ~F.startswith(F.lower(c["v"]), F.lit("data:")) & ~c["v"].rlike(r"^\d+$")
    )
    resolved = F.transform(named, lambda c: F.struct(c["place"].alias("place"), c["points"].alias("points"), absolute_url(c["v"], url).alias("u")))
    kept = F.filter(resolved, lambda c: is_http_url(c["u"]) & acceptable_image(c["u"]))
    scored = F.transform(
        kept, lambda c: F.struct((c["points"] - image_penalty(c["u"], url)).alias("score"), (-c["place"]).alias("early"), c["u"].alias("image_url"))
    )
    return F.array_max(scored)


def page_titles(shredded: DataFrame) -> DataFrame:
    return shredded.select("page_id", page_title(F.col("url")).alias("title"))


def page_descriptions(shredded: DataFrame) -> DataFrame:
    return shredded.select("page_id", page_description().alias("description"))


def page_images(shredded: DataFrame) -> DataFrame:
    return shredded.select("page_id", best_image(F.col("url")).alias("b")).select("page_id", "b.image_url", "b.score")


def page_metadata(shredded: DataFrame) -> DataFrame:
    """Title, image and description in one pass over the node array."""
    u = F.col("url")
    return shredded.select(
        "page_id", "url", page_title(u).alias("title"), best_image(u)["image_url"].alias("image_url"), page_description().alias("description")
    )


# --- bodies ------------------------------------------------------------------------------------------
def _noise() -> str:
    classes = " OR ".join(f"contains(n.attrs['class'], '{c}')" for c in S.NOISE_CLASSES)
    ids = " OR ".join(f"contains(n.attrs['id'], '{c}')" for c in S.NOISE_IDS)
    tags = ", ".join(f"'{t}'" for t in [*S.NOISE_TAGS, "script", "style", "noscript"])
    roles = ", ".join(f"'{r}'" for r in S.NOISE_ROLES)
    return f"n.tag IN ({tags}) OR coalesce({classes}, false) OR coalesce({ids}, false) OR coalesce(n.attrs['role'] IN ({roles}), false)"


def _selectors() -> list[str]:
    return [
        *[f"coalesce(contains(n.attrs['class'], '{c}'), false)" for c in S.BODY_CLASSES],
        *[f"coalesce(contains(n.attrs['data-hook'], '{h}'), false)" for h in S.BODY_HOOKS],
        f"n.tag = 'div' AND coalesce(contains(n.attrs['class'], 'content'), false) AND {inside('n', 'article')}",
        "n.tag = 'article'",
        "n.tag = 'main'",
        "coalesce(n.attrs['role'] = 'main', false)",
    ]


def _kept_texts() -> str:
    """SQL: the text of every node, empty where the node is no text or lies in a noise subtree; linear in the nodes.

    Outermost noise nodes are those in no other noise subtree; between and inside them runs of flags are laid down.
    """
    inner = "flatten(transform(noise, c -> CASE WHEN c.z > c.a THEN sequence(c.a + 1, c.z) ELSE array() END))"
    outer = f"transform(array_except(transform(noise, c -> c.a), {inner}), i -> named_struct('a', i, 'z', nodes[i - 1].end))"
    runs = """flatten(transform(outer, (c, k) -> concat(
        array_repeat(true, c.a - 1 - if(k = 0, 0, outer[k - 1].z)), array_repeat(false, c.z - c.a + 1))))"""
    rest = "array_repeat(true, size(nodes) - if(size(outer) = 0, 0, outer[size(outer) - 1].z))"
    flags = f"concat({runs}, {rest})"
    texts = f"zip_with(nodes, {flags}, (n, kept) -> if(kept AND n.tag = '#text', n.text, ''))"
    return f"transform(array({outer}), outer -> named_struct('kept', {flags}, 'texts', {texts}))[0]"


def _markup() -> str:
    """SQL: HTML of the subtree of node ``b.id`` without its noise: start tags and texts in order, end tags after the last descendant."""
    void = ", ".join(f"'{t}'" for t in sorted(VOID))
    attributes = """array_join(transform(map_entries(n.attrs), e -> concat(' ', e.key, '="', replace(replace(e.value, '&', '&amp;'), '"', '&quot;'), '"')), '')"""
    text = "replace(replace(replace(n.text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    inside_ = "filter(slice(nodes, b.id, nodes[b.id - 1].end - b.id + 1), (n, i) -> kept[b.id - 1 + i])"
    starts = f"transform({inside_}, n -> named_struct('at', n.id, 'side', 0, 'turn', 0, 'text', if(n.tag = '#text', {text}, concat('<', n.tag, {attributes}, '>'))))"
    closed = f"filter({inside_}, n -> n.tag <> '#text' AND n.tag NOT IN ({void}))"
    ends = f"transform({closed}, n -> named_struct('at', n.end, 'side', 1, 'turn', -n.id, 'text', concat('</', n.tag, '>')))"
    return f"array_join(transform(array_sort(concat({starts}, {ends})), e -> e.text), '')"


def article_bodies(shredded: DataFrame) -> DataFrame:
    """Main content as text and as markup: noise subtrees out, then the longest node of the first selector with enough text.

    ``selector_rank`` is the selector's number, or one past the last when the whole body was taken.
    """
    noise = f"transform(filter(nodes, n -> {_noise()}), n -> named_struct('a', n.id, 'z', n.end))"
    clean = shredded.select("page_id", "nodes", F.expr(noise).alias("noise"))
    clean = clean.select("page_id", "nodes", F.expr(_kept_texts()).alias("k")).select("page_id", "nodes", "k.kept", "k.texts")
    inner = "array_join(slice(texts, n.id, n.end - n.id + 1), '')"
    ranked = []
    for i, selector in enumerate([*_selectors(), "n.tag = 'body'"]):
        limit = S.BODY_MIN_BYTES if i < len(_selectors()) else -1
        found = f"filter(nodes, n -> kept[n.id - 1] AND ({selector}))"
        ranked.append(f"transform({found}, n -> named_struct('rank', {i + 1}, 'id', n.id, 'text', trim({inner}), 'floor', {limit}))")
    enough = f"filter(concat({', '.join(ranked)}), c -> octet_length(c.text) > c.floor)"
    best = "array_min(transform(found, c -> named_struct('rank', c.rank, 'short', -octet_length(c.text), 'id', c.id, 'text', c.text)))"
    chosen = clean.select("*", F.expr(enough).alias("found")).select("page_id", "nodes", "kept", F.expr(best).alias("b"))
    return chosen.select(
        "page_id", F.col("b.rank").alias("selector_rank"), F.col("b.text").alias("body_text"),
        F.expr(f"CASE WHEN b IS NOT NULL THEN {_markup()} END").alias("body_html"),
    )


# fixed values: clean-up patterns for extracted markup
BODY_PATTERNS = [
    (r"(?is)<(div|span|section)[^>]*>\s*</\1>", ""),
    (r"""(?i)\s+data-[\w-]+="[^"]*\"""", ""),
    (r"""(?i)\s+data-[\w-]+='[^']*'""", ""),
    (r"""(?i)\s+(?:style|class)="[^"]*\"""", ""),
    (r"""(?i)\s+(?:style|class)='[^']*'""", ""),
    (r"(?i)</?(?:wow-image|wix-[a-z-]+)[^>]*>", ""),
    (r"\n{3,}", "\n\n"),
]


def clean_body_html(html: Column) -> Column:
    out = html
    for pattern, replacement in BODY_PATTERNS:
        out = F.regexp_replace(out, pattern, replacement)
    return trim_ascii(out)


def absolutize_body_urls(html: Column, base: Column) -> Column:
    """Prefix relative href, src, poster and data-src values with the page's origin (and folder)."""
    origin = url_origin(base)
    folder = F.regexp_replace(F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/[^/]*/?$", "")
    lead = r"""(?i)((?:href|src|poster|data-src)\s*=\s*["'])"""
    rooted = F.regexp_replace(html, F.lit(lead + r"""(/(?!/)[^"':\s]?[^"']*?)(["'])"""), F.concat(F.lit("$1"), origin, F.lit("$2$3")))
    relative = lead + r"""((?![/#])(?!data:)(?!mailto:)(?!https?://)[^"':\s/][^"']*?)(["'])"""
    return F.regexp_replace(rooted, F.lit(relative), F.concat(F.lit("$1"), origin, folder, F.lit("/$2$3")))


def raw_title(html: Column, url: Column) -> Column:
    """Title by pattern: og:title, first h1, title element, else the host."""
    og = decoded_markup(F.regexp_extract(html, r"""(?i)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']+)["']""", 1))
    h1 = clean_markup(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1))
    title = clean_markup(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.coalesce(blank_to_null(og), blank_to_null(h1), blank_to_null(title), url_host(url), F.lit("Untitled"))


def clean_markup(x: Column) -> Column:
    from feedweir.functions.text import strip_tags

    return trim_ascii(strip_tags(x))


def decoded_markup(x: Column) -> Column:
    from feedweir.functions.text import decode_entities, strip_tags

    return trim_ascii(decode_entities(strip_tags(x)))


def raw_image(html: Column, url: Column) -> Column:
    og = F.regexp_extract(html, r"""(?i)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']""", 1)
    img = F.regexp_extract(html, r"""(?i)<img[^>]+src=["']([^"']+)["']""", 1)
    found = F.coalesce(blank_to_null(og), blank_to_null(img))
    return F.when(F.startswith(found, F.lit("/")), F.concat(url_origin(url), found)).otherwise(found)


def raw_html_title_image(pages: DataFrame) -> DataFrame:
    h, u = F.col("html"), F.col("url")
    return pages.select("page_id", raw_title(h, u).alias("title"), raw_image(h, u).alias("image_url"))
