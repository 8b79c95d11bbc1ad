"""Text cleaning as column expressions (entities, tags, limits, dates, UTF-8, JSON, slugs)."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import apply, blank_to_null, col, contains_any, let, let_sql
from feedweir.functions.urls import trim_ascii, trim_sql

SPACES = r"[\s\x{85}\p{Z}]+"
#: No ASCII letter, digit or sign and in a range that holds white space or control characters.
ODD = r"[^ -~\x{A1}-\x{167F}\x{3001}-\x{10FFFF}]"
COMMENT = r"(?s)<!--.*?(?:-->|$)"
TAG = r"""<[^\s>"'][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>|<>"""
LOOSE_TAG = r"<[^\s>][^>]*(?:>|$)"


def _entity_table() -> str:
    """The HTML5 names as one text, ``|name=characters|…``.

    A single string ships with a task at no cost, where a map of 2 000 entries is thousands of objects per expression.
    """
    rows = (f"\\u0001{name[:-1]}=" + text.replace("\\", "\\\\") for name, text in html5.items() if name.endswith(";"))
    return "".join(rows) + "\\u0001"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# fixed values: the references that make up nearly all of real text
COMMON = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0"}


CODE = r"""CASE WHEN n RLIKE r'^#[xX]0*[0-9a-fA-F]{1,6}$' THEN cast(conv(substring(n, 3), 16, 10) AS BIGINT)
    WHEN n RLIKE r'^#0*[0-9]{1,7}$' THEN cast(substring(n, 2) AS BIGINT) END"""
CHARACTER = let_sql(
    CODE, "k", "CASE WHEN k BETWEEN 1 AND 55295 OR k BETWEEN 57344 AND 1114111 THEN decode(unhex(lpad(hex(k), 8, '0')), 'UTF-32') END"
)
TABLE = "'" + _entity_table().replace("'", "\\'").replace("\n", "\\n") + "'"
RARE = let_sql(
    "concat('\\u0001', n, '=')", "m",
    f"CASE WHEN contains({TABLE}, m) THEN substring_index(substring_index({TABLE}, m, -1), '\\u0001', 1) END",
)
NAMED = "CASE n " + " ".join(f"WHEN '{k}' THEN {_literal(v)}" for k, v in COMMON.items()) + f" ELSE {RARE} END"
ENTITY = let_sql(
    r"regexp_extract(p, r'^(#?[0-9A-Za-z]+);', 1)",
    "n",
    let_sql(
        f"CASE WHEN n = '' THEN NULL WHEN startswith(n, '#') THEN {CHARACTER} ELSE {NAMED} END",
        "e",
        r"CASE WHEN e IS NULL THEN concat('&', p) ELSE concat(e, substring(p, length(n) + 2)) END",
    ),
)


def decode_sql(x: str) -> str:
    pieces = f"transform(split({x}, '&'), (p, i) -> CASE WHEN i = 0 THEN p ELSE {ENTITY} END)"
    return f"CASE WHEN NOT contains({x}, '&') THEN {x} ELSE array_join({pieces}, '') END"


def strip_sql(x: str) -> str:
    out = x
    for pattern in (COMMENT, TAG, LOOSE_TAG):
        out = f"regexp_replace({out}, {_literal(pattern)}, '')"
    return f"CASE WHEN NOT contains({x}, '<') THEN {x} ELSE {out} END"


def collapse_sql(x: str) -> str:
    """Collapse white space; the lone string ``0`` counts as empty. Text without odd or doubled spaces stays as it is."""
    uneven = f"startswith({x}, ' ') OR endswith({x}, ' ') OR contains({x}, '  ') OR {x} RLIKE {_literal(ODD)}"
    collapsed = f"CASE WHEN {uneven} THEN regexp_replace({trim_sql(x)}, {_literal(SPACES)}, ' ') ELSE {x} END"
    return let_sql(collapsed, "z", "CASE WHEN z = '0' THEN '' ELSE z END")


CLEAN = let_sql(decode_sql("t"), "d", let_sql(strip_sql("d"), "s", collapse_sql("s")))


def decode_entities(value: Column | str) -> Column:
    """Decode named and numeric character references; text without ``&`` is passed through untouched."""
    return apply(f"t -> {decode_sql('t')}", value)


def strip_tags(value: Column | str) -> Column:
    """Remove comments and tags; a ``<`` followed by white space is text."""
    return apply(f"d -> {strip_sql('d')}", value)


def clean_text(value: Column | str) -> Column:
    """Entities, tags, white space."""
    return apply(f"t -> {CLEAN}", value)


def truncate_text(value: Column | str, limit: int, ellipsis: str = "...") -> Column:
    return let(
        col(value),
        lambda text: F.when(
            F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit))), F.lit(ellipsis))
        ).otherwise(text),
    )


def title_or_default(value: Column | str, default: str = S.DEFAULT_TITLE) -> Column:
    clean = clean_text(F.coalesce(col(value), F.lit("")))
    return let(clean, lambda t: truncate_text(F.when(t == "", F.lit(default)).otherwise(t), S.TITLE_LIMIT))


def nullable_summary(value: Column | str) -> Column:
    return let(clean_text(value), lambda t: truncate_text(F.when(t != "", t), S.SUMMARY_LIMIT))


def clean_summary(value: Column | str) -> Column:
    return truncate_text(clean_text(value), S.SUMMARY_LIMIT)


# --- dates -------------------------------------------------------------------------------------------
# fixed values: zone names used in feed dates
ZONE_OFFSETS = {
    "GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600",
    "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}
ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
RFC_DATE = r"^\d{1,2} [A-Za-z]{3} \d{4}( \d{2}:\d{2}(:\d{2})?( ([A-Za-z]{1,3}|[+-]\d{4}))?)?$"
MONTH = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?"


ZONE_CASE = "CASE upper(regexp_extract(x, r' ([A-Za-z]{1,3})$', 1)) WHEN '' THEN '+0000' " + " ".join(
    f"WHEN '{name}' THEN '{shift}'" for name, shift in ZONE_OFFSETS.items()
) + " END"
CLOCK = let_sql(
    r"regexp_extract(x, r'^\S+ \S+ \S+ (\d{2}:\d{2}(:\d{2})?)', 1)",
    "c",
    "CASE WHEN c = '' THEN '00:00:00' WHEN length(c) = 5 THEN concat(c, ':00') ELSE c END",
)
RFC = rf"""try_to_timestamp(concat_ws(' ', initcap(regexp_extract(x, r'^(\d{{1,2}} [A-Za-z]{{3}} \d{{4}})', 1)), {CLOCK},
    CASE WHEN x RLIKE r'[+-]\d{{4}}$' THEN right(x, 5) ELSE {ZONE_CASE} END), 'd MMM yyyy HH:mm:ss xx')"""
ISO = r"""try_cast(CASE WHEN x RLIKE r'^\d{4}-\d{2}-\d{2}$' THEN x
    ELSE regexp_replace(regexp_replace(regexp_replace(x, r'([+-]\d{2})(\d{2})$', '$1:$2'), r'\s+(Z|[+-])', '$1'),
        r'([T ]\d{2}:\d{2})(Z|[+-]|$)', '$1:00$2') END AS TIMESTAMP)"""
#: Weekday names go, slashes become dashes, ``March 14, 2026`` becomes ``14 Mar 2026``.
PLAIN = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(z, r'^[A-Za-z]{{3,9}},\s*', ''),
    r'^(\d{{4}})/(\d{{2}})/(\d{{2}})', '$1-$2-$3'), r'(?i)^{MONTH}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})', '$2 $1 $3'),
    r'(?i)^(\d{{1,2}}) {MONTH}\.?,? (\d{{4}})', '$1 $2 $3')"""
DATE = let_sql(
    let_sql(trim_sql("t"), "z", f"CASE WHEN z RLIKE r'{ISO_DATE}' THEN z ELSE {PLAIN} END"),
    "x",
    f"CASE WHEN x RLIKE r'{ISO_DATE}' THEN {ISO} WHEN x RLIKE r'{RFC_DATE}' AND {ZONE_CASE} IS NOT NULL THEN {RFC} END",
)


def parse_date(value: Column | str) -> Column:
    """ISO 8601, RFC 822/1123, ``yyyy-MM-dd[ HH:mm[:ss]]`` and dates with month names in either order; everything else is null."""
    return apply(f"t -> {DATE}", value)


def iso_date(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ssxxx")


# --- UTF-8 -------------------------------------------------------------------------------------------
def repair_utf8(value: Column | str, max_bytes: int | None = None) -> Column:
    """Binary or string → valid UTF-8 without the broken bytes, cut at a character boundary.

    Valid text stays as it is. Broken bytes become U+FFFD and go; marks that the text itself holds stand aside meanwhile.
    """
    raw, mark, aside = col(value).cast("string"), F.lit("\ufffd"), F.lit("\U0010ffff\U0010fffe")
    cleared = F.replace(F.replace(F.make_valid_utf8(F.replace(raw, mark, aside)), mark, F.lit("")), aside, mark)
    text = F.when(F.is_valid_utf8(raw), raw).otherwise(cleared)
    return text if max_bytes is None else cut_utf8(text, max_bytes)


def cut_utf8(value: Column, max_bytes: int) -> Column:
    """Longest prefix of at most ``max_bytes`` bytes that does not split a character."""
    head = F.make_valid_utf8(F.substring(value.cast("binary"), 1, max_bytes).cast("string"))
    cut = F.regexp_replace(head, "\ufffd+$", "")
    return F.when(F.octet_length(value) <= max_bytes, value).otherwise(cut)


# --- filters -----------------------------------------------------------------------------------------
def likely_title(value: Column | str, blocked: list[str] = S.FEED_TITLE_BLOCKED) -> Column:
    return let(
        F.lower(trim_ascii(value)), lambda t: F.length(t).between(S.TITLE_MIN, S.TITLE_MAX) & ~contains_any(t, blocked)
    )


def likely_listing_title(value: Column | str) -> Column:
    def judged(title: Column) -> Column:
        copy = let(F.lower(trim_ascii(title)), lambda t: ~contains_any(t, S.LISTING_COPY_BLOCKED))
        return F.length(title).between(S.TITLE_MIN, S.TITLE_MAX) & copy

    return let(col(value), judged)


def likely_summary(value: Column | str) -> Column:
    return let(
        F.lower(trim_ascii(value)), lambda s: (F.length(s) >= S.SUMMARY_MIN) & ~contains_any(s, S.FEED_SUMMARY_BLOCKED)
    )


# --- JSON, slugs -------------------------------------------------------------------------------------
def extract_json_object(value: Column | str) -> Column:
    """JSON object text inside code fences or prose; null when it does not parse."""
    raw = trim_ascii(value)
    unfenced = F.when(
        F.startswith(raw, F.lit("```")),
        trim_ascii(F.regexp_replace(F.regexp_replace(raw, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")),
    ).otherwise(raw)
    braces = let(
        unfenced,
        lambda t: F.when(t.rlike(r"(?s)\{.*\}"), F.regexp_extract(t, r"(?s)(\{.*\})", 1)).otherwise(t),
    )
    return let(braces, lambda t: F.when(F.try_parse_json(t).isNotNull() & t.rlike(r"^\s*[\{\[]"), t))


def slug(value: Column | str) -> Column:
    # accents that decompose are folded, Cyrillic is spelt out; other non-ASCII letters are dropped
    latin = F.translate(F.lower(col(value)), "абвгґдезийіклмнопрстуфхцыэёьъ", "abvggdeziyiklmnoprstufhcyee")
    for letter, spelt in (("є", "ye"), ("ж", "zh"), ("ї", "yi"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ю", "yu"), ("я", "ya")):
        latin = F.replace(latin, F.lit(letter), F.lit(spelt))
    folded = F.translate(
        latin,
        "àáâãäåāçćčďèéêëēěìíîïīñńňòóôõöøōřśšťùúûüūůýÿžźż",
        "aaaaaaacccdeeeeeeiiiiinnnooooooorsstuuuuuuyyzzz",
    )
    text = F.replace(F.replace(folded, F.lit("ß"), F.lit("ss")), F.lit("@"), F.lit("-at-"))
    words = F.regexp_replace(F.regexp_replace(text, "_", "-"), r"[^a-z0-9\s-]+", "")
    return F.regexp_replace(F.regexp_replace(words, r"[-\s]+", "-"), "^-|-$", "")


def article_slug(title: Column | str, language: Column | str, key: Column) -> Column:
    """Readable slug with a short stable suffix derived from ``key``."""
    base = F.coalesce(blank_to_null(slug(truncate_text(title, S.SLUG_LIMIT, ""))), F.lit("article"))
    return F.concat_ws("-", base, col(language), F.left(F.md5(key.cast("binary")), F.lit(8)))
