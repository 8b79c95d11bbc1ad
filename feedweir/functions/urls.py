"""URL canonicalisation, resolution and identity as column expressions.

Everything stays in the JVM. ``parse_url`` is not used: it keeps the host's case and rejects non-ASCII URLs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import apply, col, let_sql, sha256_ci

SCHEME = r"^[a-zA-Z][a-zA-Z0-9+\-.]*://"
PARTS = r"(?s)^([a-zA-Z][a-zA-Z0-9+\-.]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$"
USERINFO = r"^.*@"
PORT = r":(\d*)$"
BAD_PORT = r"(?<!\]):(?!\d{0,5}$)[^\]]*$"
HTTP_URL = (
    r"(?i)^https?://(?:[!-~&&[^/?#@]]*@)?"
    r"(?:\[[0-9a-f:.]+\]|[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?)*\.?)"
    r"(?::\d{1,5})?(?:[/?#][!-~]*)?$"
)


#: The ASCII white space that is trimmed from URLs and texts.
BLANKS = " \t\n\r\x00\x0b"


def trim_ascii(value: Column | str) -> Column:
    """Trim the ASCII whitespace set used for URLs and texts."""
    return F.trim(col(value), F.lit(BLANKS))


def url_authority(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, PARTS, 2), USERINFO, "")


def url_host(url: Column | str) -> Column:
    """Lower-cased host, or null when there is none."""
    host = F.lower(F.regexp_replace(url_authority(col(url)), PORT, ""))
    return F.nullif(host, F.lit(""))


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), PARTS, 3)


def url_query(url: Column | str) -> Column:
    return F.regexp_extract(col(url), PARTS, 4)


def url_origin(url: Column | str) -> Column:
    u = col(url)
    return F.concat(F.regexp_extract(u, PARTS, 1), F.lit("://"), F.coalesce(url_host(u), F.lit("")))


# --- SQL text of the canonical form ------------------------------------------------------------------
def trim_sql(x: str) -> str:
    return rf"trim(BOTH ' \t\n\r\u0000\u000B' FROM {x})"


def _plain(x: str) -> str:
    return f"coalesce(try_url_decode({x}), {x})"


def _encode(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '+', '%20'), '*', '%2A'), '%7E', '~')"


TRACKED = ", ".join(f"'{k}'" for k in S.TRACKING_KEYS)
TRACKING = f"(startswith(lower(trim(kv.k)), '{S.TRACKING_PREFIX}') OR lower(trim(kv.k)) IN ({TRACKED}))"
PAIRS = f"""transform(filter(split(substring(p.q, 2), '&'), s -> s <> ''), s -> named_struct(
    'k', translate(ltrim({_plain("substring_index(s, '=', 1)")}), '. ', '__'),
    'v', {_plain("CASE WHEN contains(s, '=') THEN regexp_replace(s, r'^[^=]*=', '') ELSE '' END")}))"""
KEPT = f"""filter(kvs, (kv, i) -> kv.k <> '' AND NOT kv.k RLIKE r'^(0|-?[1-9][0-9]*)$' AND NOT {TRACKING}
    AND NOT exists(slice(kvs, i + 2, size(kvs)), later -> later.k = kv.k))"""
ENCODED = f"array_join(transform(array_sort({KEPT}), kv -> concat({_encode('kv.k')}, '=', {_encode('kv.v')})), '&')"
# ``?a=1&b`` → sorted, de-duplicated (last wins), tracking-free and RFC 3986 encoded
QUERY = let_sql(let_sql(PAIRS, "kvs", ENCODED), "e", "CASE WHEN e = '' THEN '' ELSE concat('?', e) END")
# patterns are only tried where the character is that they look for
PORTLESS = f"CASE WHEN contains(p.h, ':') THEN regexp_replace(p.h, r'{PORT}', '') ELSE p.h END"
CANONICAL_PATH = "regexp_replace(CASE WHEN contains(p.f, '//') THEN regexp_replace(p.f, '/+', '/') ELSE p.f END, '/$', '')"
NUMBER = rf"CASE WHEN contains(p.h, ':') THEN regexp_replace(regexp_extract(p.h, r'{PORT}', 1), r'^0+(?=\d)', '') ELSE '' END"
STANDARD_PORT = "(n = '' OR (lower(p.s) = 'http' AND n = '80') OR (lower(p.s) = 'https' AND n = '443'))"
REBUILT = f"""CASE WHEN {PORTLESS} = '' OR (contains(p.h, ':') AND p.h RLIKE r'{BAD_PORT}') THEN w
    ELSE concat(lower(p.s), '://', rtrim('.', lower({PORTLESS})),
        {let_sql(NUMBER, 'n', f"CASE WHEN {STANDARD_PORT} THEN '' ELSE concat(':', n) END")},
        {let_sql(CANONICAL_PATH, 'c', "CASE WHEN c = '' THEN '/' ELSE c END")},
        CASE WHEN length(p.q) <= 1 THEN '' ELSE {QUERY} END) END"""
HOST = let_sql(f"regexp_extract(w, r'{PARTS}', 2)", "a", f"CASE WHEN contains(a, '@') THEN regexp_replace(a, r'{USERINFO}', '') ELSE a END")
SPLIT = f"""named_struct('s', regexp_extract(w, r'{PARTS}', 1), 'h', {HOST},
    'f', regexp_extract(w, r'{PARTS}', 3), 'q', regexp_extract(w, r'{PARTS}', 4))"""
WITH_SCHEME = f"CASE WHEN v RLIKE r'{SCHEME}' THEN v ELSE concat('https://', v) END"


def canonical_sql(x: str) -> str:
    return let_sql(trim_sql(x), "v", f"CASE WHEN v = '' THEN v ELSE {let_sql(WITH_SCHEME, 'w', let_sql(SPLIT, 'p', REBUILT))} END")


def canonical_url(value: Column | str) -> Column:
    """Canonical URL: one spelling per resource."""
    return apply(f"u -> {canonical_sql('u')}", value)


# href ``c`` against canonical base ``b``
ORIGIN = r"regexp_extract(b, r'^([a-zA-Z][a-zA-Z0-9+\-.]*://[^/?#]*)', 1)"
DIRECTORY = f"regexp_replace(regexp_extract(b, r'{PARTS}', 3), r'[^/]*$', '')"
UNDOTTED = """concat('/', array_join(aggregate(filter(split(concat(DIR, c), '/'), s -> s <> '' AND s <> '.'), cast(array() AS array<string>),
    (acc, s) -> CASE WHEN s = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) ELSE array_append(acc, s) END), '/'))""".replace(
    "DIR", DIRECTORY
)
RESOLVED = f"""CASE WHEN c = '' THEN b
    WHEN c RLIKE r'{SCHEME}' OR regexp_extract(b, r'{PARTS}', 2) = '' THEN c
    WHEN startswith(c, '//') THEN concat(regexp_extract(b, r'{PARTS}', 1), ':', c)
    WHEN startswith(c, '/') THEN concat({ORIGIN}, c)
    ELSE concat({ORIGIN}, {UNDOTTED}) END"""
RESOLVE = let_sql(RESOLVED, "r", canonical_sql("r"))
ABSOLUTE = let_sql(trim_sql("x.a"), "c", let_sql(canonical_sql("x.b"), "b", RESOLVE))
ON_CANONICAL = let_sql(trim_sql("x.a"), "c", let_sql("x.b", "b", RESOLVE))


def absolute_url(href: Column | str, base: Column | str) -> Column:
    """Resolve ``href`` against ``base`` and canonicalise the result."""
    return apply(f"x -> {ABSOLUTE}", href, base)


def resolved_url(href: Column | str, base: Column | str) -> Column:
    """:func:`absolute_url` for a ``base`` that is canonical already: many links of a page share one."""
    return apply(f"x -> {ON_CANONICAL}", href, base)


def is_http_url(url: Column | str) -> Column:
    """ASCII http(s) URL with a well-formed host."""
    return F.coalesce(col(url).rlike(HTTP_URL), F.lit(False))


def url_hash(url: Column | str) -> Column:
    return sha256_ci(url)


def host_in_domain(host: Column, domain: str) -> Column:
    return (host == domain) | F.endswith(host, F.lit("." + domain))
