"""DuckDB expression builders used by several oracles."""

from __future__ import annotations

from feedweir import settings as S

NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_of(value: str, words) -> str:
    return "(" + " OR ".join(f"contains({value}, '{w}')" for w in words) + ")"


def let(value: str, name: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def parts(url: str) -> str:
    return (
        f"regexp_extract({url}, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?', ['s', 'a', 'p', 'q'])"
    )


def canon(url: str) -> str:
    """Canonical form of a URL expression."""
    query = (
        "list_sort(list_filter(string_split(substr(r.q, 2), '&'), lambda kv: kv <> '' AND NOT starts_with(lower(kv), "
        f"'utm_') AND NOT list_contains([{quoted(S.TRACKING_KEYS)}], lower(split_part(kv, '=', 1)))))"
    )
    host = "rtrim(lower(regexp_replace(regexp_replace(r.a, '^.*@', ''), ':[0-9]*$', '')), '.')"
    port = "regexp_extract(r.a, ':([0-9]+)$', 1)"
    path = "regexp_replace(regexp_replace(r.p, '/+', '/', 'g'), '/$', '')"
    body = (
        f"CASE WHEN r.a = '' THEN w ELSE lower(r.s) || '://' || {host}"
        f" || CASE WHEN {port} = '' OR (lower(r.s) = 'http' AND {port} = '80') OR (lower(r.s) = 'https' AND {port} = '443')"
        f" THEN '' ELSE ':' || {port} END"
        f" || CASE WHEN {path} = '' THEN '/' ELSE {path} END"
        f" || CASE WHEN len({query}) = 0 THEN '' ELSE '?' || array_to_string({query}, '&') END END"
    )
    with_scheme = (
        f"CASE WHEN regexp_matches(trim({url}), '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN trim({url})"
        f" ELSE 'https://' || trim({url}) END"
    )
    return f"CASE WHEN trim({url}) = '' THEN '' ELSE {let(with_scheme, 'w', let(parts('w'), 'r', body))} END"


def host(url: str) -> str:
    return f"nullif(lower(regexp_replace(regexp_replace(regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '')"


def path(url: str) -> str:
    return f"regexp_extract({url}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def valid(url: str) -> str:
    label = "[a-z0-9]([a-z0-9-]*[a-z0-9])?"
    return f"regexp_matches({url}, '^https?://{label}(\\.{label})*\\.?(:[0-9]{{1,5}})?([/?#][!-~]*)?$', 'i')"


def absolute(href: str, base: str) -> str:
    """Hrefs of the sample pages: absolute, root-relative or plain relative without dots."""
    b = canon(base)
    raw = (
        f"CASE WHEN h = '' THEN b WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN h"
        f" WHEN starts_with(h, '//') THEN split_part(b, '://', 1) || ':' || h"
        f" WHEN starts_with(h, '/') THEN regexp_extract(b, '^([a-zA-Z]+://[^/?#]*)', 1) || h"
        f" ELSE regexp_extract(b, '^([a-zA-Z]+://[^/?#]*)', 1) || regexp_replace({path('b')}, '[^/]*$', '') || h END"
    )
    return let(f"trim({href})", "h", let(b, "b", let(raw, "u", canon("u"))))


def clean(text: str) -> str:
    """Entities of the sample data, tags, white space."""
    decoded = text
    for name, char in (
        ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    ):
        decoded = f"replace({decoded}, '{name}', '{char}')"
    stripped = (
        f"regexp_replace(regexp_replace(regexp_replace({decoded}, '(?s)<!--.*?(-->|$)', '', 'g'),"
        " '<[^\\s>\"''][^>\"'']*((\"[^\"]*\"|''[^'']*'')[^>\"'']*)*>', '', 'g'), '<[^\\s>][^>]*(>|$)', '', 'g')"
    )
    spaced = f"regexp_replace(regexp_replace({stripped}, '^\\s+|\\s+$', '', 'g'), '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g')"
    spaced = spaced.replace("{{", "{").replace("}}", "}")
    return let(spaced, "t", "CASE WHEN t = '0' THEN '' ELSE t END")


def limit(text: str, n: int, dots: str = "...") -> str:
    return let(text, "t", f"CASE WHEN length(t) > {n} THEN rtrim(left(t, {n})) || '{dots}' ELSE t END")


def iso(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S+00:00')"


def jitter(hash_expr: str, low: int, high: int) -> str:
    return f"(CAST('0x' || left({hash_expr}, 7) AS BIGINT) % {high - low + 1} + {low})"
