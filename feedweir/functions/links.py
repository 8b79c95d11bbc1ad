"""Which anchors lead to articles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import col, contains_any, let, starts_with_any
from feedweir.functions.urls import absolute_url, trim_ascii, url_path

MEDIA_PATH = rf"\.({'|'.join(S.HREF_EXTENSIONS_BLOCKED)})$"


def likely_href(href: Column | str, base: Column | str, resolve: Callable[[Column | str, Column | str], Column] = absolute_url) -> Column:
    """Rejects in-page, script, mail and phone links, media files and taxonomy paths. ``resolve``: ``resolved_url`` for a canonical base."""
    target = let(
        F.lower(resolve(href, base)),
        lambda u: ~url_path(u).rlike(MEDIA_PATH) & ~contains_any(u, S.HREF_PATHS_BLOCKED),
    )
    plain = let(F.lower(trim_ascii(href)), lambda h: (h != "") & ~starts_with_any(h, S.HREF_PREFIX_BLOCKED))
    return F.coalesce(plain & target, F.lit(False))
