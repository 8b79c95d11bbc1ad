"""Image URL acceptance rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedweir import settings as S
from feedweir.functions.core import col, contains_any, let
from feedweir.functions.urls import url_host, url_path

DYNAMIC_MEDIA = r"(?i)/is/(?:content|image)/"
FACE_SIZE = r"(?i)(?:width|w)=([1-9]\d?)(?:[,&]|$)"
TINY_SIZE = r"(?i)[?&](?:s|size|w|width|h|height)=(?:[1-9]|[1-5]\d)(?:&|$)"
SMALL_SIZE = r"(?i)[?&](?:w|width|h|height)=([1-9]\d{0,2})(?:[&#]|$)"


def _extensionless(path: Column) -> Column:
    return ~F.regexp_extract(path, r"([^/]*)$", 1).rlike(r"\.[^.]+$")


def acceptable_image(url: Column | str) -> Column:
    """Rule for images taken from article pages."""
    u = col(url)
    lower = F.lower(u)
    path = url_path(u)
    face_crop = F.contains(lower, F.lit("cdn-cgi/image/")) & (
        F.contains(lower, F.lit("gravity=face")) | F.contains(lower, F.lit("fit=crop")) | u.rlike(FACE_SIZE)
    )
    rejected = (
        contains_any(lower, S.PAGE_IMAGE_BLOCKED)
        | face_crop
        | F.contains(F.coalesce(url_host(u), F.lit("")), F.lit("gravatar.com"))
        | u.rlike(TINY_SIZE)
        | (F.trim(path) == "")
        | (path.rlike(DYNAMIC_MEDIA) & _extensionless(path))
        | path.rlike(r"/\d+/?$")
    )
    return F.coalesce(~rejected, F.lit(False))


def feed_image_or_null(url: Column | str) -> Column:
    """Rule for images found inside feed bodies and listings: the URL, or null when rejected."""
    u = col(url)
    path = url_path(u)
    named = let(F.lower(u), lambda lower: contains_any(lower, S.LISTING_IMAGE_BLOCKED))
    rejected = named | (path.rlike(DYNAMIC_MEDIA) & _extensionless(path))
    return F.when(~rejected & (F.trim(u) != ""), u)


def image_penalty(url: Column, base_url: Column) -> Column:
    """Points taken off an image candidate whose name or size looks unlike a lead image."""
    lower = F.lower(url)
    exempt = F.contains(F.coalesce(url_host(base_url), F.lit("")), F.lit("github.blog"))
    size = F.regexp_extract(url, SMALL_SIZE, 1)

    def points(hit: Column, value: int) -> Column:
        return F.when(hit, F.lit(value)).otherwise(F.lit(0))

    return (
        points(F.contains(lower, F.lit("cropped-microsoft_logo_element")), 90)
        + points(lower.rlike(r"(?:^|[/_-])(logo|icon)(?:[/_.-]|$)") & ~exempt, 45)
        + points(lower.rlike(r"(?:^|[/_-])(avatar|headshot|author|profile)(?:[/_.-]|$)"), 120)
        + points((size != "") & (F.coalesce(size.try_cast("int"), F.lit(999)) < 220), 40)
    )
