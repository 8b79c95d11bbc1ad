"""Markdown clean-up and language checks on whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir.functions.core import apply, blank_to_null, col
from feedweir.functions.text import strip_tags
from feedweir.functions.urls import trim_ascii, url_host
from feedweir.operators.partitioning import top_per_key

# fixed values: text removed before the lines are looked at
MARKDOWN_NOISE = [
    (r"(?m)^(Published Time|URL Source|Markdown Content):.*$", ""),
    (r"(?i)!\[Image \d+:.*?avatar\]\([^)]+\)", ""),
    (r"(?i)!\[Image \d+\]\([^)]+\)", ""),
    (r"(?i)\[.*?Follow\]\([^)]+\)", ""),
    (r"(?i)\[-?\s*\[x?\]\s*Upvote\s*\d*\]\([^)]+\)", ""),
    (r"(?i)\[Upvote\s*\d*\]\([^)]+\)", ""),
    (r"(?im)^\s*\[.*?\b(Follow)\b.*?\]\([^)]+\)\s*$", ""),
    (r"(?m)^\s*\+\d+\s*$", ""),
]
# fixed values: navigation lines, noise lines inside the article, bylines, and headings that end it
SKIPPED = r"(?i)^top of page$|^bottom of page$|^Use tab to navigate|^Search$|^\*\s+More\s*$|^\*\s+\[All Posts\]"
NOISE = (
    r"(?i)^\*?\s*\[?.*avatar.*\]?\s*$|^\s*\w+\s+\w+\s+Follow\s*$|^\s*\[\w+\]\(https:\/\/.*\/\w+\)\s*$|^\s*Enterprise\+?Article\s*$"
    r"|\bFollow\s*$|^\s*Upvote\s*\d*\s*$|^\s*Like\s*\d*\s*$|^\s*Share\s*$|^\s*Repost\s*$"
    r"|^\s*Published\s+\d+\s+(hours?|days?|weeks?|months?)\s+ago\s*$|^\s*\d+\s+min\s+read\s*$"
)
BYLINE = r"(?i)^\*\s+(!\[Image \d+:.*Writer|.*min read|\w+ \d{1,2}$)"
FOOTER = (
    r"(?i)^#{1,6}\s+(Recent Posts|Related Posts|More Articles|Comments|Share this|Copyright|Terms of Service|Privacy Policy|Discussion"
    r"|Responses|Leave a comment)$"
)
HEADER_BUDGET, BODY_LINE_BYTES = 30, 80

_START = f"""try_element_at(filter(transform(kept, (l, i) -> named_struct('i', i, 'l', trim(l))), x -> x.i > h
    AND (x.l LIKE '# %' OR x.l LIKE '## %' OR (x.i - h > {HEADER_BUDGET} AND octet_length(x.l) > {BODY_LINE_BYTES}))), 1).i"""
_FIRST = "try_element_at(filter(transform(kept, (l, i) -> CASE WHEN trim(l) LIKE '# %' THEN i END), i -> i IS NOT NULL), 1)"
_STOP = f"coalesce(try_element_at(filter(transform(rest, (l, i) -> CASE WHEN trim(l) RLIKE r'{FOOTER}' THEN i END), i -> i IS NOT NULL), 1), size(rest))"
_BODY = f"""element_at(transform(array(slice(kept, s + 1, size(kept))), rest -> array_join(filter(slice(rest, 1, {_STOP}),
    l -> NOT trim(l) LIKE '# %' AND NOT trim(l) RLIKE r'{NOISE}' AND NOT trim(l) RLIKE r'{BYLINE}'), '\\n')), 1)"""
MARKDOWN = f"""t -> element_at(transform(array(split(t, '\\n')), lines -> element_at(transform(array(filter(lines, l -> NOT trim(l) RLIKE r'{SKIPPED}')),
    kept -> element_at(transform(array({_FIRST}), h -> CASE WHEN h IS NULL THEN '' ELSE element_at(transform(array({_START}),
        s -> CASE WHEN s IS NULL THEN array_join(slice(lines, 2, size(lines)), '\\n') ELSE {_BODY} END), 1) END), 1)), 1)), 1)"""


def clean_markdown(value: Column | str) -> Column:
    """Article part of a page rendered as Markdown.

    Content starts at the second H1, the first H2 after the first H1, or the first long line once the header budget is
    used up; it ends at a footer heading. A document is one row, so line positions replace a line-by-line state.
    """
    text = col(value)
    for pattern, replacement in MARKDOWN_NOISE:
        text = F.regexp_replace(text, pattern, replacement)
    return trim_ascii(apply(MARKDOWN, text))


def markdown_title(value: Column | str, url: Column) -> Column:
    title = trim_ascii(F.regexp_extract(col(value), r"(?m)^# (.+)$", 1))
    return F.coalesce(blank_to_null(title), url_host(url), F.lit("Untitled"))


def markdown_image(value: Column | str) -> Column:
    """First picture that is neither a small thumbnail nor an icon."""
    images = F.regexp_extract_all(col(value), F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), F.lit(1))

    def lead(u: Column) -> Column:
        width = F.regexp_extract(u, r"fill/w_(\d+)", 1)
        return F.when(width != "", width.try_cast("bigint") >= 200).otherwise(~u.rlike("(?i)icon|logo|avatar|favicon"))

    return F.try_element_at(F.filter(images, lead), F.lit(1))


# fixed values: thresholds of the language verdict, profile length
MIN_CHARS, MIN_SCORE, MIN_MARGIN, PROFILE = 60, 0.04, 0.03, 300
#: Languages that profiles may tell apart; bounds the table that every task holds.
MAX_LANGUAGES = 500
#: Letters of texts whose trigrams are looked at together, and distinct trigrams of a language that are kept before they are merged.
LETTERS, HELD = 1 << 19, 1 << 18


def _letters(text: Column) -> Column:
    """The whole text as lower-case words of letters, a blank at each word's border."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def _runs(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``LETTERS`` letters, or of one longer text."""
    ends, lo = np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LETTERS, "right")))
        yield lo, hi
        lo = hi


def _trigrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, text, trigram) of runs of texts; a trigram is a number in the order of its letters."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in _runs(sizes):
        part = texts.slice(lo, hi - lo).fill_null("")
        letters = np.frombuffer("".join(part.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = sizes[lo:hi]
        text = np.repeat(np.arange(len(size)), size)
        inside = np.flatnonzero(text[2:] == text[:-2]) if len(text) > 2 else np.zeros(0, np.int64)
        yield lo, hi, text[inside], (letters[inside] << 42) | (letters[inside + 1] << 21) | letters[inside + 2]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return gram, np.bincount(place, np.concatenate([n for _, n in parts]), len(gram)).astype(np.int64)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per batch, language and trigram; a task holds distinct trigrams, not those of all its texts."""
    for batch in batches:
        coded = batch.column("lang").dictionary_encode()
        lang = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lo, hi, text, gram in _trigrams(batch.column("letters")):
            for code in np.unique(lang[lo:hi]):
                parts = found.setdefault(int(code), [])
                parts.append(np.unique(gram[lang[lo:hi][text] == code], return_counts=True))
                if sum(len(g) for g, _ in parts[1:]) > HELD:
                    parts[:] = [_merged(parts)]
        for code, parts in found.items():
            gram, n = _merged(parts)
            name = coded.dictionary[code].as_py() if code < len(coded.dictionary) else None
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])


def language_profiles(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """lang, gram, weight: the ``size`` most frequent trigrams per language, weighted 1 (first) down to 1/size.

    Trigrams are counted batch by batch, so one row per batch, language and trigram is shuffled.
    """
    counted = docs.select("lang", _letters(F.col("text")).alias("letters")).mapInArrow(_count_trigrams, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = top_per_key(counted, ["lang"], [F.col("n").desc(), F.col("gram").asc()], size)
    return ranked.select("lang", "gram", ((size + 1 - F.col("rn")) / size).alias("weight"))


def language_code(code: Column) -> Column:
    """Variants of Chinese are one language, others go by what stands before the hyphen."""
    low = F.lower(code)
    return F.when(F.startswith(low, F.lit("zh")), "zh").otherwise(F.substring_index(low, "-", 1))


def _scores(known: np.ndarray, points: np.ndarray, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text, gram in _trigrams(batch.column("letters")):
                place = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
                hit = known[place] == gram if len(known) else np.zeros(len(gram), bool)
                sums = np.stack([np.bincount(text[hit], w[place[hit]], hi - lo) for w in points], axis=1) if len(points) else np.zeros((hi - lo, 0))
                mean = sums / (size * np.maximum(np.bincount(text, minlength=hi - lo), 1))[:, None]
                ends = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * mean.shape[1])
                rest = [batch.column(c).slice(lo, hi - lo) for c in batch.schema.names if c != "letters"]
                names = [c for c in batch.schema.names if c != "letters"]
                yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(ends, pa.array(mean.ravel()))], names=[*names, "mean"])

    return run


def verify_language(docs: DataFrame, profiles: DataFrame, target: Column, key: str = "doc_id", size: int = PROFILE) -> DataFrame:
    """Is each document in its target language? true, false, or null when unclear.

    A score is the mean profile weight over the document's trigrams: weights are whole points of 1/``size``, summed as such, so the order of
    the sum changes nothing. The profiles (at most ``size`` rows for each of at most
    ``MAX_LANGUAGES`` languages) go to the tasks as one sorted array, so a text is scored where it lies and nothing is shuffled.
    """
    table = profiles.where("lang IS NOT NULL").select("lang", "gram", "weight").limit(size * MAX_LANGUAGES + 1).toPandas()
    if len(table) > size * MAX_LANGUAGES:
        raise ValueError(f"profiles of more than {MAX_LANGUAGES} languages")
    langs = sorted(table["lang"].unique())
    known, place = np.unique(table["gram"].to_numpy(np.int64), return_inverse=True)
    points = np.zeros((len(langs), len(known)))
    points[np.searchsorted(langs, table["lang"]) if len(langs) else [], place] = np.rint(table["weight"].to_numpy(float) * size)

    plain = trim_ascii(strip_tags("text"))
    letters = F.when(F.length("plain") >= MIN_CHARS, _letters(F.col("plain")))
    rows = docs.select(key, target.cast("string").alias("target"), plain.alias("plain")).select(key, "target", letters.alias("letters"))
    kind = rows.schema[key].dataType.simpleString()
    scored = rows.mapInArrow(_scores(known, points, size), f"`{key}` {kind}, target string, mean array<double>")
    named = F.zip_with("mean", F.array(*[F.lit(x) for x in langs]).cast("array<string>"), lambda m, x: F.struct(F.round(m, 6).alias("score"), x.alias("lang"), m.alias("mean")))
    ranked = F.reverse(F.array_sort(F.filter(named, lambda s: s["mean"] > 0)))
    joined = scored.select(key, "target", ranked.alias("r"))
    top, second = F.try_element_at("r", F.lit(1)), F.coalesce(F.try_element_at("r", F.lit(2))["score"], F.lit(0.0))
    verdict = (
        F.when(top["score"] < MIN_SCORE, None)
        .when(language_code(top["lang"]) == language_code(F.col("target")), True)
        .when(top["score"] - second < MIN_MARGIN, None)
        .when(top["score"].isNotNull(), False)
    )
    return joined.select(key, "target", top["lang"].alias("top_lang"), top["score"].alias("top_score"), verdict.alias("verdict"))
