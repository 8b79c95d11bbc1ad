"""How the word use of each source differs from that of the other sources of its language, from count-level bitmaps.

Terms are counted per (lang, source). Each language keeps the terms of at least ``MIN_DOCS`` of its documents and numbers them
from its most frequent term on. For every (source, count) there is a set of term numbers, held as a bitmap: only its non-zero
words of 64 terms are rows. What a term adds to the distance of two sources depends on its two counts alone, so the
distance is the sum over pairs of counts of the number of terms with these counts (AND of two bitmaps, bits counted) times
the distance of the two shares. The bitmap of the terms that a source lacks is the complement of all its others.

Words of bitmaps are dealt to tasks by (lang, word). A task compares the at most 64 counts that one source can have in a word
with those of every other source and keeps one sum per pair of sources, never a row per term or per pair of counts. A hot
source is counted in the tasks that read it before anything is shuffled; in the bitmaps it is no larger than others.

All arithmetic is in integers. Edge cases: null text, lang and source are empty texts; repeated rows and rows of one or no id each
count as a document; a group without terms has value 0 or the distance of its smoothed shares; a language without kept terms
has pairs of value 0 and no term rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedweir.llm import words as w
from feedweir.llm.scratch import Scratch

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
#: Bitmap words that are ANDed at once.
BLOCK = 1 << 21

_COUNTS = "lang string, source string, term string, count long, docs long"
_LEVELS = "lang string, word long, source string, p long, bits long"
_SUMS = "lang string, source string, item string, value long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = w.Tally(["lang", "source", "term"], ["count", "docs"])
    for batch in batches:
        names = [batch.column(c).dictionary_encode() for c in ("lang", "source")]
        langs, sources = (n.dictionary for n in names)
        group = names[0].indices.to_numpy().astype(np.int64) * len(sources) + names[1].indices.to_numpy()
        for lo, hi, ws in w.slices(batch.column("text"), w.NON_LETTER):
            coded = w.strings(ws).dictionary_encode()
            doc, term, times = w.unique_pairs(ws.doc(), coded.indices.to_numpy().astype(np.int64))
            cell = group[lo:hi][doc] * max(len(coded.dictionary), 1) + term
            cells, at = np.unique(cell, return_inverse=True)
            which, term = cells // max(len(coded.dictionary), 1), cells % max(len(coded.dictionary), 1)
            # an empty term tells of a group that may have no terms
            seen = np.unique(group[lo:hi])
            which, none = np.concatenate([which, seen]), np.zeros(len(seen), np.int64)
            terms = pa.concat_arrays([coded.dictionary.take(pa.array(term)), pa.array([""] * len(seen), pa.string())])
            yield from tally.add(pa.table({
                "lang": langs.take(pa.array(which // len(sources))), "source": sources.take(pa.array(which % len(sources))), "term": terms,
                "count": np.concatenate([np.bincount(at, times, len(cells)).astype(np.int64), none]),
                "docs": np.concatenate([np.bincount(at, minlength=len(cells)), none]),
            }))
    yield from tally.flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences and documents; with one row of the empty term for each group."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms))."""
    number = F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + 2)
    return F.call_function("div", number, F.greatest(total + 2 * terms, F.lit(1)).cast("decimal(19,0)")) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _numbered(kept: DataFrame, scratch: Scratch) -> DataFrame:
    """``kept`` with ``number``: from 0 in each language, from its most frequent term on."""
    order = [F.col("lang"), F.col("total").desc(), F.col("term")]
    placed = scratch.put(
        kept.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
        "placed",
    )
    # one row per partition and language
    parts = placed.groupBy("lang", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = parts.select("lang", "part", (before - F.col("first")).alias("base"))
    return placed.join(base, ["lang", "part"]).withColumn("number", F.col("base") + F.col("row")).drop("part", "row", "base")


def bitmaps(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, word, source, p, bits: the words of the bitmap of every (source, share), with the complements for absent terms.

    ``cells``: lang, source, number, p of the terms that a group holds; ``groups``: lang, source, p0 (share of a term without
    occurrences). A word -1 without terms makes sure that each group is seen.
    """
    bit = F.expr("shiftleft(1L, cast(number % 64 as int))")
    levels = cells.groupBy("lang", F.expr("number div 64").alias("word"), "source", "p").agg(F.bit_or(bit).alias("bits"))
    held = levels.groupBy("lang", "word", "source").agg(F.bit_or("bits").alias("held"))
    full = levels.groupBy("lang", "word").agg(F.bit_or("bits").alias("full"))
    full = full.union(groups.select("lang", F.lit(-1).cast("long"), F.lit(0).cast("long")).distinct())
    every = full.join(groups, "lang").join(held, ["lang", "word", "source"], "left")
    rest = F.col("full").bitwiseAND(F.bitwise_not(F.coalesce("held", F.lit(0).cast("long"))))
    return levels.unionByName(every.select("lang", "word", "source", F.col("p0").alias("p"), rest.alias("bits")))


class _Sums:
    """Distances of the pairs of sources of one language, summed over the bitmap words that a task sees."""

    def __init__(self, lang: str):
        self.lang, self.at, self.sums = lang, {}, np.zeros((0, 0), np.int64)

    def _grow(self, names: list[str]) -> None:
        for n in names:
            self.at.setdefault(n, len(self.at))
        if len(self.at) > len(self.sums):
            more = np.zeros((2 * len(self.at),) * 2, np.int64)
            more[: len(self.sums), : len(self.sums)] = self.sums
            self.sums = more

    def add(self, source: pa.Array, p: np.ndarray, bits: np.ndarray) -> None:
        coded = source.dictionary_encode()
        names = coded.dictionary.to_pylist()
        self._grow(names)
        who = np.array([self.at[n] for n in names])[coded.indices.to_numpy()]
        n, step = len(self.sums), max(1, BLOCK // max(len(p), 1))
        flat = self.sums.reshape(-1)
        for lo in range(0, len(p), step):
            both = bits[lo : lo + step, None] & bits[None, :]
            i, j = np.nonzero(both)
            cells = np.bitwise_count(both[i, j]).astype(np.int64)
            a, b = p[lo + i], p[j]
            np.add.at(flat, who[lo + i] * n + who[j], cells * ((a - b) ** 2 // (a + b)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        names = pa.array(list(self.at), pa.string())
        n, other = len(names), np.arange(len(names))
        for i in range(n):  # one batch per source
            keep = pa.array(other[other != i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.lang] * (n - 1), pa.string()), pa.array([names[i].as_py()] * (n - 1), pa.string()), names.take(keep),
                 pa.array(self.sums[i, :n]).take(keep)], names=["lang", "source", "item", "value"],
            )


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (lang, word) after the other, from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, word = batch.column("lang").dictionary_encode(), batch.column("word").to_numpy()
        code = lang.indices.to_numpy()
        cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (word[1:] != word[:-1])) + 1), len(word)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            own = (lang.dictionary[int(code[lo])].as_py(), int(word[lo]))
            if held and own != key:
                yield pa.Table.from_batches(held)
                held = []
            key = own
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = None
    for table in _words(batches):
        lang = table.column("lang")[0].as_py()
        if sums is None or sums.lang != lang:
            if sums:
                yield from sums.rows()
            sums = _Sums(lang)
        sums.add(table.column("source").combine_chunks(), table.column("p").to_numpy(), table.column("bits").to_numpy().view(np.uint64))
    if sums:
        yield from sums.rows()


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``docs`` (text, lang, source) → lang, source, part, item, value, rank.

    Part ``pair``: the distance to every other source of the language, all ranks. Part ``term``: the ``top`` terms by which the
    source stands out from its language.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    counts = scratch.put(term_counts(docs), "counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(F.col("docs") >= min_docs)
    kept = scratch.put(_numbered(kept.drop("docs"), scratch), "kept")
    scratch.drop("placed")
    size = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    cells = scratch.put(counts.join(kept, ["lang", "term"]), "cells")
    totals = cells.groupBy("lang", "source").agg(F.sum("count").alias("group_total"))
    zero = F.lit(0).cast("long")
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(size, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("group_total", "terms", "lang_total")])
    groups = scratch.put(groups.withColumn("p0", share(zero, F.col("group_total"), F.col("terms"))), "groups")
    cells = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "number", share(F.col("count"), F.col("group_total"), F.col("terms")).alias("p"),
        share(F.col("total"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    cells = scratch.put(cells, "shares")
    maps = bitmaps(cells, groups.select("lang", "source", "p0")).repartition("lang", "word").sortWithinPartitions("lang", "word")
    pairs = maps.select(*[c.split()[0] for c in _LEVELS.split(", ")]).mapInArrow(_compare, _SUMS)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = cells.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(out).union(terms.withColumn("part", F.lit("term")).select(out))


def audit_sql(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    """The same rows in DuckDB SQL over ``documents``, term by term."""
    f = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
    share_of = f"1 + ({SCALE} * ({{c}} + 2)) // ({{n}} + 2 * terms)"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents
), words AS (SELECT row, lang, source, unnest(found) AS term FROM docs
), cells AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM words GROUP BY ALL
), kept AS (SELECT lang, term, count(*)::BIGINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= {min_docs}
), sizes AS (SELECT lang, count(*)::BIGINT AS terms, sum(n)::BIGINT AS lang_n FROM kept GROUP BY lang
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n, terms, lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source)::BIGINT AS group_n
  FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN cells c USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, n, {share_of.format(c="n", n="group_n")} AS p, {share_of.format(c="all_n", n="lang_n")} AS q FROM grid
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum({f.format(p="a.p", q="b.p")})::BIGINT AS value
  FROM shares a JOIN shares b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b USING (lang)
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source WHERE a.source <> b.source
), rows AS (
  SELECT lang, source, 'pair' AS part, item, value FROM every
  UNION ALL
  SELECT lang, source, 'term', term, ({f.format(p="p", q="q")})::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM rows QUALIFY part = 'pair' OR rank <= {top}"""
