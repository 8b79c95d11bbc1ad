"""Exact top-k BM25 over an inverted index in shards, for many queries at once, pruned by the score to reach.

Every shard holds the postings of a bounded number of documents as sorted arrays, written to the shared folder; statistics
(row count, mean length, document frequencies) are summed over all shards, so scores do not depend on the sharding. Documents of a
shard are ordered by their most frequent word and length.

Queries meet a shard in groups. Its frequent words are rows over all its documents and meet a group as a product of matrices in single
precision, its rarer words' postings are added up for several queries in one pass. The sum, with what single precision may be off,
bounds each document; those whose bound reaches the score to beat are scored exactly. Nothing is approximate: the k best of each
shard are exact and so is their merger. Scores are rounded to ``DIGITS`` places before they are compared, ties go to the smaller id.

This is no WAND. Queries are whole texts of hundreds of words: with the k-th best score of 32,000 documents to beat, a pivot need not
open the words of the least maxima, which hold 0.55 of the postings (measured); they are frequent words, which cost least here.

Queries pass in blocks of bounded bytes. A block runs over the shards in waves, each twice as large as all before it, and with every
query goes its k-th best score so far: a shard leaves out what does not reach it.

Words are runs of ASCII letters, digits, underscores and non-ASCII characters, in lower case. Edge cases: null and empty texts
match nothing; fewer than k matching documents give fewer rows; repeated rows are found each; null ids sort first; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedweir.llm import words as w
from feedweir.llm.scratch import Scratch

K = 10
K1, B = 1.2, 0.75
DIGITS = 6
SHARD_ROWS = 4096
#: Words in this share of a shard's documents are kept as rows of impacts, which meet a group of queries as matrices.
FREQUENT = 1 / 20
#: Queries multiplied at once, and postings of rarer words added up at once.
GROUP = 256
POSTINGS = 1 << 17
#: Pairs of a query and a document scored exactly at once.
EXACT = 4096
#: Bytes of queries broadcast at once.
QUERY_BYTES = 32 << 20
#: Shards searched before a query has a score to reach.
FIRST_WAVE = 4

_INDEX = "shard int, n_docs long, n_words long, ids binary, known binary, lengths binary, terms binary, starts binary, docs binary, tfs binary"
_ARRAYS = ("ids", "known", "lengths", "terms", "starts", "docs", "tfs")
_HITS = "query_id long, doc_id long, score double"


def _index(key: tuple, table: pa.Table) -> pa.Table:
    """One row: the index of a shard's documents."""
    docs, terms, tfs, lengths, base = [], [], [], [], 0
    for lo, hi, ws in w.slices(table.column("text"), w.NON_WORD):
        d, t, n = w.unique_pairs(ws.doc(), ws.hashes())
        docs.append((d + base).astype(np.int32))
        terms.append(t)
        tfs.append(n.astype(np.int32))
        lengths.append(ws.counts)
        base += hi - lo
    doc, term, tf, length = (np.concatenate(x) for x in (docs, terms, tfs, lengths))
    del docs, terms, tfs
    top = np.zeros(base, np.uint64)
    by_count = np.argsort(tf, kind="stable")
    top[doc[by_count]] = term[by_count]
    del by_count
    order = np.lexsort((length, top))  # new place -> row
    place = np.empty(base, np.int32)
    place[order] = np.arange(base)
    doc = place[doc]
    sort = np.lexsort((doc, term))
    doc, term, tf = doc[sort], term[sort], tf[sort]
    del sort
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    ids = table.column("doc_id").combine_chunks()
    known = ids.is_valid().to_numpy(zero_copy_only=False)[order]
    small = np.uint16 if base <= 1 << 16 and (not len(tf) or tf.max() < 1 << 16) else np.uint32
    cells = [
        ids.fill_null(0).to_numpy()[order].astype("<i8"), known.astype(np.uint8), length[order].astype("<i8"), term[first],
        np.append(first, len(term)).astype("<i8"), doc.astype(small), tf.astype(small),
    ]
    shard = key[0].as_py()
    return pa.table(
        [[shard], [base], [int(length.sum())], *[[c.tobytes()] for c in cells]],
        schema=pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_words", pa.int64()), *[(c, pa.binary()) for c in _ARRAYS]]),
    )


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, starts in zip(batch.column("terms").to_pylist(), batch.column("starts").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(terms, np.int64)), pa.array(np.diff(np.frombuffer(starts, "<i8")))], names=["term", "df"]
            )


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("query_id").to_numpy()
        for lo, _, ws in w.slices(batch.column("text"), w.NON_WORD):
            d, t, n = w.unique_pairs(ws.doc(), ws.hashes())
            yield pa.RecordBatch.from_arrays([pa.array(ids[lo + d]), pa.array(w.signed(t)), pa.array(n)], names=["query_id", "term", "n"])


@dataclass
class Queries:
    """A block of queries: words of query ``i`` are the entries ``first[i]`` to ``first[i + 1]`` of ``word`` (a place in ``words``) and ``weight``.

    Queries are ordered by the commonest of their words: neighbours are of one language and share their frequent words.
    """

    ids: np.ndarray
    first: np.ndarray
    words: np.ndarray
    word: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Queries:
        ids, terms, weight = (rows.column(c).combine_chunks() for c in ("query_id", "term", "weight"))
        sizes = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words, word = np.unique(terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), return_inverse=True)
        query, weight = np.repeat(np.arange(len(sizes)), sizes), weight.flatten().to_numpy(zero_copy_only=False).astype(float)
        common = np.zeros(len(sizes), np.int64)
        np.maximum.at(common, query, np.bincount(word)[word] * len(words) + word)
        order = np.argsort(common, kind="stable")
        entry = np.argsort(np.argsort(order)[query], kind="stable")
        return cls(ids.to_numpy()[order], np.append(0, np.cumsum(sizes[order])), words, word[entry].astype(np.int32), weight[entry])


class Shard:
    """A shard's arrays: postings with their impacts, and the counts of frequent words as rows over all documents."""

    def __init__(self, row: dict, mean_length: float):
        self.ids, self.known = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], np.uint8)
        self.n = len(self.ids)
        self.terms, self.starts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["starts"], "<i8")
        kind = np.uint16 if len(row["docs"]) == 2 * int(self.starts[-1]) else np.uint32
        self.docs, tf = np.frombuffer(row["docs"], kind), np.frombuffer(row["tfs"], kind)
        self.norm = K1 * (1 - B + B * np.frombuffer(row["lengths"], "<i8") / max(mean_length, 1e-9))
        self.impact = _impact(tf, self.norm[self.docs])
        often = np.flatnonzero(np.diff(self.starts) >= max(1, self.n * FREQUENT))
        self.often = np.full(len(self.terms), -1)
        self.often[often] = np.arange(len(often))
        self.counts = np.zeros((len(often), self.n), kind)
        for i, t in enumerate(often):
            a, b = self.starts[t], self.starts[t + 1]
            self.counts[i, self.docs[a:b]] = tf[a:b]
        self.rows = np.empty(self.counts.shape, np.float32)
        for i, counts in enumerate(self.counts):
            self.rows[i] = _impact(counts, self.norm)
        #: How far, as a share of it, a sum of products in single precision may be off.
        self.off = (len(often) + 8) * 2.0**-23

    def best(self, asked: Queries, floors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of queries, places, rounded scores): the k best documents of each query, of those that score its floor or more."""
        at = np.minimum(np.searchsorted(self.terms, asked.words), max(len(self.terms) - 1, 0))
        at[self.terms[at] != asked.words if len(self.terms) else slice(None)] = -1
        sizes = np.diff(self.starts)
        for lo in range(0, len(asked.ids), GROUP):
            hi = min(len(asked.ids), lo + GROUP)
            entries = slice(asked.first[lo], asked.first[hi])
            place = at[asked.word[entries]]
            here = np.flatnonzero(place >= 0)
            query = np.repeat(np.arange(lo, hi), np.diff(asked.first[lo : hi + 1]))[here]
            place, weight = place[here], asked.weight[entries][here]
            row = self.often[place]
            seldom, often = row < 0, row >= 0
            rare = query[seldom], self.starts[place[seldom]], sizes[place[seldom]], weight[seldom]
            frequent = query[often], row[often], weight[often]
            used, column = np.unique(frequent[1], return_inverse=True)
            matrix = np.zeros((hi - lo, len(used)), np.float32)
            matrix[frequent[0] - lo, column] = frequent[2]
            dense = matrix @ self.rows[used]
            postings = np.append(0, np.cumsum(np.bincount(rare[0] - lo, rare[2], minlength=hi - lo)))
            a = 0
            while a < hi - lo:
                b = max(a + 1, int(np.searchsorted(postings, postings[a] + POSTINGS, "right")) - 1)
                yield self._of_group(lo + a, lo + b, rare, frequent, dense[a:b], floors[lo + a : lo + b], k)
                a = b

    def _within(self, least):
        """What a sum of single precision is at least where the score, rounded, is ``least`` or more, and more than nothing."""
        return (np.maximum(least, 1.4 * 10.0**-DIGITS) - 10.0**-DIGITS) / (1 + self.off)

    def _of_group(self, lo: int, hi: int, rare: tuple, frequent: tuple, dense: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = np.searchsorted(rare[0], [lo, hi])
        query, start, size, weight = (x[a:b] for x in rare)
        flat = np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) if len(size) else np.zeros(0, np.int64)
        flat += np.arange(len(flat))
        cell = np.repeat((query - lo) * self.n, size)
        cell += self.docs.take(flat, mode="clip")
        value = self.impact.take(flat, mode="clip")
        value *= np.repeat(weight, size)
        part = np.bincount(cell, value, minlength=(hi - lo) * self.n).reshape(hi - lo, self.n)
        score = part + dense
        hits = np.flatnonzero(score >= self._within(floors)[:, None])
        part, score = part.ravel()[hits], score.ravel()[hits]
        query = hits // max(self.n, 1)
        ends = np.searchsorted(query, np.arange(hi - lo + 1))
        crowded = np.flatnonzero(np.diff(ends) > 4 * k)
        if len(crowded):
            kept = np.ones(len(hits), bool)
            for i in crowded:
                these = slice(ends[i], ends[i + 1])
                kept[these] = score[these] >= self._within(np.partition(score[these], -k)[-k] * (1 - self.off))
            hits, part, query = hits[kept], part[kept], query[kept]
        places = hits - query * self.n
        exact = np.concatenate([np.zeros(0)] + [self._exact(lo + query[i : i + EXACT], places[i : i + EXACT], part[i : i + EXACT], frequent) for i in range(0, len(hits), EXACT)])
        kept = np.flatnonzero((exact > 0) & (exact >= floors[query]))
        query, places, exact = query[kept], places[kept], exact[kept]
        order = np.lexsort((self.ids[places], self.known[places], -exact, query))
        order = order[np.arange(len(order)) - np.searchsorted(query, query) < k]  # queries are in order before and after
        return lo + query[order], places[order], exact[order]

    def _exact(self, query: np.ndarray, places: np.ndarray, part: np.ndarray, frequent: tuple) -> np.ndarray:
        """Rounded scores of pairs of a query and a document, whose rarer words give ``part``."""
        a, b = np.searchsorted(frequent[0], query), np.searchsorted(frequent[0], query, "right")
        pair = np.repeat(np.arange(len(query)), b - a)
        entry = np.arange(len(pair)) + np.repeat(a - np.append(0, np.cumsum(b - a)[:-1]), b - a)
        impacts = _impact(self.counts[frequent[1][entry], places[pair]], self.norm[places[pair]])
        return np.round(part + np.bincount(pair, impacts * frequent[2][entry], minlength=len(query)), DIGITS)


def _impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return tf * (K1 + 1) / (tf + norm)


def _search(block, floors, mean_length: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = block.value
        for batch in batches:
            for i in range(batch.num_rows):
                # one shard at a time, its arrays are views of the batch
                shard = Shard({c: batch.column(c)[i].as_buffer() for c in _ARRAYS}, mean_length)
                found = [
                    (asked.ids[query], shard.ids[places], shard.known[places] == 0, score)
                    for query, places, score in shard.best(asked, floors.value, k)
                ]
                q, ids, null, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0)] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.astype(np.int64)), pa.array(ids.astype(np.int64), mask=null.astype(bool)), pa.array(score.astype(float))],
                    names=["query_id", "doc_id", "score"],
                )
                del shard, found  # before the next shard's arrays are made

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """→ query_id, doc_id, score, rank: the ``k`` best rows of ``docs`` (doc_id, text) for each row of ``queries`` (query_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    shards = max(1, -(-rows.count() // shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text", F.rand(7)), F.lit(shards)).cast("int"))
    index = scratch.put(dealt.groupBy("shard").applyInArrow(_index, _INDEX), "index", maxRecordsPerFile=1)  # a shard is a task's least
    size = index.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("words")).first()
    n, mean_length = size["n"] or 0, (size["words"] or 0) / max(1, size["n"] or 0)

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    asked = scratch.put(asked.where("query_id is not null").mapInArrow(_query_terms, "query_id long, term long, n long"), "asked")
    wanted = asked.select("term").distinct()
    df = index.select("terms", "starts").mapInArrow(_frequencies, "term long, df long").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.groupBy("query_id", "term").agg(F.sum("n").alias("n")).join(df, "term").select("query_id", "term", (F.col("n") * idf).alias("weight"))
    listed = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("words"))
    listed = scratch.put(listed.select("query_id", "words.term", "words.weight", (F.size("words") * 16).alias("bytes")), "queries")

    # blocks of queries: a block's bytes are bounded, so what is broadcast is
    total = listed.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-total // query_bytes))
    hits = []
    for i in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        asked = Queries.of(part.select("query_id", "term", "weight").toArrow())
        shared = spark.sparkContext.broadcast(asked)
        found: list[DataFrame] = []
        for lo, hi in waves(shards):
            floors = spark.sparkContext.broadcast(_floors(asked.ids, found, k))
            some = index.where((F.col("shard") >= lo) & (F.col("shard") < hi))
            found.append(scratch.put(some.mapInArrow(_search(shared, floors, mean_length, k), _HITS), f"hits-{i}-{lo}"))
            floors.unpersist()
        shared.unpersist()
        hits += found
    return _ranked(hits, k)


def waves(shards: int, first: int = FIRST_WAVE) -> list[tuple[int, int]]:
    """Ranges of shards, each twice as many as all before it: a wave starts from what the query's k-th best score is so far.

    Shards are random parts of the rows, so about 2 * k rows of a wave reach that score: hits grow with the queries and the number of
    waves, not with the number of shards.
    """
    out, lo = [], 0
    while lo < shards:
        hi = min(shards, max(first, 3 * lo))
        out.append((lo, hi))
        lo = hi
    return out


def _ranked(hits: list[DataFrame], k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = reduce(DataFrame.union, hits).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= k)


def _floors(ids: np.ndarray, hits: list[DataFrame], k: int) -> np.ndarray:
    """The k-th best score of every query that has k hits: one number per query."""
    floors = np.full(len(ids), -np.inf)
    if hits:
        rows = _ranked(hits, k).where(F.col("rank") == k).select("query_id", "score").toArrow()
        order = np.argsort(ids)
        floors[order[np.searchsorted(ids[order], rows.column("query_id").to_numpy())]] = rows.column("score").to_numpy()
    return floors
