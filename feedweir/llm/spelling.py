"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to a few symbols, so a word becomes a shorter-lived string over a small alphabet: two words one edit apart
have reduced words that are equal or one edit apart themselves. Every reduced word's one-edit neighbourhood over the small
alphabet is generated and joined with the reduced vocabulary; what meets is verified on the original strings. A pair of reduced
words is generated from one side only, which loses nothing: the longer word's deletions are the shorter one's
insertions, and a replacement is made from the smaller symbol to the greater one; equal reduced words meet by themselves.
So a pair of words meets under exactly one key, and it becomes a row only once it is verified (the check is the join's condition).
Keys are hashes of the reduced words; a clash of two of them is one more pair to verify and changes nothing else.

Occurrences are counted in the tasks that read the texts, so a word that fills a third of all texts is one row per task.

Edge cases: null texts have no words; a null id is written as an empty text before the colon; repeated rows count again; a word's
letters are code points; a table without words gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweir.llm import words as w
from feedweir.llm.scratch import Scratch

SYMBOLS = 8
MIN_LENGTH = 7
MIN_COUNT = 2
#: How many times more frequent than a word its form is.
FACTOR = 10
#: A run loses a letter where this divides its checksum.
DAMAGE = 31
#: Letters of the longest words that the rows of their neighbourhood carry.
LONG = 64
#: Rows of neighbourhoods given out at once.
ROWS_OUT = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)

_LETTERS = [chr(c) for c in [*range(0x61, 0x7B), *range(0xC0, 0x100)]]
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF, and of these alone
_ASCII = ~w.NON_LETTER
_ASCII[128:] = False


def _inside(buf: np.ndarray) -> np.ndarray:
    lead = buf == _LEAD
    inside = _ASCII[buf] | lead
    inside[1:] |= lead[:-1]
    return inside


def _count(least: int, damage: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = w.Tally(["word"], ["n"])
        for batch in batches:
            ids = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("doc_id").to_pylist()]
            for lo, hi, ws in w.slices(batch.column("text"), _inside):
                points = np.concatenate([[0], np.cumsum((ws.buf & 0xC0) != 0x80)])
                long = points[ws.end] - points[ws.start] >= least  # a shorter run cannot become long enough
                kept = w.Words(ws.buf, ws.offsets, ws.start[long], ws.end[long], np.searchsorted(np.flatnonzero(long), ws.first))
                coded = w.strings(kept).dictionary_encode()
                doc, code, times = w.unique_pairs(kept.doc(), coded.indices.to_numpy().astype(np.int64))
                raw = coded.dictionary.cast(pa.binary()).to_pylist()
                start = np.array(ids[lo:hi], np.int64)[doc].tolist()
                sums = np.fromiter((zlib.crc32(raw[c], s) for c, s in zip(code.tolist(), start, strict=True)), np.int64, len(code))
                whole = sums % damage > 0
                text = coded.dictionary.to_pylist()
                cut = []
                for c, h in zip(code[~whole].tolist(), sums[~whole].tolist(), strict=True):
                    at = h % len(text[c])
                    cut.append(text[c][:at] + text[c][at + 1 :])
                count = np.bincount(code[whole], times[whole], len(text)).astype(np.int64)
                yield from tally.add(pa.table({
                    "word": pa.concat_arrays([coded.dictionary, pa.array(cut, pa.string())]), "n": np.concatenate([count, times[~whole]]),
                }))
        yield from tally.flush()

    return run


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = DAMAGE) -> DataFrame:
    """word, n: the words of at least ``min_length`` letters that occur ``min_count`` times in ``docs`` (doc_id, text)."""
    counts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_count(min_length, damage), "word string, n long")
    counts = counts.groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") >= min_count) & (F.char_length("word") >= min_length))


def symbols_of(symbols: int = SYMBOLS) -> np.ndarray:
    """Symbol of every letter by its code point: its checksum modulo ``symbols``."""
    table = np.zeros(0x100, np.int64)
    for c in _LETTERS:
        table[ord(c)] = zlib.crc32(c.encode()) % symbols
    return table


def neighbourhoods(words: pa.StringArray, symbols: int, own_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, key, is its own) of the reduced words at which each word meets others.

    A key is a polynomial hash of the reduced word, so a deletion or replacement costs one step at any length. Deletions within a run of
    equal symbols give one and the same reduced word, of which the first counts.
    """
    size = pc.utf8_length(words).to_numpy().astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(first[-1]) - first[word]
    letters = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    symbol = symbols_of(symbols)[letters]
    value = w.mix(np.arange(1, symbols + 1, dtype=np.uint64) * _STEP)
    up, down = w.powers(int(size.max(initial=0)) + 1)
    term = value[symbol] * up[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    whole = sums[first[1:]] - sums[first[:-1]]
    key = lambda h, n: w.mix(h + n.astype(np.uint64) * _STEP)
    own = key(whole, size)
    if own_only:
        return np.arange(len(size)), own, np.ones(len(size), bool)
    begins = np.ones(len(symbol), bool)
    begins[1:] = (symbol[1:] != symbol[:-1]) | (word[1:] != word[:-1])
    i = np.flatnonzero(begins)
    who, keys = [np.arange(len(size)), word[i]], [own]
    keys.append(key(sums[i] - sums[first[word[i]]] + (sums[first[word[i] + 1]] - sums[i + 1]) * down[1], size[word[i]] - 1))
    for s in range(1, symbols):
        i = np.flatnonzero(symbol < s)
        who.append(word[i])
        keys.append(key(whole[word[i]] + (value[s] - value[symbol[i]]) * up[place[i]], size[word[i]]))
    who, keys = np.concatenate(who), np.concatenate(keys)
    return who, keys, np.arange(len(keys)) < len(size)


def _keys(symbols: int, carried: str, own_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, keys, own = neighbourhoods(batch.column("word"), symbols, own_only)
            for lo in range(0, len(who), ROWS_OUT):
                at = pa.array(who[lo : lo + ROWS_OUT])
                out = [pa.array(w.signed(keys[lo : lo + ROWS_OUT])), pa.array(own[lo : lo + ROWS_OUT])]
                yield pa.RecordBatch.from_arrays([*out, batch.column(carried).take(at), batch.column("n").take(at)], names=["key", "own", carried, "n"])

    return run


def _met(vocab: DataFrame, symbols: int, carried: str) -> tuple[DataFrame, DataFrame]:
    """(key, own, a, n_a) of the neighbourhoods and (key, b, n_b) of the vocabulary, with ``carried`` of the words."""
    rows = vocab.select(*dict.fromkeys(["word", carried, "n"]))
    kind = dict(rows.dtypes)[carried]
    left, right = (
        rows.mapInArrow(_keys(symbols, carried, own_only), f"key long, own boolean, {carried} {kind}, n long")
        .withColumnsRenamed({carried: side, "n": f"n_{side}"})
        for side, own_only in (("a", False), ("b", True))
    )
    return left, right.drop("own")


def near_words(vocab: DataFrame, symbols: int = SYMBOLS, long: int = LONG) -> DataFrame:
    """a, n_a, b, n_b: every pair of words of ``vocab`` (word, n) that are one edit apart, once.

    Rows of the neighbourhoods carry the word, so that pairs are verified where they meet. Words of more than ``long`` letters
    have too many rows for that: theirs carry a number, and the words are looked up for pairs that have met.
    """
    once = (~F.col("own")) | (F.col("a") < F.col("b"))  # equal reduced words meet from both sides
    size = F.char_length("word")
    left, right = _met(vocab.where(size <= long), symbols, "word")
    short = left.join(right.hint("merge"), "key").where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")
    numbered = vocab.where(size >= long).withColumn("number", F.xxhash64("word"))
    left, right = _met(numbered, symbols, "number")
    pairs = left.join(right.hint("merge"), "key").where(once).select("a", "b").distinct()
    for side in ("a", "b"):
        names = numbered.select(F.col("number").alias(side), F.col("word").alias(f"w_{side}"), F.col("n").alias(f"n_{side}"))
        pairs = pairs.join(names.hint("merge"), side)
    far = F.greatest(F.char_length("w_a"), F.char_length("w_b")) > long
    pairs = pairs.where(far & (F.levenshtein("w_a", "w_b", 1) == 1))
    return short.union(pairs.select(F.col("w_a").alias("a"), "n_a", F.col("w_b").alias("b"), "n_b"))


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root of every row of ``forms`` (word, form): the last of the chain of forms. The way doubles each round."""
    roots = scratch.put(forms.select("word", F.col("form").alias("root")), "roots-0")
    step = 0
    while True:
        nxt = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = roots.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step += 1
        moved = scratch.put(moved, f"roots-{step}")
        scratch.drop(f"roots-{step - 1}")
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return roots


def variants(
    docs: DataFrame, symbols: int = SYMBOLS, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR, damage: int = DAMAGE
) -> DataFrame:
    """``docs`` (doc_id, text) → word, n, n_near, form, form_n, root: one row per word."""
    scratch = Scratch(docs.sparkSession, "spelling")
    vocab = scratch.put(vocabulary(docs, min_length, min_count, damage), "vocabulary")
    pairs = near_words(vocab, symbols)
    best = F.when(F.col("other_n") >= factor * F.col("n"), F.struct((-F.col("other_n")).alias("rest"), F.col("other").alias("form")))
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("other_n")),
    )
    sides = pairs.select(F.inline(both)).select("word", "n", F.lit(1).cast("long").alias("near"), best.alias("best"))
    alone = vocab.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<rest: long, form: string>").alias("best"))
    found = sides.union(alone).groupBy("word").agg(F.first("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    found = scratch.put(found.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.rest")).alias("form_n")), "found")
    scratch.drop("vocabulary")
    roots = _roots(found.where("form IS NOT NULL"), scratch)
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants_sql(min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR, damage: int = DAMAGE) -> str:
    """The same rows in DuckDB SQL over ``documents``; the checksum goes byte by byte, pairs meet at equal gaps."""
    step = "xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)"
    crc = (
        "list_reduce(list_prepend(4294967295, list_transform(range(strlen(line)), "
        "lambda i: (strpos('0123456789ABCDEF', hx[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', hx[2 * i + 2]) - 1)), "
        "lambda c, b: xor(c // 256, crc_table[xor(c % 256, b) + 1]))"
    )
    return rf"""
WITH RECURSIVE t AS (
  SELECT list(v ORDER BY n) AS crc_table FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: {step}) AS v FROM (SELECT unnest(range(256)) AS n))
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), runs AS (
  SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS line, count(*)::BIGINT AS times FROM found WHERE length(run) >= {min_length} GROUP BY ALL
), hexed AS (SELECT *, hex(encode(line)) AS hx FROM runs
), summed AS (SELECT run, times, xor({crc}, 4294967295) AS h FROM hexed, t
), whole AS (
  SELECT CASE WHEN h % {damage} > 0 THEN run ELSE substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) END AS word, times FROM summed
), vocab AS (
  SELECT word, sum(times)::BIGINT AS n FROM whole WHERE length(word) >= {min_length} GROUP BY word HAVING sum(times) >= {min_count}
), gaps AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS gap FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocab)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.gap = b.gap AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN vocab b ON a.gap = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN vocab b ON a.gap = b.word
), ranked AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near
), forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= {factor} * v.n THEN other END AS form,
    CASE WHEN other_n >= {factor} * v.n THEN other_n END AS form_n FROM vocab v LEFT JOIN ranked r ON r.word = v.word AND place = 1
), chain AS (
  SELECT word, coalesce(form, word) AS root, form IS NULL AS done FROM forms
  UNION ALL
  SELECT c.word, coalesce(f.form, f.word), f.form IS NULL FROM chain c JOIN forms f ON f.word = c.root WHERE NOT c.done
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, c.root FROM forms f JOIN chain c ON c.word = f.word WHERE c.done"""
