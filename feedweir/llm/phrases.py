"""Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words of one text. A word is removed when a window that covers it also begins in a
document with a smaller id. The steps, each linear in the words that take part:

1. Every window holds an *anchor*, the n-gram of smallest hash among its n-grams (the last of equal ones), so equal windows
   share their anchor. Only anchors, about one in twenty words, are shuffled; those of two documents or more *recur*.
   Word-for-word copies of an earlier document are settled here and take no further part.
2. Windows round recurring anchors are hashed (128 bits) and grouped: a window of two documents is *confirmed*, its home is
   the first of them. Confirmed windows that follow each other in their home form passages, cut into bounded pieces.
3. Documents with recurring anchors are dealt into shards of bounded size. A shard gets the passages of which one of its
   documents after the home holds a confirmed window, and compiles them into Aho-Corasick automata of bounded words: phrases
   of half a window at such a stride that every window of a passage holds a whole phrase. All texts of the shard run through
   each; each hit is extended word by word against the passage, and matches of at least a window, from all automata together,
   remove their words. So hashes only propose, words decide.

A frequent passage has one home and is one pattern per shard, whatever the number of documents that hold it. A window of a
document calls for one passage at most, so the passages of all shards are linear in the input, also where one phrase stands in
many different passages.

Edge cases: null and empty texts have no words and lose none; texts shorter than a window lose none; a null id counts as
larger than every id; rows with the same id are not earlier than each other; repeated rows get the same answer each; other
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedweir.llm import words as w
from feedweir.llm.scratch import Scratch

WINDOW = 50
#: Words of an anchor n-gram.
GRAM = 8
#: Windows in one piece of a passage.
PIECE = 200
#: Bytes of text in one shard.
SHARD_BYTES = 8 << 20
#: Words of the passages in one automaton; each has a code point of its own at most, of which there are 1,056,768.
AUTOMATON_WORDS = 500_000
LAST_ID = (1 << 63) - 1

_SEEN = "id long, doc_id long, tag string, n_words long, k1 long, k2 long, whole_sha256 string, anchors array<long>"
_WINDOWS = "h1 long, h2 long, id long, shard long"
_PASSAGES = "home long, passage string, windows array<long>"
_FOUND = "id long, tag string, n_removed long, kept_sha256 string, kept string"


def _key(group: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One value for (row, value), to look up many rows' sets at once."""
    return w.mix(values + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _members(group: np.ndarray, values: np.ndarray, sets: pa.ListArray) -> np.ndarray:
    """Which (row, value) have the value in the set of their row."""
    ends = sets.offsets.to_numpy()
    held = sets.values.to_numpy(zero_copy_only=False).view(np.uint64)[ends[0] : ends[-1]]
    keys = np.unique(_key(np.repeat(np.arange(len(sets)), np.diff(ends)), held))
    if not len(keys):
        return np.zeros(len(values), bool)
    asked = _key(group, values)
    return keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked


def _anchored(ws: w.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word index of each window, hash of its anchor, word hashes)."""
    h = ws.hashes()
    g = w.grams(h, gram)
    at = w.fits(ws, window)
    if not len(at):
        return at, np.zeros(0, np.uint64), h
    return at, g[w.rightmost_minima(g, window - gram + 1)[at]], h


def _survey(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ws in w.slices(batch.column("text")):
                at, anchor, h = _anchored(ws, window, gram)
                h2 = ws.hashes(1)
                doc, anchor, _ = w.unique_pairs(ws.doc()[at], anchor)
                bounds = ws.offsets
                whole = [
                    hashlib.sha256(b" ".join(ws.buf[bounds[d] : bounds[d + 1]].tobytes().split())).hexdigest() for d in range(hi - lo)
                ]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("doc_id"), part.column("tag"), pa.array(ws.counts.astype(np.int64)),
                        pa.array(w.signed(w.whole(h, ws.first))), pa.array(w.signed(w.whole(h2, ws.first, 1))),
                        pa.array(whole, pa.string()), w.lists(w.signed(anchor), doc, hi - lo, pa.int64()),
                    ],
                    names=["id", "doc_id", "tag", "n_words", "k1", "k2", "whole_sha256", "anchors"],
                )

    return run


def _windows(window: int, gram: int):
    """Distinct windows of each document whose anchor recurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shards = batch.column("id").to_numpy(), batch.column("shard").to_numpy()
            for lo, hi, ws in w.slices(batch.column("text")):
                at, anchor, h = _anchored(ws, window, gram)
                doc = ws.doc()[at]
                keep = _members(doc, anchor, batch.column("anchors").slice(lo, hi - lo))
                at, doc = at[keep], doc[keep]
                if not len(at):
                    continue
                h1, h2 = w.grams(h, window)[at], w.grams(ws.hashes(1), window, 1)[at]
                order = np.lexsort((h2, h1, doc))
                d, a, b = doc[order], h1[order], h2[order]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                at = lo + d[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.signed(a[new])), pa.array(w.signed(b[new])), pa.array(ids[at]), pa.array(shards[at])],
                    names=["h1", "h2", "id", "shard"],
                )

    return run


def _passages(window: int, gram: int):
    """Runs of confirmed windows in their home, as words joined by one space, with the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            homes, texts, held = [], [], []
            for lo, hi, ws in w.slices(batch.column("text")):
                at, _, h = _anchored(ws, window, gram)
                doc = ws.doc()[at]
                windows = w.grams(h, window)[at] if len(at) else np.zeros(0, np.uint64)
                keep = _members(doc, windows, batch.column("windows").slice(lo, hi - lo))
                at, doc, windows = at[keep], doc[keep], windows[keep]
                _, first = np.unique(_key(doc, windows), return_index=True)  # a window of a text is kept where it stands first
                first.sort()
                at, doc, windows = at[first], doc[first], windows[first]
                cuts = np.flatnonzero((np.diff(at) != 1) | (np.diff(doc) != 0)) + 1
                for a, b in zip(np.append(0, cuts), np.append(cuts, len(at)), strict=True):
                    for s in range(a, b, PIECE):
                        e = min(b, s + PIECE)
                        i, j = at[s], at[e - 1] + window
                        homes.append(ids[lo + doc[s]])
                        texts.append(b" ".join(ws.buf[ws.start[i] : ws.end[j - 1]].tobytes().split()).decode())
                        held.append(w.signed(windows[s:e]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(homes, pa.int64()), pa.array(texts, pa.string()), pa.array(held, pa.list_(pa.int64()))],
                names=["home", "passage", "windows"],
            )

    return run


class Automaton:
    """Aho-Corasick automaton of the phrases of some passages.

    The alphabet is the passages' words, one code point each; words outside it are code point 0. Phrases are ``half``
    words at a stride of ``window - half + 1``, so that each window of a passage holds one of them whole.
    """

    def __init__(self, homes: list[int], passages: list[str], window: int):
        self.window, self.half = window, (window + 1) // 2
        self.homes = homes
        self.code: dict[bytes, str] = {}
        self.passages = [
            "".join(self.code.setdefault(x, chr(0xE000 + len(self.code))) for x in passage.encode().split(b" ")) for passage in passages
        ]
        self.places: list[list[tuple[int, int]]] = []
        self.automaton = ahocorasick.Automaton()
        known: dict[str, int] = {}
        for p, text in enumerate(self.passages):
            for o in range(0, len(text) - self.half + 1, window - self.half + 1):
                phrase = text[o : o + self.half]
                if phrase not in known:
                    known[phrase] = len(self.places)
                    self.places.append([])
                    self.automaton.add_word(phrase, known[phrase])
                self.places[known[phrase]].append((p, o))
        if known:
            self.automaton.make_automaton()

    def spans(self, words: list[bytes], before: int) -> list[tuple[int, int]]:
        """Maximal matches of at least a window with passages whose home is smaller than ``before``."""
        if not self.places:
            return []
        code, n = self.code, len(words)
        text = "".join([code.get(x, "\0") for x in words])
        found, done = [], {}
        for last, phrase in self.automaton.iter(text):
            at = last - self.half + 1
            for p, o in self.places[phrase]:
                if self.homes[p] >= before or done.get((p, at - o), -1) >= last:
                    continue
                passage = self.passages[p]
                left, most = 0, min(at, o)
                if text[at - most : at] == passage[o - most : o]:
                    left = most
                else:
                    while text[at - left - 1] == passage[o - left - 1]:
                        left += 1
                stop, end = last + 1, o + self.half
                most = min(n - stop, len(passage) - end)
                if text[stop : stop + most] == passage[end : end + most]:
                    right = most
                else:
                    right = 0
                    while text[stop + right] == passage[end + right]:
                        right += 1
                done[p, at - o] = last + right
                if left + self.half + right >= self.window:
                    found.append((at - left, stop + right))
        return found


def automata(homes: list[int], passages: list[str], window: int, limit: int) -> Iterator[Automaton]:
    """The passages in automata of at most ``limit`` words, or one passage where it is longer."""
    lo, held = 0, 0
    for i, passage in enumerate(passages):
        n = passage.count(" ") + 1
        if i > lo and held + n > limit:
            yield Automaton(homes[lo:i], passages[lo:i], window)
            lo, held = i, 0
        held += n
    if passages:
        yield Automaton(homes[lo:], passages[lo:], window)


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[int, str, str]:
    """(words removed, sha256 of the kept words joined by one space, text without the removed words)."""
    raw = text.encode()
    buf = np.frombuffer(raw, np.uint8)
    ws = w.split(buf, np.array([0, len(buf)]))
    words = raw.split()
    edge = np.zeros(len(words) + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    kept = b" ".join([x for x, g in zip(words, gone.tolist(), strict=True) if not g])
    change = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    starts = np.append(ws.start, len(raw))
    pieces, at = [], 0
    for a, b in zip(change[::2], change[1::2], strict=True):
        pieces.append(raw[at : starts[a]])
        at = starts[b]
    return int(gone.sum()), hashlib.sha256(kept).hexdigest(), b"".join([*pieces, raw[at:]]).decode()


def _stream(window: int, limit: int):
    def run(docs: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(docs))]
        for automaton in automata(passages["home"].tolist(), passages["passage"].tolist(), window, limit):
            for own, i, text in zip(spans, docs["id"], docs["text"], strict=True):
                own += automaton.spans(text.encode().split(), i)
        rows = [(i, tag, *_cut(text, own)) for i, tag, text, own in zip(docs["id"], docs["tag"], docs["text"], spans, strict=True)]
        return pd.DataFrame(rows, columns=["id", "tag", "n_removed", "kept_sha256", "kept"])

    return run


def tag(text: Column) -> Column:
    """Names a text among the rows of one id."""
    return F.md5(F.coalesce(text, F.lit("")))


def routed(passages: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(part, home, passage): each passage once for every shard in which a document after its home holds one of its windows."""
    wanted = (
        passages.select("passage_id", "home", F.explode("windows").alias("h1"))
        .join(confirmed.where("last > home").select("home", "h1", "shard"), ["home", "h1"])
        .select("passage_id", F.col("shard").alias("part")).distinct()
    )
    return wanted.join(passages.select("passage_id", "home", "passage"), "passage_id").select("part", "home", "passage")


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, automaton_words: int = AUTOMATON_WORDS
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text).

    → doc_id, tag (see ``tag``), n_words, n_removed, kept_sha256 and ``kept``: the text without the removed words, null where
    none was removed.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "phrases")
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"),
        tag(F.col("text")).alias("tag"), F.coalesce("text", F.lit("")).alias("text"),
    )
    seen = scratch.put(texts.mapInArrow(_survey(window, gram), _SEEN), "seen")
    keys = ["k1", "k2", "n_words"]
    firsts = seen.where(F.col("n_words") >= window).groupBy(*keys).agg(F.min("id").alias("first"))
    is_copy = F.col("id") > F.coalesce("first", F.lit(LAST_ID))
    marked = scratch.put(
        seen.join(firsts, keys, "left").select(
            "id", "doc_id", "tag", "n_words", "whole_sha256", is_copy.alias("copy"), F.when(~is_copy, F.col("anchors")).alias("anchors")
        ),
        "marked",
    )
    scratch.drop("seen")

    # anchors of two documents or more
    anchors = marked.select("id", "tag", F.explode("anchors").alias("anchor"))
    recurring = scratch.put(
        anchors.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor"), "recurring"
    )
    flags = anchors.join(recurring, "anchor").groupBy("id", "tag").agg(F.collect_set("anchor").alias("anchors"))
    flagged = scratch.put(texts.select("id", "tag", "text").join(flags, ["id", "tag"]), "flagged")

    size = flagged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    dealt = flagged.select("id", "tag", "text", "anchors", F.pmod(F.xxhash64("id", "tag"), F.lit(shards)).cast("long").alias("shard"))

    # confirmed windows, their homes and the last document of each shard that holds them
    windows = dealt.select("id", "text", "anchors", "shard").mapInArrow(_windows(window, gram), _WINDOWS)
    held = windows.groupBy("h1", "h2", "shard").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    same = W.partitionBy("h1", "h2")
    confirmed = scratch.put(
        held.select("h1", "shard", "last", F.min("first").over(same).alias("home"), F.max("last").over(same).alias("end"))
        .where("home < end").drop("end"),
        "confirmed",
    )
    homes = confirmed.groupBy(F.col("home").alias("id")).agg(F.collect_set("h1").alias("windows"))
    passages = flagged.select("id", "text").join(homes, "id").mapInArrow(_passages(window, gram), _PASSAGES)
    passages = scratch.put(passages.withColumn("passage_id", F.monotonically_increasing_id()), "passages")

    # automata by shard
    found = (
        dealt.select("shard", "id", "tag", "text").groupBy("shard")
        .cogroup(routed(passages, confirmed).groupBy("part")).applyInPandas(_stream(window, automaton_words), _FOUND)
        .where("id is not null").dropDuplicates(["id", "tag"])
    )
    nothing = hashlib.sha256(b"").hexdigest()
    joined = marked.drop("anchors").join(found, ["id", "tag"], "left")
    return joined.select(
        "doc_id", "tag", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).when(F.col("n_removed") > 0, F.col("kept")).alias("kept"),
    )


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with repeated passages cut out of their texts and ``n_chars`` counted anew; every row stays."""
    cut = remove_repeats(docs, window).where("kept is not null").select("doc_id", "tag", "kept").dropDuplicates(["doc_id", "tag"])
    cut = cut.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "tag", "kept")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id")
    joined = docs.select(F.struct("*").alias("row"), id_, tag(F.col("text")).alias("tag")).join(cut, ["id", "tag"], "left")
    old, kept = F.col("row"), F.col("kept")
    new = {"text": F.coalesce(kept, old["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(kept.isNotNull(), F.char_length(kept)).otherwise(old["n_chars"])
    return joined.select(*[new.get(f.name, old[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema])
