"""Toxicity scores: logistic regression on hashed word n-grams and skip-grams, learnt by FTRL-proximal.

Features of a text are the distinct buckets of its words, of its pairs of neighbouring words and of its pairs with one word
between. Every coordinate has its own learning rate, and the L1 term keeps most weights at exactly zero, so that a model is a
few thousand (bucket, weight) pairs and is broadcast; a coordinate takes part only if enough of the fitted documents hold it.

Fitting: a sample of at most about ``max_fit`` labelled documents is dealt to ``SHARDS`` shards by a hash of the id. In each epoch every
shard's task takes its documents one by one from the common state, and the states that come out are averaged in Spark. The
driver holds one byte per bucket for the counts of a shard and one state of the coordinates that take part, never a
document. Scoring reads every text once and shuffles nothing.

Labels reach the model only through rows outside the held-out quarter. Edge cases: null and empty texts have no features and get the
score of the bias; null ids are never held out and never labelled; of rows of one id one is fitted, all are scored; a document
with several label rows counts as their mean; without labelled rows every score is 0; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir.llm import words as w
from feedweir.llm.scratch import Scratch

BITS = 22
ALPHA, BETA, L1, L2 = 4.0, 1.0, 1.5, 0.0
EPOCHS = 4
SHARDS = 8
#: Labelled documents that are fitted, about.
MAX_FIT = 20_000
#: Fitted documents that hold a coordinate which takes part.
MIN_DOCS = 10
THRESHOLD = 0.3

_GAPS = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xC2B2AE3D27D4EB4F)}
_FIT = "doc_id long, y double, features array<int>"


def buckets(ws: w.Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word, pair of neighbours and pair with one word between of a slice."""
    h = w.Words(w.LOWER[ws.buf], ws.offsets, ws.start, ws.end, ws.first).hashes()
    doc = ws.doc()
    texts, found = [doc], [h]
    for gap, factor in _GAPS.items():
        if len(h) > gap:
            own = doc[gap:] == doc[:-gap]
            texts.append(doc[gap:][own])
            found.append(w.mix(h[:-gap][own] * factor + h[gap:][own]))
    return np.concatenate(texts), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)


def features(ws: w.Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (text, bucket) of a slice."""
    text, bucket = buckets(ws)
    cell = np.unique((text << BITS) | bucket)
    return cell >> BITS, cell & ((1 << BITS) - 1)


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class State:
    """FTRL-proximal: sums of shifted gradients ``z`` and of squared gradients ``n`` by coordinate; the last one is the bias."""

    z: np.ndarray
    n: np.ndarray

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, y: float) -> None:
        """One document with the coordinates ``at`` and label ``y``."""
        weight = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(weight.sum(), -35, 35))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * weight
        self.n[at] = n + g * g


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, ws in w.slices(batch.column("text"), w.NON_LETTER):
            part = batch.slice(lo, hi - lo)
            text, bucket = features(ws)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("y"), w.lists(bucket.astype(np.int32), text, hi - lo, pa.int32()), part.column("text_hash")],
                names=["doc_id", "y", "features", "text_hash"],
            )


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Features and labels of the documents of a shard, in the order of their ids, one shard after the other."""
    held: list[pa.RecordBatch] = []

    def out():
        table = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()
        lists = table.column("features").combine_chunks()
        return np.split(lists.flatten().to_numpy(), lists.offsets.to_numpy()[1:-1]), table.column("y").to_numpy()

    for batch in batches:
        shard = batch.column("shard").to_numpy()
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1), len(shard)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                if held and held[-1].column("shard")[0].as_py() != shard[lo]:
                    yield out()
                    held = []
                held.append(batch.slice(lo, hi - lo))
    if held:
        yield out()


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte per bucket: how many documents of a shard hold it, 255 at most."""
    for rows, _ in _shards(batches):
        count = np.zeros(1 << BITS, np.int64)
        for f in rows:
            count[f] += 1
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(count, 255).astype(np.uint8).tobytes()])], names=["seen"])


def _epoch(state, included):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[included.value] = np.arange(len(included.value), dtype=np.int32)
        for rows, labels in _shards(batches):
            own = State(*(x.copy() for x in state.value))
            bias = np.array([len(included.value)])
            for f, y in zip(rows, labels, strict=True):
                at = place[f]
                own.learn(np.concatenate([at[at >= 0], bias]), y)
            for lo in range(0, len(own.z), 1 << 16):
                hi = min(len(own.z), lo + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo, hi, dtype=np.int32)), pa.array(own.z[lo:hi]), pa.array(own.n[lo:hi])], names=["i", "z", "n"])

    return run


@dataclass
class Model:
    """The buckets whose weight is not zero, their weights and the bias."""

    bucket: np.ndarray
    weight: np.ndarray
    bias: float


def sample(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """doc_id, y, features, shard of the labelled documents to fit: one row per id."""
    marks = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("toxic").alias("y"))
    scratch = Scratch(docs.sparkSession, "toxicity-labels")
    marks = scratch.put(marks, "marks")
    turns = 1 << 30
    below = turns * min(1.0, max_fit / max(marks.count(), 1))
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(turns)) < int(below))
    # about max_fit ids and numbers, so they go to the texts and not the texts to them
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(chosen), "doc_id")
    found = rows.select("doc_id", "y", "text", "text_hash").mapInArrow(_labelled, f"{_FIT}, text_hash long")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("y", "features"), "text_hash").alias("row")).select("doc_id", "row.*")
    one = one.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SHARDS)).cast("int"))
    return scratch.put(one.repartition(SHARDS, "shard").sortWithinPartitions("shard"), "sample")


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, epochs: int = EPOCHS, min_docs: int = MIN_DOCS) -> Model | None:
    """Learn from the labelled rows outside the held-out quarter; None where there are none."""
    rows = sample(docs, labels, max_fit)
    context = docs.sparkSession.sparkContext
    total = np.zeros(1 << BITS, np.int32)
    shards = rows.select("shard", "doc_id", "y", "features")
    for r in shards.mapInArrow(_seen, "seen binary").collect():  # SHARDS rows of one byte per bucket
        total += np.frombuffer(r["seen"], np.uint8)
    if not total.any():
        return None if rows.isEmpty() else Model(np.zeros(0, np.int64), np.zeros(0), _log_odds(rows))
    included = context.broadcast(np.flatnonzero(total >= min_docs))
    size = len(included.value) + 1
    state = State(np.zeros(size), np.zeros(size))
    for _ in range(epochs):
        sent = context.broadcast((state.z, state.n))
        parts = shards.mapInArrow(_epoch(sent, included), "i int, z double, n double")
        mean = parts.groupBy("i").agg(F.round(F.avg("z"), 9).alias("z"), F.round(F.avg("n"), 9).alias("n")).toArrow()  # one row per coordinate
        at = mean.column("i").to_numpy()
        state.z[at], state.n[at] = mean.column("z").to_numpy(), mean.column("n").to_numpy()
    weight = state.weights()
    kept = np.flatnonzero(weight[:-1])
    return Model(included.value[kept], weight[kept], float(weight[-1]))


def _log_odds(rows: DataFrame) -> float:
    p = rows.agg(F.avg("y")).first()[0]
    return float(np.log((p + 0.01) / (1.01 - p)))


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.float32)
        if model is not None:
            table[model.bucket] = model.weight
        used = table != 0
        for batch in batches:
            for lo, hi, ws in w.slices(batch.column("text"), w.NON_LETTER):
                n = hi - lo
                score = np.zeros(n)
                if model is not None:
                    text, bucket = buckets(ws)
                    hit = used[bucket]
                    cell = np.unique((text[hit] << BITS) | bucket[hit])
                    total = np.bincount(cell >> BITS, table[cell & ((1 << BITS) - 1)], n) + model.bias
                    score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, epochs: int = EPOCHS, min_docs: int = MIN_DOCS) -> DataFrame:
    """→ doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); ``labels``: doc_id, toxic."""
    model = fit(docs, labels, max_fit, epochs, min_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = texts.mapInArrow(_scored(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
