"""Quality scores: kernel ridge regression on document statistics, calibrated.

Statistics of the whole text (lengths, kinds of bytes, repetition, word shapes) are standardised and mapped by random Fourier
features, which approximate a Gaussian kernel. Every partition sums its part of the normal equations; the sums are added
up in Spark and a system of fixed size is solved. An isotonic fit on rows that the regression has not seen turns its
values into probabilities.

Labels reach the model only through rows outside the held-out third. At most ``MAX_FIT`` labelled rows are fitted, chosen by
a hash of the id; all rows are scored. Inputs of a score are the text's statistics alone.

Edge cases: null and empty texts have zero statistics and are scored like any other; null ids are never held out and
never labelled; repeated rows are scored alike; a document with several label rows counts as their mean; without labelled rows
every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedweir.llm import words as w
from feedweir.llm.scratch import Scratch

FEATURES = 256
RIDGE = 1e-3
SEED = 7
MAX_FIT = 400_000
#: Partial sums that are added up in one shuffle.
MAX_PARTS = 64
#: Steps per unit of the regression's value at which the calibration counts labels.
STEPS = 500
#: Weight of the uncalibrated value in a score; keeps the order of documents where the isotonic fit is flat.
TILT = 0.01

_BYTE = np.arange(256)
_KINDS = {
    "space": w.WHITE,
    "newline": _BYTE == 10,
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "lower": (_BYTE >= 97) & (_BYTE <= 122),
    "high": _BYTE >= 128,
    "mark": np.isin(_BYTE, list(b".,;:!?'\"-()")),
}
_KINDS["symbol"] = ~np.logical_or.reduce([_KINDS[k] for k in ("space", "digit", "upper", "lower", "high", "mark")])
_LETTER = _KINDS["upper"] | _KINDS["lower"] | _KINDS["high"]
NAMES = [
    *_KINDS, "log_bytes", "log_words", "word_mean", "word_spread", "short_words", "long_words", "no_letter", "symbol_end", "capital",
    "distinct_words", "top_word", "same_as_last", "distinct_triples", "line_words", "sentence_words",
]


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def statistics(ws: w.Words) -> np.ndarray:
    """Statistics of the texts of a slice, one row each."""
    size, n = np.diff(ws.offsets).astype(float), ws.counts.astype(float)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(n, 1)
    cell = np.repeat(np.arange(len(n)) * 256, np.diff(ws.offsets)) + ws.buf
    bytes_ = np.bincount(cell, minlength=256 * len(n)).reshape(len(n), 256).astype(float)
    kinds = {k: bytes_ @ table for k, table in _KINDS.items()}
    length = (ws.end - ws.start).astype(float)
    letters = np.zeros(len(ws.buf) + 1, np.int32)
    np.cumsum(_LETTER[ws.buf], out=letters[1:])
    words = lambda flag: _per_text(flag, ws.first) * per_word
    mean = words(length)
    h, doc = ws.hashes(), ws.doc()
    d, times = w.distinct_counts(doc, h)
    most = np.zeros(len(n))
    np.maximum.at(most, d, times)
    again = np.zeros(len(h))
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    at = w.fits(ws, 3)
    triples = np.bincount(doc[at], minlength=len(n)) if len(at) else np.zeros(len(n))
    distinct = np.bincount(w.distinct_counts(doc[at], w.grams(h, 3)[at])[0], minlength=len(n)) if len(at) else np.zeros(len(n))
    last = ws.buf[ws.end - 1] if len(h) else ws.buf[:0]
    begin = ws.buf[ws.start] if len(h) else ws.buf[:0]
    out = [
        *(v * per_byte for v in kinds.values()), np.log1p(size), np.log1p(n), np.log1p(mean),
        np.log1p(np.sqrt(np.maximum(words(length**2) - mean**2, 0))), words(length <= 3), words(length > 15),
        words(letters[ws.end] == letters[ws.start]), words(_KINDS["symbol"][last]), words(_KINDS["upper"][begin]),
        np.bincount(d, minlength=len(n)) * per_word, most * per_word, words(again), np.where(triples > 0, distinct / np.maximum(triples, 1), 1),
        np.log1p(n / (kinds["newline"] + 1)), np.log1p(n / (_per_text(last == 46, ws.first) + 1)),
    ]
    return np.stack(out, axis=1)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, ws in w.slices(batch.column("text")):
            x = statistics(ws).astype(np.float32)
            ends = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["doc_id", "stats"]
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), len(NAMES)).astype(np.float64)


@dataclass
class Model:
    """Standardisation, random features, ridge weights and calibration knots."""

    mean: np.ndarray
    scale: np.ndarray
    wave: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -6, 6) @ self.wave + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip((1 - TILT) * np.interp(raw, self.knots, self.levels) + TILT * np.clip((raw + 1) / 3, 0, 1), 0, 1)


def isotonic(value: np.ndarray, total: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators over counts sorted by value → (mean value, share of ones) of each pool."""
    pools: list[list[float]] = []
    for v, n, y in zip(value, total, ones, strict=True):
        pools.append([v * n, n, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def held_out(doc_id: Column) -> Column:
    """The third of the ids whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _equations(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for frame in frames:
            if len(frame):
                z = model.features(np.stack(frame["stats"].to_numpy()).astype(np.float64))
                total += z.T @ np.hstack([z, frame["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"i": np.arange(FEATURES + 1), "row": list(total)})

    return run


def _added(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": frame["i"].iloc[:1], "row": [np.sum(frame["row"].to_list(), axis=0)]})


def _raw(model: Model):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.stack(frame["stats"].to_numpy()).astype(np.float64) if len(frame) else np.zeros((0, len(NAMES)))
            yield pd.DataFrame({"step": np.rint(np.clip(model.raw(x), -1, 2) * STEPS).astype(np.int64), "y": frame["y"].to_numpy()})

    return run


def fit(stats: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Model | None:
    """Learn from the labelled rows outside the held-out third; four fifths fit the regression, one fifth the calibration."""
    marks = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isNotNull())
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    known = stats.join(marks, "doc_id").withColumn("turn", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)))
    rows = known.count()
    if not rows:
        return None
    known = Scratch(stats.sparkSession, "quality-fit").put(known.where(F.col("turn") < int((1 << 20) * min(1.0, max_fit / rows))), "known")
    fitted, checked = known.where("turn % 5 > 0"), known.where("turn % 5 = 0")
    d = len(NAMES)
    sums = fitted.select(
        F.count("*"), *[F.sum(F.col("stats")[i].cast("double")) for i in range(d)],
        *[F.sum(F.pow(F.col("stats")[i].cast("double"), 2)) for i in range(d)],
    ).first()
    n = max(1, sums[0])
    mean = np.array([x or 0.0 for x in sums[1 : d + 1]]) / n
    spread = np.sqrt(np.maximum(np.array([x or 0.0 for x in sums[d + 1 :]]) / n - mean**2, 0))
    draw = np.random.default_rng(SEED)
    model = Model(
        mean, np.where(spread > 1e-6, spread, 1.0), draw.standard_normal((d, FEATURES)) / np.sqrt(d), draw.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5),
    )
    parts = fitted.select("stats", "y").coalesce(MAX_PARTS).mapInPandas(_equations(model), "i int, row array<double>")
    total = np.zeros((FEATURES + 1, FEATURES + 2))
    for r in parts.groupBy("i").applyInPandas(_added, "i int, row array<double>").collect():  # a matrix of fixed size
        total[r["i"]] = r["row"]
    model.beta = np.linalg.solve(total[:, :-1] + RIDGE * n * np.eye(FEATURES + 1), total[:, -1])
    steps = checked.select("stats", "y").mapInPandas(_raw(model), "step long, y double").groupBy("step").agg(F.count("*").alias("n"), F.sum("y").alias("y"))
    counts = sorted((r["step"], r["n"], r["y"]) for r in steps.collect())  # at most 3 * STEPS + 1 rows
    if counts:
        value, size, ones = np.array(counts, float).T
        model.knots, model.levels = isotonic(value / STEPS, size, ones)
    return model


def survey(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every row of ``docs``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_survey, "doc_id long, stats array<float>")


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(batch.num_rows, 0.5) if model is None else model.score(_matrix(batch.column("stats")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> DataFrame:
    """→ doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text)."""
    stats = Scratch(docs.sparkSession, "quality").put(survey(docs), "stats")
    scored = stats.mapInArrow(_scored(fit(stats, labels, max_fit)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _accepted(model: Model | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ws in w.slices(batch.column("text")):
                part = batch.slice(lo, hi - lo)
                yield part if model is None else part.filter(pa.array(model.score(statistics(ws)) >= least))

    return run


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, max_fit: int = MAX_FIT) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more; the texts are walked through twice and never shuffled."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(scratch.put(survey(docs), "stats"), labels, max_fit)
    scratch.drop("stats")
    return docs.mapInArrow(_accepted(model, least), docs.schema)
