"""Mixing to target weights with soft memberships.

A classifier learnt from a labelled table gives every document a posterior over the table's domains. Document rates r >= 0 are
fitted so that the expected tokens of each domain, the sum of rate x tokens x posterior, match the target weights: a
nonnegative least-squares problem (domain residuals relative to their targets) solved by accelerated projected gradient.
One step needs the sums over all documents of a vector with one entry per domain; a document's rate follows from its own
posterior and the residuals so far, so nothing but these short vectors ever leaves the executors. Rates start at 1 and move no
further than the targets ask.

The classifier: log-odds of hashed words on one half of a bounded sample of labelled rows, softmax regression over them and
document statistics on the other half.

``mixed`` repeats or leaves out documents by their rates: the whole part, and one more where a hash of the document is below the
fraction.

Edge cases: null and empty texts have no tokens, get a posterior like any other and keep rate 1; null ids are never labelled; repeated
rows get the same rate; an empty table gives no rows; without labelled rows there is one domain and all rates are 1; targets of
domains without labelled rows count as nothing to match; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweir.llm import words as w
from feedweir.llm.quality import statistics
from feedweir.llm.scratch import Scratch

#: Labelled rows that are learnt from at most.
MAX_FIT = 20_000
BUCKETS = 1 << 16
STEPS = 60
TOLERANCE = 1e-6
#: Least share by which a domain's residual is divided.
LEAST_SHARE = 0.01
_PRIOR = 8.0


def _buckets(ws: w.Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, bucket of a word) of a slice."""
    keys = np.unique((ws.doc().astype(np.uint64) << np.uint64(16)) | (ws.hashes() >> np.uint64(48)))
    return (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(BUCKETS - 1)).astype(np.int64)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, ws in w.slices(batch.column("text")):
            doc, bucket = _buckets(ws)
            x = statistics(ws)
            ends = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1])
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("domain"), w.lists(bucket.astype(np.int32), doc, hi - lo, pa.int32()),
                    pa.ListArray.from_arrays(ends, pa.array(x.ravel().astype(np.float32))),
                ],
                names=["doc_id", "domain", "buckets", "stats"],
            )


@dataclass
class Classifier:
    domains: list[str]
    odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def inputs(self, doc: np.ndarray, bucket: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n, cells = len(stats), [stats]
        size = np.sqrt(np.maximum(np.bincount(doc, minlength=n), 1))
        for odds in self.odds:
            worth = odds[bucket]
            most = np.zeros(n)
            np.maximum.at(most, doc, worth)
            cells += [(np.bincount(doc, worth, minlength=n) / size)[:, None], most[:, None]]
        return np.hstack(cells)

    def posterior(self, doc: np.ndarray, bucket: np.ndarray, stats: np.ndarray) -> np.ndarray:
        x = np.clip((self.inputs(doc, bucket, stats) - self.mean) / self.scale, -6, 6)
        return softmax(np.hstack([x, np.ones((len(x), 1))]) @ self.beta)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def learn(docs: DataFrame, labelled: DataFrame, max_fit: int = MAX_FIT) -> Classifier | None:
    """Fit the classifier on at most about ``max_fit`` rows of ``labelled`` (doc_id, domain), chosen by a hash of the id."""
    known = labelled.where("doc_id is not null and domain is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("domain").alias("domain"))
    rows = known.count()
    if not rows:
        return None
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_fit / rows)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most max_fit short rows
    found = texts.mapInArrow(_sample, "doc_id long, domain string, buckets array<int>, stats array<float>")
    once = found.groupBy("doc_id").agg(F.min(F.struct("domain", "buckets", "stats")).alias("row")).select("doc_id", "row.*")  # repeated ids count once
    sample = once.toArrow().sort_by([("doc_id", "ascending")])
    if not sample.num_rows:
        return None
    names, y = np.unique(np.array(sample.column("domain").to_pylist()), return_inverse=True)
    stats = np.stack(sample.column("stats").to_numpy()).astype(float)
    lists = sample.column("buckets").combine_chunks()
    bucket, doc = lists.flatten().to_numpy(), np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    half = np.arange(len(y)) % 2 == 0
    odds = []
    for d in range(len(names)):
        inside, outside = half & (y == d), half & (y != d)
        a = np.bincount(bucket[inside[doc]], minlength=BUCKETS)
        b = np.bincount(bucket[outside[doc]], minlength=BUCKETS)
        share = (a + b + 0.1) / max(half.sum(), 1)
        p = (a + _PRIOR * share) / (inside.sum() + _PRIOR)
        q = (b + _PRIOR * share) / (outside.sum() + _PRIOR)
        odds.append(np.log(p / q))
    model = Classifier(names.tolist(), np.array(odds), np.zeros(0), np.zeros(0), np.zeros(0))
    x = model.inputs(doc, bucket, stats)
    train = ~half if (~half).any() else half
    model.mean, spread = x[train].mean(axis=0), x[train].std(axis=0)
    model.scale = np.where(spread > 1e-6, spread, 1.0)
    x = np.hstack([np.clip((x[train] - model.mean) / model.scale, -6, 6), np.ones((train.sum(), 1))])
    target = np.eye(len(names))[y[train]]
    beta = np.zeros((x.shape[1], len(names)))
    momentum, rate = beta, 4.0 / max(np.linalg.eigvalsh(x.T @ x / len(x))[-1], 1e-9)
    for step in range(400):
        ahead = beta + (step / (step + 3)) * (beta - momentum)
        momentum, beta = beta, ahead - rate / 2 * (x.T @ (softmax(x @ ahead) - target) / len(x) + 1e-2 * ahead)
    model.beta = beta
    return model


def _judge(model: Classifier | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ws in w.slices(batch.column("text")):
                if model is None:
                    p = np.ones((hi - lo, 1))
                else:
                    p = model.posterior(*_buckets(ws), statistics(ws))
                part = batch.slice(lo, hi - lo)
                ends = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * p.shape[1])
                extra = [pa.array(ws.counts.astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(p.ravel()))]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *extra], names=["row", "doc_id", "tokens", "posterior"])

    return run


@dataclass
class Descent:
    """Residuals so far; a document's rate is a function of its posterior and them."""

    step: float
    #: Pull of each domain, and the momentum of the step that took it.
    pulls: list[tuple[np.ndarray, float]]
    momentum: float = 0.0

    def walk(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rates after the last step and after the one before."""
        rate = before = np.ones(len(p))
        for pull, momentum in self.pulls:
            ahead = rate + momentum * (rate - before)
            before, rate = rate, np.maximum(0.0, ahead + self.step * (p @ pull))
        return rate, before

    def rates(self, p: np.ndarray) -> np.ndarray:
        return self.walk(p)[0]

    def ahead(self, p: np.ndarray) -> np.ndarray:
        """The point at which the next gradient is taken."""
        rate, before = self.walk(p)
        return rate + self.momentum * (rate - before)


def _posteriors(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return batch.column("posterior").flatten().to_numpy().reshape(batch.num_rows, n)


def _totals(descent: Descent, n: int, at_rates: bool):
    """Expected tokens by domain at the next point, and the rates' where asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            p = _posteriors(batch, n)
            rate = descent.rates(p) if at_rates else descent.ahead(p)
            total += (batch.column("tokens").to_numpy() * rate) @ p
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["total"])

    return run


def _gram(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            p = _posteriors(batch, n)
            total += (p * batch.column("tokens").to_numpy()[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["total"])

    return run


def _summed(parts: DataFrame, n: int) -> np.ndarray:
    row = parts.select(*[F.sum(F.col("total")[i]) for i in range(n)]).first()
    return np.array([x or 0.0 for x in row])


def descend(held: DataFrame, domains: list[str], targets: dict[str, float], steps: int = STEPS) -> tuple[Descent, dict]:
    """Fit the rates of ``held`` (tokens, posterior) → the descent and a report."""
    n = len(domains)
    light = held.select("tokens", "posterior")
    gram = _summed(light.mapInArrow(_gram(n), "total array<double>"), n * n).reshape(n, n)
    tokens = gram.sum()
    goal = np.array([max(0.0, float(targets.get(d, 0.0))) for d in domains])
    goal = goal / goal.sum() * tokens if goal.sum() > 0 and tokens > 0 else gram.sum(axis=1)
    scale = 1 / np.maximum(goal, LEAST_SHARE * max(tokens, 1.0))
    root = np.sqrt(scale)
    top = np.linalg.eigvalsh(root[:, None] * gram * root[None, :])[-1] if tokens > 0 else 1.0
    descent, seen, worth, turn = Descent(1.0 / max(top, 1e-9), []), [], [], 0
    for _ in range(steps if tokens > 0 else 0):
        total = _summed(light.mapInArrow(_totals(descent, n, False), "total array<double>"), n)
        seen.append(float(np.abs(total - goal).max() / tokens))
        if seen[-1] < TOLERANCE or len(seen) > 8 and max(seen[-8:]) - min(seen[-8:]) < TOLERANCE:
            break
        worth.append(float(scale @ (goal - total) ** 2))
        turn = 0 if len(worth) > 1 and worth[-1] > worth[-2] else turn + 1  # momentum that has overshot starts afresh
        descent.pulls.append((scale * (goal - total), descent.momentum))
        descent.momentum = turn / (turn + 3)
    return descent, {"domains": domains, "goal": goal.tolist(), "steps": len(descent.pulls), "residuals": seen}


def _rated(descent: Descent, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate = descent.rates(_posteriors(batch, n))
            rate = np.where(batch.column("tokens").to_numpy() > 0, rate, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "rate"])

    return run


def rated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], max_fit: int = MAX_FIT) -> tuple[DataFrame, list[str], dict]:
    """→ row (a struct of the document's columns), doc_id, tokens, posterior (in the order of the returned domains), rate and copies;
    the domains; a report of the fit."""
    scratch = Scratch(docs.sparkSession, "mixing")
    model = learn(docs, labelled, max_fit)
    domains = model.domains if model else ["all"]
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    kinds = f"row {rows.schema['row'].dataType.simpleString()}, doc_id long"
    held = scratch.put(rows.mapInArrow(_judge(model), f"{kinds}, tokens long, posterior array<double>"), "held")
    descent, report = descend(held, domains, targets)
    out = held.mapInArrow(_rated(descent, len(domains)), f"{kinds}, tokens long, posterior array<double>, rate double")
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("rate")
    return out.withColumn("copies", (whole + (chance < F.col("rate") - whole).cast("long")).cast("long")), domains, report


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], max_fit: int = MAX_FIT) -> DataFrame:
    """The documents, each as many times as its rate says."""
    out, _, _ = rated(docs, labelled, targets, max_fit)
    repeated = out.select("row", F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1L, copies) ELSE array() END")).alias("copy"))
    return repeated.select("row.*")
