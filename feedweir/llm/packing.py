"""Mixture-controlled packing: every window is filled from all source queues in the target proportions of tokens.

Sources are queues of tokens, in table order, every source its own. Each queue gets its share of every window in whole tokens and
what it is short of is carried into the next window without end: how many tokens of a queue lie before a window is an exact
formula of the window's number and the queue's whole total (see ``Phase``), so rare sources are spread over the corpus as evenly
as large ones. When a queue runs dry the others share its part, until all tokens lie in exactly one piece. The plan is a short
list of phases (two per target at most), and every document finds its pieces from the position of its first token in its queue.
Positions are sums over the tokens of earlier partitions, so deficits carry across partitions too.

Token ids are written once to the shared folder; only counts per partition and queue are shuffled.

The driver and each task hold one name and one number per source.

Edge cases: a null or empty text is its end token alone; rows without a source share one queue; repeated rows are packed each;
an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from feedweir.llm.scratch import Scratch
from feedweir.llm.tokenizer import encoder

SIZE = 2048
END = 1
#: Queue of the rows without a source.
SHARED = "*"

_TOKENS = "doc_id long, queue string, part int, local long, tokens long, ids binary"
_PIECES = "doc_id long, queue string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), {}
        last = np.asarray([end], enc.kind).tobytes()
        for batch in batches:
            ids = [x + last for x in enc.encode([t or "" for t in batch.column("text").to_pylist()])]
            queues, local, counts = batch.column("queue").to_pylist(), [], [len(x) // enc.kind.itemsize for x in ids]
            for q, n in zip(queues, counts, strict=True):
                local.append(seen.get(q, 0))
                seen[q] = local[-1] + n
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("queue"), pa.array([part] * len(ids), pa.int32()), pa.array(local, pa.int64()),
                    pa.array(counts, pa.int64()), pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "queue", "part", "local", "tokens", "ids"],
            )

    return run


class Phase:
    """Windows ``first`` to ``first + count`` of ``size`` tokens in which the queues have whole-number ``weights``.

    A binary tree over the queues deals tokens one by one: of the first n tokens of a node its left child has n * left / node,
    rounded. Both children's counts rise by 0 or 1 with n, so quotas are never negative, sum to n exactly, and stray from the
    weights by half a token per level of the tree at most, however many windows there are.
    """

    def __init__(self, first: int, count: int, weights: np.ndarray, used: np.ndarray, size: int):
        self.first, self.count, self.used, self.size = first, count, used, size
        self.queues, self.depth = len(weights), max(0, len(weights) - 1).bit_length()
        total = sum(int(x) for x in weights)
        tokens = max(size * (count + 1), int(max(weights, default=0)) + 1)
        self.kind = np.int64 if 2 * tokens * total < 1 << 62 else object  # object: Python's integers, exact at any size
        upto = np.zeros((1 << self.depth) + 1, self.kind)
        upto[1 : self.queues + 1] = np.cumsum(np.array([int(x) for x in weights], self.kind))
        upto[self.queues + 1 :] = total
        self.upto = upto

    def before(self, queue: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of the queue, tokens of all queues before it) among the first ``n`` of the phase."""
        lo, n, others = np.zeros(len(queue), np.int64), n.astype(self.kind), np.zeros(len(queue), self.kind)
        for level in range(self.depth - 1, -1, -1):
            mid = lo + (1 << level)
            whole = np.maximum(self.upto[mid + (1 << level)] - self.upto[lo], 1)
            left = (n * (self.upto[mid] - self.upto[lo]) + whole // 2) // whole
            right = queue >= mid
            others, n, lo = np.where(right, others + left, others), np.where(right, n - left, left), np.where(right, mid, lo)
        return n.astype(np.int64), others.astype(np.int64)

    def rank(self, queue: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Place among all tokens of the phase of a queue's token; one that may lie beyond the phase comes as a Python integer."""
        kind = object if token.dtype == object else self.kind
        wide, token = self.upto.astype(kind, copy=False), token.astype(kind)
        for level in range(self.depth):
            mid = (queue >> (level + 1) << (level + 1)) + (1 << level)
            low, middle, high = wide[mid - (1 << level)], wide[mid], wide[mid + (1 << level)]
            whole, right = high - low, queue >= mid
            up = -((whole // 2 - (token + 1) * whole) // np.maximum(middle - low, 1)) - 1
            token = np.where(right, (token * whole + whole // 2) // np.maximum(high - middle, 1), up)
        return token

    def taken(self, windows: int) -> np.ndarray:
        return self.before(np.arange(self.queues), np.full(self.queues, windows * self.size, object))[0]

    def pieces(self, queue: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, stop, window, offset) of the pieces of runs of tokens of queues, counted from the start of the phase."""
        row = np.arange(len(queue))
        ends = (self.rank(np.tile(queue, 2), np.concatenate([start, stop - 1])) // self.size).astype(np.int64)
        first, last = ends[: len(queue)], ends[len(queue) :]
        rare = last - first >= stop - start  # fewer tokens than windows: go by tokens
        n = np.where(rare, stop - start, last - first + 1)
        row = np.repeat(row, n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        window, thin = first[row] + step, rare[row]
        if thin.any():
            window[thin] = self.rank(queue[row[thin]], (start[row] + step)[thin]) // self.size
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1])
            row, window = row[new], window[new]
        asked, bounds = np.tile(queue[row], 2), np.concatenate([window, window + 1]).astype(self.kind) * self.size
        own, others = self.before(asked, bounds)
        begin, end = own[: len(row)], own[len(row) :]
        a, b = np.maximum(start[row], begin), np.minimum(stop[row], end)
        offset = others[len(row) :] - others[: len(row)] + a - begin
        some = b > a
        return row[some], a[some], b[some], self.first + window[some], offset[some]


def _whole(weights: np.ndarray) -> np.ndarray:
    """Whole numbers in the proportions of the weights: themselves if whole, else to 60 bits."""
    if weights.dtype.kind in "iu" or np.all((weights == np.floor(weights)) & (weights < 1 << 53)):
        return weights.astype(np.int64)
    scale = (1 << 60) / float(weights.sum())
    return np.array([max(1, int(x * scale)) if x > 0 else 0 for x in weights.tolist()], np.int64)


def schedule(totals: np.ndarray, weights: np.ndarray, size: int = SIZE) -> list[Phase]:
    """The phases that use up ``totals`` tokens of each queue."""
    left, used, first, phases = totals.astype(np.int64).copy(), np.zeros(len(totals), np.int64), 0, []

    def add(phase: Phase) -> None:
        nonlocal first
        phases.append(phase)
        taken = phase.taken(phase.count)
        left[:], used[:], first = left - taken, used + taken, first + phase.count

    while left.sum() >= size:
        active = left > 0
        share = np.where(active, np.maximum(weights, 0), 0)
        share = share if share.sum() > 0 else np.where(active, left, 0)
        whole = _whole(share)
        asked = np.flatnonzero(whole > 0)
        most = Phase(first, int(left.sum()) // size, whole, used.copy(), size)
        # the first window that would need a token that its queue no longer has
        dry = min(int(x) for x in most.rank(asked, left[asked].astype(object)))
        count = min(most.count, dry // size)
        if count:
            add(Phase(first, count, whole, used.copy(), size))
            continue
        quota = np.minimum(most.taken(1), left)  # a queue runs dry in this window: the others fill its part
        while (short := size - int(quota.sum())) > 0:
            able = np.flatnonzero(left > quota)
            part = np.where(share[able] > 0, share[able], 0).astype(float)
            part = part / part.sum() if part.sum() > 0 else np.full(len(able), 1 / len(able))
            more = np.minimum(np.maximum(np.floor(part * short), 0).astype(np.int64), left[able] - quota[able])
            if not more.any():
                more[np.argmax(part)] = 1
            quota[able] += more
        add(Phase(first, 1, quota, used.copy(), size))
    if left.sum():
        add(Phase(first, 1, left.copy(), used.copy(), int(left.sum())))
    return phases


def _cut(phases: list[Phase], queues: dict[str, int], kind: str):
    ends = [p.used + p.taken(p.count) for p in phases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            queue = np.array([queues[q] for q in batch.column("queue").to_pylist()], np.int64)
            at, tokens = batch.column("at").to_numpy(), batch.column("tokens").to_numpy()
            found = []
            for phase, end in zip(phases, ends, strict=True):
                start, stop = np.maximum(at, phase.used[queue]), np.minimum(at + tokens, end[queue])
                rows = np.flatnonzero(start < stop)
                if len(rows):
                    base = phase.used[queue[rows]]
                    row, a, b, window, offset = phase.pieces(queue[rows], start[rows] - base, stop[rows] - base)
                    skip = base[row] - at[rows[row]]
                    found.append((rows[row], a + skip, b - a, window, offset))
            row, start, length, window, offset = (np.concatenate(x) for x in zip(*found, strict=True))
            wide = [np.frombuffer(raw, kind).astype("<u4").tobytes() for raw in batch.column("ids").to_pylist()]
            ids = [wide[r][4 * s : 4 * (s + n)] for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            take = pa.array(row)
            columns = [
                batch.column("doc_id").take(take), batch.column("queue").take(take), pa.array(start), pa.array(length),
                batch.column("tokens").take(take), pa.array(window), pa.array(offset), pa.array(ids, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "queue", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            )

    return run


def pack(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece of a document: doc_id, queue, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32).

    ``tokenizer`` is the path of a byte-level BPE file. ``targets``: share of tokens by source (sources left out: none, they come
    last); by default the corpus's own shares, which every window then keeps to the end.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    queue = F.coalesce(F.col("source").cast("string"), F.lit(SHARED))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), queue.alias("queue"), "text")
    tokens = scratch.put(rows.mapInArrow(_encode(tokenizer, end), _TOKENS), "tokens")

    sums = scratch.put(tokens.groupBy("part", "queue").agg(F.sum("tokens").alias("n")), "sums")
    totals = sums.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").toArrow()  # one name and one number per source
    queues = {q: i for i, q in enumerate(totals["queue"].to_pylist())}
    counts = totals["n"].to_numpy().astype(np.int64)
    weights = counts if targets is None else np.array([float(targets.get(q, 0)) for q in queues])
    phases = schedule(counts, weights, size)
    before = W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # one short row per partition and queue, written out so that Spark knows its size before it plans the join
    bases = scratch.put(bases, "bases")
    placed = tokens.join(bases, ["part", "queue"]).select("doc_id", "queue", (F.col("base") + F.col("local")).alias("at"), "tokens", "ids")
    return placed.mapInArrow(_cut(phases, queues, encoder(tokenizer).kind.str), _PIECES)
