"""Near-duplicate classes by ProbMinHash.

A document is the weighted set of its word ``gram``-grams, weight 1 + ln(count). Each element sends arrivals of a Poisson process
of its weight's rate to random components; a component keeps the element that arrives first, and an element stops once
its next arrival is later than the latest component. Two documents agree in a component with the probability Jaccard
similarity of their weights (for plain sets: the Jaccard similarity). ``bands`` bands of ``rows`` components make the buckets;
every link is verified on the exact weighted sets.

Hot groups: word-for-word copies are one class from the start and only the first of them takes part. In a bucket all members are
first compared with its smallest member, which settles a tight group of n copies with n comparisons. Where that leaves a bucket
in several classes, its members are dealt into chunks of about ``BLOCK`` documents, together with the small buckets around them and
large classes into chunks of their own, and chunks that share a bucket are compared as matrices, once however many buckets they share and never where both
hold one and the same class. So no link of two members of a bucket is lost, and no pair is ever a row.

Edge cases: null and empty texts are copies of each other; texts of fewer than ``gram`` words are one element; a null id
counts as larger than every id and comes out as null; rows of one id (null too) are one document; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedweir.llm import words as w
from feedweir.llm.phrases import LAST_ID
from feedweir.llm.scratch import Scratch

GRAM = 5
SIMILARITY = 0.8
BANDS, ROWS = 28, 6
#: Documents on one side of a block of comparisons.
BLOCK = 512
#: Columns of a block's incidence matrices worked on at once.
COLUMNS = 4096
_STEP = np.uint64(0x9E3779B97F4A7C15)

_SIGNED = "id long, doc_id long, n_words long, k1 long, k2 long, bands array<long>"
_SETS = "id long, grams array<long>, counts array<int>"


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, size: int) -> np.ndarray:
    """ProbMinHash signature (docs x size) of weighted sets given as (document, element, weight) rows."""
    times, owner = np.full(docs * size, np.inf), np.zeros(docs * size, np.uint64)
    latest = np.full(docs, np.inf)
    clock, step = np.zeros(len(doc)), 0
    while len(doc):
        ahead = 1 if step < 3 else 16  # few elements are left then, so draw several arrivals at once
        k = np.arange(step + 1, step + ahead + 1, dtype=np.uint64) * _STEP
        bits = w.mix(element[:, None] + k[None, :])
        wait = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / weight[:, None]
        at = clock[:, None] + np.cumsum(wait, axis=1)
        place = ((w.mix(bits ^ _STEP) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
        alive = at < latest[doc][:, None]
        slot = (doc[:, None] * size + place.astype(np.int64))[alive]
        when, who = at[alive], np.broadcast_to(element[:, None], at.shape)[alive]
        np.minimum.at(times, slot, when)
        won = times[slot] == when
        owner[slot[won]] = who[won]
        latest = times.reshape(docs, size).max(axis=1)
        clock = at[:, -1]
        on = clock < latest[doc]
        doc, element, weight, clock = doc[on], element[on], weight[on], clock[on]
        step += ahead
    return owner.reshape(docs, size)


def shingles(ws: w.Words, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, element, count) of the texts of a slice, sorted; a text of fewer than ``gram`` words is one element."""
    h = ws.hashes()
    at = w.fits(ws, gram)
    doc, value = ws.doc()[at], w.grams(h, gram)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((ws.counts > 0) & (ws.counts < gram))
    return w.unique_pairs(np.concatenate([doc, short]), np.concatenate([value, w.whole(h, ws.first)[short]]))


def weights(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets (elements sorted)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    same = a[at] == b
    x, y = wa[at[same]], wb[same]
    if not len(x):
        return 0.0
    if wa.max() == 1 and wb.max() == 1:
        return len(x) / (len(a) + len(b) - len(x))
    # sum over common x of 1 / sum over all y of max(a_y / a_x, b_y / b_x), by prefix sums in the order of a / b
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    below_b = np.cumsum(y)
    from_a = x[::-1].cumsum()[::-1]
    total = (from_a + only_a) / x + (below_b - y + only_b) / y
    return float((1.0 / total).sum())


def _sign(gram: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ws in w.slices(batch.column("text")):
                doc, element, count = shingles(ws, gram)
                owner = signatures(doc, element, weights(count), hi - lo, bands * rows) if len(doc) else np.zeros((hi - lo, bands * rows), np.uint64)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _STEP, (hi - lo, bands))
                for r in range(rows):
                    key = w.mix(key * np.uint64(0xCA5A826395121157) + owner.reshape(hi - lo, bands, rows)[:, :, r])
                full = np.flatnonzero(ws.counts > 0)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("doc_id"), pa.array(ws.counts.astype(np.int64)),
                        pa.array(w.signed(w.whole(ws.hashes(), ws.first))), pa.array(w.signed(w.whole(ws.hashes(1), ws.first, 1))),
                        w.lists(w.signed(key[full].ravel()), np.repeat(full, bands), hi - lo, pa.int64()),
                    ],
                    names=["id", "doc_id", "n_words", "k1", "k2", "bands"],
                )

    return run


def _sets(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ws in w.slices(batch.column("text")):
                doc, element, count = shingles(ws, gram)
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(lo, n), w.lists(w.signed(element), doc, n, pa.int64()),
                        w.lists(count.astype(np.int32), doc, n, pa.int32()),
                    ],
                    names=["id", "grams", "counts"],
                )

    return run


def _verify(least: float):
    def one(batch: pa.RecordBatch, side: str, i: int) -> tuple[np.ndarray, np.ndarray]:
        grams = batch.column(f"grams_{side}")[i].values.to_numpy().view(np.uint64)
        return grams, weights(batch.column(f"counts_{side}")[i].values.to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # elements are sorted as unsigned values, as ``shingles`` leaves them
            keep = [similarity(*one(batch, "a", i), *one(batch, "b", i)) >= least for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, root) of every node but the roots: its component's smallest id. Alternating large-star and small-star rounds.

    Minima are combined before each shuffle, and every round is written out, so neither a hub nor a lost executor hurts.
    """
    edges = scratch.put(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{name}-0")
    stamp = _stamp(edges)
    step = 0
    while True:
        step += 1
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        large = scratch.put(large, f"{name}-{step}-large")
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(least, "b")
        small = joined.select(F.col("m").alias("a"), "b").union(joined.where("m < a").select("m", F.col("a").alias("b"))).distinct()
        edges = scratch.put(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-large")
        now = _stamp(edges)
        if now == stamp:
            return edges.select(F.col("b").alias("id"), F.col("a").alias("root"))
        stamp = now


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def _torn(held: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, id, label, n) of buckets of three members or more in which several classes are left."""
    label = held.where("n > 2").join(roots, "id", "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("label"))
    torn = label.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("bucket")
    return label.join(torn, "bucket")


def _homes(torn: DataFrame) -> DataFrame:
    """Rows of ``torn`` with their document's ``home``, its largest bucket."""
    return torn.join(torn.groupBy("id").agg(F.max(F.struct("n", "bucket")).alias("home")), "id")


def _chunks(homes: DataFrame, block: int) -> DataFrame:
    """(id, chunk, one): a chunk holds documents of one neighbourhood of buckets; ``one`` names its class where it is all of one.

    Homes go with the largest home that members of their documents' buckets have, so a large group and the many small homes around it
    fill chunks together: chunks are as many as their documents need, not as many as there are homes.
    """
    best = homes.groupBy("bucket").agg(F.max("home").alias("best"))
    root = homes.join(best, "bucket").groupBy("home").agg(F.max("best")["bucket"].alias("root"))
    placed = homes.groupBy("id").agg(F.max("home").alias("home"), F.min("label").alias("label")).join(root, "home").select("id", "root", "label")
    large = placed.groupBy("root", "label").agg(F.count("*").alias("size")).where(F.col("size") >= block // 2)
    sided = placed.join(large, ["root", "label"], "left").select("id", "root", F.when(F.col("size").isNotNull(), F.col("label")).alias("one"))
    key = F.coalesce("one", F.lit(-1))
    parts = sided.groupBy("root", key.alias("k")).agg(F.ceil(F.count("*") * 1.1 / block).alias("parts"))
    dealt = sided.withColumn("k", key).join(parts, ["root", "k"])
    return dealt.select("id", F.xxhash64("root", "k", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("chunk"), "one")


def _seen(torn: DataFrame, chunks: DataFrame) -> DataFrame:
    """(bucket, chunk, one): the chunks that have members in a bucket."""
    return torn.select("bucket", "id").join(chunks, "id").select("bucket", "chunk", "one").distinct()


def _blocks(seen: DataFrame) -> DataFrame:
    """Pairs of chunks that share a bucket and do not hold one and the same class."""
    other = seen.select("bucket", F.col("chunk").alias("c2"), F.col("one").alias("two"))
    pairs = seen.join(other, "bucket").where("chunk <= c2 AND NOT coalesce(one = two, false)")
    return pairs.select(F.col("chunk").alias("c1"), "c2").distinct()


def _sides(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(c1, c2, side, id): the documents of each block, once per block that their chunk is in."""
    sides = blocks.select("c1", "c2", F.posexplode(F.array("c1", "c2")).alias("side", "chunk"))
    return sides.where("side = 0 OR c1 <> c2").join(chunks, "chunk").select("c1", "c2", "side", "id")


def _compare(least: float):
    """Links between the two sides of a block (or within its one side), as a spanning forest."""

    def run(table: pa.Table) -> pa.Table:
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        order = np.argsort(side, kind="stable")
        table, side, ids = table.take(pa.array(order)), side[order], ids[order]
        grams, counts = table.column("grams").combine_chunks(), table.column("counts").combine_chunks()
        sizes = np.diff(grams.offsets.to_numpy())
        flat = grams.flatten().to_numpy().view(np.uint64)
        weight = weights(counts.flatten().to_numpy())
        row = np.repeat(np.arange(len(ids)), sizes)
        plain = np.ones(len(ids), bool)
        plain[row[weight > 1]] = False
        total = np.bincount(row, weight, minlength=len(ids))
        share = np.sqrt(weight / total[row])
        known, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        use = times[column] > 1
        sort = np.argsort(column[use], kind="stable")
        col, at, half = column[use][sort], row[use][sort], share[use][sort]
        left, right = (np.arange(len(ids)),) * 2 if side.max() == side.min() else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        place = np.zeros(len(ids), np.int64)
        place[left] = np.arange(len(left))
        on_right = place.copy()
        on_right[right] = np.arange(len(right))
        is_left, is_right = np.isin(np.arange(len(ids)), left), np.isin(np.arange(len(ids)), right)
        both = np.zeros((len(left), len(right)))
        alike = np.zeros((len(left), len(right)))
        for lo in range(0, len(known), COLUMNS):
            a, b = np.searchsorted(col, [lo, lo + COLUMNS])
            if a == b:
                continue
            mats = []
            for value in (np.ones(b - a, np.float32), half[a:b].astype(np.float32)):
                for inside, spot, n in ((is_left, place, len(left)), (is_right, on_right, len(right))):
                    m = np.zeros((n, COLUMNS), np.float32)
                    keep = inside[at[a:b]]
                    m[spot[at[a:b]][keep], col[a:b][keep] - lo] = value[keep]
                    mats.append(m)
            both += mats[0] @ mats[1].T
            if not plain.all():
                alike += mats[2] @ mats[3].T
        union = sizes[left][:, None] + sizes[right][None, :] - both
        exact = plain[left][:, None] & plain[right][None, :]
        linked = exact & (both / np.maximum(union, 1) >= least)
        # weighted sets: the similarity is at most the sum of the roots of the products of the shares
        maybe = ~exact & (alike >= least - 1e-4)
        root = np.arange(len(ids))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        ends, found = np.append(0, np.cumsum(sizes)), []
        for i, j in np.argwhere(linked | maybe).tolist():
            x, y = int(left[i]), int(right[j])
            if x == y or find(x) == find(y):
                continue
            if maybe[i, j]:
                p, q = slice(ends[x], ends[x + 1]), slice(ends[y], ends[y + 1])
                if similarity(flat[p], weight[p], flat[q], weight[q]) < least:
                    continue
            root[find(x)] = find(y)
            found.append((ids[x], ids[y]))
        a, b = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        return pa.table([np.minimum(a, b), np.maximum(a, b)], names=["a", "b"])

    return run


def near_duplicates(
    docs: DataFrame, gram: int = GRAM, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) → doc_id, n_words, class_id: the smallest id of its near-duplicate class."""
    scratch = Scratch(docs.sparkSession, "near")
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    signed = scratch.put(texts.mapInArrow(_sign(gram, bands, rows), _SIGNED), "signed")
    keys = ["n_words", "k1", "k2"]
    firsts = signed.groupBy(*keys).agg(F.min("id").alias("first"))
    members = scratch.put(
        signed.join(firsts, keys).select("id", "doc_id", "n_words", "first", F.when(F.col("id") == F.col("first"), F.col("bands")).alias("bands")),
        "members",
    )
    scratch.drop("signed")

    # buckets of two different texts or more
    dealt = members.select("id", F.explode("bands").alias("bucket"))
    buckets = scratch.put(
        dealt.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("last"), F.count("*").alias("n")).where("head < last").drop("last"),
        "buckets",
    )
    held = scratch.put(dealt.join(buckets, "bucket"), "held")
    wanted = held.select("id").distinct().hint("merge")  # the same plan at every size: never a broadcast of ids
    sets = scratch.put(texts.select("id", "text").join(wanted, "id").mapInArrow(_sets(gram), _SETS), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        for side in ("b", "a"):
            pairs = pairs.join(sets.select(F.col("id").alias(side), F.col("grams").alias(f"grams_{side}"), F.col("counts").alias(f"counts_{side}")), side)
        return pairs.mapInArrow(_verify(least), "a long, b long")

    heads = held.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    # rows of one id with different texts are one document
    several = members.groupBy("id").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("id", "a")
    joined = members.join(several, "id").where("first > a").select("a", F.col("first").alias("b"))
    links = scratch.put(verified(heads).union(joined), "links-heads")
    roots = components(links, scratch, "classes-heads")

    # buckets that still hold several classes: their members are compared in blocks, but for members of one class
    torn = _torn(held, roots)
    torn = scratch.put(torn, "torn")
    if not torn.isEmpty():
        chunks = scratch.put(_chunks(scratch.put(_homes(torn), "homes"), block), "chunks")
        blocks = scratch.put(_blocks(scratch.put(_seen(torn, chunks), "seen")), "blocks")
        scratch.drop("homes", "seen")
        dealt = _sides(blocks, chunks).join(sets, "id").select("c1", "c2", "side", "id", "grams", "counts")
        more = scratch.put(dealt.groupBy("c1", "c2").applyInArrow(_compare(least), "a long, b long"), "links-blocks")
        roots = components(roots.select(F.col("root").alias("a"), F.col("id").alias("b")).union(more), scratch, "classes-blocks")

    known = roots.select(F.col("id").alias("first"), "root")
    found = members.drop("bands").join(known, "first", "left").withColumn("class_id", F.coalesce("root", "first"))
    return found.select("doc_id", "n_words", F.when(F.col("class_id") < LAST_ID, F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document of the smallest id of each near-duplicate class, once."""
    kept = near_duplicates(docs).where("doc_id <=> class_id").groupBy("doc_id").agg(F.count("*").alias("times"))
    kept = Scratch(docs.sparkSession, "near-kept").put(kept.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "times"), "kept")
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id")
    rows = docs.select(F.struct("*").alias("row"), id_).join(kept.hint("merge"), "id")
    once = rows.where("times = 1").select("row.*")
    if kept.where("times > 1").isEmpty():
        return once
    return once.union(rows.where("times > 1").dropDuplicates(["id"]).select("row.*"))
