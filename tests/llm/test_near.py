from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from feedweir.llm import near


def shingles(text):
    words = (text or "").encode().split()
    if len(words) < near.GRAM:
        return Counter([tuple(words)] if words else [])
    return Counter(tuple(words[i : i + near.GRAM]) for i in range(len(words) - near.GRAM + 1))


def probability_jaccard(a, b):
    if not a or not b:
        return float(not a and not b)
    x, y = ({k: 1 + math.log(n) for k, n in s.items()} for s in (a, b))
    total = 0.0
    for k in x.keys() & y.keys():
        total += 1 / sum(max(x.get(j, 0) / x[k], y.get(j, 0) / y[k]) for j in x.keys() | y.keys())
    return total


def classes(rows):
    """Smallest id of every row's class, all pairs compared."""
    ids = [near.LAST_ID if r[0] is None else r[0] for r in rows]
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if ids[i] == ids[j] or probability_jaccard(sets[i], sets[j]) >= near.SIMILARITY:
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, doc_id in enumerate(ids):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    named = [least[find(i)] for i in range(len(rows))]
    return sorted(((r[0], None if c == near.LAST_ID else c) for r, c in zip(rows, named, strict=True)), key=repr)


@pytest.fixture(scope="module")
def small(spark, rows):
    kept = [(r[0], r[1]) for r in rows if r[0] != 64]
    return kept, spark.createDataFrame(kept, "doc_id bigint, text string").repartition(3)


def test_classes_equal_all_pairs(small):
    rows, docs = small
    got = near.near_duplicates(docs).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got), key=repr) == classes(rows)


@pytest.mark.parametrize("block", [4, 256])
def test_torn_buckets_are_compared_to_the_end(spark, block):
    """With one coarse component per band all texts share buckets, so links between members that are not the smallest count."""
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(["common five words stand here", *[f"d{i}x{j}" for j in range(6)]])) for i in range(30)]
    rows += [(100 + i, " ".join(["common five words stand here", *base[:59], f"e{i}"])) for i in range(6)]
    rows += [(200 + i, " ".join(["common five words stand here", *["again and again we say it"] * 9, *base[:9], f"e{i}"])) for i in range(5)]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), bands=40, rows=1, block=block)
    assert sorted(map(tuple, got.select("doc_id", "class_id").collect()), key=repr) == classes(rows)


def test_small_buckets_round_a_large_one_share_its_chunks(spark):
    """Every pair of a bucket meets in a block, and a large group is not copied once for each small bucket that touches it."""
    rows = [(0, i, i, 120) for i in range(120)]
    rows += [(1 + i, doc, doc, 3) for i in range(120) for doc in (i, 1000 + i, 2000 + i)]
    torn = spark.createDataFrame(rows, "bucket long, id long, label long, n long")
    chunks = near._chunks(near._homes(torn), 512).cache()
    sides = near._sides(near._blocks(near._seen(torn, chunks)), chunks).collect()
    assert len(sides) <= 2 * 360
    met = {(r.c1, r.c2) for r in sides}
    chunk = {r.id: r.chunk for r in chunks.collect()}
    assert all((min(chunk[a], chunk[b]), max(chunk[a], chunk[b])) in met for x, a, _, _ in rows for y, b, _, _ in rows if x == y and a < b)


def test_one_document_of_each_class_stays(messy, rows):
    out = near.one_of_each(messy)
    assert out.schema == messy.schema
    ids = [r.doc_id for r in out.collect()]
    found = {(r.doc_id, r.class_id) for r in near.near_duplicates(messy).collect()}
    assert sorted(ids, key=repr) == sorted({c for _, c in found}, key=repr)
    assert 48 in ids and not set(ids) & set(range(49, 59))


def test_empty_table(none):
    assert near.near_duplicates(none).count() == 0


def test_signatures_estimate_the_similarity():
    draw = np.random.default_rng(3)
    a, b = draw.integers(0, 1 << 63, 300).astype(np.uint64), draw.integers(0, 1 << 63, 300).astype(np.uint64)
    b[:200] = a[:200]
    wa, wb = 1 + draw.random(300), 1 + draw.random(300)
    doc = np.repeat([0, 1], 300)
    owner = near.signatures(doc, np.concatenate([a, b]), np.concatenate([wa, wb]), 2, 4096)
    i, j = np.argsort(a), np.argsort(b)
    exact = near.similarity(a[i], wa[i], b[j], wb[j])
    assert abs((owner[0] == owner[1]).mean() - exact) < 0.04
