"""Fingerprints and shards."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import functions as F

from feedweir.llm import sharding, winnowing


def test_fingerprints_follow_the_definition(spark, rows):
    texts = sorted({r[1] or "" for r in rows if len(r[1] or "") < 3000})
    df = winnowing.fingerprinted(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "chosen")
    hashed = {r[0]: r[1] for r in spark.createDataFrame([(x,) for t in texts for x in t.encode().decode().split()], "w string").distinct().select("w", F.xxhash64("w")).collect()}
    for i, _, chosen in df.collect():
        words = [x for x in __import__("re").split(r"[\t-\r ]+", texts[i]) if x]
        at = [winnowing._LOW - (c & winnowing._LOW) for c in chosen]
        values = [c >> winnowing.POSITION_BITS for c in chosen]
        n = max(len(words) - winnowing.GRAM + 1, min(len(words), 1))
        assert all(0 <= p < n for p in at) and len(set(at)) == len(at)
        windows = max(1, n - winnowing.WIDTH + 1) if n else 0
        assert all(any(s <= p < s + winnowing.WIDTH for p in at) for s in range(windows)), "every window has a choice"
        assert bool(words) == bool(values)
    assert hashed


def test_rightmost_of_equal_hashes_is_chosen(spark):
    (chosen,) = winnowing.fingerprinted(spark.createDataFrame([(" ".join(["a"] * 20),)], "t string"), "t", "c").select("c").first()
    assert [winnowing._LOW - (c & winnowing._LOW) for c in chosen] == list(range(7, 16))


def test_edited_texts_and_neighbours(messy, rows):
    got = winnowing.edited(messy, rows=7).collect()
    assert len(got) == len(rows)
    order = sorted({r[0] for r in rows if r[0] is not None and r[0] != 63}, reverse=True)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        if r.doc_id in order and r.doc_id not in (0, 64, 62, 63):
            following = order[order.index(r.doc_id) + 1]
            cut = len(r.text) // 3
            if following != 62:
                assert r.edited == r.text[: len(r.text) - cut] + text[following][:cut], r.doc_id
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = {}
    for r in got:
        assert same.setdefault(r.text, r.chosen) == r.chosen
    alike = [r for r in got if r.doc_id == 57]
    assert alike[0].near_next == 1.0


def test_single_document_is_its_own_next(spark):
    (r,) = winnowing.edited(spark.createDataFrame([(5, "a b c d e f g h i")], "doc_id bigint, text string")).collect()
    assert r.near_next == 1.0 and r.edited == r.text[:12] + r.text[:5]


def test_empty_table(none):
    assert winnowing.edited(none).count() == 0 and sharding.shard(none).count() == 0


def test_shards_are_even_and_gapless(messy, rows):
    got = sharding.shard(messy, shards=8).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(
        ((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=repr
    )
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert [r.position for r in sorted(got, key=lambda r: r.number)] != sorted(r.position for r in got)


def test_permutation_is_a_permutation(spark):
    for n in (1, 2, 3, 5, 17, 64, 1000, 4097):
        moved = spark.range(n).select(F.expr(sharding.permutation("id", n, 3)).alias("p"))
        assert sorted(r.p for r in moved.collect()) == list(range(n))


def test_sha(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
