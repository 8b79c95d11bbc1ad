"""Toxicity: the model against a plain FTRL of dictionaries, held-out accuracy, edge cases."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from feedweir.llm import toxicity
from feedweir.llm import words as w

LABELS = "doc_id bigint, quality int, toxic int, text string"
WORDS = ["river", "house", "green", "morning", "walks", "Über", "slowly", "bridge", "market", "song"]


@pytest.fixture(scope="module")
def marked(spark):
    """Toxic: one of two words, or a pair of words each of which is harmless alone."""
    draw, rows = random.Random(3), []
    for i in range(1200):
        words = [draw.choice(WORDS) for _ in range(draw.randrange(8, 60))]
        toxic = i % 5 == 0
        at = draw.randrange(len(words) - 2)
        if toxic:
            words[at : at + 2] = draw.choice([["Oaf", "go"], ["you", "twit"], ["cold", "fish"]])
        else:
            words[at] = draw.choice(["cold", "fish", "go"])
        rows.append((i, draw.choice([" ", ", "]).join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, y, "own column") for i, _, y in rows if i % 4 != 1] + [(None, 1, 1, ""), (3, 1, None, "")], LABELS)
    return docs, labels, {i: y for i, _, y in rows}


def test_held_out_documents_are_told_apart(marked):
    docs, labels, truth = marked
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 1200 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted for r in held if truth[r.doc_id]]) > 0.95
    assert np.mean([r.predicted for r in held if not truth[r.doc_id]]) < 0.03


def test_held_out_labels_change_nothing(marked):
    docs, labels, _ = marked
    held = toxicity.held_out(labels["doc_id"])
    flipped = labels.withColumn("toxic", toxicity.F.when(held, 1 - labels["toxic"]).otherwise(labels["toxic"]))
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, x, epochs=1).collect()} for x in (labels, flipped))
    assert max(abs(a[i] - b[i]) for i in a) < 1e-6


def plain_features(text):
    """Buckets by the words as bytes, one at a time."""
    found = [x.encode() for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    found = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in found]
    if not found:
        return set()
    one = {x: int(w.split(np.frombuffer(x, np.uint8), np.array([0, len(x)]), w.NON_LETTER).hashes()[0]) for x in set(found)}
    h = [one[x] for x in found]
    mask, mixed = (1 << 64) - 1, []
    for gap, factor in toxicity._GAPS.items():
        mixed += [int(w.mix(np.array([(a * int(factor) + b) & mask], np.uint64))[0]) for a, b in zip(h, h[gap:], strict=False)]
    return {x >> (64 - toxicity.BITS) for x in h + mixed}


def test_scores_equal_a_plain_model(marked, messy, spark):
    """Sequential FTRL over dictionaries, shard by shard in the order of the ids, averaged after each epoch."""
    docs, labels, _ = marked
    known = [(r.doc_id, r.y, list(r.features), r.shard) for r in toxicity.sample(docs, labels).collect()]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(set(f) == plain_features(text[i]) for i, _, f, _ in known)
    count: dict = {}
    for _, _, f, _ in known:
        for x in f:
            count[x] = count.get(x, 0) + 1
    used = {x for x, n in count.items() if n >= toxicity.MIN_DOCS} | {"bias"}
    state = {x: (0.0, 0.0) for x in used}

    def weight(z, n):
        return 0.0 if abs(z) <= toxicity.L1 else -(z - np.sign(z) * toxicity.L1) / ((toxicity.BETA + n**0.5) / toxicity.ALPHA + toxicity.L2)

    shards = sorted({k[3] for k in known})
    for _ in range(toxicity.EPOCHS):
        ends = []
        for s in shards:
            own = dict(state)
            for _, y, f, _ in sorted(k for k in known if k[3] == s):
                at = [x for x in f if x in used] + ["bias"]
                ws = {x: weight(*own[x]) for x in at}
                g = 1 / (1 + np.exp(-sum(ws.values()))) - y
                for x in at:
                    z, n = own[x]
                    own[x] = (z + g - ((n + g * g) ** 0.5 - n**0.5) / toxicity.ALPHA * ws[x], n + g * g)
            ends.append(own)
        state = {x: tuple(sum(e[x][k] for e in ends) / len(ends) for k in (0, 1)) for x in used}
    final = {x: weight(*state[x]) for x in used}
    asked = docs.limit(50).union(messy.select("doc_id", "text"))
    model = toxicity.fit(docs, labels)
    assert set(model.bucket.tolist()) == {x for x, v in final.items() if v and x != "bias"}
    for r in asked.collect():
        want = 1 / (1 + np.exp(-sum(final[x] for x in plain_features(r.text) | {"bias"} if x in final)))
        out = next(toxicity._scored(model)(iter([toxicity.pa.record_batch({"doc_id": [r.doc_id], "text": toxicity.pa.array([r.text], toxicity.pa.string())})])))
        assert abs(out.column("score")[0].as_py() - want) < 1e-4


def test_rows_of_one_id_are_fitted_once(spark, marked):
    docs, labels, _ = marked
    again = docs.union(docs.where("doc_id = 8")).union(docs.where("doc_id = 8")).union(spark.createDataFrame([(8, "another text")], docs.schema))
    got = toxicity.sample(again, labels)
    assert got.where("doc_id = 8").count() == 1 and got.count() == toxicity.sample(docs, labels).count()


def test_sample_is_bounded(marked):
    docs, labels, _ = marked
    assert 20 < toxicity.sample(docs, labels, 100).count() < 200


def test_messy_and_empty_tables(messy, none, rows, marked):
    docs, labels, _ = marked
    got = toxicity.score(messy, labels.select("doc_id", "toxic", "text")).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None and not r.held_out for r in got) == 2
    assert {r.score for r in toxicity.score(messy, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(none, labels).count() == 0
    blank = messy.where("trim(text) = ''")
    assert len({r.score for r in toxicity.score(blank, labels).collect()}) == 1
