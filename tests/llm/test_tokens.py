"""Token counts and packing."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, normalizers

from feedweir.llm import packing, viterbi
from feedweir.llm.tokenizer import Encoder

BPE, UNIGRAM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def odd_texts(n):
    draw = random.Random(4)
    parts = ["a", "b", "é", "'s", "'t", ".", " ", "\n", "\t", " ", "  ", "1", "2", ",", "!", "中", "<|endoftext|>", "word", "I'm", "don't", "\u0301", "ß", "▁", "'"]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(25))) for _ in range(n)]


def test_encoder_equals_the_tokenizer(rows):
    encoder, plain = Encoder(BPE), Tokenizer.from_file(BPE)
    texts = [r[1] or "" for r in rows] + odd_texts(3000)
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, encoder.kind).tolist() == plain.encode(text, add_special_tokens=False).ids, text[:60]


def test_simple_texts_are_looked_up_by_their_distinct_words():
    encoder, plain = Encoder(BPE), Tokenizer.from_file(BPE)
    texts = ["the cat, the end.\nthe the\nCat ends.", "x", "the\nx\nthe", "é, 中! don't"]
    asked = []
    encoder._words, words = lambda new: asked.extend(new) or words(new), encoder._words
    for _ in range(2):
        raw = encoder._by_words(texts)
        assert [np.frombuffer(r, encoder.kind).tolist() for r in raw] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) == len(set(asked)) and all(encoder._simple(t) for t in texts)


def test_counts_equal_the_tokenizer(rows):
    pieces = viterbi.vocabulary(UNIGRAM)
    plain = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    plain.normalizer = normalizers.Sequence([normalizers.Prepend(viterbi.MARK), normalizers.Replace(" ", viterbi.MARK)])
    counter = viterbi.Counter(pieces)
    texts = [r[1] or "" for r in rows] + odd_texts(2000)
    assert counter.counts(texts) == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]


def test_ties_follow_the_tokenizer():
    """Equal scores everywhere, pieces across spaces and unknown runs."""
    draw, letters = random.Random(8), "abc▁"
    for across in (False, True):
        pieces = [("<unk>", 0.0), *((x, -1.0) for x in letters)]
        pieces += list({"".join(draw.choice("abc") for _ in range(draw.randrange(2, 5))): -1.0 for _ in range(25)}.items())
        pieces += [("▁a", -1.0), ("▁▁", -2.0)] + ([("a▁b", -1.5)] if across else [])
        plain = Tokenizer(models.Unigram(pieces, unk_id=0))
        plain.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
        counter = viterbi.Counter(pieces)
        texts = ["".join(draw.choice("abc  zz") for _ in range(draw.randrange(30))) for _ in range(500)]
        assert counter.counts(texts) == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]


def test_counts_of_a_table(messy, none, rows):
    assert viterbi.token_counts(messy, UNIGRAM).count() == len(rows) and viterbi.token_counts(none, UNIGRAM).count() == 0


@pytest.mark.parametrize("targets", [None, {"hot": 0.5, "s0": 0.5}, {"s1": 1.0, "absent": 2.0}])
def test_packing_is_whole_and_mixed(messy, rows, targets):
    plain = Tokenizer.from_file(BPE)
    pieces = packing.pack(messy, BPE, targets=targets, size=256).collect()
    want = sorted((r[0] if r[0] is not None else -1, *plain.encode(r[1] or "", add_special_tokens=False).ids, 1) for r in rows)
    texts, sequences = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        texts.setdefault(p.doc_id, []).append((p.start, ids))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length, p.queue))
    once = [w for w in want if [x[0] for x in want].count(w[0]) == 1]
    for doc_id, *ids in once:
        at, joined = 0, []
        for start, part in sorted(texts[None if doc_id == -1 else doc_id]):
            assert start == len(joined)
            joined += part
        assert joined == ids and at == 0
    assert sum(p.length for p in pieces) == sum(len(w) - 1 for w in want)
    assert sorted(sequences) == list(range(len(sequences)))
    sizes = []
    for _, parts in sorted(sequences.items()):
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert set(sizes[:-1]) <= {256} and sizes[-1] <= 256


def test_every_full_window_has_the_mixture():
    totals, size = np.array([50_000, 7_000, 300, 123_456]), 2048
    phases = packing.schedule(totals, totals.astype(float), size)
    share = totals / totals.sum()
    filled = np.zeros(4, np.int64)
    for phase in phases[:1]:
        for k in range(phase.count):
            quota = phase.taken(k + 1) - phase.taken(k)
            assert quota.sum() == size
            filled += quota
            assert np.abs(filled - share * size * (k + 1)).max() < 4, "deficits are carried, not lost"
    last = phases[-1]
    assert (last.used + last.taken(last.count) == totals).all()
    assert phases[0].count >= 0.98 * totals.sum() // size


def test_schedule_uses_everything():
    draw = np.random.default_rng(2)
    for _ in range(200):
        totals = draw.integers(0, 3000, draw.integers(1, 6))
        weights = draw.random(len(totals)) * draw.integers(0, 2, len(totals))
        phases = packing.schedule(totals, weights, 64)
        assert sum(p.taken(p.count) for p in phases).tolist() == totals.tolist() if phases else not totals.sum()
        assert [p.first for p in phases] == np.cumsum([0, *[p.count for p in phases]])[:-1].tolist()


@pytest.mark.parametrize("scale", [1, 1000])
def test_rare_sources_keep_their_share_over_thousands_of_windows(scale):
    """Sources of less than a token per hundred windows lie near their targets throughout; ``scale`` 1000 needs more than 64 bits."""
    size = 2048
    totals = np.array([3_000_000, 7, 86, *[40] * 300, 4_000_000, 1, 2_500, *range(1, 60)], np.int64) * scale
    totals[1] = 7
    phases = packing.schedule(totals, totals, size)
    windows = int(totals.sum()) // size
    assert windows > 3000 and phases[0].count == windows
    for k in [*range(1, windows, max(1, windows // 2000)), windows]:
        due = totals / totals.sum() * size * k
        assert np.abs(phases[0].taken(k) - due).max() < 6, k
    last = phases[-1]
    assert (last.used + last.taken(last.count) == totals).all()


def test_pieces_equal_the_quotas_token_by_token():
    draw = np.random.default_rng(5)
    for _ in range(60):
        weights, size = draw.integers(0, 40, draw.integers(1, 12)), int(draw.integers(3, 30))
        count = int(weights.sum()) // size
        if not count:
            continue
        phase = packing.Phase(4, count, weights, np.zeros(len(weights), np.int64), size)
        upto = np.array([phase.taken(k) for k in range(count + 1)])
        quotas = np.diff(upto, axis=0)
        assert (quotas >= 0).all() and (quotas.sum(axis=1) == size).all()
        filled = np.zeros((count, size), int)
        for q in np.flatnonzero(upto[-1]):
            n = int(upto[-1][q])
            cut = int(draw.integers(0, n))
            runs = [(a, b) for a, b in ((0, cut), (cut, n)) if b > a]
            starts, stops = np.array(runs).T
            row, a, b, window, offset = phase.pieces(np.full(len(runs), q), starts, stops)
            assert (b - a).sum() == n
            for x, y, k, o in zip(a, b, window - 4, offset, strict=True):
                assert upto[k][q] <= x < y <= upto[k + 1][q]
                filled[k, o : o + y - x] += 1
        assert (filled == 1).all()


def test_every_source_has_its_own_queue(spark):
    rows = [(i, "one two three four", f"s{i % 350}") for i in range(700)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), BPE, size=64).collect()
    assert len({p.queue for p in pieces}) == 350
    assert sum(p.length for p in pieces) == sum({p.doc_id: p.doc_tokens for p in pieces}.values())


def test_empty_table(none):
    assert packing.pack(none, BPE).count() == 0
