from __future__ import annotations

import hashlib

from feedweir.llm import phrases


def brute(rows, window=50):
    """(id, text) -> (words, removed, sha256 of the kept ones)."""
    first: dict[bytes, int] = {}
    order = lambda r: phrases.LAST_ID if r[0] is None else r[0]
    split = [(order(r), r[0], r[1], (r[1] or "").encode().split()) for r in rows]
    for i, _, _, words in split:
        for p in range(len(words) - window + 1):
            key = b" ".join(words[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, doc_id, _, words in split:
        gone = [False] * len(words)
        for p in range(len(words) - window + 1):
            if first[b" ".join(words[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_every_repeat_and_nothing_else_goes(messy, rows):
    got = phrases.remove_repeats(messy, shard_bytes=20_000).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    assert sum(r.n_removed for r in got) > 500


def test_texts_lose_the_passages_and_keep_the_rest(messy, rows):
    out = phrases.without_repeats(messy)
    assert out.schema == messy.schema
    words = sorted(((r.doc_id, len((r.text or "").encode().split())) for r in out.collect()), key=repr)
    assert words == sorted(((r[0], r[1] - r[2]) for r in brute(rows)), key=repr)
    kept = {r.doc_id: r.text for r in out.collect()}
    text = {r[0]: r[1] for r in rows}
    assert kept[40] == text[40] and "\n" in kept[41] and kept[41].split()[:20] == text[41].split()[:20]


def test_empty_table(none):
    assert phrases.remove_repeats(none).count() == 0 and phrases.without_repeats(none).count() == 0


def test_overlapping_variants_of_one_passage(spark):
    words = [f"w{i}" for i in range(140)]
    rows = [(1, " ".join(words[:80])), (2, " ".join(words[30:140])), (3, " ".join(words)), (4, " ".join(["x", *words[60:120], "y"]))]
    got = phrases.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute(rows)


def test_a_common_phrase_does_not_send_every_passage_to_every_shard(spark, monkeypatch):
    """Each pair of near copies has its own passage round one licence line; only the shards of its two documents get it."""
    line = [f"licence{i}" for i in range(8)]
    rows = []
    for g in range(60):
        left, right = [f"a{g}x{i}" for i in range(45)], [f"b{g}x{i}" for i in range(45)]
        rows += [(2 * g, " ".join([*left, *line, *right])), (2 * g + 1, " ".join(["new", *left, *line, *right, "end"]))]
    sent = []
    plain = phrases.routed

    def counted(passages, confirmed):
        out = plain(passages, confirmed)
        sent.append((passages.count(), out.count(), out.select("part").distinct().count()))
        return out

    monkeypatch.setattr(phrases, "routed", counted)
    got = phrases.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), shard_bytes=4_000)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute(rows)
    passages, routed, shards = sent[0]
    assert passages == 60 and shards > 10 and routed == passages


def test_bounded_automata_remove_the_same_words(messy, rows):
    got = phrases.remove_repeats(messy, shard_bytes=20_000, automaton_words=100).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_more_distinct_words_than_code_points():
    passages = [" ".join(f"{n:x}" for n in range(at, at + 200)) for at in range(0, 1_100_000, 200)]
    found = 0
    for automaton in phrases.automata([1] * len(passages), passages, 50, phrases.AUTOMATON_WORDS):
        assert len(automaton.code) <= phrases.AUTOMATON_WORDS
        found += sum(b - a for a, b in automaton.spans(passages[-1].encode().split(), 2))
    assert found == 200
