"""URL rules and search."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedweir.llm import search, url_rules

URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/EN/", "x://net", "x://net/", "http://b.example.com/de/x?y#z", "http://example.com/de", "no scheme",
    "", None, "http://fr.org/fr/", "http://org/fr/a/b", "http://notnet/", "http://u@h.net:80/p", "://", "http://example.net/en/?://", "http://x.net?/q", "a://b://c/d",
]
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("x.net", "allow"), ("net/", "allow"), (None, "block"), ("", "block")]


def verdict(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule in {r for r, _ in RULES if r}:
        at = rule.find("/") if "/" in rule else len(rule)
        fits = (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:])
        if host and fits and (best is None or len(rule) > len(best)):
            best = rule
    blocks = best and any(r == best and v == "block" for r, v in RULES)
    return host, path, best, "block" if blocks else "allow"


@pytest.mark.parametrize("shard_rules", [1, 2, 1000])
def test_longest_rule_decides(spark, shard_rules):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] * 2, "page_id bigint, url string, rule string, host string")
    got = url_rules.judge(pages, spark.createDataFrame(RULES, "rule string, verdict string"), shard_rules).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == verdict(URLS[r.page_id]), URLS[r.page_id]


def test_no_rules_and_no_pages(spark):
    none = spark.createDataFrame([], "rule string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    assert [r.verdict for r in url_rules.judge(pages, none).collect()] == ["allow"]
    assert url_rules.judge(pages.limit(0), none).count() == 0


def test_digests_that_collide_are_told_apart(monkeypatch, spark):
    monkeypatch.setattr(url_rules, "digests", lambda strings: np.array([len(s) % 3 for s in strings], np.uint64))
    folder = str(__import__("tempfile").mkdtemp(prefix="spark-", dir="/tmp"))
    rules = ["a.b/", "c.d/", "ee.f/"]
    url_rules._store(folder)(__import__("pandas").DataFrame({"rule": rules, "block": [True, False, True], "shard": [0] * 3}))
    found = url_rules.Rules(folder, [0], 1).find([*rules, "x.y/", "zz.z/"])
    assert found == [True, False, True, None, None]


def bm25(rows, queries, k):
    words = [[x for x in re.split(r"[^0-9a-z_\x80-\U0010ffff]+", (t or "").lower()) if x] for _, t in rows]
    tf, n = [Counter(x) for x in words], len(rows)
    df = Counter(t for c in tf for t in c)
    mean = sum(map(len, words)) / max(n, 1)
    out = []
    for q, text in queries:
        terms, hits = Counter(x for x in re.split(r"[^0-9a-z_\x80-\U0010ffff]+", (text or "").lower()) if x), []
        for (doc_id, _), c, size in zip(rows, tf, map(len, words), strict=True):
            score = sum(
                m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (search.K1 + 1) / (c[t] + search.K1 * (1 - search.B + search.B * size / mean))
                for t, m in terms.items() if c[t]
            )
            if round(score, 6) > 0:
                hits.append((-round(score, 6), doc_id is not None, doc_id or 0, doc_id))
        out += [(q, h[3], rank + 1) for rank, h in enumerate(sorted(hits)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard_rows", "query_bytes"), [(1000, 1 << 20), (9, 3000)])
def test_search_is_exact(messy, rows, shard_rows, query_bytes):
    plain = [(r[0], r[1]) for r in rows]
    queries = messy.where("doc_id % 4 = 0").selectExpr("doc_id AS query_id", "text", "'clash' AS doc_id")
    asked = [(i, t) for i, t in plain if i is not None and i % 4 == 0]
    got = search.top_k(messy, queries, k=5, shard_rows=shard_rows, query_bytes=query_bytes).collect()
    assert sorted(((r.query_id, r.doc_id, r["rank"]) for r in got), key=repr) == bm25(plain, asked, 5)


def test_empty_tables(none, messy):
    queries = messy.selectExpr("doc_id AS query_id", "text")
    assert search.top_k(none, queries).count() == 0 and search.top_k(messy, queries.limit(0)).count() == 0


def test_groups_of_queries_meet_a_shard_exactly(monkeypatch):
    """Single precision and the score to reach lose no document, however queries are grouped."""
    draw = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in draw.zipf(1.3, draw.integers(1, 80)) if x < 4000) for _ in range(700)]
    texts += texts[:40] + ["only tie"] * 12 + [""]
    index = search._index((pa.scalar(0, pa.int32()),), pa.table({"doc_id": pa.array(range(len(texts))), "text": texts})).to_pylist()[0]
    shard = search.Shard(index, index["n_words"] / index["n_docs"])
    assert 0 < len(shard.rows) < len(shard.terms)
    size = np.diff(shard.starts)
    picked = [np.unique(draw.integers(0, len(size), draw.integers(0, 200))) for _ in range(300)] + [np.arange(len(size))]
    weights = [draw.integers(1, 4, len(p)) * np.log1p((len(texts) - size[p] + 0.5) / (size[p] + 0.5)) for p in picked]
    rows = pa.table({
        "query_id": pa.array(range(500, 500 + len(picked))), "weight": pa.array([w.tolist() for w in weights], pa.list_(pa.float64())),
        "term": pa.array([[*shard.terms[p].view(np.int64).tolist(), -5] for p in picked], pa.list_(pa.int64())),
    })
    rows = rows.set_column(1, "weight", pa.array([[*w.tolist(), 2.5] for w in weights], pa.list_(pa.float64())))
    asked = search.Queries.of(rows)
    full = np.zeros((len(size), shard.n))
    for t in range(len(size)):
        full[t, shard.docs[shard.starts[t] : shard.starts[t + 1]]] = shard.impact[shard.starts[t] : shard.starts[t + 1]]
    score = np.array([np.round(w @ full[p], 6) for p, w in zip(picked, weights)])[asked.ids - 500]
    for k, floors in ((7, np.full(len(picked), -np.inf)), (7, np.sort(score, axis=1)[:, -5]), (1, np.sort(score, axis=1)[:, -1])):
        want = {q: sorted((-x, shard.ids[d]) for d, x in enumerate(row) if x > 0 and x >= floors[q])[:k] for q, row in enumerate(score)}
        for group, postings in ((256, 1 << 17), (3, 50)):
            monkeypatch.setattr(search, "EXACT", postings)
            monkeypatch.setattr(search, "GROUP", group)
            monkeypatch.setattr(search, "POSTINGS", postings)
            got = {}
            for queries, places, found in shard.best(asked, floors, k):
                for q, d, x in zip(queries, shard.ids[places], found, strict=True):
                    got.setdefault(q, []).append((-x, d))
            assert got == {q: hits for q, hits in want.items() if hits}


def test_a_shard_is_searched_by_groups_and_in_few_waves(monkeypatch):
    """Work per query and shard is what they share, not calls: a group of queries is one product of matrices and few passes over postings."""
    calls = []
    whole = search.Shard._of_group
    monkeypatch.setattr(search.Shard, "_of_group", lambda self, lo, hi, *a: calls.append(hi - lo) or whole(self, lo, hi, *a))
    index = search._index((pa.scalar(0, pa.int32()),), pa.table({"doc_id": pa.array(range(50)), "text": [f"a b{i}" for i in range(50)]})).to_pylist()[0]
    shard, n = search.Shard(index, 2.0), 1000
    terms = pa.array([shard.terms[[i % 50]].view(np.int64).tolist() for i in range(n)], pa.list_(pa.int64()))
    asked = search.Queries.of(pa.table({"query_id": pa.array(range(n)), "term": terms, "weight": pa.array([[1.0]] * n)}))
    assert sum(len(set(queries)) for queries, _, _ in shard.best(asked, np.full(n, -np.inf), 3)) == n
    assert sum(calls) == n and len(calls) <= n // 200
    assert len(search.waves(1000)) <= 7


def test_waves_cover_all_shards_once():
    for shards in (1, 3, 4, 5, 9, 64, 1000):
        ranges = search.waves(shards)
        assert [x for lo, hi in ranges for x in range(lo, hi)] == list(range(shards))
        assert len(ranges) <= max(1, shards.bit_length())


def test_a_batch_of_large_rows_is_bounded(spark):
    """Rows of an index are megabytes each; a worker holds few of them at once."""
    from feedweir.llm import scratch

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    rows = scratch.configure(spark).range(0, 16, 1, 1).select(F.expr("cast(repeat('x', 4000000) AS binary)").alias("b"))
    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) < 2 * scratch.BATCH_BYTES
