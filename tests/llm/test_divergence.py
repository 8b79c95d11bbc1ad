"""Source divergence against a count of every term of every group."""

from __future__ import annotations

import collections
import re

import pytest

from feedweir.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs, top):
    """rows: (text, lang, source)."""
    cells, docs = collections.Counter(), collections.Counter()
    groups = {(lang or "", source or "") for _, lang, source in rows}
    for text, lang, source in rows:
        found = [t.translate(AZ) for t in TERM.findall(text or "")]
        cells.update((lang or "", source or "", t) for t in found)
        docs.update((lang or "", t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= min_docs]
        sources = [s for x, s in groups if x == lang]
        share = lambda count, total: 1 + 10**9 * (count + 2) // (total + 2 * len(kept))
        total = {s: sum(cells[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: share(cells[lang, s, t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(cells[lang, s, t] for s in sources), sum(total.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if cells[lang, s, t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


def as_rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("min_docs", [1, 3, 10**6])
def test_equals_a_count_of_every_term(messy, rows, min_docs):
    docs = messy.withColumn("lang", divergence.F.expr("if(doc_id % 7 = 0, null, if(doc_id % 3 = 0, 'é', 'en'))"))
    plain = [(t, None if i is None else (None if i % 7 == 0 else "é" if i % 3 == 0 else "en"), s) for i, t, s, *_ in rows]
    plain = [(t, "en" if i is None else lang, s) for (t, lang, s), (i, *_) in zip(plain, rows, strict=True)]
    assert as_rows(divergence.audit(docs, min_docs)) == brute(plain, min_docs, divergence.TOP)


def test_many_levels_hot_source_and_group_without_terms(spark):
    """One source holds most rows, counts reach into the thousands, one group has no terms, several bitmap words are in use."""
    rows = [(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300) if d % (1 + i // 8) == 0) * (1 + d % 5), "en", "hot" if d % 4 else f"s{d % 3}") for d in range(240)]
    rows += [("123 ... 456", "en", "empty"), ("Only ONE", "xx", None)]
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term string").repartition(5)
    assert as_rows(divergence.audit(docs)) == brute(rows, 10, 10)


def test_counts_above_the_limit_of_a_task_are_given_out_in_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence.w.Tally.__init__, "__defaults__", (3,))
    import pyarrow as pa

    batch = pa.record_batch({"lang": ["en"] * 3, "source": ["a", "b", "a"], "text": ["x y z x", "x x q", None]})
    got = collections.Counter()
    for out in divergence._count(iter([batch, batch])):
        for r in out.to_pylist():
            got[r["source"], r["term"]] += r["count"]
    assert got == {("a", "x"): 4, ("a", "y"): 2, ("a", "z"): 2, ("b", "x"): 4, ("b", "q"): 2, ("a", ""): 0, ("b", ""): 0}


def test_empty_table(none):
    assert divergence.audit(none.withColumn("lang", divergence.F.lit("en"))).count() == 0
