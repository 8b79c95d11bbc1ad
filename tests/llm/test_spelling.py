"""Spelling variants against all pairs of words."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest

from feedweir.llm import spelling

AZ = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {x: c for x, c in count.items() if len(x) >= 7 and c >= 2}
    near = {x: sorted((y for y in n if one_edit(x, y)), key=lambda y: (-n[y], y)) for x in n}
    form = {x: near[x][0] if near[x] and n[near[x][0]] >= 10 * n[x] else None for x in n}

    def root(x):
        while form[x]:
            x = form[x]
        return x

    return sorted((x, n[x], len(near[x]), form[x], form[x] and n[form[x]], root(x)) for x in n)


def as_rows(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def same(got, want):
    assert [r[0] for r in got] == [r[0] for r in want]
    assert got == want


@pytest.mark.parametrize("symbols", [1, 3, 8])
def test_equals_all_pairs_of_words(spark, symbols):
    """Chains of forms, ties, hot words, letters beyond ASCII, words of every border length and runs of one letter."""
    draw, rows = random.Random(4), []
    bases = ["".join(draw.choice("abcé") for _ in range(draw.choice([7, 8, 9]))) for _ in range(25)] + ["straße" * 2, "a" * 9, "ÀÉÿ×÷ñabc"]
    for i in range(150):
        words = []
        for b in bases:
            x, times = b, draw.choice([1, 1, 2, 30])
            for _ in range(draw.choice([0, 0, 1, 2])):
                at = draw.randrange(len(x))
                x = draw.choice([x[:at] + x[at + 1 :], x[:at] + draw.choice("abcdé") + x[at:], x[:at] + draw.choice("abcdé") + x[at + 1 :]])
                times = 1
            words += [x.upper() if draw.random() < 0.1 else x] * times
        rows.append((i if i % 9 else None, draw.choice([" ", "’", "1", "Ā"]).join(words)))
    rows += [(200, None), (201, ""), (202, "short"), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "w", 5) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    want = brute(rows)
    assert any(r[3] for r in want) and any(r[5] != r[3] and r[3] for r in want)
    same(as_rows(spelling.variants(docs, symbols)), want)


def test_long_words_meet_words_of_every_length(spark):
    draw = random.Random(8)
    base = "".join(draw.choice("abcdefgh") for _ in range(63))
    words = [base, base + "x", base + "xy", base[:30] + "z" + base[30:] + "xy", base + "xyz"]
    huge = "".join(draw.choice("ab") for _ in range(20_000))
    words += [huge, huge[:7777] + "c" + huge[7777:], huge[:100] + "q" + huge[101:]]
    rows = [(i, " ".join([x] * (2 if k % 2 else 40))) for i in range(3) for k, x in enumerate(words)]
    same(as_rows(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))), brute(rows))


def test_keys_stand_for_all_reduced_words_one_edit_apart():
    draw = random.Random(2)
    words = sorted({"".join(draw.choice("abcdxyz") for _ in range(draw.choice([3, 4, 5]))) for _ in range(120)})
    array, table = spelling.pa.array(words), spelling.symbols_of(3)
    who, keys, _ = spelling.neighbourhoods(array, 3)
    own = dict(zip(spelling.neighbourhoods(array, 3, True)[1].tolist(), range(10**6), strict=False))
    small = ["".join(chr(97 + table[ord(c)]) for c in x) for x in words]
    reached = {(i, own[k]) for i, k in zip(who.tolist(), keys.tolist(), strict=True) if k in own}
    first = {r: i for i, r in reversed(list(enumerate(small)))}
    last = {r: i for i, r in enumerate(small)}
    for i, a in enumerate(small):
        for b in first:
            if a == b or one_edit(a, b):
                assert (i, last[b]) in reached or any((j, last[a]) in reached for j in range(len(small)) if small[j] == b), (a, b)


def test_messy_and_empty_tables(messy, none, rows):
    same(as_rows(spelling.variants(messy)), brute([r[:2] for r in rows]))
    assert spelling.variants(none).count() == 0
