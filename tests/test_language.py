"""Language scores: exact sums, bounded memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from feedweir.operators import documents as D


def test_scores_do_not_depend_on_the_order_of_the_sum():
    gram = lambda t: (ord(t[0]) << 42) | (ord(t[1]) << 21) | ord(t[2])
    text = " " + "abcdefghijklmnopqrstuvwxyz" * 40 + " "
    grams = sorted({gram(text[i : i + 3]) for i in range(len(text) - 2)})
    points = np.array([[300 - 7 * i for i in range(len(grams))]], float)
    total = [text[i : i + 3] for i in range(len(text) - 2)]
    want = sum(int(points[0][grams.index(gram(t))]) for t in total) / (300 * len(total))
    batch = pa.RecordBatch.from_pydict({"letters": [text], "doc_id": [1]})
    (out,) = D._scores(np.array(grams), points, 300)(iter([batch]))
    assert out.column("mean").to_pylist() == [[want]]


def test_counting_holds_distinct_trigrams_only():
    rng = np.random.default_rng(1)
    texts = [" " + "".join(rng.choice(list("abcdefgh "), 20_000)) + " " for _ in range(8)]

    def peak(copies):
        batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 8 * copies, "letters": texts * copies})
        tracemalloc.start()
        (out,) = D._count_trigrams(iter([batch]))
        used = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(out.column("n").to_pylist()) == copies * sum(len(t) - 2 for t in texts)
        return used

    assert peak(40) < 2 * peak(10)
