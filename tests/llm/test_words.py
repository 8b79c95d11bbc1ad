from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from feedweir.llm import words as w


@pytest.mark.parametrize("limit", [10, 1000, 1 << 20])
def test_words_and_hashes_do_not_depend_on_slices(rows, limit, monkeypatch):
    monkeypatch.setattr(w, "SLICE_BYTES", limit)
    texts, seen = [r[1] for r in rows], {}
    for lo, hi, ws in w.slices(pa.array(texts), limit=limit):
        h = ws.hashes()
        for d in range(hi - lo):
            a, b = ws.first[d], ws.first[d + 1]
            want = (texts[lo + d] or "").encode().split()
            assert [ws.word(i) for i in range(a, b)] == want
            assert all(seen.setdefault(x, h[i]) == h[i] for i, x in zip(range(a, b), want, strict=True))
    assert len(seen) == len(set(seen.values()))


@pytest.mark.parametrize("bits", [24, 8])
def test_minima_are_the_rightmost(bits, monkeypatch):
    monkeypatch.setattr(w, "POINT_BITS", bits)
    values = np.random.default_rng(1).integers(0, 5, 2000).astype(np.uint64) << np.uint64(40)
    got = w.rightmost_minima(values, 43)
    assert got.tolist() == [i + 42 - int(np.argmin(values[i : i + 43][::-1])) for i in range(len(values) - 42)]
