"""Words and word n-grams of a batch of texts as numpy arrays: one vectorised pass over the UTF-8 bytes of many texts.

A word is a maximal run of bytes outside a separator set. Hashes are polynomials modulo 2**64 of the bytes (words) or of
the word hashes (n-grams), finished with a mixing step; they depend on the word alone, never on where it stands, on the
batch or on the Python process.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; longer single texts are walked through in pieces that end between words.
SLICE_BYTES = 1 << 20
POINT_BITS = 24
_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII that is not a letter.
NON_LETTER = np.array([not chr(b).isalpha() if b < 128 else False for b in range(256)])
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything in ASCII that is neither a letter, a digit nor an underscore.
NON_WORD = np.array([not (chr(b).isalnum() or chr(b) == "_") if b < 128 else False for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xCA5A826395121157)
    return h ^ (h >> np.uint64(32))


class _Powers:
    """base**i and base**-i modulo 2**64 for i < n, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, size, 1 << 64))])
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in _BASES)


def powers(n: int, base: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base of the polynomials and of its inverse, at least n of each."""
    return _POWERS[base].upto(n + 1)


@dataclass
class Words:
    """Words of the texts of one slice. ``first[d]`` to ``first[d + 1]`` are the words of text d."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, base: int = 0) -> np.ndarray:
        """64-bit hash of every word."""
        out = np.zeros(len(self.start), np.uint64)
        powers, i, n = _POWERS[base], 0, len(self.start)
        while i < n:
            at = int(self.start[i])
            j = max(int(np.searchsorted(self.end, at + SLICE_BYTES, "right")), i + 1)
            stop = int(self.end[j - 1])
            if stop - at > SLICE_BYTES:  # one word longer than a slice
                total = 0
                for k in range(at, stop, SLICE_BYTES):
                    part = self.buf[k : min(stop, k + SLICE_BYTES)].astype(np.uint64) + np.uint64(1)
                    up, _ = powers.upto(len(part))
                    total += int((part * up[: len(part)]).sum(dtype=np.uint64)) * pow(powers.base, k - at, 1 << 64)
                out[i] = np.uint64(total & _MASK)
            else:
                part = self.buf[at:stop].astype(np.uint64) + np.uint64(1)
                up, down = powers.upto(len(part) + 1)
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(part * up[: len(part)], out=sums[1:])
                s, e = self.start[i:j] - at, self.end[i:j] - at
                out[i:j] = (sums[e] - sums[s]) * down[s]
            i = j
        return mix(out)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("" if not pa.types.is_binary(array.type) else b"")
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def split(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray = WHITE) -> Words:
    """Cut the texts into words. A text border always ends a word."""
    return runs(buf, offsets, ~separators[buf])


def runs(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """The maximal runs of bytes that are ``inside``. A text border always ends a run."""
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    border = np.unique(offsets[(offsets > 0) & (offsets < len(buf))])
    starts[border] = inside[border]
    ends[border - 1] = inside[border - 1]
    start = np.flatnonzero(starts)
    return Words(buf, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def slices(
    array: pa.Array, separators: np.ndarray | Callable[[np.ndarray], np.ndarray] = WHITE, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) for runs of rows of at most ``limit`` bytes, or one row where it is longer.

    ``separators`` is a table of bytes, or a function that tells of each byte of a text whether it is part of a word.
    """
    buf, offsets = column(array)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1, lo + 1)
        part, at = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        yield lo, hi, runs(part, at, separators(part)) if callable(separators) else split(part, at, separators)
        lo = hi


def grams(hashes: np.ndarray, k: int, base: int = 0) -> np.ndarray:
    """Hash of the k words that begin at each word (at the last k - 1 words: of nothing); borders are the caller's."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _POWERS[base].upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def whole(hashes: np.ndarray, first: np.ndarray, base: int = 0) -> np.ndarray:
    """Hash of the whole word sequence of each text, its length included."""
    up, down = _POWERS[base].upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64))


def fits(words: Words, k: int) -> np.ndarray:
    """Indices of the words at which k words of the same text begin."""
    last = np.repeat(words.first[1:], words.counts)
    i = np.arange(len(words.start))
    return i[i + k <= last]


def rightmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of each ``width`` consecutive values, by the upper bits; of equal ones the last."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    limit = (1 << POINT_BITS) - 1
    step = limit - width
    if len(values) > limit:
        return np.concatenate([rightmost_minima(values[a : a + step + width - 1], width) + a for a in range(0, n, step)])
    low = np.uint64(limit)
    m = (values & ~low) | (low - np.arange(len(values), dtype=np.uint64))
    size = 1
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: n], m[width - size : width - size + n])
    return (low - (m[:n] & low)).astype(np.int64)


def strings(words: Words) -> pa.StringArray:
    """All words in their order, A-Z as a-z."""
    size = words.end - words.start
    edge = np.zeros(len(words.buf) + 1, np.int8)
    edge[words.start] += 1
    edge[words.end] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(LOWER[words.buf[inside]]))


class Tally:
    """Sums by key of the rows of a task: combined as they come, given out when more than ``limit`` keys are held."""

    def __init__(self, keys: list[str], sums: list[str], limit: int = 400_000):
        self.keys, self.sums, self.limit, self.held, self.rows, self.least = keys, sums, limit, [], 0, 0

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        self.held.append(table)
        self.rows += table.num_rows
        if self.rows > max(self.limit, 2 * self.least):
            self._combine()
            if self.rows > self.limit:
                yield from self.flush()

    def _combine(self) -> None:
        added = pa.concat_tables(self.held).group_by(self.keys, use_threads=False).aggregate([(s, "sum") for s in self.sums])
        added = added.rename_columns([c.removesuffix("_sum") for c in added.column_names]).select(self.keys + self.sums)
        self.held, self.rows, self.least = [added], added.num_rows, added.num_rows

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._combine()
            yield from self.held[0].to_batches(max_chunksize=1 << 16)
        self.held, self.rows, self.least = [], 0, 0


def lists(values: np.ndarray, group: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """One list for each of n rows from values sorted by their row."""
    ends = np.searchsorted(group, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values).cast(kind))


def unique_pairs(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, value) sorted, and how often each stands there."""
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return g[at], v[at], np.diff(np.append(at, len(g)))


def distinct_counts(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group and frequency of its distinct values, told apart by their upper 44 bits: for statistics, by one plain sort."""
    keys, times = np.unique((group.astype(np.uint64) << np.uint64(44)) | (values >> np.uint64(20)), return_counts=True)
    return (keys >> np.uint64(44)).astype(np.int64), times


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
