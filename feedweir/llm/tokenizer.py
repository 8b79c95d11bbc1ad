"""Token ids of whole texts with a public tokenizer file; repeated words are looked up instead of encoded again."""

from __future__ import annotations

import os
import re
from itertools import islice

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.compute as pc  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

#: Words kept per worker; beyond that the later half is dropped.
MAX_WORDS = 600_000
#: Words encoded in one call.
CHUNK = 500
#: Marks the first word of a line, which has no space before it; texts with it in them are encoded whole.
FIRST = "\t"
_OTHER_SPACE = re.compile(r"[^\S \n]")
_RUNS = ("  ", "\n ", " \n", "\n\n")
_ENDS = ".,;:!?"
_OPEN: dict[str, Encoder] = {}


class Encoder:
    """A byte-level BPE whose pre-tokenizer never joins a non-space with a space or line feed behind it, nor a letter with a mark.

    Such a text can be cut before every space and round every line feed, and its words encoded by themselves. Only texts of words
    between single spaces and line feeds take that way; others, and texts with special tokens in them, are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line, *self.marks = self._whole(["\n", *_ENDS])
        self.known: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words, many to a call: a line feed between two words is a token of its own."""
        out: list[bytes] = []
        for a in range(0, len(words), CHUNK):
            part = words[a : a + CHUNK]
            (raw,) = self._whole(["\n".join(part)])
            cuts = np.flatnonzero(np.frombuffer(raw, self.kind) == np.frombuffer(self.line, self.kind)[0]) * self.kind.itemsize
            if len(cuts) == len(part) - 1:
                size = self.kind.itemsize
                starts, ends = [0, *(cuts + size).tolist()], [*cuts.tolist(), len(raw)]
                out += [raw[i:j] for i, j in zip(starts, ends, strict=True)]
            else:
                out += self._whole(part)
        return out

    def _learn(self, parts: list[str]) -> None:
        """Encode parts that are not known: words behind a space, and marked by ``FIRST`` the first words of lines."""
        known = self.known
        marked = [p for p in parts if len(p) > 1 and p[-1] in _ENDS and p[-2].isalpha()]
        bare = {p[:-1] for p in marked}.union(parts).difference(marked)
        new = [p for p in bare if p not in known]
        known.update(zip(new, self._words([p[1:] if p[:1] == FIRST else " " + p for p in new]), strict=True))
        for p in marked:
            known[p] = known[p[:-1]] + self.marks[_ENDS.index(p[-1])]

    def _simple(self, text: str) -> bool:
        """Whether the text is words between single spaces and line feeds."""
        if not text or text[0] in " \n" or text[-1] in " \n" or any(run in text for run in _RUNS):
            return False
        return not _OTHER_SPACE.search(text) and not any(s in text for s in self.special)

    def _by_words(self, texts: list[str]) -> list[bytes]:
        """Ids of simple texts: each distinct word of them is looked up once."""
        # a line feed becomes a part of its own; the word behind it, and the first of all, is marked
        cut = pc.replace_substring(pa.array(texts, pa.large_string()), "\n", f" \n {FIRST}")
        parts = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), cut, pa.scalar(FIRST, pa.large_string())), " ")
        words = parts.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > MAX_WORDS:  # frequent words come early: the first half stays
            self.known = dict(islice(self.known.items(), MAX_WORDS // 2))
        known = self.known
        known["\n"] = self.line
        raw = list(map(known.get, distinct))
        new = [i for i, x in enumerate(raw) if x is None]
        self._learn([distinct[i] for i in new])
        for i in new:
            raw[i] = known[distinct[i]]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // self.kind.itemsize
        starts = np.cumsum(sizes) - sizes
        ids, index = np.frombuffer(b"".join(raw), self.kind), words.indices.to_numpy()
        each = sizes[index]
        ends = np.cumsum(each)
        found = ids[np.repeat(starts[index] - (ends - each), each) + np.arange(ends[-1])].tobytes()
        bounds = (np.append(0, ends)[parts.offsets.to_numpy()] * self.kind.itemsize).tolist()
        return [found[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``kind``."""
        simple = [self._simple(text) for text in texts]
        lines = [t for t, s in zip(texts, simple, strict=True) if s]
        by_words = iter(self._by_words(lines) if lines else ())
        whole = iter(self._whole([t for t, s in zip(texts, simple, strict=True) if not s]))
        return [next(by_words if s else whole) for s in simple]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
