"""Token counts of a unigram tokenizer without building its tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character; dynamic programming carries the best score
and the number of pieces to each position. Ties follow the tokenizer: of equally good ways to reach a position the one
whose last piece begins first is kept. A character that no piece of its own covers costs ten less than the lowest score; runs of such
characters are one unknown piece, or their UTF-8 bytes where the vocabulary has byte pieces.

Spaces are written as the vocabulary's space mark, one is put before the text. Where no piece has the mark after another
character, the best path of a text is the best paths of its space-led words put together, so counts of words are kept and looked up.

Edge cases: null and empty texts have no tokens; long words without spaces cost time and memory in proportion to their length;
repeated rows are counted each; null ids stay; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words kept per worker; beyond that the store starts afresh.
MAX_WORDS = 400_000
_OPEN: dict[str, Counter] = {}
_WORDS = re.compile(" *[^ ]+| +")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        known = {p for p, _ in pieces}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in known for b in range(256))
        self.by_word = MARK in known and not any(MARK in p.lstrip(MARK) for p in known)
        self.words: dict[str, int] = {}

    def best(self, text: str) -> int:
        """Pieces of the best path through ``text`` (spaces already written as marks)."""
        n = len(text)
        score, count, open_end = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        ends = self.automaton.iter(text)
        match = next(ends, None)
        for i in range(n):
            best, end, single = None, i + 1, False
            while match is not None and match[0] == i:  # longest first: ascending start
                length, worth = match[1]
                start = end - length
                total = score[start] + worth
                if best is None or total > best:
                    best, pieces = total, count[start] + 1
                single = single or length == 1
                match = next(ends, None)
            if not single:
                total = score[i] + self.unknown
                if best is None or total > best:
                    best = total
                    pieces = count[i] + (len(text[i].encode()) if self.bytes else not open_end[i])
                    open_end[end] = True
            score[end], count[end] = best, pieces
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        if not self.by_word:
            return self.best(MARK + text.replace(" ", MARK))
        return sum(self._word(x) for x in _WORDS.findall(" " + text.replace(MARK, " ")))  # a written mark is a space

    def _word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = self.best(word.replace(" ", MARK))
            if len(self.words) > MAX_WORDS:
                self.words.clear()
            self.words[word] = found
        return found

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_word:
            return [self.count(t) for t in texts]
        out, words = [], self.words
        for text in texts:
            if not text or text[0] == " " or text[-1] == " " or "  " in text or MARK in text:
                out.append(self.count(text))
                continue
            parts = text.split(" ")
            new = {p for p in parts if p not in words}
            if len(words) + len(new) > MAX_WORDS:
                words.clear()
                new = set(parts)
            for p in new:
                words[p] = self.best(MARK + p.replace(" ", MARK))
            out.append(sum(map(words.__getitem__, parts)))
        return out


def counter(path: str) -> Counter:
    """The worker's counter for a vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = Counter(vocabulary(path))
    return _OPEN[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = counter(path).counts([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """→ doc_id, n_tokens for every row of ``docs`` (doc_id, text); ``path`` names a sentencepiece vocabulary."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(path), "doc_id long, n_tokens long")
