"""Word-piece token counts by a linear longest-match automaton.

The vocabulary becomes a trie with failure links. Following a failure link means that the longest match so far has been
cut into pieces; how many pieces is precomputed for the link ("popped tokens"), so a word's greedy longest-match-first
length is a sum of small numbers over one pass of its bytes, and no piece is ever built.

Pieces are byte strings, as in the public vocabulary file: a word's last piece carries an end-of-word mark. The mark is
one extra symbol here, so a word is its bytes and then END. A word that the vocabulary cannot cut counts as one
(unknown) token. Words are the runs without ASCII white space of the text with A-Z lower-cased.

Counts of words already seen are kept per worker in a bounded table. Defined cases: null and blank texts have no words
and 0 pieces; a word longer than MAX_WORD_BYTES is counted by the same automaton but not kept; a null doc_id keeps its
row; repeated rows are counted each; no rows give no rows; texts of any length are counted whole; other columns of
whatever names are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ASCII_LOWER, map_batches, utf8_bytes

END = 256
WORDS_KEPT = 400_000
MAX_WORD_BYTES = 64


class LongestMatch:
    """Trie states are numbered from 0, the root. For each: whether it ends a piece, its failure link, its pops."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            state = 0
            for symbol in piece:
                state = self.next[state].setdefault(symbol, len(self.next))
                if state == len(self.next):
                    self.next.append({})
                    final.append(False)
            final[state] = True
        self.fail, self.pops = [-1] * len(self.next), [0] * len(self.next)
        waiting = deque([0])
        while waiting:
            at = waiting.popleft()
            for symbol, to in self.next[at].items():
                if final[to]:  # the whole of it is one piece; matching starts again
                    self.fail[to], self.pops[to] = 0, 1
                else:
                    link, popped = self.fail[at], self.pops[at]
                    while link >= 0 and symbol not in self.next[link]:
                        popped += self.pops[link]
                        link = self.fail[link]
                    if link >= 0:
                        self.fail[to], self.pops[to] = self.next[link][symbol], popped
                waiting.append(to)

    def count(self, symbols: Iterable[int]) -> int | None:
        """Pieces of the greedy longest match; None if some rest cannot be matched."""
        state, popped = 0, 0
        for symbol in symbols:
            while (to := self.next[state].get(symbol)) is None:
                popped += self.pops[state]
                state = self.fail[state]
                if state < 0:
                    return None
            state = to
        while state:
            popped += self.pops[state]
            state = self.fail[state]
            if state < 0:
                return None
        return popped

    def word(self, word: bytes) -> int:
        found = self.count([*word, END])
        return 1 if found is None else found


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 stands for itself, the rest follows from 256."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary_pieces(path: str, end_mark: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary file with an end-of-word mark; entries with other characters are no pieces."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {x["content"] for x in model["added_tokens"]}
    letters, pieces = byte_alphabet(), []
    for entry in model["model"]["vocab"]:
        ended = entry.endswith(end_mark)
        stem = entry[: -len(end_mark)] if ended else entry
        if entry not in special and stem and all(c in letters for c in stem):
            pieces.append((*[letters[c] for c in stem], *[END] * ended))
    return pieces


@lru_cache(maxsize=2)
def automaton(path: str) -> tuple[LongestMatch, dict[bytes, int]]:
    return LongestMatch(vocabulary_pieces(path)), {}


def count_pieces(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_pieces, longest_word_pieces for every whole text."""

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine, kept = automaton(vocabulary_path)
        rows = []
        for text in utf8_bytes(batch.column(1)):
            words = text.translate(ASCII_LOWER).split()
            counts = [kept.get(w) or _count(machine, kept, w) for w in words]
            rows.append((len(words), sum(counts), max(counts, default=0)))
        words, pieces, longest = zip(*rows, strict=True)
        return pa.record_batch({"doc_id": batch.column(0), "n_words": pa.array(words, pa.int64()), "n_pieces": pa.array(pieces, pa.int64()), "longest_word_pieces": pa.array(longest, pa.int64())})

    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), counted, "doc_id long, n_words long, n_pieces long, longest_word_pieces long")


def _count(machine: LongestMatch, kept: dict[bytes, int], word: bytes) -> int:
    n = machine.word(word)
    if len(word) <= MAX_WORD_BYTES:
        if len(kept) >= WORDS_KEPT:
            kept.clear()
        kept[word] = n
    return n
