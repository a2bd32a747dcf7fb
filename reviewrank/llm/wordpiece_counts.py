"""Token counts by greedy longest match in linear time.

The vocabulary is a trie.  Where a word cannot continue from a node, the greedy match would emit certain tokens and go on
from another node: both depend on the node alone and are computed once, as a failure link and the *number* of popped
tokens.  A word is then counted byte by byte without ever going back or building a piece.
"""

from __future__ import annotations

import json
from collections import deque

import public_tokenizers
from pyspark.sql import DataFrame

from reviewrank.llm.common import map_rows, own_columns
from reviewrank.llm.forced_bpe import byte_alphabet

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_START = 0x20  # the byte that opens every word; tokens that begin with it start a word, all others continue one
CACHED_WORDS, CACHED_LENGTH = 400_000, 48


def vocabulary_bytes(path: str = VOCABULARY) -> list[bytes]:
    """The tokens of a byte-level vocabulary file, as bytes, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = {c: b for b, c in enumerate(byte_alphabet())}
    special = {t["content"] for t in spec["added_tokens"]}
    return [bytes(byte[c] for c in t) for t in spec["model"]["vocab"] if t not in special]


class LongestMatchCounter:
    """Counts the pieces of greedy longest match; a word that cannot be covered counts as one piece."""

    def __init__(self, tokens: list[bytes]):
        self._go: dict[int, int] = {}  # node * 256 + byte -> node
        parents, labels, ends = [0], [0], [False]
        for token in tokens:
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self._go:
                    self._go[key] = len(parents)
                    parents.append(node)
                    labels.append(b)
                    ends.append(False)
                node = self._go[key]
            ends[node] |= node != 0
        self._fail = [-1] * len(parents)
        self._popped = [0] * len(parents)
        below: dict[int, list[int]] = {}
        for node in range(1, len(parents)):
            below.setdefault(parents[node], []).append(node)
        todo = deque(below.get(0, ()))
        while todo:  # parents before children
            node = todo.popleft()
            todo.extend(below.get(node, ()))
            if ends[node]:
                self._fail[node], self._popped[node] = 0, 1
                continue
            at, popped = self._fail[parents[node]], self._popped[parents[node]]
            while at >= 0 and (at << 8 | labels[node]) not in self._go:
                popped += self._popped[at]
                at = self._fail[at]
            if at >= 0:
                self._fail[node], self._popped[node] = self._go[at << 8 | labels[node]], popped
        self._known: dict[str, int] = {}

    def pieces(self, data: bytes) -> int:
        """Number of pieces of ``data``; none for no bytes."""
        go, fail, popped = self._go, self._fail, self._popped
        node = count = 0
        for b in data:
            while (node << 8 | b) not in go:
                if fail[node] < 0:
                    return 1
                count += popped[node]
                node = fail[node]
            node = go[node << 8 | b]
        while node:
            if fail[node] < 0:
                return 1
            count += popped[node]
            node = fail[node]
        return count

    def word(self, word: str) -> int:
        n = self._known.get(word)
        if n is None:
            n = self.pieces(bytes([WORD_START]) + word.encode("utf-8", "surrogatepass"))
            if len(word) <= CACHED_LENGTH:
                if len(self._known) >= CACHED_WORDS:
                    self._known.clear()
                self._known[word] = n
        return n

    def text(self, text: str | None) -> tuple[int, int]:
        """``(words, pieces)``; words are runs without white space."""
        words = (text or "").split()
        known = self._known
        return len(words), sum([known[w] if w in known else self.word(w) for w in words])


_COUNTERS: dict[str, LongestMatchCounter] = {}


def counter(path: str = VOCABULARY) -> LongestMatchCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = LongestMatchCounter(vocabulary_bytes(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_words, n_pieces)`` for every row's whole text (null or empty: no words); repeated rows each give a row."""

    def rows_of():
        count = counter(path)
        return lambda b: [(i, *count.text(t)) for i, t in zip(b["doc_id"], b["text"], strict=True)]

    return map_rows(own_columns(docs, "doc_id", "text"), "doc_id long, n_words long, n_pieces long", rows_of)
