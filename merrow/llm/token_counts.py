"""Token counts by a linear longest-match automaton.

Greedy word-piece tokenisation takes the longest vocabulary entry that the rest of a word starts
with, again and again. The automaton is the vocabulary's trie; a node that can't go on has a
failure link to the node that stands for what remains after the pieces complete by then, and the
number of those pieces. So one walk over a word's bytes gives its number of pieces, and none is
built.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from merrow.llm.bpe import byte_letters
from merrow.llm.shared import arrow_map

#: Distinct words that a task remembers.
CACHE_WORDS = 600_000
#: Longer words are counted anew each time, so that what is remembered has bounded bytes.
CACHED_BYTES = 64
#: A word's first piece is an entry that starts with this byte.
START = b" "

OUTPUTS = T.StructType([T.StructField("n_words", T.LongType(), False), T.StructField("n_tokens", T.LongType(), False), T.StructField("most_in_word", T.LongType(), False)])


def vocabulary(path: str) -> list[bytes]:
    """The entries of a byte-level tokenizer file, as bytes."""
    with open(path, encoding="utf-8") as f:
        names = json.load(f)["model"]["vocab"]
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    return [bytes(byte_of[c] for c in name) for name in names if all(c in byte_of for c in name)]


class Automaton:
    """The trie with failure links and numbers of popped pieces. Node 0 is the root."""

    def __init__(self, entries: Iterable[bytes]):
        self.go: list[dict[int, int]] = [{}]
        complete = [False]
        for entry in entries:
            node = 0
            for byte in entry:
                if byte not in self.go[node]:
                    self.go[node][byte] = len(self.go)
                    self.go.append({})
                    complete.append(False)
                node = self.go[node][byte]
            complete[node] = node != 0
        self.fail, self.popped = [-1] * len(self.go), [0] * len(self.go)
        level = [0]
        while level:
            below = []
            for node in level:
                for byte, child in self.go[node].items():
                    below.append(child)
                    if complete[child]:
                        self.fail[child], self.popped[child] = 0, 1
                        continue
                    count, z = self.popped[node], self.fail[node]
                    while z >= 0 and byte not in self.go[z]:
                        count, z = count + self.popped[z], self.fail[z]
                    if z >= 0:
                        self.fail[child], self.popped[child] = self.go[z][byte], count
            level = below
        self.known: dict[bytes, int] = {}

    def pieces(self, word: bytes) -> int:
        """The number of greedy pieces of a marked word; 1 for a word that has no such pieces."""
        go, fail, popped, node, count = self.go, self.fail, self.popped, 0, 0
        for byte in word:
            while byte not in go[node]:
                if fail[node] < 0:
                    return 1
                count, node = count + popped[node], fail[node]
            node = go[node][byte]
        while node:
            if fail[node] < 0:
                return 1
            count, node = count + popped[node], fail[node]
        return count

    def count(self, text: bytes | None) -> tuple[int, int, int]:
        """Words between ASCII white space, their pieces, and the most pieces of one word."""
        words = text.split() if text else []
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        try:
            counts = [known[w] for w in words]
        except KeyError:
            known.update((w, self.pieces(START + w)) for w in set(words) if len(w) <= CACHED_BYTES and w not in known)
            counts = [known[w] if len(w) <= CACHED_BYTES else self.pieces(START + w) for w in words]
        return len(counts), sum(counts), max(counts, default=0)


_built: dict[str, Automaton] = {}


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_tokens and most_in_word (the most tokens in one word) of each whole
    text, for the vocabulary of a byte-level tokenizer file that every executor has.

    A null or empty text counts 0. A text of any length is counted whole, alone or in a part of about
    4 MB; equal rows get equal counts, each its own row, and no count depends on an order. A word for which the vocabulary has no pieces counts as one
    unknown token; with all single bytes in the vocabulary there is none. Other columns pass
    through (those in ``keep``); ones named like the results are replaced. Empty stays empty."""

    def make():
        if path not in _built:
            _built[path] = Automaton(vocabulary(path))
        automaton = _built[path]

        def work(texts):
            found = [automaton.count(t) for t in texts]
            return [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]

        return work

    return arrow_map(docs, text_col, OUTPUTS, make, keep)
