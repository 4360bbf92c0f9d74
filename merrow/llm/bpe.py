"""BPE encoding and decoding with a public tokenizer file.

Encoding works on the distinct words that a task meets. All new words of a piece of the
partition are laid end to end, and an index maps each pair of symbols that has a merge to all
places where it stands. Ranks present are applied in ascending order, each at all its places
from left to right, and the pairs that a merge creates join the index. Texts are then put
together from the words' ids.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from merrow.llm.shared import arrow_map, bounded_batches

#: Characters of text that are cut into words at once, and what a task remembers: stretches of text
#: between white space, and the words in them.
PIECE_CHARS = 1 << 19
CACHED_CHUNKS, CACHED_WORDS = 250_000, 60_000
#: Longer words are encoded anew each time, so that what is remembered has bounded bytes.
CACHED_LENGTH = 64
#: Up to here lower-casing and composition need no tables: no marks to compose, no final sigma.
_PLAIN = re.compile(r"[^\x00-\x1b\x20-˿]")
_SPACE = re.compile(r"\s")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


class WordBpe:
    """A word-level BPE read from a tokenizer file: lower-cased, white space dropped, word ends marked."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.rank = {a << 20 | b: r for r, (a, b, _) in enumerate(self.merges)}
        self.pairs, self.pair_rank = (np.array(x) for x in zip(*sorted(self.rank.items()), strict=True))
        made = {c: r for r, (_, _, c) in reversed(list(enumerate(self.merges)))}
        if any(made.get(x, -1) >= r for r, (a, b, _) in enumerate(self.merges) for x in (a, b)):
            raise ValueError("a merge uses a symbol that only a later merge makes; ranks can't be applied in order")
        letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.plain_words = regex.compile(pattern).findall
        library = Tokenizer.from_file(path)
        self.normal, self.pre_split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte_of = {c: b for b, c in enumerate(letters)}
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.tokens = [names.get(i, "") for i in range(max(names) + 1)]
        self.chunks: dict[str, bytes] = {}
        self.known: dict[bytes, bytes] = {}

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, all words at once by an index from pairs to places."""
        symbol, starts, merges, find = [-1], [], self.merges, self.rank.get
        inner, last = self.inner, self.last
        for raw in words:
            starts.append(len(symbol))
            symbol += [inner[x] for x in raw]
            symbol[-1] = last[raw[-1]]
            symbol.append(-1)
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        places = self._index(symbol)
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, c = merges[r]
            for i in sorted(places.pop(r)):
                j = after[i]
                if symbol[i] != a or symbol[j] != b:
                    continue
                symbol[i], symbol[j] = c, -2
                k, h = after[j], before[i]
                after[i], before[k] = k, i
                if (s := symbol[h]) >= 0 and (new := find(s << 20 | c)) is not None:
                    if new in places:
                        places[new].append(h)
                    else:
                        places[new] = [h]
                        heapq.heappush(active, new)
                if (s := symbol[k]) >= 0 and (new := find(c << 20 | s)) is not None:
                    if new in places:
                        places[new].append(i)
                    else:
                        places[new] = [i]
                        heapq.heappush(active, new)
        out = []
        for i in starts:
            ids = []
            while symbol[i] >= 0:
                ids.append(symbol[i])
                i = after[i]
            out.append(ids)
        return out

    def _index(self, symbol: list[int]) -> dict[int, list[int]]:
        """The places of every pair with a merge, by its rank."""
        row = np.array(symbol, np.int64)
        pair = np.where((row[:-1] >= 0) & (row[1:] >= 0), row[:-1] << 20 | row[1:], -1)
        near = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        at = np.flatnonzero(self.pairs[near] == pair)
        rank = self.pair_rank[near[at]]
        order = np.argsort(rank, kind="stable")
        ranks, first = np.unique(rank[order], return_index=True)
        return dict(zip(ranks.tolist(), (x.tolist() for x in np.split(at[order], first[1:])), strict=True)) if len(ranks) else {}

    def chunks_of(self, text: str) -> list[str]:
        """What stands between white space, normalised; a special token as a space and its text."""
        if self.split_special and "<" in text and len(parts := self.split_special.split(text)) > 1:
            return [c for i, p in enumerate(parts) for c in ([f" {p}"] if i % 2 else self.chunks_of(p) if p else [])]
        return self.normal(text).split(" ") if _PLAIN.search(text) else text.lower().split()

    def words_of(self, chunk: str) -> list[bytes]:
        """The words of a chunk; beyond plain letters the library's tables of characters decide."""
        if _PLAIN.search(chunk):
            return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.pre_split(chunk)]
        return [w.encode() for w in self.plain_words(chunk)]

    def learn(self, new: Iterable[str]) -> None:
        if len(self.chunks) > CACHED_CHUNKS:
            self.chunks.clear()
            self.chunks[""] = b""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        of = {c: self.words_of(c) for c in new if c[:1] != " "}
        words = list({w for ws in of.values() for w in ws if w not in self.known})
        self.known.update(zip(words, (array("i", ids).tobytes() for ids in self.encode_words(words)), strict=True))
        self.chunks.update((c, b"".join(map(self.known.__getitem__, ws))) for c, ws in of.items())
        self.chunks.update((c, np.int32(self.special[c[1:]]).tobytes()) for c in new if c[:1] == " ")
        for w in words:
            if len(w) > CACHED_LENGTH:
                del self.known[w]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit numbers."""
        held: list[tuple[int, list[str]]] = []
        out, size = [[] for _ in texts], 0
        for k, text in enumerate(texts):
            for piece in pieces(text or ""):
                held.append((k, self.chunks_of(piece)))
                size += len(piece)
                if size >= PIECE_CHARS:
                    self._flush(held, out)
                    size = 0
        self._flush(held, out)
        return [b"".join(x) for x in out]

    def _flush(self, held: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        new = set().union(*(c for _, c in held))
        if len(self.chunks) > CACHED_CHUNKS:
            self.learn(new)
        elif new := new - self.chunks.keys():
            self.learn(new)
        get = self.chunks.__getitem__
        for k, chunks in held:
            out[k].append(b"".join(map(get, chunks)))
        held.clear()
        for c in new:
            if len(c) > CACHED_LENGTH:
                self.chunks.pop(c, None)


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in pieces that end at white space, so that no word is cut."""
    i = 0
    while i < len(text):
        cut = _SPACE.search(text, i + size) if i + size < len(text) else None
        j = cut.end() if cut else len(text)
        yield text[i:j]
        i = j


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The tokenizer of a path, kept with its words for the life of the Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the token ids of each whole text (special tokens' strings count as such; none
    is added) and, if ``decoded_col`` is given, the text decoded from these ids as ``bpe_decode``
    does. ``path`` is a tokenizer file that every executor has, as installed with the library.

    A null or empty text, or one of white space only, has no ids. Texts of any length are encoded
    whole, in pieces that end at white space. Equal rows get equal ids, each its own row; of merges
    that could be made next the lowest rank goes first, at its places from left to right. Other columns pass through (those in ``keep``); one
    with the name of ``ids_col`` is replaced. An empty table gives an empty result."""

    fields = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)]
    if decoded_col:
        fields.append(T.StructField(decoded_col, T.StringType(), False))

    def make():
        bpe = tokenizer(path)
        tokens = pa.array(bpe.tokens)

        def work(texts):
            raw = bpe.encode([None if t is None else t.decode("utf-8", "replace") for t in texts])
            ends = np.cumsum([0, *(len(x) // 4 for x in raw)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), np.int32)))
            return [ids, join_tokens(ids, tokens)] if decoded_col else [ids]

        return work

    return arrow_map(docs, text_col, T.StructType(fields), make, keep)


def bpe_decode(docs: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``docs`` with the text of each row's ids, as a file without a decoder has it: the tokens, with
    a space between. Null and empty ids give an empty text; an id that the file lacks gives an
    empty token. A column with the name of ``decoded_col`` is replaced."""
    kept = docs.drop(decoded_col)
    schema = T.StructType([*kept.schema, T.StructField(decoded_col, T.StringType(), False)])
    at = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(tokenizer(path).tokens)
        for batch in batches:
            decoded = join_tokens(batch.column(at), tokens)
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, decoded_col])

    bounded_batches(kept.sparkSession)
    return kept.mapInArrow(run, schema)


def join_tokens(ids: pa.Array, tokens: pa.Array) -> pa.Array:
    ids = pc.fill_null(ids, pa.scalar([], ids.type)) if ids.null_count else ids
    flat = ids.flatten()
    known = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), flat, None)
    named = pc.fill_null(tokens.take(known), "")
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), named), " ")

