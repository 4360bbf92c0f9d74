"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Texts and items are reduced to words (ASCII letters lower-cased, everything in ASCII that is
neither letter nor digit is a separator). A window is 13 consecutive words of an item; an item
of fewer words is one window. The automaton reads whole words: each word of the items stands for
one to three code points, as many for every word, and all other words of a text for one more code,
so a single scan of a text finds everything, and an end position is a word number, from which the
place in the original text follows.

The patterns aren't the windows, which overlap, but blocks of 7 words that don't: every window has
a whole block in it. Where a block is found, the 6 words before and after it are compared with the
item's; together they are a hit from 13 words on. So the automaton has about a node for each word
of the items, and one automaton holds all of them.
"""

from __future__ import annotations

import re
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.llm.shared import arrow_map

WINDOW = 13
#: Code points for each place of a word's code; a node of the automaton has no more branches.
DIGITS = 256
#: Distinct words of one automaton, as many as there are codes for. Only items that have more need
#: a second one; texts are still normalised and passed once.
MOST_WORDS = DIGITS**3 - 1

_SEPARATORS = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_NORMAL = bytes(32 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_OTHER = "\x01"

OUTPUTS = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("n_hit", T.LongType(), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
        T.StructField("hit_words", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]), False), False),
    ]
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_NORMAL).split() if text else []


class Scanner:
    """The automaton of items: blocks with what stands around them, and whole short items."""

    def __init__(self, window: int):
        self.window, self.block = window, (window + 1) // 2
        self.reach = window - self.block
        self.numbers: dict[bytes, int] = {}
        self.around: dict[tuple[int, ...], dict[tuple[tuple[int, ...], tuple[int, ...]], set[str]]] = {}
        self.short: dict[tuple[int, ...], set[str]] = {}
        self.automaton = None

    def add(self, item: str | None, own: list[bytes]) -> None:
        """An item's words; one without an id is found, but not named."""
        numbers, names = self.numbers, () if item is None else (item,)
        whole = tuple(numbers.setdefault(word, len(numbers)) for word in own)
        if 0 < len(whole) < self.window:
            self.short.setdefault(whole, set()).update(names)
            return
        for at in range(0, len(whole) - self.block + 1, self.block):
            end = at + self.block
            sides = whole[max(0, at - self.reach) : at], whole[end : end + self.reach]
            self.around.setdefault(whole[at:end], {}).setdefault(sides, set()).update(names)

    def ready(self) -> Scanner:
        self.width = next(d for d in (1, 2, 3) if len(self.numbers) <= DIGITS**d)
        # a place in a code has code points of its own, so that codes are found at their starts only
        place = [[chr(DIGITS * (k + 1) + i) for i in range(DIGITS)] for k in range(self.width)]
        codes = ["".join(place[k][n // DIGITS**k % DIGITS] for k in range(self.width)) for n in range(len(self.numbers))]
        write = lambda part: "".join([codes[n] for n in part])
        if keys := {*self.around, *self.short}:
            self.automaton = ahocorasick.Automaton()
            for key in keys:
                around = [(write(left)[::-1], write(right), tuple(ids)) for (left, right), ids in self.around.get(key, {}).items()]
                self.automaton.add_word(write(key), (len(key), tuple(self.short[key]) if key in self.short else None, around))
            self.automaton.make_automaton()
        self.codes = dict(zip(self.numbers, codes, strict=True))
        self.around, self.short, self.numbers = {}, {}, {}
        return self

    def scan(self, own: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals [start, end) inside windows, and the items that they are from."""
        runs: list[tuple[int, int]] = []
        ids: set[str] = set()
        if self.automaton is None or not own:
            return runs, ids
        width, reach = self.width, self.reach * self.width
        text = "".join(map(self.codes.get, own, repeat(_OTHER * width)))
        for last, (size, short, around) in self.automaton.iter(text):
            end = (last + 1) // width
            start = end - size
            if short is not None:
                runs.append((start, end))
                ids.update(short)
            if around:
                at = start * width
                before, after = text[max(0, at - reach) : at][::-1], text[last + 1 : last + 1 + reach]
                for left, right, of in around:
                    a, b = _same(before, left) // width, _same(after, right) // width
                    if a + size + b >= self.window:
                        runs.append((start - a, end + b))
                        ids.update(of)
        return runs, ids


def _same(a: str, b: str) -> int:
    """Code points that two strings have in common at their starts."""
    if a == b:
        return len(a)
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def scanners_of(items: list[tuple[str | None, bytes | None]], window: int) -> list[Scanner]:
    """One scanner of all items, or more where they have too many distinct words."""
    out = [Scanner(window)]
    for item, text in items:
        own = words(text)
        if out[-1].numbers and len(out[-1].numbers) + len(own) > MOST_WORDS:
            out.append(Scanner(window))
        out[-1].add(item, own)
    return [s.ready() for s in out]


_held: list = []


def _scanners(told, window: int) -> list[Scanner]:
    """The scanners of a broadcast, built once in a worker."""
    items = told.value
    if not _held or _held[0] is not items or _held[1] != window:
        _held[:] = [items, window, scanners_of(items, window)]
    return _held[2]


def scan_all(scanners: list[Scanner], own: list[bytes]) -> tuple[list[int], set[str]]:
    """Merged word intervals, flat, and the items, as all scanners find them."""
    found = [s.scan(own) for s in scanners]
    out: list[int] = []
    for start, end in sorted(r for runs, _ in found for r in runs):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += (start, end)
    return out, set().union(*(ids for _, ids in found))


def original_spans(text: bytes, runs: list[int]) -> list[dict[str, int]]:
    """Code point spans of word intervals in the text as it came."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text.decode("utf-8", "replace"))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(runs[::2], runs[1::2], strict=True)]


def find_benchmark_passages(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_hit, items, hit_words (word intervals), spans (code points of the
    original) and contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    The items are told to all workers, each of which builds the automaton once; a text is
    normalised and scanned once. An automaton takes some 50 times the bytes of the items.

    A null or empty text has no words and is not contaminated. A null or empty item has no
    windows; an item without an id still marks words, but isn't listed. Equal items all count, and
    windows that touch or overlap are one span. A text of any length is read whole, in a task's part
    of about 4 MB of texts or alone. Equal rows get equal results, each its own row.
    No documents or no items: an empty or all-clean result. Other columns pass through (those
    named in ``keep``); one that has the name of a result is replaced."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast([(r.item, None if r.text is None else bytes(r.text)) for r in items.toLocalIterator()])

    def make():
        scanners = _scanners(held, window)

        def work(texts):
            own = list(map(words, texts))
            return _arrays(texts, list(map(len, own)), [scan_all(scanners, o) for o in own])

        return work

    out = arrow_map(docs, text_col, OUTPUTS, make, keep)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _arrays(texts: list[bytes | None], n_words: list[int], found: list[tuple[list[int], set[str]]]) -> list[pa.Array]:
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return [
        pa.array(n_words, pa.int64()),
        pa.array([sum(r[1::2]) - sum(r[::2]) for r, _ in found], pa.int64()),
        pa.array([sorted(ids) for _, ids in found], pa.list_(pa.string())),
        pa.array([r for r, _ in found], pa.list_(pa.int32())),
        pa.array([original_spans(t, r) if r else [] for t, (r, _) in zip(texts, found, strict=True)], pa.list_(span)),
    ]
