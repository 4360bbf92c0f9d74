"""Suffix-array dedup: bytes of strings of 100 bytes that start somewhere earlier are removed.

A suffix for each byte would be sorted many times its text. So suffixes start at anchors only: of
all 37-byte strings inside a window of 100 bytes, that of the smallest hash, the leftmost of
equals. Equal windows have their anchors at equal places, so windows need to be compared only
with those of an equal anchor, and neighbouring windows of one anchor form one segment.

1. Segments are grouped by anchor. Where all are equal, the first of them keeps its windows.
2. The rest, by anchor: what follows the anchors is sorted, and what precedes them, read
   backwards. This is a merge sort of suffixes whose comparisons find the common extension by
   binary search over prefix polynomial hashes; the extensions of neighbours in the order are
   then verified byte by byte. Two windows that hold the anchor at the same place are equal if
   they are in one run of neighbours both ways, and the earliest of each run keeps.
3. Windows that keep meet their texts again; all other windows are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.llm.shared import is_small, slices, small, written
from merrow.operators.order import numbered

LENGTH = 100
#: Windows that may share one anchor: as many as a long has bits.
SPREAD = 64
#: Windows of a text that are hashed at once.
PIECE = 1 << 20
#: Segments of an anchor that one task sorts at once at most. Windows of anchors with more are
#: grouped one by one instead.
MOST_SORTED = 2_000
#: Segments that a task gathers, of whole anchors, before it sorts them.
SORTED_AT_ONCE = 20_000

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        row = np.full(n, base, _U)
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


class Hashed:
    """Prefix polynomial hashes of a buffer; ``of(start, n)`` compares strings of equal length."""

    def __init__(self, data: np.ndarray):
        powers, self.inverse = _powers(1 << max(21, len(data).bit_length()))
        self.prefix = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * powers[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.prefix[start + n] - self.prefix[start]) * self.inverse[start]

    def all_of(self, n: int) -> np.ndarray:
        """Mixed hashes of every string of ``n`` bytes."""
        count = max(0, len(self.prefix) - n)
        h = (self.prefix[n:] - self.prefix[:count]) * self.inverse[:count]
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        return h ^ (h >> _U(32))


def anchors(data: np.ndarray, length: int = LENGTH, spread: int = SPREAD) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a buffer the start of its anchor; and the hashes of all anchors' starts."""
    h = Hashed(data).all_of(length - spread + 1)
    low, at, step = h, np.arange(len(h), dtype=np.int64), 1
    while step < spread:
        by = min(step, spread - step)
        less = low[by:] < low[:-by]
        at = np.where(less, at[by:], at[:-by])
        low = np.where(less, low[by:], low[:-by])
        step += by
    return at, h


def pack(start: np.ndarray, n: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The first window of a segment, how many there are, and how far the anchor is from it."""
    return (start << 12) | ((n - 1) << 6) | back


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 12, ((place >> 6) & 63) + 1, place & 63


def _buffers(texts: list[bytes | None], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Parts (text, offset, bytes) of about PIECE windows; parts of a text share ``length`` - 1 bytes."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for offset in range(0, max(0, len(text or b"") - length + 1), PIECE):
            part = text[offset : offset + PIECE + length - 1]
            if held and size + len(part) > PIECE + length:
                yield held
                held, size = [], 0
            held.append((i, offset, part))
            size += len(part)
    if held:
        yield held


def segments_of(texts: list[bytes | None], length: int = LENGTH, told: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The distinct segments of each text, first ones only: key, digest, text, place and bytes. If
    sorted keys are ``told``, only segments of these."""
    found = []
    for parts in _buffers(texts, length):
        joined = b"".join(p for _, _, p in parts)
        sizes = np.array([len(p) for _, _, p in parts])
        ends = np.cumsum(sizes)
        at, h = anchors(np.frombuffer(joined, np.uint8), length)
        part = np.repeat(np.arange(len(parts)), sizes)[: len(at)]
        inside = np.arange(len(at)) + length <= ends[part]
        # a segment goes on while the anchor is the same and the next window is in the text
        goes_on = (at[1:] == at[:-1]) & inside[1:] & (part[1:] == part[:-1])
        first = np.flatnonzero(inside & ~np.concatenate([[False], goes_on]))
        last = np.flatnonzero(inside & ~np.concatenate([goes_on, [False]]))
        key = h[at[first]].view(np.int64)
        if told is not None and len(told):
            chosen = told[np.minimum(np.searchsorted(told, key), len(told) - 1)] == key
            first, last, key = first[chosen], last[chosen], key[chosen]
        begins = ends - sizes
        offsets = np.array([o for _, o, _ in parts])
        of = part[first]
        place = pack(first - begins[of] + offsets[of], last - first + 1, at[first] - first)
        bodies = [joined[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)]
        digest = np.fromiter(map(xxhash.xxh3_64_intdigest, bodies), _U, len(bodies)).view(np.int64)
        found.append((key, digest, np.array([i for i, _, _ in parts])[of], place, bodies))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, []
    key, digest, text, place = (np.concatenate([f[c] for f in found]) for c in range(4))
    order = np.lexsort((place, digest, key, text))
    k, d, t = key[order], digest[order], text[order]
    fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (t[1:] != t[:-1])])
    keep = np.sort(order[fresh])
    every = [b for f in found for b in f[4]]
    return key[keep], digest[keep], text[keep], place[keep], [every[i] for i in keep.tolist()]


def compared(data: np.ndarray, hashed: Hashed, start: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes suffixes ``a`` and ``b`` have in common, by binary search over hashes, and
    the sign of their order; a suffix that another continues comes before it."""
    low, high = np.zeros(len(a), np.int64), np.minimum(size[a], size[b])
    while (low < high).any():
        middle = (low + high + 1) >> 1
        same = hashed.of(start[a], middle) == hashed.of(start[b], middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    next_of = [np.where(low < size[x], data[np.minimum(start[x] + low, len(data) - 1)].astype(np.int64), -1) for x in (a, b)]
    return low, np.sign(next_of[0] - next_of[1])


def suffix_sort(data: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes (start, size) within their groups, and how many bytes each shares with
    the one before it, -1 for the first of a group. Groups are runs of suffixes; ``first`` and
    ``count`` are those of each suffix's group.

    Runs of 1, 2, 4, ... suffixes are merged, all at once: a suffix's place in the merged run is
    its place in its own plus its rank in the other, found by binary search."""
    n, run = len(start), 1
    hashed, place = Hashed(data), np.arange(n)
    order = np.arange(n)
    while n and run < count.max():
        own = (place - first) // run
        begin, other = first + own * run, np.minimum(first + (own ^ 1) * run, first + count)
        low, high, later = other.copy(), np.minimum(other + run, first + count), own & 1
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            sign = compared(data, hashed, start, size, order[middle], order[open_])[1]
            before = (sign < 0) | ((sign == 0) & (later[open_] == 1))
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        merged = np.empty(n, np.int64)
        merged[np.minimum(begin, other) + (place - begin) + (low - other)] = order
        order, run = merged, run * 2
    return _verified(data, hashed, start, size, first, order)


def _verified(data: np.ndarray, hashed: Hashed, start: np.ndarray, size: np.ndarray, first: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order and common sizes, once bytes have shown that each suffix comes after the one
    before it. Where a hash was wrong, bytes alone sort."""
    n, shared = len(order), np.full(len(order), -1)
    pairs = np.flatnonzero(first[order][1:] == first[order][:-1]) if n else np.zeros(0, np.int64)
    shared[pairs + 1], sign = compared(data, hashed, start, size, order[pairs], order[pairs + 1])
    reach = np.arange(int(size.max(initial=0)))
    table = np.where(reach < size[:, None], data[np.minimum(start[:, None] + reach, len(data) - 1)].astype(np.int16), -1)
    differ = table[order[pairs]] != table[order[pairs + 1]]
    true = np.where(differ.any(axis=1), differ.argmax(axis=1), size[order[pairs]])
    if (true == shared[pairs + 1]).all() and (sign <= 0).all():
        return order, shared
    body = data.tobytes()
    order = np.array(sorted(range(n), key=lambda i: (first[i], body[start[i] : start[i] + size[i]])))
    differ = table[order[pairs]] != table[order[pairs + 1]]
    shared[pairs + 1] = np.where(differ.any(axis=1), differ.argmax(axis=1), size[order[pairs]])
    return order, shared


def first_windows(key: np.ndarray, place: np.ndarray, bodies: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For segments in the order of their keys, and of their texts and places within a key, the
    windows (bits of a long) that no earlier segment of the key has."""
    n, (_, windows, back) = len(key), unpack(place)
    edge = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    count = np.diff(np.concatenate([np.flatnonzero(edge), [n]]))[np.cumsum(edge) - 1] if n else first
    sides = []
    for parts in ([b[k:] for b, k in zip(bodies, back.tolist(), strict=True)], [b[:k][::-1] for b, k in zip(bodies, back.tolist(), strict=True)]):
        size = np.array([len(p) for p in parts], np.int64)
        data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
        sides.append(suffix_sort(data, np.cumsum(size) - size, size, first, count))
    kept = np.zeros(n, _U)
    for before in range(length):
        has = np.flatnonzero((before <= back) & (before > back - windows))
        if not len(has):
            continue
        runs = []
        for (order, shared), least in zip(sides, (length - before, before), strict=True):
            run = np.empty(n, np.int64)
            run[order] = np.cumsum(shared < least)
            runs.append(run[has])
        earliest = has[np.unique(runs[0] * (n + 1) + runs[1], return_index=True)[1]]
        kept[earliest] |= _U(1) << (back[earliest] - before).astype(_U)
    return kept.view(np.int64)


_SEGMENT = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "digest", "no", "place")])
_KEPT = T.StructType([T.StructField(c, T.LongType()) for c in ("no", "place", "kept")])


def _segments(texts: DataFrame, length: int, told=None, bodies: bool = False) -> DataFrame:
    """(key, digest, no, place[, body]) of the segments of texts (no, text)."""
    schema = T.StructType([*_SEGMENT, *([T.StructField("body", T.BinaryType())] if bodies else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            no = batch.column(0).to_numpy()
            key, digest, of, place, body = segments_of(batch.column(1).to_pylist(), length, None if told is None else told.value)
            columns = [pa.array(c) for c in (key, digest, no[of], place)] + ([pa.array(body, pa.binary())] if bodies else [])
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return texts.mapInArrow(run, schema)


def _sorted_groups(segments: DataFrame, length: int) -> DataFrame:
    """(no, place, kept) of segments sorted by key, number and place, all of a key in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> pa.RecordBatch:
            place = rows.column("place").to_numpy()
            kept = first_windows(rows.column("key").to_numpy(), place, rows.column("body").to_pylist(), length)
            some = kept != 0
            return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (rows.column("no").to_numpy(), place, kept)], names=_KEPT.names)

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < SORTED_AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield done(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    return segments.select("key", "no", "place", "body").mapInArrow(run, _KEPT)


def _single_windows(segments: DataFrame, length: int) -> DataFrame:
    """(no, place, kept) of segments of any number for a key: each window is a row, told by 128
    bits, and the earliest of equals keeps."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("one", "two", "no", "start")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, n, _ = unpack(batch.column(1).to_numpy())
            every = [xxhash.xxh3_128_digest(b[j : j + length]) for b, m in zip(batch.column(2).to_pylist(), n.tolist(), strict=True) for j in range(m)]
            told = np.frombuffer(b"".join(every), np.int64).reshape(-1, 2)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            columns = [told[:, 0], told[:, 1], np.repeat(batch.column(0).to_numpy(), n), np.repeat(start, n) + step]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

    windows = segments.select("no", "place", "body").mapInArrow(run, schema)
    # one text has a window of each kind once at most in a segment, but may have several segments
    firsts = windows.groupBy("one", "two", "no").agg(F.min("start").alias("start")).groupBy("one", "two").agg(F.min("no").alias("no"), F.min_by("start", "no").alias("start"))
    return firsts.select("no", F.shiftleft("start", 12).alias("place"), F.lit(-1).cast("long").alias("kept"))


def kept_windows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(no, place, kept): for texts (no, text) with distinct numbers, segments with the windows (as
    bits) that start nowhere earlier, in a text of a smaller number or before in the same one."""
    by_key = _segments(texts, length).groupBy("key").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.min("no").alias("no"), F.min_by("place", "no").alias("place"))
    alike = F.col("low") == F.col("high")
    firsts = written(by_key.select(F.when(~alike, F.col("key")).alias("key"), *[F.when(alike, F.col(c)).alias(c) for c in ("no", "place")]), "anchors")
    keys = firsts.where("key is not null").select("key")
    told = None
    if is_small(keys):
        told = texts.sparkSession.sparkContext.broadcast(np.sort(keys.toArrow().column(0).to_numpy()))
    unlike = _segments(texts, length, told, bodies=True)
    if told is None:
        unlike = unlike.join(keys, "key", "left_semi")
    elif not len(told.value):
        unlike = unlike.where("false")
    unlike = unlike.groupBy("key", "digest").agg(F.min(F.struct("no", "place", "body")).alias("s")).select("key", "s.*")
    unlike = written(unlike, "segments")
    many = written(unlike.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MOST_SORTED).select("key"), "hot-anchors")
    few = unlike.join(small(many), "key", "left_anti").repartition("key").sortWithinPartitions("key", "no", "place")
    rest = unlike.join(small(many), "key", "left_semi")
    whole = firsts.where("key is null").select("no", "place", F.lit(-1).cast("long").alias("kept"))
    return whole.unionByName(_sorted_groups(few, length)).unionByName(_single_windows(rest, length))


def cut(texts: list[bytes | None], of: np.ndarray, place: np.ndarray, kept: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, list[list[tuple[int, int]]], list[bytes]]:
    """Sizes, removed bytes, removed runs and what is left of texts, given kept windows by text."""
    body = b"".join(t or b"" for t in texts)
    size = np.array([len(t or b"") for t in texts], np.int64)
    ends = np.cumsum(size)
    begins, n = ends - size, len(body)
    start, windows, _ = unpack(place)
    start = start + begins[of]
    edge = np.zeros(n + SPREAD + 1, np.int32)
    whole = kept == -1
    np.add.at(edge, start[whole], 1)
    np.add.at(edge, (start + windows)[whole], -1)
    stays = np.cumsum(edge)[:n] > 0
    bit = np.flatnonzero(~whole)
    row, step = np.nonzero((kept[bit, None].view(_U) >> np.arange(SPREAD, dtype=_U)) & _U(1))
    stays[start[bit][row] + step] = True
    text = np.repeat(np.arange(len(texts)), size)
    goes = ~stays & (np.arange(n) + length <= ends[text])
    count = np.concatenate([[0], np.cumsum(goes)])
    removed = count[1:] > count[np.maximum(np.arange(n) + 1 - length, 0)]
    turn = removed & ~np.concatenate([[False], removed[:-1] & (text[1:] == text[:-1])]) if n else removed
    stop = removed & ~np.concatenate([removed[1:] & (text[1:] == text[:-1]), [False]]) if n else removed
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b, i in zip(np.flatnonzero(turn).tolist(), np.flatnonzero(stop).tolist(), text[turn].tolist(), strict=True):
        spans[i].append((a - int(begins[i]), b + 1 - int(begins[i])))
    total = np.concatenate([[0], np.cumsum(removed)])
    gone = total[ends] - total[begins]
    left = np.frombuffer(body, np.uint8)[~removed].tobytes()
    at = np.concatenate([[0], np.cumsum(size - gone)]).tolist()
    return size, gone, spans, [left[a:b] for a, b in zip(at, at[1:], strict=False)]


def _rejoined(rows: DataFrame, kept: DataFrame, columns: list[str], length: int) -> DataFrame:
    """Rows (columns, __no, __text) cut by the kept windows of their number: both are dealt out by
    number and sorted, windows before the text that they are of."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)]), False)
    outputs = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in rows.schema if f.name in columns), *outputs])
    both = rows.withColumns({"__place": F.lit(None).cast("long"), "__kept": F.lit(None).cast("long")})
    both = both.unionByName(kept.toDF("__no", "__place", "__kept"), allowMissingColumns=True)
    dealt = both.repartition("__no").sortWithinPartitions("__no", F.col("__place").isNull())
    dealt = dealt.select(*[F.col(f"`{f.name}`") for f in schema[: len(schema) - 4]], "__no", "__text", "__place", "__kept")
    n = len(schema) - 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fit = to_arrow_schema(schema)
        before = np.zeros((2, 0), np.int64)
        for batch in slices(batches, n + 1):
            is_text = batch.column(n + 2).is_null().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(is_text)
            windows = np.flatnonzero(~is_text)
            held = np.stack([batch.column(c).take(pa.array(windows)).to_numpy() for c in (n + 2, n + 3)])
            # windows belong to the next text; those after the last one wait for the next batch
            of = np.concatenate([np.zeros(before.shape[1], np.int64), np.searchsorted(at, windows)])
            held = np.concatenate([before, held], axis=1)
            now = of < len(at)
            before = held[:, ~now]
            if not len(at):
                continue
            texts = batch.take(pa.array(at))
            size, gone, spans, left = cut(texts.column(n + 1).to_pylist(), of[now], held[0, now], held[1, now], length)
            made = [pa.array(size), pa.array(gone), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], fit.field("spans").type), pa.array(left, pa.binary())]
            arrays = [*texts.columns[:n], *made]
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, fit, strict=True)], schema=fit)

    return dealt.mapInArrow(run, schema)


def _numbered_texts(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` (with __id and __text) with __no, a long in the order of ids and, for equal ids, of
    texts' digests; and whether no two rows have the same. Ids that are distinct whole numbers are used."""
    whole = isinstance(docs.schema["__id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    if whole and docs.groupBy("__id").agg(F.count("*").alias("n")).where("n > 1 or __id is null").isEmpty():
        return docs.withColumn("__no", F.col("__id").cast("long")), True
    named = docs.withColumn("__tie", F.sha2("__text", 256))
    numbers = numbered(named.select("__id", "__tie").distinct(), [F.col("__id").asc_nulls_first(), F.col("__tie")], "__no", "text-numbers")
    numbers = written(numbers.toDF("__of", "__as", "__no"), "text-numbers")
    joined = named.join(small(numbers), F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__tie") == F.col("__as")))
    return joined.drop("__tie", "__of", "__as"), False


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_bytes, n_removed, spans (maximal removed runs, in bytes of the text as UTF-8)
    and kept (the bytes that are left, which may end within a character).

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a row
    of a smaller id, or before in the same text. Strings are those of the input and never cross
    rows. A null text is an empty one; texts shorter than ``length`` stay. A text of any length is
    hashed in overlapping pieces. Rows of equal id and text are one document and each have the same
    result; rows of equal id and other texts come in the order of the texts' SHA-256, and a null
    id comes first. An empty table gives no rows. Other columns pass through (those named in
    ``keep``); one that has the name of a result is replaced. ``length`` is 64 at least."""
    names = ("n_bytes", "n_removed", "spans", "kept")
    columns = [c for c in (docs.columns if keep is None else keep) if c not in names]
    # own names while at work, whatever the names of other columns are
    held = [f"__c{i}" for i in range(len(columns))]
    out = [*(F.col(h).alias(c) for h, c in zip(held, columns, strict=True)), *names]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(*[F.col(f"`{c}`").alias(h) for h, c in zip(held, columns, strict=True)], F.col(f"`{id_col}`").alias("__id"), text.alias("__text"))
    rows, distinct = _numbered_texts(rows)
    if distinct:
        return _rejoined(rows, kept_windows(rows.select("__no", "__text"), length), held, length).select(*out)
    rows = written(rows, "numbered-texts")
    once = rows.select("__no", "__text").dropDuplicates(["__no"])
    found = _rejoined(once.withColumn("__of", F.col("__no")), kept_windows(once, length), ["__of"], length)
    return rows.join(found, F.col("__no") == F.col("__of")).select(*out)
