"""Document frequencies brought back to the documents, for vocabularies of any size.

Documents are counted in chunks of bounded size. A chunk sends its distinct names to buckets by
their hash, packed: a bucket is told a name once by each chunk, not by each document. The bucket
adds up the frequencies of its names, numbers them, and answers each chunk with frequencies and
numbers alone, in the order in which the chunk named them. So no entry of a document is joined by
its term, and nobody holds the vocabulary: a task has one chunk or one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.arrow import bounded_bytes, lean, slices
from merrow.operators.order import ROW_BITS
from merrow.operators.packed import coded_terms, names_of
from merrow.scratch import discard, written

#: Bytes of text of one chunk, and of that whose names one bucket gets; names or entries that leave a
#: task at once.
CHUNK_BYTES, BUCKET_BYTES, ROWS_AT_ONCE = 4_000_000, 16_000_000, 100_000
#: The bucket of a chunk's own row, behind those of its answers.
LAST = 2**31 - 1
_PARTS = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("names", T.BinaryType()), T.StructField("body", T.BinaryType())])
_COUNTS = T.StructType([T.StructField("term", T.StringType()), T.StructField("df", T.LongType()), T.StructField("number", T.LongType()), *_PARTS.fields[:2], T.StructField("answer", T.BinaryType())])


@dataclass
class Counted:
    """parts: the chunks' entries, packed; counts: (term, df, number) of each term, and the answers to the
    chunks, as rows without a term; both written tables. Numbers are distinct, from 1, with gaps."""

    parts: DataFrame
    counts: DataFrame
    n_documents: int
    buckets: int

    @property
    def frequencies(self) -> DataFrame:
        return self.counts.where("number is not null").select("term", "df", "number")


def packed_bytes(*arrays: np.ndarray | pa.Buffer) -> bytes:
    raw = b"".join(len(b).to_bytes(8, "little") + b for b in (a.tobytes() if isinstance(a, np.ndarray) else bytes(a) for a in arrays))
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpacked_bytes(body: bytes) -> list[bytes]:
    raw, out, at = pa.Codec("zstd").decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True), [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _strings(names: pa.Array, start: int, end: int) -> tuple[np.ndarray, pa.Buffer]:
    """Lengths and bytes of some names of an array that has no offset."""
    offsets = np.frombuffer(names.buffers()[1], np.int32)[start : end + 1]
    return np.diff(offsets), names.buffers()[2][int(offsets[0]) : int(offsets[-1])] if len(offsets) and offsets[-1] else pa.py_buffer(b"")


def _named(lengths: bytes, data: bytes) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int32))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data))


def _hashes(tokens: pa.Array) -> np.ndarray:
    return np.fromiter((int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in tokens.to_pylist()), np.uint64, len(tokens))


def _buckets_of(tokens: pa.Array, kinds: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each term, which follows from its own words alone."""
    own, n = _hashes(tokens), max(1, len(tokens))
    mixed = own[kinds // n] * np.uint64(0x9E3779B97F4A7C15) + (own[kinds % n] ^ (own[kinds % n] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    every = np.concatenate([own, mixed])
    return ((every ^ (every >> np.uint64(31))) % np.uint64(buckets)).astype(np.int64)


def _chunked(documents: DataFrame, key: str, buckets: int, named: bool) -> DataFrame:
    """The parts of documents (key, document). ``named`` keeps a chunk's names beside its entries too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << ROW_BITS
        for batch in slices(batches, 1, CHUNK_BYTES):
            of, term, times, tokens, kinds = coded_terms(batch.column(1))
            if not len(of):
                continue
            bucket = _buckets_of(tokens, kinds, buckets)
            order = np.argsort(bucket, kind="stable")
            names = names_of(tokens, kinds).take(pa.array(order))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            df = np.bincount(term, minlength=len(order))[order]
            code = of * len(order) + place[term]
            sort = np.argsort(code)
            entries = (np.diff(code[sort], prepend=0), times[sort].astype(np.int64))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("key", batch.column(0).type)])) as out:
                out.write_batch(pa.RecordBatch.from_arrays([batch.column(0)], names=["key"]))
            body = packed_bytes(np.array([len(order)]), sink.getvalue(), *entries, *(_strings(names, 0, len(names)) if named else ()))
            starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(starts))
            told = [packed_bytes(*_strings(names, starts[b], starts[b + 1]), df[starts[b] : starts[b + 1]].astype(np.int64)) for b in full.tolist()]
            rows = [pa.array([chunk] * (len(full) + 1)), pa.array([*full.tolist(), LAST], pa.int32()), pa.array([*told, None], pa.binary()), pa.array([*[None] * len(full), body], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names=_PARTS.names)
            chunk += 1

    bounded_bytes(documents.sparkSession)
    return documents.select(key, "document").mapInArrow(lean(run), _PARTS)


def _counted(parts: DataFrame, buckets: int) -> DataFrame:
    """Terms with their df and number, and the answers to the chunks, of the names that each bucket was told."""

    def done(bucket: int, chunks: list[int], names: list[pa.Array], dfs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = pa.concat_arrays(names).dictionary_encode()
        place, terms = every.indices.to_numpy(), every.dictionary
        total = np.bincount(place, np.concatenate(dfs), len(terms)).astype(np.int64)
        number = np.arange(len(terms)) * buckets + bucket + 1
        for start in range(0, len(terms), ROWS_AT_ONCE):
            rows = slice(start, start + ROWS_AT_ONCE)
            made = [terms.slice(start, ROWS_AT_ONCE), pa.array(total[rows]), pa.array(number[rows])]
            none = [pa.nulls(len(made[0]), kind) for kind in (pa.int64(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*made, *none], names=_COUNTS.names)
        ends = np.cumsum([len(d) for d in dfs])
        answers = [packed_bytes(total[own], own.astype(np.int64)) for own in np.split(place, ends[:-1])]
        none = [pa.nulls(len(chunks), kind) for kind in (pa.string(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(chunks), pa.array([bucket] * len(chunks), pa.int32()), pa.array(answers, pa.binary())], names=_COUNTS.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [])
        for batch in batches:
            for bucket, chunk, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != now and now is not None:
                    yield from done(now, *held)
                    held = ([], [], [])
                now = bucket
                lengths, data, df = unpacked_bytes(body.as_py())
                for column, value in zip(held, (chunk, _named(lengths, data), np.frombuffer(df, np.int64)), strict=True):
                    column.append(value)
        if now is not None:
            yield from done(now, *held)

    told = parts.where(F.col("bucket") < LAST).select("bucket", "chunk", "names")
    return told.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), _COUNTS)


def counted(documents: DataFrame, n_documents: int, n_bytes: int, key: str = "slug", named: bool = False, names: tuple[str, str] = ("chunks", "document-frequencies")) -> Counted:
    """The chunks of documents (key, document) of about so many bytes, and the frequencies of their
    terms. Documents are read once."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    buckets = max(1, -(-n_bytes // BUCKET_BYTES), min(2 * cores, -(-n_bytes // 1_000_000)))
    parts = written(_chunked(documents, key, buckets, named), names[0])
    counts = written(_counted(parts, buckets), names[1])
    # the names that buckets were told aren't read again
    own = written(parts.where(F.col("bucket") == LAST).select("chunk", "bucket", "body"), names[0])
    discard(parts)
    return Counted(own, counts, n_documents, buckets)


def rows_of(found: Counted, schema: T.StructType, make: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``make`` yields for each chunk, from its keys, and by entry: row, place of the term in the
    chunk, times; and by place: df, number, and the names if the chunks have kept them."""
    buckets = found.buckets

    def whole(body: bytes, answers: list[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        size, keys, code, times, *named = unpacked_bytes(body)
        n = int(np.frombuffer(size, np.int64)[0])
        df = np.concatenate([a[0] for a in answers])
        number = np.concatenate([a[1] * buckets + a[2] + 1 for a in answers])
        if len(df) != n:
            raise ValueError(f"a chunk of {n} terms has answers for {len(df)}")
        code = np.cumsum(np.frombuffer(code, np.int64))
        keys = pa.ipc.open_stream(keys).read_all().column(0).combine_chunks()
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
        yield from make(keys, code // n, code % n, np.frombuffer(times, np.int64), df, number, _named(*named) if named else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: list[tuple[np.ndarray, np.ndarray, int]] = []
        for batch in batches:
            for bucket, body in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket == LAST:
                    yield from whole(body.as_py(), answers)
                    answers = []
                else:
                    answers.append((*(np.frombuffer(x, np.int64) for x in unpacked_bytes(body.as_py())), bucket))

    answers = found.counts.where("chunk is not null").select("chunk", "bucket", F.col("answer").alias("body"))
    rows = answers.unionByName(found.parts)
    return rows.repartition(buckets, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(lean(run), schema)
