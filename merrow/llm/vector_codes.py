"""Vector code compression: product codes whose codebooks are fitted over a trie of distinct parts.

Vectors become integers and are cut into equal parts. The distinct parts of a batch, sorted, are
the leaves of a trie whose levels are the components. Walking it depth first, a common prefix of
components has its distances to all entries of the codebook added up once; a leaf takes the
nearest entry, and counts for as many parts as are equal to it when entries are moved. A task
returns one row of counts and sums for each entry, so that what is gathered is as large as the
codebooks, however many vectors there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.llm.shared import small, written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Integers beyond this, either way, are taken as this, so that distances fit 64 bits.
MOST = 1 << 26
#: Leaves of the trie that are walked at once; each holds a distance for every entry.
LEAVES = 8_192


@dataclass
class Codebooks:
    """``entries[part, entry, position]``; no entries at all where no vector was kept."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector isn't null, has a component and only finite ones."""
    vector = F.col(f"`{vector_col}`")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vectors.where(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine))


def integers(flat: np.ndarray, n: int, dims: int, parts: int) -> np.ndarray:
    """Rows of integers (row, part, position); zeros fill up a last part that is too short."""
    width = -(-dims // parts)
    whole = np.zeros((n, parts * width), np.int64)
    whole[:, :dims] = np.clip(np.floor(flat.astype(np.float64) * SCALE), -MOST, MOST).reshape(n, dims)
    return whole.reshape(n, parts, width)


def nearest(own: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For parts ``own`` (row, position) of one place and its ``entries``: the distinct parts (the
    trie's leaves in depth-first order), which of them each row is, how often each occurs, and the
    leaf's nearest entry and squared distance; ties go to the lower entry."""
    order = np.lexsort(own.T[::-1])
    ranked = own[order]
    # the depth at which a part leaves the path of the part before it
    differs = ranked[1:] != ranked[:-1]
    fresh = np.concatenate([[True], differs.any(axis=1)])
    leaves = ranked[fresh]
    of = np.empty(len(own), np.int64)
    of[order] = np.cumsum(fresh) - 1
    forks = np.concatenate([[0], np.argmax(differs, axis=1)[fresh[1:]]])
    best, error = np.empty(len(leaves), np.int64), np.empty(len(leaves), np.int64)
    for start in range(0, len(leaves), LEAVES):
        block, fork = leaves[start : start + LEAVES], forks[start : start + LEAVES].copy()
        fork[0] = 0
        shared = np.zeros((1, len(entries)), np.int64)
        parent = np.zeros(len(block), np.int64)
        for depth in range(own.shape[1]):
            node = fork <= depth
            step = block[node, depth, None] - entries[None, :, depth]
            shared = shared[parent[node]] + step * step
            parent = np.cumsum(node) - 1
        best[start : start + LEAVES] = shared.argmin(axis=1)
        error[start : start + LEAVES] = shared.min(axis=1)
    return leaves, of, np.bincount(of, minlength=len(leaves)), best, error


def _vectors_of(batch: pa.RecordBatch, at: int, dims: int, parts: int) -> np.ndarray:
    flat = batch.column(at).flatten().to_numpy(zero_copy_only=False)
    return integers(flat, len(batch), dims, parts)


def _moved(vectors: DataFrame, books: np.ndarray, dims: int) -> np.ndarray:
    """The codebooks after one round over all vectors (one column)."""
    parts, k, width = books.shape
    names = [f"s{i}" for i in range(width)]
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "entry", "n", *names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for batch in batches:
            own = _vectors_of(batch, 0, dims, parts)
            for part in range(parts if len(own) else 0):
                leaves, _, times, best, _ = nearest(own[:, part], books[part])
                np.add.at(counts[part], best, times)
                np.add.at(sums[part], best, leaves * times[:, None])
        part, entry = np.nonzero(counts)
        columns = [part, entry, counts[part, entry], *sums[part, entry].T]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=schema.names)

    totals = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *names)]
    out = books.copy()
    # at most a row for each entry of each part
    for row in vectors.mapInArrow(run, schema).groupBy("part", "entry").agg(*totals).collect():
        out[row.part, row.entry] = [int(row[c]) // int(row.n) for c in names]
    return out


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, int]:
    """Codebooks and the number of dimensions: that of the vector of the smallest id. Each
    codebook starts as its part of the vectors of the ``entries`` smallest ids (ties by vector; a
    null id comes last; fewer vectors make fewer entries), and each round moves every entry to the
    floored mean of the parts nearest to it, over all vectors of that dimension."""
    vector = F.col(f"`{vector_col}`").cast("array<double>").alias("vector")
    kept = usable(vectors, vector_col).select(F.col(f"`{id_col}`").alias("id"), vector)
    order = [F.col("id").asc_nulls_last(), "vector"]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64)), 0
    dims = len(first[0].vector)
    same = kept.where(F.size("vector") == dims)
    start = np.array([r.vector for r in same.orderBy(*order).limit(entries).collect()])
    books = integers(start.ravel(), len(start), dims, parts).transpose(1, 0, 2).copy()
    own = same.select("vector")
    for _ in range(rounds):
        books = _moved(own, books, dims)
    return Codebooks(books), dims


def assign(vectors: DataFrame, books: Codebooks, dims: int, vector_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The kept rows of ``vectors`` with codes (an entry for each part) and error (the squared
    distances added up). Columns named in ``keep`` (default: all) pass through; one that has the
    name of a result is replaced."""
    outputs = [T.StructField("codes", T.ArrayType(T.IntegerType(), False), False), T.StructField("error", T.LongType(), False)]
    rows = usable(vectors, vector_col).where(F.size(f"`{vector_col}`") == dims)
    kept = [f for f in vectors.schema if f.name not in ("codes", "error") and (keep is None or f.name in keep)]
    schema, entries = T.StructType([*kept, *outputs]), books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fit = to_arrow_schema(schema)
        for batch in batches:
            own = _vectors_of(batch, batch.num_columns - 1, dims, len(entries))
            codes, error = np.zeros((len(own), len(entries)), np.int32), np.zeros(len(own), np.int64)
            for part in range(len(entries) if len(own) else 0):
                _, of, _, best, far = nearest(own[:, part], entries[part])
                codes[:, part] = best[of]
                error += far[of]
            offsets = pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(entries))
            made = [pa.ListArray.from_arrays(offsets, pa.array(codes.ravel())), pa.array(error)]
            arrays = [*batch.columns[:-1], *made]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, fit, strict=True)], schema=fit)

    vector = F.col(f"`{vector_col}`").cast("array<double>").alias("__vector")
    return rows.select(*[F.col(f"`{f.name}`") for f in kept], vector).mapInArrow(run, schema)


def hex_codes(codes: Column) -> Column:
    """Codes as two lower-case hex digits each."""
    return F.array_join(F.transform(codes, lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """A row for each kept vector: its id, label, codes, error, label_error (the errors of all rows
    of equal label added up, null labels together) and codebooks_sha256.

    Rows whose vector is null, empty, or holds a null or a component that isn't finite are dropped,
    as are those of another dimension than the vector of the smallest id. A dimension that the
    number of parts doesn't divide is filled up with zeros. Components are integers of at most
    2^26 either way; greater ones are taken as that. Rows of equal id or vector each count and each
    have a row; equal vectors have equal codes. A null id or label is kept. An empty table, or
    one without a usable vector, gives no rows. Other columns don't take part, whatever their
    names. A vector of any length is read whole; there are no texts."""
    named = vectors.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").alias("__label"), F.col(f"`{vector_col}`").alias("vector"))
    books, dims = fit(named, "__id", "vector", parts, entries, rounds)
    coded = written(assign(named, books, dims, "vector", ["__id", "__label"]), "codes")
    sums = written(coded.groupBy(F.col("__label").alias("__of")).agg(F.sum("error").alias("label_error")), "label-errors")
    rows = coded.join(small(sums), F.col("__label").eqNullSafe(F.col("__of")))
    digest = F.lit(books.digest()).alias("codebooks_sha256")
    return rows.select(F.col("__id").alias(id_col), F.col("__label").alias(label_col), "codes", "error", "label_error", digest)
