"""Sparse vectors, packed: one row has all of a vector's term numbers and values, as two lists.

Everything that a document or a context needs is in its own row, so tokens, counts, weights and
norms are worked out there, by Arrow batches in numpy, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.arrow import bounded_bytes, slices

NUMBERS = T.StructField("numbers", T.ArrayType(T.LongType(), False))
WEIGHTS = T.StructField("weights", T.ArrayType(T.DoubleType(), False))


def coded_terms(documents: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Of documents (tokens with one space between them; null: none) the distinct terms of each:
    document, term and times, in this order; the tokens; and the pairs of them that are terms, as
    the first one's number times that of tokens, plus the second's. Terms are tokens of two
    characters or more, and pairs of neighbours among these, numbered after the tokens."""
    split = pc.split_pattern(pc.fill_null(documents, ""), " ")
    flat, of = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.greater_equal(pc.utf8_length(flat), 2)
    coded, doc = flat.filter(real).dictionary_encode(), of.filter(real).to_numpy().astype(np.int64)
    token, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    inside = doc[1:] == doc[:-1]
    pairs = pa.array((token[:-1] * n + token[1:])[inside]).dictionary_encode()
    kinds = pairs.dictionary.to_numpy()
    term, many = np.concatenate([token, n + pairs.indices.to_numpy()]), max(1, n + len(kinds))
    found, times = np.unique(np.concatenate([doc, doc[1:][inside]]) * many + term, return_counts=True)
    return found // many, found % many, times, coded.dictionary, kinds


def names_of(tokens: pa.Array, kinds: np.ndarray) -> pa.Array:
    """The names of the terms of ``coded_terms``."""
    n = max(1, len(tokens))
    first, second = (tokens.take(pa.array(x)) for x in (kinds // n, kinds % n))
    return pa.concat_arrays([tokens, pc.binary_join_element_wise(first, second, " ")])


def terms_of(documents: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Document, term and times of ``coded_terms``, and the terms' names."""
    of, term, times, tokens, kinds = coded_terms(documents)
    return of, term, times, names_of(tokens, kinds)


def lists(of: np.ndarray, n: int, *columns: pa.Array | np.ndarray) -> list[pa.Array]:
    """A list for each of ``n`` rows from values that come in the order of their rows."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]


def opened(numbers: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and value of packed vectors."""
    of = pc.list_parent_indices(numbers).to_numpy(zero_copy_only=False).astype(np.int64)
    return of, *(pc.list_flatten(c).to_numpy(zero_copy_only=False) for c in (numbers, values))


def summed(of: np.ndarray, numbers: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by row and number, those of one number added up."""
    order = np.lexsort((numbers, of))
    of, numbers, values = of[order], numbers[order], values[order]
    if not len(of):
        return of, numbers, values
    fresh = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (numbers[1:] != numbers[:-1])]))
    return of[fresh], numbers[fresh], np.add.reduceat(values, fresh)


def unit(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Values of vectors at norm 1; 0 where the norm is."""
    norm = np.sqrt(np.bincount(of, values * values, n))[of]
    return np.divide(values, norm, out=np.zeros(len(values)), where=norm > 0)


def map_rows(df: DataFrame, outputs: list[T.StructField], by: str, work, keep: list[str]) -> DataFrame:
    """``df`` with columns that ``work`` makes of a batch (a dict of its columns), in parts of
    bounded size in the column ``by``; ``keep`` names the columns that stay. ``work`` returns an
    array for each output and, if rows are to go, the places of those that stay."""
    kept = [df.schema[c] for c in keep]
    schema, names = T.StructType([*kept, *outputs]), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fit = to_arrow_schema(schema)
        for batch in slices(batches, names.index(by)):
            columns = dict(zip(names, batch.columns, strict=True))
            made = [*[columns[c] for c in keep], *work(columns)]
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(made, fit, strict=True)], schema=fit)

    bounded_bytes(df.sparkSession)
    return df.mapInArrow(run, schema)


def packed_counts(documents: DataFrame, key: str = "slug") -> DataFrame:
    """(key, terms, counts) of documents (key, document): each row's distinct terms and how often
    each occurs. Null and empty documents have empty lists."""
    outputs = [T.StructField("terms", T.ArrayType(T.StringType(), False)), T.StructField("counts", T.ArrayType(T.LongType(), False))]

    def work(columns):
        of, term, times, names = terms_of(columns["document"])
        return lists(of, len(columns["document"]), names.take(pa.array(term)), times.astype(np.int64))

    return map_rows(documents.select(key, "document"), outputs, "document", work, [key])


def document_frequencies(documents: DataFrame) -> DataFrame:
    """(term, df) of documents (document): counted by batch in the tasks, then added up, which is
    the only shuffle. Sums are kept behind it only: before it, a task's table would hold about all
    terms of its input, few of which come again in another batch."""
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            _, term, _, names = terms_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.bincount(term, minlength=len(names)))], names=schema.names)

    return documents.select("document").mapInArrow(run, schema).repartition("term").groupBy("term").agg(F.sum("n").alias("df"))


def products(pairs: DataFrame, out: str = "product") -> DataFrame:
    """``pairs`` (numbers, weights, other_numbers, other_weights, further columns) with the product
    of the two vectors of each row, whose numbers are sorted and distinct: both are merged into
    one sorted list of (row, number), in which equal neighbours meet."""
    packed = ("numbers", "weights", "other_numbers", "other_weights")
    keep = [c for c in pairs.columns if c not in packed]

    def work(columns):
        n = len(columns["numbers"])
        mine, theirs = opened(columns["numbers"], columns["weights"]), opened(columns["other_numbers"], columns["other_weights"])
        of, numbers, values = (np.concatenate([a, b]) for a, b in zip(mine, theirs, strict=True))
        order = np.lexsort((numbers, of))
        of, numbers, values = of[order], numbers[order], values[order]
        meet = np.flatnonzero((of[1:] == of[:-1]) & (numbers[1:] == numbers[:-1]))
        return [pa.array(np.bincount(of[meet], values[meet] * values[meet + 1], n))]

    return map_rows(pairs, [T.StructField(out, T.DoubleType())], "numbers", work, keep)
