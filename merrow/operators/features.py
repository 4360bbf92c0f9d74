"""Content features: term counts, document frequencies and normalised TF-IDF weights, packed by row.

A fit counts its documents in chunks (``chunks``), which get the frequencies of their terms back as
answers: texts are read once, and no entry of a document is joined by its term.

Other documents meet a frozen vocabulary, whose terms are numbered by falling frequency, over ranges
of that order. The most frequent ones, up to a fixed number, are told to all tasks, which look them
up row by row; rarer ones, of which there may be any number, meet their documents in a join on the
term. As only rare terms are joined, none of its keys is hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.arrow import spread
from merrow.config import FEATURES, FeatureConfig
from merrow.functions.text import content_document, preference_document, terms
from merrow.operators.chunks import ROWS_AT_ONCE, Counted, counted, rows_of
from merrow.operators.order import numbered
from merrow.operators.packed import NUMBERS, WEIGHTS, document_frequencies, lists, map_rows, opened, packed_counts, summed, terms_of, unit
from merrow.scratch import discard, kept, written

#: The most frequent terms, which every task is told (some 20 MB).
MOST_TERMS_TOLD = 500_000


@dataclass
class Features:
    """idf: (term, df, idf, number), numbers distinct; vectors: (slug, numbers, weights) of norm 1,
    numbers sorted."""

    idf: DataFrame
    vectors: DataFrame
    #: Written tables that both are plans over: that of the vectors alone first.
    made_of: tuple[DataFrame, ...] = ()

    @property
    def weights(self) -> DataFrame:
        """(slug, term, weight), a row for each entry of a vector."""
        return long_form(self.vectors, self.idf)


def term_counts(documents: DataFrame, key: str = "slug") -> DataFrame:
    """(key, term, tf) of documents (key, document)."""
    pairs = F.explode(F.arrays_zip("terms", "counts")).alias("t")
    return packed_counts(documents, key).select(key, pairs).select(key, "t.terms", "t.counts").toDF(key, "term", "tf")


def inverse_frequencies(df: DataFrame, n_documents: DataFrame) -> DataFrame:
    """(term, df, idf) with smooth idf, of (term, df); ``n_documents`` has one row with n."""
    return df.crossJoin(F.broadcast(n_documents)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def vocabulary(documents: DataFrame) -> DataFrame:
    """(term, df, idf, number) of documents (document), a written table."""
    idf = inverse_frequencies(document_frequencies(documents), documents.agg(F.count("*").alias("n")))
    return numbered(idf, [F.desc("df"), F.col("term")], "number", "idf")


def vectors_of(documents: DataFrame, idf: DataFrame, key: str = "slug") -> DataFrame:
    """(key, numbers, weights): sublinear counts times idf, at norm 1, of documents (key, document)
    in a vocabulary; unknown terms drop out, and so do documents without a known one."""
    told = idf.where(F.col("number") <= MOST_TERMS_TOLD).select("term", "number", "idf").toArrow()
    spark, whole = documents.sparkSession, idf.where(F.col("number") > MOST_TERMS_TOLD).isEmpty()
    held = spark.sparkContext.broadcast((told.column("term").to_pylist(), told.column("number").to_numpy(), told.column("idf").to_numpy()))
    rest = [T.StructField("rest", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))]

    def work(columns):
        known, number, weight = _dictionary(held)
        n = len(columns["document"])
        of, term, times, names = terms_of(columns["document"])
        place = np.fromiter((known.get(x, -1) for x in names.to_pylist()), np.int64, len(names))[term]
        own = place >= 0
        rows, numbers, values = summed(of[own], number[place[own]], (1 + np.log(times[own])) * weight[place[own]])
        if whole:
            return lists(rows, n, numbers, unit(rows, values, n))
        left = pa.StructArray.from_arrays([names.take(pa.array(term[~own])), pa.array(times[~own])], names=["term", "tf"])
        return [*lists(rows, n, numbers, values), *lists(of[~own], n, left)]

    rows = map_rows(documents.select(key, "document"), [NUMBERS, WEIGHTS, *([] if whole else rest)], "document", work, [key])
    if not whole:
        rows = written(rows, "half-packed")
        rare = idf.where(F.col("number") > MOST_TERMS_TOLD).select("term", "number", "idf")
        more = rows.select(key, F.explode("rest").alias("r")).select(key, "r.*").join(rare, "term")
        entry = F.struct("number", ((1 + F.log("tf")) * F.col("idf")).alias("raw"))
        more = more.groupBy(key).agg(F.collect_list(entry).alias("more"))
        more = more.select(F.col(key).alias("__key"), F.transform("more", lambda e: e["number"]).alias("n"), F.transform("more", lambda e: e["raw"]).alias("w"))
        both = rows.join(more, F.col(key) == F.col("__key"), "left")
        added = lambda own, new: F.concat(own, F.coalesce(new, F.array().cast(rows.schema[own].dataType))).alias(own)
        rows = at_norm_1(both.select(key, added("numbers", "n"), added("weights", "w")), [key])
    return rows.where(F.size("numbers") > 0)


def _idf(df: np.ndarray, n_documents: int) -> np.ndarray:
    return np.log((1 + n_documents) / (1 + df)) + 1


def _vectors(found: Counted, key: T.StructField) -> DataFrame:
    """(key, numbers, weights) at norm 1, numbers sorted, of counted documents that have a term."""
    n_documents = found.n_documents

    def make(keys, of, place, times, df, number, _) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((number[place], of))
        of, place, n = of[order], place[order], len(keys)
        numbers, weights = number[place], unit(of, (1 + np.log(times[order])) * _idf(df, n_documents)[place], n)
        full = pa.array(np.flatnonzero(np.bincount(of, minlength=n)))
        yield pa.RecordBatch.from_arrays([a.take(full) for a in (keys, *lists(of, n, numbers, weights))], names=[key.name, "numbers", "weights"])

    return rows_of(found, T.StructType([key, NUMBERS, WEIGHTS]), make)


def _entries(found: Counted, key: T.StructField) -> DataFrame:
    """(key, term, weight): a row for each entry of the vectors at norm 1 of counted documents."""
    n_documents = found.n_documents

    def make(keys, of, place, times, df, _, names) -> Iterator[pa.RecordBatch]:
        weights = unit(of, (1 + np.log(times)) * _idf(df, n_documents)[place], len(keys))
        for start in range(0, len(of), ROWS_AT_ONCE):
            rows = slice(start, start + ROWS_AT_ONCE)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(of[rows])), names.take(pa.array(place[rows])), pa.array(weights[rows])], names=[key.name, "term", "weight"])

    return rows_of(found, T.StructType([key, T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]), make)


def term_weights(documents: DataFrame, key: str = "slug") -> DataFrame:
    """(key, term, weight), a row for each entry of the vectors at norm 1 that documents (key,
    document), a written table, have in their own vocabulary.

    Terms keep their names, so that no entry is joined by number at the end. A vocabulary that is
    small enough is told to all tasks; beyond that chunks of documents get the frequencies of their
    own terms."""
    spark = documents.sparkSession
    sizes = documents.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("document")), F.lit(0))).first()
    found = counted(documents, *sizes, key, True, ("half-weighted", "document-frequencies"))
    if found.frequencies.count() > MOST_TERMS_TOLD:
        return _entries(found, documents.schema[key])
    discard(found.parts)
    told = inverse_frequencies(found.frequencies, spark.range(1).select(F.lit(found.n_documents).alias("n"))).select("term", "idf").toArrow()
    held = spark.sparkContext.broadcast((told.column("term").to_pylist(), told.column("idf").to_numpy()))
    outputs = [T.StructField("terms", T.ArrayType(T.StringType(), False)), T.StructField("raws", T.ArrayType(T.DoubleType(), False))]

    def work(columns):
        known, weight = _dictionary(held)
        n_rows = len(columns["document"])
        of, term, times, names = terms_of(columns["document"])
        place = np.fromiter((known[x] for x in names.to_pylist()), np.int64, len(names))[term]
        return lists(of, n_rows, names.take(pa.array(term)), unit(of, (1 + np.log(times)) * weight[place], n_rows))

    rows = map_rows(documents.select(key, "document"), outputs, "document", work, [key])
    rows = rows.select(key, F.explode(F.arrays_zip("terms", "raws")).alias("e"))
    return rows.select(key, F.col("e.terms").alias("term"), F.col("e.raws").alias("weight"))


_held: list[tuple] = []


def _dictionary(told) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """The vocabulary of a broadcast, made ready once in a worker."""
    value = told.value
    if not _held or _held[0] is not value:
        _held[:] = [value, ({name: i for i, name in enumerate(value[0])}, *value[1:])]
    return _held[1]


def at_norm_1(vectors: DataFrame, keep: list[str]) -> DataFrame:
    """Vectors (keep, numbers, weights) with entries of one number added up, sorted, at norm 1."""

    def work(columns):
        n = len(columns["numbers"])
        of, numbers, values = summed(*opened(columns["numbers"], columns["weights"]))
        return lists(of, n, numbers, unit(of, values, n))

    return map_rows(vectors.withColumnsRenamed({"numbers": "__n", "weights": "__w"}).select(*keep, F.col("__n").alias("numbers"), F.col("__w").alias("weights")), [NUMBERS, WEIGHTS], "numbers", work, keep)


def long_form(vectors: DataFrame, idf: DataFrame, key: str = "slug") -> DataFrame:
    """(key, term, weight) of packed vectors."""
    entries = vectors.select(key, F.explode(F.arrays_zip("numbers", "weights")).alias("e")).select(key, "e.numbers", "e.weights").toDF(key, "number", "weight")
    names = idf.select("number", "term")
    few = idf.limit(MOST_TERMS_TOLD + 1).count() <= MOST_TERMS_TOLD
    return entries.join(F.broadcast(names) if few else names, "number").select(key, "term", "weight")


def fit(items: DataFrame, config: FeatureConfig = FEATURES) -> Features:
    """Features of nested items, whose texts are read once; ``vectors`` is a plan over packed chunks."""
    sizes = items.agg(F.count("*"), F.coalesce(F.sum(F.coalesce(F.octet_length("description"), F.lit(0)) + 100), F.lit(0))).first()
    found = counted(spread(items).select("slug", content_document(config).alias("document")), *sizes)
    n = items.sparkSession.range(1).select(F.lit(found.n_documents).alias("n"))
    idf = found.frequencies.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), "number")
    return Features(idf, _vectors(found, items.schema["slug"]), (found.parts, found.counts))


def settled(features: Features) -> Features:
    """Features as written tables; what they were made of is removed as soon as nothing reads it."""
    vectors = kept(features.vectors, "vectors")
    discard(*features.made_of[:1])
    idf = kept(features.idf, "idf")
    discard(*features.made_of[1:])
    return Features(idf, vectors)


def preference_vectors(contexts: DataFrame, idf: DataFrame, key: str = "context_id") -> DataFrame:
    """(key, numbers, weights), not at norm 1, of each context's preferred genres and tags in a
    fitted vocabulary: a context has a few terms, which are looked up by a join."""
    document = preference_document(F.col("genres"), F.col("tags"))
    asked = contexts.select(key, F.explode(terms(document)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    raw = asked.join(idf.select("term", "number", "idf"), "term").select(key, F.struct("number", ((1 + F.log("tf")) * F.col("idf")).alias("raw")).alias("e"))
    packed = raw.groupBy(key).agg(F.array_sort(F.collect_list("e")).alias("e"))
    return packed.select(key, F.transform("e", lambda e: e["number"]).alias("numbers"), F.transform("e", lambda e: e["raw"]).alias("weights"))


def fit_problems(items: DataFrame, features: Features) -> DataFrame:
    """(rule, key) of what makes a fit unusable: empty documents, rows without weights, values that
    aren't finite, an empty vocabulary."""
    # whole descriptions are gone through only where all else of an item has no term
    told = content_document(description="__none")
    bare = items.withColumn("__none", F.lit(None).cast("string")).where(~told.rlike("[^ ]{2}")).select(*items.columns)
    documents = written(bare, "bare").select("slug", content_document().alias("document"))
    empty = documents.where(F.size(terms(F.col("document"))) == 0).select(F.lit("document_empty").alias("rule"), F.col("slug").alias("key"))
    zero = items.select("slug").join(features.vectors.select("slug"), "slug", "left_anti").select(F.lit("row_without_weights").alias("rule"), F.col("slug").alias("key"))
    odd = F.exists("weights", lambda w: F.isnan(w) | (F.abs(w) == float("inf")))
    wild = features.vectors.where(odd).select(F.lit("weight_not_finite").alias("rule"), F.col("slug").alias("key"))
    none = features.idf.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("vocabulary_empty").alias("rule"), F.lit(None).cast("string").alias("key"))
    return empty.unionByName(zero).unionByName(wild).unionByName(none)
