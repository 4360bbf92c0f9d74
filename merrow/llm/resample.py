"""Target-distribution importance resampling with hashed n-grams, as Arrow kernels.

Whole texts of a batch are lower-cased (``ascii_lower``), split at separators
(``split_pattern_regex``), flattened and dictionary-encoded. The indices, shifted against each
other, form the n-grams, each order encoded anew from pairs of (shorter n-gram, next word), so
that a feature's checksum is made once for each distinct one in the batch. Features are counted
by bucket in the raw and the target table; a bucket's gain is the logarithm of the ratio of its
smoothed shares. A second pass takes the gain of every feature and adds them up by document, and
noise that follows from the id turns weights into a draw without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.llm.shared import arrow_map, slices, written
from merrow.operators.order import numbered

ORDER = 1
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10

#: What separates words once A-Z are lower-cased.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (UTF-8 or bytes; null: none) in a row, and how many each text has."""
    # copied, as ascii_lower gives wrong bytes for a slice that was cast
    whole = texts.cast(pa.large_binary()).take(pa.array(np.arange(len(texts))))
    lowered = pc.ascii_lower(pc.fill_null(whole.view(pa.large_string()), ""))
    split = pc.split_pattern_regex(lowered, pattern=_SEPARATORS)
    flat, of = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.not_equal(pc.binary_length(flat), 0)
    return flat.filter(real), np.bincount(of.filter(real).to_numpy(), minlength=len(texts))


def features_of(texts: pa.Array, order: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text; and for each length of n-gram the bucket and the text of its occurrences."""
    flat, n_words = words_of(texts)
    encoded = flat.dictionary_encode()
    index = encoded.indices.to_numpy().astype(np.int64)
    known = encoded.dictionary.cast(pa.large_binary()).to_pylist()
    text = np.repeat(np.arange(len(texts)), n_words)
    sums = np.fromiter(map(zlib.crc32, known), np.int64, len(known))
    grams, made = index, [(sums[index] % buckets, text)]
    for size in range(2, order + 1):
        # a gram of this size is one of the size before and the word that follows it
        last = index[size - 1 :]
        inside = text[: len(last)] == text[size - 1 :]
        codes = pa.array((grams[: len(last)] * len(known) + last)[inside]).dictionary_encode()
        pairs = codes.dictionary.to_numpy()
        before, word = pairs // max(1, len(known)), pairs % max(1, len(known))
        sums = np.array([zlib.crc32(b" " + known[w], int(sums[g])) for g, w in zip(before, word, strict=True)], np.int64)
        grams = np.full(len(last), -1, np.int64)
        grams[inside] = codes.indices.to_numpy()
        made.append((sums[grams[inside]] % buckets, text[size - 1 :][inside]))
        # starts whose gram leaves the text never match again, since longer ones leave it too
        grams = np.where(inside, grams, 0)
    return n_words, made


def bucket_counts(texts: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the whole table are in each bucket. A task gives at most a row for each
    bucket; the driver gets one for each bucket."""
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in slices(batches, 0):
            for bucket, _ in features_of(batch.column(0), order, buckets)[1]:
                counts += np.bincount(bucket, minlength=buckets)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=schema.names)

    rows = texts.select(F.col(f"`{text_col}`").cast("binary").alias("text")).mapInArrow(run, schema)
    out = np.zeros(buckets, np.int64)
    for row in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ratio) of each bucket's smoothed share in the target to that in the raw table."""
    s_all, t_all, k = float(raw.sum()), float(target.sum()), len(raw)
    ratio = [(t + 1) * (s_all + k) / ((s + 1) * (t_all + k)) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, text_col: str = "text", order: int = ORDER, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_features and weight, the sum of the gains of its features."""
    outputs = T.StructType([T.StructField(n, T.LongType(), False) for n in ("n_words", "n_features", "weight")])
    told = docs.sparkSession.sparkContext.broadcast(gain)

    def make():
        gain = told.value

        def work(texts):
            n_words, found = features_of(pa.array(texts, pa.large_binary()), order, len(gain))
            n_features, weight = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for bucket, text in found:
                ends = np.cumsum(np.bincount(text, minlength=len(texts)))
                total = np.concatenate([[0], np.cumsum(gain[bucket])])
                n_features += np.diff(ends, prepend=0)
                weight += total[ends] - total[np.concatenate([[0], ends[:-1]])]
            return [pa.array(n_words.astype(np.int64)), pa.array(n_features), pa.array(weight)]

        return work

    return arrow_map(docs, text_col, outputs, make, keep)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_words, n_features, weight, score and rank: of the rows of at least
    ``least_words`` words, the ``percent`` of a hundred with the highest scores are drawn and have
    ranks 1, 2, 3 and so on, ties to the smaller id; all others have a null rank.

    A null or empty text has no words: weight 0, never drawn unless ``least_words`` is 0. A null id
    counts as an empty one in the noise and comes last in ties. Rows of equal id have equal noise,
    and each of them is ranked on its own. A text of any length is read whole, in a part of about
    4 MB of texts or alone. An empty target leaves all gains to the smoothing; an empty table gives
    no rows. Other columns pass through (those named in ``keep``); one that has the name of a
    result is replaced."""
    gain = gains(bucket_counts(docs, text_col, order, buckets), bucket_counts(target, text_col, order, buckets))
    names = ("n_words", "n_features", "weight", "score", "rank")
    columns = [c for c in (docs.columns if keep is None else keep) if c not in names]
    # own names while at work, whatever the names of other columns are
    held = [f"__c{i}" for i in range(len(columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(h) for h, c in zip(held, columns, strict=True)], F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    rows = weigh(rows, gain, "__text", order, [*held, "__id"])
    half = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((half + 0.5) / 4294967296.0))).cast("long")
    rows = written(rows.withColumn("score", F.col("weight") + noise), "scored")
    able = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    n = rows.where(able).count()
    # equal rows are dealt out by their place in the written table
    rows = rows.withColumns({"__able": able, "__tie": F.monotonically_increasing_id()})
    placed = numbered(rows, [F.desc("__able"), F.desc("score"), F.col("__id").asc_nulls_last(), F.col("__tie")], "__place", "ranked")
    rank = F.when(F.col("__able") & (F.col("__place") <= percent * n // 100), F.col("__place"))
    placed = placed.withColumn("rank", rank)
    return placed.select(*[F.col(h).alias(c) for h, c in zip(held, columns, strict=True)], *names)
