"""A reproducible shuffle into shards: a Feistel permutation with cycle walking over row numbers.

Rows get the numbers 0 to n-1 in an order that follows from their ids alone. A keyed Feistel
network permutes a grid of ``a * b >= n`` cells; a number that lands beyond n-1 walks on until it
lands inside. The permuted number gives the shard (its remainder) and the slot in the shard (its
quotient), so both can be computed for any row number without looking at other rows, shards
differ by one row at most and slots have no gaps.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MASK = (1 << 31) - 1
ROUNDS = 6
#: Groups in which rows are counted and numbered; the groups' counts are all that is broadcast.
BUCKETS = 4096


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """A number under 2^31 for each round."""
    return [int.from_bytes(hashlib.sha256(f"{seed}:{r}".encode()).digest()[:4], "big") & _MASK for r in range(rounds)]


def grid(n: int) -> tuple[int, int]:
    """The sides of a near-square grid of at least n cells; fewer than its first side are spare."""
    a = math.isqrt(n - 1) + 1 if n > 0 else 1
    return a, max(1, -(-n // a))


def _step(df: DataFrame, cell: str, n: int, seed: int) -> DataFrame:
    """``cell`` sent once through the network, where it isn't already an inside cell reached."""
    a, b = grid(n)
    df = df.withColumns({"__l": F.expr(f"{cell} div {b}"), "__r": F.col(cell) % F.lit(b)})
    for r, key in enumerate(round_keys(seed)):
        to, by, side = ("__l", "__r", a) if r % 2 == 0 else ("__r", "__l", b)
        mixed = F.xxhash64(F.col(by), F.lit(key).cast("long")).bitwiseAND(F.lit(_MASK))
        df = df.withColumn(to, (F.col(to) + mixed) % F.lit(side))
    return df.withColumn("__y", F.col("__l") * F.lit(b) + F.col("__r")).drop("__l", "__r")


def _walk(df: DataFrame, n: int, seed: int) -> DataFrame:
    """One more step for the rows whose ``__y`` is a spare cell."""
    df = _step(df.withColumnRenamed("__y", "__x"), "__x", n, seed)
    return df.withColumn("__y", F.when(F.col("__x") < n, F.col("__x")).otherwise(F.col("__y"))).drop("__x")


def longest_walk(spark: SparkSession, n: int, seed: int) -> int:
    """Steps after which every walk that enters the spare cells has left them. The spare cells,
    fewer than sqrt(n), are all walked; those that never leave are circles that nothing enters,
    and walks of every length up to the longest occur, so no change means that only these are left."""
    a, b = grid(n)
    cells, walked, inside = spark.range(n, a * b).withColumnRenamed("id", "__y"), 0, a * b - n
    while inside:
        cells = _walk(cells, n, seed)
        # counted, not filtered: a filter would be pushed down with all the steps written out in it
        now = cells.agg(F.count_if(F.col("__y") >= n)).first()[0]
        if now == inside:
            break
        inside, walked = now, walked + 1
    return walked


def permute(df: DataFrame, number: str, n: int, seed: int, out: str = "permuted") -> DataFrame:
    """``df`` with the place of each row number among n under the permutation of ``seed``."""
    df = _step(df, number, n, seed)
    for _ in range(longest_walk(df.sparkSession, n, seed)):
        df = _walk(df, n, seed)
    return df.withColumnRenamed("__y", out)


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """A group from the key's text, the same in every run; 0 for a null key."""
    return F.coalesce(F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long") % F.lit(buckets), F.lit(0)).cast("int")


def number_rows(df: DataFrame, key: str, then: list[str], out: str = "row_number", buckets: int = BUCKETS) -> tuple[DataFrame, int]:
    """``df`` with numbers from 0 without gaps, by bucket of the key, the key and the columns of
    ``then``; and how many there are. Each bucket is sorted on its own; only the buckets' counts
    (at most ``buckets`` rows) go to all tasks, as each one's first number."""
    # rows without a key are dealt by the other columns, not all into one bucket
    dealt = df.withColumn("__bucket", bucket_of(F.coalesce(F.col(key).cast("string"), F.concat_ws(":", *then)), buckets))
    counts = dealt.groupBy("__bucket").agg(F.count("*").alias("__rows"))
    held = sorted((r["__bucket"], r["__rows"]) for r in counts.collect())
    first, total = [], 0
    for bucket, rows in held:
        first.append((bucket, total))
        total += rows
    starts = F.broadcast(df.sparkSession.createDataFrame(first or [(0, 0)], "__bucket int, __first long"))
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy(key, *then))
    return dealt.join(starts, "__bucket").withColumn(out, F.col("__first") + rank - 1).drop("__bucket", "__first"), total


def shard_rows(docs: DataFrame, n_shards: int, seed: int = 17, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the key, size (UTF-8 bytes of the text plus 8),
    text_crc32, row_number, shard and slot.

    The law is by rows: the counts of two shards differ by one at most. The shuffle is the same in
    every run and for every partitioning of the input. Rows with equal keys are ordered by
    checksum and size; rows equal in these too are interchangeable. A null key counts as a key. A
    null text has no bytes: size 8 and checksum 0, as an empty one; a text of any length is only
    measured. Every row of a repeated one is placed. Only key, size and checksum
    are shuffled, never texts. An empty table gives no rows; other columns don't matter."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    slim = docs.select(F.col(f"`{key}`").alias("__key"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered, n = number_rows(slim, "__key", ["text_crc32", "size"])
    place = permute(numbered, "row_number", n, seed)
    return place.select(F.col("__key").alias(key), "size", "text_crc32", "row_number", (F.col("permuted") % n_shards).cast("int").alias("shard"), F.expr(f"permuted div {n_shards}").alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> None:
    """The rows of ``docs``, which have unique keys, in folders ``shard=...`` in the order of their slots."""
    rows = docs.join(placed.select(key, "shard", "slot"), key)
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
