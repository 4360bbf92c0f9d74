"""Tables laid out by day and by hash of a key, of which a job rewrites only the partitions it changes.

A job names the rows that change, their partitions are found first (key and time are all that is
read for that), and only those are read, mapped and replaced by a dynamic partition overwrite. Files
of other partitions aren't touched. A job that ends half-way leaves each partition old or new; it
can run again, as all jobs here find nothing to do where they have been."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.sources.files import exists, folders, locked, promote, read_text, remove, staging, write_text

DAY, BUCKET = "part_day", "part_bucket"
#: A table has fewer partitions than this; their list is what passes through the driver.
MOST_PARTITIONS = 200_000
# Fixed value: the folder of a partition whose day is null.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"
#: The file of a table's schema and layout; readers pass over names with this start.
FACTS = "_layout.json"


@dataclass(frozen=True)
class Layout:
    """A table at ``path`` in ``buckets`` by the hash of ``key`` and, with ``time``, by day before that."""

    path: str
    key: str
    buckets: int = 64
    time: str | None = None

    @property
    def levels(self) -> list[str]:
        return [DAY, BUCKET] if self.time else [BUCKET]

    def bucket(self) -> Column:
        """Of the key as text, so that integers of all widths agree."""
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def marked(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the columns of the partition that each belongs to, whose names are taken."""
        if {DAY, BUCKET} & set(rows.columns):
            raise ValueError(f"{DAY} and {BUCKET} are names of the layout")
        marks = {BUCKET: self.bucket()} | ({DAY: F.col(self.time).cast("date").cast("string")} if self.time else {})
        return rows.withColumns(marks)

    def folder(self, part: tuple) -> str:
        named = {level: NO_DAY if value is None else value for level, value in zip(self.levels, part, strict=True)}
        return "/".join([self.path, *(f"{level}={value}" for level, value in named.items())])


def _write(rows: DataFrame, layout: Layout) -> set[tuple]:
    """Replace the partitions that ``rows`` (marked) are in; which these are. Rows are dealt out by
    partition, and adaptive execution splits a partition that holds very many."""
    seen, levels = Observation(), layout.levels
    dealt = rows.hint("rebalance", *levels).observe(seen, F.collect_set(F.struct(*levels)).alias("parts"))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*levels).parquet(layout.path)
    return {tuple(part) for part in seen.get["parts"]}


def lay_out(rows: DataFrame, layout: Layout) -> None:
    """Write a whole table for the first time, under its path only once it is whole. Null keys share
    a bucket and null times a day; a table of no rows has a schema."""
    spark = rows.sparkSession
    marked = layout.marked(rows)
    if exists(spark, layout.path):
        raise FileExistsError(f"{layout.path} exists")
    staged = replace(layout, path=staging(layout.path))
    # by name, as the partitions' columns are last in files
    columns = [*rows.columns, *layout.levels]
    write_text(spark, f"{staged.path}/{FACTS}", json.dumps({"layout": [layout.key, layout.buckets, layout.time], "schema": marked.select(*columns).schema.jsonValue()}))
    _write(marked, staged)
    promote(spark, staged.path, layout.path)


def table(spark: SparkSession, layout: Layout) -> DataFrame:
    """All rows, with the columns of their partitions."""
    facts = json.loads(read_text(spark, f"{layout.path}/{FACTS}"))
    if facts["layout"] != [layout.key, layout.buckets, layout.time]:
        raise ValueError(f"{layout.path} is laid out by {facts['layout']}")
    return spark.read.schema(T.StructType.fromJson(facts["schema"])).option("basePath", layout.path).parquet(layout.path)


def plain(spark: SparkSession, layout: Layout) -> DataFrame:
    """All rows as they were written."""
    return table(spark, layout).drop(DAY, BUCKET)


def of_keys(spark: SparkSession, layout: Layout, keys: DataFrame) -> DataFrame:
    """The rows of the buckets that ``keys`` (a table with the key's column) fall into."""
    buckets = [row[0] for row in keys.select(layout.bucket()).distinct().collect()]
    return table(spark, layout).where(F.col(BUCKET).isin(buckets))


def partitions_of(rows: DataFrame, layout: Layout) -> list[tuple]:
    """The distinct partitions of marked rows, in order."""
    found = [tuple(r) for r in rows.select(*layout.levels).distinct().orderBy(*layout.levels).limit(MOST_PARTITIONS + 1).collect()]
    if len(found) > MOST_PARTITIONS:
        raise ValueError(f"{layout.path} has over {MOST_PARTITIONS} partitions; choose fewer buckets")
    return found


def _there(spark: SparkSession, layout: Layout, parts: list[tuple]) -> DataFrame:
    """The rows of some partitions: conditions on partition columns only, so that no other is read."""
    by_day: dict[str | None, list[int]] = {}
    for *day, bucket in parts:
        by_day.setdefault(day[0] if day else None, []).append(bucket)
    wanted = F.lit(False)
    for day, buckets in by_day.items():
        same_day = F.col(DAY).eqNullSafe(F.lit(day)) if layout.time else F.lit(True)
        wanted = wanted | (same_day & F.col(BUCKET).isin(buckets))
    return table(spark, layout).where(wanted).drop(DAY, BUCKET)


def _refuse_others(rows: DataFrame, parts: DataFrame, layout: Layout) -> DataFrame:
    """``rows`` (marked); one outside of ``parts``, which has fewer rows than MOST_PARTITIONS, is an error."""
    known = parts.select(*[F.col(level).alias(f"{level}_known") for level in layout.levels], F.lit(True).alias("part_is_known"))
    same = F.lit(True)
    for level in layout.levels:
        same = same & F.col(level).eqNullSafe(F.col(f"{level}_known"))
    both = rows.join(F.broadcast(known), same, "left")
    wrong = F.raise_error(F.lit(f"a row is outside of the partitions of {layout.path} that change")).cast("int")
    checked = F.when(F.col("part_is_known"), F.col(BUCKET)).otherwise(wrong).alias(BUCKET)
    return both.select(*[checked if c == BUCKET else F.col(f"`{c}`") for c in rows.columns])


def rewrite(spark: SparkSession, layout: Layout, changing: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """Replace the partitions of the rows ``changing`` (with the partitions' columns, new rows
    among them) and return how many these are.

    ``change(old, parts)`` maps the rows of those partitions to new ones; ``parts`` (the levels)
    names the partitions. A row that it puts anywhere else fails the job before anything is
    replaced. A partition that is left without rows goes. One job at a time: another one on the
    same table is refused."""
    with locked(spark, layout.path):
        parts = partitions_of(changing, layout)
        if not parts:
            return 0
        named = spark.createDataFrame(parts, f"{DAY} string, {BUCKET} int" if layout.time else f"{BUCKET} int")
        new = layout.marked(change(_there(spark, layout, parts), named))
        left = _write(_refuse_others(new, named, layout), layout)
        for part in set(parts) - left:
            remove(spark, layout.folder(part))
        return len(parts)


def drop_days(spark: SparkSession, layout: Layout, before: date) -> int:
    """Remove the partitions of all days before one, whole and unread; how many days these were.
    Rows without a time stay."""
    with locked(spark, layout.path):
        old = [d for d in folders(spark, layout.path, f"{DAY}=") if d != NO_DAY and date.fromisoformat(d) < before]
        for day in old:
            remove(spark, f"{layout.path}/{DAY}={day}")
        return len(old)
