"""Feedback over streams of interactions, equal to the batch result on the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merrow.operators.feedback import dimension
from merrow.sources.files import exists

KEYS = ("user_id", "item_id", "dimension")
_ROW = ("id", "occurred_at", "interaction_type", "value")


def active_state_stream(interactions: DataFrame) -> DataFrame:
    """The newest row of each user, item and dimension, emitted again whenever a batch touches it
    (output mode ``update``).

    Rows may come in any order and twice: the newest by time, then id, wins as in the batch
    backfill. Views aren't state and don't take part. A batch is reduced to one row a key before it
    is shuffled. The state is the result itself, one row a key, which no time makes invalid, so it
    isn't dropped by a watermark; keep it in a state store on disk (RocksDB) where it is large."""
    rows = interactions.where("interaction_type <> 'viewed'").withColumn("dimension", dimension())
    newest = F.max(F.struct("occurred_at", "id", "interaction_type", "value"))
    return rows.groupBy(*KEYS).agg(newest.alias("newest")).select(*KEYS, "newest.interaction_type", "newest.value", "newest.occurred_at", "newest.id")


def superseded_stream(interactions: DataFrame) -> DataFrame:
    """Every row of the log whose validity a batch changes: new rows, and the rows that they end or
    whose end they move, with ``superseded_at`` as ``feedback.supersede`` gives it.

    The state of a user, item and dimension is its rows so far, since a late row may go between any
    two of them. A row that came before (by id) changes nothing. Views have no state: they
    come out with no end, and repeated ones are dropped by the sink, which keeps one row an id."""
    zone = interactions.schema["occurred_at"].dataType
    views = interactions.where("interaction_type = 'viewed'").select("id", "user_id", "item_id", "interaction_type", "value", "occurred_at", F.lit(None).cast(zone).alias("superseded_at"))
    # times are whole microseconds and values text while Python holds them
    rows = interactions.where("interaction_type <> 'viewed'").withColumn("dimension", dimension())
    rows = rows.select(*KEYS, "id", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("occurred_at"), "interaction_type", F.col("value").cast("string").alias("value"))
    row = "id long, occurred_at long, interaction_type string, value string"
    out = f"user_id long, item_id long, {row}, superseded_at long"
    state = "ids array<long>, times array<long>, kinds array<string>, vals array<string>"
    changed = rows.groupBy(*KEYS).applyInPandasWithState(_ended, out, state, "update", "NoTimeout")
    at = lambda c: F.timestamp_micros(c).cast(zone)
    value = F.col("value").cast(interactions.schema["value"].dataType)
    changed = changed.select("id", "user_id", "item_id", "interaction_type", value.alias("value"), at("occurred_at").alias("occurred_at"), at("superseded_at").alias("superseded_at"))
    return changed.unionByName(views)


def _ended(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    known = list(zip(*state.get, strict=True)) if state.exists else []
    before = _ends(known)
    have = {r[0] for r in known}
    for frame in frames:
        for r in frame[list(_ROW)].itertuples(index=False, name=None):
            if r[0] not in have:
                have.add(r[0])
                known.append((int(r[0]), int(r[1]), r[2], None if pd.isna(r[3]) else r[3]))
    after = _ends(known)
    state.update(tuple(map(list, zip(*known, strict=True))) if known else ([], [], [], []))
    rows = [(key[0], key[1], *r, after[r[0]]) for r in known if r[0] not in before or before[r[0]] != after[r[0]]]
    if rows:
        frame = pd.DataFrame(rows, columns=["user_id", "item_id", *_ROW, "superseded_at"])
        frame["superseded_at"] = frame["superseded_at"].astype("Int64")
        yield frame


def _ends(rows: list[tuple]) -> dict[int, int | None]:
    """When each row ends: when the next newer one occurred, by time and id; the newest doesn't."""
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    return {r[0]: newer[1] for r, newer in zip(ordered, ordered[1:], strict=False)} | ({ordered[-1][0]: None} if ordered else {})


def keep_changes(path: str):
    """A sink for ``foreachBatch``: the changes of each batch in a folder of its number, which a
    repeated batch writes anew, so that every batch counts once however often it is run."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def kept_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The log as the sink's batches leave it: of each id the row of the newest batch."""
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("batch")))
    return rows.withColumn("__place", newest).where("__place = 1").drop("__place", "batch")
