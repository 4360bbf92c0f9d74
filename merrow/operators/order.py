"""Row numbers of a whole table in a sort order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merrow.scratch import written

#: Bits of ``monotonically_increasing_id`` that count rows within a partition.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[Column], out: str = "place", name: str = "numbered") -> DataFrame:
    """``df`` with each row's number, from 1 without gaps, in the order given, as a written table.

    Rows are dealt into ranges of the order and sorted there; a range's first number is the sum of
    the counts of those before it, and only these counts (a row for each range) go to all tasks.
    Rows that are equal in the order are numbered in any order, each once, and may be dealt out by
    further columns of ``order`` to keep a range small. An empty table gives no rows."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = written(dealt.withColumn("__at", F.monotonically_increasing_id()), name)
    part = F.shiftright("__at", ROW_BITS)
    counts = sorted(held.groupBy(part.alias("part")).agg(F.count("*").alias("rows")).collect())
    first, total = [], 0
    for row in counts:
        first.append((row["part"], total))
        total += row["rows"]
    starts = F.broadcast(df.sparkSession.createDataFrame(first or [(0, 0)], "__part long, __first long"))
    number = F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return held.join(starts, part == F.col("__part")).withColumn(out, number).drop("__at", "__part", "__first")
