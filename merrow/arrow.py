"""Helpers for work on Arrow batches in tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a column that are worked on at once.
SLICE_BYTES = 4_000_000


#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 3_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_bytes(spark: SparkSession) -> None:
    """Arrow batches of about so many bytes, unless the session has set another size: a batch is in
    the JVM and in the worker at once, for each core."""
    if spark.conf.get(_BATCH) == "67108864b":
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives back at its end what it has freed: workers stay for a while after their
    tasks, and would keep it beside those of the next stage."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most about ``most`` bytes of text, or values of a list, in a
    column; one row at least."""
    for batch in batches:
        values = batch.column(column)
        sizes = pc.binary_length(values) if not pa.types.is_list(values.type) else pc.multiply(pc.list_value_length(values), 8)
        ends = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
        start = 0
        while start < len(batch):
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(ends.searchsorted(done + (most or SLICE_BYTES), side="right")))
            yield batch.slice(start, end - start)
            start = end


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out to all cores where it is read from fewer files than there are cores, as a
    file may come to a single task; tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
