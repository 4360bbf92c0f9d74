"""What the operators of this subpackage share: tables, scratch tables, Arrow helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.scratch import discard as discard
from merrow.scratch import written as written


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of the input folder, with the named columns only (all of them if none is named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Bytes of a table that is broadcast at most, measured before it is.
MOST_BROADCAST_BYTES = 16_000_000


def is_small(table: DataFrame, most: int | None = None) -> bool:
    """Whether a written table's rows take at most ``most`` bytes, as measured now."""
    widths = [F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8) for f in table.schema]
    total = table.agg(F.sum(sum(widths, F.lit(16)))).first()[0] or 0
    return total <= (MOST_BROADCAST_BYTES if most is None else most)


def small(table: DataFrame, most: int | None = None) -> DataFrame:
    """A written table, marked for broadcast if it is small."""
    return F.broadcast(table) if is_small(table, most) else table


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it.

    Spark may paste a projected expression into every place that reads it, lambdas included;
    a lambda variable is evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most about ``most`` bytes in a column (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < len(batch):
            done = sizes[start - 1] if start else 0
            end = max(start + 1, int(sizes.searchsorted(done + most, side="right")))
            yield batch.slice(start, end - start)
            start = end


#: Rows of an Arrow batch, where the session doesn't say otherwise. Spark's own number suits short
#: rows; of whole texts it makes batches of tens of megabytes, several of which a task holds.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small, unless the session has set their size itself."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)


def arrow_map(df: DataFrame, text_col: str, outputs: T.StructType, make: Callable[[], Callable], keep: list[str] | None = None) -> DataFrame:
    """``df`` with columns computed from whole texts by Arrow batches.

    ``make`` runs once in each task and gives a function from a list of texts (bytes or None) to
    one Arrow array per field of ``outputs``. ``keep`` names the columns passed through (default:
    all). A column that has the name of an output is replaced by it."""
    bounded_batches(df.sparkSession)
    names = [f.name for f in outputs]
    kept = [f for f in df.schema if f.name not in names and (keep is None or f.name in keep)]
    columns = [F.col(f"`{f.name}`") for f in kept]
    n = len(kept)
    at = next((i for i, f in enumerate(kept) if f.name == text_col and f.dataType == T.StringType()), n)
    if at == n:
        columns.append(F.col(f"`{text_col}`").cast("binary").alias(f"__text_{uuid.uuid4().hex[:8]}"))
    schema = T.StructType([*kept, *outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fit = to_arrow_schema(schema)
        work = make()
        for batch in slices(batches, at):
            made = work(batch.column(at).cast(pa.binary()).to_pylist())
            arrays = [*batch.columns[:n], *made]
            yield pa.RecordBatch.from_arrays([a if a.type == f.type else a.cast(f.type) for a, f in zip(arrays, fit, strict=True)], schema=fit)

    return df.select(*columns).mapInArrow(run, schema)
