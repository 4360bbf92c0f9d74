"""Tables written once in the folder that a cluster shares, to cut lineage and plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where the session names none, a session on one
    machine gets a temporary one; on a cluster that would be lost rows, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="merrow-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that is this application's own."""
    return f"{shared_folder(spark)}/merrow/{spark.sparkContext.applicationId}"


#: Makes Spark remove an execution's shuffles as it ends, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back, so that a lost
    executor costs a read and not a recomputation, and later plans start from a scan. The shuffles
    of the write are gone when it is done."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._merrow_path = path
    return out


def is_written(df: DataFrame) -> bool:
    """Whether ``df`` is a table of ``written`` as it is."""
    return hasattr(df, "_merrow_path")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, or as it is if it has been already."""
    return df if is_written(df) else written(df, name)


def discard(*tables: DataFrame) -> None:
    """Remove the files behind ``written`` tables that nothing will read again."""
    for df in tables:
        _remove(df.sparkSession, df._merrow_path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application wrote. For the owner of a job, once its results are
    saved: a result that is read after this fails."""
    _remove(spark, run_folder(spark))


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
