"""Tables bucketed by a key, so that joins and groups by it need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from merrow.sources.files import promote, staging


def store_bucketed(rows: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``rows`` in ``buckets`` by ``key`` to a new path, one sorted file a bucket, and name the
    table in the session's catalog. Tables that are joined by the key need equal numbers of buckets;
    choose it so that a bucket fits a task (some 200 MB). Null keys share a bucket. The files are
    renamed to the path once they are whole."""
    spark, staged = rows.sparkSession, staging(path)
    draft = f"{name}_draft"
    dealt = rows.repartition(buckets, key).write.format("parquet").option("path", staged).option("compression", "zstd")
    dealt.bucketBy(buckets, key).sortBy(key).saveAsTable(draft)
    spark.sql(f"drop table `{draft}`")
    promote(spark, staged, path)
    return attach_bucketed(spark, rows.schema.toDDL(), name, path, key, buckets)


def attach_bucketed(spark: SparkSession, columns: str, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """A stored table of other sessions under a name in this one's catalog; ``columns`` are in DDL."""
    place = path.replace("'", "\\'")
    spark.sql(f"create table `{name}` ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`) into {int(buckets)} buckets location '{place}'")
    return spark.table(f"`{name}`")
