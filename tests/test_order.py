"""Row numbers over ranges."""

from pyspark.sql import functions as F

from merrow.operators.order import numbered


def test_numbers_follow_the_order(spark):
    rows = spark.range(5_000).select("id", (F.xxhash64("id") % 97).alias("k"))
    got = numbered(rows, [F.desc("k"), F.col("id")]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 5_001))
    assert [(r.k, r.id) for r in got] == sorted(((r.k, r.id) for r in got), key=lambda r: (-r[0], r[1]))


def test_equal_rows_and_none(spark):
    rows = spark.createDataFrame([(1, "a")] * 7 + [(None, "b")], "k int, v string")
    assert sorted(r.place for r in numbered(rows, [F.col("k")]).collect()) == list(range(1, 9))
    assert numbered(rows.where("false"), [F.col("k")]).collect() == []
