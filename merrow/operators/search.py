"""Literal title search through a posting table of trigrams, exact for every query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merrow.operators.catalog import search_title
from merrow.scratch import written

#: Characters of a gram. Shorter queries can't be looked up and scan the titles.
SIZE = 3
#: Grams of a query that are intersected, the rarest ones; what they leave is verified anyway.
MOST_GRAMS = 4


@dataclass
class Index:
    """postings: (gram, id) in the order of grams; frequencies: (gram, n)."""

    postings: DataFrame
    frequencies: DataFrame


def index_titles(items: DataFrame) -> Index:
    """The index of items (id, title), as written tables. A null or short title has no grams."""
    title = F.lower("title")
    starts = F.when(F.length(title) >= SIZE, F.sequence(F.lit(1), F.length(title) - SIZE + 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(title, i, F.lit(SIZE))))
    postings = items.select("id", F.explode(grams).alias("gram")).select("gram", "id")
    held = written(postings.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id"), "postings")
    return Index(held, written(held.groupBy("gram").agg(F.count("*").alias("n")), "gram-frequencies"))


def search_indexed(items: DataFrame, index: Index, query: str) -> DataFrame:
    """Items whose title contains the query, ignoring case; every character stands for itself, as in
    ``catalog.search_title``. Only postings of the query's rarest grams are read, and titles of the
    items that have all of these are verified. An empty query finds everything."""
    if len(query) < SIZE:
        return search_title(items, query)
    spark = items.sparkSession
    low = spark.range(1).select(F.lower(F.lit(query)).alias("q")).first().q
    grams = {low[i : i + SIZE] for i in range(len(low) - SIZE + 1)}
    known = index.frequencies.where(F.col("gram").isin(*grams)).orderBy("n", "gram").collect()
    if len(known) < len(grams):
        return items.where("false")
    rarest = [r.gram for r in known[:MOST_GRAMS]]
    both = index.postings.where(F.col("gram").isin(*rarest)).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest))
    return search_title(items.join(both.select("id"), "id", "left_semi"), query)
