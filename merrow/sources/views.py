"""The catalog and feedback tables as views of the driver tables, the same in every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW, CUTOFF = "2024-01-20 00:00:00", "2024-01-05 00:00:00"


class Views:
    """Views over one folder of Parquet tables; each is a plan, read when an action asks."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def interactions(self) -> DataFrame:
        kind = F.when(F.col("event_type") == "view", "viewed")
        for event, meaning in (("click", "liked"), ("error", "disliked"), ("signup", "wishlisted")):
            kind = kind.when(F.col("event_type") == event, meaning)
        kind = kind.when(F.col("event_id") % 2 == 0, "rated").otherwise("played")
        value = F.when(F.col("interaction_type") == "rated", F.round(F.least(F.col("value"), F.lit(100.0)) / 5) / 2).cast("decimal(5,2)")
        events = self.table("events").withColumn("interaction_type", kind)
        item = F.get_json_object("props", "$.k").cast("long")
        time = F.col("ts").alias("occurred_at")
        return events.select(F.col("event_id").alias("id"), "user_id", item.alias("item_id"), "interaction_type", value.alias("value"), time)

    def items(self) -> DataFrame:
        """Items made of documents; average_rating only where a label exists."""
        counts = self.interactions().groupBy(F.col("item_id").alias("doc_id")).agg(F.count("*").alias("n"))
        labels = self.table("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        docs = self.table("documents").join(labels, "doc_id", "left").join(counts, "doc_id", "left")
        rating = (4 + 4 * F.col("quality") - 2 * F.col("toxic") + (F.col("doc_id") % 10) / 10).cast("decimal(4,2)")
        return docs.select(
            F.col("doc_id").alias("id"),
            F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("title"),
            F.concat(F.lit("doc-"), "doc_id").alias("slug"),
            F.col("text").alias("description"),
            F.date_add(F.lit("2015-01-01").cast("date"), (F.col("doc_id") % 3650).cast("int")).alias("release_date"),
            F.col("source").alias("developer"),
            F.lit(None).cast("string").alias("publisher"),
            rating.alias("average_rating"),
            (F.col("n_chars") % 5000).cast("int").alias("rating_count"),
            (F.coalesce("n", F.lit(0)) + (F.col("doc_id") % 97) / 10).cast("decimal(10,4)").alias("popularity_score"),
            "lang",
            "source",
        )

    def nested_items(self) -> DataFrame:
        one = lambda c: F.array(F.struct(F.col(c).alias("slug"), F.col(c).alias("name")))
        platforms = F.array_sort(F.array_distinct(F.array(F.concat(F.lit("p"), F.col("id") % 4), F.concat(F.lit("p"), F.col("id") % 6))))
        return self.items().select("*", one("lang").alias("genres"), one("source").alias("tags"), F.transform(platforms, lambda p: F.struct(p.alias("slug"), p.alias("name"))).alias("platforms"))

    def part_items(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("title"),
            F.concat(F.lit("part-"), "p_partkey").alias("slug"),
            F.col("p_brand").alias("developer"),
            F.col("p_size").alias("rating_count"),
            F.col("p_retailprice").cast("decimal(10,4)").alias("popularity_score"),
        )

    def part_genres(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("id"), F.lower("p_type").alias("slug"), F.col("p_type").alias("name"))

    def part_tags(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("id"), F.explode(F.array_distinct(F.split("p_name", " "))).alias("slug")).withColumn("name", F.col("slug"))

    def part_platforms(self) -> DataFrame:
        first = self.table("lineitem").select("l_partkey", "l_suppkey").distinct()
        pairs = first.join(self.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        pairs = pairs.select(F.col("l_partkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("slug")).distinct()
        return pairs.withColumn("name", F.col("slug"))

    def preferences(self) -> DataFrame:
        """Saved preferences: the three items viewed most, a genre, a tag, a platform, and a stale item for some."""
        from pyspark.sql import Window

        views = self.interactions().where("interaction_type = 'viewed'").groupBy("user_id", "item_id").agg(F.count("*").alias("n"))
        rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "item_id"))
        games = views.withColumn("rank", rank).where("rank <= 3").select("user_id", F.lit("game").alias("preference_type"), F.concat(F.lit("doc-"), "item_id").alias("value"))
        users = self.table("events").select("user_id").distinct()
        fixed = F.array(
            F.struct(F.lit("genre").alias("t"), F.lit("en").alias("v")),
            F.struct(F.lit("tag").alias("t"), F.concat(F.lit("src"), F.col("user_id") % 20).alias("v")),
            F.struct(F.lit("platform").alias("t"), F.concat(F.lit("p"), F.col("user_id") % 6).alias("v")),
            F.struct(F.lit("game").alias("t"), F.when(F.col("user_id") % 10 == 0, "doc-999999999").alias("v")),
        )
        rest = users.select("user_id", F.explode(fixed).alias("p")).where("p.v is not null").select("user_id", F.col("p.t").alias("preference_type"), F.col("p.v").alias("value"))
        return games.unionByName(rest).withColumn("weight", F.lit(1).cast("decimal(4,3)"))

    @staticmethod
    def top_k() -> Column:
        """How many items a user asks for."""
        return 5 + F.col("user_id") % 6

    def users(self) -> DataFrame:
        first = self.table("events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
        legacy = F.col("user_id") % 11 == 0
        later = lambda days: F.expr(f"created_at + make_dt_interval(cast({days} as int))")
        return first.select(
            F.col("user_id").alias("id"),
            "created_at",
            F.when(~legacy, F.col("created_at")).alias("consented_at"),
            F.when(~legacy, F.when(F.col("user_id") % 5 == 0, "v0").otherwise("v1")).alias("consent_version"),
            F.when(~legacy, later("user_id % 30 + 1")).alias("expires_at"),
            F.when(legacy | (F.col("user_id") % 7 == 0), later("10")).alias("revoked_at"),
        )

    def rec_events(self) -> DataFrame:
        return self.table("events").where("event_type = 'view'").select(F.concat(F.lit("gen-"), "event_id").alias("generation_id"), "user_id", F.col("ts").alias("generated_at"))
