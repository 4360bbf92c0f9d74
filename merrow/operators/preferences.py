"""Saved preferences: pivot, replacement, stale references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAMILIES = {"game": "selected", "genre": "genres", "tag": "tags", "platform": "platforms"}


def pivot_preferences(preferences: DataFrame) -> DataFrame:
    """One row for each user with sorted arrays selected, genres, tags and platforms."""
    lists = [F.array_sort(F.collect_set(F.when(F.col("preference_type") == kind, F.col("value")))).alias(name) for kind, name in FAMILIES.items()]
    return preferences.groupBy("user_id").agg(*lists)


def list_preferences(preferences: DataFrame, user_id: int) -> DataFrame:
    return preferences.where(F.col("user_id") == user_id).orderBy("preference_type", "value")


def replace_preferences(current: DataFrame, desired: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, preference_type, value, weight, change) after replacing all preferences of
    ``users``; change is kept, deleted or inserted. Users that aren't named keep everything."""
    keys = ["user_id", "preference_type", "value"]
    wanted = desired.select(*keys).distinct().withColumn("want", F.lit(True))
    have = current.select(*keys).distinct().withColumn("have", F.lit(True))
    named = users.select("user_id").distinct().withColumn("named", F.lit(True))
    both = have.join(wanted, keys, "full_outer").join(named, "user_id", "left")
    change = F.when(F.col("have") & F.col("want"), "kept").when(F.col("have") & F.col("named"), "deleted").when(F.col("have"), "kept").when(F.col("named"), "inserted")
    return both.withColumn("change", change).where("change is not null").select(*keys, F.lit(1).cast("decimal(4,3)").alias("weight"), "change")


def changed_users(replaced: DataFrame) -> DataFrame:
    """(user_id, changed): whether a replacement did anything."""
    return replaced.groupBy("user_id").agg(F.bool_or(F.col("change") != "kept").alias("changed"))


def stale_references(preferences: DataFrame, known: DataFrame, most: int = 26) -> DataFrame:
    """(user_id, reference) of saved values that ``known`` (family, slug) lacks, as family:slug, the
    first ``most`` of each user (the report's length)."""
    missing = preferences.select("user_id", F.col("preference_type").alias("family"), F.col("value").alias("slug")).join(known, ["family", "slug"], "left_anti")
    named = missing.select("user_id", F.concat_ws(":", "family", "slug").alias("reference")).distinct()
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("reference"))
    return named.withColumn("place", rank).where(F.col("place") <= most)


def without_stale(preferences: DataFrame, known: DataFrame) -> DataFrame:
    """Preferences whose values exist."""
    names = known.select(F.col("family").alias("preference_type"), F.col("slug").alias("value"))
    return preferences.join(names, ["preference_type", "value"], "left_semi")


def contexts_of(preferences: DataFrame, top_k: Column) -> DataFrame:
    """Contexts of users with all that they saved, asking for ``top_k`` items (of user_id). ``ranking.context_problems`` reports those beyond
    the bounds of a request (five items and genres, ten tags, six platforms)."""
    pivoted = pivot_preferences(preferences)
    return pivoted.select("user_id", F.col("user_id").alias("context_id"), "selected", "genres", "tags", "platforms", top_k.cast("int").alias("top_k"))
