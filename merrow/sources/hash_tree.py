"""A catalog's fingerprint as a stored tree of hashes, so that changes cost what they touch.

An item's leaf is the hash of its row. Its place follows from its slug alone: six hex digits of the
slug's hash name its group, three of them the group's parent, and the root is above these 4,096.
A node's hash is that of its children's in order. When items change, only their groups, the parents
of these and the root are hashed again; and two trees are compared from the root down, reading only
children of nodes that differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merrow.functions.identity import canonical_json, finite
from merrow.scratch import is_written, kept, written

DIGITS = (6, 3, 0)


def row_hash(items: DataFrame) -> Column:
    """SHA-256 of an item's canonical JSON; lists are taken by slug."""
    lists = {k: F.array_sort(k) for k in ("genres", "tags", "platforms")}
    names = ("slug", "title", "description", "developer", "publisher")
    numbers = {k: finite(F.col(k).cast("double")) for k in ("average_rating", "popularity_score")} | {"rating_count": F.col("rating_count").cast("long")}
    return F.sha2(canonical_json(**{n: F.col(n) for n in names}, **numbers, **lists), 256)


@dataclass
class Tree:
    """leaves: (slug, place, hash); levels: (place, hash) of six, three and no digits."""

    leaves: DataFrame
    levels: list[DataFrame]

    @property
    def root(self) -> DataFrame:
        """One row: fingerprint, that of an empty catalog too."""
        return self.levels[-1].agg(F.coalesce(F.max("hash"), F.sha2(F.lit(""), 256)).alias("fingerprint"))


def leaves_of(items: DataFrame) -> DataFrame:
    return items.select("slug", F.substring(F.sha2("slug", 256), 1, DIGITS[0]).alias("place"), row_hash(items).alias("hash"))


def _above(children: DataFrame, digits: int, named: str) -> DataFrame:
    """Nodes over children, which are ordered by ``named``. A group of slugs has a 16,777,216th of
    all on average, and a node of the other levels at most 4,096 children."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(named, "hash"))), lambda c: F.concat_ws(":", c[named], c["hash"])), ",")
    nodes = children.groupBy(F.substring("place", 1, digits).alias("__place")).agg(F.sha2(ordered, 256).alias("hash"))
    return nodes.withColumnRenamed("__place", "place")


def _level(leaves: DataFrame, levels: list[DataFrame], digits: int) -> DataFrame:
    return _above(levels[-1], digits, "place") if levels else _above(leaves.withColumnRenamed("slug", "name"), digits, "name")


def tree(items: DataFrame) -> Tree:
    """The whole tree of nested items."""
    leaves, levels = leaves_of(items), []
    for digits in DIGITS:
        levels.append(_level(leaves, levels, digits))
    return Tree(leaves, levels)


def held(new: Tree) -> Tree:
    """The tree in scratch tables, for those who read its levels one by one. Each level is made of
    the written one below, so that items are hashed once."""
    leaves, levels = kept(new.leaves, "leaves"), []
    for digits, level in zip(DIGITS, new.levels, strict=True):
        levels.append(level if is_written(level) else written(_level(leaves, levels, digits), "level"))
    return Tree(leaves, levels)


def refreshed(old: Tree, changed: DataFrame, removed: DataFrame) -> Tree:
    """The tree after nested items were added or changed, and slugs removed (a table of slug), in
    scratch tables. Branches without either are taken over as they are."""
    new = written(leaves_of(changed), "new-leaves")
    gone = new.select("slug").unionByName(removed.select("slug")).distinct()
    places = gone.select(F.substring(F.sha2("slug", 256), 1, DIGITS[0]).alias("place")).distinct()
    leaves = written(old.leaves.join(gone, "slug", "left_anti").unionByName(new), "leaves")
    below, named, levels = leaves.withColumnRenamed("slug", "name"), "name", []
    for digits, level in zip(DIGITS, old.levels, strict=True):
        touched = places.select(F.substring("place", 1, digits).alias("place")).distinct()
        # the children of touched nodes are found by the nodes' places, not by hashing all
        own = below.withColumn("__above", F.substring("place", 1, digits)).join(touched.withColumnRenamed("place", "__above"), "__above", "left_semi").drop("__above")
        levels.append(written(level.join(touched, "place", "left_anti").unionByName(_above(own, digits, named)), "level"))
        below, named = levels[-1], "place"
    return Tree(leaves, levels)


def save(new: Tree, path: str) -> None:
    """Write a tree where nothing is; leaves lie in the order of their places."""
    new.leaves.repartitionByRange("place", "slug").sortWithinPartitions("place", "slug").write.mode("errorifexists").parquet(f"{path}/leaves")
    for digits, level in zip(DIGITS, new.levels, strict=True):
        level.repartitionByRange("place").sortWithinPartitions("place").write.mode("errorifexists").parquet(f"{path}/level-{digits}")


def read(spark: SparkSession, path: str) -> Tree:
    return Tree(spark.read.parquet(f"{path}/leaves"), [spark.read.parquet(f"{path}/level-{d}") for d in DIGITS])


def changes(old: Tree, new: Tree) -> DataFrame:
    """(slug, change) of items added, removed or changed between two trees: at each level only the
    children of nodes that differ are compared."""
    differ = None
    for digits, (a, b) in zip(reversed(DIGITS), zip(reversed(old.levels), reversed(new.levels), strict=True), strict=True):
        sides = [a, b]
        if differ is not None:
            sides = [s.withColumn("__above", F.substring("place", 1, above)).join(differ.withColumnRenamed("place", "__above"), "__above", "left_semi").drop("__above") for s in sides]
        left, right = sides[0].withColumnRenamed("hash", "old"), sides[1].withColumnRenamed("hash", "new")
        differ, above = left.join(right, "place", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("place"), digits
    old_rows, new_rows = (t.leaves.join(differ, "place", "left_semi").select("slug", F.col("hash").alias(name)) for t, name in ((old, "old"), (new, "new")))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return old_rows.join(new_rows, "slug", "full_outer").select("slug", change.alias("change")).where("change is not null")
