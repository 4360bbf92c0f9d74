"""The nested JSON catalog: a strict read, and its tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.schemas import SEED


@dataclass
class Seed:
    provenance: DataFrame
    taxonomies: DataFrame
    games: DataFrame
    bridges: dict[str, DataFrame]


def unknown_fields(spark: SparkSession, path: str) -> DataFrame:
    """(place, field) of fields that the schema doesn't have, at any level."""
    text = spark.read.text(path, wholetext=True).select("value")

    def extra(rows: DataFrame, column: str, place: str, kind: T.StructType) -> DataFrame:
        known = F.array(*[F.lit(f.name) for f in kind])
        found = rows.select(F.explode(F.array_except(F.json_object_keys(column), known)).alias("field"))
        return found.select(F.lit(place).alias("place"), "field").distinct()

    def inside(column: str, path_: str) -> DataFrame:
        each = F.from_json(F.get_json_object(column, path_), "array<string>")
        return text.select(F.explode_outer(each).alias("row"))

    out = extra(text, "value", "$", SEED)
    for name in ("provenance", "taxonomies"):
        out = out.unionByName(extra(text.select(F.get_json_object("value", f"$.{name}").alias("row")), "row", name, SEED[name].dataType))
    for name in ("genres", "tags", "platforms"):
        out = out.unionByName(extra(inside("value", f"$.taxonomies.{name}"), "row", name, SEED["taxonomies"].dataType[name].dataType.elementType))
    return out.unionByName(extra(inside("value", "$.games"), "row", "games", SEED["games"].dataType.elementType))


def read_seed(spark: SparkSession, path: str) -> Seed:
    """The catalog file's tables. A value of a wrong type or an unknown field fails the read."""
    bad = [f"{r.place}.{r.field}" for r in unknown_fields(spark, path).limit(20).collect()]
    if bad:
        raise ValueError("the catalog has unknown fields: " + ", ".join(sorted(bad)))
    whole = spark.read.schema(SEED).option("multiLine", True).option("mode", "FAILFAST").json(path)
    families = {"genre": "genres", "tag": "tags", "platform": "platforms"}

    def listed(one: str, many: str) -> Column:
        return F.transform(F.col(f"taxonomies.{many}"), lambda t: F.struct(F.lit(one).alias("family"), t["slug"].alias("slug"), t["name"].alias("name")))

    lists = F.flatten(F.array(*[listed(*f) for f in families.items()]))
    taxonomies = whole.select(F.explode(lists).alias("t")).select("t.*")
    games = whole.select(F.posexplode("games").alias("place", "g")).select((F.col("place") + 1).cast("long").alias("id"), "g.*")
    bridges = {}
    for one, many in families.items():
        names = taxonomies.where(F.col("family") == one).select("slug", "name")
        bridges[many] = games.select("id", F.explode(f"{one}_slugs").alias("slug")).join(names, "slug").select("id", "slug", "name")
    return Seed(whole.select("provenance.*"), taxonomies, games, bridges)
