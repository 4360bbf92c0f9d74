"""Data quality: rules on rows, uniqueness, references, canonical items. All give violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from merrow.functions.text import casefold, normalize_text

# Fixed value: the grammar of a slug.
SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"
# The allowed names.
INTERACTION_TYPES = ("viewed", "liked", "disliked", "played", "wishlisted", "rated")
PREFERENCE_TYPES = ("genre", "tag", "platform", "game")


def holds(test: Column) -> Column:
    """A test that a null doesn't fail, as in a CHECK constraint."""
    return F.coalesce(test, F.lit(True))


def item_rules() -> dict[str, Column]:
    return {
        "slug_format": holds(F.col("slug").rlike(SLUG)),
        "slug_length": holds(F.length("slug") <= 220),
        "title_length": holds(F.length("title") <= 200),
        "average_rating_range": holds(F.col("average_rating").between(0, 10)),
        "rating_count_range": holds(F.col("rating_count") >= 0),
        "popularity_range": holds(F.col("popularity_score") >= 0),
    }


def interaction_rules() -> dict[str, Column]:
    rated = F.col("interaction_type") == "rated"
    return {
        "type_known": holds(F.col("interaction_type").isin(*INTERACTION_TYPES)),
        "value_only_for_ratings": F.when(rated, F.col("value").isNotNull() & F.col("value").between(0, 10)).otherwise(F.col("value").isNull()),
        "superseded_after": holds(F.col("superseded_at") >= F.col("occurred_at")),
    }


def preference_rules() -> dict[str, Column]:
    return {"type_known": holds(F.col("preference_type").isin(*PREFERENCE_TYPES)), "value_length": holds(F.length("value").between(1, 220)), "weight_range": holds(F.col("weight").between(0, 1))}


def user_rules() -> dict[str, Column]:
    names = ("consent_version", "consented_at", "expires_at")
    none = F.col(names[0]).isNull() & F.col(names[1]).isNull() & F.col(names[2]).isNull() & F.col("revoked_at").isNotNull()
    every = F.col(names[0]).isNotNull() & (F.length(F.trim(names[0])) > 0) & F.col(names[1]).isNotNull() & F.col(names[2]).isNotNull() & F.coalesce(F.col("expires_at") > F.col("consented_at"), F.lit(False))
    return {"consent_lifecycle": none | every}


def digest_rule(column: str = "anonymous_token_digest") -> dict[str, Column]:
    return {"digest_format": holds(F.col(column).rlike("^[0-9a-f]{64}$"))}


def event_rules() -> dict[str, Column]:
    extra = ("data_fingerprint", "ranking_policy_name", "ranking_policy_version")
    old = F.col("event_schema_version") == "legacy-v1"
    new = F.col("event_schema_version") == "stage-4-v1"
    shape = lambda c, kind: holds(F.col(c).isNull() | F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith(kind), F.lit(False)))
    all_null = F.col(extra[0]).isNull() & F.col(extra[1]).isNull() & F.col(extra[2]).isNull()
    all_set = F.col(extra[0]).isNotNull() & F.col(extra[1]).isNotNull() & F.col(extra[2]).isNotNull()
    return {"event_identity": F.coalesce((old & all_null) | (new & all_set), F.lit(False)), "context_is_object": shape("request_context", "OBJECT"), "result_is_array": shape("result_summary", "ARRAY")}


def violations(rows: DataFrame, table: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """(table, rule, key) of every rule that a row breaks, in one pass."""
    broken = F.array_compact(F.array(*[F.when(~test, F.lit(name)) for name, test in rules.items()]))
    return rows.select(F.lit(table).alias("table"), F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def split(rows: DataFrame, rules: dict[str, Column], path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Clean rows, rejected rows with their ``reasons``, and how many rows there are and break each
    rule, from one scan of ``rows``: both kinds are written side by side where nothing is, while
    the counts are observed. An empty table gives two empty ones."""
    broken = F.array_compact(F.array(*[F.when(~test, F.lit(name)) for name, test in rules.items()]))
    # the flag is made once; a row that breaks a rule goes to the other folder
    marked = rows.withColumn("reasons", broken).withColumn("verdict", F.when(F.size("reasons") == 0, "clean").otherwise("reject"))
    watch = Observation()
    counts = [F.count_if(F.array_contains("reasons", name)).alias(name) for name in rules]
    observed = marked.observe(watch, F.count(F.lit(1)).alias("rows"), *counts)
    observed.write.mode("errorifexists").partitionBy("verdict").parquet(path)
    both = rows.sparkSession.read.schema(marked.schema).parquet(path)
    return both.where("verdict = 'clean'").drop("reasons", "verdict"), both.where("verdict = 'reject'").drop("verdict"), dict(watch.get)


def duplicates(rows: DataFrame, table: str, rule: str, keys: list[str], where: Column | None = None) -> DataFrame:
    """(table, rule, key, n) of keys that occur more than once among the rows that ``where`` selects."""
    part = rows.where(where) if where is not None else rows
    found = part.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return found.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("key"), "n")


def orphans(child: DataFrame, table: str, rule: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(table, rule, key, n) of child values that the parent lacks; nulls refer to nothing."""
    refs = child.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__ref")).agg(F.count("*").alias("n"))
    gone = refs.join(parent.select(F.col(parent_key).alias("__ref")), "__ref", "left_anti")
    return gone.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), F.col("__ref").cast("string").alias("key"), "n")


def feedback_rules() -> dict[str, Column]:
    return {
        "reaction_known": holds(F.col("reaction").isin("liked", "disliked")),
        "reaction_time": F.col("reaction").isNull() == F.col("reaction_at").isNull(),
        "rating_range": holds(F.col("rating").between(0, 10)),
        "rating_time": F.col("rating").isNull() == F.col("rating_at").isNull(),
        "has_a_value": F.col("reaction").isNotNull() | F.coalesce("played", F.lit(False)) | F.coalesce("wishlisted", F.lit(False)) | F.col("rating").isNotNull(),
    }


def seed_problems(games: DataFrame, taxonomies: DataFrame, least_games: int = 25) -> DataFrame:
    """(rule, key) for a catalog file: taxonomies (family, slug, name) unique by folded name and by
    slug, games unique by slug, no repeated or unknown references, at least one genre and platform,
    and enough games."""
    folded = taxonomies.withColumn("folded", casefold(F.col("name")))
    out = duplicates(folded, "taxonomies", "name_repeated", ["family", "folded"]).unionByName(duplicates(taxonomies, "taxonomies", "slug_repeated", ["family", "slug"])).unionByName(duplicates(games, "games", "slug_repeated", ["slug"])).select("rule", "key")
    fields = {"genre": "genre_slugs", "tag": "tag_slugs", "platform": "platform_slugs"}
    rules = {f"{c}_repeated": holds(F.size(F.array_distinct(c)) == F.size(c)) for c in fields.values()}
    rules |= {f"{fields[f]}_missing": F.coalesce(F.size(fields[f]) > 0, F.lit(False)) for f in ("genre", "platform")}
    # digits of a number are bounded by its type; lengths and ranges as for items
    rules |= item_rules()
    out = out.unionByName(violations(games, "games", "slug", rules).select("rule", "key"))

    def named(family: str, column: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda s: F.struct(F.lit(family).alias("family"), s.alias("slug")))

    pairs = F.flatten(F.array(*[named(*f) for f in fields.items()]))
    used = games.select(F.col("slug").alias("game"), F.explode(pairs).alias("r")).select("game", "r.*")
    unknown = used.join(taxonomies.select("family", "slug"), ["family", "slug"], "left_anti").select(F.concat(F.col("family"), F.lit("_unknown")).alias("rule"), F.concat_ws(":", "game", "slug").alias("key"))
    few = games.agg(F.count("*").alias("n")).where(F.col("n") < least_games).select(F.lit("too_few_games").alias("rule"), F.col("n").cast("string").alias("key"))
    return out.unionByName(unknown).unionByName(few)


def canonical_items(items: DataFrame) -> DataFrame:
    """Nested items in canonical form with ``rejects``, the reasons that a row can't be used: texts
    normalised, lists by slug, an empty studio as null."""
    text = {c: normalize_text(F.col(c)) for c in ("title", "description", "developer", "publisher") if c in items.columns}
    out = items.withColumns(text)
    studios = {c: F.when(F.col(c) != "", F.col(c)) for c in ("developer", "publisher") if c in items.columns}
    out = out.withColumns(studios | {k: F.array_sort(k) for k in ("genres", "tags", "platforms")})
    finite = lambda c: ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    rules = {
        "title_blank": F.coalesce(F.col("title") != "", F.lit(False)),
        "description_blank": F.coalesce(F.col("description") != "", F.lit(False)),
        "slug_format": F.coalesce(F.col("slug").rlike(SLUG), F.lit(False)),
        "average_rating_range": holds(finite("average_rating") & F.col("average_rating").between(0, 10)),
        "rating_count_range": F.coalesce(F.col("rating_count") >= 0, F.lit(False)),
        "popularity_range": F.coalesce(finite("popularity_score") & (F.col("popularity_score") >= 0), F.lit(False)),
    }
    rules |= {f"{k}_repeated": F.size(F.array_distinct(F.transform(k, lambda v: v["slug"]))) == F.size(k) for k in ("genres", "tags", "platforms")}
    return out.withColumn("rejects", F.array_compact(F.array(*[F.when(~t, F.lit(n)) for n, t in rules.items()])))


def catalog_verdict(canonical: DataFrame) -> DataFrame:
    """One row: items, rejected, repeated slugs, and valid (a catalog with any reject, repeated slug
    or without items is invalid as a whole)."""
    per_slug = canonical.groupBy("slug").agg(F.count("*").alias("n"), F.count_if(F.size("rejects") > 0).alias("bad"))
    totals = per_slug.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.coalesce(F.sum("bad"), F.lit(0)).alias("rejected"), F.count_if(F.col("n") > 1).alias("repeated_slugs"))
    return totals.withColumn("valid", (F.col("items") > 0) & (F.col("rejected") == 0) & (F.col("repeated_slugs") == 0))
