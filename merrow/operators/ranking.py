"""Content ranking for many contexts at once: user vectors, scores, ranks, evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merrow.config import RANKING, RankingConfig
from merrow.functions.fixedpoint import contribution, quantize
from merrow.operators.features import Features, preference_vectors
from merrow.operators.packed import products
from merrow.operators.tiles import MIXED, Policy, best_items
from merrow.scratch import written


@dataclass
class Model:
    """What ranking needs: nested items, features, and popularity (slug, popularity)."""

    items: DataFrame
    features: Features
    popularity: DataFrame


def context_problems(contexts: DataFrame, items: DataFrame, config: RankingConfig = RANKING) -> DataFrame:
    """(context_id, reason) of contexts that can't be ranked."""
    most = {"selected": config.most_selected, "genres": config.most_genres, "tags": config.most_tags, "platforms": config.most_platforms}
    found = [F.when((F.size("selected") == 0) & (F.size("genres") == 0) & (F.size("tags") == 0), "no_content_signal")]
    for name, limit in most.items():
        found.append(F.when(F.size(name) > limit, f"{name}_too_many"))
        found.append(F.when(F.size(F.array_distinct(name)) < F.size(name), f"{name}_repeated"))
    found.append(F.when(~F.coalesce(F.col("top_k").between(1, config.most_top_k), F.lit(False)), "top_k_out_of_range"))
    shape = contexts.select("context_id", F.explode(F.array_compact(F.array(*found))).alias("reason"))
    picked = contexts.select("context_id", F.explode("selected").alias("slug"))
    unknown = picked.join(items.select("slug"), "slug", "left_anti").select("context_id", F.lit("selected_unknown").alias("reason")).distinct()
    return shape.unionByName(unknown)


def packed_items(model: Model) -> DataFrame:
    """(slug, numbers, weights, has, popularity_units): all that scoring needs of an item, one row,
    as a written table."""
    popular = model.popularity.select("slug", quantize(F.col("popularity")).alias("popularity_units"))
    has = F.coalesce(F.transform("platforms", lambda p: p["slug"]), F.array().cast("array<string>"))
    facts = model.items.select("slug", has.alias("has")).join(popular, "slug")
    return written(model.features.vectors.join(facts, "slug"), "packed-items")


def queries_of(contexts: DataFrame, model: Model, extra: DataFrame | None = None) -> DataFrame:
    """Contexts as the queries of a tile join (context_id, MIXED), a written table. Picked items and
    preferences, each of norm 1, are mixed there; either alone has all the weight. A context whose
    preferences match no known term has no query, even if it picked items. ``extra`` has further
    columns of a query by context_id: sources, excluded, played."""
    none = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    prefers = (F.size("genres") > 0) | (F.size("tags") > 0)
    liked = preference_vectors(contexts.where(prefers), model.features.idf).withColumnsRenamed({"numbers": "liked_numbers", "weights": "liked_weights"})
    asked = contexts.select("context_id", "top_k", (F.size("selected") > 0).alias("picks"), prefers.alias("prefers"), F.col("platforms").alias("wanted"), F.col("selected").alias("picked"))
    rows = asked.join(liked, "context_id", "left").where(~F.col("prefers") | F.col("liked_numbers").isNotNull())
    if extra is not None:
        rows = rows.join(extra, "context_id", "left")
    rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in MIXED if f.name not in rows.columns})
    lists = ("wanted", "picked", "excluded", "played")
    return written(rows.select("context_id", *[none(f.name) if f.name in lists else F.col(f.name).cast(f.dataType) for f in MIXED]), "queries")


def alike(rows: DataFrame, key: str) -> DataFrame:
    """(key, first): for each row the least key of those that are equal to it in all other columns,
    as a written table. Lists count as equal only in the same order."""
    shape = F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c != key))), 256)
    shapes = written(rows.select(key, shape.alias("shape")), "shapes")
    return written(shapes.join(shapes.groupBy("shape").agg(F.min(key).alias("first")), "shape").select(key, "first"), "alike")


def firsts(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The rows that stand for all that are alike."""
    return rows.join(members.where(F.col(key) == F.col("first")).select(key), key, "left_semi")


def for_all(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The rows of each first one for every member."""
    return rows.withColumnRenamed(key, "first").join(members, "first").select(key, *[c for c in rows.columns if c != key])


def score_candidates(contexts: DataFrame, model: Model, config: RankingConfig = RANKING) -> DataFrame:
    """Every candidate of every context: (context_id, slug, content_units, platform_units,
    popularity_units, base_units), without picked items and those of no content units."""
    return _base(best_items(queries_of(contexts, model), packed_items(model), "context_id", Policy(config, cut=False), model.features.vectors))


def best_candidates(contexts: DataFrame, model: Model, config: RankingConfig = RANKING, near: bool = False) -> DataFrame:
    """The candidates that can be among a context's top_k, as of ``score_candidates``. Contexts that
    want the same are scored once. With ``near`` rows have the products (slug, product) with the
    picked items."""
    members = alike(contexts.select("context_id", "selected", "genres", "tags", "platforms", "top_k"), "context_id")
    asked = firsts(contexts, members, "context_id")
    best = _base(best_items(queries_of(asked, model), packed_items(model), "context_id", Policy(config, near=near), model.features.vectors))
    return for_all(top_ranked(best, asked).drop("rank"), members, "context_id")


def _base(rows: DataFrame) -> DataFrame:
    more = [c for c in rows.columns if c == "near"]
    return rows.where("slug is not null").select("context_id", "slug", "content_units", "platform_units", "popularity_units", "base_units", *more)


def top_ranked(candidates: DataFrame, contexts: DataFrame, key: str = "context_id", order: tuple[str, ...] = ("base_units", "content_units", "popularity_units"), most: int = RANKING.most_top_k) -> DataFrame:
    """Candidates with their rank, up to each context's top_k; slugs break ties."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order], F.asc("slug")))
    # the constant bound lets Spark keep only so many rows of a context before the shuffle
    ranked = candidates.withColumn("rank", rank).where(F.col("rank") <= most)
    return ranked.join(contexts.select(key, "top_k"), key).where(F.col("rank") <= F.col("top_k")).drop("top_k")


def explain(similar: Column, genres: Column, tags: Column, platforms: Column, popularity_units: Column, config: RankingConfig = RANKING) -> Column:
    """The reasons in their order; the first is the summary."""

    def named(values: Column, field: str, most: int) -> Column:
        return F.array_join(F.transform(F.slice(values, 1, most), lambda v: v[field]), ", ")

    def when_any(values: Column, lead: str, field: str, most: int) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(lead), named(values, field, most), F.lit(".")))

    # The sentences of an explanation.
    reasons = F.array_compact(
        F.array(
            when_any(similar, "Its content profile is similar to ", "title", 2),
            when_any(genres, "It matches your preferred genres: ", "name", 3),
            when_any(tags, "It matches your preferred tags: ", "name", 3),
            when_any(platforms, "It is available on preferred platforms: ", "name", 3),
            F.when(popularity_units >= config.popular_from, "Its catalog rating and popularity signals provide supporting evidence."),
        )
    )
    return F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("Its catalog content is related to the context you selected.")))


def with_evidence(ranked: DataFrame, contexts: DataFrame, model: Model, config: RankingConfig = RANKING) -> DataFrame:
    """Ranked rows with components, matches, similar picked items, reasons and summary. Similarities
    of pairs are computed for ranked items only, unless ranked rows have brought them as ``near``."""
    picked = contexts.select("context_id", F.explode("selected").alias("picked"))
    pairs = written(ranked.select("context_id", "slug").join(picked, "context_id"), "evidence-pairs")
    own = model.features.vectors
    other = own.select(F.col("slug").alias("picked"), F.col("numbers").alias("other_numbers"), F.col("weights").alias("other_weights"))
    if "near" in ranked.columns:
        met = ranked.select("slug", F.explode("near").alias("n")).select("slug", F.col("n.slug").alias("picked"), F.col("n.product").alias("product"))
        met = met.groupBy("slug", "picked").agg(F.max("product").alias("product"))
        met, ranked = met.join(own.select("slug"), "slug").join(other.select("picked"), "picked"), ranked.drop("near")
    else:
        # a pair of items is multiplied once, however many contexts show it
        met = products(pairs.select("slug", "picked").distinct().join(own, "slug").join(other, "picked"))
    close = pairs.join(met.select("slug", "picked", quantize(F.col("product")).alias("units")).where("units > 0"), ["slug", "picked"])
    titles = model.items.select(F.col("slug").alias("picked"), "title")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("units")).alias("order"), F.col("picked").alias("slug"), "title", "units"))), 1, config.most_similar)
    similar = close.join(titles, "picked").groupBy("context_id", "slug").agg(F.transform(best, lambda x: F.struct(x["slug"], x["title"], x["units"])).alias("similar"))
    nested = model.items.select("slug", "genres", "tags", "platforms")
    wanted = contexts.select("context_id", *[F.col(k).alias(f"want_{k}") for k in ("genres", "tags", "platforms")])
    rows = ranked.join(similar, ["context_id", "slug"], "left").join(nested, "slug").join(wanted, "context_id")
    rows = rows.withColumn("similar", F.coalesce("similar", F.array().cast("array<struct<slug:string,title:string,units:bigint>>")))
    match = lambda k: F.filter(F.array_sort(k), lambda v: F.array_contains(F.col(f"want_{k}"), v["slug"]))
    rows = rows.withColumns({"matching_genres": match("genres"), "matching_tags": match("tags"), "matching_platforms": match("platforms")})

    def part(name: str, weight: int) -> Column:
        raw = F.col(f"{name}_units")
        fields = {"raw_units": raw, "weight_units": F.lit(weight).cast("long"), "contribution_units": contribution(raw, weight)}
        return F.struct(F.lit(name).alias("name"), *[value.alias(field) for field, value in fields.items()])

    weights_of = {"content": config.content_weight, "platform": config.platform_weight, "popularity": config.popularity_weight}
    parts = F.array(*[part(name, weight) for name, weight in weights_of.items()])
    reasons = explain(F.col("similar"), F.col("matching_genres"), F.col("matching_tags"), F.col("matching_platforms"), F.col("popularity_units"), config)
    rows = rows.withColumns({"components": parts, "reasons": reasons})
    return rows.withColumn("summary", F.element_at("reasons", 1)).drop("genres", "tags", "platforms", "want_genres", "want_tags", "want_platforms")


def recommend(contexts: DataFrame, model: Model, config: RankingConfig = RANKING) -> DataFrame:
    """The ranked rows of all contexts; a context without any has one row with a reason."""
    ranked = top_ranked(best_candidates(contexts, model, config), contexts)
    reason = F.when(F.col("slug").isNull(), "no_content_support").otherwise("recommendations")
    return contexts.select("context_id").join(ranked, "context_id", "left").withColumn("reason", reason)


def recommend_for_ids(requests: DataFrame, model: Model, config: RankingConfig = RANKING) -> DataFrame:
    """Ranked rows with display columns for requests (context_id, item_ids, genres, tags, platforms,
    top_k) that name items by id. Nothing is stored. A request with an unknown id has one row, of
    reason unknown_items. ``model.items`` has the ids."""
    asked = requests.select("context_id", F.explode("item_ids").alias("id"))
    slugs = asked.join(model.items.select("id", "slug"), "id", "left")
    named = slugs.groupBy("context_id").agg(F.array_sort(F.collect_set("slug")).alias("selected"), F.bool_or(F.col("slug").isNull()).alias("lost"))
    rows = written(requests.join(named, "context_id", "left").withColumn("selected", F.coalesce("selected", F.array().cast("array<string>"))), "requests")
    refused = F.coalesce("lost", F.lit(False))
    ranked = recommend(rows.where(~refused).drop("lost", "item_ids"), model, config)
    shown = model.items.select("slug", "id", "title", "developer", F.col("average_rating").cast("double").alias("average_rating"), "rating_count")
    out = ranked.join(shown, "slug", "left")
    return out.unionByName(rows.where(refused).select("context_id", F.lit("unknown_items").alias("reason")), allowMissingColumns=True)
