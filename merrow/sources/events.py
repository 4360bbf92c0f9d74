"""Recommendation events: one for each generation, bounded, appended by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merrow.config import ModelIdentity
from merrow.functions.identity import canonical_json, state_fingerprint
from merrow.operators.feedback import positive_sources
from merrow.operators.quality import SLUG
from merrow.sources.files import exists

# The bounds of an event's payload.
MOST_ITEMS, MOST_CONTEXT_BYTES, MOST_RESULT_BYTES, MOST_TOP_K = 20, 8_192, 32_768, 20
MOST_OF_LIST = {"selected_game_slugs": 25, "preferred_genres": 20, "preferred_tags": 25, "preferred_platforms": 10, "positive_source_slugs": 5}
MOST_OF_COUNT = {"disliked_count": 100_000, "played_count": 100_000, "positive_source_count": 5}
MOST_SLUG = 220


def effective_states(feedback: DataFrame) -> DataFrame:
    """(user_id, fingerprint, disliked_count, played_count, positive_source_count, positive_sources)."""
    sources = positive_sources(feedback).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("place", "slug", "kind"))).alias("s"))
    those = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("slug"))))
    sets = feedback.groupBy("user_id").agg(those(F.col("reaction") == "disliked").alias("disliked"), those(F.col("played")).alias("played"))
    known = F.coalesce("s", F.array().cast("array<struct<place:int,slug:string,kind:string>>"))
    both = sets.join(sources, "user_id", "left").withColumn("sources", F.transform(known, lambda x: F.struct(x["kind"], x["slug"])))
    return both.select(
        "user_id",
        state_fingerprint(F.col("disliked"), F.col("played"), F.col("sources")).alias("fingerprint"),
        F.size("disliked").alias("disliked_count"),
        F.size("played").alias("played_count"),
        F.size("sources").alias("positive_source_count"),
        F.transform("sources", lambda s: s["slug"]).alias("positive_sources"),
    )


def generation_events(ranked: DataFrame, contexts: DataFrame, feedback: DataFrame, generated_at: Column, data_fingerprint: Column, generation_id: Column | None = None, policy: tuple[str, str] = ("merrow-feedback", "1.0.0"), identity: ModelIdentity | None = None) -> DataFrame:
    """One event for each user with ranked rows, with the model's name and version. Ids are random unless given; write the events
    before reading them again."""
    per_item = F.struct(F.col("affinity_units"), F.col("base_units"), F.col("final_units"), F.col("played_delta_units"), F.col("rank"), F.col("slug"))
    results = ranked.where("slug is not null").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", per_item.alias("r")))).alias("r"))
    rows = results.join(contexts, "user_id").join(effective_states(feedback), "user_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    none = F.array().cast("array<string>")
    # who has no feedback has the fingerprint of an empty state
    empty_state = state_fingerprint(none, none, F.array().cast("array<struct<kind:string,slug:string>>"))
    context = canonical_json(
        disliked_count=zero("disliked_count"),
        effective_state_fingerprint=F.coalesce("fingerprint", empty_state),
        played_count=zero("played_count"),
        positive_source_count=zero("positive_source_count"),
        positive_source_slugs=F.coalesce("positive_sources", none),
        preferred_genres=F.col("genres"),
        preferred_platforms=F.col("platforms"),
        preferred_tags=F.col("tags"),
        selected_game_slugs=F.col("selected"),
        top_k=F.col("top_k"),
    )
    result = F.to_json(F.transform("r", lambda x: x["r"]))
    return rows.select(
        (generation_id if generation_id is not None else F.replace(F.uuid(), F.lit("-"), F.lit(""))).alias("generation_id"),
        "user_id",
        F.lit("stage-4-v1").alias("event_schema_version"),
        F.lit((identity or ModelIdentity()).name).alias("model_name"),
        F.lit((identity or ModelIdentity()).version).alias("model_version"),
        data_fingerprint.alias("data_fingerprint"),
        F.lit(policy[0]).alias("ranking_policy_name"),
        F.lit(policy[1]).alias("ranking_policy_version"),
        generated_at.alias("generated_at"),
        context.alias("request_context"),
        result.alias("result_summary"),
    )


def payload_problems(events: DataFrame) -> DataFrame:
    """(generation_id, reason) of events out of bounds."""
    fields = ", ".join([*(f"{k} array<string>" for k in MOST_OF_LIST), *(f"{k} bigint" for k in MOST_OF_COUNT), "top_k bigint", "effective_state_fingerprint string"])
    units = ("base_units", "final_units", "affinity_units")
    items = F.from_json("result_summary", f"array<struct<slug: string, rank: bigint, played_delta_units: bigint, {', '.join(f'{u}: bigint' for u in units)}>>")
    rows = events.select("generation_id", "request_context", "result_summary", F.from_json("request_context", fields).alias("c"), items.alias("items"))

    def no_slug(x: Column) -> Column:
        return ~F.coalesce(x.rlike(SLUG) & (F.length(x) <= MOST_SLUG), F.lit(False))

    def outside(x: Column, low: int, high: int) -> Column:
        return ~F.coalesce(x.between(low, high), F.lit(False))

    def any_item(test) -> Column:
        return F.exists("items", test)

    out_of_range = any_item(lambda r: outside(r["base_units"], 0, 1_000_000) | outside(r["final_units"], 0, 1_000_000) | outside(r["affinity_units"], 0, 1_000_000))
    lists = [F.col(f"c.{k}") for k in MOST_OF_LIST]
    found = {
        "items_too_many": F.size("items") > MOST_ITEMS,
        "context_too_long": F.octet_length("request_context") > MOST_CONTEXT_BYTES,
        "result_too_long": F.octet_length("result_summary") > MOST_RESULT_BYTES,
        "units_out_of_range": out_of_range,
        "rank_out_of_range": any_item(lambda r: outside(r["rank"], 1, MOST_ITEMS)),
        "played_delta_out_of_range": any_item(lambda r: outside(r["played_delta_units"], -1_000_000, 0)),
        "top_k_out_of_range": outside(F.col("c.top_k"), 1, MOST_TOP_K),
        "slug_format": any_item(lambda r: no_slug(r["slug"])) | F.exists(F.flatten(F.array(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])), no_slug),
        "fingerprint_format": ~F.coalesce(F.col("c.effective_state_fingerprint").rlike("^[0-9a-f]{64}$"), F.lit(False)),
    }
    found |= {f"{k}_too_long": F.size(f"c.{k}") > most for k, most in MOST_OF_LIST.items()}
    found |= {f"{k}_out_of_range": outside(F.col(f"c.{k}"), 0, most) for k, most in MOST_OF_COUNT.items()}
    reasons = F.array_compact(F.array(*[F.when(test, name) for name, test in found.items()]))
    return rows.select("generation_id", F.explode(reasons).alias("reason"))


def refusals(contexts: DataFrame, stale: DataFrame) -> DataFrame:
    """(user_id, reason, references) of users who aren't ranked because they saved what isn't there
    any more; ``stale`` is of ``preferences.stale_references``."""
    own = stale.groupBy("user_id").agg(F.array_sort(F.collect_list("reference")).alias("references"))
    return contexts.select("user_id").join(own, "user_id").select("user_id", F.lit("stale_references").alias("reason"), "references")


def append_events(events: DataFrame, path: str, batch: str) -> None:
    """Append the events of a generation batch, in folders by date and batch.

    A batch is named by its maker and has the same events whenever it is made again: running it
    twice, or again after it failed half-way, replaces its own folders and no others. An event
    whose generation_id another batch has isn't appended again, nor one that stands twice in the
    batch."""
    spark = events.sparkSession
    rows = events.dropDuplicates(["generation_id"]).withColumns({"event_date": F.col("generated_at").cast("date"), "batch": F.lit(batch)})
    if exists(spark, path):
        others = spark.read.schema(rows.select("generation_id", "batch").schema).parquet(path).where(F.col("batch") != batch)
        rows = rows.join(others.select("generation_id"), "generation_id", "left_anti")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date", "batch").parquet(path)
