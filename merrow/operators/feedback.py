"""Feedback: supersession, active state, state changes, positive sources, feedback-adjusted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merrow.config import FEEDBACK, RANKING, SCALE, STATE_TYPES, FeedbackConfig, RankingConfig
from merrow.functions.fixedpoint import contribution
from merrow.operators.ranking import Model, alike, firsts, for_all, packed_items, queries_of, top_ranked
from merrow.operators.tiles import Policy, best_items
from merrow.scratch import written


def dimension() -> Column:
    """What at most one active row may exist of: likes and dislikes share one."""
    return F.when(F.col("interaction_type").isin("liked", "disliked"), "reaction").otherwise(F.col("interaction_type"))


def supersede(log: DataFrame) -> DataFrame:
    """The log with superseded_at: every state row but the newest (by time, then id) of its user,
    item and dimension ends when the next newer one occurred. Views are never superseded."""
    newest = Window.partitionBy("user_id", "item_id", "dimension").orderBy(F.desc("occurred_at"), F.desc("id"))
    rows = log.drop("superseded_at").withColumn("dimension", dimension())
    newer = F.lag("occurred_at").over(newest)
    state = rows.where("interaction_type <> 'viewed'").withColumn("superseded_at", F.when(newer.isNotNull(), F.greatest("occurred_at", newer)))
    views = rows.where("interaction_type = 'viewed'").withColumn("superseded_at", F.lit(None).cast(rows.schema["occurred_at"].dataType))
    return state.unionByName(views).drop("dimension")


def active_rows(log: DataFrame) -> DataFrame:
    """State rows that hold now."""
    return log.where(F.col("superseded_at").isNull() & F.col("interaction_type").isin(*STATE_TYPES))


def feedback_state(active: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One row for each user and item: reaction, played, wishlisted, rating, their times and the
    latest one; with the item's slug if ``items`` (id, slug) is given."""
    kind = F.col("interaction_type")
    reaction = kind.isin("liked", "disliked")
    at = lambda test: F.max(F.when(test, F.col("occurred_at")))
    out = active.groupBy("user_id", "item_id").agg(
        F.max(F.when(reaction, kind)).alias("reaction"),
        at(reaction).alias("reaction_at"),
        F.bool_or(kind == "played").alias("played"),
        F.bool_or(kind == "wishlisted").alias("wishlisted"),
        F.max(F.when(kind == "rated", F.col("value"))).alias("rating"),
        at(kind == "rated").alias("rating_at"),
        F.max("occurred_at").alias("latest_at"),
    )
    return out.join(items.select(F.col("id").alias("item_id"), "slug"), "item_id") if items is not None else out


def feedback_page(active: DataFrame, items: DataFrame, user_id: int, page: int, size: int) -> tuple[DataFrame, DataFrame]:
    """A page of a user's items with feedback, latest first, and the total."""
    own = feedback_state(active.where(F.col("user_id") == user_id), items)
    return own.orderBy(F.desc("latest_at"), "item_id").offset((page - 1) * size).limit(size), own.agg(F.count("*").alias("total"))


def feedback_pages(active: DataFrame, items: DataFrame, page: int, size: int) -> DataFrame:
    """A page of every user's items with feedback, latest first, each row with the user's total."""
    rows = feedback_state(active, items)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("latest_at"), "item_id"))
    paged = rows.withColumn("place", place).where(F.col("place").between((page - 1) * size + 1, page * size))
    return paged.join(rows.groupBy("user_id").agg(F.count("*").alias("total")), "user_id")


def replace_state(log: DataFrame, desired: DataFrame, now: Column) -> DataFrame:
    """The log after setting the state of the pairs named in ``desired``, with a column ``change``
    (kept, closed, inserted). Rows without it are not touched.

    ``desired`` has (user_id, item_id, interaction_type, value); a pair with a null type asks for no
    state at all. Active rows that aren't wanted, or with another value, are closed at ``now``;
    wanted rows that aren't there are inserted with null ids; equal ones stay. Applying the same
    request again changes nothing."""
    keys = ["user_id", "item_id"]
    touched = desired.select(*keys).distinct().withColumn("touched", F.lit(True))
    value = F.col("value").cast(log.schema["value"].dataType)
    wanted = desired.where("interaction_type is not null")
    wanted = wanted.select(*keys, "interaction_type", value.alias("want"), F.lit(True).alias("wanted"))
    is_active = F.col("superseded_at").isNull() & F.col("interaction_type").isin(*STATE_TYPES)
    current = log.join(touched, keys, "left").withColumn("open", F.coalesce("touched", F.lit(False)) & is_active)
    marked = current.join(wanted, [*keys, "interaction_type"], "left")
    same = F.coalesce("wanted", F.lit(False)) & F.col("want").eqNullSafe(F.col("value"))
    close = F.col("open") & ~same
    ended = F.when(close, now).otherwise(F.col("superseded_at")).alias("superseded_at")
    columns = [ended if c == "superseded_at" else F.col(c) for c in log.columns]
    kept = marked.select(*columns, F.when(close, "closed").otherwise("kept").alias("change"))
    there = marked.where(F.col("open") & same).select(*keys, "interaction_type")
    new = wanted.join(there, [*keys, "interaction_type"], "left_anti")
    made = {"value": F.col("want"), "occurred_at": now, "superseded_at": F.lit(None)}
    types = {f.name: f.dataType for f in log.schema}
    known = {c: F.col(c) for c in new.columns} | made
    columns = [known.get(c, F.lit(None)).cast(types[c]).alias(c) for c in log.columns]
    inserted = new.select(*columns, F.lit("inserted").alias("change"))
    return kept.unionByName(inserted)


def positive_sources(feedback: DataFrame, config: FeedbackConfig = FEEDBACK) -> DataFrame:
    """(user_id, slug, kind, occurred_at, place): up to five newest likes, and ratings of at least
    seven where there is no reaction; slugs break ties of time."""
    liked = F.col("reaction") == "liked"
    rated = F.col("reaction").isNull() & (F.col("rating") >= config.positive_rating)
    kind = F.when(liked, "liked").when(rated, "rating")
    time = F.when(liked, F.col("reaction_at")).otherwise(F.col("rating_at"))
    rows = feedback.select("user_id", "slug", kind.alias("kind"), time.alias("occurred_at"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("occurred_at"), "slug"))
    return rows.where("kind is not null").withColumn("place", place).where(F.col("place") <= config.most_sources)


def effective_contexts(contexts: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contexts (user_id, selected, ...) without disliked picks, and those that thereby lose all signal."""
    disliked = feedback.where("reaction = 'disliked'").groupBy("user_id").agg(F.collect_set("slug").alias("disliked"))
    out = contexts.join(disliked, "user_id", "left").withColumn("selected", F.array_except("selected", F.coalesce("disliked", F.array().cast("array<string>")))).drop("disliked")
    empty = (F.size("selected") == 0) & (F.size("genres") == 0) & (F.size("tags") == 0)
    return out.where(~empty), out.where(empty).select("user_id", F.lit("insufficient_context").alias("reason"))


def _wishes(contexts: DataFrame, feedback: DataFrame, config: FeedbackConfig) -> DataFrame:
    """The users' contexts (user_id, without disliked picks) with the sorted slugs of what they liked
    (``sources``, null for none), of what may not be ranked, and of what they played."""
    usable, _ = effective_contexts(contexts, feedback)
    sources = positive_sources(feedback, config).select("user_id", "slug")
    barred = feedback.where("reaction = 'disliked'").select("user_id", "slug").unionByName(sources)
    out = usable.select("user_id", "selected", "genres", "tags", "platforms", "top_k")
    for rows, name in ((sources, "sources"), (barred, "excluded"), (feedback.where("played"), "played")):
        out = out.join(rows.groupBy("user_id").agg(F.array_sort(F.collect_set("slug")).alias(name)), "user_id", "left")
    return written(out, "wishes")


def _queries_of_wishes(wishes: DataFrame, model: Model) -> DataFrame:
    extra = wishes.select(F.col("user_id").alias("context_id"), "sources", "excluded", "played")
    return queries_of(wishes.withColumn("context_id", F.col("user_id")), model, extra).withColumnRenamed("context_id", "user_id")


def with_adjustments(rows: DataFrame, config: FeedbackConfig = FEEDBACK) -> DataFrame:
    """Scored rows with what became of their base units, step by step."""
    with_profile, is_played = F.col("has_profile"), F.col("is_played")
    weights = {
        "affinity_units": F.when(with_profile, F.col("affinity_units")).otherwise(F.lit(0)),
        "base_weight": F.when(with_profile, config.base_weight).otherwise(SCALE),
        "affinity_weight": F.when(with_profile, config.affinity_weight).otherwise(0),
        "played_factor": F.when(is_played, config.played_factor).otherwise(SCALE),
    }
    rows = rows.withColumns({name: value.cast("long") for name, value in weights.items()})
    parts = {f"{x}_contribution": contribution(F.col(f"{x}_units"), F.col(f"{x}_weight")) for x in ("base", "affinity")}
    rows = rows.withColumns(parts)
    rows = rows.withColumn("pre_played_units", F.col("base_contribution") + F.col("affinity_contribution"))
    rows = rows.withColumn("final_units", contribution(F.col("pre_played_units"), F.col("played_factor")))
    reasons = F.array_compact(F.array(F.when(with_profile, "feedback_affinity"), F.when(is_played, "played_adjustment")))
    rows = rows.withColumns({"played_delta_units": F.col("final_units") - F.col("pre_played_units"), "adjustments": reasons})
    return rows.drop("has_profile", "is_played")


def feedback_candidates(contexts: DataFrame, feedback: DataFrame, model: Model, config: FeedbackConfig = FEEDBACK, ranking: RankingConfig = RANKING) -> DataFrame:
    """All eligible candidates of the users with their adjusted units."""
    queries = _queries_of_wishes(_wishes(contexts, feedback, config), model)
    rows = best_items(queries, packed_items(model), "user_id", Policy(ranking, config, cut=False), model.features.vectors)
    return with_adjustments(rows.where("slug is not null"), config)


def feedback_recommend(contexts: DataFrame, feedback: DataFrame, model: Model, config: FeedbackConfig = FEEDBACK, ranking: RankingConfig = RANKING) -> DataFrame:
    """Ranked rows of all users under their feedback; a user without any has one row with a reason
    (no_content_support, no_eligible_candidates or insufficient_context). Items are passed once:
    base and affinity are products of one pass, which also tells who has support at all. Users
    whose contexts and feedback ask for the same are scored once."""
    order = ("final_units", "pre_played_units", "base_units", "affinity_units", "content_units", "popularity_units")
    wishes = _wishes(contexts, feedback, config)
    members = alike(wishes, "user_id")
    asked = firsts(wishes, members, "user_id")
    queries = _queries_of_wishes(asked, model)
    best = written(best_items(queries, packed_items(model), "user_id", Policy(ranking, config), model.features.vectors), "best")
    candidates = with_adjustments(best.where("slug is not null"), config)
    ranked = for_all(top_ranked(candidates, asked, "user_id", order, ranking.most_top_k), members, "user_id")
    _, lost = effective_contexts(contexts, feedback)
    supported = for_all(best.where("slug is null").select("user_id").distinct().withColumn("supported", F.lit(True)), members, "user_id")
    out = contexts.select("user_id").join(ranked, "user_id", "left").join(supported, "user_id", "left").join(lost, "user_id", "left")
    reason = F.when(F.col("slug").isNotNull(), "recommendations").when(F.col("reason").isNotNull(), F.col("reason"))
    reason = reason.when(F.col("supported"), "no_eligible_candidates").otherwise("no_content_support")
    return out.withColumn("reason", reason).drop("supported")
