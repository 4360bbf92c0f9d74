"""The registered queries over the views of the driver tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merrow.arrow import spread
from merrow.functions import fixedpoint, identity, text
from merrow.operators import catalog, features, feedback, lifecycle, packed, popularity, preferences, quality, ranking, row_jobs, search
from merrow.plans.sql import ORACLE_SQL as ORACLE_SQL
from merrow.scratch import discard, run_folder, written
from merrow.sources import events as event_log
from merrow.sources import hash_tree, model_store
from merrow.sources.buckets import store_bucketed
from merrow.sources.layout import Layout, lay_out, plain
from merrow.sources.views import CUTOFF, NOW, Views


def _at(time: str):
    return F.to_timestamp_ntz(F.lit(time))


def _page(sort: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, totals = catalog.catalog_page(Views(spark, sf_dir).items(), sort, page=2, size=20)
        rows = rows.select("id", "slug", "average_rating", "rating_count", "release_date", "popularity_score")
        return rows.crossJoin(F.broadcast(totals))

    return run


def catalog_deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, a middle and the last page of every sort, each as a range of the sort's index."""
    items, out = written(Views(spark, sf_dir).items().drop("description"), "items"), None
    last = max(1, -(-items.count() // 20))
    for sort in catalog.SORTS:
        index = catalog.page_index(items, catalog.sort_columns(sort))
        for page in sorted({1, (last + 1) // 2, last}):
            rows = catalog.indexed_page(index, page, 20).select(F.lit(sort).alias("sort"), F.lit(page).cast("long").alias("page"), "place", "id")
            out = rows if out is None else out.unionByName(rows)
    return out


def catalog_search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of a few searches; the wildcards of SQL are ordinary characters."""
    items = Views(spark, sf_dir).part_items()
    out = None
    for q in ("red", "WIDGET", "%", "_", "\\"):
        row = catalog.totals(catalog.search_title(items, q), 20).withColumn("q", F.lit(q))
        out = row if out is None else out.unionByName(row)
    return out


def catalog_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same totals through the trigrams of titles."""
    items = written(Views(spark, sf_dir).part_items(), "items")
    index, out = search.index_titles(items), None
    for q in ("red", "WIDGET", "%", "_", "\\"):
        row = catalog.totals(search.search_indexed(items, index, q), 20).withColumn("q", F.lit(q))
        out = row if out is None else out.unionByName(row)
    return out


def catalog_filter_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    rows, _ = catalog.catalog_page(v.part_items(), "popularity", 1, 50, query="r", genre=(v.part_genres(), "economy"), tag=(v.part_tags(), "red"), platform=(v.part_platforms(), "n3"))
    return rows.select("id", "title", "popularity_score")


def catalog_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    rows = catalog.nest(v.part_items(), v.part_genres(), v.part_tags(), v.part_platforms())
    names = lambda k: F.array_join(F.transform(k, lambda x: x["name"]), ",").alias(k)
    return rows.select("id", names("genres"), names("tags"), names("platforms"))


def catalog_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look-up of one item that its SQL names; ``catalog_items`` looks up all."""
    v = Views(spark, sf_dir)
    row = catalog.item_by_id(v.part_items(), 7, v.part_genres(), v.part_tags(), v.part_platforms())
    return row.select("id", "title", F.size("genres").alias("genres"), F.size("tags").alias("tags"), F.size("platforms").alias("platforms"))


def catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that orders or the parts themselves name."""
    v = Views(spark, sf_dir)
    asked = v.part_items().select("id").unionByName(v.table("lineitem").select(F.col("l_partkey").alias("id")))
    rows = catalog.items_by_ids(v.part_items(), asked, v.part_genres(), v.part_tags(), v.part_platforms())
    return rows.select("id", "title", F.size("genres").alias("genres"), F.size("tags").alias("tags"), F.size("platforms").alias("platforms"))


def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return _scanned(v.part_items(), v.part_genres(), v.part_tags(), v.part_platforms())


def catalog_scan_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from tables bucketed by id, which the scan joins where they are."""
    v = Views(spark, sf_dir)
    mark = uuid.uuid4().hex
    stored = lambda rows, name: store_bucketed(rows, f"{name}_{mark}", f"{run_folder(spark)}/{name}-{mark}", "id", 16)
    return _scanned(stored(v.part_items(), "items"), stored(v.part_genres(), "genres"), stored(v.part_tags(), "tags"), stored(v.part_platforms(), "platforms"))


def _scanned(*tables: DataFrame) -> DataFrame:
    rows = catalog.catalog_scan(*tables)
    slugs = lambda k: F.array_join(F.transform(k, lambda x: x["slug"]), ",").alias(k)
    return rows.select("slug", "popularity_score", slugs("genres"), slugs("tags"), slugs("platforms"))


def taxonomy_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    one = lambda family, bridge: catalog.taxonomy_list(bridge).select(F.lit(family).alias("family"), "slug", "name", "items")
    return one("genre", v.part_genres()).unionByName(one("tag", v.part_tags())).unionByName(one("platform", v.part_platforms()))


def resolve_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids that interactions ask for, with their slugs or as unknown."""
    v = Views(spark, sf_dir)
    asked = v.interactions().where("item_id is not null").select(F.col("user_id").alias("request_id"), F.col("id").alias("place"), (F.col("item_id") * 40).alias("id"))
    known, unknown = catalog.resolve_ids(asked, v.items())
    return known.select("request_id", "place", "id", "slug").unionByName(unknown.select("request_id", "place", "id", F.lit(None).cast("string").alias("slug")))


def popularity_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = popularity.popularity(Views(spark, sf_dir).items())
    return rows.select("slug", fixedpoint.quantize(F.col("popularity")).alias("popularity_units"))


def _ascii_documents(v: Views) -> DataFrame:
    words = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)")), " ")
    return v.table("documents").select(F.concat(F.lit("doc-"), "doc_id").alias("slug"), words.alias("document"))


def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packed.packed_counts(spread(_ascii_documents(Views(spark, sf_dir))))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)
    rows = rows.select("slug", F.size("counts").cast("long").alias("terms"), total.alias("occurrences"), F.array_max("counts").alias("most"))
    return rows.where("terms > 0")


def document_frequency_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _ascii_documents(Views(spark, sf_dir))
    idf = features.inverse_frequencies(packed.document_frequencies(spread(docs)), docs.agg(F.count("*").alias("n")))
    return idf.select("term", "df", F.round("idf", 9).alias("idf"))


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = written(spread(_ascii_documents(Views(spark, sf_dir))), "documents")
    return features.term_weights(docs).select("slug", "term", F.round("weight", 6).alias("weight"))


def content_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest and size of each item's weighted document."""
    rows = Views(spark, sf_dir).nested_items().select("slug", text.content_document().alias("document"))
    return rows.select("slug", F.length("document").alias("characters"), F.size(text.terms(F.col("document"))).alias("terms"), F.sha2("document", 256).alias("sha256"))


def _known(v: Views) -> DataFrame:
    items = v.items().select(F.lit("game").alias("family"), "slug")
    nested = v.nested_items()
    for family, column in (("genre", "genres"), ("tag", "tags"), ("platform", "platforms")):
        items = items.unionByName(nested.select(F.lit(family).alias("family"), F.explode(F.transform(column, lambda x: x["slug"])).alias("slug")).distinct())
    return items


def _contexts(v: Views) -> DataFrame:
    return written(preferences.contexts_of(preferences.without_stale(v.preferences(), _known(v)), v.top_k()), "contexts")


def _model(v: Views) -> ranking.Model:
    """All items with their whole descriptions."""
    return model_store.held(model_store.build(written(v.nested_items(), "items")))


def _feedback(v: Views) -> DataFrame:
    return written(feedback.feedback_state(feedback.active_rows(feedback.supersede(v.interactions())), v.items()), "feedback")


def content_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return ranking.recommend(_contexts(v), _model(v))


def recommend_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that name items by id, every fifth with an id that no item has."""
    v = Views(spark, sf_dir)
    ids = F.transform("selected", lambda s: F.substring(s, 5, 20).cast("long"))
    ids = F.when(F.col("user_id") % 5 == 0, F.concat(ids, F.array(F.lit(999_999_999).cast("long")))).otherwise(ids)
    rows = ranking.recommend_for_ids(_contexts(v).withColumn("item_ids", ids).drop("selected"), _model(v))
    return rows.select("context_id", "rank", "id", "title", "developer", "average_rating", "rating_count", "base_units", "reason")


def recommend_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    contexts, model = _contexts(v), _model(v)
    ranked = written(ranking.top_ranked(ranking.best_candidates(contexts, model, near=True), contexts), "ranked")
    rows = ranking.with_evidence(ranked, contexts, model)

    def listed(name: str, *fields: str) -> Column:
        return F.array_join(F.transform(name, lambda x: F.concat_ws(":", *[x[f] for f in fields])), ",").alias(name)

    shown = [listed("similar", "slug", "units"), *[listed(f"matching_{k}", "slug") for k in ("genres", "tags", "platforms")]]
    parts = listed("components", "name", "raw_units", "weight_units", "contribution_units")
    return rows.select("context_id", "rank", "slug", "base_units", *shown, parts, F.array_join("reasons", " ").alias("reasons"), "summary")


def context_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of contexts as they are saved, stale references included."""
    v = Views(spark, sf_dir)
    return ranking.context_problems(preferences.contexts_of(v.preferences(), v.top_k() * 3), v.items())


def active_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.feedback_state(feedback.active_rows(feedback.supersede(Views(spark, sf_dir).interactions())))


def feedback_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of the one user that its SQL names; ``feedback_pages_all`` has every user's."""
    v = Views(spark, sf_dir)
    rows, total = feedback.feedback_page(feedback.active_rows(feedback.supersede(v.interactions())), v.items(), 3, 1, 20)
    return rows.crossJoin(total).select("item_id", "slug", "reaction", "played", "wishlisted", "rating", "latest_at", "total")


def feedback_pages_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    rows = feedback.feedback_pages(feedback.active_rows(feedback.supersede(v.interactions())), v.items(), 1, 20)
    return rows.select("user_id", "place", "item_id", "slug", "reaction", "played", "wishlisted", "rating", "latest_at", "total")


def supersession_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.supersede(Views(spark, sf_dir).interactions()).select("id", "user_id", "item_id", "interaction_type", "superseded_at")


def _log_and_wanted(v: Views) -> tuple[DataFrame, DataFrame]:
    """The log up to a time, and the state that later rows ask for."""
    log = v.interactions()
    before = feedback.supersede(log.where(F.col("occurred_at") < _at(NOW)))
    wanted = log.where((F.col("occurred_at") >= _at(NOW)) & (F.col("interaction_type") != "viewed"))
    newest = feedback.active_rows(feedback.supersede(wanted)).select("user_id", "item_id", "interaction_type", "value")
    return before, newest


def replace_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after setting the wanted state."""
    before, wanted = _log_and_wanted(Views(spark, sf_dir))
    done = feedback.replace_state(before, wanted, _at(NOW))
    return done.groupBy("user_id", "change").agg(F.count("*").alias("rows"), F.count_if(F.col("superseded_at").isNull() & (F.col("interaction_type") != "viewed")).alias("active"))


def state_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and active rows of each user in the log after the wanted state was set in its table."""
    before, wanted = _log_and_wanted(Views(spark, sf_dir))
    log = _laid_out(before, "log", "user_id")
    row_jobs.replace_state(spark, log, wanted, _at(NOW))
    active = F.count_if(F.col("superseded_at").isNull() & (F.col("interaction_type") != "viewed")).alias("active")
    return plain(spark, log).groupBy("user_id").agg(F.count("*").alias("rows"), active)


def positive_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.positive_sources(_feedback(Views(spark, sf_dir)))


def feedback_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    rows = feedback.feedback_recommend(_contexts(v), _feedback(v), _model(v))
    return rows.withColumn("adjustments", F.array_join("adjustments", ","))


def preferences_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preferences.pivot_preferences(Views(spark, sf_dir).preferences())
    return rows.select("user_id", *[F.array_join(c, ",").alias(c) for c in ("selected", "genres", "tags", "platforms")])


def preferences_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third user replaces tags and platforms by one other platform."""
    saved = Views(spark, sf_dir).preferences()
    chosen = saved.where("user_id % 3 = 0").select("user_id").distinct()
    keep = saved.where("user_id % 3 = 0 and preference_type in ('game', 'genre')").select("user_id", "preference_type", "value")
    desired = keep.unionByName(chosen.select("user_id", F.lit("platform").alias("preference_type"), F.concat(F.lit("p"), F.col("user_id") % 5).alias("value")))
    return preferences.replace_preferences(saved, desired, chosen)


def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    asked = v.preferences().select(F.col("user_id").alias("request_id"), F.col("preference_type").alias("family"), F.col("value").alias("slug"))
    return catalog.unknown_values(asked, _known(v)).select("request_id", "family", "slug")


def stale_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return preferences.stale_references(v.preferences(), _known(v))


def _laid_out(rows: DataFrame, name: str, key: str, time: str | None = None, buckets: int = 16) -> Layout:
    """A table in this run's own folder, for a job to change in place."""
    layout = Layout(f"{run_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}", key, buckets, time)
    lay_out(rows, layout)
    return layout


def _parts_and_feed(v: Views) -> tuple[DataFrame, DataFrame]:
    """Parts, and a changed feed: new prices, other tags, some new parts; some not in it."""
    tags = v.part_tags().groupBy("id").agg(F.array_sort(F.collect_set("slug")).alias("tags"))
    old = v.part_items().join(tags, "id").withColumn("updated_at", _at(CUTOFF)).select("slug", "title", "popularity_score", "tags", "updated_at", "id")
    cheaper = F.when(F.col("id") % 5 == 0, F.col("popularity_score") - 1).otherwise(F.col("popularity_score")).cast("decimal(10,4)")
    feed = old.where("id % 4 <> 3").select("slug", "title", cheaper.alias("popularity_score"), F.when(F.col("id") % 7 == 0, F.array_append("tags", F.lit("sale"))).otherwise(F.reverse("tags")).alias("tags"))
    new = old.where("id % 10 = 0").select(F.concat("slug", F.lit("-b")).alias("slug"), "title", "popularity_score", "tags")
    return old, feed.unionByName(new)


def upsert_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts merged with the feed."""
    old, feed = _parts_and_feed(Views(spark, sf_dir))
    merged = lifecycle.upsert_items(old, feed, _at(NOW))
    return merged.select("slug", "title", "popularity_score", F.array_join(F.array_sort("tags"), ",").alias("tags"), "updated_at", "outcome")


def upsert_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of parts after the feed was merged into the buckets that it changes."""
    old, feed = _parts_and_feed(Views(spark, sf_dir))
    parts = _laid_out(old, "parts", "slug")
    row_jobs.upsert_items(spark, parts, feed, _at(NOW))
    return plain(spark, parts).select("slug", "title", "popularity_score", F.array_join(F.array_sort("tags"), ",").alias("tags"), "updated_at")


def _planted(rows: DataFrame, key: str, parts: int, changes: dict[int, dict]) -> DataFrame:
    """``rows`` with values set where the key leaves a remainder."""
    values: dict[str, Column] = {}
    for rest, columns in changes.items():
        for name, value in columns.items():
            kind = rows.schema[name].dataType
            values[name] = F.when(F.col(key) % parts == rest, F.lit(value).cast(kind)).otherwise(values.get(name, F.col(name)))
    return rows.withColumns(values)


#: Values that break each rule of items, by the remainder of the id.
WRONG_ITEMS = {0: {"slug": "Not A Slug"}, 1: {"slug": "a" * 221}, 2: {"title": "t" * 201}, 3: {"average_rating": 11}, 4: {"rating_count": -1}, 5: {"popularity_score": -1}}


def quality_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items split into clean and rejected ones: rows that break each rule, as observed while they
    were written, and the rows of both tables."""
    items = _planted(Views(spark, sf_dir).items(), "id", 13, WRONG_ITEMS)
    clean, rejected, counts = quality.split(items, quality.item_rules(), f"{run_folder(spark)}/split-{uuid.uuid4().hex}")
    by_rule = spark.createDataFrame([(rule, n) for rule, n in counts.items() if n and rule != "rows"], "rule string, n long")
    for name, rows in (("clean", clean), ("rejected", rejected)):
        by_rule = by_rule.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n"))
    return by_rule


def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of items, interactions, preferences and users, with rows that break each of them."""
    v = Views(spark, sf_dir)
    items = _planted(v.items(), "id", 13, WRONG_ITEMS)
    log = _planted(feedback.supersede(v.interactions()), "id", 50, {0: {"value": 11}})
    shared = (F.col("id") % 50 == 1) & (F.col("interaction_type") != "rated")
    early = F.when(F.col("id") % 50 == 2, F.col("occurred_at") - F.expr("interval 1 day")).otherwise(F.col("superseded_at"))
    log = log.withColumns({"interaction_type": F.when(shared, "shared").otherwise(F.col("interaction_type")), "superseded_at": early})
    saved = v.preferences().withColumn("key", F.concat_ws(":", "user_id", "preference_type", "value"))
    tags = saved.where("preference_type = 'tag'")
    tags = _planted(tags, "user_id", 7, {0: {"preference_type": "mood"}, 1: {"value": ""}, 2: {"weight": 2}})
    users = v.users().withColumn("expires_at", F.when(F.col("id") % 9 == 0, F.col("consented_at")).otherwise(F.col("expires_at")))
    found = quality.violations(items, "items", "id", quality.item_rules())
    found = found.unionByName(quality.violations(log, "interactions", "id", quality.interaction_rules()))
    found = found.unionByName(quality.violations(saved.where("preference_type <> 'tag'").unionByName(tags), "preferences", "key", quality.preference_rules()))
    return found.unionByName(quality.violations(users, "users", "id", quality.user_rules()))


def unique_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    log = v.interactions().withColumn("dimension", feedback.dimension())
    active = quality.duplicates(log, "interactions", "one_active", ["user_id", "item_id", "dimension"], F.col("interaction_type") != "viewed")
    return active.unionByName(quality.duplicates(v.part_items(), "part_items", "title", ["title"]))


def fk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    shifted = v.interactions().withColumn("item_id", F.col("item_id") + F.when(F.col("id") % 20 == 0, 10_000_000).otherwise(0))
    found = quality.orphans(shifted, "interactions", "item_id", "item_id", v.items(), "id")
    return found.unionByName(quality.orphans(v.rec_events(), "rec_events", "user_id", "user_id", v.users(), "id"))


def feedback_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of feedback rows, with rows that break each of them."""
    state = active_feedback(spark, sf_dir)
    part = F.col("item_id") % 10
    reacted = F.col("reaction").isNotNull()
    empty = part == 4
    state = state.withColumns(
        {
            "rating": F.when(part == 0, F.col("rating") + 5).when(~empty, F.col("rating")),
            "reaction": F.when((part == 1) & reacted, "meh").when(~empty, F.col("reaction")),
            "reaction_at": F.when((part != 2) & ~empty, F.col("reaction_at")),
            "rating_at": F.when((part != 3) & ~empty, F.col("rating_at")),
            "played": F.col("played") & ~empty,
            "wishlisted": F.col("wishlisted") & ~empty,
        }
    )
    return quality.violations(state.withColumn("key", F.concat_ws(":", "user_id", "item_id")), "feedback", "key", quality.feedback_rules())


def catalog_canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = Views(spark, sf_dir).nested_items().withColumn("title", F.when(F.col("id") % 11 == 0, F.lit(" 　 ")).otherwise(F.concat(F.lit("  "), "title")))
    rows = quality.canonical_items(items)
    return rows.select("slug", "title", "developer", F.sha2("description", 256).alias("description_sha256"), "rejects")


def retention_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    return lifecycle.retention_preview(v.rec_events(), v.users(), _at(CUTOFF), _at(NOW), _at(NOW))


def retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Views(spark, sf_dir)
    left = lifecycle.retention_purge(v.rec_events(), v.users(), {"interactions": v.interactions(), "preferences": v.preferences()}, _at(CUTOFF), _at(NOW))
    return _rows_per_user(left)


def retention_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table, by user, after the purge of tables laid out by user, events by day too."""
    v = Views(spark, sf_dir)
    owned = {"interactions": v.interactions(), "preferences": v.preferences()}
    children = {name: _laid_out(rows, name, "user_id") for name, rows in owned.items()}
    users, events = _laid_out(v.users(), "users", "id"), _laid_out(v.rec_events(), "events", "user_id", "generated_at")
    row_jobs.purge(spark, events, users, children, datetime.fromisoformat(CUTOFF), _at(NOW))
    return _rows_per_user({name: plain(spark, layout) for name, layout in ({"users": users, "events": events} | children).items()})


def _rows_per_user(left: dict[str, DataFrame]) -> DataFrame:
    per_user = [rows.groupBy(F.col("id" if name == "users" else "user_id").alias("user_id")).agg(F.count("*").alias("rows")).withColumn("table", F.lit(name)) for name, rows in left.items()]
    out = per_user[0]
    for rows in per_user[1:]:
        out = out.unionByName(rows)
    return out


def revoke_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.revoke_cohort(Views(spark, sf_dir).users(), _at(CUTOFF), _at(NOW)).select("id", "revoked_at", "processed")


def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.session_status(Views(spark, sf_dir).users(), _at(NOW), "v1")


def legacy_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = Views(spark, sf_dir).users().withColumn("anonymous_key", F.concat(F.lit("key-"), "id"))
    return lifecycle.backfill_identities(users, _at(NOW)).select("id", "anonymous_token_digest", "revoked_at")


def event_log_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event for each user with ranked rows; users who saved what isn't there any more aren't
    ranked, and have a row that says so."""
    v = Views(spark, sf_dir)
    state, model, everyone = _feedback(v), _model(v), _contexts(v)
    refused = event_log.refusals(everyone, preferences.stale_references(v.preferences(), _known(v)))
    refused = written(refused.withColumn("references", F.array_join("references", ",")), "refused")
    contexts = written(everyone.join(refused, "user_id", "left_anti"), "contexts")
    ranked = feedback.feedback_recommend(contexts, state, model)
    contexts = contexts.crossJoin(F.broadcast(model_store.fingerprint(model.items).withColumnRenamed("fingerprint", "catalog")))
    made = F.concat(F.lit("gen-"), F.sha2(F.col("user_id").cast("string"), 256).substr(1, 24))
    rows = written(event_log.generation_events(ranked, contexts, state, _at(NOW), F.col("catalog"), made), "events")
    problems = event_log.payload_problems(rows).groupBy("generation_id").agg(F.count("*").alias("problems"))
    rows = rows.join(problems, "generation_id", "left").withColumn("problems", F.coalesce("problems", F.lit(0)))
    return rows.unionByName(refused, allowMissingColumns=True)


def pseudonymise_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Views(spark, sf_dir).users().select("id", identity.pseudonym(F.concat(F.lit("token-"), "id"), b"a key of the test tables", b"session:").alias("digest"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Views(spark, sf_dir).table("documents")
    return docs.select("doc_id", F.sha2(text.redact(F.col("text")), 256).alias("redacted_sha256"), (text.redact(F.col("text")) != F.col("text")).alias("changed"))


def catalog_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Views(spark, sf_dir).nested_items()
    return model_store.fingerprint(rows).crossJoin(rows.agg(F.count("*").alias("items")))


def catalog_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a catalog's tree of hashes says of one with some items removed, changed and added, when
    only the branches of these are hashed again."""
    items = Views(spark, sf_dir).nested_items()
    old = hash_tree.held(hash_tree.tree(items))
    removed = items.where("id % 9 = 0")
    edited = items.where("id % 9 <> 0 and id % 7 = 0").withColumn("title", F.concat("title", F.lit("!")))
    added = items.where("id % 10 = 1").withColumn("slug", F.concat("slug", F.lit("-b")))
    return hash_tree.changes(old, hash_tree.held(hash_tree.refreshed(old, edited.unionByName(added), removed)))


def model_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of a model made of all items: for the same catalog, for one that has changed, for
    one that is invalid, and where there is no model."""
    items = Views(spark, sf_dir).nested_items()
    manifest = written(model_store.fingerprint(items), "manifest")
    later = items.withColumn("title", F.when(F.col("id") == F.lit(1), "another").otherwise(F.col("title"))).unionByName(items.limit(1).withColumn("slug", F.lit("one-more")))
    verdict = lambda valid: spark.range(1).select(F.lit(valid).alias("valid"))
    cases = {"same": (manifest, items, True), "changed": (manifest, later, True), "invalid": (manifest, items, False), "none": (None, items, True)}
    out = None
    for name, (model, catalog_now, valid) in cases.items():
        row = model_store.status(model, catalog_now, verdict(valid)).select(F.lit(name).alias("case"), "status", "reason")
        out = row if out is None else out.unionByName(row)
    return out


def model_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a model over all items, and the problems of its fit."""
    model = _model(Views(spark, sf_dir))
    return model_store.summary(model).crossJoin(features.fit_problems(model.items, model.features).agg(F.count("*").alias("problems")))


def feature_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of a fit over all items, some of which have nothing to say."""
    items = Views(spark, sf_dir).nested_items()
    empty = {c: F.when(F.col("id") % 17 != 0, F.col(c)) for c in ("title", "description", "developer")}
    lists = {c: F.when(F.col("id") % 17 != 0, F.col(c)).otherwise(F.array().cast(items.schema[c].dataType)) for c in ("genres", "tags")}
    items = written(items.withColumns(empty | lists), "items")
    return features.fit_problems(items, features.settled(features.fit(items)))


def model_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model over all items, stored, read again and checked, with its status for the same catalog."""
    v = Views(spark, sf_dir)
    # the vectors are written once, to the store
    model = model_store.build(written(v.nested_items(), "items"))
    path = f"{run_folder(spark)}/model-{uuid.uuid4().hex}"
    model_store.store(model, path, NOW)
    discard(*model.features.made_of)
    rules = model_store.integrity(spark, path)
    verdict = spark.range(1).select(F.lit(True).alias("valid"))
    state = model_store.status(model_store.inspect(spark, path), model.items, verdict)
    stale = model_store.stale_items(model.items, v.nested_items()).agg(F.count("*").alias("stale_items"))
    return rules.crossJoin(F.broadcast(state.select("status"))).crossJoin(F.broadcast(stale))


def session_renew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third user consents to the version of now, for 90 days."""
    users = Views(spark, sf_dir).users()
    rows = lifecycle.renew(users, users.where("id % 3 = 0").select("id"), _at(NOW), "v1", 90 * 86_400)
    return rows.select("id", "consent_version", "consented_at", "expires_at")


def delete_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each table, by user, when every fourth user is deleted with all that they own."""
    v = Views(spark, sf_dir)
    gone = v.users().where("id % 4 = 1").select(F.col("id").alias("user_id"))
    left = lifecycle.delete_users(v.users(), gone, {"events": v.rec_events(), "interactions": v.interactions(), "preferences": v.preferences()})
    return _rows_per_user(left)


def legacy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = Views(spark, sf_dir).rec_events().withColumn("id", F.substring("generation_id", 5, 20).cast("long"))
    return lifecycle.backfill_events(events).select("id", "user_id", "generation_id", "event_schema_version")


def half_step_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Views(spark, sf_dir).interactions().where("interaction_type = 'rated'")
    return rows.select("id", fixedpoint.half_step_rating(F.col("value")).alias("half_step"), fixedpoint.half_step_rating(F.col("value") + F.lit(0.25).cast("decimal(5,2)")).alias("quarter_more"))


def _plain(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Decimals as doubles and dates as text, which every engine prints alike."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = query(spark, sf_dir)
        casts = {c: F.col(c).cast("double" if kind.startswith("decimal") else "string") for c, kind in rows.dtypes if kind.startswith("decimal") or kind == "date"}
        return rows.withColumns(casts) if casts else rows

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"catalog_page_{s}": _plain(_page(s)) for s in catalog.SORTS} | {
    f.__name__.removesuffix("_query"): _plain(f)
    for f in (
        catalog_deep_pages, catalog_search_literal, catalog_search_indexed, catalog_filter_taxonomy, catalog_nested, catalog_item, catalog_items, catalog_scan, catalog_scan_bucketed, taxonomy_lists, resolve_ids, popularity_baseline, term_frequency,
        document_frequency_idf, tfidf_weights, content_documents, content_recommend, recommend_by_ids, recommend_evidence, context_checks, active_feedback, feedback_pages, feedback_pages_all,
        supersession_backfill, replace_state, positive_sources, feedback_recommend, preferences_pivot, preferences_replace, unknown_references, stale_references,
        upsert_classify, quality_checks, quality_split, unique_checks, fk_checks, feedback_checks, catalog_canonicalise, retention_preview, retention_purge, revoke_cohort,
        upsert_in_place, state_in_place, retention_in_place,
        session_status, legacy_backfill, event_log_query, pseudonymise_users, redact_text, catalog_fingerprint, catalog_changes, model_states, feature_checks, model_summary, model_integrity, session_renew, delete_users, legacy_events, half_step_ratings,
    )
}
