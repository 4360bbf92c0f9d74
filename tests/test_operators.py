"""Operators of the catalog, feedback, preferences, quality and maintenance on small rows."""

import hashlib
import hmac
import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from merrow.functions import identity, text
from merrow.operators import catalog, features, feedback, lifecycle, popularity, preferences, quality
from merrow.schemas import INTERACTION, ITEM, NESTED_ITEM
from merrow.sources import catalog_json, events

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def log(spark, *rows):
    return spark.createDataFrame([(i, u, g, k, None if v is None else Decimal(v), at(h), None) for i, (u, g, k, v, h) in enumerate(rows)], INTERACTION)


# --- text ----------------------------------------------------------------------------------------


def test_words_terms_and_documents(spark):
    row = ("Café 　Ünïcode\r\nA tactical", "co-op")
    got = spark.createDataFrame([row], "t string, s string").select(text.normalize_text(F.col("t")).alias("n"), text.fold_words(F.col("t")).alias("w"), text.field_token("tag", F.col("s")).alias("k"), text.terms(F.lit("a tactical tactical")).alias("g"), text.terms(F.lit("x")).alias("one")).first()
    assert (got.n, got.w, got.k) == ("Café Ünïcode A tactical", "cafe unicode a tactical", "tag_co_op")
    assert got.g == ["tactical", "tactical", "tactical tactical"] and got.one == []
    item = (1, None, "Red Sky", "red-sky", "A sky", None, "東京", None, None, 0, Decimal(0), None, [("rpg", "RPG")], [], [])
    doc = spark.createDataFrame([item], NESTED_ITEM).select(text.content_document().alias("d")).first().d
    assert doc == "red sky red sky genre_rpg genre_rpg genre_rpg developer_ a sky"


def test_redaction_and_pseudonyms(spark):
    token = "a" * 43
    raw = f"postgresql+psycopg://user:pw@host/db password=abc, Token: xyz; {token} {token}b"
    got = spark.range(1).select(text.redact(F.lit(raw)).alias("r"), identity.pseudonym(F.lit("t1"), b"key", b"session:").alias("p"), identity.pseudonym(F.lit("t1"), b"k" * 70, b"session:").alias("q"), identity.replacement_digest(F.lit("key-1"), F.lit(255)).alias("d"), identity.canonical_json(b=F.lit(1), a=F.lit(None).cast("string"), c=F.lit("é")).alias("j")).first()
    assert got.r == f"postgresql+psycopg://user:***@host/db password=***, Token: ***; *** {token}b"
    for value, key in ((got.p, b"key"), (got.q, b"k" * 70)):
        assert value == hmac.new(key, b"session:t1", hashlib.sha256).hexdigest()
    assert got.d == hashlib.md5(b"legacy-revoked-v1:key-1").hexdigest() + "ff".zfill(32)
    assert got.j == '{"a":null,"b":1,"c":"é"}'


# --- catalog -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, None, t, f"item-{i}", "d", None, None, None, r, c, Decimal(p), None) for i, t, r, c, p in [(1, "100% Fun", Decimal("9.00"), 5, 10), (2, "under_score", None, 0, 50), (3, "Back\\slash", Decimal("9.00"), 9, 50), (4, "plain", Decimal("1.00"), 1, 1)]]
    return spark.createDataFrame(rows, ITEM)


def test_catalog(spark, items):
    count = lambda q: catalog.search_title(items, q).count()
    assert [count(q) for q in ("%", "_", "\\", "FUN", "none")] == [1, 1, 1, 1, 0]
    ids = lambda sort: [r.id for r in catalog.page_of(items, catalog.sort_columns(sort), 1, 10).collect()]
    assert ids("popularity") == [2, 3, 1, 4] and ids("rating") == [3, 1, 4, 2] and ids("title") == [1, 3, 4, 2]
    page, totals = catalog.catalog_page(items, "title", 99, 3)
    assert page.count() == 0 and tuple(totals.first()) == (4, 2)
    assert tuple(catalog.totals(items.limit(0), 3).first()) == (0, 0)
    bridge = spark.createDataFrame([(1, "b", "Beta"), (1, "a", "Zeta"), (2, "b", "Beta")], "id long, slug string, name string")
    nested = {r.id: [x.slug for x in r.genres] for r in catalog.nest(items, bridge, bridge, bridge.limit(0)).collect()}
    assert nested == {1: ["b", "a"], 2: ["b"], 3: [], 4: []}
    assert catalog.filtered(items, genre=(bridge, "b"), tag=(bridge, "a")).count() == 1
    known, unknown = catalog.resolve_ids(spark.createDataFrame([(7, 0, 1), (7, 1, 99)], "request_id long, place int, id long"), items)
    assert [r.slug for r in known.collect()] == ["item-1"] and [r.id for r in unknown.collect()] == [99]


def test_deep_pages(spark):
    """Every page of an index equals that of a sort, and the last one reads no more rows than the first."""
    rng = random.Random(3)
    rows = [(i, None, f"Title {rng.randrange(9)}", f"item-{i}", "d", None, None, None, Decimal(rng.randrange(4)) if i % 5 else None, rng.randrange(3), Decimal(rng.randrange(6)), None) for i in range(97)]
    table = spark.createDataFrame(rows, ITEM)
    for sort in catalog.SORTS:
        order = catalog.sort_columns(sort)
        index = catalog.page_index(table, order)
        for page in (1, 2, 5, 10, 11):
            own = [r.id for r in catalog.indexed_page(index, page, 10).collect()]
            assert own == [r.id for r in catalog.page_of(table, order, page, 10).collect()]
            plan = catalog.indexed_page(index, page, 10)._jdf.queryExecution().executedPlan().toString()
            assert "GreaterThanOrEqual(place" in plan and "LessThanOrEqual(place" in plan
    with pytest.raises(ValueError, match="start at 1"):
        catalog.indexed_page(index, 0, 10)


def test_indexed_search_equals_the_scan(spark):
    from merrow.operators import search

    titles = ["Red Sky", "RED%", "under_score", "Back\\slash \\ red", "東京タワー 東京", "İstanbul", "ab", "", None, "aaaa", "red red red", "%_%", "re d", "Straße rot"]
    items = spark.createDataFrame(list(enumerate(titles)), "id long, title string").repartition(3)
    index = search.index_titles(items)
    for q in ("red", "RED", "%", "_", "\\", "a", "aaa", "aaaaa", "東京", "京タワ", "İst", "straße", "%_%", "sky ", "nothing", "", "d red", "red re", "h \\ r"):
        own = sorted(r.id for r in search.search_indexed(items, index, q).collect())
        assert own == sorted(r.id for r in catalog.search_title(items, q).collect()), q
    assert search.search_indexed(items, index, "red").count() >= 4


def test_popularity(spark, items):
    got = {r.slug: r.popularity for r in popularity.popularity(items).collect()}
    mean = (9 * 5 + 9 * 9 + 1) / 15
    blend = lambda v, r: v / (v + 50) * r / 10 + 50 / (v + 50) * mean / 10
    raw = [blend(5, 9), blend(0, mean), blend(9, 9), blend(1, 1)]
    for k, (b, s) in enumerate(zip(raw, (10, 50, 50, 1), strict=True), 1):
        want = 0.7 * (b - min(raw)) / (max(raw) - min(raw)) + 0.3 * (s - 1) / 49
        assert got[f"item-{k}"] == pytest.approx(want, abs=1e-12)
    flat = items.withColumns({"average_rating": F.lit(None).cast("decimal(4,2)"), "popularity_score": F.lit(3).cast("decimal(10,4)")})
    assert {round(r.popularity, 12) for r in popularity.popularity(flat).collect()} == {0.5}


def test_feature_problems(spark):
    rows = [(i, None, t, f"s-{i}", d, None, None, None, None, 0, Decimal(0), None, [], [], []) for i, t, d in ((1, "word", "text"), (2, "!", "?"))]
    frame = spark.createDataFrame(rows, NESTED_ITEM)
    assert {(r.rule, r.key) for r in features.fit_problems(frame, features.fit(frame)).collect()} == {("document_empty", "s-2"), ("row_without_weights", "s-2")}


# --- feedback ------------------------------------------------------------------------------------


def test_supersession(spark):
    rows = log(spark, (1, 1, "liked", None, 0), (1, 1, "disliked", None, 1), (1, 1, "played", None, 0), (1, 1, "played", None, 2), (1, 1, "viewed", None, 5), (1, 1, "viewed", None, 6), (2, 1, "liked", None, 3), (2, 1, "disliked", None, 3))
    done = {r.id: r.superseded_at for r in feedback.supersede(rows).collect()}
    assert done == {0: at(1), 1: None, 2: at(2), 3: None, 4: None, 5: None, 6: at(3), 7: None}
    assert {r.id for r in feedback.active_rows(feedback.supersede(rows)).collect()} == {1, 3, 7}
    rng = random.Random(1)
    many = log(spark, *[(rng.randrange(3), rng.randrange(3), rng.choice(["liked", "disliked", "played", "rated", "viewed"]), None, rng.randrange(5)) for _ in range(150)])
    active = feedback.active_rows(feedback.supersede(many)).withColumn("d", feedback.dimension())
    assert active.groupBy("user_id", "item_id", "d").count().where("count > 1").count() == 0


def test_replace_state(spark):
    want = lambda *rows: spark.createDataFrame([(1, 1, k, None if v is None else Decimal(v)) for k, v in rows], "user_id long, item_id long, interaction_type string, value decimal(5,2)")
    empty = log(spark, (9, 9, "liked", None, 0))
    one = feedback.replace_state(empty, want(("liked", None), ("played", None), ("rated", "8.5")), F.lit(at(1)))
    counts = lambda df: {r["change"]: r["count"] for r in df.groupBy("change").count().collect()}
    assert counts(one) == {"kept": 1, "inserted": 3}
    base = one.drop("change")
    same = feedback.replace_state(base, want(("liked", None), ("played", None), ("rated", "8.50")), F.lit(at(2)))
    assert counts(same) == {"kept": 4}
    other = feedback.replace_state(base, want(("disliked", None), ("wishlisted", None), ("rated", "9")), F.lit(at(3)))
    assert counts(other) == {"kept": 1, "closed": 3, "inserted": 3}
    cleared = feedback.replace_state(other.drop("change"), want((None, None)), F.lit(at(4)))
    assert counts(cleared) == {"kept": 4, "closed": 3} and feedback.active_rows(cleared).where("user_id = 1").count() == 0


# --- preferences -----------------------------------------------------------------------------------


def test_preferences(spark):
    rows = spark.createDataFrame([(1, "game", "b"), (1, "game", "a"), (1, "genre", "g"), (2, "tag", "t")], "user_id long, preference_type string, value string")
    got = {r.user_id: (r.selected, r.genres, r.tags, r.platforms) for r in preferences.pivot_preferences(rows).collect()}
    assert got == {1: (["a", "b"], ["g"], [], []), 2: ([], [], ["t"], [])}
    users = spark.createDataFrame([(1,)], "user_id long")
    new = spark.createDataFrame([(1, "game", "a"), (1, "tag", "z")], rows.schema)
    changed = {(r.value, r.change) for r in preferences.replace_preferences(rows, new, users).collect()}
    assert changed == {("a", "kept"), ("b", "deleted"), ("g", "deleted"), ("z", "inserted"), ("t", "kept")}
    known = spark.createDataFrame([("game", "a"), ("genre", "g"), ("tag", "t")], "family string, slug string")
    assert [(r.user_id, r.reference) for r in preferences.stale_references(rows, known).collect()] == [(1, "game:b")]


# --- quality and maintenance -------------------------------------------------------------------------


def test_rules(spark):
    rows = log(spark, (1, 1, "rated", None, 0), (1, 1, "rated", "11", 0), (1, 1, "liked", "3", 0), (1, 1, "other", None, 0), (1, 1, "rated", "10", 0))
    found = {(r.rule, r.key) for r in quality.violations(rows, "interactions", "id", quality.interaction_rules()).collect()}
    assert found == {("value_only_for_ratings", "0"), ("value_only_for_ratings", "1"), ("value_only_for_ratings", "2"), ("type_known", "3")}
    assert [r.n for r in quality.duplicates(rows, "t", "r", ["user_id"], F.col("interaction_type") == "rated").collect()] == [3]
    assert [(r.key, r.n) for r in quality.orphans(rows, "t", "r", "item_id", spark.range(1), "id").collect()] == [("1", 5)]
    event = [("g1", "legacy-v1", None, None, None, "{}", "[]"), ("g2", "stage-4-v1", "f", None, "1", "[]", "{}"), ("g3", "stage-4-v1", "f", "n", "1", None, None)]
    frame = spark.createDataFrame(event, "generation_id string, event_schema_version string, data_fingerprint string, ranking_policy_name string, ranking_policy_version string, request_context string, result_summary string")
    assert {(r.rule, r.key) for r in quality.violations(frame, "e", "generation_id", quality.event_rules()).collect()} == {("event_identity", "g2"), ("context_is_object", "g2"), ("result_is_array", "g2")}


def test_split_in_one_scan(spark, tmp_path):
    rows = log(spark, (1, 1, "rated", None, 0), (1, 2, "other", "11", 0), (1, 3, "liked", None, 0), (1, 4, "rated", "10", 0), (1, 5, "viewed", None, 1))
    scans = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(x):
        scans.add(1)
        return x

    counted = rows.withColumn("id", seen.asNondeterministic()("id"))
    clean, rejects, counts = quality.split(counted, quality.interaction_rules(), str(tmp_path / "split"))
    assert scans.value == 5 and counts == {"rows": 5, "type_known": 1, "value_only_for_ratings": 2, "superseded_after": 0}
    assert {r.item_id for r in clean.collect()} == {3, 4, 5} and clean.columns == rows.columns
    assert {r.item_id: r.reasons for r in rejects.collect()} == {1: ["value_only_for_ratings"], 2: ["type_known", "value_only_for_ratings"]}
    with pytest.raises(Exception, match="(?i)exist"):
        quality.split(rows, quality.interaction_rules(), str(tmp_path / "split"))
    none = quality.split(rows.where("false"), quality.interaction_rules(), str(tmp_path / "none"))
    assert none[0].count() == none[1].count() == 0 and none[2]["rows"] == 0


def test_canonical_items(spark):
    ok = (1, None, " A  title ", "a-1", "text", None, "", "  ", Decimal("5.00"), 1, Decimal(1), None, [("b", "B"), ("a", "A")], [], [])
    bad = (2, None, "　", "Bad Slug", "t", None, None, None, None, -1, Decimal(1), None, [("a", "A"), ("a", "B")], [], [])
    rows = quality.canonical_items(spark.createDataFrame([ok, bad], NESTED_ITEM))
    got = {r.id: r for r in rows.collect()}
    assert got[1].rejects == [] and got[1].title == "A title" and got[1].developer is None and got[1].publisher is None and [g.slug for g in got[1].genres] == ["a", "b"]
    assert got[2].rejects == ["title_blank", "slug_format", "rating_count_range", "genres_repeated"]
    assert tuple(quality.catalog_verdict(rows).first()) == (2, 1, 0, False)
    assert not quality.catalog_verdict(rows.limit(0)).first().valid


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "A", ["x"], at(0)), (2, "b", "B", ["x", "y"], at(0)), (3, "c", "C", [], at(0))], "id long, slug string, title string, tags array<string>, updated_at timestamp_ntz")
    new = spark.createDataFrame([("a", "A2", ["x"]), ("b", "B", ["y", "x"]), ("d", "D", [])], "slug string, title string, tags array<string>")
    merged = lifecycle.upsert_items(old, new, F.lit(at(5)).cast("timestamp_ntz"))
    assert {(r.slug, r.outcome, r.updated_at) for r in merged.collect()} == {("a", "updated", at(5)), ("b", "unchanged", at(0)), ("c", "kept", at(0)), ("d", "inserted", at(5))}
    again = lifecycle.upsert_items(merged.drop("outcome"), new, F.lit(at(6)).cast("timestamp_ntz"))
    assert tuple(lifecycle.outcome_counts(again).first()) == (0, 0, 3)
    associated = lifecycle.upsert_items(old, new.where("slug = 'b'").withColumn("tags", F.array(F.lit("x"))), F.lit(at(5)).cast("timestamp_ntz"))
    assert [r.outcome for r in associated.where("slug = 'b'").collect()] == ["updated"]


USER = "id long, created_at timestamp_ntz, consented_at timestamp_ntz, consent_version string, expires_at timestamp_ntz, revoked_at timestamp_ntz"


def test_retention_and_sessions(spark):
    users = spark.createDataFrame([(1, at(0), at(0), "v1", at(5), None), (2, at(0), at(0), "v1", at(50), at(5)), (3, at(0), None, None, None, at(1)), (4, at(9), at(9), "v0", at(50), None), (5, at(0), at(0), "v1", at(50), None)], USER)
    rows = spark.createDataFrame([("g1", 5, at(5)), ("g2", 5, at(6)), ("g3", 1, at(9))], "generation_id string, user_id long, generated_at timestamp_ntz")
    cut = lambda h: F.lit(at(h)).cast("timestamp_ntz")
    assert tuple(lifecycle.retention_preview(rows, users, cut(5), cut(5)).first())[:3] == (1, 1, 0)
    assert tuple(lifecycle.retention_preview(rows, users, cut(5), cut(5), cut(5)).first())[:3] == (1, 1, 2)
    left = lifecycle.retention_purge(rows, users, {"preferences": rows.select("user_id")}, cut(5), cut(5))
    assert {r.id for r in left["users"].collect()} == {2, 3, 4, 5} and [r.generation_id for r in left["events"].collect()] == ["g2"] and left["preferences"].count() == 2
    assert tuple(lifecycle.retention_preview(left["events"], left["users"], cut(5), cut(5)).first())[:3] == (0, 0, 0)
    status = {r.id: r.status for r in lifecycle.session_status(users, cut(5), "v1").collect()}
    assert status == {1: "required", 2: "required", 3: "required", 4: "consent_outdated", 5: "active"}
    gone = {r.id for r in lifecycle.revoke_cohort(users, cut(0), cut(6)).where("processed").collect()}
    assert gone == {5}
    fresh = {r.id: r.expires_at for r in lifecycle.renew(users, spark.createDataFrame([(i,) for i in range(1, 6)], "id long"), cut(10), "v1", 3600).collect()}
    assert fresh == {1: at(5), 2: at(50), 3: None, 4: at(11), 5: at(50)}
    assert {r.id for r in lifecycle.delete_users(users, spark.createDataFrame([(1,)], "user_id long"), {})["users"].collect()} == {2, 3, 4, 5}
    row = lifecycle.summary(users, lifecycle.expired(cut(5)), "preview", cut(5)).first()
    assert (row["mode"], row.eligible, row.processed, row.remaining) == ("preview", 1, 0, 1)


# --- sources ----------------------------------------------------------------------------------------


def seed(n=25, **extra):
    games = [{"external_id": None, "title": f"Game {i}", "slug": f"game-{i}", "description": "d", "release_date": "2024-01-01", "developer": "x", "publisher": None, "average_rating": 7.5, "rating_count": 1, "popularity_score": 1.5, "genre_slugs": ["rpg"], "tag_slugs": [], "platform_slugs": ["pc"]} for i in range(n)]
    names = lambda *s: [{"name": x.upper(), "slug": x} for x in s]
    return {"provenance": {"source": "s", "created_at": "2024-01-01", "license": "l", "limitations": "n"}, "taxonomies": {"genres": names("rpg"), "tags": names("co-op"), "platforms": names("pc", "mac")}, "games": games, **extra}


def test_seed(spark, tmp_path):
    path = tmp_path / "seed.json"
    path.write_text(json.dumps(seed(), indent=1))
    read = catalog_json.read_seed(spark, str(path))
    assert read.games.count() == 25 and read.taxonomies.count() == 4 and read.bridges["genres"].count() == 25
    assert quality.seed_problems(read.games, read.taxonomies).count() == 0
    bad = seed(3)
    bad["games"][0]["genre_slugs"] = ["rpg", "rpg", "lost"]
    bad["games"][1]["slug"] = "game-0"
    bad["games"][2]["platform_slugs"] = []
    path.write_text(json.dumps(bad))
    read = catalog_json.read_seed(spark, str(path))
    assert {r.rule for r in quality.seed_problems(read.games, read.taxonomies).collect()} == {"genre_slugs_repeated", "genre_unknown", "slug_repeated", "platform_slugs_missing", "too_few_games"}
    odd = seed()
    odd["games"][0]["surprise"] = 1
    path.write_text(json.dumps(odd))
    with pytest.raises(ValueError, match="games.surprise"):
        catalog_json.read_seed(spark, str(path))


def test_event_payloads(spark, tmp_path):
    good_item = {"affinity_units": 0, "base_units": 1, "final_units": 5, "played_delta_units": 0, "rank": 1, "slug": "s-1"}
    good = {"top_k": 5, "selected_game_slugs": ["a"], "preferred_genres": [], "preferred_tags": [], "preferred_platforms": [], "positive_source_slugs": [], "disliked_count": 0, "played_count": 3, "positive_source_count": 0, "effective_state_fingerprint": "0f" * 32}
    cases = {
        "ok": (good, [good_item]),
        "items_too_many": (good, [good_item] * 21),
        "units_out_of_range": (good, [good_item | {"final_units": 2_000_000}]),
        "rank_out_of_range": (good, [good_item | {"rank": 0}]),
        "played_delta_out_of_range": (good, [good_item | {"played_delta_units": 1}]),
        "slug_format": (good, [good_item | {"slug": "Not a slug"}]),
        "context_too_long": (good | {"note": "y" * 9000}, []),
        "top_k_out_of_range": (good | {"top_k": 21}, []),
        "fingerprint_format": (good | {"effective_state_fingerprint": "x"}, []),
        "selected_game_slugs_too_long": (good | {"selected_game_slugs": ["a"] * 26}, []),
        "preferred_platforms_too_long": (good | {"preferred_platforms": ["a"] * 11}, []),
        "played_count_out_of_range": (good | {"played_count": -1}, []),
    }
    rows = [(name, json.dumps(context), json.dumps(result), at(0)) for name, (context, result) in cases.items()]
    frame = spark.createDataFrame(rows, "generation_id string, request_context string, result_summary string, generated_at timestamp_ntz")
    assert {(r.generation_id, r.reason) for r in events.payload_problems(frame).collect()} == {(name, name) for name in cases if name != "ok"}
    path = str(tmp_path / "events")
    for _ in range(2):
        events.append_events(frame, path, "batch-1")
    assert spark.read.parquet(path).count() == len(rows)


def test_stream_equals_batch(spark, tmp_path):
    from merrow.streaming.feedback_state import active_state_stream

    rng = random.Random(2)
    rows = log(spark, *[(rng.randrange(4), rng.randrange(4), rng.choice(["liked", "disliked", "played", "rated", "viewed"]), "5", rng.randrange(6)) for _ in range(120)])
    rows = rows.drop("superseded_at")
    folder = str(tmp_path / "in")
    rows.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    seen = {}

    def take(batch, _):
        for r in batch.collect():
            seen[r.user_id, r.item_id, r.dimension] = r.id

    query = active_state_stream(stream).writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    batch = feedback.active_rows(feedback.supersede(rows)).withColumn("d", feedback.dimension())
    assert seen == {(r.user_id, r.item_id, r.d): r.id for r in batch.collect()}
