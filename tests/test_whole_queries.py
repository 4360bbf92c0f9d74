"""The registered queries work on whole texts and whole tables."""

from pyspark.sql import functions as F

from merrow.functions.text import content_document, terms
from merrow.plans import queries
from merrow.sources.views import Views

SF = "/root/testdata/sf0.001"


def test_model_reads_whole_descriptions(spark):
    v = Views(spark, SF)
    model = queries._model(v)
    texts = {f"doc-{r.doc_id}": r.text for r in v.table("documents").collect()}
    assert {r.slug: r.description for r in model.items.select("slug", "description").collect()} == texts
    want = v.nested_items().select("slug", F.size(F.array_distinct(terms(content_document()))).alias("n"))
    got = {r.slug: r.n for r in model.features.weights.groupBy("slug").agg(F.count("*").alias("n")).collect()}
    assert got == {r.slug: r.n for r in want.collect()}


def test_every_users_first_page(spark):
    state = queries.QUERIES["active_feedback"](spark, SF).collect()
    items = {r.id: r.slug for r in Views(spark, SF).items().select("id", "slug").collect()}
    got = queries.QUERIES["feedback_pages_all"](spark, SF).collect()
    users = {}
    for r in state:
        if r.item_id in items:
            users.setdefault(r.user_id, []).append(r)
    want = set()
    for user, rows in users.items():
        rows.sort(key=lambda r: r.item_id)
        rows.sort(key=lambda r: r.latest_at, reverse=True)
        want |= {(user, k + 1, r.item_id, items[r.item_id], r.reaction, r.rating, len(rows)) for k, r in enumerate(rows[:20])}
    assert {(r.user_id, r.place, r.item_id, r.slug, r.reaction, r.rating, r.total) for r in got} == want and len(users) > 1
    one = queries.QUERIES["feedback_pages"](spark, SF).collect()
    assert [(r.item_id, r.total) for r in one] == [(r.item_id, r.total) for r in sorted(got, key=lambda r: r.place) if r.user_id == 3]


def test_every_item_by_id(spark):
    got = {r.id: r for r in queries.QUERIES["catalog_items"](spark, SF).collect()}
    lists = {r.id: [len([x for x in r[c].split(",") if x]) for c in ("genres", "tags", "platforms")] for r in queries.QUERIES["catalog_nested"](spark, SF).collect()}
    assert {k: [r.genres, r.tags, r.platforms] for k, r in got.items()} == lists and len(got) > 1
    assert queries.QUERIES["catalog_item"](spark, SF).collect() == [got[7]]


def test_contexts_beyond_the_bounds_are_reported(spark):
    from merrow.operators import preferences, ranking

    saved = [(1, kind, f"{kind}{i}") for kind, n in (("game", 6), ("genre", 6), ("tag", 11), ("platform", 7)) for i in range(n)]
    saved += [(2, kind, f"{kind}{i}") for kind, n in (("game", 5), ("genre", 5), ("tag", 10), ("platform", 6)) for i in range(n)]
    contexts = preferences.contexts_of(spark.createDataFrame(saved, "user_id long, preference_type string, value string"), F.lit(5))
    items = spark.createDataFrame([(f"game{i}",) for i in range(6)], "slug string")
    got = sorted((r.context_id, r.reason) for r in ranking.context_problems(contexts, items).collect())
    assert got == [(1, f"{name}_too_many") for name in ("genres", "platforms", "selected", "tags")]


def test_term_weights_number_no_vocabulary_and_join_rare_terms_only(spark, monkeypatch):
    from collections import Counter
    from math import log, sqrt
    from pathlib import Path

    from merrow.operators import features
    from merrow.scratch import run_folder, written

    texts = {"a": "red fox red fox", "b": "red hen", "c": "blue hen sat", "d": "x", "e": None}
    rows = written(spark.createDataFrame([*texts.items()], "slug string, document string"), "texts")

    def counted(text):
        words = [w for w in (text or "").split() if len(w) > 1]
        return Counter(words + [f"{x} {y}" for x, y in zip(words, words[1:])])

    tf = {k: counted(t) for k, t in texts.items()}
    df = Counter(t for own in tf.values() for t in own)
    want = {}
    for k, own in tf.items():
        raw = {t: (1 + log(n)) * (log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in own.items()}
        want |= {(k, t): round(x / sqrt(sum(y * y for y in raw.values())), 9) for t, x in raw.items()}
    folder = Path(run_folder(spark).removeprefix("file:"))
    for most in (500_000, 2, 0):
        monkeypatch.setattr(features, "MOST_TERMS_TOLD", most)
        before = set(folder.glob("*"))
        got = {(r.slug, r.term): round(r.weight, 9) for r in features.term_weights(rows).collect()}
        assert got == want
        there = {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - before}
        assert there == {"document-frequencies"} | ({"half-weighted"} if most < 500_000 else set())
