"""Stored models, events, trees of hashes and streams: crashes, repeats and changes."""

import os
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from merrow.operators import feedback
from merrow.schemas import NESTED_ITEM
from merrow.sources import events, files, hash_tree, model_store


def catalog(spark, slugs, title="Title"):
    rows = [(k, None, f"{title} {s}", s, "some text of words", None, "Studio", None, Decimal("8.00"), 10, Decimal(k % 7), None, [("g", "G")], [], [("p", "P")]) for k, s in enumerate(slugs)]
    return spark.createDataFrame(rows, NESTED_ITEM)


@pytest.fixture(scope="module")
def model(spark):
    return model_store.held(model_store.build(catalog(spark, ["a-b", "c-d", "e-f"])))


def test_a_crash_leaves_no_model(spark, model, tmp_path, monkeypatch):
    path = str(tmp_path / "model")

    def die(checks):
        raise RuntimeError("the writer ends here")

    with monkeypatch.context() as m:
        m.setattr(model_store, "_refuse", die)
        with pytest.raises(RuntimeError, match="ends here"):
            model_store.store(model, path, "2024-01-01T00:00:00Z")
    assert not os.path.exists(path) and [n for n in os.listdir(tmp_path) if n.startswith(".model.stage-")]
    assert files.abandoned(spark, path) == []
    assert len(files.abandoned(spark, path, older_than=-60)) == 1
    model_store.store(model, path, "2024-01-01T00:00:00Z")
    assert model_store.load(spark, path).items.count() == 3


def test_one_of_two_writers_wins(spark, model, tmp_path):
    path = str(tmp_path / "model")
    (tmp_path / ".model.lock").touch()
    with pytest.raises(FileExistsError, match="another writer"):
        model_store.store(model, path, "2024-01-01T00:00:00Z")
    assert not os.path.exists(path)
    files.abandoned(spark, path, older_than=-60)
    staged = files.staging(path)
    model.items.write.parquet(staged)
    model_store.store(model, path, "2024-01-01T00:00:00Z")
    with pytest.raises(FileExistsError, match="exists"):
        files.promote(spark, staged, path)
    assert os.path.exists(staged) and model_store.load(spark, path).items.count() == 3


def test_changed_members_are_told(spark, model, tmp_path):
    path = str(tmp_path / "model")
    model_store.store(model, path, "2024-01-01T00:00:00Z")
    changed = spark.read.parquet(f"{path}/popularity").withColumn("popularity", F.col("popularity") / 2)
    rows = changed.collect()
    spark.createDataFrame(rows, changed.schema).write.mode("overwrite").parquet(f"{path}/popularity")
    assert {r.rule for r in model_store.integrity(spark, path).where("not passed").collect()} == {"digests"}


def test_events_count_once(spark, tmp_path):
    path = str(tmp_path / "events")
    day = datetime(2024, 1, 1)

    def made(*rows):
        return spark.createDataFrame([(g, u, day + timedelta(days=d)) for g, u, d in rows], "generation_id string, user_id long, generated_at timestamp_ntz")

    def held():
        return sorted((r.generation_id, r.user_id) for r in spark.read.parquet(path).collect())

    first, second = made(("g1", 1, 0), ("g2", 2, 1), ("g2", 2, 1)), made(("g3", 3, 0), ("g1", 1, 0))
    for _ in range(2):
        events.append_events(first, path, "b1")
        assert held() == [("g1", 1), ("g2", 2)]
    events.append_events(second, path, "b2")
    times = {f: os.path.getmtime(f) for f in map(str, tmp_path.rglob("batch=b1/*.parquet"))}
    events.append_events(second, path, "b2")
    assert held() == [("g1", 1), ("g2", 2), ("g3", 3)]
    assert times == {f: os.path.getmtime(f) for f in times} and times
    stale = spark.createDataFrame([(1, "game:x"), (1, "game:a"), (9, "tag:t")], "user_id long, reference string")
    got = events.refusals(spark.createDataFrame([(1,), (2,)], "user_id long"), stale).collect()
    assert [tuple(r) for r in got] == [(1, "stale_references", ["game:a", "game:x"])]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_tree_after_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hash_tree, "DIGITS", (2, 1, 0))
    rng, slugs = random.Random(1), [f"item-{i}" for i in range(300)]
    old = hash_tree.tree(catalog(spark, slugs))
    hash_tree.save(old, str(tmp_path / "old"))
    old = hash_tree.read(spark, str(tmp_path / "old"))
    gone, edited, added = rng.sample(slugs[:100], 5), rng.sample(slugs[100:], 6), ["new-1", "new-2"]
    k = {s: i for i, s in enumerate(slugs)}
    new_rows = catalog(spark, edited + added, "Other")
    now = catalog(spark, [s for s in slugs if s not in gone and s not in edited]).drop("id").join(spark.createDataFrame(list(k.items()), "slug string, k int"), "slug")
    now = now.withColumn("popularity_score", (F.col("k") % 7).cast("decimal(10,4)")).unionByName(new_rows, allowMissingColumns=True)
    whole = hash_tree.tree(now)
    after = hash_tree.refreshed(old, new_rows, spark.createDataFrame([(s,) for s in gone], "slug string"))
    assert rows_of(after.root) == rows_of(whole.root) != rows_of(old.root)
    for a, b in zip(after.levels, whole.levels, strict=True):
        assert rows_of(a.select("place", "hash")) == rows_of(b.select("place", "hash"))
    want = {(s, "removed") for s in gone} | {(s, "changed") for s in edited} | {(s, "added") for s in added}
    assert set(rows_of(hash_tree.changes(old, after))) == want
    assert hash_tree.changes(old, old).count() == 0
    none = hash_tree.tree(catalog(spark, slugs).where("false"))
    assert len(rows_of(none.root)) == 1 and hash_tree.changes(none, old).count() == 300


def test_stream_equals_supersede(spark, tmp_path):
    """Late rows, repeated rows, and a stop in the middle."""
    from merrow.streaming.feedback_state import keep_changes, kept_log, superseded_stream

    rng, t0 = random.Random(6), datetime(2024, 1, 1)
    kinds = ["liked", "disliked", "played", "wishlisted", "rated", "viewed"]
    made = []
    for i in range(150):
        kind = rng.choice(kinds)
        made.append((i, rng.randrange(3), rng.randrange(3), kind, Decimal(rng.randrange(20)) / 2 if kind == "rated" else None, t0 + timedelta(hours=rng.randrange(20))))
    shuffled = [*made, *rng.sample(made, 40)]
    rng.shuffle(shuffled)
    schema = "id long, user_id long, item_id long, interaction_type string, value decimal(5,2), occurred_at timestamp_ntz"
    source, out, place = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = superseded_stream(stream).writeStream.outputMode("update").foreachBatch(keep_changes(out)).option("checkpointLocation", place).trigger(availableNow=True).start()
        assert query.awaitTermination(120)

    def same(rows):
        unique = spark.createDataFrame(sorted(set(rows)), schema)
        assert rows_by_id(kept_log(spark, out)) == rows_by_id(feedback.supersede(unique))

    rows_by_id = lambda df: {r.id: (r.user_id, r.item_id, r.interaction_type, r.value, r.occurred_at, r.superseded_at) for r in df.collect()}
    assert kept_log(spark, out) is None
    feed(shuffled[:70])
    feed(shuffled[70:100])
    run()
    same(shuffled[:100])
    feed(shuffled[100:])
    run()
    same(shuffled)
    # the sink takes a batch that is run again
    again = spark.read.parquet(out).where("batch = 1").drop("batch")
    again = spark.createDataFrame(again.collect(), again.schema)
    keep_changes(out)(again, 1)
    same(shuffled)


def test_items_are_hashed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(title):
        seen.add(1)
        return title

    items = catalog(spark, [f"s-{i}" for i in range(20)])
    old = hash_tree.held(hash_tree.tree(items.withColumn("title", counted("title"))))
    assert seen.value == 20
    edited = items.where("slug in ('s-1', 's-2')").withColumn("title", counted(F.concat("title", F.lit("!"))))
    new = hash_tree.held(hash_tree.refreshed(old, edited, items.where("slug = 's-3'")))
    assert seen.value == 22
    assert sorted(map(tuple, hash_tree.changes(old, new).collect())) == [("s-1", "changed"), ("s-2", "changed"), ("s-3", "removed")]


def test_held_tables_are_not_written_again(spark):
    items = catalog(spark, ["a-b", "c-d"])
    once = model_store.held(model_store.build(items))
    again = model_store.held(once)
    assert again.items is once.items and again.popularity is once.popularity
    assert again.features.idf is once.features.idf and again.features.vectors is once.features.vectors
