"""Tables of which jobs rewrite only the partitions that change."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from merrow.operators import feedback, lifecycle, preferences, row_jobs
from merrow.schemas import INTERACTION, PREFERENCE
from merrow.sources import files
from merrow.sources.layout import Layout, drop_days, lay_out, plain, rewrite, table

START = datetime(2024, 1, 1)


def at(time):
    return F.lit(time.isoformat()).cast("timestamp_ntz")


def now():
    return at(datetime(2024, 2, 1))


def stamps(layout):
    """The files of a table with their times."""
    found = {}
    for folder, _, names in os.walk(layout.path):
        found |= {os.path.join(folder, n): os.stat(os.path.join(folder, n)).st_mtime_ns for n in names if n.endswith(".parquet")}
    return found


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def partition(name):
    return os.path.dirname(name)


@pytest.fixture
def users(spark, tmp_path):
    kind = "id bigint, created_at timestamp_ntz, consented_at timestamp_ntz, consent_version string, expires_at timestamp_ntz, revoked_at timestamp_ntz"
    rows = [(k, START, START, f"v{k % 2}", START + timedelta(days=200 if k > 20 else 10), START if k == 40 else None) for k in range(400)]
    rows.append((None, START, None, None, None, None))
    layout = Layout(str(tmp_path / "users"), "id", 32)
    lay_out(spark.createDataFrame(rows, kind), layout)
    return layout


@pytest.fixture
def events(spark, tmp_path):
    rows = [(f"g{k}", k % 400, START + timedelta(hours=k)) for k in range(800)] + [("none", None, None)]
    layout = Layout(str(tmp_path / "events"), "user_id", 8, "generated_at")
    lay_out(spark.createDataFrame(rows, "generation_id string, user_id bigint, generated_at timestamp_ntz"), layout)
    return layout


def test_ten_users_leave_the_other_files(spark, users, events):
    before, was, ids = stamps(users) | stamps(events), plain(spark, users), spark.createDataFrame([(k,) for k in (1, 2, 3, None, 10**9)], "user_id int")
    expected = {name: rows_of(df) for name, df in lifecycle.delete_users(was, ids, {"events": plain(spark, events)}).items()}
    done = row_jobs.delete_users(spark, ids, users, {"events": events})
    assert {"users": rows_of(plain(spark, users)), "events": rows_of(plain(spark, events))} == expected
    after = stamps(users) | stamps(events)
    touched = {partition(n) for n in before if after.get(n) != before[n]}
    assert done == {"users": 3, "events": 6} and len(touched) == 9
    assert row_jobs.delete_users(spark, ids, users, {"events": events}) == {"users": 0, "events": 0}
    assert stamps(users) | stamps(events) == after


def test_purge_drops_days_and_is_whole(spark, users, events):
    cutoff = START + timedelta(days=5, hours=7)
    expected = lifecycle.retention_purge(plain(spark, events), plain(spark, users), {}, at(cutoff), now(), now())
    # an event without a time is not old
    undated = plain(spark, events).where("generated_at is null")
    expected = {"users": rows_of(expected["users"]), "events": rows_of(expected["events"].unionByName(undated))}
    before = stamps(users)
    done = row_jobs.purge(spark, events, users, {}, cutoff, now(), now())
    assert {"users": rows_of(plain(spark, users)), "events": rows_of(plain(spark, events))} == expected
    assert done["event_days"] == 5 and done["events_by_age"] > 0 and 0 < done["users"] < 32
    assert sum(stamps(users).get(n) == t for n, t in before.items()) == len(before) - done["users"]
    assert set(row_jobs.purge(spark, events, users, {}, cutoff, now(), now()).values()) == {0}


def test_a_table_can_be_emptied_and_filled(spark, events):
    everyone = plain(spark, events)
    rewrite(spark, events, table(spark, events), lambda old, _: old.where("false"))
    assert plain(spark, events).count() == 0 and plain(spark, events).columns == everyone.columns and stamps(events) == {}
    new = spark.createDataFrame([("x", 7, START)], "generation_id string, user_id bigint, generated_at timestamp_ntz")
    assert rewrite(spark, events, events.marked(new), lambda old, _: old.unionByName(new)) == 1
    assert plain(spark, events).collect() == new.collect()
    assert drop_days(spark, events, START.date()) == 0 and drop_days(spark, events, (START + timedelta(days=1)).date()) == 1


def test_what_a_job_may_not_do(spark, users, tmp_path):
    before, was = stamps(users), rows_of(plain(spark, users))
    one = table(spark, users).where("id = 5")
    with pytest.raises(Exception, match="outside of the partitions"):
        rewrite(spark, users, one, lambda old, _: old.withColumn("id", F.col("id") + 1))
    assert stamps(users) == before and rows_of(plain(spark, users)) == was
    lock = tmp_path / ".users.lock"
    lock.touch()
    with pytest.raises(FileExistsError, match="another writer"):
        rewrite(spark, users, one, lambda old, _: old)
    files.abandoned(spark, users.path, older_than=-60)
    assert rewrite(spark, users, one, lambda old, _: old) == 1 and rows_of(plain(spark, users)) == was
    with pytest.raises(ValueError, match="is laid out by"):
        table(spark, Layout(users.path, "id", 16))
    with pytest.raises(FileExistsError):
        lay_out(plain(spark, users), users)
    with pytest.raises(ValueError, match="names of the layout"):
        lay_out(table(spark, users), Layout(str(tmp_path / "other"), "id"))


def test_a_job_that_ends_half_way_runs_again(spark, users, events, monkeypatch):
    ids = spark.createDataFrame([(k,) for k in range(9)], "user_id bigint")
    expected = rows_of(plain(spark, events).where("user_id >= 9 or user_id is null"))
    real = row_jobs.rewrite

    def dies_at_users(spark, layout, *rest):
        if layout is users:
            raise RuntimeError("the job ends here")
        return real(spark, layout, *rest)

    with monkeypatch.context() as m:
        m.setattr(row_jobs, "rewrite", dies_at_users)
        with pytest.raises(RuntimeError):
            row_jobs.delete_users(spark, ids, users, {"events": events})
    assert plain(spark, users).count() == 401 and rows_of(plain(spark, events)) == expected
    assert row_jobs.delete_users(spark, ids, users, {"events": events})["events"] == 0
    assert plain(spark, users).count() == 392


def test_sessions_are_revoked_and_renewed(spark, users):
    ids = spark.createDataFrame([(k,) for k in (30, 31, 33, 40, None)], "id bigint")
    expected = rows_of(lifecycle.renew(plain(spark, users), ids, now(), "v1", 60))
    assert row_jobs.renew(spark, users, ids, now(), "v1", 60) == {"users": 1}
    assert rows_of(plain(spark, users)) == expected
    assert row_jobs.renew(spark, users, ids, now(), "v1", 60) == {"users": 0}
    cutoff = at(START)
    expected = rows_of(lifecycle.revoke_cohort(plain(spark, users), cutoff, now()).drop("processed"))
    assert row_jobs.revoke_cohort(spark, users, cutoff, now())["users"] == 32
    assert rows_of(plain(spark, users)) == expected
    assert row_jobs.revoke_cohort(spark, users, cutoff, now()) == {"users": 0}


def test_upsert_writes_what_differs(spark, tmp_path):
    kind = "slug string, title string, tags array<string>, updated_at timestamp_ntz"
    old = spark.createDataFrame([(f"s{k}", f"t{k}", ["a", "b"], START) for k in range(300)], kind)
    layout = Layout(str(tmp_path / "items"), "slug", 32)
    lay_out(old, layout)
    same = old.select("slug", "title", F.reverse("tags").alias("tags"))
    before = stamps(layout)
    assert row_jobs.upsert_items(spark, layout, same, now()) == {"items": 0} and stamps(layout) == before
    feed = same.withColumn("title", F.when(F.col("slug") == "s5", "new").otherwise(F.col("title"))).unionByName(spark.createDataFrame([("fresh", "f", None)], "slug string, title string, tags array<string>"))
    expected = rows_of(lifecycle.upsert_items(old, feed, now()).drop("outcome"))
    assert row_jobs.upsert_items(spark, layout, feed, now())["items"] in (1, 2)
    assert rows_of(plain(spark, layout)) == expected
    assert len([n for n, t in before.items() if stamps(layout).get(n) == t]) >= len(before) - 2
    assert row_jobs.upsert_items(spark, layout, feed, now()) == {"items": 0}


def test_states_and_preferences_are_replaced(spark, tmp_path):
    rows = [(k, k % 50, k % 7, "liked", None, START, None) for k in range(200)]
    log = feedback.supersede(spark.createDataFrame(rows, INTERACTION)).select(*INTERACTION.names)
    layout = Layout(str(tmp_path / "log"), "user_id", 16)
    lay_out(log, layout)
    wanted = spark.createDataFrame([(3, 3, None, None), (4, 1, "played", None), (999, 1, "liked", None)], "user_id bigint, item_id bigint, interaction_type string, value double")
    expected = rows_of(feedback.replace_state(log, wanted, now()).drop("change"))
    assert 0 < row_jobs.replace_state(spark, layout, wanted, now())["log"] <= 3
    assert rows_of(plain(spark, layout)) == expected
    assert row_jobs.replace_state(spark, layout, wanted, now()) == {"log": 0}

    saved = spark.createDataFrame([(k % 40, "tag", f"t{k}", None) for k in range(120)], PREFERENCE).withColumn("weight", F.lit(1).cast("decimal(4,3)"))
    place = Layout(str(tmp_path / "saved"), "user_id", 16)
    lay_out(saved, place)
    named = spark.createDataFrame([(1,), (2,), (500,)], "user_id bigint")
    asked = spark.createDataFrame([(1, "tag", "t1"), (500, "genre", "g")], "user_id bigint, preference_type string, value string")
    expected = rows_of(preferences.replace_preferences(saved, asked, named).where("change <> 'deleted'").drop("change"))
    assert 0 < row_jobs.replace_preferences(spark, place, asked, named)["preferences"] <= 3
    assert rows_of(plain(spark, place)) == expected
    assert row_jobs.replace_preferences(spark, place, asked, named) == {"preferences": 0}


def test_bucketed_tables_are_nested_in_place(spark, tmp_path):
    from merrow.operators import catalog
    from merrow.sources.buckets import attach_bucketed, store_bucketed

    items = spark.createDataFrame([(k, f"s{k}", float(k)) for k in range(60)], "id bigint, slug string, popularity_score double")
    tags = spark.createDataFrame([(k, f"t{j}", f"T{j}") for k in range(50) for j in range(k % 4)], "id bigint, slug string, name string")
    kept = [store_bucketed(rows, name, str(tmp_path / name), "id", 4) for rows, name in ((items, "items_b"), (tags, "tags_b"))]
    again = attach_bucketed(spark, tags.schema.toDDL(), "tags_again", str(tmp_path / "tags_b"), "id", 4)
    with pytest.raises(FileExistsError):
        store_bucketed(items, "items_c", str(tmp_path / "items_b"), "id", 4)
    assert len([n for n in os.listdir(tmp_path / "tags_b") if n.endswith(".parquet")]) == 4
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nested = catalog.catalog_scan(kept[0], kept[1], again, kept[1])
        assert "Exchange" not in nested._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in catalog.catalog_scan(items, tags, tags, tags)._jdf.queryExecution().executedPlan().toString()
        assert rows_of(nested) == rows_of(catalog.catalog_scan(items, tags, tags, tags))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
