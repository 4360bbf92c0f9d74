"""Row-changing jobs in place: each finds the partitions that hold rows to change and rewrites only
these (``sources/layout.py``). The rules are those of ``lifecycle``, ``feedback`` and ``preferences``.

Each job returns the partitions rewritten, by table. Running a job again, or after it ended
half-way, changes only what is left to change: what names the rows goes last."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from merrow.operators import feedback, lifecycle, preferences
from merrow.scratch import written
from merrow.sources.layout import Layout, drop_days, of_keys, rewrite, table


def _without(spark: SparkSession, layout: Layout, keys: DataFrame) -> int:
    """Remove the rows of ``keys``, which has the layout's key."""
    changing = of_keys(spark, layout, keys).join(keys, layout.key, "left_semi")
    return rewrite(spark, layout, changing, lambda old, _: old.join(keys, layout.key, "left_anti").select(*old.columns))


def _delete(spark: SparkSession, gone: DataFrame, users: Layout, children: dict[str, Layout]) -> dict[str, int]:
    """Remove users (user_id) from their tables, from ``users`` last, so that a job that ended
    half-way finds them again."""
    done = {name: _without(spark, layout, gone) for name, layout in children.items()}
    return done | {"users": _without(spark, users, gone.select(F.col("user_id").alias(users.key)))}


def delete_users(spark: SparkSession, ids: DataFrame, users: Layout, children: dict[str, Layout]) -> dict[str, int]:
    """Delete the users in ``ids`` (user_id; nulls are nobody) and what they own."""
    return _delete(spark, written(ids.select("user_id").where("user_id is not null").distinct(), "gone-users"), users, children)


def purge(
    spark: SparkSession, events: Layout, users: Layout, children: dict[str, Layout], event_cutoff: datetime, user_cutoff: Column, revoked_cutoff: Column | None = None
) -> dict[str, int]:
    """Retention: events up to a cutoff, users expired or revoked, and what these own. Days before
    the cutoff's are dropped unread; of its own day the partitions with older events are rewritten."""
    done = {"event_days": drop_days(spark, events, event_cutoff.date())}
    old = F.coalesce(F.col(events.time) <= F.lit(event_cutoff.isoformat()).cast("timestamp_ntz"), F.lit(False))
    done["events_by_age"] = rewrite(spark, events, table(spark, events).where(old), lambda rows, _: rows.where(~old))
    goes = F.coalesce(lifecycle.expired(user_cutoff) | lifecycle.revoked(revoked_cutoff), F.lit(False))
    gone = written(table(spark, users).where(goes).select(F.col(users.key).alias("user_id")).distinct(), "gone-users")
    return done | _delete(spark, gone, users, {"events": events} | children)


def revoke_cohort(spark: SparkSession, users: Layout, created_cutoff: Column, now: Column) -> dict[str, int]:
    """Set revoked_at for the live cohort."""
    changing = table(spark, users).where(lifecycle.live_cohort(created_cutoff, now))
    return {"users": rewrite(spark, users, changing, lambda old, _: lifecycle.revoke_cohort(old, created_cutoff, now).select(*old.columns))}


def renew(spark: SparkSession, users: Layout, ids: DataFrame, now: Column, version: str, ttl_seconds: int) -> dict[str, int]:
    """Fresh consent for those among ``ids`` (the key) whose session is live and of another version."""
    asked = written(ids.select(users.key).distinct(), "renewed")
    changing = of_keys(spark, users, asked).where(lifecycle.renewable(now, version)).join(asked, users.key, "left_semi")
    return {"users": rewrite(spark, users, changing, lambda old, _: lifecycle.renew(old, asked, now, version, ttl_seconds).select(*old.columns))}


def upsert_items(spark: SparkSession, items: Layout, incoming: DataFrame, now: Column, associations: tuple[str, ...] = ("genres", "tags", "platforms")) -> dict[str, int]:
    """Merge incoming items by key. Only the buckets that they fall into are compared, and of these
    only the ones with a new or different item are rewritten: a feed that repeats itself writes nothing."""
    feed = written(items.marked(incoming), "incoming")
    fresh = feed.drop(*items.levels)
    merged = lifecycle.upsert_items(of_keys(spark, items, fresh).drop(*items.levels), fresh, now, items.key, associations)
    changing = items.marked(merged.where("outcome in ('inserted', 'updated')"))

    def change(old: DataFrame, parts: DataFrame) -> DataFrame:
        here = feed.join(F.broadcast(parts), items.levels, "left_semi").drop(*items.levels)
        return lifecycle.upsert_items(old, here, now, items.key, associations).select(*old.columns)

    return {"items": rewrite(spark, items, changing, change)}


def replace_state(spark: SparkSession, log: Layout, desired: DataFrame, now: Column) -> dict[str, int]:
    """Set the state of the pairs in ``desired`` (see ``feedback.replace_state``) in a log laid out
    by user. Inserted rows have null ids, as there."""
    asked = written(log.marked(desired), "desired")
    plain = asked.drop(*log.levels)
    before = of_keys(spark, log, plain).drop(*log.levels)
    changing = log.marked(feedback.replace_state(before, plain, now).where("change <> 'kept'"))

    def change(old: DataFrame, parts: DataFrame) -> DataFrame:
        here = asked.join(F.broadcast(parts), log.levels, "left_semi").drop(*log.levels)
        return feedback.replace_state(old, here, now).select(*old.columns)

    return {"log": rewrite(spark, log, changing, change)}


def replace_preferences(spark: SparkSession, saved: Layout, desired: DataFrame, users: DataFrame) -> dict[str, int]:
    """Replace all preferences of ``users`` (user_id) by ``desired``, as ``preferences.replace_preferences``."""
    asked, named = written(saved.marked(desired), "desired"), written(saved.marked(users.select("user_id").distinct()), "named")
    bare = lambda rows: rows.drop(*saved.levels)
    replaced = preferences.replace_preferences(bare(of_keys(spark, saved, bare(named))), bare(asked), bare(named))
    changing = saved.marked(replaced.where("change <> 'kept'"))

    def change(old: DataFrame, parts: DataFrame) -> DataFrame:
        here = lambda rows: bare(rows.join(F.broadcast(parts), saved.levels, "left_semi"))
        return preferences.replace_preferences(old, here(asked), here(named)).where("change <> 'deleted'").select(*old.columns)

    return {"preferences": rewrite(spark, saved, changing, change)}
