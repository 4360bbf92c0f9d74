"""Row-changing jobs: upsert, retention, revocation, session states, legacy backfills.

Each maps old tables to new ones and a summary; the caller writes them to a new place, or
``row_jobs`` applies them in place to the partitions that change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merrow.functions.identity import replacement_digest


def upsert_items(existing: DataFrame, incoming: DataFrame, now: Column, key: str = "slug", associations: tuple[str, ...] = ("genres", "tags", "platforms")) -> DataFrame:
    """Existing rows with the incoming ones merged in by key, and ``outcome`` (inserted, updated,
    unchanged, kept). A row changes if a scalar or an association set differs; rows that aren't
    incoming are kept. Both sides have updated_at, which changed rows get anew."""
    skip = {key, "updated_at", "created_at", "id"}
    scalars = [c for c in incoming.columns if c not in skip and c not in associations]
    sets = [c for c in associations if c in incoming.columns]
    new = incoming.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in [*scalars, *sets]], F.lit(True).alias("is_new"))
    old = existing.withColumn("is_old", F.lit(True))
    both = old.join(new, key, "full_outer")
    differs = F.lit(False)
    for c in scalars:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    for c in sets:
        differs = differs | ~F.array_sort(F.array_distinct(c)).eqNullSafe(F.array_sort(F.array_distinct(f"new_{c}")))
    outcome = F.when(F.col("is_new").isNull(), "kept").when(F.col("is_old").isNull(), "inserted").when(differs, "updated").otherwise("unchanged")
    both = both.withColumn("outcome", outcome)
    fresh = F.col("outcome").isin("inserted", "updated")
    changed = {c: F.col(f"new_{c}") for c in (*scalars, *sets)} | {"updated_at": now}
    cols = [F.when(fresh, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in existing.columns]
    return both.select(*cols, "outcome")


def outcome_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("inserted", "updated", "unchanged")])


def expired(cutoff: Column) -> Column:
    return F.col("consented_at").isNotNull() & F.col("revoked_at").isNull() & (F.col("expires_at") <= cutoff)


def revoked(cutoff: Column | None) -> Column:
    """Revoked up to a cutoff; nothing without one."""
    return F.lit(False) if cutoff is None else F.coalesce(F.col("revoked_at") <= cutoff, F.lit(False))


def retention_preview(events: DataFrame, users: DataFrame, event_cutoff: Column, user_cutoff: Column, revoked_cutoff: Column | None = None) -> DataFrame:
    """One row: events, expired users and revoked users up to the cutoffs, inclusive."""
    old = events.agg(F.count_if(F.col("generated_at") <= event_cutoff).alias("events"))
    people = users.agg(F.count_if(expired(user_cutoff)).alias("expired_users"), F.count_if(revoked(revoked_cutoff)).alias("revoked_users"))
    return old.crossJoin(F.broadcast(people)).withColumn("eligible", F.col("events") + F.col("expired_users") + F.col("revoked_users"))


def retention_purge(events: DataFrame, users: DataFrame, children: dict[str, DataFrame], event_cutoff: Column, user_cutoff: Column, revoked_cutoff: Column | None = None) -> dict[str, DataFrame]:
    """The tables after a purge: events by age, users by expiry or revocation, and with them what
    they own (tables with user_id). A second purge finds nothing."""
    goes = F.coalesce(expired(user_cutoff) | revoked(revoked_cutoff), F.lit(False))
    gone = users.where(goes).select(F.col("id").alias("user_id"))
    out = {"users": users.where(~goes), "events": events.where(F.col("generated_at") > event_cutoff).join(gone, "user_id", "left_anti")}
    return out | {name: rows.join(gone, "user_id", "left_anti") for name, rows in children.items()}


def delete_users(users: DataFrame, ids: DataFrame, children: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables without the users in ``ids`` (user_id) and what they own."""
    out = {"users": users.join(ids.select(F.col("user_id").alias("id")), "id", "left_anti")}
    return out | {name: rows.join(ids.select("user_id"), "user_id", "left_anti") for name, rows in children.items()}


def live_cohort(created_cutoff: Column, now: Column) -> Column:
    """Sessions created up to a cutoff that are still live."""
    return F.coalesce(F.col("consented_at").isNotNull() & F.col("revoked_at").isNull() & (F.col("created_at") <= created_cutoff) & (F.col("expires_at") > now), F.lit(False))


def revoke_cohort(users: DataFrame, created_cutoff: Column, now: Column) -> DataFrame:
    """Users with revoked_at set for the live cohort, and ``processed``."""
    goes = live_cohort(created_cutoff, now)
    return users.withColumns({"processed": goes, "revoked_at": F.when(goes, now).otherwise(F.col("revoked_at"))})


def summary(rows: DataFrame, eligible: Column, mode: str, cutoff: Column) -> DataFrame:
    """The job's row: mode, eligible, processed, remaining, cutoff. A preview processes nothing."""
    n = F.count_if(eligible)
    done = n if mode == "apply" else F.lit(0).cast("long")
    return rows.agg(F.lit(mode).alias("mode"), n.alias("eligible"), done.alias("processed"), (n - done).alias("remaining"), F.first(cutoff).alias("cutoff"))


def session_status(users: DataFrame, now: Column, version: str) -> DataFrame:
    """(id, status): required for revoked, expired or never consented sessions, consent_outdated for
    another version, else active."""
    dead = F.col("consented_at").isNull() | F.col("revoked_at").isNotNull() | (F.col("expires_at") <= now)
    status = F.when(dead, "required").when(~F.col("consent_version").eqNullSafe(F.lit(version)), "consent_outdated").otherwise("active")
    return users.select("id", status.alias("status"))


def renewable(now: Column, version: str) -> Column:
    """Live sessions that consented to another version."""
    live = F.col("consented_at").isNotNull() & F.col("revoked_at").isNull() & (F.col("expires_at") > now)
    return F.coalesce(live & ~F.col("consent_version").eqNullSafe(F.lit(version)), F.lit(False))


def renew(users: DataFrame, ids: DataFrame, now: Column, version: str, ttl_seconds: int) -> DataFrame:
    """Users with fresh consent for those among ``ids`` whose session is live and of another version.
    Expired, revoked and never consented ones stay as they are, and so do those of this version."""
    chosen = ids.select("id").distinct().withColumn("__chosen", F.lit(True))
    rows = users.join(chosen, "id", "left").withColumn("__go", F.coalesce("__chosen", F.lit(False)) & renewable(now, version))
    until = now + F.make_dt_interval(secs=F.lit(ttl_seconds))
    fresh = {"consent_version": F.lit(version), "consented_at": now, "expires_at": until}
    changed = {c: F.when(F.col("__go"), value).otherwise(F.col(c)) for c, value in fresh.items()}
    return rows.withColumns(changed).drop("__chosen", "__go")


def backfill_identities(users: DataFrame, now: Column) -> DataFrame:
    """Users of the old key scheme: a replacement digest, revoked at ``now``."""
    return users.withColumns({"anonymous_token_digest": replacement_digest(F.col("anonymous_key"), F.col("id")), "revoked_at": now}).drop("anonymous_key")


def backfill_events(events: DataFrame) -> DataFrame:
    """Events of the old scheme: a generation id from the id, the legacy schema, no policy."""
    none = F.lit(None).cast("string")
    empty = dict.fromkeys(("data_fingerprint", "ranking_policy_name", "ranking_policy_version"), none)
    made = {"generation_id": F.concat(F.lit("legacy-"), F.col("id").cast("string")), "event_schema_version": F.lit("legacy-v1")}
    return events.withColumns(made | empty)
