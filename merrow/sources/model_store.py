"""Stored models: staged, checked and promoted as a whole; checked again before use."""

from __future__ import annotations

import json
from dataclasses import asdict
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merrow.config import ModelIdentity, ModelLimits
from merrow.operators.features import Features, fit, settled
from merrow.operators.popularity import popularity
from merrow.operators.ranking import Model
from merrow.scratch import kept, shuffles_removed
from merrow.sources import files, hash_tree

MEMBERS = ("items", "idf", "vectors", "popularity")


def fingerprint(items: DataFrame) -> DataFrame:
    """One row: the fingerprint of the whole catalog, the same for any order of rows: the root of
    its tree of hashes, in which no node has many children."""
    return hash_tree.tree(items).root


def build(items: DataFrame, identity: ModelIdentity | None = None) -> Model:
    """A model of nested items, not stored."""
    identity = identity or ModelIdentity()
    return Model(items, fit(items, identity.features), popularity(items, "slug", identity.popularity))


def held(model: Model) -> Model:
    """The model in scratch tables, for rankings that read it several times; what is one already
    isn't written again. It takes the place of ``model``, whose features can't be read any more."""
    return Model(kept(model.items, "items"), settled(model.features), kept(model.popularity, "popularity"))


def summary(model: Model) -> DataFrame:
    """One row: items, terms, weights."""
    counts = [rows.agg(F.count("*").alias(name)) for rows, name in ((model.items, "items"), (model.features.idf, "terms"))]
    counts.append(model.features.vectors.agg(F.coalesce(F.sum(F.size("numbers")), F.lit(0)).cast("long").alias("weights")))
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


def digests(model: Model) -> DataFrame:
    """One row: for each member a digest of its rows, whatever their order."""
    out = None
    for name, rows in _members_of(model).items():
        one = rows.select(F.xxhash64(*rows.columns).alias("h")).select("h", F.xxhash64("h", F.lit(7)).alias("g"))
        digest = F.concat_ws(":", F.count("*"), F.hex(F.coalesce(F.expr("bit_xor(h)"), F.lit(0).cast("long"))), F.hex(F.coalesce(F.expr("bit_xor(g)"), F.lit(0).cast("long"))))
        one = one.agg(digest.alias(f"{name}_digest"))
        out = one if out is None else out.crossJoin(one)
    return out


def _members_of(model: Model) -> dict[str, DataFrame]:
    return {"items": model.items, "idf": model.features.idf, "vectors": model.features.vectors, "popularity": model.popularity}


def store(model: Model, path: str, built_at: str, identity: ModelIdentity | None = None) -> None:
    """Write a model to a path where nothing is.

    All is written and checked in a hidden folder beside the path, then renamed to it at once, so
    that the path has a whole model or none. A writer that ends before its end leaves only its
    stage, which ``files.abandoned`` removes; storing again succeeds. Of several writers one wins,
    and the others get an error."""
    identity = identity or ModelIdentity()
    spark = model.items.sparkSession
    if files.exists(spark, path):
        raise FileExistsError(f"{path} exists")
    staged = files.staging(path)
    with shuffles_removed(spark):
        for name, rows in _members_of(model).items():
            rows.write.mode("errorifexists").option("compression", "zstd").parquet(f"{staged}/{name}")
    held = load(spark, staged, checked=False)
    manifest = summary(held).crossJoin(fingerprint(held.items)).crossJoin(digests(held))
    config = json.dumps(asdict(identity), sort_keys=True, default=str)
    extra = {"name": F.lit(identity.name), "version": F.lit(identity.version), "config": F.lit(config), "built_at": F.lit(built_at)}
    manifest = spark.createDataFrame([manifest.withColumns(extra).first()], manifest.withColumns(extra).schema)
    _refuse(_checks(held, manifest, identity, ModelLimits()))
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{staged}/manifest")
    files.promote(spark, staged, path)


def _refuse(checks: DataFrame) -> None:
    bad = [r.rule for r in checks.where(~F.col("passed")).collect()]
    if bad:
        raise ValueError("the stored model fails: " + ", ".join(bad))


def load(spark: SparkSession, path: str, checked: bool = True, identity: ModelIdentity | None = None, limits: ModelLimits | None = None) -> Model:
    """A stored model; refused unless its checks pass."""
    model = Model(*_members(spark, path))
    if checked:
        _refuse(integrity(spark, path, identity, limits))
    return model


def _members(spark: SparkSession, path: str) -> tuple[DataFrame, Features, DataFrame]:
    items, idf, vectors, popular = (spark.read.parquet(f"{path}/{name}") for name in MEMBERS)
    return items, Features(idf, vectors), popular


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's row."""
    return spark.read.parquet(f"{path}/manifest")


def integrity(spark: SparkSession, path: str, identity: ModelIdentity | None = None, limits: ModelLimits | None = None) -> DataFrame:
    """(rule, passed) of a stored model, from aggregates over its tables."""
    return _checks(Model(*_members(spark, path)), inspect(spark, path), identity or ModelIdentity(), limits or ModelLimits())


def _checks(model: Model, manifest: DataFrame, identity: ModelIdentity, limits: ModelLimits) -> DataFrame:
    counts = summary(model).select(*[F.col(c).alias(f"now_{c}") for c in ("items", "terms", "weights")])
    square = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w * w)
    odd = F.exists("weights", lambda w: ~((w >= 0) & (w < float("inf"))))
    order = F.transform("numbers", lambda n, i: F.get("numbers", i + 1) > n)
    # numbers rise, so that none is there twice; no weight lacks its number
    uneven = F.size("numbers") != F.size("weights")
    per_row = model.features.vectors.select("slug", (F.abs(F.sqrt(square) - 1) > 1e-9 + 1e-12).alias("off"), odd.alias("wild"), (F.exists(order, lambda x: ~x) | uneven).alias("twice"))
    rows = per_row.agg(F.count("*").alias("rows"), F.count_if("off").alias("norms"), F.count_if("wild").alias("wild"), (F.count_if("twice") + F.count("slug") - F.countDistinct("slug")).alias("twice"))
    idf = model.features.idf.agg(F.count_if(~(F.col("idf") >= 1)).alias("low_idf"))
    popular = model.popularity.agg(F.count("*").alias("popular"), F.count_if(~F.coalesce(F.col("popularity").between(0, 1), F.lit(False))).alias("out_of_range"))
    facts = manifest.crossJoin(counts).crossJoin(rows).crossJoin(idf).crossJoin(popular).crossJoin(fingerprint(model.items).withColumnRenamed("fingerprint", "now_fingerprint"))
    facts = facts.crossJoin(digests(model).toDF(*[f"digest_of_{n}" for n in MEMBERS]))
    config = json.dumps(asdict(identity), sort_keys=True, default=str)
    under = lambda column, limit: F.lit(True) if limit is None else F.col(column) <= limit
    rules = {
        "identity": (F.col("name") == identity.name) & (F.col("version") == identity.version),
        "config": F.col("config") == config,
        "counts": (F.col("items") == F.col("now_items")) & (F.col("terms") == F.col("now_terms")) & (F.col("weights") == F.col("now_weights")),
        "fingerprint": F.col("fingerprint") == F.col("now_fingerprint"),
        "digests": reduce(and_, [F.col(f"{n}_digest") == F.col(f"digest_of_{n}") for n in MEMBERS]),
        "unique_weights": F.col("twice") == 0,
        "finite_weights": F.col("wild") == 0,
        "unit_rows": F.col("norms") == 0,
        "complete_rows": (F.col("rows") == F.col("now_items")) & (F.col("popular") == F.col("now_items")),
        "idf_from_1": F.col("low_idf") == 0,
        "popularity_range": F.col("out_of_range") == 0,
        "sizes": under("now_items", limits.items) & under("now_terms", limits.terms) & under("now_weights", limits.weights),
    }
    listed = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(t, F.lit(False)).alias("passed")) for n, t in rules.items()])
    return facts.select(F.explode(listed).alias("r")).select("r.*")


def status(manifest: DataFrame | None, canonical: DataFrame, verdict: DataFrame) -> DataFrame:
    """One row (status, reason): ready, unavailable (catalog_invalid or catalog_stale) or
    not_configured, from a manifest, the canonical catalog and its verdict."""
    if manifest is None:
        return verdict.select(F.lit("not_configured").alias("status"), F.lit(None).cast("string").alias("reason"))
    now = fingerprint(canonical).withColumnRenamed("fingerprint", "now")
    reason = F.when(~F.col("valid"), "catalog_invalid").when(F.col("fingerprint") != F.col("now"), "catalog_stale")
    rows = manifest.select("fingerprint").crossJoin(now).crossJoin(verdict.select("valid")).withColumn("reason", reason)
    return rows.select(F.when(F.col("reason").isNull(), "ready").otherwise("unavailable").alias("status"), "reason")


def stale_items(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(slug, change) of items that differ: added, removed or changed."""
    return hash_tree.changes(*(hash_tree.held(hash_tree.tree(items)) for items in (stored, current)))
