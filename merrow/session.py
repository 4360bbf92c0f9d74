"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "merrow", master: str | None = None, **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``settings`` use ``__`` for the dots of a key."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=fixed | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
