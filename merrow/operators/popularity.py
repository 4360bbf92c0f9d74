"""The popularity baseline: Bayesian ratings and a signal, both scaled to their range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merrow.config import POPULARITY, PopularityConfig


def popularity(items: DataFrame, key: str = "slug", config: PopularityConfig = POPULARITY) -> DataFrame:
    """(key, popularity): 70 % weighted rating and 30 % popularity score, each min-max scaled.

    The mean rating is weighted by votes over rated items (a default without votes); an unrated
    item takes the mean. A constant range counts as one half. The catalog-wide numbers are two
    one-row aggregates; no window spans the catalog."""
    rated = F.col("average_rating").isNotNull()
    votes, rating = F.col("rating_count").cast("double"), F.col("average_rating").cast("double")
    base = items.select(F.col(key), rating.alias("rating"), votes.alias("votes"), F.col("popularity_score").cast("double").alias("signal"), rated.alias("rated"))
    total = F.sum(F.when(F.col("rated"), F.col("votes")))
    weighted = F.sum(F.when(F.col("rated"), F.col("rating") * F.col("votes")))
    mean = base.agg(F.when(total > 0, weighted / total).otherwise(F.lit(config.default_mean)).alias("mean"))
    prior = F.lit(float(config.prior_votes))
    own = F.coalesce("rating", "mean") / 10
    blended = F.col("votes") / (F.col("votes") + prior) * own + prior / (F.col("votes") + prior) * (F.col("mean") / 10)
    rows = base.crossJoin(F.broadcast(mean)).select(key, blended.alias("blended"), "signal")
    ranges = rows.agg(*[f(c).alias(f"{n}_{c}") for c in ("blended", "signal") for n, f in (("low", F.min), ("high", F.max))])

    def scaled(c: str) -> Column:
        low, high = F.col(f"low_{c}"), F.col(f"high_{c}")
        return F.when(high - low <= config.tolerance, F.lit(config.constant_value)).otherwise((F.col(c) - low) / (high - low))

    units = lambda share: round(share * 1_000_000)
    out = (scaled("blended") * units(config.rating_share) + scaled("signal") * units(config.signal_share)) / 1_000_000
    return rows.crossJoin(F.broadcast(ranges)).select(key, out.alias("popularity"))
