"""Constants of the scoring and feature policies. All weights are fixed-point units of a millionth."""

from __future__ import annotations

from dataclasses import dataclass, field

SCALE = 1_000_000


@dataclass(frozen=True)
class FeatureConfig:
    """How often each part of an item counts in its document."""

    title: int = 2
    genre: int = 3
    tag: int = 3
    developer: int = 1
    publisher: int = 1
    description: int = 1


@dataclass(frozen=True)
class PopularityConfig:
    prior_votes: int = 50
    default_mean: float = 5.0
    rating_share: float = 0.7
    signal_share: float = 0.3
    constant_value: float = 0.5
    tolerance: float = 1e-15


@dataclass(frozen=True)
class RankingConfig:
    content_weight: int = 800_000
    platform_weight: int = 100_000
    popularity_weight: int = 100_000
    selected_share: float = 0.65
    preference_share: float = 0.35
    most_similar: int = 3
    popular_from: int = 700_000
    most_selected: int = 5
    most_genres: int = 5
    most_tags: int = 10
    most_platforms: int = 6
    most_top_k: int = 20


@dataclass(frozen=True)
class FeedbackConfig:
    positive_rating: float = 7.0
    most_sources: int = 5
    base_weight: int = 900_000
    affinity_weight: int = 100_000
    played_factor: int = 500_000


@dataclass(frozen=True)
class ModelLimits:
    """Sizes beyond which a stored model counts as broken; None means no limit."""

    items: int | None = None
    terms: int | None = None
    weights: int | None = None


FEATURES, POPULARITY, RANKING, FEEDBACK = FeatureConfig(), PopularityConfig(), RankingConfig(), FeedbackConfig()
STATE_TYPES = ("liked", "disliked", "played", "wishlisted", "rated")


@dataclass(frozen=True)
class ModelIdentity:
    name: str = "merrow-content-tfidf"
    version: str = "1.0.0"
    features: FeatureConfig = field(default_factory=FeatureConfig)
    popularity: PopularityConfig = field(default_factory=PopularityConfig)
    ranking: RankingConfig = field(default_factory=RankingConfig)
