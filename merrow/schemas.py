"""The declared schemas; none is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

NAMED = T.StructType([T.StructField("slug", T.StringType()), T.StructField("name", T.StringType())])
NAMED_LIST = T.ArrayType(NAMED)

ITEM = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("external_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("slug", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("release_date", T.DateType()),
        T.StructField("developer", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("average_rating", T.DecimalType(4, 2)),
        T.StructField("rating_count", T.IntegerType()),
        T.StructField("popularity_score", T.DecimalType(10, 4)),
        T.StructField("cover_image_url", T.StringType()),
    ]
)

NESTED_ITEM = T.StructType([*ITEM, *[T.StructField(k, NAMED_LIST) for k in ("genres", "tags", "platforms")]])

_slugs = T.ArrayType(T.StringType())
SEED = T.StructType(
    [
        T.StructField("provenance", T.StructType([T.StructField("source", T.StringType()), T.StructField("created_at", T.DateType()), T.StructField("license", T.StringType()), T.StructField("limitations", T.StringType())])),
        T.StructField("taxonomies", T.StructType([T.StructField(k, T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("slug", T.StringType())]))) for k in ("genres", "tags", "platforms")])),
        T.StructField("games", T.ArrayType(T.StructType([*[f for f in ITEM if f.name not in ("id", "cover_image_url")], *[T.StructField(f"{k}_slugs", _slugs) for k in ("genre", "tag", "platform")], T.StructField("cover_image_url", T.StringType())]))),
    ]
)

CONTEXT = T.StructType([T.StructField("context_id", T.LongType()), *[T.StructField(k, _slugs) for k in ("selected", "genres", "tags", "platforms")], T.StructField("top_k", T.IntegerType())])

FEEDBACK = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("slug", T.StringType()),
        T.StructField("reaction", T.StringType()),
        T.StructField("reaction_at", T.TimestampNTZType()),
        T.StructField("played", T.BooleanType()),
        T.StructField("wishlisted", T.BooleanType()),
        T.StructField("rating", T.DecimalType(5, 2)),
        T.StructField("rating_at", T.TimestampNTZType()),
    ]
)

INTERACTION = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("interaction_type", T.StringType()),
        T.StructField("value", T.DecimalType(5, 2)),
        T.StructField("occurred_at", T.TimestampNTZType()),
        T.StructField("superseded_at", T.TimestampNTZType()),
    ]
)

PREFERENCE = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("preference_type", T.StringType()), T.StructField("value", T.StringType()), T.StructField("weight", T.DecimalType(4, 3))])
