"""Text expressions: normalisation, folding, tokens, content documents, redaction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.config import FEATURES, FeatureConfig


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _folded(texts: pd.Series) -> pd.Series:
    def fold(text: str) -> str:
        if text.isascii():
            return text.lower()
        lowered = unicodedata.normalize("NFKC", text).lower()
        return "".join(c for c in unicodedata.normalize("NFKD", lowered) if not unicodedata.combining(c))

    return texts.map(fold, na_action="ignore")


def normalize_text(text: Column) -> Column:
    """NFKC, all white space runs as one space, trimmed. A blank text becomes empty. The four
    separators from U+001C on are white space too."""
    spaced = F.regexp_replace(nfkc(text), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.trim(spaced)


def blank(text: Column) -> Column:
    """Whether a required text is missing."""
    return F.coalesce(normalize_text(text), F.lit("")) == ""


def fold_words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, accents dropped, joined by one space."""
    return F.array_join(F.regexp_extract_all(F.coalesce(_folded(text), F.lit("")), F.lit("([a-z0-9]+)")), " ")


def field_token(prefix: str, slug: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.translate(slug, "-", "_"))


def _studio_token(prefix: str, name: Column) -> Column:
    """One token for a studio; only the prefix if its name has no ASCII letter or digit."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(prefix + "_"), F.translate(fold_words(name), " ", "_")))


def content_document(config: FeatureConfig = FEATURES, title: str = "title", description: str = "description", developer: str = "developer", publisher: str = "publisher", genres: str = "genres", tags: str = "tags") -> Column:
    """The weighted document of a nested item; platforms don't take part."""

    def many(prefix: str, named: str, times: int) -> Column:
        return F.flatten(F.transform(F.coalesce(F.col(named), F.array().cast("array<struct<slug:string,name:string>>")), lambda x: F.array_repeat(field_token(prefix, x["slug"]), times)))

    parts = [
        F.array_repeat(fold_words(F.col(title)), config.title),
        many("genre", genres, config.genre),
        many("tag", tags, config.tag),
        F.array_repeat(_studio_token("developer", F.col(developer)), config.developer),
        F.array_repeat(_studio_token("publisher", F.col(publisher)), config.publisher),
        F.array_repeat(fold_words(F.col(description)), config.description),
    ]
    return F.array_join(F.filter(F.flatten(F.array(*parts)), lambda x: x != ""), " ")


def preference_document(genres: Column, tags: Column) -> Column:
    token = lambda prefix, slugs: F.transform(F.array_sort(slugs), lambda s: field_token(prefix, s))
    return F.array_join(F.concat(token("genre", genres), token("tag", tags)), " ")


def terms(document: Column) -> Column:
    """Tokens of two characters or more, then the pairs of neighbours among them."""
    tokens = F.filter(F.split(document, " "), lambda t: F.length(t) >= 2)

    def with_pairs(own: Column) -> Column:
        pairs = F.transform(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), lambda t, i: F.concat_ws(" ", t, F.get(own, i + 1)))
        return F.concat(own, pairs)

    return F.element_at(F.transform(F.array(tokens), with_pairs), 1)


# The secrets that log redaction knows, and what replaces each.
REDACTIONS = (
    (r"(?iU)\b(postgresql(?:\+[a-z0-9_-]+)?://[^:\s/@]+:)([^@\s/]+)(@)", "$1***$3"),
    (r"(?iU)\b(password|passwd|pwd|secret|token|csrf)(\s*[=:]\s*)([^\s,;]+)", "$1$2***"),
    (r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{43}(?![A-Za-z0-9_-])", "***"),
)


def redact(text: Column) -> Column:
    for pattern, replacement in REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text
