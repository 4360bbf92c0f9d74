"""Language identification in two levels: the family first, then the language within it.

Texts become hashed counts of byte 1- to 3-grams. Families are told apart by linear support
vector machines, one for each pair of families; within the family that wins, machines for each
pair of its languages vote. A model is fitted on a sample of bounded size per language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.llm.shared import arrow_map

UNKNOWN = "und"
#: Buckets that n-grams are hashed to, and rows per language that a model is fitted on at most.
BUCKETS = 1 << 14
ROWS_PER_LANGUAGE = 300
EPOCHS, COST = 15, 10.0
#: Languages that a model can learn; more distinct labels are taken for a broken column.
MOST_LANGUAGES = 200

# Language codes by family. A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "iranian": ("fa", "ku", "ps", "tg"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "austronesian": ("id", "jv", "mg", "ms", "tl"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
OUTPUTS = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language, language)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts_of(text: bytes) -> np.ndarray:
    """Hashed 1- to 3-gram counts of a text, ASCII letters lower-cased and other ASCII as spaces."""
    own = np.frombuffer(b" ".join([b"", *text.translate(_CLEAN).split(), b""]), np.uint8).astype(np.uint32)
    out = np.bincount(own, minlength=BUCKETS)
    two = own[:-1] << 8 | own[1:]
    for gram in (two + np.uint32(1 << 24), two[:-1] << 8 | own[2:]):
        out += np.bincount((gram * np.uint32(2654435761)) >> np.uint32(18), minlength=BUCKETS)
    return out


def features(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32)
    return x / max(float(np.sqrt(x @ x)), 1e-9)


def fit_pair(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge, no intercept), by dual
    coordinate descent in a fixed order."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(len(y), np.float32)
    diagonal = 1.0 / (2 * COST)
    scale = np.einsum("ij,ij->i", x, x) + diagonal
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            slope = y[i] * float(w @ x[i]) - 1 + diagonal * alpha[i]
            new = max(alpha[i] - slope / scale[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


@dataclass
class Choice:
    """Machines for each pair of some labels, as columns of the model's weights."""

    labels: list[str]
    columns: list[tuple[int, int, int]]

    def chances(self, margins: np.ndarray) -> np.ndarray:
        """For each label the mean chance over its pairs."""
        k = len(self.labels)
        if k == 1:
            return np.ones(1)
        out = np.zeros(k)
        for a, b, column in self.columns:
            p = 1 / (1 + np.exp(-6 * np.clip(margins[column], -50, 50)))
            out[a] += p
            out[b] += 1 - p
        return out / (k - 1)


@dataclass
class Model:
    families: Choice
    languages: dict[str, Choice]
    weights: np.ndarray

    @property
    def knows(self) -> bool:
        return bool(self.families.labels)

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.knows or not has_letter(text.decode("utf-8", "replace")):
            return UNKNOWN, 0.0
        margins = features(counts_of(text)) @ self.weights
        by_family = self.families.chances(margins)
        f = int(by_family.argmax())
        choice = self.languages[self.families.labels[f]]
        by_language = choice.chances(margins)
        k = int(by_language.argmax())
        return choice.labels[k], float(by_family[f] * by_language[k])


#: Counts of a text: the buckets that have any, and how many.
Sparse = tuple[np.ndarray, np.ndarray]


def dense(rows: list[Sparse]) -> np.ndarray:
    """The features of some rows."""
    out = np.zeros((len(rows), BUCKETS), np.float32)
    for own, (at, n) in zip(out, rows, strict=True):
        own[at] = n
        own[:] = features(own)
    return out


def fit(rows: list[tuple[str, Sparse]]) -> Model:
    """A model from (language, counts) rows, which stay sparse but for those of the pair that is
    fitted: 64 KB a row otherwise, for as many rows as all languages have."""
    by_language: dict[str, list[Sparse]] = {}
    for language, counts in rows:
        by_language.setdefault(language, []).append(counts)
    by_family: dict[str, list[str]] = {}
    for language in sorted(by_language):
        by_family.setdefault(family_of(language), []).append(language)
    weights: list[np.ndarray] = []

    def choose(labels: list[str], rows_of: dict[str, list[Sparse]]) -> Choice:
        columns = []
        for a in range(len(labels)):
            for b in range(a + 1, len(labels)):
                one, other = rows_of[labels[a]], rows_of[labels[b]]
                weights.append(fit_pair(dense(one + other), np.arange(len(one) + len(other)) < len(one)))
                columns.append((a, b, len(weights) - 1))
        return Choice(labels, columns)

    # the languages of a family in equal parts, as many rows as one language has at most
    pooled = {f: [x for own in of for x in by_language[own][: max(1, ROWS_PER_LANGUAGE // len(of))]] for f, of in by_family.items()}
    families = choose(sorted(by_family), pooled)
    languages = {f: choose(of, by_language) for f, of in by_family.items()}
    return Model(families, languages, np.stack(weights, 1) if weights else np.zeros((BUCKETS, 0), np.float32))


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from all learning: one in five, by the checksum of its id."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """A model of the languages in ``lang_col``, from documents that aren't held out.

    At most ``rows_per_language`` rows of each language are used, those with the smallest hashes of
    their id and text; their whole texts, of any length, are counted on the executors, and what
    comes to the driver is one row of at most BUCKETS counts for each. Rows without text, letter,
    language or id (a null id counts as held out) don't take part. Rows of equal id differ by text,
    and of equal rows as many are used as the bound allows. Without any rows the model knows no
    language; more than MOST_LANGUAGES labels are an error. Other columns don't matter."""
    known = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.col(f"`{lang_col}`").alias("__lang"))
    known = known.where(F.col("__lang").isNotNull() & F.col("__text").rlike(r"\p{L}") & ~held_out(F.col("__id")))
    known = known.withColumn("__draw", F.xxhash64("__id", "__text"))
    # of each language the draws of as many rows as are used, without their texts; a task keeps so
    # many of a language at most before anything is sent
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy("__draw"))
    lowest = known.select("__lang", "__draw").withColumn("__rank", rank).where(F.col("__rank") <= rows_per_language)
    ends = lowest.groupBy("__lang").agg(F.max("__draw").alias("__end")).limit(MOST_LANGUAGES + 1).collect()
    if len(ends) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    if not ends:
        return fit([])
    chosen = F.lit(False)
    for r in ends:
        chosen = chosen | ((F.col("__lang") == r["__lang"]) & (F.col("__draw") <= r["__end"]))
    # equal rows are drawn alike, so they are counted once more
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy("__draw", "__id", "__text"))
    sample = known.where(chosen).withColumn("__rank", rank).where(F.col("__rank") <= rows_per_language)
    cells = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType(), False), False), T.StructField("n", T.ArrayType(T.IntegerType(), False), False)])

    def make():
        def work(texts):
            counts = [counts_of(t or b"") for t in texts]
            at = [np.flatnonzero(c) for c in counts]
            pick = pa.list_(pa.int32())
            return [pa.array([a.astype(np.int32) for a in at], pick), pa.array([c[a].astype(np.int32) for c, a in zip(counts, at, strict=True)], pick)]

        return work

    # as Arrow: lists of Python integers would take some thirty times the bytes
    found = arrow_map(sample, "__text", cells, make, ["__lang", "__id"]).toArrow()
    names, ids = found.column("__lang").to_pylist(), found.column("__id").to_pylist()
    at, n = (found.column(c).combine_chunks() for c in ("at", "n"))
    rows = [(names[i], (at[i].values.to_numpy(), n[i].values.to_numpy()), str(ids[i])) for i in range(len(names))]
    # big-endian bytes are in the order of the numbers
    rows = [r[:2] for r in sorted(rows, key=lambda r: (r[0], r[2], r[1][0].astype(">u4").tobytes()))]
    return fit(rows)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1), from the whole text and nothing else.

    A text that is null, empty or has no letter is ``und`` with score 0, as is every text for a
    model that knows no language. Of labels with equal chances the first by name is taken. A text
    of any length is read whole, in parts of a task's batch of about 4 MB or itself. Equal rows get
    equal predictions, each its own row. Other columns pass through (those in ``keep``); ones named
    like the results are replaced. An empty table stays empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = held.value.predict

        def work(texts):
            found = [predict(t) for t in texts]
            return [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

        return work

    return arrow_map(docs, text_col, OUTPUTS, make, keep)
