"""Quality rules: text measures, and lines that many documents of a host share.

Each text is read once: its measures and the hashes of its normalised lines go to a slim table.
Distinct documents are counted for each line of each host; lines above the limit are removed, and
a document that loses too many of its words that way is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merrow.llm.shared import bind, written

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
#: Most words in repeated 3-word windows, in hundredths.
MAX_REPEATED = 50
#: A line in more distinct documents of a host than this is removed.
MAX_DOCUMENTS = 20
#: Least part of a document's words that must be left, in hundredths.
MIN_LEFT = 50


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the array."""

    def count(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(run: Column) -> Column:
            def again(x: Column, k: Column) -> Column:
                near = (F.get(run, k - 1)["h"] == x["h"]) | (F.get(run, k + 1)["h"] == x["h"])
                return F.when(F.coalesce(near, F.get(run, k + 1)["h"] == x["h"], F.get(run, k - 1)["h"] == x["h"], F.lit(False)), x["i"])

            return F.sort_array(F.filter(F.transform(run, again), lambda i: i.isNotNull()))

        def covered(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - i, F.lit(3)))), F.lit(0), lambda n, x: n + x)

        found = bind(by_hash, lambda run: bind(places(run), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found)

    windows = bind(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    return bind(windows, count).cast("long")


def measures(text: Column) -> dict[str, Column]:
    """The measures of a text by name; all 0 for a null one."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), repeated_words(words).alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(WORD)))
    return {
        "__words": bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), GAP, " "))


def line_facts(text: Column) -> Column:
    """Hash and words of each line that has a word."""
    facts = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: bind(normal_line(x), lambda n: F.struct(F.when(n != "", F.xxhash64(n)).alias("hash"), F.size(F.split(n, " ")).alias("words"))))
    return F.filter(facts, lambda x: x["hash"].isNotNull())


def _common(line: DataFrame, max_documents: int) -> DataFrame:
    """(host, hash) of lines (host, hash, document) in more than ``max_documents`` documents of a host.

    Rows are dealt by all three columns first, so that a line of a third of all documents is
    counted in many tasks."""
    once = line.select("host", "hash", "document").distinct()
    return once.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") > max_documents).drop("n")


def _document(id_col: str) -> Column:
    """What counts as one document: rows of an id, or a row without one."""
    return F.coalesce(F.concat(F.lit("id:"), F.col(f"`{id_col}`").cast("string")), F.concat(F.lit("row:"), F.monotonically_increasing_id().cast("string")))


def without_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """``docs`` without the lines that ``judge`` counts in n_common_words; all other lines, those
    without a word too, stay as they are. A null text stays null, one that loses all lines is empty."""
    text, host = F.col(f"`{text_col}`"), F.col(f"`{host_col}`")
    line = docs.select(host.alias("host"), F.xxhash64(text).alias("digest"), _document(id_col).alias("document"), F.explode(line_facts(text)).alias("line"))
    line = written(line.select("host", "digest", "document", F.col("line.hash").alias("hash")).distinct(), "host-lines")
    common = _common(line, max_documents)
    on = line["host"].eqNullSafe(common["host"]) & (line["hash"] == common["hash"])
    lost = line.join(common, on, "left_semi").groupBy("host", "digest").agg(F.collect_set("hash").alias("__lost")).withColumnsRenamed({"host": "__h", "digest": "__d"})
    stays = lambda x: bind(normal_line(x), lambda n: (n == "") | ~F.array_contains("__lost", F.xxhash64(n)))
    left = F.when(F.col("__lost").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), stays), "\n"))
    out = docs.join(lost, host.eqNullSafe(F.col("__h")) & (F.xxhash64(text) == F.col("__d")), "left")
    return out.select(*[left.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_documents: int = MAX_DOCUMENTS, min_left: int = MIN_LEFT) -> DataFrame:
    """One row for each row of ``docs``: the id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_common_words (words in lines that more than ``max_documents`` documents of the
    host have), base_failed and kept.

    base_failed: under 50 words, or more than half of them in repeated 3-word windows. kept: not
    base_failed, and at least ``min_left`` hundredths of the words are outside common lines.
    Rows of equal id are one document, rows without an id one each. Rows without a host are of one
    host. A line of exactly ``max_documents`` documents stays, and so does a text with exactly
    ``min_left`` left. A null or empty text has no words and fails; a text of any length is read
    whole. Equal rows get equal verdicts, each its own row. An empty table gives no rows; other
    columns don't matter. ``without_common_lines`` returns the texts."""
    text = F.col(f"`{text_col}`")
    slim = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{host_col}`").alias("host"), _document(id_col).alias("document"), line_facts(text).alias("lines"), *[c.alias(n) for n, c in measures(text).items()])
    slim = written(slim.withColumn("row", F.monotonically_increasing_id()), "measures")
    line = slim.select("row", "host", "document", F.explode("lines").alias("line")).select("row", "host", "document", "line.*")
    common = _common(line, max_documents)
    on = line["host"].eqNullSafe(common["host"]) & (line["hash"] == common["hash"])
    lost = line.join(common, on, "left_semi").groupBy("row").agg(F.sum("words").alias("lost"))
    out = slim.join(lost, "row", "left").select("__id", "__words.*", "n_symbols", "n_dup_lines", F.coalesce("lost", F.lit(0)).cast("long").alias("n_common_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    left = 100 * (F.col("n_words") - F.col("n_common_words")) >= min_left * F.col("n_words")
    return out.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words", failed.alias("base_failed"), (~failed & left).alias("kept"))
