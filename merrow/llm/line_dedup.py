"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of consecutive lines decides where a chunk of lines starts, so a
passage is cut alike wherever it stands and whatever precedes it. A line of many words is a
chunk of its own. A chunk of several lines, or of one such long line, that occurs again anywhere
in the table is removed, but for its first occurrence and only where its bytes are the same.

Chunks lose passages of a few short lines, whose first and last lines fall into chunks with foreign
neighbours. ``passages`` finds them: from each line forward and to each line backward, the least
run of two or more lines with over 50 words is hashed. Any repeated passage of over 50 words is the
union of such runs inside it, so all of its lines go, wherever chunks are cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merrow.llm.shared import bind, discard, is_small, small, written

#: Of the line pairs, one in so many starts a chunk.
DIVISOR = 3
LONG_LINE_WORDS = 50
#: A passage of more words than this goes where it is repeated.
PASSAGE_WORDS = 50

WORD = r"[^\x20\x09-\x0D]+"


def line_hash(line: Column) -> Column:
    """28 bits of a line; SQL engines agree on it."""
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def is_long(line: Column, long_words: int) -> Column:
    return F.when(F.length(line) < 2 * long_words - 1, F.lit(False)).otherwise(F.regexp_count(line, F.lit(WORD)) >= long_words)


def _cut(text: Column, divisor: int, long_words: int, make: Callable[[Column, Column, Column], Column]) -> Column:
    """``make`` of a text's lines, their marks, and the places of lines where a chunk starts."""

    def mark(line: Column) -> Column:
        # a long line is a chunk anyway, whatever its hash
        return bind(is_long(line, long_words), lambda long: F.struct(F.when(~long, line_hash(line)).alias("hash"), long.alias("long")))

    def starts(marks: Column) -> Column:
        def begins(i: Column) -> Column:
            here, before = F.get(marks, i), F.get(marks, i - 1)
            rolled = (before["hash"] * 31 + here["hash"]) % divisor == 0
            return (i == 0) | here["long"] | before["long"] | rolled

        return F.filter(F.sequence(F.lit(0), F.size(marks) - 1), begins)

    def cut(lines: Column) -> Column:
        return bind(F.transform(lines, mark), lambda marks: bind(starts(marks), lambda at: make(lines, marks, at)))

    return bind(F.split(text, "\n", -1), cut)


def chunks_of(text: Column, divisor: int = DIVISOR, long_words: int = LONG_LINE_WORDS) -> Column:
    """The chunks of a text in order: struct of text, lines, repeatable (whether a repetition counts)
    and at (the place of the first line)."""

    def build(lines: Column, marks: Column, at: Column) -> Column:
        def chunk(s: Column, k: Column) -> Column:
            lines_in = F.coalesce(F.get(at, k + 1), F.size(lines)) - s
            joined = F.array_join(F.slice(lines, s + 1, lines_in), "\n")
            counts = ((lines_in > 1) | F.get(marks, s)["long"]) & F.rlike(joined, F.lit(WORD))
            return F.struct(joined.alias("text"), lines_in.alias("lines"), counts.alias("repeatable"), s.alias("at"))

        return F.transform(at, chunk)

    return _cut(text, divisor, long_words, build)


def sizes_of(text: Column, divisor: int = DIVISOR, long_words: int = LONG_LINE_WORDS) -> Column:
    """How many lines and chunks a text has (struct of lines, chunks), without the chunks' texts."""
    return _cut(text, divisor, long_words, lambda lines, _, at: F.struct(F.size(lines).alias("lines"), F.size(at).alias("chunks")))


def runs_of(text: Column, words: int = PASSAGE_WORDS) -> Column:
    """The least runs of two or more lines with over ``words`` words, from each line that has a word
    forward and backward: struct of at (place of the first line), lines and hash."""

    def reach(counts: Column) -> Column:
        """How many of the lines it takes; null if all are too few. Words and lines are summed in one number."""
        enough = (words + 1) * 1000
        return F.aggregate(counts, F.lit(0).cast("long"), lambda n, w: F.when(n >= enough, n).otherwise(n + w * 1000 + 1), lambda n: F.when(n >= enough, (n % 1000).cast("int")))

    def find(lines: Column, worded: Column) -> Column:
        counts = F.transform(worded, lambda x: x["words"])
        # each of these lines has a word, so that words + 1 of them are enough; mostly few are
        forward = lambda i, most: reach(F.slice(counts, i + 1, most))
        backward = lambda i, most: reach(F.reverse(F.slice(counts, F.greatest(i - most + 1, F.lit(0)) + 1, F.least(i + 1, F.lit(most)))))
        at = lambda i: F.get(worded, i)["at"].cast("long")
        # place and number of lines in one number, whose duplicates are found by hash
        coded = lambda a, b: at(a) * 2147483648 + (at(b) - at(a) + 1)
        either = lambda way, i: F.coalesce(way(i, 6), way(i, words + 1))
        ahead = F.transform(worded, lambda _, i: bind(either(forward, i), lambda k: F.when(k > 1, coded(i, i + k - 1))))
        behind = F.transform(worded, lambda _, i: bind(either(backward, i), lambda k: F.when(k > 1, coded(i - k + 1, i))))

        def run(code: Column) -> Column:
            place, n = F.floor(code / 2147483648).cast("int"), (code % 2147483648).cast("int")
            return F.struct(place.alias("at"), n.alias("lines"), F.xxhash64(F.array_join(F.slice(lines, place + 1, n), "\n")).alias("hash"))

        return F.transform(F.array_distinct(F.array_compact(F.concat(ahead, behind))), run)

    def cut(lines: Column) -> Column:
        worded = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words"))), lambda x: x["words"] > 0)
        return bind(worded, lambda w: find(lines, w))

    return bind(F.split(text, "\n", -1), cut)


def _passages(base: DataFrame, gone: DataFrame) -> DataFrame:
    """(__i, __d, __runs): the runs (at, lines) of each text that stand before already, in another
    text or the same, and have a line that ``gone`` (__i, __d, __ranges: at and lines of chunks that
    go) leaves. In the text where a run stays, those that overlap its first place stay too."""
    key = ["__id", "__digest"]
    held = written(base.select(*key, F.explode(runs_of(F.col("__text"))).alias("r")).select(*key, "r.*"), "runs")
    repeated = written(held.groupBy("hash").agg(F.count("*").alias("n"), F.min("__id").alias("stays_in")).where("n > 1").drop("n"), "repeated-runs")
    told = small(repeated)
    first = F.min(F.struct("at", "lines")).over(Window.partitionBy(*key, "hash"))
    found = held.join(told, "hash").withColumn("home", F.col("__id").eqNullSafe(F.col("stays_in"))).repartition(*key).withColumn("first", first)
    found = found.withColumns({"stays": F.col("home") & (F.col("at") == F.col("first.at")), "goes": ~F.col("home") | (F.col("at") >= F.col("first.at") + F.col("first.lines"))})
    found = written(found.where("stays or goes").select(*key, "hash", "at", "lines", "stays"), "found-runs")
    discard(held, repeated)
    per = found.where("not stays").groupBy(*key).agg(F.collect_set(F.struct("at", "lines", "hash")).alias("w"))
    per = per.join(gone, per["__id"].eqNullSafe(gone["__i"]) & per["__digest"].eqNullSafe(gone["__d"]), "left")

    def marks(ranges: Column) -> Column:
        end = lambda k: F.coalesce(F.get(ranges, k - 1)["at"] + F.get(ranges, k - 1)["lines"], F.lit(0))
        return F.flatten(F.transform(ranges, lambda r, k: F.concat(F.array_repeat(F.lit(False), r["at"] - end(k)), F.array_repeat(F.lit(True), r["lines"]))))

    def left(gone_lines: Column) -> Column:
        of = lambda x: F.slice(gone_lines, x["at"] + 1, x["lines"])
        return F.filter("w", lambda x: ~((F.size(of(x)) == x["lines"]) & F.forall(of(x), lambda g: g)))

    ranges = F.sort_array(F.coalesce("__ranges", F.array().cast("array<struct<at:int,lines:int>>")))
    opened = written(per.select(*key, F.explode(bind(marks(ranges), left)).alias("x")).select(*key, "x.*", F.lit(False).alias("stays")), "open-runs")
    keep = found.where("stays").join(opened.select("hash").distinct(), "hash", "left_semi").select(*opened.columns)
    both = written(opened.unionByName(keep), "compared-runs")
    discard(found, opened)
    few = is_small(both)
    asked = both.groupBy(*key).agg(F.collect_set(F.struct("at", "lines", "hash", "stays")).alias("w")).select(F.col("__id").alias("__i"), F.col("__digest").alias("__d"), "w")
    asked = F.broadcast(asked) if few else asked
    same = F.col("__digest").eqNullSafe(F.col("__d")) & F.col("__id").eqNullSafe(F.col("__i"))
    body = bind(F.split("__text", "\n", -1), lambda lines: F.transform("w", lambda x: F.struct(x["hash"].alias("hash"), x["at"].alias("at"), x["lines"].alias("lines"), x["stays"].alias("stays"), F.array_join(F.slice(lines, x["at"] + 1, x["lines"]), "\n").alias("run"))))
    texts = written(base.join(asked, same).select(*key, F.explode(body).alias("x")).select(*key, "x.*"), "run-texts")
    stay = written(texts.where("stays").groupBy("hash").agg(F.min("run").alias("kept_run")), "kept-runs")
    equal = texts.where("not stays").join(small(stay), "hash").where("run = kept_run")
    runs = written(equal.groupBy(*key).agg(F.collect_set(F.struct("at", "lines")).alias("__runs")).select(F.col("__id").alias("__i"), F.col("__digest").alias("__d"), "__runs"), "gone-runs")
    discard(both, texts, stay)
    return runs


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, long_words: int = LONG_LINE_WORDS, passages: bool = False) -> DataFrame:
    """``docs`` with repeated chunks taken out of the texts, and the columns n_lines, n_chunks,
    n_removed_chunks and n_removed_lines. With ``passages``, the lines of repeated passages of over
    PASSAGE_WORDS words go as well, whatever chunks they are in; a line's first occurrence stays.

    The first occurrence, which stays, is the first one in the document of the smallest id.
    Chunks are found repeated by a 64-bit hash and counted before anything is gathered, so a
    chunk in a third of all documents is one row here; then the bytes of each are compared with
    those that stay, and unequal ones stay too.

    A null text stays null and has no lines; an empty one has one empty line. Rows of equal id
    count as one document in choosing what stays; where only rows without an id have a chunk, all
    of them keep it. A text of which all chunks go is empty; one of any length is cut whole. No rows give no rows. Columns named
    like the added ones are replaced; all others pass through.

    Tables on the way go as soon as nothing reads them again. With ``passages``, what is left for
    the result's plan are the lines that go; without, what they are worked out from."""
    added = ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")
    base = docs.drop(*added).withColumns({"__id": F.col(f"`{id_col}`"), "__text": F.col(f"`{text_col}`")}).withColumn("__digest", F.xxhash64("__text"))
    where = lambda c: [c["at"].alias("at"), c["lines"].alias("lines")] if passages else []
    hashed = F.transform(chunks_of(F.col("__text"), divisor, long_words), lambda c, i: F.struct(i.alias("place"), F.when(c["repeatable"], F.xxhash64(c["text"])).alias("hash"), *where(c)))
    held = written(base.select("__id", "__digest", F.explode(F.filter(hashed, lambda c: c["hash"].isNotNull())).alias("c")).select("__id", "__digest", "c.*"), "chunks")
    repeated = written(held.groupBy("hash").agg(F.count("*").alias("n"), F.min("__id").alias("stays_in")).where("n > 1").drop("n"), "repeated")
    told = small(repeated)
    found = held.join(told, "hash").groupBy("__id", "__digest").agg(F.sort_array(F.collect_set(F.struct("hash", "place", "stays_in"))).alias("__found"))
    going = F.transform(F.filter(F.transform("__found", _decided), lambda f: ~f["stays"]), lambda f: f["place"])

    cut = F.transform(chunks_of(F.col("__text"), divisor, long_words), lambda c, i: F.struct(i.alias("place"), F.when(c["repeatable"], F.xxhash64(c["text"])).alias("hash"), c["text"].alias("text")))
    texts = base.select("__id", "__digest", F.explode(F.filter(cut, lambda c: c["hash"].isNotNull())).alias("c")).select("__id", "__digest", "c.*").join(told, "hash")
    texts = written(texts, "repeated-texts")
    # written apart, so that a chunk of very many documents is joined in parts, or by broadcast
    stay = texts.where(F.col("__id").eqNullSafe(F.col("stays_in"))).groupBy("hash").agg(F.min(F.struct("place", "text"))["text"].alias("kept_text"))
    stay = written(stay, "kept-texts")
    unequal = written(texts.join(small(stay), "hash").where("text <> kept_text").select("__id", "__digest", "place").distinct(), "unequal")
    discard(texts, stay)
    gone = found.select(F.col("__id").alias("__i"), F.col("__digest").alias("__d"), going.alias("__gone"))
    if not unequal.isEmpty():
        spared = unequal.groupBy("__id", "__digest").agg(F.collect_set("place").alias("spared"))
        same = gone["__d"].eqNullSafe(spared["__digest"]) & gone["__i"].eqNullSafe(spared["__id"])
        gone = gone.join(spared, same, "left").select("__i", "__d", F.when(F.col("spared").isNull(), F.col("__gone")).otherwise(F.array_except("__gone", "spared")).alias("__gone"))
    gone = gone.where(F.size("__gone") > 0)
    if passages:
        places = held.select(F.col("__id").alias("i"), F.col("__digest").alias("d"), "place", "at", "lines").distinct()
        each = gone.select("__i", "__d", F.explode("__gone").alias("p"))
        match = each["__i"].eqNullSafe(places["i"]) & each["__d"].eqNullSafe(places["d"]) & (each["p"] == places["place"])
        spans = each.join(places, match).groupBy("__i", "__d").agg(F.collect_set(F.struct("at", "lines")).alias("__ranges"), F.sort_array(F.collect_set("p")).alias("__gone"))
        gone = written(spans, "gone-chunks")
        discard(held, repeated, unequal)
        runs = _passages(base, gone).select(F.col("__i").alias("i"), F.col("__d").alias("d"), "__runs")
        either = gone.join(runs, gone["__i"].eqNullSafe(runs["i"]) & gone["__d"].eqNullSafe(runs["d"]), "full_outer")
        # one side is there; its identifier may be null, its digest is not
        has = F.col("__d").isNotNull()
        none = F.array().cast("array<int>")
        spread = lambda c: F.flatten(F.transform(F.coalesce(c, F.array().cast("array<struct<at:int,lines:int>>")), lambda r: F.sequence(r["at"], r["at"] + r["lines"] - 1)))
        lines_of = F.array_distinct(F.concat(spread(F.col("__ranges")), spread(F.col("__runs"))))
        gone = either.select(F.when(has, F.col("__i")).otherwise(F.col("i")).alias("__i"), F.coalesce("__d", "d").alias("__d"), F.coalesce("__gone", none).alias("__gone"), lines_of.alias("__lines"))
    out = _joined(base, gone).withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    if passages:
        out = out.withColumn("__sizes", sizes_of(F.col("__text"), divisor, long_words))
        n_lines, n_chunks = F.col("__sizes.lines"), F.col("__sizes.chunks")
        out = out.withColumn("__lines", F.coalesce("__lines", F.array().cast("array<int>")))
        lines = F.split("__text", "\n", -1)
        kept = bind(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("__lines")), lambda i: F.get(x, i)), "\n"))
        text, lines_gone = F.when(F.size("__lines") == 0, F.col("__text")).otherwise(kept), F.size("__lines")
    else:
        out = out.withColumn("__cut", chunks_of(F.col("__text"), divisor, long_words))
        n_lines, n_chunks = F.aggregate("__cut", F.lit(0), lambda n, c: n + c["lines"]), F.array_size("__cut")
        stays = F.array_except(F.sequence(F.lit(0), F.size("__cut") - 1), F.col("__gone"))
        text = F.when(F.size("__gone") == 0, F.col("__text")).otherwise(F.array_join(F.transform(stays, lambda p: F.get(F.col("__cut"), p)["text"]), "\n"))
        lines_gone = F.aggregate("__gone", F.lit(0), lambda n, p: n + F.get(F.col("__cut"), p)["lines"])
    return out.select(
        *[text.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c not in added],
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(n_chunks, F.lit(0)).cast("long").alias("n_chunks"),
        F.size("__gone").cast("long").alias("n_removed_chunks"),
        lines_gone.cast("long").alias("n_removed_lines"),
    )


def _decided(f: Column, k: Column) -> Column:
    """A repeated chunk with whether it stays: the first of its hash in the document where that stays."""
    before = F.get(F.col("__found"), k - 1)["hash"]
    first = ~F.coalesce(before == f["hash"], F.lit(False))
    return F.struct(f["hash"], f["place"], (first & F.col("__id").eqNullSafe(f["stays_in"])).alias("stays"))


def _joined(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """``docs`` with the facts of each document, null where there are none."""
    return docs.join(facts, F.col("__digest").eqNullSafe(F.col("__d")) & F.col("__id").eqNullSafe(F.col("__i")), "left")
