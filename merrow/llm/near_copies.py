"""N-gram Jaccard join: a grouped prefix join over word shingles.

Shingles have a global order: rare ones by hash, then those known to be frequent by their count.
Two sets whose similarity reaches the threshold share a shingle among the first few of each in
that order, so only those are joined on. Documents with equal sets are one node; nodes with equal
prefix and size form a group. Pairs of groups are filtered by the places of the shared shingle and
by size; only then are groups expanded to their nodes, which a sketch of parities filters again and
whole sets decide.

What is asked for is links' components. Each list of groups that share a shingle is first joined
to one of its groups only, the one with the most partners in all lists, which is linear; what that
doesn't bring into one component is then joined pair by pair. So a group of many near copies costs
its size, not its square. Of a list that is still long then, only pairs that share a second shingle
of the prefixes (one longer for that) are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.llm.components import components
from merrow.llm.shared import bounded_batches, discard, slices, small, written
from merrow.llm.shingles import parities, parities_differ, sequence_marks, shingle_sets, signatures

#: Shingles of distinct sets that a task counts at once, and from which count in these it reports one.
COUNTED_AT_ONCE, REPORTED_FROM = 2_000_000, 3
#: Frequent shingles that are told to all tasks at most (16 MB), and from which sum of counts. They
#: only decide the order, so what lies beyond the bound costs time and never a link.
MOST_FREQUENT, FREQUENT_FROM = 1_000_000, 16
#: Sets that a task remembers, to report none twice (16 bytes each).
REMEMBERED = 100_000
#: A list with more open groups than this, or with more pairs of an open and any other entry than one
#: task tests in some seconds, is joined by two shingles.
LONG_LIST, LONG_PAIRS = 1_000, 50_000_000
#: First shingles of a group that its rows carry, to take a pair where it meets first.
CARRIED = 4
#: A signature of more than one row in so many is joined by broadcast, so there are at most as many.
HOT_SHARE = 1_000


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(x, T.LongType()) for x in names]


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - -(-num * n // den) + 1


def _measured(docs: DataFrame, size: int) -> DataFrame:
    """Rows (id, n, hi, lo) for documents and (token, seen) for shingles that a task saw in several sets."""
    schema = T.StructType([docs.schema[0], *_long("n", "hi", "lo", "token", "seen")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fit = to_arrow_schema(schema)
        held, total, seen = [], 0, set()

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            many = counts >= REPORTED_FROM
            none = [pa.nulls(int(many.sum()), f.type) for f in fit][:4]
            found = [pa.array(tokens[many].view(np.int64)), pa.array(counts[many].astype(np.int64))]
            return pa.RecordBatch.from_arrays([*none, *found], schema=fit)

        for batch in slices(batches, 1):
            values, bounds = shingle_sets(batch.column(1), size)
            hi, lo = signatures(values, bounds)
            n = np.diff(bounds)
            for k, mark in enumerate(zip(hi.tolist(), lo.tolist(), strict=True)):
                if n[k] and mark not in seen:
                    seen.add(mark)
                    held.append(values[bounds[k] : bounds[k + 1]])
                    total += n[k]
                    if total >= COUNTED_AT_ONCE:
                        yield frequent()
                        held, total, seen = [], 0, set()
            # the slice's own array isn't kept beyond it
            held = [np.concatenate(held)] if held else []
            made = [pa.array(c) for c in (n.astype(np.int64), hi, lo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *[pa.nulls(len(n), pa.int64())] * 2], schema=fit)
        yield frequent()

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _prefixes(docs: DataFrame, size: int, num: int, den: int, frequent) -> DataFrame:
    """Rows (token, gid, n, place, often) of prefixes, and (gid, n, hi, lo, sketch) of the sets in groups.

    A prefix has one shingle more than pairs need to share one: with it, they share two. Its last
    place serves for nothing else, and the filter by place sees to that."""
    schema = T.StructType([*_long("token", "gid", "n", "place", "often", "hi", "lo"), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fit = to_arrow_schema(schema)
        tokens, counts = frequent.value
        sets, groups = set(), set()

        def rows(**columns) -> pa.RecordBatch:
            of = len(columns["gid"])
            return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(of, f.type)) for f in fit], schema=fit)

        for batch in slices(batches, 1):
            values, bounds = shingle_sets(batch.column(1), size)
            sketched, hi, lo = [], *signatures(values, bounds)
            near = np.minimum(np.searchsorted(tokens, values), max(len(tokens) - 1, 0))
            common = tokens[near] == values if len(tokens) else np.zeros(len(values), bool)
            picked, firsts, rare = [], [], []
            for k, mark in enumerate(zip(hi.tolist(), lo.tolist(), strict=True)):
                part = slice(bounds[k], bounds[k + 1])
                own = values[part]
                if not len(own) or mark in sets:
                    continue
                sets.add(mark)
                p = min(int(prefix_length(len(own), num, den)) + 1, len(own))
                late = np.flatnonzero(common[part])
                first = own[~common[part]][:p] if len(late) else own[:p]
                picked.append(k)
                rare.append(len(own) - len(late))
                if len(first) < p:
                    by_count = late[np.argsort(counts[near[part][late]], kind="stable")]
                    first = np.concatenate([first, own[by_count[: p - len(first)]]])
                firsts.append(first)
                sketched.append(parities(own))
            if not picked:
                continue
            sizes = np.fromiter(map(len, firsts), np.int64, len(firsts))
            all_of, at = np.concatenate(firsts), np.concatenate([[0], np.cumsum(sizes)])
            n = np.diff(bounds)[picked].astype(np.int64)
            gid = sequence_marks(all_of, at) ^ n
            yield rows(gid=pa.array(gid), n=pa.array(n), hi=pa.array(hi[picked]), lo=pa.array(lo[picked]), sketch=pa.array(sketched, pa.binary()))
            fresh = [k for k, g in enumerate(gid.tolist()) if g not in groups and not groups.add(g)]
            if len(sets) > REMEMBERED:
                sets.clear()
                groups.clear()
            if fresh:
                s = sizes[fresh]
                place = np.concatenate([np.arange(k) for k in s])
                token = np.concatenate([firsts[k] for k in fresh]).view(np.int64)
                often = (place >= np.repeat(np.array(rare)[fresh], s)).astype(np.int64)
                yield rows(token=pa.array(token), gid=pa.array(np.repeat(gid[fresh], s)), n=pa.array(np.repeat(n[fresh], s)), place=pa.array(place), often=pa.array(often))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _shared_size(n: str, m: str, num: int, den: int) -> str:
    """SQL for the least number of shared shingles at which sets of n and m reach the threshold."""
    return f"(({num} * ({n} + {m}) + {num + den - 1}) div {num + den})"


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """Whether groups that share a shingle at their places can hold a link, if it is the first that
    they share: what follows in each must be enough. This also bounds the sizes."""
    least = _shared_size(f"{a}.n", f"{b}.n", num, den)
    return F.expr(f"{a}.place <= {a}.n - {least} and {b}.place <= {b}.n - {least}")


def _before(place: str) -> Column:
    """The tokens in ``first`` that stand before a place."""
    return F.coalesce(F.transform(F.filter("first", lambda x: x["place"] < F.col(place)), lambda x: x["token"]), F.array().cast("array<long>"))


def _candidates(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of rows (a, b, n, m, one, other) whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            most = n + m + 2 * (-num * (n + m) // (num + den))
            differ = map(parities_differ, batch.column(4).to_pylist(), batch.column(5).to_pylist())
            keep = np.fromiter(differ, np.int64, len(batch)) <= most
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    kind = pairs.schema["a"].dataType
    return pairs.select("a", "b", "n", "m", "one", "other").mapInArrow(run, T.StructType([T.StructField(x, kind) for x in "ab"]))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, mark, shingles as bytes) of documents (node, text); the mark stands for the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            values, bounds = shingle_sets(batch.column(1), size)
            made = pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signatures(values, bounds)[0]), made], names=names)

    names = ["node", "mark", "shingles"]
    schema = T.StructType([T.StructField("node", docs.schema[0].dataType), *_long("mark"), T.StructField("shingles", T.BinaryType())])
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _verified(pairs: DataFrame, source: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold, from the texts in ``source``.

    The set of b travels with the pair to that of a, which is there once, however many pairs it has."""
    pairs = written(pairs.distinct(), "pairs")
    nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    texts = source.withColumnRenamed("id", "node").join(small(nodes), "node", "left_semi").select("node", "text")
    sets = written(_sets(texts, size).dropDuplicates(["node", "mark"]).drop("mark"), "shingles")
    links = written(_linked(pairs, sets, num, den), "links")
    for done in (pairs, nodes, sets):
        discard(done)
    return links


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = one.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").select("a", "b", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                both_in = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both_in >= num * (len(x) + len(y) - both_in))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, T.StructType([T.StructField(x, both.schema["a"].dataType) for x in "ab"]))


class _Join:
    """The tables of one join: rows (documents), members (nodes in groups), lists (groups that share
    a shingle, with the list's length) and hubs (one group of each list)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, num: int, den: int):
        self.size, self.num, self.den = size, num, den
        self.source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
        measured = written(_measured(self.source, size), "sets")
        self.rows = measured.where("n is not null").select("id", "n", "hi", "lo")
        found = written(_prefixes(self.source.where("id is not null"), size, num, den, self._frequent(measured)), "prefixes")
        copies = self.rows.where("n > 0 and id is not null").groupBy("hi", "lo").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
        self.reps = written(copies, "nodes")
        members = found.where("gid is not null and hi is not null").select("gid", "n", "hi", "lo", "sketch").dropDuplicates(["gid", "hi", "lo"])
        self.members = written(members.join(self.reps.drop("copies"), ["hi", "lo"]).drop("hi", "lo"), "members")
        head = F.min(F.struct("node", "n", "sketch")).alias("head")
        self.heads = self.members.groupBy("gid").agg(head, (F.count("*") > 1).alias("crowd")).select("gid", "head.*", "crowd")
        #: Whether a place can be that of the first shared shingle of a pair.
        self.leading = F.expr(f"{den} * place <= {den - num} * n")
        self.lists = written(self._lists(found), "lists")
        discard(found)

    def _frequent(self, measured: DataFrame):
        """The shingles seen most and their counts, by hash, told to all tasks."""
        seen = measured.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= FREQUENT_FROM)
        top = seen.orderBy(F.desc("seen"), "token").limit(MOST_FREQUENT).toArrow()
        tokens, counts = top.column("token").to_numpy().view(np.uint64), top.column("seen").to_numpy()
        order = np.argsort(tokens)
        return measured.sparkSession.sparkContext.broadcast((tokens[order], counts[order]))

    def _lists(self, found: DataFrame) -> DataFrame:
        """(token, gid, n, place, k): groups by shingle, for shingles of k > 1 groups. Rare ones are
        dealt out once; most stand in one group only, or in two whose sizes are too different.
        Those known to be frequent are counted without being brought together. A group that two
        tasks saw counts twice in k, which is then too large, but is one row."""
        posted = found.where("token is not null").select("token", "gid", "n", "place", "often")
        same = Window.partitionBy("token")
        counted = {"k": F.count("*").over(same), "low": F.min("n").over(same), "high": F.max("n").over(same)}
        shared = (F.col("k") > 2) | ((F.col("k") == 2) & (self.den * F.col("low") >= self.num * F.col("high")))
        rare = posted.where("often = 0").drop("often").withColumns(counted).where(shared).drop("low", "high")
        often = posted.where("often = 1").drop("often").dropDuplicates(["token", "gid"])
        many = F.broadcast(often.groupBy("token").agg(F.count("*").alias("k")).where("k > 1"))
        return rare.dropDuplicates(["token", "gid"]).unionByName(often.join(many, "token"))

    def stars(self) -> DataFrame:
        """Candidate pairs of each group with its lists' hubs, and of a group's nodes with its head."""
        weighed = self.lists.withColumn("weight", F.sum("k").over(Window.partitionBy("gid"))).where(self.leading)
        best = weighed.groupBy("token").agg(F.max(F.struct("weight", (-F.col("place")).alias("front"), "gid", "n")).alias("h"))
        self.hubs = written(best.select("token", "h.gid", "h.n", (-F.col("h.front")).alias("place")), "hubs")
        on = (F.col("l.token") == F.col("h.token")) & (F.col("l.gid") != F.col("h.gid")) & _may_link("l", "h", self.num, self.den)
        near = self.lists.where(self.leading).alias("l").join(self.hubs.alias("h"), on).select(F.col("h.gid").alias("hub"), F.col("l.gid").alias("gid")).distinct()
        near = near.unionByName(self.heads.where("crowd").select(F.col("gid").alias("hub"), "gid"))
        heads = self.heads.select(F.col("gid").alias("hub"), F.col("node").alias("a"), "n", F.col("sketch").alias("one"))
        of = self.members.select("gid", F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("other"))
        return _candidates(near.join(heads, "hub").join(of, "gid").where("a <> b"), self.num, self.den)

    def rest(self, roots: DataFrame) -> DataFrame:
        """Candidate pairs of different components, given (node, root), that no star has tested."""
        placed = written(self.members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
        classes = placed.groupBy("gid", "root").agg(F.min("n").alias("n"))
        head = self.heads.select("gid", "node", "crowd").join(placed.select("gid", "node", "root").distinct(), ["gid", "node"])
        head = head.select("gid", F.col("root").alias("hub_root"), "crowd")
        hubs = self.hubs.join(head, "gid").select("token", F.col("gid").alias("hub"), "hub_root", "crowd")
        # a hub that is one node has met all of its lists
        lists = self.lists.where(self.leading).join(hubs, "token").where("crowd or (k > 2 and gid <> hub)")
        within = head.where("crowd").select(F.col("gid").alias("token"), "gid", F.lit(0).cast("long").alias("place"), "hub_root")
        entries = lists.select(within.columns).unionByName(within).join(classes, "gid")
        entries = written(entries.withColumn("open", F.col("root") != F.col("hub_root")).drop("hub_root"), "entries")
        return self._expanded(self._open_pairs(entries), placed)

    def _open_pairs(self, entries: DataFrame) -> DataFrame:
        """Pairs (gid, root, other_gid, other_root) that share a token in entries (token, gid, n,
        place, root, open), one of them open at least and their roots different. An entry carries
        the first few of its group's tokens before its own (ahead): two entries that have one of
        them in common met there already, and not again here."""
        counts = entries.groupBy("token").agg(F.count_if("open").alias("k"), F.count("*").alias("all"))
        is_long = (F.col("k") > LONG_LIST) | (F.col("k") * F.col("all") > LONG_PAIRS)
        counts = written(counts.where("k > 0").select("token", "k", is_long.alias("long")), "open-lists")
        # with a threshold of a half or less, sets may link that share one shingle only
        split = F.col("long") if self.num * 2 > self.den else F.lit(False)
        rank = F.row_number().over(Window.partitionBy("gid").orderBy("place"))
        useful = entries.join(counts, "token")
        first = useful.where("token <> gid").select("gid", "place", "token").distinct().withColumn("rank", rank).where(F.col("rank") <= CARRIED)
        first = first.groupBy("gid").agg(F.collect_list(F.struct("place", "token")).alias("first"))
        useful = useful.withColumn("long", split).drop("k").join(first, "gid", "left")
        apart = F.expr("(l.gid <> r.gid or l.token = l.gid) and not arrays_overlap(l.ahead, r.ahead)")
        brief = useful.where("not long").withColumn("ahead", _before("place")).drop("first", "long")
        pairs = self._pairs(brief, ["token"], apart)
        if counts.where(split).isEmpty():
            return pairs
        then = self.lists.select("gid", F.col("token").alias("second"), F.col("place").alias("later"))
        by_two = useful.where("long and token <> gid").join(then, "gid").where("later > place")
        within = useful.where("long and token = gid").withColumns({"second": F.lit(0).cast("long"), "later": F.col("place")})
        by_two = by_two.unionByName(within).withColumns({"ahead": _before("place"), "between": F.array_remove(_before("later"), F.col("token"))})
        apart_twice = apart & F.expr("not arrays_overlap(l.between, r.between)")
        return pairs.unionByName(self._pairs(by_two.drop("first", "long", "later"), ["token", "second", "step"], apart_twice))

    def _pairs(self, entries: DataFrame, keys: list[str], apart: Column) -> DataFrame:
        """Pairs with equal keys. With the key ``step``, sizes in the same step or the next of the
        threshold's powers meet, so that a long list is split by size."""
        left, right = entries.where("open"), entries
        if "step" in keys:
            step = F.floor(F.log(F.col("n").cast("double")) / (1.0001 * float(np.log(self.den / self.num)))).cast("long")
            left = left.withColumn("step", F.explode(F.array(step - 1, step, step + 1)))
            right = right.withColumn("step", step)
        on = (F.col("l.root") != F.col("r.root")) & F.expr("not r.open or l.root < r.root") & _may_link("l", "r", self.num, self.den) & apart
        for key in keys:
            on = on & (F.col(f"l.{key}") == F.col(f"r.{key}"))
        found = left.alias("l").join(right.alias("r"), on)
        pair = {"gid": "l.gid", "root": "l.root", "other_gid": "r.gid", "other_root": "r.root"}
        return found.select(*[F.col(c).alias(name) for name, c in pair.items()])

    def _expanded(self, pairs: DataFrame, placed: DataFrame) -> DataFrame:
        one = placed.select("gid", "root", F.col("node").alias("a"), "n", F.col("sketch").alias("one"))
        other = {"gid": "other_gid", "root": "other_root", "node": "b", "n": "m", "sketch": "other"}
        both = pairs.distinct().join(one, ["gid", "root"]).join(placed.select(*[F.col(c).alias(name) for c, name in other.items()]), ["other_gid", "other_root"])
        return _candidates(both, self.num, self.den)

    def verified(self, pairs: DataFrame) -> DataFrame:
        return _verified(pairs, self.source, self.size, self.num, self.den)

    def by_row(self, of_set: DataFrame) -> DataFrame:
        """``rows`` with the columns of ``of_set`` (hi, lo, copies, ...). Sets with very many rows are
        few and broadcast, so that copies aren't brought together."""
        total = self.rows.count()
        hot = F.col("copies") > max(1, total // HOT_SHARE)
        common, usual = of_set.where(hot).drop("copies"), of_set.where(~hot).drop("copies")
        plain = self.rows.where("n = 0 or id is null")
        full = self.rows.where("n > 0 and id is not null")
        few = F.broadcast(common)
        spread = full.join(few, ["hi", "lo"]).unionByName(full.join(few, ["hi", "lo"], "left_anti").join(usual, ["hi", "lo"], "left"))
        return spread.unionByName(plain, allowMissingColumns=True)


def link_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each row of ``docs``: the id, n_shingles (size of its set) and component_id (the
    smallest id that links reach, its own included).

    A text's set: its distinct shingles of ``size`` words (between ASCII white space, ASCII
    letters lower-cased), compared by 64-bit hash; with fewer words, all of them as one. Two
    documents link when den * intersection >= num * union. Documents with equal sets are one
    node of the join (a 128-bit signature says so), however many they are.

    A null or empty text has no shingles and no links: it is its own component. A row without an
    id is counted, but takes part in no link and has no component. Rows of equal id are one
    document, linked by any of their texts. Ties don't occur: a root is
    the smallest id. A text of any length is one set, and takes about 40 bytes a word while it is
    made. An empty table gives no rows; other columns don't matter."""
    join = _Join(docs, id_col, text_col, size, num, den)
    roots = components(join.verified(join.stars()))
    more = join.verified(join.rest(roots))
    if not more.isEmpty():
        roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    of_set = join.reps.join(roots, "node", "left").select("hi", "lo", "copies", F.coalesce("root", "node").alias("root"))
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id")))
    return join.by_row(of_set).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def near_copy_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, as pairs (a, b) of nodes, and (id, node, n_links) of the
    documents: a node is the smallest id of those with one set, and n_links counts the documents of
    other nodes that a document links with. Copies of one text aren't written out as pairs.

    The same join without its short cut: every pair of a list is tested, whether or not its
    documents are in one component already. Nulls, empty texts and equal ids count as for
    ``link_near_copies``: a document without shingles is its own node, one without an id has none."""
    join = _Join(docs, id_col, text_col, size, num, den)
    apart = docs.sparkSession.createDataFrame([], T.StructType([T.StructField(x, join.rows.schema["id"].dataType) for x in ("node", "root")]))
    pairs = join.verified(join.stars()).unionByName(join.verified(join.rest(apart)))
    links = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "all-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = join.reps.select(F.col("node").alias("b"), "copies")
    n_links = both.join(copies, "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("n_links"))
    of_set = join.reps.join(n_links, "node", "left").select("hi", "lo", "copies", "node", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    node = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("node")).otherwise(F.col("id")))
    return links, join.by_row(of_set).select(F.col("id").alias(id_col), node.alias("node"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
