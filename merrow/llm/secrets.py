"""Secret scans: fixed patterns, and a battery of randomness tests for everything else.

Runs of key-like characters are decoded to the symbols of the encoding that they suggest, and three
tests look at the symbols: chi-squared against a uniform alphabet, the runs (how seldom neighbours
are on different sides of it) and the serial correlation of neighbours. An alphabet's order is that
of its symbols' frequency in the table. How such values lie in ordinary writing is measured in the
same table: all of its words, with nothing between them and joined as names are, are cut into pieces
of each length, and the means and covariances of the three tests say how likely ordinary writing is
to look as random as a run. False discoveries are controlled over the whole table and separately by length, since long
runs show more: all runs of a length class are one family of tests.
"""

from __future__ import annotations

import re
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.llm.shared import arrow_map, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEY_LIKE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: Shortest length of each class.
LENGTHS = (20, 28, 40, 64)
#: Part of false finds among the random runs reported.
FALSE_RATE = 0.05
#: Equal parts of an alphabet that the chi-squared test counts.
PARTS = 4
#: Pieces of ordinary writing that a length and encoding needs for its runs to be judged.
LEAST_PIECES = 30
#: Levels of randomness: tenths of a standard deviation below ordinary writing.
MOST_LEVEL, STEPS = 400, 10

# The symbols of the encodings, in their order.
ALPHABETS = {
    "digits": b"0123456789",
    "letters": b"abcdefghijklmnopqrstuvwxyz",
    "base36": b"abcdefghijklmnopqrstuvwxyz0123456789",
    "base64": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
ENCODINGS = tuple(ALPHABETS)
#: Characters left in ordinary writing for each encoding; those that fold case are lower-cased first.
_DROPPED = {name: bytes(b for b in range(256) if b not in own or b in b"+/") for name, own in ALPHABETS.items()}
#: Ways to join ordinary words into names, told from running text in the widest encoding: camelCase
#: and snake_case (paths and kebab-case too, since the last two symbols are alike rare; CONSTANT_CASE
#: as well, since a run without small letters is lower-cased).
STYLES = ("camel", "snake")
#: What runs are held against: running text in each encoding, and joined words in the last one.
NULLS = (*ENCODINGS, *STYLES)
_WORD, _SMALL = re.compile(rb"[A-Za-z]+"), re.compile(rb"[a-z]")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_URL = bytes.maketrans(b"-_", b"+/")

SPAN_ARRAY = "array<struct<start:int,end:int,kind:int>>"
SPAN = T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False), T.StructField("kind", T.IntegerType(), False)])
TESTED = T.StructType([*[T.StructField(x, T.IntegerType(), False) for x in ("start", "end", "length_class", "encoding")], T.StructField("values", T.ArrayType(T.DoubleType(), False), False)])
#: Of each kind of writing and length: the number of pieces, the sums of the tests and of their products.
N_MOMENTS = 1 + 3 + 9
OUTPUTS = T.StructType([T.StructField("base", T.ArrayType(SPAN, False), False), T.StructField("tested", T.ArrayType(TESTED, False), False), T.StructField("ordinary", T.ArrayType(T.DoubleType(), False), False)])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start and then kind."""
    found = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], x[2]))


def encoding(run: bytes) -> str:
    """The encoding that a run's characters suggest: the smallest alphabet that has them all."""
    if run.isdigit():
        return "digits"
    if run.isalpha() and (run.islower() or run.isupper()):
        return "letters"
    if run.isalnum() and (run.islower() or run.isupper()):
        return "base36"
    return "base64"


def folded(text: bytes, name: str) -> bytes:
    return text if name == "base64" else text.translate(_LOWER)


def ranks(counts: np.ndarray) -> dict[str, np.ndarray]:
    """For each encoding, of every byte its place in the order of frequency (counts of bytes)."""
    out = {}
    for name, own in ALPHABETS.items():
        seen = counts.copy()
        if name != "base64":
            seen[97:123] += seen[65:91]
        symbols = np.frombuffer(own, np.uint8)
        place = np.zeros(256, np.uint8)
        place[symbols[np.argsort(-seen[symbols], kind="stable")]] = np.arange(len(symbols))
        out[name] = place
    return out


def battery(symbols: np.ndarray, size: int) -> np.ndarray:
    """The three tests of each row of symbols (places in the order of frequency in an alphabet of
    ``size``), each lower the more random: chi-squared over the alphabet's parts, the share of
    neighbours on one side of its middle, and the absolute serial correlation."""
    n = symbols.shape[1]
    part = (np.arange(size) * PARTS // size).astype(np.uint8)
    expected = n * np.bincount(part, minlength=PARTS) / size
    parts = part[symbols]
    square = sum(((parts == k).sum(1) - expected[k]) ** 2 / expected[k] for k in range(PARTS))
    side = parts >= PARTS // 2
    same = (side[:, 1:] == side[:, :-1]).mean(1)
    around = symbols.astype(np.float32)
    around -= around.mean(1, keepdims=True)
    serial = np.einsum("ij,ij->i", around[:, 1:], around[:, :-1]) / np.maximum(np.einsum("ij,ij->i", around, around), 1e-9)
    return np.stack([square, same, np.abs(serial) * np.sqrt(n)], 1)


def moments(texts: list[bytes], places: dict[str, np.ndarray]) -> np.ndarray:
    """The moments of ordinary writing in texts, for each of NULLS and each length. Pieces are cut
    within a text, so that they are the same however texts are dealt out."""
    out = np.zeros((len(NULLS), len(LENGTHS), N_MOMENTS))
    texts = [KEY_LIKE.sub(b" ", t) for t in texts]
    names = [b"/".join(_WORD.findall(t)).lower() for t in texts]
    for e, null in enumerate(NULLS):
        name = null if null in ENCODINGS else ENCODINGS[-1]
        if null == "camel":
            written = [b"".join([w.capitalize() for w in n.split(b"/")]) for n in names]
        elif null in STYLES:
            written = names
        else:
            written = [folded(t, name).translate(None, _DROPPED[name]) for t in texts]
        left, sizes = places[name][np.frombuffer(b"".join(written), np.uint8)], np.array([len(w) for w in written], np.int64)
        begins = np.cumsum(sizes) - sizes
        for k, length in enumerate(LENGTHS):
            n = sizes // length
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(begins, n) + step * length
            for start in range(0, len(at), 20_000):
                pieces = left[at[start : start + 20_000, None] + np.arange(length)]
                values = battery(pieces, len(ALPHABETS[name]))
                out[e, k] += np.concatenate([[len(values)], values.sum(0), (values.T @ values).ravel()])
    return out


def length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def scan_texts(texts: list[bytes | None], places: dict[str, np.ndarray]) -> list[pa.Array]:
    base, tested = [], []
    for raw in texts:
        text = raw.decode("utf-8", "replace") if raw else ""
        spans, runs, at, done, end = base_spans(text), [], 0, 0, 0
        for m in KEY_LIKE.finditer(raw or b""):
            start = end + len(raw[done : m.start()].decode("utf-8", "replace"))  # in code points
            done, end = m.end(), start + len(m[0])
            while at < len(spans) and spans[at][1] <= start:
                at += 1
            if any(s < end and e > start for s, e, _ in spans[at : at + 4]):
                continue
            body = m[0].rstrip(b"=").translate(_URL)
            name = encoding(body)
            body = folded(body, name) if _SMALL.search(body) else body.lower()
            known = places[name][np.frombuffer(body, np.uint8)]
            values = battery(known[None], len(ALPHABETS[name]))[0] if len(body) > 2 else np.zeros(3)
            runs.append({"start": start, "end": end, "length_class": length_class(end - start), "encoding": ENCODINGS.index(name), "values": values.tolist()})
        base.append([dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans])
        tested.append(runs)
    # the moments of all texts stand in the first row
    ordinary = [moments([t for t in texts if t], places).ravel().tolist(), *[[] for _ in texts[1:]]] if texts else []
    from pyspark.sql.pandas.types import to_arrow_schema

    return [pa.array(x, f.type) for x, f in zip((base, tested, ordinary), to_arrow_schema(OUTPUTS), strict=True)]


def byte_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often each byte stands in the texts of ``docs``."""
    counted = T.StructType([T.StructField("counts", T.ArrayType(T.LongType(), False), False)])

    def make():
        def work(texts):
            total = np.bincount(np.frombuffer(b"".join(t or b"" for t in texts), np.uint8), minlength=256)
            return [pa.array([total.tolist(), *[[] for _ in texts[1:]]] if texts else [], pa.list_(pa.int64()))]

        return work

    each = arrow_map(docs, text_col, counted, make, []).where(F.size("counts") > 0)
    return np.array(each.agg(*[F.coalesce(F.sum(F.get("counts", F.lit(k))), F.lit(0)) for k in range(256)]).first(), np.int64)


def chance(level: int) -> float:
    """How often ordinary writing is so random or more."""
    return NormalDist().cdf(-level / STEPS)


def levels_to_reach(counts: dict[tuple[int, int], int], rate: float = FALSE_RATE) -> list[int | None]:
    """For each length class the lowest level at which the expected false finds are at most
    ``rate`` of the finds (Benjamini and Hochberg's step-up rule on levels); None: no level is."""
    out: list[int | None] = []
    for which in range(len(LENGTHS)):
        own = sorted((lv, n) for (c, lv), n in counts.items() if c == which)
        total, found, reach = sum(n for _, n in own), 0, None
        for lv, n in reversed(own):
            found += n
            if lv and total * chance(lv) <= rate * found:
                reach = lv
        out.append(reach)
    return out


def _levels(ordinary: np.ndarray) -> Column:
    """The level of a tested run ``t``: its three tests, each in standard deviations from ordinary
    writing, added up, in standard deviations of that sum; 0 where ordinary writing is too little.
    A run of the widest encoding is held against joined words too, and has the lowest level."""
    known: list[list[tuple[float, ...] | None]] = []
    for e in range(len(NULLS)):
        known.append([])
        for k in range(len(LENGTHS)):
            n, total, products = ordinary[e, k, 0], ordinary[e, k, 1:4], ordinary[e, k, 4:].reshape(3, 3)
            if n < LEAST_PIECES:
                known[-1].append(None)
                continue
            mean = total / n
            spread = products / n - np.outer(mean, mean)
            scale = np.where(np.diag(spread) > 1e-12, 1 / np.sqrt(np.maximum(np.diag(spread), 1e-12)), 0.0)
            of_sum = float(np.sqrt(max(scale @ spread @ scale, 0.0))) or 1.0
            weight = scale / of_sum
            known[-1].append((*weight.tolist(), float(-weight @ mean)))

    def total(rows: list[tuple[float, ...] | None], none: float) -> Column:
        """By length class the sum of a run's tests against one kind of writing."""
        own = F.get(F.array(*[F.array(*map(F.lit, r or (0.0, 0.0, 0.0, none))) for r in rows]), F.col("t.length_class"))
        return sum((F.get(own, F.lit(k)) * F.get("t.values", F.lit(k)) for k in range(3)), F.get(own, F.lit(3)))

    # joined words of which there are too few say nothing
    widest = F.greatest(*[total(known[e], 0.0 if e < len(ENCODINGS) else float(-MOST_LEVEL)) for e in range(len(ENCODINGS) - 1, len(NULLS))])
    chosen = F.when(F.col("t.encoding") == len(ENCODINGS) - 1, widest)
    for e in range(len(ENCODINGS) - 1):
        chosen = chosen.when(F.col("t.encoding") == e, total(known[e], 0.0))
    return F.least(F.greatest(F.floor(-STEPS * chosen), F.lit(0)), F.lit(MOST_LEVEL)).cast("int")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_RATE) -> DataFrame:
    """One row for each row of ``docs``: the id and spans (array of start, end, kind; code points,
    end exclusive; kinds number KINDS), by start and then kind.

    Fixed patterns always stay. A random run is added where it doesn't overlap one and its tests
    pass the control over all runs of its length class in the table. What comes to the driver are
    256 counts of bytes, the moments of ordinary writing and counts by class and level, some
    thousand numbers whatever the table's size. In a table with too little ordinary writing no run
    is called random.

    A null or empty text has no spans. A text of any length is read whole, by tasks that hold about
    4 MB of texts, or one, at a time. Equal rows get equal results, each its own row; ties of start
    are by kind. An empty table gives no rows; other columns don't matter."""
    source = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    places = docs.sparkSession.sparkContext.broadcast(ranks(byte_counts(source.select("__text"), "__text")))

    def make():
        return lambda texts: scan_texts(texts, places.value)

    scanned = written(arrow_map(source, "__text", OUTPUTS, make, ["__row", "__id"]), "secrets")
    cells = len(NULLS) * len(LENGTHS) * N_MOMENTS
    sums = scanned.where(F.size("ordinary") > 0).agg(*[F.coalesce(F.sum(F.get("ordinary", F.lit(k))), F.lit(0.0)) for k in range(cells)])
    ordinary = np.array(sums.first()).reshape(len(NULLS), len(LENGTHS), N_MOMENTS)
    tested = scanned.select("__row", F.explode("tested").alias("t")).select("__row", "t.start", "t.end", "t.length_class", _levels(ordinary).alias("level"))
    tested = written(tested, "tested-runs")
    counts = {(r["length_class"], r["level"]): r["count"] for r in tested.groupBy("length_class", "level").count().collect()}
    needed = F.array(*[F.lit(MOST_LEVEL + 1 if r is None else r) for r in levels_to_reach(counts, rate)])
    random = tested.where(F.col("level") >= F.get(needed, F.col("length_class")))
    random = random.groupBy("__row").agg(F.collect_list(F.struct("start", "end", F.lit(KINDS.index("random")).alias("kind"))).alias("random"))
    both = scanned.select("__row", "__id", "base").join(random, "__row", "left")
    all_of = F.concat("base", F.coalesce("random", F.array().cast(SPAN_ARRAY)))
    by_place = F.sort_array(F.transform(all_of, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return both.select(F.col("__id").alias(id_col), F.transform(by_place, lambda s: F.struct(s["start"], s["end"], s["kind"])).alias("spans"))


def written_out(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs``, whose ids are unique, with each span of ``found`` replaced by ``mask``."""
    spans = found.select(id_col, F.col("spans").alias("__spans"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(F.col(text_col), done["at"] + 1, F.greatest(s["start"] - done["at"], F.lit(0)))
        return F.when(s["end"] <= done["at"], done).otherwise(F.struct(F.concat(done["out"], gap, F.lit(mask)).alias("out"), s["end"].alias("at")))

    def finish(done: Column) -> Column:
        return F.concat(done["out"], F.substring(F.col(text_col), done["at"] + 1, F.length(text_col)))

    masked = F.when(F.size("__spans") > 0, F.aggregate("__spans", start, step, finish)).otherwise(F.col(text_col))
    return docs.join(spans, id_col, "left").withColumn(text_col, masked).drop("__spans")
