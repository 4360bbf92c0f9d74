"""Importance resampling and vector codes against brute force, with odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from merrow.llm import vector_codes
from merrow.llm.resample import bucket_counts, resample, words_of
from merrow.llm.vector_codes import compress, hex_codes, integers, nearest

SF = "/root/testdata/sf0.001"


def brute_features(text, order):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, order=1, buckets=10_000, seed=2024, least=20, percent=10):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    raw = Counter(bucket(f) for _, t in docs for f in brute_features(t, order)[1])
    want = Counter(bucket(f) for t in target for f in brute_features(t, order)[1])
    s_all, t_all, rows = sum(raw.values()), sum(want.values()), []
    for key, text in docs:
        words, found = brute_features(text, order)
        weight = sum(math.floor(1000 * math.log((want[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((key, len(found), weight, score, len(words) >= least))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = [(r[:4], i + 1 if i < percent * len(drawn) // 100 else None) for i, r in enumerate(drawn)]
    ranks += [(r[:4], None) for r in rows if not r[4]]
    return sorted(((*r, rank) for r, rank in ranks), key=str)


def test_op11_query(spark):
    from merrow.llm.queries import QUERIES

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op11_resample"](spark, SF).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str) == brute_resample(docs, target)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_resample_odd_rows(spark, order):
    long = " ".join(f"Word{i % 701} ÄÖ{i % 13}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, "One two\x00THREE one two three"), (3, "other text"), (None, "one two"), (5, long), (6, "one-two three")] + [(9, "the same words")] * 9
    target = [None, "", "one two three", "word7 word8"]
    table = spark.createDataFrame([(*d, 7, "x") for d in docs], "doc_id long, text string, weight int, __id string").repartition(3)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(table, items, order=order, buckets=50, least_words=2, percent=40)
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "__id", "n_words", "n_features", "weight", "score", "rank"]
    want = brute_resample(docs, target, order, 50, least=2, percent=40)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows), key=str) == want
    assert resample(table.where("false"), items).collect() == []
    assert all(r["rank"] is None for r in resample(table.where("doc_id < 3"), items.where("false")).collect())


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary(), pa.string()])
def test_words_of_slices(kind):
    texts = ["a b"] * 3 + ["Ä X", "y\x00Z", "", "tail"]
    flat, n_words = words_of(pa.array([t.encode() for t in texts], pa.binary()).cast(kind).slice(3, 3))
    assert flat.to_pylist() == ["Ä", "x", "y", "z"] and n_words.tolist() == [2, 2, 0]


def test_counts_of_batches_cut_in_parts(spark):
    # one batch of more than the 4 MB that are worked on at once
    texts = [" ".join(f"Word{i % 97} other{k}" for i in range(130_000)) for k in range(4)]
    want = Counter(zlib.crc32(f.encode()) % 500 for t in texts for f in brute_features(t, 1)[1])
    got = bucket_counts(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), buckets=500)
    assert got.tolist() == [want[b] for b in range(500)]


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dims]
    width = -(-dims // parts)
    cut = []
    for _, v, _ in kept:
        whole = [max(-(1 << 26), min(1 << 26, math.floor(256 * x))) for x in v] + [0] * (parts * width - dims)
        cut.append([whole[p * width : (p + 1) * width] for p in range(parts)])
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def pick(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return min(range(len(d)), key=lambda j: (d[j], j)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            near = [pick(c[p], books[p])[0] for c in cut]
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, near) if k == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    out, sums = [], Counter()
    for (key, _, lab), c in zip(kept, cut):
        near = [pick(c[p], books[p]) for p in range(parts)]
        out.append((key, "".join(f"{k:02x}" for k, _ in near), sum(d for _, d in near), lab))
        sums[lab] += out[-1][2]
    return sorted(((k, c, e, sums[lab], digest) for k, c, e, lab in out), key=str)


def test_op13_query(spark):
    from merrow.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(400).collect()]
    few = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = compress(few).select("vec_id", hex_codes(F.col("codes")), "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_codes([(a, list(b), c) for a, b, c in rows], 16, 64, 2)
    whole = QUERIES["op13_vector_codes"](spark, SF)
    assert whole.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert whole.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()


@pytest.mark.parametrize("leaves", [3, 8_192])
def test_codes_of_odd_rows(spark, monkeypatch, leaves):
    monkeypatch.setattr(vector_codes, "LEAVES", leaves)
    nan, inf = float("nan"), float("inf")
    rows = [(4, None, 1), (5, [1.0, None, 0.0, 0.0, 0.5], 1), (6, [nan, 0.0, 0.0, 0.0, 0.0], 2), (7, [inf, 0.0, 0.0, 0.0, 0.0], 2), (8, [], 1), (9, [1.0, 2.0], 3)]
    rows += [(1, [0.1, -0.2, 0.3, 1e9, 0.0], 1), (1, [0.1, -0.2, 0.3, -1e9, 0.0], None), (None, [0.1, 0.2, 0.3, 0.0, 1.0], None)]
    rows += [(2, [0.5] * 5, None)] * 6 + [(10 + i, [((i * k) % 11) / 10 for k in range(1, 6)], i % 3) for i in range(40)]
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, embedding array<double>, label int, codes string, __id int").repartition(3)
    got = compress(table, parts=2, entries=5, rounds=2).select("vec_id", hex_codes(F.col("codes")), "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_codes(rows, 2, 5, 2)
    assert compress(table.where("embedding is null")).collect() == [] and compress(table.where("false")).collect() == []


def test_nearest_shares_prefixes():
    own = integers(np.array([1.0, 2.0, 1.0, 2.5, 1.0, 2.0, -3.0, 0.0]), 4, 2, 1)[:, 0]
    leaves, of, times, best, error = nearest(own, np.array([[256, 512], [256, 512], [0, 0]]))
    assert leaves.tolist() == [[-768, 0], [256, 512], [256, 640]] and of.tolist() == [1, 2, 1, 0]
    assert times.tolist() == [1, 2, 1] and best.tolist() == [2, 0, 0] and error.tolist() == [768**2, 0, 128**2]
