"""Counting in chunks against brute force, and what it leaves on disk."""

import random
from collections import Counter
from math import log, sqrt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from merrow.operators import chunks, features
from merrow.scratch import run_folder, written


def documents():
    rng = random.Random(9)
    words = ["é", "ab", "été", "日本", *(f"w{i}" for i in range(50))]
    rows = [(f"d{i % 90}", " ".join(rng.choice(words[: 4 + i % 50]) for _ in range(rng.randint(0, 40)))) for i in range(100)]
    return [*rows, ("none", None), ("blank", ""), ("short", "a b c")]


def counted(text):
    own = [w for w in (text or "").split(" ") if len(w) > 1]
    return Counter([*own, *(f"{a} {b}" for a, b in zip(own, own[1:]))])


@pytest.mark.parametrize("chunk, bucket", [(4_000_000, 16_000_000), (60, 300), (1, 50)])
def test_any_chunks_and_buckets(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(chunks, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(chunks, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(features, "MOST_TERMS_TOLD", 0)
    rows = documents()
    docs = written(spark.createDataFrame(rows, "slug string, document string").repartition(3), "texts")
    df = Counter(t for _, text in rows for t in counted(text))
    want = Counter()
    for slug, text in rows:
        raw = {t: (1 + log(n)) * (log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in counted(text).items()}
        want.update((slug, t, round(x / sqrt(sum(y * y for y in raw.values())), 9)) for t, x in raw.items())
    assert Counter((r.slug, r.term, round(r.weight, 9)) for r in features.term_weights(docs).collect()) == want
    found = chunks.counted(docs, len(rows), 5_000)
    known = found.frequencies.collect()
    assert {r.term: r.df for r in known} == dict(df) and len(known) == len({r.number for r in known}) == len(df)
    name = {r.number: r.term for r in known}
    vectors = features._vectors(found, docs.schema["slug"]).collect()
    assert all(r.numbers == sorted(set(r.numbers)) for r in vectors)
    assert Counter((r.slug, name[n], round(w, 9)) for r in vectors for n, w in zip(r.numbers, r.weights)) == want


def test_a_fit_leaves_its_two_tables_and_no_shuffle(spark):
    from merrow.plans import queries
    from merrow.sources.views import Views

    folder = Path(run_folder(spark).removeprefix("file:"))
    items = written(Views(spark, "/root/testdata/sf0.001").nested_items(), "items")
    statuses = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    tables, shuffles = set(folder.glob("*")), statuses()
    found = features.settled(features.fit(items))
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - tables)
    # the one-row aggregate of sizes isn't a write and may leave its shuffle to the garbage collection
    assert left == ["idf", "vectors"] and statuses() <= shuffles + 1
    assert found.vectors.count() > 0 and found.idf.select(F.min("idf")).first()[0] >= 1
    assert queries.QUERIES["model_integrity"](spark, "/root/testdata/sf0.001").where("not passed").count() == 0
