"""Packed vectors and the tile join against brute force, with tiles and batches of any size."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from merrow.operators import features, packed, ranking, tiles
from merrow.scratch import written


def documents(spark, n=60):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"d{i}", " ".join(rng.choice(words[: 3 + i % 37]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return [*rows, ("none", None), ("blank", ""), ("short", "a b c")]


def brute_terms(document):
    own = [t for t in (document or "").split(" ") if len(t) >= 2]
    return Counter([*own, *(f"{a} {b}" for a, b in zip(own, own[1:]))])


def brute_weights(rows):
    counts = {slug: brute_terms(d) for slug, d in rows}
    df = Counter(t for c in counts.values() for t in c)
    out = {}
    for slug, c in counts.items():
        raw = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out |= {(slug, t): x / norm for t, x in raw.items()}
    return out, df


@pytest.mark.parametrize("told", [0, 7, 500_000])
def test_weights_of_any_vocabulary(spark, monkeypatch, told):
    monkeypatch.setattr(features, "MOST_TERMS_TOLD", told)
    rows = documents(spark)
    docs = spark.createDataFrame(rows, "slug string, document string").repartition(3)
    idf = written(features.vocabulary(docs), "idf")
    want, df = brute_weights(rows)
    by_number = idf.orderBy("number").collect()
    assert [(r.term, r.df) for r in by_number] == sorted(df.items(), key=lambda x: (-x[1], x[0]))
    assert [r.number for r in by_number] == list(range(1, len(df) + 1))
    vectors = written(features.vectors_of(docs, idf), "vectors")
    got = {(r.slug, r.term): r.weight for r in features.long_form(vectors, idf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert all(list(r.numbers) == sorted(set(r.numbers)) for r in vectors.collect())
    counted = {(r.slug, r.term): r.tf for r in features.term_counts(docs).collect()}
    assert counted == {(s, t): n for s, d in rows for t, n in brute_terms(d).items()}


def test_plans_shuffle_no_terms_of_rows(spark):
    docs = spark.createDataFrame(documents(spark), "slug string, document string")
    assert "Exchange" not in plan(packed.packed_counts(docs))
    assert plan(packed.document_frequencies(docs)).count("Exchange") == 1
    idf = written(features.vocabulary(docs), "idf")
    assert "Exchange" not in plan(features.vectors_of(docs, idf))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_products(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for i in range(200):
        a, b = ({int(k): float(rng.normal()) for k in rng.choice(30, rng.integers(0, 12), replace=False)} for _ in range(2))
        rows.append((i, sorted(a), [a[k] for k in sorted(a)], sorted(b), [b[k] for k in sorted(b)]))
        want[i] = sum(v * b.get(k, 0.0) for k, v in a.items())
    frame = spark.createDataFrame(rows, "id int, numbers array<long>, weights array<double>, other_numbers array<long>, other_weights array<double>")
    for r in packed.products(frame).collect():
        assert abs(r.product - want[r.id]) < 1e-12


def vector(rng, n=30):
    own = sorted(rng.choice(n, rng.integers(1, 10), replace=False).tolist())
    values = rng.random(len(own))
    return own, (values / np.sqrt((values**2).sum())).tolist()


def half_up(value):
    return int(value + 0.5)


def brute_best(queries, items, adjusted, cut=True):
    out = set()
    for key, top_k, numbers, weights, o_numbers, o_weights, wanted, picked, excluded, played in queries:
        own, other = dict(zip(numbers, weights)), dict(zip(o_numbers or [], o_weights or []))
        rows, supported = [], False
        for slug, i_numbers, i_weights, has, popular in items:
            units = lambda v: half_up(round(min(1.0, max(0.0, v)) * 1e6, 6))
            content = units(sum(w * own.get(n, 0.0) for n, w in zip(i_numbers, i_weights)))
            if content <= 0 or slug in picked:
                continue
            supported = True
            if slug in excluded:
                continue
            affinity = units(sum(w * other.get(n, 0.0) for n, w in zip(i_numbers, i_weights))) if o_numbers is not None else 0
            platform = units(len(set(has) & set(wanted)) / len(wanted)) if wanted else 0
            share = lambda u, w: (u * w + 500_000) // 1_000_000
            base = share(content, 800_000) + share(platform, 100_000) + share(popular, 100_000)
            before = share(base, 900_000) + share(affinity, 100_000) if o_numbers is not None else base
            final = share(before, 500_000) if slug in played else before
            order = (final, before, base, affinity, content, popular) if adjusted else (base, content, popular)
            rows.append((tuple(-x for x in order), slug, (key, slug, slug in played, o_numbers is not None, content, platform, popular, base, affinity)))
        rows.sort(key=lambda r: (r[0], r[1].encode()))
        out |= {r[2] for r in (rows[:top_k] if cut else rows)}
        if supported:
            out.add((key, None))
    return out


@pytest.mark.parametrize("sizes", [(4_000_000, 50_000_000, 2_000_000, 0.125), (40, 90, 1, 2.0), (60, 150, 37, 0.4)])
@pytest.mark.parametrize("adjusted", [False, True])
def test_best_items(spark, monkeypatch, sizes, adjusted):
    for name, value in zip(("QUERY_ENTRIES", "ITEM_ENTRIES", "CELLS", "DENSE_SHARE"), sizes, strict=True):
        monkeypatch.setattr(tiles, name, value)
    rng = np.random.default_rng(7)
    names = [f"item-{'é' if i % 5 else '~'}{i}" for i in range(40)]
    some = lambda k: rng.choice(names, k, replace=False).tolist()
    # the last few are equal but for their names
    items = [(n, *vector(rng), [f"p{j}" for j in range(3) if (i >> j) & 1], int(rng.integers(0, 1_000_001))) for i, n in enumerate(names)]
    items = [*items[:34], *[(n, *items[0][1:]) for n in names[34:]]]
    queries = []
    for k in range(12):
        profile = vector(rng) if k % 3 == 0 else ([], []) if k % 3 == 1 else (None, None)
        queries.append((k, int(rng.integers(1, 8)), *vector(rng), *profile, ["p0", "p2"][: k % 3], some(k % 4), some(k % 6), some(5)))
    asked = spark.createDataFrame(queries, "context_id int, top_k int, numbers array<long>, weights array<double>, other_numbers array<long>, other_weights array<double>, wanted array<string>, picked array<string>, excluded array<string>, played array<string>")
    table = spark.createDataFrame(items, "slug string, numbers array<long>, weights array<double>, has array<string>, popularity_units long")
    policy = tiles.Policy(feedback=tiles.FeedbackConfig() if adjusted else None)
    rows = tiles.best_items(asked, table, "context_id", policy)
    order = ("final_units", "pre_played_units", "base_units", "affinity_units", "content_units", "popularity_units") if adjusted else ("base_units", "content_units", "popularity_units")
    own = rows.where("slug is not null")
    if adjusted:
        from merrow.operators.feedback import with_adjustments

        own = with_adjustments(own.withColumns({"p": F.col("is_played"), "h": F.col("has_profile")}))
    best = ranking.top_ranked(own, asked, "context_id", order)
    flags = ("p", "h") if adjusted else ("is_played", "has_profile")
    got = {(r.context_id, r.slug, r[flags[0]], r[flags[1]], r.content_units, r.platform_units, r.popularity_units, r.base_units, r.affinity_units if r[flags[1]] else 0) for r in best.collect()}
    got |= {(r.context_id, None) for r in rows.where("slug is null").collect()}
    assert got == brute_best(queries, items, adjusted)
    every = tiles.best_items(asked, table, "context_id", tiles.Policy(policy.ranking, policy.feedback, cut=False))
    assert every.where("slug is not null").count() == len([r for r in brute_best(queries, items, adjusted, cut=False) if r[1] is not None])


def test_units_are_decimal():
    values = np.array([0.4200435, 5e-7, 1.0000002, -1.0, 0.0, 0.5, 0.1234565, 0.0000015, 0.9999995])
    assert tiles.units_of(values).tolist() == [420_044, 1, 1_000_000, 0, 0, 500_000, 123_457, 2, 1_000_000]


def test_no_scored_pair_is_shuffled(spark):
    """Without broadcasts, an exchange follows the tiles only for the rows that are among their best."""
    rng = np.random.default_rng(2)
    items = spark.createDataFrame([(f"i{k}", *vector(rng), [], 5) for k in range(300)], "slug string, numbers array<long>, weights array<double>, has array<string>, popularity_units long")
    none = [[], [], []]
    asked = spark.createDataFrame([(k, 3, *vector(rng, 12), None, None, [], *none) for k in range(9)], "context_id int, top_k int, numbers array<long>, weights array<double>, other_numbers array<long>, other_weights array<double>, wanted array<string>, picked array<string>, excluded array<string>, played array<string>")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = tiles.best_items(asked, items, "context_id", tiles.Policy())
        per_tile = rows.withColumn("part", F.spark_partition_id()).where("slug is not null").groupBy("part", "context_id").count()
        n_tiles = max(1, 2 * spark.sparkContext.defaultParallelism)
        assert rows.where("slug is not null").groupBy("context_id").count().agg(F.max("count")).first()[0] <= 3 * n_tiles
        assert per_tile.count() > 9 and plan(rows).count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled(spark, work):
    """Bytes that stages write to shuffles while ``work`` runs."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def total():
        stages = store.stageList(none, False, False, quantiles, none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    work()
    return total() - before


def test_items_are_shuffled_once_for_all_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = [(f"i{k}", *vector(rng, 3_000), [], 5) for k in range(3_000)]
    items = written(spark.createDataFrame(items, "slug string, numbers array<long>, weights array<double>, has array<string>, popularity_units long"), "items")
    asked = [(k, 3, *vector(rng, 3_000), None, None, [], [], [], []) for k in range(30)]
    asked = written(spark.createDataFrame(asked, "context_id int, top_k int, numbers array<long>, weights array<double>, other_numbers array<long>, other_weights array<double>, wanted array<string>, picked array<string>, excluded array<string>, played array<string>"), "asked")
    sizes = []
    for entries in (4_000_000, 10):
        monkeypatch.setattr(tiles, "QUERY_ENTRIES", entries)
        sizes.append(shuffled(spark, lambda: tiles.best_items(asked, items, "context_id", tiles.Policy()).write.format("noop").mode("overwrite").save()))
    assert sizes[1] < 2 * sizes[0]


def test_alike_rows(spark):
    rows = [(5, ["a"], None), (3, ["a"], None), (4, ["a"], []), (9, ["b"], None), (7, ["b"], None)]
    table = spark.createDataFrame(rows, "context_id int, selected array<string>, tags array<string>")
    members = ranking.alike(table, "context_id")
    assert sorted(map(tuple, members.collect())) == [(3, 3), (4, 4), (5, 3), (7, 7), (9, 7)]
    assert sorted(r.context_id for r in ranking.firsts(table, members, "context_id").collect()) == [3, 4, 7]
    made = spark.createDataFrame([(3, "x"), (7, "y")], "context_id int, slug string")
    assert sorted(map(tuple, ranking.for_all(made, members, "context_id").collect())) == [(3, "x"), (5, "x"), (7, "y"), (9, "y")]


def test_document_frequencies_are_summed_behind_the_shuffle_only(spark):
    docs = spark.createDataFrame(documents(spark), "slug string, document string")
    counted = packed.document_frequencies(docs)
    assert "Aggregate" not in plan(counted).split("Exchange")[1]
    want = Counter(t for _, d in documents(spark) for t in brute_terms(d))
    assert {r.term: r.df for r in counted.collect()} == dict(want)
