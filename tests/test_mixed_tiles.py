"""Queries made of items' vectors: tiles that hold each of these once, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from merrow.operators import ranking, tiles
from merrow.operators.features import Features
from merrow.operators.ranking import Model
from merrow.schemas import CONTEXT
from merrow.scratch import written

NAMED = "array<struct<slug:string,name:string>>"
#: The vocabulary's first numbers are preferences, which items have too.
TERMS = {"genre_g0": 0, "genre_g1": 1, "tag_t0": 2, "genre_g0 tag_t0": 3}


def made(spark, n=40, many=60, size=9):
    """A model of random vectors, and these."""
    rng = np.random.default_rng(5)
    vectors = {}
    for i in range(n):
        own = sorted(rng.choice(many, min(many, size), replace=False).tolist())
        values = rng.random(len(own)) + 0.1
        vectors[f"s{i}"] = (own, (values / np.sqrt((values**2).sum())).tolist())
    popular = {s: float(rng.random()) for s in vectors}
    idf = spark.createDataFrame([(t, 1, 1.0 + k, k) for t, k in TERMS.items()], "term string, df long, idf double, number long")
    rows = [(s, f"Title {s}", [("g0", "G")], [("t0", "T")], [(f"p{i % 3}", "P")]) for i, s in enumerate(vectors)]
    items = written(spark.createDataFrame(rows, f"slug string, title string, genres {NAMED}, tags {NAMED}, platforms {NAMED}"), "items")
    own = written(spark.createDataFrame([(s, *v) for s, v in vectors.items()], "slug string, numbers array<long>, weights array<double>"), "vectors")
    table = spark.createDataFrame([*popular.items()], "slug string, popularity double")
    return Model(items, Features(written(idf, "idf"), own), written(table, "popularity")), vectors


def dense(vector, many=60):
    out = np.zeros(many)
    out[vector[0]] = vector[1]
    return out


def unit(x):
    return x / np.linalg.norm(x) if np.linalg.norm(x) else x


def liked(genres, tags):
    words = [f"genre_{g}" for g in sorted(genres)] + [f"tag_{t}" for t in sorted(tags)]
    out = np.zeros(60)
    for t in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
        if t in TERMS:
            out[TERMS[t]] += 1.0 + TERMS[t]
    return out


ASKED = [
    *((["s1", "s2", "s3"], ["g0"], ["t0"], ["p0"], 4), (["s1"], [], [], ["p1", "p2"], 3), ([], ["g1"], [], [], 5)),
    *((["s1", "nowhere"], [], [], [], 3), (["nowhere"], ["g0"], [], [], 3), (["s4", "s5"], ["unknown"], [], [], 3), (["nowhere"], [], [], [], 3)),
    *(([f"s{k}", f"s{(k * 7) % 40}"], ["g0"] if k % 2 else [], [], ["p1"], 2 + k % 5) for k in range(6, 30)),
]


@pytest.mark.parametrize("sizes", [(2_000_000, 8_000, 50_000, 500_000), (50, 8_000, 50_000, 60), (2_000_000, 5, 0, 7)])
def test_mixed_queries(spark, monkeypatch, sizes):
    for name, value in zip(("QUERY_ENTRIES", "QUERIES", "MOST_ASKED", "CELLS"), sizes, strict=True):
        monkeypatch.setattr(tiles, name, value)
    model, vectors = made(spark)
    contexts = written(spark.createDataFrame([(i, *row) for i, row in enumerate(ASKED)], CONTEXT), "contexts")
    want = {}
    for i, (picked, genres, tags, _, _) in enumerate(ASKED):
        own, other = sum((dense(vectors[s]) for s in picked if s in vectors), np.zeros(60)), liked(genres, tags)
        if (genres or tags) and not other.any():
            continue
        mixed = unit(unit(own) * (0.65 if genres or tags else 1) + unit(other) * (0.35 if picked else 1))
        for s, v in vectors.items():
            units = round(float(mixed @ dense(v)) * 1e6)
            if units > 0 and s not in picked:
                want[(i, s)] = units
    got = {(r.context_id, r.slug): r.content_units for r in ranking.score_candidates(contexts, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)
    best = lambda rows: sorted(map(tuple, ranking.top_ranked(rows, contexts).select("context_id", "rank", "slug", "base_units").collect()))
    assert best(ranking.best_candidates(contexts, model)) == best(ranking.score_candidates(contexts, model))


def test_evidence_by_products_of_the_tiles(spark):
    model, _ = made(spark)
    contexts = written(spark.createDataFrame([(i, *row) for i, row in enumerate(ASKED)], CONTEXT), "contexts")
    shown = lambda near: sorted(ranking.with_evidence(written(ranking.top_ranked(ranking.best_candidates(contexts, model, near=near), contexts), "ranked"), contexts, model).select("context_id", "slug", F.to_json("similar").alias("s"), F.to_json("reasons").alias("r")).collect())
    with_near = shown(True)
    assert with_near == shown(False) and any(r.s != "[]" for r in with_near)


def test_vectors_are_shuffled_by_tile_and_not_by_query(spark):
    from tests.test_tiles import shuffled

    model, _ = made(spark, n=30, many=4_000, size=3_000)
    sizes = []
    for n in (20, 400):
        rows = [(i, [f"s{i % 5}", f"s{5 + i // 5 % 5}", f"s{10 + i // 25 % 16}"], [], [], [], 3) for i in range(n)]
        contexts = written(spark.createDataFrame(rows, CONTEXT), "contexts")
        sizes.append(shuffled(spark, lambda: ranking.best_candidates(contexts, model).write.format("noop").mode("overwrite").save()))
    assert sizes[1] < 3 * sizes[0]
