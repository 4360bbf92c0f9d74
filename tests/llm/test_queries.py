"""The registered queries against brute force on the smallest tables."""

import hashlib
import re
import zlib

import pytest

from tests.llm.test_operators import brute_base, brute_components, brute_hits

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    from merrow.llm.queries import QUERIES

    return {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}


def test_op1(spark, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for key, r in rows(spark, "op1_decontaminate").items():
        n, hits, names = brute_hits(texts[key], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hits, len(names), sha(",".join(names)), hits > 0 and 20 * hits >= n)


def test_op2(spark, texts):
    from tokenizers import Tokenizer

    from merrow.llm.queries import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path())
    got = rows(spark, "op2_bpe")
    assert len(got) == len(texts)
    for key, r in got.items():
        ids = library.encode(texts[key], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_op6(spark, texts):
    names = ("assign", "access", "hex", "random")
    total = 0
    for key, r in rows(spark, "op6_secrets").items():
        base = brute_base(texts[key])
        total += len(base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, _, k in base) for j in range(3)]
        written = [f"{names[k]}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == sha(",".join(written))
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == written
    assert total > 5


def test_op3_op8(spark, texts):
    for key, r in rows(spark, "op3_language").items():
        assert r.held_out == (zlib.crc32(str(key).encode()) % 5 == 0) and 0 <= r.score <= 1
    got = rows(spark, "op8_shards")
    assert {r.law for r in got.values()} == {"rows"} and {r.grown_shard for r in got.values()} == {None}
    assert sorted(r.slot * 24 + r.shard for r in got.values()) == list(range(len(texts)))


def test_op7(spark, texts):
    """Each row against greedy longest matches, word by word."""
    import public_tokenizers

    from merrow.llm.token_counts import vocabulary

    entries, seen = set(vocabulary(public_tokenizers.path("byte_bpe_50k.json"))), {}

    def pieces(word):
        n, i = 0, 0
        while i < len(word):
            i = next(k for k in range(len(word), i, -1) if word[i:k] in entries)
            n += 1
        return n

    for key, r in rows(spark, "op7_token_counts").items():
        counts = [seen.setdefault(w, pieces(b" " + w)) if w not in seen else seen[w] for w in (texts[key] or "").encode().split()]
        assert (r.n_words, r.n_tokens, r.most_in_word) == (len(counts), sum(counts), max(counts, default=0))


def test_op8_sizes(spark, texts):
    for key, r in rows(spark, "op8_shards").items():
        raw = (texts[key] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    counts = {}
    for r in rows(spark, "op8_shards").values():
        counts[r.shard] = counts.get(r.shard, 0) + 1
    assert len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 1


def test_op10(spark, texts):
    got = {k: (r.n_shingles, r.component_id) for k, r in rows(spark, "op10_near_copies").items()}
    assert got == brute_components(list(texts.items()), 3, 90, 100)


def test_pipeline(spark):
    """Each stage against what its operator says of the stage's own input."""
    import corpus_pipeline
    from merrow.llm.decontaminate import find_benchmark_passages
    from merrow.llm.near_copies import link_near_copies
    from merrow.scratch import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), name)
        if name != "tokens":
            assert out.columns == docs.columns
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        assert after.keys() <= before.keys()
        if name == "language_id":
            assert after.keys() == {k for k, r in before.items() if re.search(r"[^\W\d_]", r.text or "")}
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in after.values()) and all(set(r.text.split("\n")) <= set(before[k].text.split("\n")) for k, r in after.items())
        if name == "near_copies":
            assert after.keys() == {r.doc_id for r in link_near_copies(docs).where("component_id = doc_id").collect()}
        if name == "decontamination":
            hits = {k: brute_hits(r.text, bench) for k, r in before.items()}
            assert after.keys() == {k for k, (n, h, _) in hits.items() if not (h and 20 * h >= n)}
            assert find_benchmark_passages(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == len(before)
        if name == "tokens":
            assert after.keys() == before.keys()
        docs = out
