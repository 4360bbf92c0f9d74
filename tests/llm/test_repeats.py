"""Suffix dedup against brute force, with odd rows and every switch at its other end."""

import hashlib
import os
import random

import numpy as np
import pytest

from merrow.llm import repeats
from merrow.llm.repeats import remove_repeats, suffix_sort

SF = "/root/testdata/sf0.001"


def brute(texts, length=100):
    """(bytes, removed, runs, what is left) of texts in their order."""
    seen, out = set(), []
    for text in texts:
        t = (text or "").encode()
        gone = bytearray(len(t) + 1)
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(gone), runs, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def odd_texts():
    rng = random.Random(5)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(n))

    shared, long = words(30), words(4_000)
    edited = [long[: 90 * k] + rng.choice(["X", "yy", ""]) + long[90 * k :] for k in range(1, 40)]
    around = [words(6) + shared + words(6) for _ in range(60)]
    return [
        None, "", "short", "a" * 99, "a" * 100, "a" * 101, "ab" * 500, "ba" * 700, "é" * 400, "日本語" * 90, long, long, long + long, *edited, *around,
        shared[:99], shared[:120], shared[5:160] + "é" + shared[20:190], long[3_000:3_500] * 3, " " * 5_000, "\0" * 300,
    ]


def same(spark, texts, **options):
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, __no string").repartition(5)
    got = remove_repeats(table, **options)
    assert got.columns == ["doc_id", "text", "__no", "n_bytes", "n_removed", "spans", "kept"]
    for r, (size, gone, runs, left) in zip(got.orderBy("doc_id").collect(), brute(texts, **options), strict=True):
        assert (r.text, r["__no"]) == (texts[r.doc_id], "x")
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == (size, gone, runs, left), r.doc_id
        whole = (r.text or "").encode()
        assert sum(s.end - s.start for s in r.spans) == gone and all(0 <= s.start < s.end <= len(whole) for s in r.spans)


def test_odd_texts(spark):
    same(spark, odd_texts())


@pytest.mark.parametrize("switch", [("PIECE", 150), ("MOST_SORTED", 3), ("SORTED_AT_ONCE", 4), ("told", 0)])
def test_switches(spark, monkeypatch, switch):
    if switch[0] == "told":
        monkeypatch.setattr(repeats, "is_small", lambda table: False)
    else:
        monkeypatch.setattr(repeats, *switch)
    same(spark, odd_texts()[:40])


def test_repeated_and_missing_ids(spark):
    text, other = "".join(map(str, range(200))), "".join(map(str, range(100, 300)))
    first, second = sorted((text, other), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    rows = [(7, other), (7, text), (7, text), (None, text[:150]), (None, text[:150]), (9, "none"), (9, None)]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id int, text string").repartition(3)).collect()
    want = dict(zip([(None, text[:150]), (7, first), (7, second), (9, "none"), (9, None)], brute([text[:150], first, second, "none", None])))
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(rows, key=str)
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == want[r.doc_id, r.text]
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_op12_query(spark):
    from merrow.llm.queries import QUERIES

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = {k: b for (k, _), b in zip(docs, brute([t for _, t in docs]), strict=True)}
    got = QUERIES["op12_repeats"](spark, SF).collect()
    assert len(got) == len(want) and any(r.n_spans > 1 for r in got)
    for r in got:
        size, gone, runs, left = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (size, gone, runs, hashlib.sha256(left).hexdigest())


def groups(strings, key):
    n, size = len(strings), np.array([len(s) for s in strings])
    edge = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    count = np.diff(np.concatenate([np.flatnonzero(edge), [n]]))[np.cumsum(edge) - 1]
    return np.frombuffer(b"".join(strings) + b"\0", np.uint8), np.cumsum(size) - size, size, first, count


@pytest.mark.parametrize("wrong", [False, True])
def test_suffix_sort(monkeypatch, wrong):
    """Also with a hash under which all strings of a size are equal."""
    if wrong:
        monkeypatch.setattr(repeats.Hashed, "of", lambda self, start, n: np.zeros(len(start), np.uint64))
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    key = np.sort(np.array([rng.randint(0, 15) for _ in strings]))
    order, shared = suffix_sort(*groups(strings, key))
    assert [(key[i], strings[i]) for i in order] == sorted(zip(key, strings))
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        assert shared[k] == (-1 if key[a] != key[b] else len(os.path.commonprefix([strings[a], strings[b]])))
