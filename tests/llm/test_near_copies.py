"""Near copies against brute force, with the limits that change the way of the join at their ends."""

import random

import pytest

from merrow.llm import near_copies, shared
from tests.llm.test_operators import brute_components


def families(seed: int = 5) -> list[tuple[int, str | None]]:
    """Families whose members link with a middle text, in chains, or share much and don't link."""
    rng = random.Random(seed)
    rows: list[tuple[int, str | None]] = []
    for family in range(4):
        base = [f"f{family}w{i}" for i in range(120)]
        for k in range(30):
            own = list(base)
            for _ in range(rng.randrange((3, 6, 12, 25)[family])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(1000 + k, " ".join(f"s{i}" for i in range(k % 5, 60 + k))) for k in range(30)]
    common = [f"c{i}" for i in range(40)]
    rows += [(2000 + k, " ".join([*common, *(f"u{k}v{i}" for i in range(k % 9))])) for k in range(40)]
    rows += [(3000 + k, rows[k][1]) for k in range(0, 120, 5)]
    rows += [(4000 + k, t) for k, t in enumerate([None, "", " ", "one", "One two", "one two", "one two three four"] * 3)]
    return rows


@pytest.mark.parametrize(("size", "num", "tight"), [(3, 90, True), (5, 80, True), (5, 80, False), (2, 45, False), (2, 45, True)])
def test_families(spark, monkeypatch, size, num, tight):
    if tight:  # every switch at its other end
        monkeypatch.setattr(near_copies, "LONG_LIST", 0)
        monkeypatch.setattr(shared, "MOST_BROADCAST_BYTES", 0)
        monkeypatch.setattr(near_copies, "HOT_SHARE", 100_000)
        monkeypatch.setattr(near_copies, "CARRIED", 1)
        monkeypatch.setattr(near_copies, "FREQUENT_FROM", 3)
        monkeypatch.setattr(near_copies, "REMEMBERED", 0)
    rows = families()
    got = near_copies.link_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=size, num=num, den=100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, size, num, 100)


def test_lists_of_few_open_and_many_closed_groups(spark, monkeypatch):
    """Lists are long by their pairs too, whatever the number of open groups is."""
    monkeypatch.setattr(near_copies, "LONG_PAIRS", 0)
    rows = families(11)
    got = near_copies.link_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=5, num=80, den=100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, 5, 80, 100)


@pytest.mark.parametrize(("size", "num"), [(3, 90), (5, 60)])
def test_all_links(spark, size, num):
    """Every pair of different texts that link, and each document's number of links."""
    rows = [r for r in families(9) if r[1] is None or len(r[1].split()) < 130][:200]
    links, members = near_copies.near_copy_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), size=size, num=num, den=100)

    def shingles(text):
        words = (text or "").lower().split()
        k = min(size, len(words))
        return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset()

    nodes, copies = {}, {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        own = shingles(text)
        nodes.setdefault(own or key, key)
        copies[own or key] = copies.get(own or key, 0) + 1
    sets = [s for s in nodes if isinstance(s, frozenset)]
    want = {tuple(sorted((nodes[a], nodes[b]))) for i, a in enumerate(sets) for b in sets[:i] if 100 * len(a & b) >= num * len(a | b)}
    assert {(r.a, r.b) for r in links.collect()} == want and want
    by_node = {v: k for k, v in nodes.items()}
    count = {key: sum(copies[by_node[b if a == key else a]] for a, b in want if key in (a, b)) for key in nodes.values()}
    assert {r.doc_id: (r.node, r.n_links) for r in members.collect()} == {k: (nodes[shingles(t) or k], count[nodes[shingles(t) or k]]) for k, t in rows}
