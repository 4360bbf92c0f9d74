"""The exact best items of many queries: every tile of queries meets every block of items.

A query's vector is a sum of a few others: the vectors of picked items, and one of preferences. Many
queries share them, so a tile holds each such vector once, as an atom, and a query only the places
and shares of its atoms. Items are multiplied with atoms, and a query's products are added up from these.

Queries are packed into tiles and items into blocks, rows of Arrow data in one column each, and
dealt out once. Spark's cartesian product then lets a task read some tiles and some blocks where they
lie, so that what is shuffled is both tables, once, however many tiles there are. A task holds a
tile's queries and streams blocks past them: it multiplies a batch of items with all atoms of the
tile at once, finishes the scores of those that can still be among a query's best, and keeps these.
What can't be is told by the least score that a query has kept and the most that any item could add
to its content, so that every item is looked at and the result is exact. What leaves a task is no
more than ``top_k`` rows for each of its queries. Nothing passes through the driver, and the memory
of a task depends on the sizes of a tile and of the blocks of a partition alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.arrow import bounded_bytes, lean, slices
from merrow.config import SCALE, FeedbackConfig, RankingConfig
from merrow.operators.order import ROW_BITS
from merrow.operators.packed import opened, summed, unit
from merrow.scratch import discard, written

#: Vector entries of the atoms of one tile, of the items of one partition, and of one block of these.
QUERY_ENTRIES, ITEM_ENTRIES, BLOCK_ENTRIES = 2_000_000, 8_000_000, 250_000
#: Queries of one tile, and vectors that are told to all tasks by their slugs.
QUERIES, MOST_ASKED = 8_000, 50_000
#: Pairs of an item and a query that are scored at once.
CELLS = 500_000
#: Numbers in so many parts of a tile's vectors are multiplied as a dense matrix.
DENSE_SHARE = 0.125

UNITS = ("content_units", "platform_units", "popularity_units", "base_units", "affinity_units")
_STRINGS = T.ArrayType(T.StringType())
#: Columns of a query, besides its key. ``other_*`` is a second vector, of affinity; ``picked``
#: items are no candidates, ``excluded`` ones are but may not be ranked.
QUERY = T.StructType(
    [
        T.StructField("top_k", T.IntegerType()),
        *[T.StructField(f"{side}numbers", T.ArrayType(T.LongType())) for side in ("", "other_")],
        *[T.StructField(f"{side}weights", T.ArrayType(T.DoubleType())) for side in ("", "other_")],
        *[T.StructField(c, _STRINGS) for c in ("wanted", "picked", "excluded", "played")],
    ]
)


def units_of(values: np.ndarray) -> np.ndarray:
    """Whole millionths of doubles in [0, 1], the shortest decimal text rounded half up."""
    scaled = np.clip(values, 0.0, 1.0) * SCALE
    out = np.floor(scaled + 0.5).astype(np.int64)
    # where a product may be on the wrong side of a half, decimals decide
    for at in zip(*np.nonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6), strict=True):
        exact = Decimal(repr(float(min(1.0, max(0.0, values[at]))))).quantize(Decimal(1).scaleb(-18), ROUND_HALF_UP)
        out[at] = int((exact * SCALE).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def _share(units: np.ndarray, weight: np.ndarray | int) -> np.ndarray:
    return (units * weight + SCALE // 2) // SCALE


@dataclass
class Policy:
    """How units become an order: the base score, and with ``feedback`` the adjusted one. With
    ``near`` rows have the products with the picked items that a query is made of."""

    ranking: RankingConfig = field(default_factory=RankingConfig)
    feedback: FeedbackConfig | None = None
    cut: bool = True
    near: bool = False


class Tile:
    """The queries of a tile, and the best of the items that have passed."""

    def __init__(self, body: bytes, policy: Policy):
        one, atoms = (dict(zip(t.column_names, (_whole(c) for c in t.columns), strict=True)) for t in _opened_tile(body))
        self.policy, self.key, self.n = policy, one["key"], len(one["key"])
        self.top_k = pc.fill_null(one["top_k"], 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.most = int(self.top_k.max(initial=0))
        self.profile = one["other_at"].is_valid().to_numpy(zero_copy_only=False)
        self.own, self.other = (self._side(one[f"{side}at"], one[f"{side}share"]) for side in ("", "other_"))
        self.slug = atoms["slug"]
        self._index(atoms)
        self._platforms(one["wanted"])
        self.picked, self.excluded, self.played = (self._by_item(one[c]) for c in ("picked", "excluded", "played"))
        self.supported = np.zeros(self.n, bool)
        self.least = np.full(self.n, -1, np.int64)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.names: list[str] = []
        self._bounds()

    def _side(self, at: pa.Array, share: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Atoms and their shares by place in a query's list, one column for each query; what a
        shorter list lacks is atom 0 with no share."""
        of, atom, value = opened(pc.fill_null(at, []), pc.fill_null(share, []))
        size = np.bincount(of, minlength=self.n)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        atoms, shares = np.zeros((size.max(initial=0), self.n), np.int64), np.zeros((size.max(initial=0), self.n))
        atoms[place, of], shares[place, of] = atom, value
        return atoms, shares

    def _index(self, atoms: dict[str, pa.Array]) -> None:
        """Entries of the atoms by number: dense rows for numbers that many of them have, and
        for the rest the columns and values of each."""
        self.wide = len(atoms["numbers"])
        column, number, value = opened(atoms["numbers"], atoms["weights"])
        order = np.argsort(number, kind="stable")
        self.column, number, self.value = column[order], number[order], value[order]
        self.numbers, self.first, self.count = np.unique(number, return_index=True, return_counts=True)
        many = np.flatnonzero(self.count >= max(2, DENSE_SHARE * self.wide))
        many = many[np.argsort(-self.count[many], kind="stable")][: max(1, 2 * CELLS // max(1, self.wide))]
        self.dense_row = np.full(len(self.numbers), -1, np.int64)
        self.dense_row[many] = np.arange(len(many))
        self.dense = np.zeros((len(many), self.wide))
        own = np.repeat(self.dense_row, self.count)
        self.dense[own[own >= 0], self.column[own >= 0]] = self.value[own >= 0]

    def _platforms(self, wanted: pa.Array) -> None:
        """Each query's distinct platforms by place, as codes; the last code is of none."""
        of = pc.list_parent_indices(wanted).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(wanted).dictionary_encode()
        self.platforms = {p: i for i, p in enumerate(coded.dictionary.to_pylist())}
        self.n_wanted = np.bincount(of, minlength=self.n)
        many = max(1, len(self.platforms))
        of, code = np.divmod(np.unique(of * many + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)), many)
        size = np.bincount(of, minlength=self.n)
        self.wants = np.full((size.max(initial=0), self.n), len(self.platforms), np.int64)
        self.wants[np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size), of] = code

    def _by_item(self, lists: pa.Array) -> dict[str, list[int]]:
        out: dict[str, list[int]] = {}
        for slug, of in zip(pc.list_flatten(lists).to_pylist(), pc.list_parent_indices(lists).to_pylist(), strict=True):
            out.setdefault(slug, []).append(of)
        return out

    def _bounds(self) -> None:
        """For each query the most that a score can be besides its content's part, without
        popularity, and what a unit of content and of popularity adds to it."""
        config, adjusted = self.policy.ranking, self.policy.feedback
        weights = [config.content_weight, config.platform_weight, config.popularity_weight]
        keep, add, self.factor = np.ones(self.n), np.zeros(self.n), 1.0
        if adjusted is not None:
            weights += [adjusted.base_weight, adjusted.affinity_weight, adjusted.played_factor]
            keep = np.where(self.profile, adjusted.base_weight / SCALE, 1.0)
            add = np.where(self.profile, float(adjusted.affinity_weight), 0.0)
            self.factor = max(1.0, adjusted.played_factor / SCALE)
        # each of at most six roundings adds half a unit
        self.besides = add + keep * np.where(self.n_wanted > 0, config.platform_weight, 0) + 4
        self.per_content, self.per_popular = keep * config.content_weight / SCALE, keep * config.popularity_weight / SCALE
        self.bounded = self.policy.cut and min(weights) >= 0

    def _low(self, popular: np.ndarray) -> np.ndarray:
        """The least content by query with which one of some items can be among its best."""
        low = np.full(self.n, 4e-7)
        if self.bounded:
            rest = self.least / self.factor - self.besides - self.per_popular * popular.max(initial=0)
            need = np.divide(rest, self.per_content, out=np.full(self.n, -1.0), where=self.per_content > 0)
            low = np.where(self.least >= 0, np.maximum(low, (need - 2) / SCALE), low)
        return low

    def products(self, of: np.ndarray, number: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Products of all atoms with ``n`` items."""
        wide = self.wide
        place = np.minimum(np.searchsorted(self.numbers, number), max(0, len(self.numbers) - 1))
        known = self.numbers[place] == number if len(self.numbers) else np.zeros(len(number), bool)
        of, place, value = of[known], place[known], value[known]
        row = self.dense_row[place]
        items = np.zeros((n, len(self.dense)))
        items[of[row >= 0], row[row >= 0]] = value[row >= 0]
        out = items @ self.dense
        of, place, value = of[row < 0], place[row < 0], value[row < 0]
        sizes = self.count[place]
        ends = np.cumsum(sizes)
        # parts whose products are no more than the cells of a batch, or one entry's
        start = 0
        while start < len(of):
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + 2 * CELLS, side="right")))
            size = sizes[start:end]
            at = np.arange(size.sum()) + np.repeat(self.first[place[start:end]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            cell = np.repeat(of[start:end] * wide, size) + self.column[at]
            out += np.bincount(cell, self.value[at] * np.repeat(value[start:end], size), n * wide).reshape(n, wide)
            start = end
        return np.ascontiguousarray(out.T)

    def _marked(self, slugs: list[str], by_item: dict[str, list[int]], query: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether an item of a pair stands in a list of its query."""
        hits = [i for i, slug in enumerate(slugs) if slug in by_item]
        if not hits:
            return np.zeros(len(query), bool)
        out = np.zeros((self.n, len(slugs)), bool)
        for i in hits:
            out[by_item[slugs[i]], i] = True
        return out[query, item]

    def score(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Score items; without a cut all candidates come out at once."""
        step = max(1, CELLS // max(1, self.n, self.wide, len(self.dense)))
        for start in range(0, len(batch) if self.wide else 0, step):
            yield from self._scored(batch.slice(start, step))

    def _scored(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        slugs, n = batch.column("slug").to_pylist(), len(batch)
        popular = batch.column("popularity_units").to_numpy(zero_copy_only=False)
        product = self.products(*opened(batch.column("numbers"), batch.column("weights")), n)
        content = np.zeros((self.n, n))
        for atom, share in zip(*self.own, strict=True):
            part = product[atom]
            part *= share[:, None]
            content += part
        query, item = np.nonzero(content >= self._low(popular)[:, None])
        content = units_of(content[query, item])
        alive = (content > 0) & ~self._marked(slugs, self.picked, query, item)
        self.supported[query[alive]] = True
        alive &= ~self._marked(slugs, self.excluded, query, item)
        query, item, content = query[alive], item[alive], content[alive]
        if not len(query):
            return
        has = np.zeros((n, len(self.platforms) + 1))
        of = pc.list_parent_indices(batch.column("has")).to_pylist()
        for i, p in zip(of, pc.list_flatten(batch.column("has")).to_pylist(), strict=True):
            if p in self.platforms:
                has[i, self.platforms[p]] = 1
        shared = sum((has[item, code[query]] for code in self.wants), np.zeros(len(query)))
        wanted = self.n_wanted[query]
        platform = units_of(np.divide(shared, wanted, out=np.zeros(len(query)), where=wanted > 0))
        popular = popular[item]
        config = self.policy.ranking
        base = _share(content, config.content_weight) + _share(platform, config.platform_weight) + _share(popular, config.popularity_weight)
        affinity = units_of(sum((product[atom[query], item] * share[query] for atom, share in zip(*self.other, strict=True)), np.zeros(len(query))))
        played = self._marked(slugs, self.played, query, item)
        order = [base, content, popular]
        if (adjusted := self.policy.feedback) is not None:
            profile = self.profile[query]
            before = _share(base, np.where(profile, adjusted.base_weight, SCALE)) + _share(affinity, np.where(profile, adjusted.affinity_weight, 0))
            order = [_share(before, np.where(played, adjusted.played_factor, SCALE)), before, base, affinity, content, popular]
        columns = [query, item, played, content, platform, popular, base, affinity, *order]
        if self.policy.cut:
            alive = order[0] >= self.least[query]
            if n > self.most > 0 and alive.sum() > 4 * self.most * self.n:
                # no query needs more of this batch than its best
                every = np.full((self.n, n), -1, np.int64)
                every[query[alive], item[alive]] = order[0][alive]
                alive &= order[0] >= np.partition(every, n - self.most, axis=1)[query, n - self.most]
            columns = [c[alive] for c in columns]
        if self.policy.near:
            columns += [np.where(share[columns[0]] > 0, product[atom[columns[0]], columns[1]], np.nan) for atom, share in zip(*self.own, strict=True)]
        columns[1] = columns[1] + len(self.names)
        first = not self.names
        self.names += slugs
        self.held.append(tuple(columns))
        if not self.policy.cut:
            yield from self.done(False)
            self.names = []
        elif first or sum(len(h[0]) for h in self.held) > max(CELLS // 4, 4 * self.most * self.n):
            self._keep_best()

    def _keep_best(self) -> None:
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        query, order = columns[0], columns[8 : 14 if self.policy.feedback is not None else 11]
        # names in the order of their UTF-8 bytes, which is that of code points
        there, own = np.unique(columns[1], return_inverse=True)
        rank = np.unique(np.array([self.names[i] for i in there.tolist()], str), return_inverse=True)[1][own] if len(query) else query
        ranked = np.lexsort((rank, *[-c for c in reversed(order)], query))
        query = query[ranked]
        first = np.searchsorted(query, query, side="left")
        place = np.arange(len(query)) - first
        kept = ranked[place < self.top_k[query]]
        full = place == self.top_k[query] - 1
        self.least[query[full]] = order[0][ranked[full]]
        self.held = [tuple(c[kept] for c in columns)]

    def done(self, last: bool = True) -> Iterator[pa.RecordBatch]:
        """The best rows; and at last a row without an item for each query that any item supports."""
        if self.policy.cut and self.held:
            self._keep_best()
        slots = len(self.own[0]) if self.policy.near else 0
        wide = 14 if self.policy.feedback is not None else 11
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)] if self.held else [np.zeros(0, np.int64)] * (wide + slots)
        extra = np.flatnonzero(self.supported) if last else np.zeros(0, np.int64)
        none = np.full(len(extra), 0, np.int64)
        query = np.concatenate([columns[0], extra])
        names = pa.array([*[self.names[i] for i in columns[1].tolist()], *[None] * len(extra)], pa.string())
        played = pa.array(np.concatenate([columns[2].astype(bool), none.astype(bool)]))
        arrays = [self.key.take(pa.array(query)), names, played, pa.array(self.profile[query]), *[pa.array(np.concatenate([c, none])) for c in columns[3:8]]]
        if self.policy.near:
            arrays.append(self._near(columns[0], columns[wide:], len(extra)))
        self.held = []
        if len(query):
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "slug", "is_played", "has_profile", *UNITS, *(["near"] if self.policy.near else [])])

    def _near(self, query: np.ndarray, values: list[np.ndarray], extra: int) -> pa.Array:
        """For each row its products with the atoms that are items, and nothing for ``extra`` rows."""
        atom = self.own[0][:, query].T
        value = np.array(values, float).reshape(len(values), len(query)).T
        real = ~np.isnan(value) & self.slug.is_valid().to_numpy(zero_copy_only=False)[atom]
        offsets = np.concatenate([[0], np.cumsum(real.sum(axis=1)), np.full(extra, real.sum())]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([self.slug.take(pa.array(atom[real])), pa.array(value[real])], names=["slug", "product"])
        return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _tile_of(queries: pa.RecordBatch, atoms: pa.RecordBatch) -> bytes:
    both = [_body(b) for b in (queries, atoms)]
    return len(both[0]).to_bytes(8, "little") + both[0] + both[1]


def _opened_tile(body: bytes) -> list[pa.Table]:
    end = 8 + int.from_bytes(body[:8], "little")
    return [pa.ipc.open_stream(b).read_all() for b in (body[8:end], body[end:])]


def _body(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


_LISTS = ("wanted", "picked", "excluded", "played")
_TILE = T.StructType([T.StructField("queries", T.BinaryType())])


def _lists_of(of: np.ndarray, n: int, values: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
    mask = None if valid is None else pa.array(~valid)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)


def _own_tiles(queries: DataFrame) -> DataFrame:
    """Tiles of queries whose vectors are their own: (key, QUERY)."""
    at = queries.columns.index("numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 8 * QUERY_ENTRIES):
            n, profile = len(batch), batch.column("other_numbers").is_valid().to_numpy(zero_copy_only=False)
            atoms = [pa.concat_arrays([pc.fill_null(batch.column(f"{side}{c}"), []) for side in ("", "other_")]) for c in ("numbers", "weights")]
            atoms = pa.RecordBatch.from_arrays([pa.nulls(2 * n, pa.string()), *atoms], names=["slug", "numbers", "weights"])
            rows = np.arange(n)
            sides = [_lists_of(rows, n, rows), _lists_of(rows, n, np.ones(n)), _lists_of(rows, n, rows + n, profile), _lists_of(rows, n, np.ones(n), profile)]
            own = pa.RecordBatch.from_arrays([batch.column("key"), batch.column("top_k"), *sides, *[batch.column(c) for c in _LISTS]], names=["key", "top_k", "at", "share", "other_at", "other_share", *_LISTS])
            yield pa.RecordBatch.from_arrays([pa.array([_tile_of(own, atoms)], pa.binary())], names=["queries"])

    return queries.mapInArrow(lean(run), _TILE)


#: Columns of a query whose vector is made of those of items, besides its key: picked items and
#: preferences are mixed by shares, ``sources`` make up the vector of affinity (null: there is none).
MIXED = T.StructType(
    [
        T.StructField("top_k", T.IntegerType()),
        *[T.StructField(c, T.BooleanType()) for c in ("picks", "prefers")],
        T.StructField("liked_numbers", T.ArrayType(T.LongType())),
        T.StructField("liked_weights", T.ArrayType(T.DoubleType())),
        T.StructField("sources", _STRINGS),
        *[T.StructField(c, _STRINGS) for c in _LISTS],
    ]
)


class _Mix:
    """The atoms of one tile, and its queries in terms of them."""

    def __init__(self, config: RankingConfig):
        self.config, self.slugs, self.numbers, self.weights = config, [], [], []
        self.by_slug: dict[str, list[int]] = {}
        self.liked: dict[bytes, int] = {}

    def add(self, slug: str | None, numbers: np.ndarray, weights: np.ndarray) -> int:
        if slug is not None:
            self.by_slug.setdefault(slug, []).append(len(self.slugs))
        self.slugs.append(slug)
        self.numbers.append(numbers)
        self.weights.append(weights)
        return len(self.slugs) - 1

    def _summed(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sum of the atoms of each list."""
        none = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        parts = [(np.full(len(self.numbers[a]), i), self.numbers[a], self.weights[a]) for i, own in enumerate(lists) for a in own]
        return summed(*(np.concatenate(c) for c in zip(*none, *parts, strict=True)))

    def mixed(self, rows: list[dict]) -> list[tuple | None]:
        """(atoms, shares, other atoms, other shares) of each query; None for one without a vector."""
        out, n = [], len(rows)
        picks = [[a for slug in dict.fromkeys(r["picked"] or []) for a in self.by_slug.get(slug, ())] for r in rows]
        sources = [[a for slug in dict.fromkeys(r["sources"] or []) for a in self.by_slug.get(slug, ())] for r in rows]
        of, number, value = self._summed(picks)
        norm = np.sqrt(np.bincount(of, value * value, n))
        share = [np.where([r[c] for r in rows], s, 1.0) for c, s in (("prefers", self.config.selected_share), ("picks", self.config.preference_share))]
        liked = [(i, np.array(r["liked_numbers"], np.int64), np.array(r["liked_weights"], float)) for i, r in enumerate(rows) if r["liked_numbers"]]
        none = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        of_2, number_2, value_2 = summed(*(np.concatenate(c) for c in zip(*none, *[(np.full(len(a), i), a, w) for i, a, w in liked], strict=True)))
        unit_2 = unit(of_2, value_2, n)
        both = summed(np.concatenate([of, of_2]), np.concatenate([number, number_2]), np.concatenate([unit(of, value, n) * share[0][of], unit_2 * share[1][of_2]]))
        whole = np.sqrt(np.bincount(both[0], both[2] * both[2], n))
        there = np.bincount(both[0], minlength=n) > 0
        other = self._summed(sources)
        other_norm = np.sqrt(np.bincount(other[0], other[2] * other[2], n))
        starts = np.searchsorted(of_2, np.arange(n + 1))
        for i, r in enumerate(rows):
            if not there[i]:
                out.append(None)
                continue
            atoms = list(picks[i]) if norm[i] > 0 and whole[i] > 0 else []
            shares = [share[0][i] / (norm[i] * whole[i])] * len(atoms)
            own = slice(starts[i], starts[i + 1])
            if starts[i + 1] > starts[i] and whole[i] > 0:
                a, w = number_2[own], unit_2[own]
                mark = a.tobytes() + w.tobytes()
                if mark not in self.liked:
                    self.liked[mark] = self.add(None, a, w)
                atoms.append(self.liked[mark])
                shares.append(share[1][i] / whole[i])
            far = sources[i] if other_norm[i] > 0 else []
            out.append((atoms, shares, far if r["sources"] else None, [1 / other_norm[i]] * len(far) if r["sources"] else None))
        return out


def _mixed_tiles(queries: DataFrame, vectors: DataFrame, config: RankingConfig) -> DataFrame:
    """Tiles of queries (key, MIXED) over the vectors (slug, numbers, weights) of items."""
    slugs = F.array_distinct(F.concat("picked", F.coalesce("sources", F.array().cast("array<string>"))))
    asked = written(queries.select(F.explode(slugs).alias("slug")).groupBy("slug").agg(F.count("*").alias("times")), "asked")
    few = asked.count() <= MOST_ASKED
    atoms = written(vectors.join(F.broadcast(asked) if few else asked, "slug").select("slug", "times", "numbers", "weights"), "atoms")
    size = F.size("numbers").cast("long")
    once, all_of = atoms.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(size * F.col("times")), F.lit(0))).first()
    n_tile = max(1, -(-queries.count() // QUERIES), 1 if once <= QUERY_ENTRIES else -(-all_of // QUERY_ENTRIES))
    own = queries.withColumn("tile", F.pmod(F.xxhash64("key"), F.lit(n_tile)).cast("int"))
    met = own.select("tile", F.explode(slugs).alias("slug")).distinct().join(atoms.drop("times"), "slug")
    rows = own.withColumn("kind", F.lit(1)).unionByName(met.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    rows = rows.select("tile", "kind", "slug", "numbers", "weights", "key", *MIXED.names).repartition(n_tile, "tile").sortWithinPartitions("tile", "kind")

    def packed(mix: _Mix, batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, made = [], []
        for batch in batches:
            for start in range(0, len(batch), 100):
                part = batch.slice(start, 100)
                found = mix.mixed(part.select(MIXED.names).to_pylist())
                kept.append(part.filter(pa.array([f is not None for f in found])))
                made += [f for f in found if f is not None]
        if not made:
            return
        one = pa.Table.from_batches(kept)
        kinds = (pa.list_(pa.int64()), pa.list_(pa.float64())) * 2
        sides = [pa.array([f[i] for f in made], kind) for i, kind in enumerate(kinds)]
        whole = pa.RecordBatch.from_arrays([*[_whole(one.column(c)) for c in ("key", "top_k")], *sides, *[_whole(one.column(c)) for c in _LISTS]], names=["key", "top_k", "at", "share", "other_at", "other_share", *_LISTS])
        of = np.repeat(np.arange(len(mix.numbers)), [len(x) for x in mix.numbers])
        entries = [_lists_of(of, len(mix.numbers), np.concatenate(c) if c else np.zeros(0)) for c in (mix.numbers, mix.weights)]
        atoms = pa.RecordBatch.from_arrays([pa.array(mix.slugs, pa.string()), *entries], names=["slug", "numbers", "weights"])
        yield pa.RecordBatch.from_arrays([pa.array([_tile_of(whole, atoms)], pa.binary())], names=["queries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mix, held = None, _Mix(config), []
        for batch in batches:
            tiles, kinds = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(tiles) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(batch)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end > start and tiles[start] != now:
                    yield from packed(mix, held)
                    now, mix, held = tiles[start], _Mix(config), []
                part = batch.slice(start, end - start)
                if end > start and kinds[start]:
                    held.append(part.select(["key", *MIXED.names]))
                elif end > start:
                    of, number, weight = opened(part.column("numbers"), part.column("weights"))
                    ends = np.cumsum(np.bincount(of, minlength=len(part)))[:-1]
                    for slug, a, w in zip(part.column("slug").to_pylist(), np.split(number, ends), np.split(weight, ends), strict=True):
                        mix.add(slug, a.copy(), w.copy())
        yield from packed(mix, held)

    tiles = written(rows.mapInArrow(lean(run), _TILE), "tiles")
    discard(asked, atoms)
    return tiles


def _packed(rows: DataFrame, entries: int) -> DataFrame:
    """(body): the rows in parts of about so many vector entries, each part as Arrow data."""
    at = rows.columns.index("numbers")
    schema = T.StructType([T.StructField("body", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 8 * entries):
            yield pa.RecordBatch.from_arrays([pa.array([_body(batch)], pa.binary())], names=["body"])

    return rows.mapInArrow(lean(run), schema)


def best_items(queries: DataFrame, items: DataFrame, key: str, policy: Policy, vectors: DataFrame | None = None) -> DataFrame:
    """(key, slug, is_played, has_profile, units) of the candidates of each query: all of them, or
    the best ``top_k`` of every partition of items. A row with a null slug says that some item has
    content in common with the query, whether it may be ranked or not.

    ``queries``: a written table of key and QUERY, or of key and MIXED over ``vectors`` (slug,
    numbers, weights). ``items``: a written table of slug, numbers, weights, has (platforms) and
    popularity_units. Queries without a vector have no rows."""
    bounded_bytes(queries.sparkSession)
    cores = queries.sparkSession.sparkContext.defaultParallelism
    entries = lambda df, *lists: df.agg(F.sum(sum((F.greatest(F.size(c), F.lit(0)) + 1 for c in lists), F.lit(0)))).first()[0] or 0
    kind = queries.schema[key].dataType
    if vectors is None:
        n_query = max(1, -(-entries(queries, "numbers", "other_numbers") // QUERY_ENTRIES))
        own = queries.select(F.col(key).alias("key"), *QUERY.names).repartition(n_query, "key")
        tiles = written(_own_tiles(own), "tiles")
    else:
        tiles = _mixed_tiles(queries.select(F.col(key).alias("key"), *MIXED.names), vectors, policy.ranking)
        n_query = max(1, tiles.count())
        # a partition of the product has one tile
        tiles = tiles.repartition(n_query)
    tiles = tiles.withColumn("tile", F.monotonically_increasing_id())
    n_item = max(-(-entries(items, "numbers") // ITEM_ENTRIES), -(-2 * cores // n_query))
    blocks = _packed(items.select("slug", "numbers", "weights", "has", "popularity_units"), BLOCK_ENTRIES)
    blocks = blocks.withColumn("block", F.monotonically_increasing_id()).repartition(n_item, "block")
    # a task gets each of its tiles once, beside the first of its blocks
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)) == 0
    both = tiles.hint("shuffle_replicate_nl").crossJoin(blocks.select(first.alias("first"), "body"))
    dealt = both.select("tile", F.when(F.col("first"), F.col("queries")).alias("queries"), "body")
    fields = [("slug", T.StringType()), ("is_played", T.BooleanType()), ("has_profile", T.BooleanType()), *[(u, T.LongType()) for u in UNITS]]
    if policy.near:
        fields.append(("near", T.ArrayType(T.StructType([T.StructField("slug", T.StringType()), T.StructField("product", T.DoubleType())]))))
    schema = T.StructType([T.StructField("key", kind), *[T.StructField(n, t) for n, t in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tile = None, None
        for batch in batches:
            for at, held, body in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if at != now:
                    if tile is not None:
                        yield from tile.done()
                    now, tile = at, Tile(held.as_py(), policy)
                for part in pa.ipc.open_stream(body.as_buffer()):
                    yield from tile.score(part)
        if tile is not None:
            yield from tile.done()

    return dealt.mapInArrow(lean(run), schema).withColumnRenamed("key", key)
