"""Word shingles of many texts at once, as sorted sets of 64-bit hashes, in numpy.

A word's hash is a sum of one random number per byte times a power of an odd base, so all words of
a block of bytes come from one running sum. It depends on the word alone, not on its place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes that share one running sum, and the length from which a word is hashed by itself.
BLOCK, LONG_WORD = 1 << 18, 1 << 16

_ODD = [
    np.uint64(x | 1)
    for x in (
        0x9E3779B97F4A7C15,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x27D4EB2F165667C5,
        0xD6E8FEB86659FD93,
        0xA0761D6478BD642F,
        0xE7037ED1A0B428DB,
        0x8EBC6AF09C88C6E3,
    )
]


def mixed(x: np.ndarray) -> np.ndarray:
    """The numbers with every bit of each depending on all of its bits."""
    x = (x ^ (x >> np.uint64(31))) * _ODD[4]
    x = (x ^ (x >> np.uint64(29))) * _ODD[5]
    return x ^ (x >> np.uint64(32))


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x5851F42D4C957F2D
_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * _ODD[0])
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null ones empty), and where each begins and the last one ends."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return bytes_, offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (between ASCII white space, ASCII letters lower-cased) of all texts,
    and the number of words before each text and in all."""
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    begins, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    out = np.empty(len(begins), np.uint64)
    k = 0
    while k < len(begins):
        a = begins[k]
        to = max(k + 1, int(np.searchsorted(ends, a + BLOCK, side="right")))
        if (b := ends[to - 1]) - a <= BLOCK:
            total = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_VALUE[data[a:b]] * _POWER[: b - a], out=total[1:])
            first = begins[k:to] - a
            out[k:to] = (total[ends[k:to] - a] - total[first]) * _INVERSE[first]
        k = to
    sizes = ends - begins
    for k in np.flatnonzero(sizes > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[begins[k] : ends[k]].tobytes().translate(_LOWER))
    return mixed(out + sizes.astype(np.uint64) * _ODD[1]), np.searchsorted(begins, offsets)


def _rolled(words: np.ndarray, starts: np.ndarray | slice, size: int) -> np.ndarray:
    """Hashes of ``size`` words from each start."""
    total = np.full(len(words), size, np.uint64)[starts]
    for k in range(size):
        ahead = words[starts.start + k : starts.stop + k] if isinstance(starts, slice) else words[starts + k]
        total = (total + ahead) * _ODD[k % 4] + np.uint64(k)
    return mixed(total)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of ``size`` words of each text, sorted, in one array, and the bounds
    of each text's part in it. A text of fewer words, but not none, has one: all of its words."""
    words, at = words_of(*parts(column))
    per_text = np.diff(at)
    counts = np.where(per_text < size, np.minimum(per_text, 1), per_text - size + 1)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(bounds[-1], np.uint64)
    usual = np.ones(len(out), bool)
    for own in range(1, size):
        short = np.flatnonzero(per_text == own)
        out[bounds[short]] = _rolled(words, at[short], own)
        usual[bounds[short]] = False
    if len(words) >= size:
        inside = np.ones(len(words) - size + 1, bool)
        for k in range(1, size):
            last = at[1:] - k
            inside[last[(last >= 0) & (last < len(inside))]] = False
        out[usual] = _rolled(words, slice(0, len(inside)), size)[inside]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][counts > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each part, modulo 2 to the 64."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def signatures(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two signed numbers."""
    marks = (mixed(values * _ODD[6] + np.uint64(1)), mixed(values * _ODD[7] + np.uint64(2)))
    hi, lo = (sums(m, bounds).view(np.int64) for m in marks)
    return hi, lo


def sequence_marks(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits of each part that depend on its order and length too."""
    sizes = np.diff(bounds)
    place = (np.arange(len(values)) - np.repeat(bounds[:-1], sizes)).astype(np.uint64)
    return (sums(mixed(values * _ODD[6] + place), bounds) ^ sizes.astype(np.uint64)).view(np.int64)


def parities(values: np.ndarray) -> bytes:
    """Whether each of some equal parts of all hashes holds an odd number of the set's: about two
    bits a shingle. Sets that differ in d shingles differ in at most d of these bits, also after
    the longer row of bits is folded to the shorter one's length."""
    bits = 1 << max(6, (2 * len(values) - 1).bit_length())
    return np.packbits(np.bincount(values & np.uint64(bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def parities_differ(one: bytes, other: bytes) -> int:
    """In how many bits two rows of ``parities`` differ."""
    short, long = sorted((one, other), key=len)
    folded = np.bitwise_xor.reduce(np.frombuffer(long, np.uint8).reshape(-1, len(short)))
    return int(np.bitwise_count(folded ^ np.frombuffer(short, np.uint8)).sum())
