"""Vectorised text helpers shared by the corpus operators.

Everything here works on one slice of an Arrow string column at a time: the
UTF-8 bytes of the slice are one numpy array, words are found by a byte-class
table, and word or n-gram hashes come from prefix sums of a polynomial hash
modulo 2**64.  Memory is bounded by ``SLICE_BYTES`` plus the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_MIX_A = np.uint64(0xFF51AFD7ED558CCD)
_MIX_B = np.uint64(0xC4CEB9FE1A85EC53)
_R = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_MASK = (1 << 64) - 1
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    got = _powers_cache.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 8 << 20:
            _powers_cache[base] = got
    return got[0][:n], got[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every output bit depends on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= _MIX_A
    h ^= h >> np.uint64(33)
    h *= _MIX_B
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(values: np.ndarray, base: int = _Q) -> np.ndarray:
    up, _ = _powers(base, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _Q) -> np.ndarray:
    """Hashes of values[start:end], mixed with the length."""
    _, down = _powers(base, len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _MIX_A)


@dataclass
class Slice:
    """Some consecutive texts: their bytes and where each begins (n + 1 offsets)."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column into slices of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        own = offsets[at : to + 1]
        yield Slice(data[own[0] : own[-1]], own - own[0], at)
        at = to


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: The white space of the word pattern [^\x20\x09-\x0D]+.
PLAIN_WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Letters, digits and whatever isn't ASCII, after lower-casing A-Z.
NORMAL_WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of a slice: byte spans, and per text the first word's index (n + 1 values)."""

    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def find_words(part: Slice, table: np.ndarray, data: np.ndarray | None = None) -> Words:
    inside = table[part.data if data is None else data]
    n = len(inside)
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = part.offsets[part.offsets < n]
        begins[edge] |= inside[edge]
        edge = part.offsets[part.offsets > 0] - 1
        ends[edge] |= inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, part.offsets))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(_BYTE_VALUES[data], _R), start, end, _R)


def word_hashes(part: Slice, words: Words, data: np.ndarray | None = None) -> np.ndarray:
    return hash_spans(part.data if data is None else data, words.start, words.end)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the n-word windows that lie in one text, and their texts' indices."""
    per = np.maximum(np.diff(words.bounds) - n + 1, 0)
    doc = np.repeat(np.arange(len(per)), per)
    begin = np.cumsum(per) - per
    return np.arange(per.sum()) - begin[doc] + words.bounds[:-1][doc], doc


def covered(n_words: int, starts: np.ndarray, lengths) -> np.ndarray:
    """Marks the words inside any of the spans."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def per_text(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values between bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
