"""Vectorised word tokeniser over Arrow string buffers.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  Each word gets a 64-bit hash of its
bytes: a polynomial over random byte values (a cumulative sum modulo 2**64, shifted back by the
inverse power of the start) followed by an avalanche step.  No Python object is made per word.
Memory is bounded by ``CHUNK`` bytes of text, or one document where that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
_RAW = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _RAW.copy()
_LOWER[65:91] = _RAW[97:123]
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        n = max(n, 1 << 16)
        table = np.empty(n, dtype=np.uint64)
        table[0] = 1
        table[1:] = U64(base)
        np.multiply.accumulate(table, out=table)
        _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit integers; returns a new array."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@dataclass
class Words:
    """The words of documents ``lo`` to ``hi`` of a batch; ``first[i]:first[i+1]`` are document i's."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.first))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    return data, offsets


def doc_chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``limit`` bytes, or a single longer one."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of byte spans given in ascending order."""
    out = np.empty(len(starts), dtype=np.uint64)
    table = _LOWER if lower else _RAW
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, side="right")))
        a, z = int(starts[lo]), int(ends[hi - 1])
        sums = np.zeros(z - a + 1, dtype=np.uint64)
        np.cumsum(table[data[a:z]] * _power_table(_BASE, z - a)[: z - a], out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        h = (sums[e] - sums[s]) * _power_table(_INVERSE, z - a + 1)[s]
        out[lo:hi] = mix(h + (e - s).astype(np.uint64) * U64(0xD6E8FEB86659FD93))
        lo = hi
    return out


def words(column: pa.Array, lower: bool, limit: int = CHUNK) -> Iterator[Words]:
    data, offsets = text_buffers(column)
    for lo, hi in doc_chunks(offsets, limit):
        a, z = int(offsets[lo]), int(offsets[hi])
        part = data[a:z]
        flag = np.zeros(z - a + 2, dtype=np.int8)
        flag[1:-1] = _IS_WORD[part]
        edge = np.diff(flag)
        begin = edge[:-1] == 1
        end = edge[1:] == -1
        cuts = (offsets[lo:hi] - a)[1:]
        cuts = cuts[(cuts > 0) & (cuts < z - a)]
        inside = cuts[(flag[cuts] == 1) & (flag[cuts + 1] == 1)]
        begin[inside] = True
        end[inside - 1] = True
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        first = np.searchsorted(starts, offsets[lo : hi + 1] - a)
        yield Words(lo, hi, part, starts, ends, first, hash_spans(part, starts, ends, lower))


_SHINGLE = (_rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2)) + U64(1)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and each document's offsets into them.

    A document with fewer words has its whole sequence as one run; one without words has none.
    """
    n = len(hashes)
    counts = np.diff(first)
    runs = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    acc = np.zeros(max(0, n - width + 1), dtype=np.uint64)
    for k in range(width):
        acc += hashes[k : k + len(acc)] * _SHINGLE[k]
    out = np.empty(bounds[-1], dtype=np.uint64)
    long = counts >= width
    take = np.repeat(first[:-1][long] - bounds[:-1][long], runs[long])
    at = np.concatenate([np.arange(b, b + r) for b, r in zip(bounds[:-1][long], runs[long])]) if long.any() else np.empty(0, dtype=np.int64)
    if len(at):
        out[at] = mix(acc[at + take])
    for i in np.flatnonzero((counts > 0) & ~long):
        w = hashes[first[i] : first[i + 1]]
        length = np.array([len(w)], dtype=np.uint64) * U64(0xA24BAED4963EE407)
        out[bounds[i]] = mix((w * _SHINGLE[: len(w)]).sum(keepdims=True) + length)[0]
    return out, bounds
