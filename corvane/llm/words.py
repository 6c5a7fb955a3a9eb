"""Vectorised words and hashes over Arrow string columns.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. A word is known by a 64-bit hash of its bytes, a run of words by
a 64-bit hash of its words' hashes; two different ones share a hash with probability 2**-64.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15
#: Bytes of text handled at a time, so that work arrays stay near 50 MB.
SLAB = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(BASE))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least n of them, kept for the life of the process.

    They stand in a module of their own, as what this module's names hold would travel with every function sent to executors.
    """
    home = sys.modules.setdefault("_corvane_powers", types.ModuleType("_corvane_powers"))
    held = getattr(home, "tables", None)
    if held is None or len(held[0]) < n:
        size = max(n, SLAB + 1)
        held = home.tables = powers(BASE, size), powers(pow(BASE, -1, 1 << 64), size)
    return held


def run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of values[s:e], alike for equal contents wherever they stand."""
    up, down = power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class Words:
    """Words of the documents of one slab: byte starts and ends, the first word of each document (and one past the last)."""

    def __init__(self, column: pa.Array, lower: bool):
        a = pc.fill_null(column.cast(pa.large_string()), "")
        off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
        raw = a.buffers()[2] if len(a) else None
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.data = LOWER[data] if lower else data
        word = ~BLANK[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        full = self.off[:-1] < self.off[1:]
        at, to = self.off[:-1][full], self.off[1:][full] - 1
        first[at] = word[at]
        last[to] = word[to]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.off)

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.count)

    def hashes(self) -> np.ndarray:
        return run_hash(BYTE[self.data], self.start, self.end)


def slabs(batch: pa.RecordBatch, name: str, lower: bool, most: int = SLAB):
    """(row offset, rows, Words) for stretches of a batch with about ``most`` bytes of text; a longer document comes alone."""
    column = batch.column(batch.schema.get_field_index(name))
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield at, to - at, Words(column.slice(at, to - at), lower)
        at = to


def sort_within(values: np.ndarray, edges: np.ndarray) -> None:
    """Sorts each stretch between successive edges, in place; far quicker than one sort by two keys."""
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every run of k words inside one document, in order of place."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for i in range(1, k):
        out *= U(BASE)
        out += h[i : i + n]
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[:n] == doc[k - 1 :]
    return mix(out[whole] ^ U(k)), doc[:n][whole]


def places(first: np.ndarray, k: int) -> np.ndarray:
    """Index of the first word of every run that grams() gives."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.flatnonzero(doc[:n] == doc[k - 1 :])
