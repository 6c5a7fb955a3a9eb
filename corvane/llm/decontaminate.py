"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

A short item inside a long document has a tiny Jaccard similarity with the whole, so items are partitioned by size and a
document is cut, for a partition of items with up to u shingles, into overlapping segments of 2u shingles. A segment that
holds an item's passage is then at least about a fifth similar to it, and one equal minimum among ``HASHES`` makes a
candidate. Candidates are verified by the share of the item's shingles that the whole document has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.words import U, Words, grams, mix, slabs

HASHES = 48
SMALLEST = 8
FOUND = "doc_id long, item_id long, n_item int, n_shared int"


def multipliers() -> np.ndarray:
    return mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | U(1)


class Items:
    """Shingle sets of a block of items; items with few shingles are searched by all of these, the others by minima."""

    def __init__(self, ids: list[int], texts: list[str], size: int):
        words = Words(pa.array(texts, pa.large_string()), True)
        h = words.hashes()
        self.ids, self.sets, self.width = [], [], []
        for i, item in enumerate(ids):
            own = h[words.first[i] : words.first[i + 1]]
            if len(own):
                width = min(size, len(own))
                self.ids.append(item)
                self.width.append(width)
                self.sets.append(np.unique(grams(own, np.array([0, len(own)]), width)[0]))
        sizes = np.array([len(s) for s in self.sets], np.int64)
        self.tiny = [i for i, n in enumerate(sizes) if n < SMALLEST or self.width[i] < size]
        level = np.maximum(0, np.ceil(np.log2(np.maximum(sizes, 1) / SMALLEST))).astype(int)
        tiny = set(self.tiny)
        self.levels = {int(k): [i for i in np.flatnonzero(level == k).tolist() if i not in tiny] for k in np.unique(level)}
        self.levels = {k: v for k, v in self.levels.items() if v}
        self.minima = {k: np.array([[(self.sets[i] * a).min() for i in v] for a in multipliers()]) for k, v in self.levels.items()}
        self.size = size

    def candidates(self, words: Words, h: np.ndarray, shingle: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
        found: set[tuple[int, int]] = set()
        for width in sorted({self.width[i] for i in self.tiny}):
            s, d = (shingle, doc) if width == self.size else grams(h, words.first, width)
            own = [i for i in self.tiny if self.width[i] == width]
            value = np.concatenate([self.sets[i] for i in own])
            item = np.repeat(own, [len(self.sets[i]) for i in own])
            found |= matches(value, item, s, d)
        if not len(shingle) or not self.levels:
            return found
        count = np.bincount(doc, minlength=len(words))
        first = np.cumsum(count) - count
        place = np.arange(len(doc)) - first[doc]
        edges = np.flatnonzero(place % SMALLEST == 0)
        owner = [doc[edges]]
        steps = []
        for _ in range(max(self.levels)):  # halves the number of blocks, never across documents
            d = owner[-1]
            start = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            nth = np.arange(len(d)) - np.repeat(start, np.diff(np.append(start, len(d))))
            keep = np.flatnonzero(nth % 2 == 0)
            steps.append(keep)
            owner.append(d[keep])
        for k, a in enumerate(multipliers()):
            low = np.minimum.reduceat(shingle * a, edges)
            for level in range(max(self.levels) + 1):
                d = owner[level]
                if level in self.levels:
                    joined = low.copy()
                    same = d[:-1] == d[1:]
                    joined[:-1][same] = np.minimum(low[:-1], low[1:])[same]
                    found |= matches(self.minima[level][k], np.array(self.levels[level]), joined, d)
                if level < max(self.levels):
                    low = np.minimum.reduceat(low, steps[level])
        return found


def matches(value: np.ndarray, item: np.ndarray, probe: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
    order = np.argsort(value)
    value, item = value[order], item[order]
    at = np.searchsorted(value, probe)
    hit = np.flatnonzero(value[np.minimum(at, len(value) - 1)] == probe) if len(value) else []
    out = set()
    for j in hit:
        for i in range(at[j], len(value)):
            if value[i] != probe[j]:
                break
            out.add((int(doc[j]), int(item[i])))
    return out


def search(items: Items, percent: int):
    def run(batches):
        for batch in batches:
            out = []
            ids = batch.column(0)
            for at, _, words in slabs(batch, "text", True):
                h = words.hashes()
                shingle, doc = grams(h, words.first, items.size)
                first = np.searchsorted(doc, np.arange(len(words) + 1))
                for d, i in sorted(items.candidates(words, h, shingle, doc)):
                    own = shingle[first[d] : first[d + 1]]
                    if items.width[i] != items.size:
                        part = h[words.first[d] : words.first[d + 1]]
                        own = grams(part, np.array([0, len(part)]), items.width[i])[0]
                    n = len(items.sets[i])
                    shared = int(np.isin(items.sets[i], own).sum())
                    if 100 * shared >= percent * n:
                        out.append((ids[at + d].as_py(), items.ids[i], n, shared))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "n_item", "n_shared"])

    return run


def contained_items(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80, block_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, item_id, n_item, n_shared: every pair where the document has at least ``percent`` of the item's shingles.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text. Words are lower-cased (A-Z); an item of fewer than ``size``
    words is one shingle of its length; null, empty and blank items and documents match nothing; repeated rows match each for
    itself; further columns are ignored. The benchmark is searched in blocks of at most about ``block_bytes`` of text (one
    longer item alone), so what is sent to the executors is bounded whatever its size; the documents aren't shuffled.
    """
    sized = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    out = None
    for b in range(blocks):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows], size)
        found = docs.select("doc_id", "text").mapInArrow(search(items, percent), FOUND)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; all columns stay as they are."""
    return docs.join(contained_items(docs, benchmark, size, percent).select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)
