"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

The index holds a bounded number of labelled examples with all their terms. A term's weight is its inverse document frequency,
counted over all documents, times its relevance frequency: how many more of the examples with it are toxic than not
(``log2(2 + a / max(1, c))``, to the power ``sharpness``). With the plain weight neighbours share a topic, not a tone.
Examples lie in blocks; for every term and block the largest weight is kept, so that the sum of a query's weights times
these maxima bounds every cosine in the block, and blocks whose bound doesn't exceed the k-th best cosine so far are
skipped without changing the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.words import BYTE, Words, run_hash, slabs, sort_within

BLOCK = 32
FIRST = 8
#: Bytes that end a token here besides blanks: ASCII punctuation.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term hash, count), ordered by document and hash. Terms are words cut at punctuation, lower-cased."""
    stop = np.zeros(256, bool)
    stop[[32, 9, 10, 11, 12, 13, *PUNCTUATION]] = True
    inside = ~stop[words.data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = words.off[:-1] < words.off[1:]
    at, to = words.off[:-1][full], words.off[1:][full] - 1
    first[at], last[to] = inside[at], inside[to]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(words.off, start, "right") - 1
    h = run_hash(BYTE[words.data], start, end)
    sort_within(h, np.searchsorted(doc, np.arange(len(words) + 1)))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def found_in(vocabulary: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which hashes are in the vocabulary, their places there)."""
    if not len(vocabulary) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    some = np.flatnonzero(vocabulary[at] == h)
    return some, at[some]


def bags(batches):
    """Distinct terms and counts of each labelled example."""
    for batch in batches:
        rows = []
        for at, n, words in slabs(batch, "text", True):
            doc, h, times = terms(words)
            edge = np.searchsorted(doc, np.arange(n + 1))
            rows += [(batch.column(1)[at + k].as_py(), batch.column(2)[at + k].as_py(), h[edge[k] : edge[k + 1]].view(np.int64), times[edge[k] : edge[k + 1]]) for k in range(n)]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "label", "terms", "times"])


def frequencies(vocabulary: np.ndarray):
    """Document frequencies of the vocabulary in one partition."""

    def run(batches):
        df, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, _, words in slabs(batch, "text", True):
                df += np.bincount(found_in(vocabulary, terms(words)[1])[1], minlength=len(vocabulary))
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], n))], names=["term", "n"])

    return run


class BlockMaxIndex:
    """Unit TF-IDF vectors of the examples, in blocks of ``BLOCK``, with each term's largest weight in each block it occurs in."""

    def __init__(self, vocabulary, weights, examples, y, ids):
        self.vocabulary, self.weights = vocabulary, np.asarray(weights, float)
        vectors = [self.vector(*e) for e in examples]
        order = like_together(vectors, examples, y, len(vocabulary))
        self.place = np.argsort(order)  # of each example as given
        self.y, self.ids = np.asarray(y, float)[order], np.asarray(ids)[order]
        vectors = [vectors[j] for j in order]
        self.blocks = -(-len(order) // BLOCK)
        join = lambda i, t: np.concatenate([v[i] for v in vectors] or [np.zeros(0)]).astype(t)
        term, weight = join(0, np.int64), join(1, np.float64)
        owner = np.repeat(np.arange(len(vectors)), np.array([len(v[0]) for v in vectors], np.int64))
        by = np.lexsort((owner, term))
        term, self.weight, self.owner = term[by], weight[by], owner[by]
        block = self.owner // BLOCK
        new = np.ones(len(term), bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.start = np.append(np.flatnonzero(new), len(term))  # postings of each pair of term and block
        self.block = block[self.start[:-1]]
        self.top = np.maximum.reduceat(self.weight, self.start[:-1]) * (1 + 1e-9) if len(term) else np.zeros(0)
        self.first = np.searchsorted(term[self.start[:-1]], np.arange(len(vocabulary) + 1))

    def __getstate__(self) -> dict:
        """Places travel as 32 bits; a search takes them as 64, which numpy would widen in every call."""
        return self.__dict__ | {"owner": self.owner.astype(np.int32), "block": self.block.astype(np.int32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"owner": state["owner"].astype(np.int64), "block": state["block"].astype(np.int64)})

    def vector(self, h: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the vocabulary, weight) with unit length; empty without a term of the vocabulary."""
        some, term = found_in(self.vocabulary, h)
        w = (1 + np.log(times[some])) * self.weights[term]
        return term, w / (np.sqrt((w * w).sum()) or 1.0)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places of the examples, cosines) of the k nearest by cosine above 0, ties to the lower place. Exact."""
        pair, times = stretched(self.first[term], self.first[term + 1])
        if not len(pair):
            return np.zeros(0, np.int64), np.zeros(0)
        share = np.repeat(weight, times)
        block = self.block[pair]
        bound = np.bincount(block, weights=self.top[pair] * share, minlength=self.blocks)
        order = np.argsort(-bound, kind="stable")
        place, cosine = np.zeros(0, np.int64), np.zeros(0)
        at, size, least = 0, FIRST, 0.0
        while at < len(order) and bound[order[at]] > 0 and bound[order[at]] >= least:
            taken = order[at : at + size]
            taken = taken[(bound[taken] > 0) & (bound[taken] >= least)]
            wanted = np.zeros(self.blocks, bool)
            wanted[taken] = True
            own = np.flatnonzero(wanted[block])
            spot, n = stretched(self.start[pair[own]], self.start[pair[own] + 1])
            got = np.bincount(self.owner[spot], weights=self.weight[spot] * np.repeat(share[own], n), minlength=len(self.y))
            p = np.flatnonzero(got > 0)
            if skip is not None:
                p = p[p != skip]
            place, cosine = np.concatenate([place, p]), np.concatenate([cosine, got[p]])
            if len(cosine) > k:  # what rounds to less than the k-th best cosine does needn't be sorted
                some = np.flatnonzero(cosine >= np.partition(cosine, -k)[-k] - 2e-12)
                place, cosine = place[some], cosine[some]
            best = np.lexsort((place, -np.round(cosine, 12)))[:k]
            place, cosine = place[best], cosine[best]
            at, size = at + size, size * 4
            if len(cosine) == k:
                least = cosine[-1] - 1e-12
        return place, cosine

    def vote(self, cosine: np.ndarray, label: np.ndarray, prior: float) -> float:
        """Share of the toxic label among the neighbours, each weighing cosine / (1 - cosine + 0.1), the prior one half."""
        w = cosine / (1.1 - cosine)
        return float((prior * 0.5 + (w * label).sum()) / (0.5 + w.sum()))


def stretched(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all places of the ranges one after another, their sizes)."""
    n = stop - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def like_together(vectors, examples, y, size: int) -> list[int]:
    """An order of the examples in which those with the same most common word, and then the same label, stand together."""
    common = np.zeros(size, np.int64)
    for term, _ in vectors:
        common[term] += 1
    lead = [int(term[np.argmax(common[term])]) if len(term) else -1 for term, _ in vectors]
    return sorted(range(len(vectors)), key=lambda j: (lead[j], -y[j], examples[j][0].tolist()))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", most: int = 4000, sharpness: float = 2.0, k: int = 15) -> dict:
    """The index over at most ``most`` labelled documents with ``train`` true, those with the least hash of doc_id.

    The bound keeps what reaches the driver and the executors at some tens of MB. All terms of the examples count, with document
    frequencies from all of ``docs``. Votes are calibrated by a logistic curve fitted on the examples, each judged by the others.
    Rows with a null label or doc_id aren't used, repeated labels of a document count once; rows of ``docs`` that share a
    labelled doc_id are examples each; without examples every score is the prior, a half.
    """
    rows = labels.where(train & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("__label")).dropDuplicates(["doc_id"])
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    got = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").select("text", "doc_id", F.col("__label").alias("label")).mapInArrow(bags, "doc_id long, label int, terms array<long>, times array<long>").toArrow()
    got = got.sort_by("doc_id")
    y = got.column("label").to_numpy().astype(float) if got.num_rows else np.zeros(0)
    ids = got.column("doc_id").to_numpy() if got.num_rows else np.zeros(0, np.int64)
    flat = [got.column(c).combine_chunks() for c in ("terms", "times")]
    edge = flat[0].offsets.to_numpy()
    every, times = flat[0].values.to_numpy().view(np.uint64), flat[1].values.to_numpy()
    examples = [(every[a:b], times[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    vocabulary, back = np.unique(every, return_inverse=True)
    toxic = np.bincount(back, weights=np.repeat(y, np.diff(edge)), minlength=len(vocabulary))
    clean = np.bincount(back, minlength=len(vocabulary)) - toxic
    relevance = np.log2(2 + toxic / np.maximum(clean, 1)) ** sharpness
    counted = docs.select("text").mapInArrow(frequencies(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    df = np.zeros(len(vocabulary))
    df[at[at >= 0]] = n[at >= 0]
    total = int(n[at < 0].sum())
    index = BlockMaxIndex(vocabulary, (np.log((total + 1) / (df + 1)) + 1) * relevance, examples, y, ids)
    prior = float((y.sum() + 0.5) / (len(y) + 1))
    votes = np.zeros(len(y))
    for j, (h, t) in enumerate(examples):
        p, c = index.nearest(*index.vector(h, t), k, int(index.place[j]))
        votes[j] = index.vote(c, index.y[p], prior)
    pa.default_memory_pool().release_unused()
    return {"index": index, "prior": prior, "k": k, "curve": calibrated(votes, y)}


def calibrated(votes: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and offset of a logistic curve from a vote's log-odds to the label, by Newton's steps with a weak prior."""
    x = np.log(np.clip(votes, 1e-4, 1 - 1e-4) / (1 - np.clip(votes, 1e-4, 1 - 1e-4)))
    a, b = 1.0, 0.0
    for _ in range(30 if len(y) else 0):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * x).sum() - 0.1 * (a - 1), (y - p).sum() - 0.1 * b])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a + step[0], 0.05), b + step[1]
    return a, b


def judging(state: dict, evidence: int):
    def run(batches):
        index, k, (a, b) = state["index"], state["k"], state["curve"]
        for batch in batches:
            score, ids, cosines = np.zeros(batch.num_rows), [], []
            for at, n, words in slabs(batch, "text", True):
                doc, h, times = terms(words)
                edge = np.searchsorted(doc, np.arange(n + 1))
                for j in range(n):
                    p, c = index.nearest(*index.vector(h[edge[j] : edge[j + 1]], times[edge[j] : edge[j + 1]]), k)
                    v = min(max(index.vote(c, index.y[p], state["prior"]), 1e-4), 1 - 1e-4)
                    score[at + j] = 1 / (1 + np.exp(-(a * np.log(v / (1 - v)) + b)))
                    ids.append(index.ids[p[:evidence]].tolist())
                    cosines.append(c[:evidence].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], names=["doc_id", "score", "neighbours", "cosines"])

    return run


def toxicity_scores(docs: DataFrame, state: dict, evidence: int = 3) -> DataFrame:
    """doc_id, score (0 to 1) and the nearest examples' doc_ids and cosines for every row of ``docs`` (doc_id, text).

    Null and empty texts, and texts without a term of any example, have no neighbours and the calibrated prior as score.
    One pass without a shuffle; repeated rows get equal scores; ties between examples go to the lower place in the index; an
    empty table gives an empty result; further columns are ignored, lang, source and doc_id are no inputs.
    """
    return docs.select("doc_id", "text").mapInArrow(judging(state, evidence), "doc_id long, score double, neighbours array<long>, cosines array<double>")
