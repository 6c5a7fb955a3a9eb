"""Approximate vector search: inverted lists, product quantisation and per-partition proximity graphs.

Each kind has a builder that writes its index as tables once, and a search that reads no more of them than it needs: the cells a
query looks into, the codes without the vectors, the graphs as built. Codebooks and centroids are fitted on a bounded sample;
every row is indexed. Recall against the exact search is measured in tests.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.vectors import dot, normalized
from corvane.operators.dense import bounded, matrix, scanner
from corvane.operators.lexical import top_k
from corvane.sources.tables import written


def sample(corpus: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, those with the least hash of id."""
    got = corpus.where("vector is not null").orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toArrow()
    return matrix(got.column("vector").combine_chunks())


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.where((n := np.linalg.norm(x, axis=-1, keepdims=True)) == 0, 1.0, n)


def k_means(x: np.ndarray, k: int, rounds: int = 20, seed: int = 7, spherical: bool = True, tolerance: float = 1e-4) -> np.ndarray:
    """Centroids by k-means++ seeds and Lloyd's rounds; on the unit sphere, or plain."""
    rng = np.random.default_rng(seed)
    x = unit(x) if spherical else x
    k = min(k, len(x))
    centre = [x[rng.integers(len(x))]]
    for _ in range(1, k):
        far = np.min([((x - c) ** 2).sum(1) for c in centre], axis=0)
        centre.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))])
    c = np.array(centre)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, 1) if spherical else np.argmin(((x[:, None] - c) ** 2).sum(2), 1)
        new = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(k)])
        new = unit(new) if spherical else new
        moved = np.abs(new - c).max()
        c = new
        if moved < tolerance:
            break
    return c


def assigned(corpus: DataFrame, centroids: np.ndarray) -> DataFrame:
    """corpus with cell: the centroid with the largest dot product. Write it partitioned by cell to prune scans."""

    def run(batches):
        for batch in batches:
            rows = matrix(batch.column(1))
            cell = np.argmax(rows @ centroids.T, 1) if rows.size else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32))], names=["id", "vector", "cell"])

    return corpus.where("vector is not null").select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).mapInArrow(run, "id long, vector array<double>, cell int")


def build_ivf(corpus: DataFrame, lists: int = 16, most: int = 20_000) -> dict[str, DataFrame]:
    """Tables cells (id, vector, by cell) and centroids (cell, centroid) over ``corpus`` (id, vector)."""
    centroids = k_means(sample(corpus, most), lists)
    rows = corpus.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    return {"cells": written(assigned(corpus, centroids).repartition("cell"), "cells", "cell"), "centroids": written(rows.coalesce(1), "centroids")}


def ivf_lookup(index: dict[str, DataFrame], queries: DataFrame, k: int = 10, probe: int = 4, most: int = 20_000) -> DataFrame:
    """query_id, id, score, rank from the ``probe`` cells nearest to each query, scored exactly; other cells aren't read."""
    got = bounded(queries.select(F.col("query_id").alias("id"), "vector"), most, "id", "vector")
    c = index["centroids"].orderBy("cell").toArrow()
    centroids = matrix(c.column("centroid").combine_chunks())
    qm = unit(matrix(got.column("vector").combine_chunks())) if got.num_rows else np.zeros((0, centroids.shape[1] if centroids.size else 1))
    near = np.argsort(-(qm @ centroids.T), axis=1, kind="stable")[:, :probe] if got.num_rows and centroids.size else np.zeros((0, probe), int)
    ids = got.column("id").to_numpy()
    wanted = [int(x) for x in np.unique(near)]

    def run(batches):
        for batch in batches:
            cell = batch.column(2).to_numpy()
            for c in np.unique(cell):
                own = np.flatnonzero((near == c).any(1))
                if len(own):
                    yield from scanner(ids[own], qm[own], k, "dot")([batch.take(pa.array(np.flatnonzero(cell == c)))])

    cells = index["cells"].where(F.col("cell").isin(wanted)).select("id", "vector", "cell")
    return top_k(cells.mapInArrow(run, "query_id long, id long, score double"), k, id="id")


class Quantizer:
    """Product quantisation: M sub-spaces of K centroids each; a vector is M bytes."""

    def __init__(self, x: np.ndarray, m: int = 8, k: int = 256):
        if x.shape[1] % m:
            raise ValueError("dimensions must be a multiple of m")
        self.m, part = m, x.shape[1] // m
        self.books = [k_means(x[:, i * part : (i + 1) * part], k, 10, i, False) for i in range(m)]

    def encode(self, x: np.ndarray) -> np.ndarray:
        part = x.shape[1] // self.m
        return np.stack([np.argmin(((x[:, None, i * part : (i + 1) * part] - b) ** 2).sum(2), 1) for i, b in enumerate(self.books)], 1).astype(np.uint8)

    def scores(self, codes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Approximate dot products of every code with every query, by tables of partial products."""
        part = q.shape[1] // self.m
        return sum((q[:, i * part : (i + 1) * part] @ b.T)[:, codes[:, i]] for i, b in enumerate(self.books)).T


def build_pq(corpus: DataFrame, m: int = 8, centroids: int = 64, most: int = 5000) -> dict[str, DataFrame]:
    """Tables codes (id, code: m bytes), vectors (id, vector) and books (part, book: its centroids one behind another)."""
    pq = Quantizer(sample(corpus, most), m, centroids)

    def run(batches):
        for batch in batches:
            code = pq.encode(matrix(batch.column(1))) if batch.num_rows else np.zeros((0, m), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "code"])

    rows = corpus.select(F.col("id").cast("long"), "vector").where("vector is not null")
    books = corpus.sparkSession.createDataFrame([(i, b.shape[1], b.ravel().tolist()) for i, b in enumerate(pq.books)], "part int, width int, book array<double>")
    return {"codes": written(rows.mapInArrow(run, "id long, code binary"), "codes"), "vectors": written(rows, "vectors"), "books": written(books.coalesce(1), "books")}


def pq_lookup(index: dict[str, DataFrame], queries: DataFrame, k: int = 10, rerank: int = 10, most: int = 20_000) -> DataFrame:
    """The ``k * rerank`` best by quantised scores, from the codes alone; only these rows' vectors are read and scored exactly."""
    got = bounded(queries, most, "query_id", "vector")
    q = unit(matrix(got.column("vector").combine_chunks())) if got.num_rows else np.zeros((0, 1))
    ids = got.column("query_id").to_numpy()
    pq = Quantizer.__new__(Quantizer)
    pq.books = [np.array(r["book"]).reshape(-1, r["width"]) for r in index["books"].orderBy("part").collect()]
    pq.m = len(pq.books)

    def run(batches):
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            rough = pq.scores(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, pq.m), q)
            keep = min(k * rerank, batch.num_rows)
            best = np.argpartition(-rough, keep - 1, axis=0)[:keep]
            own = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(ids, keep)), pa.array(own[best].ravel()), pa.array(np.round(np.take_along_axis(rough, best, 0), 9).ravel())], names=["query_id", "id", "score"])

    rough = top_k(index["codes"].mapInArrow(run, "query_id long, id long, score double"), k * rerank, id="id").select("query_id", "id")
    exact = rough.join(index["vectors"], "id").join(queries.select("query_id", F.col("vector").alias("q")), "query_id")
    return top_k(exact.select("query_id", "id", F.round(dot(F.col("vector"), normalized(F.col("q"))), 9).alias("score")), k, id="id")


class Graph:
    """A layered proximity graph: a search walks down the layers greedily, then keeps a beam in the lowest."""

    def __init__(self, m: int = 16, build: int = 100, layers: int = 4, seed: int = 3):
        self.m, self.build, self.layers = m, build, layers
        self.rng = np.random.default_rng(seed)
        self.x: list[np.ndarray] = []
        self.links: list[dict[int, list[int]]] = [{} for _ in range(layers)]
        self.entry, self.top = -1, 0

    def distance(self, q: np.ndarray, nodes: list[int]) -> np.ndarray:
        return 1 - np.stack([self.x[n] for n in nodes]) @ q

    def beam(self, q: np.ndarray, start: list[int], width: int, layer: int) -> list[tuple[float, int]]:
        seen = set(start)
        todo = [(float(d), n) for d, n in zip(self.distance(q, start), start)]
        heapq.heapify(todo)
        best = [(-d, n) for d, n in todo]
        heapq.heapify(best)
        while todo:
            d, n = heapq.heappop(todo)
            if len(best) >= width and d > -best[0][0]:
                break
            new = [v for v in self.links[layer].get(n, []) if v not in seen]
            if not new:
                continue
            seen.update(new)
            for dv, v in zip(self.distance(q, new), new):
                if len(best) < width or dv < -best[0][0]:
                    heapq.heappush(todo, (float(dv), v))
                    heapq.heappush(best, (-float(dv), v))
                    if len(best) > width:
                        heapq.heappop(best)
        return sorted((-d, n) for d, n in best)

    def add(self, v: np.ndarray) -> None:
        node = len(self.x)
        self.x.append(v)
        level = min(int(-np.log(self.rng.random() + 1e-12) / np.log(self.m)), self.layers - 1)
        if self.entry < 0:
            self.entry, self.top = node, level
            return
        at = [self.entry]
        for layer in range(self.top, level, -1):
            at = [self.beam(v, at, 1, layer)[0][1]]
        for layer in range(min(level, self.top), -1, -1):
            found = self.beam(v, at, self.build, layer)
            near = [n for _, n in found[: self.m]]
            self.links[layer][node] = near
            for n in near:
                own = self.links[layer].setdefault(n, [])
                own.append(node)
                if len(own) > 2 * self.m:
                    order = np.argsort(self.distance(self.x[n], own))[: self.m]
                    self.links[layer][n] = [own[i] for i in order]
            at = [n for _, n in found]
        if level > self.top:
            self.entry, self.top = node, level

    def search(self, q: np.ndarray, k: int, width: int = 100) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = [self.entry]
        for layer in range(self.top, 0, -1):
            at = [self.beam(q, at, 1, layer)[0][1]]
        return self.beam(q, at, max(width, k), 0)[:k]


def build_graphs(corpus: DataFrame, rows: int = 20_000) -> dict[str, DataFrame]:
    """Table graphs: one graph for each stretch of at most ``rows`` rows of a task, as (ids, graph) in bytes."""

    def run(batches):
        def packed(graph, own):
            state = {"m": graph.m, "x": np.array(graph.x), "links": graph.links, "entry": graph.entry, "top": graph.top, "ids": own}
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state, 5)], pa.binary())], names=["graph"])

        graph, own = Graph(), []
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), unit(matrix(batch.column(1)))):
                graph.add(v)
                own.append(i)
                if len(own) >= rows:
                    yield packed(graph, own)
                    graph, own = Graph(), []
        if own:
            yield packed(graph, own)

    vectors = corpus.select(F.col("id").cast("long"), "vector").where("vector is not null")
    return {"graphs": written(vectors.mapInArrow(run, "graph binary"), "graphs")}


def graph_lookup(index: dict[str, DataFrame], queries: DataFrame, k: int = 10, width: int = 100, most: int = 2048) -> DataFrame:
    """Every graph searched for every query with a beam of ``width``; the best of all are merged. The graphs are read as built."""
    got = bounded(queries, most, "query_id", "vector")
    q = unit(matrix(got.column("vector").combine_chunks())) if got.num_rows else np.zeros((0, 1))
    ids = got.column("query_id").to_numpy()

    def run(batches):
        for batch in batches:
            for body in batch.column(0):
                state = pickle.loads(body.as_py())
                graph = Graph.__new__(Graph)
                graph.m, graph.x, graph.links, graph.entry, graph.top = state["m"], list(state["x"]), state["links"], state["entry"], state["top"]
                out = [(int(ids[j]), state["ids"][n], round(1 - d, 9)) for j in range(len(q)) for d, n in graph.search(q[j], k, width)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "id", "score"])

    return top_k(index["graphs"].mapInArrow(run, "query_id long, id long, score double"), k, id="id")


def recall(approximate: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """query_id, recall: share of the exact top k that was found."""
    hit = exact.join(approximate.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("recall"))
