"""Exact vector search: a stated set of queries, in blocks, against all rows.

A block of queries travels to the executors as one matrix; every Arrow batch of the corpus is multiplied with it and gives its
k best for each query, and a window keeps the best of these. What is sent is bounded by ``block`` whatever the corpus's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.lexical import top_k


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def scanner(ids: np.ndarray, queries: np.ndarray, k: int, metric: str, digits: int = 9):
    def run(batches):
        for batch in batches:
            rows = matrix(batch.column(1))
            if not rows.size:
                continue
            if metric == "cosine":
                rows = rows / np.where((n := np.linalg.norm(rows, axis=1, keepdims=True)) == 0, 1.0, n)
            own = batch.column(0).to_numpy()
            scores = rows @ queries.T
            if metric == "epsilon":
                norms = np.outer(np.linalg.norm(rows, axis=1), np.linalg.norm(queries, axis=1))
                norms += 1e-10
                scores /= norms
            np.round(scores, digits, out=scores)
            keep = min(k, len(own))
            least = np.partition(scores, len(own) - keep, axis=0)[len(own) - keep]
            row, col = np.nonzero(scores >= least)
            order = np.lexsort((own[row], -scores[row, col], col))
            row, col = row[order], col[order]
            nth = np.arange(len(col)) - np.searchsorted(col, col)
            row, col = row[nth < keep], col[nth < keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids[col]), pa.array(own[row]), pa.array(scores[row, col])], names=["query_id", "id", "score"])

    return run


def bounded(queries: DataFrame, most: int, *columns: str) -> pa.Table:
    """The queries as one table on the driver; more than ``most`` are an error, to be paged by the caller or searched by a join."""
    got = queries.select(*columns).limit(most + 1).toArrow()
    if got.num_rows > most:
        raise ValueError(f"more than {most} queries; search them in pages")
    return got


def vector_search(corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "dot", block: int = 2048, most: int = 200_000, digits: int = 9) -> DataFrame:
    """query_id, id, score, rank: the ``k`` rows of ``corpus`` (id, vector) with the largest score for each query (query_id, vector).

    metric: dot, or cosine with rows normalised; queries are normalised in both (norm + 1e-10), in raw nothing is. In epsilon
    the dot product is divided by the product of both norms + 1e-10. Scores are rounded to ``digits`` before they are ranked,
    ties go to the smaller id. At most ``most`` queries are taken, more are an error.
    """
    got = bounded(queries, most, "query_id", "vector")
    out = None
    for at in range(0, max(got.num_rows, 1), block):
        part = got.slice(at, block).combine_chunks()
        q = matrix(part.column("vector").combine_chunks()) if part.num_rows else np.zeros((0, 1))
        q = q if metric in ("raw", "epsilon") else q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-10)
        ids = part.column("query_id").to_numpy()
        found = corpus.select(F.col("id").cast("long"), "vector").where("vector is not null").mapInArrow(scanner(ids, q, k, metric, digits), "query_id long, id long, score double")
        out = found if out is None else out.union(found)
    return top_k(out, k, id="id")


def above_threshold(corpus: DataFrame, queries: DataFrame, threshold: float, k: int, most: int = 2048) -> DataFrame:
    """query_id, id, score of every row whose dot product reaches ``threshold``, and in any case of the ``k`` best of every query.

    The scan drops all others, so what leaves it is what is asked for and ``k`` rows a batch.
    """
    got = bounded(queries, most, "query_id", "vector")
    q = matrix(got.column("vector").combine_chunks()) if got.num_rows else np.zeros((0, 1))
    q = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-10)
    ids = got.column("query_id").to_numpy()

    def run(batches):
        for batch in batches:
            rows = matrix(batch.column(1))
            if rows.size and len(ids):
                scores = np.round(rows @ q.T, 9)
                row, col = np.nonzero(scores >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(ids[col]), batch.column(0).take(pa.array(row)), pa.array(scores[row, col])], names=["query_id", "id", "score"])

    rows = corpus.select(F.col("id").cast("long"), "vector").where("vector is not null")
    best = vector_search(corpus, queries, k).select("query_id", "id", "score").where(F.col("score") < threshold)
    return rows.mapInArrow(run, "query_id long, id long, score double").union(best)


def random_vectors(spark, n: int, dims: int, seed: int = 42) -> DataFrame:
    """id, vector: ``n`` seeded normal vectors of unit length, made where they are used."""
    from corvane.functions.vectors import normalized

    v = F.array(*[F.randn(seed + i) for i in range(dims)])
    return spark.range(n).select("id", v.alias("v")).select("id", normalized(F.col("v")).alias("vector"))


def prefiltered_search(corpus: DataFrame, queries: DataFrame, condition, k: int = 10, **options) -> DataFrame:
    """Filters, then searches: the filter reaches the scan."""
    return vector_search(corpus.where(condition), queries, k, **options)


def postfiltered_search(corpus: DataFrame, queries: DataFrame, condition, k: int = 10, overretrieve: int = 4, **options) -> DataFrame:
    """Searches ``k * overretrieve``, then filters; may give fewer than ``k``."""
    found = vector_search(corpus, queries, k * overretrieve, **options).drop("rank")
    return top_k(found.join(corpus.where(condition).select("id"), "id", "left_semi"), k, id="id")
