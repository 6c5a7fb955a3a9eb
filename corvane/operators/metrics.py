"""Retrieval metrics over rows (query_id, doc_id, rank, rel), one aggregation per call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(results: DataFrame, qrels: DataFrame) -> DataFrame:
    """Results with rel from qrels (query_id, doc_id, rel), 0 where there is no judgement."""
    return results.join(qrels.select("query_id", "doc_id", "rel"), ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def hits(k: int, threshold: float = 1) -> Column:
    return F.sum(F.when((F.col("rank") <= k) & (F.col("rel") >= threshold), 1).otherwise(0))


def precision(k: int, threshold: float = 1, divisor: str = "k") -> Column:
    """Hits over k ("k"; 0 for k = 0), over the smaller of k and the results ("retrieved"), or over max(k, 1) ("at_least_one")."""
    n = F.sum(F.when(F.col("rank") <= k, 1).otherwise(0))
    if divisor == "k":
        return hits(k, threshold) / k if k else F.lit(0.0) * F.count("*")
    return hits(k, threshold) / (F.greatest(n, F.lit(1)) if divisor == "retrieved" else max(k, 1))


def recall(k: int, n_relevant: Column, threshold: float = 1) -> Column:
    return F.coalesce(hits(k, threshold) / F.nullif(F.max(n_relevant), F.lit(0)), F.lit(0.0))


def reciprocal_rank(k: int | None = None, threshold: float = 1) -> Column:
    seen = F.col("rel") >= threshold if k is None else (F.col("rel") >= threshold) & (F.col("rank") <= k)
    return F.coalesce(1 / F.min(F.when(seen, F.col("rank"))), F.lit(0.0))


def gain(rel: Column, exponential: bool) -> Column:
    return F.pow(F.lit(2.0), rel) - 1 if exponential else rel.cast("double")


def with_ideal(results: DataFrame) -> DataFrame:
    """Adds ideal: the rank by falling rel within the retrieved list, and the running hits."""
    by = Window.partitionBy("query_id")
    return results.withColumn("ideal", F.row_number().over(by.orderBy(F.desc("rel"), "rank")))


def dcg(rank: str, k: int, exponential: bool) -> Column:
    return F.sum(F.when(F.col(rank) <= k, gain(F.col("rel"), exponential) / F.log2(F.col(rank) + 1)).otherwise(0.0))


def ndcg_retrieved(k: int, exponential: bool = True) -> Column:
    """The ideal is the retrieved list's own best order; without any gain 1. Needs with_ideal()."""
    best = dcg("ideal", k, exponential)
    return F.when(best == 0, F.lit(1.0)).otherwise(dcg("rank", k, exponential) / F.nullif(best, F.lit(0.0)))


def average_precision_retrieved(results: DataFrame, threshold: float = 1) -> DataFrame:
    """query_id, ap: mean over the retrieved relevant ranks of hits so far over rank; 0 without any."""
    by = Window.partitionBy("query_id").orderBy("rank")
    flag = F.when(F.col("rel") >= threshold, 1).otherwise(0)
    run = results.withColumn("hit", flag).withColumn("so_far", F.sum("hit").over(by))
    return run.groupBy("query_id").agg(F.coalesce(F.sum(F.col("hit") * F.col("so_far") / F.col("rank")) / F.nullif(F.sum("hit"), F.lit(0)), F.lit(0.0)).alias("ap"))


def ndcg_by_ideal_order(results: DataFrame, ideal: DataFrame, k: int) -> DataFrame:
    """query_id, ndcg with gain 2 for the ideal order's first document, 1 for its others, 0 else; 0 without an ideal.

    ``ideal``: query_id, doc_id, place (from 1).
    """
    g = lambda p: F.when(p == 1, 2.0).when(p > 1, 1.0).otherwise(0.0)
    best = ideal.where(F.col("place") <= k).groupBy("query_id").agg(F.sum(g(F.col("place")) / F.log2(F.col("place") + 1)).alias("best"))
    own = results.where(F.col("rank") <= k).join(ideal, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.sum(g(F.col("place")) / F.log2(F.col("rank") + 1)).alias("dcg"))
    return own.join(best, "query_id", "left").select("query_id", F.coalesce(F.col("dcg") / F.nullif("best", F.lit(0.0)), F.lit(0.0)).alias("ndcg"))


def compared(a: DataFrame, b: DataFrame, margin: float = 0.03) -> DataFrame:
    """metric, delta, verdict of two frames (metric, value): beyond ``margin`` REGRESSION or IMPROVEMENT, else stable."""
    delta = F.round(F.col("b.value") - F.col("a.value"), 6)
    both = a.alias("a").join(b.alias("b"), F.col("a.metric") == F.col("b.metric")).select(F.col("a.metric").alias("metric"), delta.alias("delta"))
    return both.withColumn("verdict", F.when(F.col("delta") < -margin, "REGRESSION").when(F.col("delta") > margin, "IMPROVEMENT").otherwise("stable"))
