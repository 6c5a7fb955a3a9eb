"""Metadata conditions compiled to one predicate, so that it can be pushed to the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "in": lambda c, v: c.isin(*v) if v else F.lit(False),
    "nin": lambda c, v: ~c.isin(*v) if v else c.isNotNull(),
    "gte": lambda c, v: c >= v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
}


def metadata_filter(conditions: list[tuple[str, str, object]], metadata: str | None = None) -> Column:
    """AND of (field, operator, value); a missing field (null) rejects for every operator, no condition accepts all.

    Fields are columns, or with ``metadata`` keys of that map. An unknown operator raises; passing it silently hid mistakes.
    """
    for _, op, _ in conditions:
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op!r}; known: {', '.join(OPERATORS)}")
    field = lambda f: F.try_element_at(F.col(metadata), F.lit(f)) if metadata else F.col(f)
    return reduce(lambda a, b: a & b, [F.coalesce(OPERATORS[op](field(f), v), F.lit(False)) for f, op, v in conditions], F.lit(True))


def above_or_top(scores: DataFrame, threshold: float, k: int, query: str = "query_id", id: str = "doc_id") -> DataFrame:
    """Rows with score >= threshold; for a query without any, its ``k`` best."""
    by = Window.partitionBy(query)
    ranked = scores.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), id))).withColumn("best", F.max("score").over(by))
    return ranked.where((F.col("score") >= threshold) | ((F.col("best") < threshold) & (F.col("rank") <= k))).drop("best")


def excluded(frame: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    return frame.join(other.select(*keys), list(keys), "left_anti")
