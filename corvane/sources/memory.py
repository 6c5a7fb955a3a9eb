"""Corpora given as Python values or as tables, with their metadata as one map."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus(spark: SparkSession, rows: Iterable[dict]) -> DataFrame:
    """id, content, metadata of rows given as dictionaries; a missing metadata map is empty."""
    return spark.createDataFrame([(r["id"], r["content"], r.get("metadata") or {}) for r in rows], "id long, content string, metadata map<string,string>")


def knowledge_base(table: DataFrame, id: str, content: str, metadata: list[str]) -> DataFrame:
    """id, content, metadata of a table, the named columns as a map."""
    pairs = [x for c in metadata for x in (F.lit(c), F.col(c).cast("string"))]
    return table.select(id, F.col(content).alias("content"), F.create_map(*pairs).alias("metadata"))
