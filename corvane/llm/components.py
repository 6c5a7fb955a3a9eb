"""Connected components of a link table by alternating large-star and small-star steps; no link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.store import dropped, settled, tidy


def least_neighbour(edges: DataFrame) -> DataFrame:
    """u, v and m: the least of u and its neighbours. The minimum is taken map-side before the shuffle."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def both_of(edges: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """u, v: the pairs of columns named, each row's one after another. Unlike a union this plans ``edges`` once."""
    return edges.select(F.inline(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in ends])))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (least node reachable) of every node in ``links``; self-links, repeats and both directions are allowed.

    Each round at least halves the paths' length. It ends when every link leads straight to a node that has no lesser
    neighbour, or when the links stop changing, however many rounds that takes. Without links the result is empty.
    """
    return counted_components(links, a, b)[1]


def counted_components(links: DataFrame, a: str, b: str) -> tuple[int, DataFrame]:
    """(number of distinct links, components())."""
    edges = settled(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    mark = n = None
    while True:
        with tidy(links.sparkSession):
            lower = edges.select(F.col("v").alias("u")).distinct().withColumn("leads", F.lit(1))
            now = edges.join(lower, "u", "left").agg(F.count("*").alias("n"), F.count_distinct("u").alias("k"), F.count("leads").alias("on"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        n = now["n"] if n is None else n
        if now == mark or not now["n"] or (now["n"] == now["k"] and not now["on"]):
            break
        mark = now
        both = both_of(edges, ("u", "v"), ("v", "u"))
        large = least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = least_neighbour(large)
        small = both_of(small, ("v", "m"), ("u", "m")).where("u <> v").distinct()
        new = settled(small, "links")
        dropped(edges)
        edges = new
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return n, edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
