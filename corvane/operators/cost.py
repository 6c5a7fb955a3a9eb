"""Token prices: per-million arithmetic over a price table (model, input, output, cache_write, cache_read, window)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MILLION = 1_000_000
#: Sample prices per million tokens by size of model; a deployment brings its own table.
PRICES = [("small", 0.80, 4.00, 1.00, 0.08, 200_000), ("medium", 3.00, 15.00, 3.75, 0.30, 200_000), ("large", 15.00, 75.00, 18.75, 1.50, 200_000)]
PRICE_SCHEMA = "model string, input double, output double, cache_write double, cache_read double, window long"


def estimated_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, n_in, n_out, ...) with cost, rounded to six places; an unknown model costs 0."""
    cost = F.round((F.col("n_in") * F.coalesce("input", F.lit(0.0)) + F.col("n_out") * F.coalesce("output", F.lit(0.0))) / MILLION, 6)
    return usage.join(F.broadcast(prices), "model", "left").select(*usage.columns, cost.alias("cost"))


def query_cost(n_in: Column, n_out: Column, written: Column, read: Column) -> Column:
    """With the price columns in scope: what is written to or read from the cache isn't charged as input again."""
    regular = F.greatest(n_in - written - read, F.lit(0))
    return (regular * F.col("input") + n_out * F.col("output") + written * F.col("cache_write") + read * F.col("cache_read")) / MILLION


def monthly(cost: Column, per_day: Column) -> Column:
    return cost * per_day * 30


def cached_plan_cost(base: Column, variable: Column, n_out: Column, per_day: Column) -> Column:
    """A month's cost with the base cached if it has at least 1,024 tokens: 30 writes, the rest reads."""
    calls = per_day * 30
    writes = F.least(calls, F.lit(30))
    cached = (writes * base * F.col("cache_write") + (calls - writes) * base * F.col("cache_read")) / MILLION
    plain = calls * base * F.col("input") / MILLION
    return F.when(base >= 1024, cached).otherwise(plain) + calls * (variable * F.col("input") + n_out * F.col("output")) / MILLION


def break_even() -> Column:
    """Reads after which a cached block has paid for its write."""
    return F.ceil((F.col("cache_write") - F.col("input")) / (F.col("input") - F.col("cache_read")))


def embedding_cost(chars: Column, price: float = 0.06) -> Column:
    return F.floor(chars / 4) * price / MILLION


def storage_bytes(n: Column, dims: Column) -> Column:
    return n * dims * 4
