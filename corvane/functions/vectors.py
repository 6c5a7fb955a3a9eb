"""Vector scalars over array columns, with sums in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n)))[0]


def cosine(a: Column, b: Column, epsilon: float | None = None) -> Column:
    """Cosine in -1 to 1. Zero vectors give 0, or with ``epsilon`` that is added to the norms' product."""
    n = norm(a) * norm(b)
    raw = dot(a, b) / (n + F.lit(epsilon)) if epsilon is not None else F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.when(n != 0, n))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def nearness(a: Column, b: Column) -> Column:
    return 1 / (1 + euclidean(a, b))


def analogy(a: Column, b: Column, c: Column) -> Column:
    """a - b + c."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x.cast("double") - y), c, lambda x, y: x + y)


def similarity_band(s: Column) -> Column:
    return F.when(s > 0.95, "near-identical").when(s > 0.80, "very similar").when(s > 0.50, "related").when(s > 0.10, "weak").otherwise("unrelated")


def half_away(x: Column, digits: int) -> Column:
    """A double rounded as SQL engines in C do: halves of the scaled double away from zero, the sign of zero kept."""
    scaled = x * F.lit(10.0**digits)
    whole = F.when(F.abs(scaled - F.rint(scaled)) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(F.rint(scaled)) / F.lit(10.0**digits)
    return F.when(F.abs(whole) < float("inf"), whole).otherwise(x)


def rounded(v: Column, digits: int) -> Column:
    return F.transform(v, lambda x: half_away(x, digits))
