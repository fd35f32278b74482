"""Vector functions as Column expressions; sums run in component order as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 for null vectors, different lengths and zero norms. Norms may be given."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    comparable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(comparable, dot(a, b) / (na * nb)).otherwise(0.0)


def is_valid(v: Column, most: int = 16383) -> Column:
    """Not empty, not too long, all components finite, some norm."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & (F.size(v) <= most) & finite & (norm(v) > 0), F.lit(False))


def half_up(x: Column, digits: int = 3) -> Column:
    """Rounded half up (towards positive infinity)."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)
