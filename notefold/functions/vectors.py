"""Vectors as JVM expressions: validity and cosine similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_ok(c: Column | str, dims: int) -> Column:
    """Whether a vector is of use: ``dims`` finite numbers, not all zero. Null is not."""
    c = F.col(c) if isinstance(c, str) else c
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) == dims) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """In double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """The length of a vector, 1 for the zero vector."""
    n = F.sqrt(dot(a, a))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def similarity(a: Column, b: Column) -> Column:
    """The cosine, held to 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))
