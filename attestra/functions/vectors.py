"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))


def cosine(a: Column, b: Column, a2: Column | None = None, b2: Column | None = None) -> Column:
    """Cosine similarity; 0 for empty, unequally long or zero vectors.

    Pass precomputed squared norms when one vector meets many others.
    """
    na = squared_norm(a) if a2 is None else a2
    nb = squared_norm(b) if b2 is None else b2
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(usable, dot(a, b) / F.sqrt(na * nb)).otherwise(F.lit(0.0))


def valid_vector(col: Column) -> Column:
    """Non-empty and finite in every element."""
    ok = F.forall(col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce((F.size(col) > 0) & ok, F.lit(False))
