"""Column functions on vectors and token matrices, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of one length."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """The vector at unit length; null for the zero vector."""
    norm = l2_norm(a)
    return F.when(norm > 0, F.transform(a, lambda x: x.cast("double") / norm))


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each query token its best document token, summed."""
    best = F.transform(query, lambda t: F.array_max(F.transform(document, lambda u: dot(t, u))))
    return F.aggregate(best, F.lit(0.0), lambda acc, x: acc + x)


def is_matrix(tokens: Column, width: int) -> Column:
    """Whether a token matrix has rows and all of them the given width."""
    return (F.size(tokens) > 0) & F.forall(tokens, lambda t: F.size(t) == width)
