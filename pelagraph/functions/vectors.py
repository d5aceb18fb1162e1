"""Vector functions on lists of numbers; null where the lengths differ. A zero vector has similarity 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pelagraph.functions.registry import plain


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _pairs(a: Column, b: Column, f) -> Column:
    both = F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double")))
    return F.when(F.size(a) == F.size(b), both)


def inner_product(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(inner_product(a, b), size))


def cross_product(a: Column, b: Column) -> Column:
    at = lambda v, i: v[i].cast("double")
    turn = [at(a, i) * at(b, j) - at(a, j) * at(b, i) for i, j in ((1, 2), (2, 0), (0, 1))]
    return F.when((F.size(a) == 3) & (F.size(b) == 3), F.array(*turn))


_ALL = {
    "inner_product": inner_product, "dot_product": inner_product, "cosine_similarity": cosine_similarity,
    "cosine_distance": lambda a, b: 1 - cosine_similarity(a, b), "squared_distance": squared_distance,
    "distance": lambda a, b: F.sqrt(squared_distance(a, b)), "l2_distance": lambda a, b: F.sqrt(squared_distance(a, b)),
    "l1_distance": lambda a, b: _sum(_pairs(a, b, lambda x, y: F.abs(x - y))), "cross_product": cross_product,
    "normalize": lambda a: F.when(norm(a) == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / norm(a))),
}
plain(**{f"array_{k}": f for k, f in _ALL.items()}, **{f"vector_{k}": f for k, f in _ALL.items()})
