"""Vector arithmetic as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """A zero vector has cosine 0 with everything."""
    return dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Shared part of two sets; ``both_empty`` if there is nothing on either side."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def score_of_distance(d: Column, kind: str = "cosine") -> Column:
    """Similarity of a distance that another store reports: 1 - d of cosine distances, 1 / (1 + d) of Euclidean ones, -d of inner products."""
    if kind == "cosine":
        return 1.0 - d
    if kind == "l2":
        return 1.0 / (1.0 + d)
    if kind == "ip":
        return -d
    raise ValueError(f"unknown distance {kind}")
