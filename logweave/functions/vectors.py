"""Column functions on ``array<double>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logweave.functions.text import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    """Length of a vector; a zero vector counts as 1 so that dividing by it is safe."""
    return let(F.sqrt(dot(v, v)), lambda n: F.when(n == 0, F.lit(1.0)).otherwise(n))


def unit(v: Column) -> Column:
    return let(l2_norm(v), lambda n: F.transform(v, lambda x: x / n))


def cosine_distance(a: Column, b: Column) -> Column:
    """Distance of two unit vectors, kept in [0, 2]."""
    return F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))
