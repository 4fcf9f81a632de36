"""Vector expressions: norms, cosine, fallback vectors, dimension checks.

Arithmetic is in DOUBLE. A zero vector is similar to nothing (similarity 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_PLACES = 6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    length = norm(v)
    return F.transform(v, lambda x: F.when(length == 0, F.lit(0.0)).otherwise(x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def score(a: Column, b: Column) -> Column:
    """Cosine rounded to SCORE_PLACES: the value rankings use, so that ties are
    decided by id and not by the last bit of a sum."""
    return F.round(cosine(a, b), SCORE_PLACES) + F.lit(0.0)


def is_finite(v: Column) -> Column:
    """A vector with at least one element, all of them finite numbers; false for null."""
    numbers = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & numbers, F.lit(False))


def or_zero_vector(v: Column, dimension: int) -> Column:
    return F.coalesce(v, F.array_repeat(F.lit(0.0).cast("float"), dimension))
