"""Column functions on scores and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    """Logistic function of a score, clamped to 60 either way."""
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if the lengths differ."""
    zipped = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(zipped, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def confidence(text: Column) -> Column:
    """A model's confidence as a number in [0, 1]; what can't be read is 0."""
    return clamp(F.coalesce(text.try_cast("double"), F.lit(0.0)))


def or_zero(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def min_max(x: Column, low: Column, high: Column) -> Column:
    """A score scaled to [0, 1] between the lowest and highest of its group; equal scores all become 1."""
    return F.when(high == low, F.lit(1.0)).otherwise((x - low) / (high - low))
