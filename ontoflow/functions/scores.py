"""Column functions over scores between 0 and 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(score: Column) -> Column:
    """The score, not under 0 nor over 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def mean_of(scores: Sequence[Column]) -> Column:
    """The arithmetic mean, summed in the given order."""
    total = scores[0]
    for c in scores[1:]:
        total = total + c
    return total / F.lit(float(len(scores)))


def least_of(scores: Sequence[Column]) -> Column:
    return F.least(*scores) if len(scores) > 1 else scores[0]


def greatest_of(scores: Sequence[Column]) -> Column:
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def share_of(count: Column, k: int) -> Column:
    """How far a count reaches k, at most 1; all of it where k is 0."""
    return F.least(F.lit(1.0), count.cast("double") / F.lit(float(k))) if k > 0 else F.lit(1.0)


def in_interval(value: Column, low: float | None, high: float | None, low_open: bool = False, high_open: bool = False) -> Column:
    """Whether a number is known and within the bounds; NaN, which Spark takes for the largest, is within none."""
    ok = value.isNotNull() & ~F.isnan(value)
    if low is not None:
        ok &= value > low if low_open else value >= low
    if high is not None:
        ok &= value < high if high_open else value <= high
    return ok
