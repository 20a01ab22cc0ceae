"""Fixed-length vectors as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_length(x: Column, length: int, fill: float = 0.0) -> Column:
    """The first ``length`` values, filled up where there are fewer."""
    missing = F.greatest(F.lit(0), F.lit(length) - F.size(x))
    return F.concat(F.slice(x, 1, length), F.array_repeat(F.lit(fill), missing))


def scaled(x: Column, means: list[float], deviations: list[float]) -> Column:
    """(x - mean) / deviation of the leading values; the others stay."""
    mu, sigma = (F.array(*map(F.lit, v)) for v in (means, deviations))
    return F.transform(x, lambda v, i: F.when(i < len(means), (v - F.get(mu, i)) / F.get(sigma, i)).otherwise(v))


def unscaled(x: Column, means: list[float], deviations: list[float]) -> Column:
    """The inverse of scaled()."""
    mu, sigma = (F.array(*map(F.lit, v)) for v in (means, deviations))
    return F.transform(x, lambda v, i: F.when(i < len(means), v * F.get(sigma, i) + F.get(mu, i)).otherwise(v))
