"""Sliding windows, overlap merge and blends over tracks.

A row is dealt to all windows that hold it by arithmetic on its index, so
windows need neither a join nor a collected track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import edge_taper, window_quality


def with_length(df: DataFrame, key: str) -> DataFrame:
    """The rows with ``length``, the rows of their key."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("length"))
    return df.join(sizes, key)


def dealt(df: DataFrame, index: str, length: Column, size: int, stride: int) -> DataFrame:
    """Each row once for each window that holds it, with ``start`` and
    ``pos``.  Windows begin at 0, stride, ... and are whole: a last part that
    is shorter than ``size`` has none."""
    low = F.ceil(F.greatest(F.lit(0), F.col(index) - (size - 1)) / stride) * stride
    high = F.floor(F.least(F.col(index), length - size) / stride) * stride
    starts = F.when((length >= size) & (low <= high), F.sequence(low, high, F.lit(stride).cast("long")))
    return df.withColumn("start", F.explode(starts)).withColumn("pos", F.col(index) - F.col("start"))


def number_of(length: Column, size: int, stride: int) -> Column:
    """How many whole windows a track of that length has."""
    return F.greatest(F.lit(0).cast("long"), F.floor((length - size) / stride) + 1)


def covering(index: Column, length: Column, size: int, stride: int) -> Column:
    """How many windows hold a row, by arithmetic alone."""
    low = F.ceil(F.greatest(F.lit(0), index - (size - 1)) / stride)
    high = F.floor(F.least(index, length - size) / stride)
    return F.when(length >= size, F.greatest(F.lit(0).cast("long"), high - low + 1)).otherwise(F.lit(0).cast("long"))


def window_stats(windows: DataFrame, key: str) -> DataFrame:
    """Per window: n, means of conf, pos_valid and obs_valid, and quality."""
    out = windows.groupBy(key, "start").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ("conf", "pos_valid", "obs_valid")))
    return out.withColumn("quality", window_quality(F.col("n"), F.col("conf"), F.col("pos_valid"), F.col("obs_valid")))


def merged(windows: DataFrame, key: str, index: str, values: list[str], size: int, least: float = 0.25, weight: Column | None = None) -> DataFrame:
    """Overlapping estimates as weighted means per time, tapered towards a
    window's ends, with ``cover``, the windows that hold the time."""
    w = F.greatest(edge_taper(F.col("pos"), size, least) * (F.lit(1.0) if weight is None else weight), F.lit(1e-6))
    rows = windows.withColumn("_w", w)
    sums = rows.groupBy(key, index).agg(F.count(F.lit(1)).alias("cover"), F.sum("_w").alias("_w"), *(F.sum(F.col("_w") * F.col(v)).alias(v) for v in values))
    return sums.select(key, index, "cover", *((F.col(v) / (F.col("_w") + 1e-6)).alias(v) for v in values))


def blended(value: Column, fallback: Column, cover: Column, fallback_weight: Column, needed: int = 3) -> Column:
    """The value moved towards the fallback where few windows cover it."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), cover / needed))
    skip = (share >= 0.999) | F.coalesce(fallback_weight <= 1e-9, F.lit(True))
    return F.when(skip, value).otherwise(share * value + (1.0 - share) * fallback)
