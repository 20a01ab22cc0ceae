"""Nearest as-of joins.

Both sides are dealt by key and time bucket, so that a key that holds a third
of all rows is split along time, and each bucket is one sort and two running
windows; there is no join of pairs.  With a tolerance, truth rows are also
dealt to the next bucket where they are within the tolerance of it.  Without
one, the nearest truth of the buckets before and after is carried over, as
one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import running

#: A day in microseconds, for joins that have no tolerance to go by.
WIDTH = 86_400_000_000


def _around(left: DataFrame, right: DataFrame, key: str, time: str, width: float | None) -> DataFrame:
    """The rows of ``left`` with ``_low`` and ``_high``, the last ``_truth`` at
    or before each and the first at or after it.  ``width`` None: the rows
    have a ``_bucket`` that holds all they need."""
    rows = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    rows = rows if width is None else running.in_buckets(rows, time, width)
    # ties of one truth time are put in the order of their columns
    order = running.within(key, time, "_side", "_truth")
    low = F.last("_truth", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first("_truth", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumns({"_low": low, "_high": high})
    if width is not None:
        parts = {"_before": (F.max("_truth"), "last"), "_after": (F.min("_truth"), "first")}
        rows = running.with_others(rows, key, parts, later=("_after",))
        rows = rows.withColumns({"_low": F.coalesce("_low", "_before"), "_high": F.coalesce("_high", "_after")})
    return rows.where("_side = 1")


def nearest(observations: DataFrame, truth: DataFrame, key: str, time: str, columns: list[str], tolerance: int | None, prefix: str = "t_", width: float = WIDTH) -> DataFrame:
    """Each observation with ``columns`` of the nearest truth row of its key,
    prefixed, and ``dt``, the distance in time.

    Of two equally near rows the earlier counts; of truth rows of one time,
    the last by ``columns`` for observations at or after it, else the first.
    Only rows within ``tolerance`` (inclusive) stay; None keeps all that
    have a truth row, from buckets of ``width``.  Rows without a time or key
    don't match.
    """
    seen = observations.where(F.col(time).isNotNull() & F.col(key).isNotNull())
    known = truth.where(F.col(time).isNotNull() & F.col(key).isNotNull())
    payload = F.struct(time, *columns)
    if tolerance is None:
        both = _around(seen, known.select(key, time, payload.alias("_truth")), key, time, width)
    else:
        wide = max(1, 8 * tolerance)
        buckets = F.sequence(F.floor((F.col(time) - tolerance) / wide), F.floor((F.col(time) + tolerance) / wide))
        right = known.select(key, time, payload.alias("_truth"), F.explode(buckets).alias("_bucket"))
        both = _around(running.in_buckets(seen, time, wide), right, key, time, None)
    t, lo, hi = F.col(time), F.col("_low").getField(time), F.col("_high").getField(time)
    best = F.when(F.col("_low").isNull() | (hi - t < t - lo), F.col("_high")).otherwise(F.col("_low"))
    out = both.withColumn("_best", best).where(F.col("_best").isNotNull())
    out = out.select(*observations.columns, F.abs(t - F.col("_best").getField(time)).alias("dt"), *(F.col("_best").getField(c).alias(f"{prefix}{c}") for c in [time, *columns]))
    return out if tolerance is None else out.where(F.col("dt") <= tolerance)


def interpolated(times: DataFrame, truth: DataFrame, key: str, time: str, columns: list[str], width: float = WIDTH) -> DataFrame:
    """``columns`` of the truth at each time, linearly between its
    neighbours and constant beyond its ends."""
    right = truth.select(key, time, F.struct(time, *columns).alias("_truth"))
    both = _around(times, right, key, time, width)
    both = both.withColumns({"_a": F.coalesce("_low", "_high"), "_b": F.coalesce("_high", "_low")}).where(F.col("_a").isNotNull())
    t0, t1 = F.col("_a").getField(time), F.col("_b").getField(time)
    share = F.when(t1 == t0, 0.0).otherwise((F.col(time) - t0) / (t1 - t0))
    at: list[Column] = [(F.col("_a").getField(c) + share * (F.col("_b").getField(c) - F.col("_a").getField(c))).alias(c) for c in columns]
    return both.select(*times.columns, *at)


def last_wins(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key, as the columns of a max_by on all of them."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col("_row").getField(c).alias(c) for c in rest))
