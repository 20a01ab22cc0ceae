"""Interval merging and stabbing, and the environment's penalty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import arc_distance
from ..functions.scalar import clip
from . import running

#: A day in microseconds.
WIDTH = 86_400_000_000

# Anchors (lat, lon) and ranges of the sensors, obstacle zones
# (lat, lon, radius, strength) and interference events (from, to, sensors, level).
ANCHORS = {"gps": (45.000, 5.000, 60000.0), "radar": (45.020, 5.010, 45000.0), "fiveg": (44.990, 5.030, 22000.0), "tdoa": (45.040, 4.980, 35000.0), "acoustic": (44.970, 5.000, 18000.0)}
ZONES = ((45.060, 5.060, 12000.0, 0.60), (44.930, 5.020, 9000.0, 0.45), (45.010, 4.940, 10000.0, 0.50))
EVENTS = ((20.0, 35.0, ("fiveg", "tdoa"), 0.60), (55.0, 68.0, ("gps", "radar"), 0.40), (85.0, 105.0, ("acoustic", "fiveg"), 0.70))


def merged(intervals: DataFrame, key: str, start: str = "start", end: str = "end", width: float = WIDTH) -> DataFrame:
    """Each key's intervals with overlapping and touching ones joined; starts
    are dealt to buckets of ``width``."""
    rows = running.with_maximum(intervals, key, [start, end], end, "_latest", width, own=False)
    fresh = F.coalesce(F.col(start) > F.col("_latest"), F.lit(True)).cast("long")
    island = running.with_sum(rows, key, [start, end], fresh, "_island", width)
    return island.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def stabbed(points: DataFrame, intervals: DataFrame, key: str, time: str, start: str = "start", end: str = "end", width: float = WIDTH) -> DataFrame:
    """The points inside any interval of their key, ends included.  No pairs
    are made: the latest end of what began by then decides."""
    rows = points.withColumn("_side", F.lit(1)).unionByName(intervals.select(key, F.col(start).alias(time), F.col(end).alias("_end")).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    rows = running.with_maximum(rows, key, [time, "_side"], "_end", "_last", width)
    return rows.where((F.col("_side") == 1) & (F.col("_last") >= F.col(time))).select(*points.columns)


def _greatest(parts: list[Column]) -> Column:
    return F.greatest(F.lit(0.0), *parts)


def reach(modality: Column, lat: Column, lon: Column) -> Column:
    """The distance to the sensor's anchor as a share of its range, to 1."""
    out = F.lit(None).cast("double")
    for name, (a_lat, a_lon, far) in ANCHORS.items():
        out = F.when(modality == name, clip(arc_distance(lat, lon, F.lit(a_lat), F.lit(a_lon)) / far)).otherwise(out)
    return out


def combined(reach: Column, zone: Column, event: Column) -> Column:
    """The penalty from its three parts."""
    return clip(0.55 * reach + 0.30 * zone + 0.30 * event)


def penalty(modality: Column, lat: Column, lon: Column, seconds: Column) -> Column:
    """0 to 1 from the distance to the sensor's anchor, the strongest zone
    around and the strongest interference at the time.  Zones and events are
    a few constants, so they are part of the expression; with_zone() and
    with_event() look them up in tables."""
    zone = _greatest([F.when(arc_distance(lat, lon, F.lit(z_lat), F.lit(z_lon)) <= radius, strength).otherwise(0.0) for z_lat, z_lon, radius, strength in ZONES])
    event = _greatest([F.when(modality.isin(*names) & seconds.between(first, last), level).otherwise(0.0) for first, last, names, level in EVENTS])
    return combined(reach(modality, lat, lon), zone, event)
