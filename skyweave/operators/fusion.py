"""Observation-weighted fusion, node features and step-wise track building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalar import clip, finite, number, spl_norm
from . import asof, running

# How far each sensor is trusted.
PRIORS = {"gps": 1.0, "radar": 0.7, "fiveg": 0.6, "tdoa": 0.45, "acoustic": 0.2}
MODALITIES = ("gps", "radar", "fiveg", "tdoa", "acoustic")


def prior(modality: Column) -> Column:
    out = F.lit(0.5)
    for name, weight in PRIORS.items():
        out = F.when(modality == name, weight).otherwise(out)
    return out


def weighted_fallback(observations: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """Per object and truth time: the confidence-weighted mean position of
    the observations nearest to it, and how many there were.

    Positions are averaged in the plane about the object's first truth row.
    Observations without a position don't count.
    """
    seen = observations.where("lat IS NOT NULL AND lon IS NOT NULL AND alt IS NOT NULL")
    first = truth.groupBy("uav_id").agg(F.min_by(F.struct("lat", "lon", "alt"), "us").alias("o"))
    near = asof.nearest(seen, truth, "uav_id", "us", [], tolerance).join(first, "uav_id")
    e, n, u = geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), F.col("o.lat"), F.col("o.lon"), F.col("o.alt"))
    w = (0.3 + 0.7 * F.col("confidence")) * prior(F.col("modality"))
    rows = near.select("uav_id", "t_us", "o", w.alias("w"), e.alias("e"), n.alias("n"), u.alias("u"))
    mean = lambda c: F.sum(F.col("w") * F.col(c)) / F.sum("w")
    sums = rows.groupBy("uav_id", "t_us").agg(F.count(F.lit(1)).alias("n_obs"), F.first("o").alias("o"), mean("e").alias("e"), mean("n").alias("n"), mean("u").alias("u"))
    lat, lon, alt = geo.llh(F.col("e"), F.col("n"), F.col("u"), F.col("o.lat"), F.col("o.lon"), F.col("o.alt"))
    return sums.select("uav_id", "t_us", "n_obs", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"))


def node_feature(lat0: Column, lon0: Column, alt0: Column) -> Column:
    """A node's features: plane position (zeros if it has none), confidence,
    whether it has a position, and its sensor one-hot."""
    valid = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("alt").isNotNull()
    place = [F.when(valid, F.round(x, 4) + 0.0).otherwise(0.0) for x in geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), lat0, lon0, alt0)]
    hot = [(F.col("modality") == m).cast("double") for m in MODALITIES]
    return F.array(*place, F.round(clip(F.col("confidence")), 9) + 0.0, valid.cast("double"), *hot)


def full_feature(lat0: Column, lon0: Column, alt0: Column, t_norm: Column) -> Column:
    """A node's features as the model takes them: plane position, velocity and
    speed, confidence, time, whether it has a position, whether it isn't
    flagged as missing, detection, loudness and energy (acoustic ones only,
    else 0), and the sensor one-hot."""
    at = lambda c: F.coalesce(number(F.col(c)), F.lit(0.0))
    valid = finite(F.col("lat")) & finite(F.col("lon")) & finite(F.col("alt"))
    place = [F.when(valid, x).otherwise(0.0) for x in geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), lat0, lon0, alt0)]
    heard = lambda x: F.when(F.col("modality") == "acoustic", F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    return F.array(
        *place, *map(at, ("vx", "vy", "vz", "speed")), clip(at("confidence")), t_norm, valid.cast("double"), (at("missing_flag") < 1).cast("double"),
        heard(clip(at("detected_flag"))), heard(spl_norm(number(F.col("spl_db")))), heard(clip(at("acoustic_energy"))), *((F.col("modality") == m).cast("double") for m in MODALITIES),
    )


def legacy_feature(lat0: Column, lon0: Column, alt0: Column, t_norm: Column, size: int) -> Column:
    """The former features: plane position, the truth's velocity and speed
    (t_vx, t_vy, t_vz, t_speed), confidence, time and the sensor one-hot, cut
    to ``size``."""
    values = [*geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), lat0, lon0, alt0), *map(F.col, ("t_vx", "t_vy", "t_vz", "t_speed", "confidence")), t_norm]
    return F.slice(F.array(*values, *((F.col("modality") == m).cast("double") for m in MODALITIES)), 1, size)


def priority_steps(rows: DataFrame, usable: Column, order: tuple[str, ...]) -> DataFrame:
    """A row for each object and hour: the altitude of its best usable
    sensor (the first of ``order``, its latest row), else the last one known."""
    rank = F.lit(len(order))
    for n, name in enumerate(order):
        rank = F.when(F.col("modality") == name, n).otherwise(rank)
    good = F.col("modality").isin(*order) & usable
    best = F.min_by(F.when(good, F.col("alt")), F.when(good, F.struct(rank, -F.col("us"), -F.col("event_id"))))
    steps = rows.groupBy("uav_id", "hour").agg(best.alias("own"))
    known = running.with_last(steps, "uav_id", ["hour"], "own", "alt", 24 * 64)
    return known.select("uav_id", "hour", "alt", F.col("own").isNotNull().alias("seen"))


def truth_rows(rows: DataFrame, step: str, flagged: Column, order: tuple[str, ...], latest: list[str], moving: list[str]) -> DataFrame:
    """A row for each object and ``step`` with a position, as truth to align
    sensors with.

    The step's own row is, of those with a position, the first by ``order``
    that isn't flagged, else the first of all; of one sensor the latest.  A
    step without such a row has the position of the last one that had, and 0
    for the ``moving`` columns; steps before any position are left out.
    ``choice`` tells which it was: valid, flagged or none.
    """
    rank = F.lit(len(order))
    for n, name in enumerate(order):
        rank = F.when(F.col("modality") == name, n).otherwise(rank)
    placed = F.col("modality").isin(*order) & F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("alt").isNotNull()
    by = F.struct(flagged.alias("flagged"), rank, *(-F.col(c) for c in latest))
    own = F.min_by(F.struct("lat", "lon", "alt", *moving, flagged.alias("flagged")), F.when(placed, by))
    steps = rows.groupBy("uav_id", step).agg(F.when(F.max(placed), own).alias("own"))
    steps = steps.withColumn("at", F.when(F.col("own").isNotNull(), F.struct("own.lat", "own.lon", "own.alt")))
    known = running.with_last(steps, "uav_id", [step], "at", "known", 1024).where("known IS NOT NULL")
    choice = F.when(F.col("own").isNull(), "none").when(F.col("own.flagged"), "flagged").otherwise("valid")
    return known.select("uav_id", step, choice.alias("choice"), "known.lat", "known.lon", "known.alt", *(F.coalesce(F.col(f"own.{c}"), F.lit(0.0)).alias(c) for c in moving))
