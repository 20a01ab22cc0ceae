"""Accuracy metrics of tracks, and how far two paths are apart at most."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import norm
from ..sources.shared import saved
from .quantiles import quantiles


#: The quantiles among a track's error statistics.
QUANTILES = {"medae": 0.5, "p90": 0.9, "p95": 0.95}


def error_stats(rows: DataFrame, keys: list[str], d: str, *more: Column) -> DataFrame:
    """``keys``, rmse, mae, medae, p90, p95 and max_err of the distances ``d``
    of each group, and ``more`` aggregates.  Quantiles go by rank, so a group
    isn't held in one place; null distances don't count."""
    x = F.col(d)
    sums = rows.groupBy(*keys).agg(F.sqrt(F.avg(x * x)).alias("rmse"), F.avg(x).alias("mae"), F.max(x).alias("max_err"), *more)
    ranked = quantiles(rows, keys, d, QUANTILES).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    return sums.join(ranked, same, "left").drop(*(f"_{k}" for k in keys))


def distance3(df: DataFrame) -> Column:
    return norm(F.col("px") - F.col("gx"), F.col("py") - F.col("gy"), F.col("pz") - F.col("gz"))


def with_relative_error(track: DataFrame, horizon: int) -> DataFrame:
    """The rows with ``rpe``, the error of the move over ``horizon`` steps
    (null where the track ends before)."""
    w = Window.partitionBy("uav_id").orderBy("t_idx")
    ahead = lambda c: F.lead(c, horizon).over(w) - F.col(c)
    return track.withColumn("rpe", norm(*(ahead("p" + a) - ahead("g" + a) for a in "xyz")))


def along_cross(track: DataFrame) -> DataFrame:
    """The rows with ``along`` and ``across``, the plane error along the true
    track's tangent and along the normal to its left."""
    w = Window.partitionBy("uav_id").orderBy("t_idx")

    def slope(c: str) -> Column:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2.0)

    rows = track.withColumns({"_tx": slope("gx"), "_ty": slope("gy")})
    size = F.greatest(norm(F.col("_tx"), F.col("_ty")), F.lit(1e-6))
    rows = rows.withColumns({"_tx": F.col("_tx") / size, "_ty": F.col("_ty") / size})
    ex, ey = F.col("px") - F.col("gx"), F.col("py") - F.col("gy")
    return rows.withColumns({"along": ex * F.col("_tx") + ey * F.col("_ty"), "across": ey * F.col("_tx") - ex * F.col("_ty")}).drop("_tx", "_ty")


def with_jerk(track: DataFrame, columns: tuple[str, str, str], name: str) -> DataFrame:
    """The rows with the norm of the third difference from each on."""
    w = Window.partitionBy("uav_id").orderBy("t_idx")
    third = lambda c: F.lead(c, 3).over(w) - 3 * F.lead(c, 2).over(w) + 3 * F.lead(c, 1).over(w) - F.col(c)
    return track.withColumn(name, norm(*map(third, columns)))


def nearest_distances(points: DataFrame, others: DataFrame, keys: list[str], index: str) -> DataFrame:
    """``keys``, ``index`` and ``d``, the distance of each point (x, y) to the
    nearest other (u, v) of its keys.

    Both are dealt to grid cells, a point to its own and the eight around, so
    only neighbours meet.  Points whose nearest isn't certain yet, as it is
    farther than a cell is wide, go on with cells four times as wide.  Points
    without a coordinate, or whose keys have no others, have no row.
    """
    others = others.where("u IS NOT NULL AND v IS NOT NULL").select(*keys, "u", "v").distinct()
    span = F.greatest(F.max("u") - F.min("u"), F.max("v") - F.min("v"))
    width = 2.0 * span / F.sqrt(F.count(F.lit(1)))
    widths = saved(others.groupBy(*keys).agg(F.when(width > 0, width).otherwise(1.0).alias("w")), "grid-widths")
    others = saved(others.join(widths, keys), "grid-others")
    left = saved(points.where("x IS NOT NULL AND y IS NOT NULL").select(*keys, index, "x", "y").join(widths, keys), "grid-open")
    cell = lambda c, w: F.floor(F.col(c) / w)
    around = lambda c, w: F.explode(F.sequence(cell(c, w) - 1, cell(c, w) + 1))
    done, scale = [], 1.0
    while True:
        w = F.col("w") * scale
        a = left.withColumn("cx", around("x", w)).withColumn("cy", around("y", w))
        b = others.select(*keys, "u", "v", cell("u", w).alias("cx"), cell("v", w).alias("cy"))
        found = a.join(b, [*keys, "cx", "cy"]).groupBy(*keys, index).agg(F.min(norm(F.col("x") - F.col("u"), F.col("y") - F.col("v"))).alias("d"))
        step = saved(left.join(found, [*keys, index], "left").withColumn("sure", F.coalesce(F.col("d") <= w, F.lit(False))), "grid-step")
        done.append(step.where("sure").select(*keys, index, "d"))
        left = step.where("NOT sure").drop("d", "sure")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        scale *= 4.0


def hausdorff(track: DataFrame) -> DataFrame:
    """The symmetric Hausdorff distance of each track's plane points."""
    sides = (("g", "p"), ("p", "g"))
    points = reduce(DataFrame.unionByName, [track.select("uav_id", F.lit(k).alias("way"), "t_idx", F.col(f"{a}x").alias("x"), F.col(f"{a}y").alias("y")) for k, (a, _) in enumerate(sides)])
    others = reduce(DataFrame.unionByName, [track.select("uav_id", F.lit(k).alias("way"), F.col(f"{b}x").alias("u"), F.col(f"{b}y").alias("v")) for k, (_, b) in enumerate(sides)])
    return nearest_distances(points, others, ["uav_id", "way"], "t_idx").groupBy("uav_id").agg(F.max("d").alias("hausdorff"))
