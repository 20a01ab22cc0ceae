"""From observations to fused positions: alignment, windows, merge, blends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.scalar import window_quality
from . import asof, fusion, running, windows

AXES = ("e", "n", "u")


def observed(steps: DataFrame) -> DataFrame:
    """What stands for a model: each step's weighted mean of its observations,
    and for steps without any that of the window."""
    return steps.withColumns({f"p{a}": F.coalesce(F.col(a), F.col(f"w{a}")) for a in AXES})


def fuse(observations: DataFrame, truth: DataFrame, tolerance: int, size: int = 20, stride: int = 5, edge: int = 20, predict: Callable[[DataFrame], DataFrame] = observed) -> DataFrame:
    """uav_id, us, cover, lat, lon and alt at each truth time of each object.

    Observations (with ``confidence``) go to the truth time nearest to them
    and are averaged there by weight, in the plane about the object's first
    truth row.  Windows of ``size`` times get estimates from ``predict``,
    which adds pe, pn and pu to their steps (uav_id, start, pos, the step's
    means e, n, u and the window's we, wn, wu).  Windows without observations
    and objects with fewer times have no estimate.  Estimates are merged by
    the windows' quality; near both ends, where few windows cover a time, the
    result moves towards the observations.
    """
    seen = observations.where("lat IS NOT NULL AND lon IS NOT NULL AND alt IS NOT NULL")
    first = truth.groupBy("uav_id").agg(F.min_by(F.struct("lat", "lon", "alt"), "us").alias("o"))
    origin = [F.col(f"o.{c}") for c in ("lat", "lon", "alt")]
    near = asof.nearest(seen, truth, "uav_id", "us", [], tolerance).join(first, "uav_id")
    plane = geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), *origin)
    weight = (0.3 + 0.7 * F.col("confidence")) * fusion.prior(F.col("modality"))
    nodes = near.select("uav_id", F.col("t_us").alias("us"), "confidence", weight.alias("w"), *(x.alias(a) for x, a in zip(plane, AXES, strict=True)))
    sums = nodes.groupBy("uav_id", "us").agg(F.count(F.lit(1)).alias("k"), F.sum("confidence").alias("c"), F.sum("w").alias("w"), *(F.sum(F.col("w") * F.col(a)).alias(f"s{a}") for a in AXES))
    times = windows.with_length(running.with_number(truth.select("uav_id", "us").distinct(), "uav_id", ["us"], "t_idx", asof.WIDTH), "uav_id")
    steps = times.join(sums, ["uav_id", "us"], "left").withColumns({a: F.col(f"s{a}") / F.col("w") for a in AXES})
    dealt = windows.dealt(steps, "t_idx", F.col("length"), size, stride)
    whole = dealt.groupBy("uav_id", "start").agg(F.sum("k").alias("n"), (F.sum("c") / F.sum("k")).alias("conf"), *((F.sum(f"s{a}") / F.sum("w")).alias(f"w{a}") for a in AXES))
    one = F.lit(1.0)  # only observations with a position and within the tolerance are nodes
    whole = whole.where("n > 0").withColumn("quality", window_quality(F.col("n"), F.col("conf"), one, one)).drop("n", "conf")
    estimates = predict(dealt.join(whole, ["uav_id", "start"]))
    merged = windows.merged(estimates, "uav_id", "t_idx", [f"p{a}" for a in AXES], size, weight=F.col("quality"))
    out = steps.join(merged, ["uav_id", "t_idx"], "left").fillna(0, ["cover"]).fillna(0.0, [f"p{a}" for a in AXES])
    for at_end in (F.col("t_idx") < edge, F.col("t_idx") >= F.col("length") - edge):
        blend = lambda a: windows.blended(F.col(f"p{a}"), F.col(a), F.col("cover"), F.coalesce("w", F.lit(0.0)))
        out = out.withColumns({f"p{a}": F.when(at_end, blend(a)).otherwise(F.col(f"p{a}")) for a in AXES})
    lat, lon, alt = geo.llh(F.col("pe"), F.col("pn"), F.col("pu"), *origin)
    return out.join(first, "uav_id").select("uav_id", "us", "cover", lat.alias("lat"), lon.alias("lon"), alt.alias("alt"))
