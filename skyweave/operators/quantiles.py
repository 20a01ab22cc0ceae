"""Exact quantiles of groups of any size, by rank.

Equal values of a group are counted first; what is left is dealt by ranges of
(group, value), so a group with a third of all rows is many tasks.  The ranges'
counts tell which of them holds a wanted rank, and only there values are
numbered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``keys`` and for each name in ``shares`` the quantile of that share,
    interpolated between its neighbours.  Null and NaN values don't count; a
    group without others has no row.  Null keys are a group of their own."""
    key = F.struct(*keys)
    values = rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key.alias("_k"), F.col(value).cast("double").alias("_v"))
    counts = values.groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    dealt = saved(counts.repartitionByRange("_k", "_v").withColumn("_p", F.spark_partition_id()), "quantile-values")
    parts = dealt.groupBy("_k", "_p").agg(F.sum("_c").alias("_c"))
    own = Window.partitionBy("_k")
    upto = F.sum("_c").over(own.orderBy("_p"))
    parts = parts.select("_k", "_p", (upto - F.col("_c")).alias("_from"), upto.alias("_to"), F.sum("_c").over(own).alias("_n"))
    # both neighbours of every wanted rank, in the ranges that hold them
    at = [(F.col("_n") - 1) * F.lit(float(share)) for share in shares.values()]
    sides = [F.struct(F.lit(k).alias("k"), x.alias("at"), side.cast("long").alias("rank")) for k, x in enumerate(at) for side in (F.floor(x), F.ceil(x))]
    wanted = parts.select("_k", "_p", "_from", "_to", F.explode(F.array(*sides)).alias("w")).where((F.col("w.rank") >= F.col("_from")) & (F.col("w.rank") < F.col("_to")))
    wanted = saved(wanted.select("_k", "_p", "_from", "w.k", "w.at", "w.rank"), "quantile-ranks")
    inside = dealt.join(wanted.select("_k", "_p", "_from").distinct(), ["_k", "_p"])
    last = F.sum("_c").over(Window.partitionBy("_k", "_p").orderBy("_v")) + F.col("_from")
    numbered = inside.select("_k", "_p", "_v", (last - F.col("_c")).alias("_first"), last.alias("_last"))
    found = numbered.join(wanted.drop("_from"), ["_k", "_p"]).where((F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_last")))
    ends = found.groupBy("_k", "k").agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.first("at").alias("at"))
    ends = ends.withColumn("q", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * (F.col("at") - F.floor("at"))))
    out = ends.groupBy("_k").agg(*(F.max(F.when(F.col("k") == k, F.col("q"))).alias(name) for k, name in enumerate(shares)))
    return out.select("_k.*", *shares)
