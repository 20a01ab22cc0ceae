"""Running values of keys of any size, in two levels.

Rows are dealt by key and by bucket of their first order column, which is a
number, so that a key with a third of all rows is many tasks' work.  Each
bucket runs by itself; what its earlier ones come to is one row for each
bucket, run per key and joined back.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_HOW = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True), "first": lambda c: F.first(c, ignorenulls=True)}
_START, _END = Window.unboundedPreceding, Window.unboundedFollowing


def in_buckets(rows: DataFrame, by: str, width: float) -> DataFrame:
    """The rows with ``_bucket``."""
    return rows.withColumn("_bucket", F.floor(F.col(by) / width))


def within(key: str, *order: str | Column):
    """A bucket's rows in order."""
    return Window.partitionBy(key, "_bucket").orderBy(*order)


def with_others(rows: DataFrame, key: str, parts: dict[str, tuple[Column, str]], later: tuple[str, ...] = ()) -> DataFrame:
    """The rows with what the other buckets of their key come to: for each
    name an aggregate of a bucket and how those of the earlier buckets (the
    later ones for names in ``later``) are put together."""
    totals = rows.groupBy(key, "_bucket").agg(*(c.alias(n) for n, (c, _) in parts.items()))
    buckets = Window.partitionBy(key).orderBy("_bucket")
    frame = lambda n: buckets.rowsBetween(1, _END) if n in later else buckets.rowsBetween(_START, -1)
    others = totals.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), *(_HOW[how](n).over(frame(n)).alias(n) for n, (_, how) in parts.items()))
    return rows.join(others, rows[key].eqNullSafe(others["_k"]) & rows["_bucket"].eqNullSafe(others["_b"]), "left").drop("_k", "_b")


def with_sum(rows: DataFrame, key: str, order: list[str], value: Column, name: str, width: float, own: bool = True) -> DataFrame:
    """The rows with the sum of a value up to each, or to the one before it."""
    rows = in_buckets(rows.withColumn("_v", value), order[0], width)
    here = F.sum("_v").over(within(key, *order).rowsBetween(_START, 0 if own else -1))
    out = with_others(rows, key, {"_before": (F.sum("_v"), "sum")}).withColumn(name, F.coalesce(here, F.lit(0)) + F.coalesce("_before", F.lit(0)))
    return out.drop("_v", "_bucket", "_before")


def with_maximum(rows: DataFrame, key: str, order: list[str], value: str, name: str, width: float, own: bool = True) -> DataFrame:
    """The rows with the largest value up to each, or to the one before it."""
    rows = in_buckets(rows, order[0], width)
    here = F.max(value).over(within(key, *order).rowsBetween(_START, 0 if own else -1))
    out = with_others(rows, key, {"_before": (F.max(value), "max")}).withColumn(name, F.greatest(here, F.col("_before")))
    return out.drop("_bucket", "_before")


def with_last(rows: DataFrame, key: str, order: list[str], value: str, name: str, width: float) -> DataFrame:
    """The rows with the last value up to each that isn't null."""
    rows = in_buckets(rows, order[0], width)
    here = F.last(value, ignorenulls=True).over(within(key, *order).rowsBetween(_START, 0))
    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    out = with_others(rows, key, {"_before": (last, "last")}).withColumn(name, F.coalesce(here, F.col("_before")))
    return out.drop("_bucket", "_before")


def with_number(rows: DataFrame, key: str, order: list[str], name: str, width: float) -> DataFrame:
    """The rows with their number among those of their key, from 0."""
    return with_sum(rows, key, order, F.lit(1).cast("long"), name, width, own=False)


def with_smoothed(rows: DataFrame, key: str, order: list[str], value: str, name: str, width: float, start: float = 0.5, beta: float = 0.8) -> DataFrame:
    """The rows with t after each, where t <- beta t + (1 - beta) value from
    ``start``; a null value leaves t as it is.

    The sums within a run of at most ``longest`` values are scaled by powers
    of beta that a double holds; over the runs before, t is carried as far
    back as it weighs anything in a double's precision.
    """
    if not 0 <= beta < 1:
        raise ValueError("beta is 0 or more and below 1")
    if beta == 0:
        return with_last(rows, key, order, value, name, width).withColumn(name, F.coalesce(name, F.lit(start)))
    longest = max(1, min(4096, int(250 / -math.log10(beta))))
    matter = math.ceil(60 * math.log(2) / -math.log(beta)) + 1
    counted = F.col(value).isNotNull().cast("long")
    dealt = in_buckets(rows, order[0], width).withColumn("_n", F.sum(counted).over(within(key, *order).rowsBetween(_START, 0)))
    # a null stands with the value before it
    dealt = dealt.withColumn("_run", F.floor(F.greatest(F.lit(0), F.col("_n") - 1) / longest))
    dealt = dealt.withColumn("_at", F.col("_n") - F.col("_run") * longest)
    run = Window.partitionBy(key, "_bucket", "_run").orderBy(*order).rowsBetween(_START, 0)
    power = lambda n: F.pow(F.lit(beta), n)
    scaled = F.when(F.col(value).isNotNull(), F.col(value) * power(-F.col("_at")))
    dealt = dealt.withColumn("_sum", F.coalesce(F.sum(scaled).over(run), F.lit(0.0)))
    dealt = dealt.withColumn("_here", (1.0 - beta) * power(F.col("_at")) * F.col("_sum"))
    runs = dealt.groupBy(key, "_bucket", "_run").agg(F.max("_at").alias("n"), F.max_by("_here", F.struct("_at", *order)).alias("sum"))
    # runs that hold values are numbered; those of nulls alone stand between them and carry nothing
    holds = (F.col("n") > 0).cast("long")
    runs = runs.withColumn("_c", F.sum(holds).over(Window.partitionBy(key).orderBy("_bucket", "_run").rowsBetween(_START, 0)) - holds)
    before = Window.partitionBy(key).orderBy("_c").rangeBetween(-matter, -1)
    first = F.when(F.col("_c") <= matter, F.lit(start)).otherwise(F.lit(0.0))
    carried = F.aggregate(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "sum"))).over(before), first, lambda t, r: power(r["n"]) * t + r["sum"])
    runs = runs.select(F.col(key).alias("_k"), F.col("_bucket").alias("_b"), F.col("_run").alias("_r"), carried.alias("_carried"))
    same = dealt[key].eqNullSafe(runs["_k"]) & dealt["_bucket"].eqNullSafe(runs["_b"]) & (dealt["_run"] == runs["_r"])
    out = dealt.join(runs, same).withColumn(name, power(F.col("_at")) * F.col("_carried") + F.col("_here"))
    return out.select(*rows.columns, name)


def with_rolling_quantile(rows: DataFrame, key: str, order: list[str], value: str, share: float, size: int, name: str, width: float, block: int = 4096) -> DataFrame:
    """``key``, ``order`` and the quantile of the last ``size`` values of the
    key, this one included; nulls don't count.  Rows are numbered and dealt to
    blocks that also get the ``size`` - 1 rows before them, and a block keeps
    its window sorted from row to row."""
    numbered = with_number(rows.select(key, *order, value), key, order, "_i", width)
    own = F.floor(F.col("_i") / block)
    blocks = F.sequence(own, F.floor((F.col("_i") + size - 1) / block))
    dealt = numbered.withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == own)
    fields = [numbered.schema[c] for c in (key, *order)]

    def roll(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        rows[name] = rows[value].astype("float64").rolling(size, min_periods=1).quantile(share, interpolation="linear")
        return rows.loc[rows["_own"], [key, *order, name]]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` double"])
    return dealt.groupBy(key, "_block").applyInPandas(roll, schema)


def softmax_share(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The rows with their share of exp(value) in their key.  The sums are one
    row for each key, made task by task first, from values brought near zero
    by the key's largest."""
    top = rows.groupBy(key).agg(F.max(value).alias("_top"))
    top = top.select(F.col(key).alias("_k"), "_top")
    near = rows.join(top, rows[key].eqNullSafe(top["_k"])).drop("_k").withColumn("_e", F.exp(F.col(value) - F.col("_top")))
    sums = near.groupBy(key).agg(F.sum("_e").alias("_sum")).select(F.col(key).alias("_k"), "_sum")
    out = near.join(sums, near[key].eqNullSafe(sums["_k"])).withColumn(name, F.col("_e") / (F.col("_sum") + 1e-12))
    return out.select(*rows.columns, name)
