"""Counts, means, squared deviations and extremes that merge exactly enough.

Deviations are sums of squares about a mean, put together by the difference of
means, so values far from zero don't cancel and a batch's rows are read once.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = ["n", "mean", "m2", "least", "most"]


def moments(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """``keys``, n, mean, m2 (summed squares of deviations), least and most of
    each group's values; null, NaN and infinite values don't count."""
    v = value.cast("double")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    own = rows.select(*keys, F.when(usable, v).alias("_v")).where("_v IS NOT NULL")
    n = F.count(F.lit(1))
    return own.groupBy(*keys).agg(n.alias("n"), F.avg("_v").alias("mean"), (F.var_pop("_v") * n).alias("m2"), F.min("_v").alias("least"), F.max("_v").alias("most"))


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """The groups' states put together: as those of all their rows."""
    n = F.sum("n")
    # means are averaged by their distance from one of them, which is small
    near = _beside(states, states.groupBy(*keys).agg(F.first("mean").alias("_base")), keys)
    off = F.sum(F.col("n") * (F.col("mean") - F.col("_base"))) / n
    about = _beside(states, near.groupBy(*keys).agg((F.first("_base") + off).alias("_mean")), keys)
    gap = F.col("mean") - F.col("_mean")
    return about.groupBy(*keys).agg(n.alias("n"), F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * gap * gap).alias("m2"), F.min("least").alias("least"), F.max("most").alias("most"))


def _beside(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with their group's columns; null keys are groups too."""
    groups = groups.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(groups, same).drop(*(f"_key_{k}" for k in keys))


def deviation(m2: Column, n: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), m2 / n))


def weighted(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """``keys``, n (the weights' sum), mean and m2: about the mean of a first
    pass, so nothing cancels.  Null values and weights of 0 don't count."""
    own = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    near = _beside(own, own.groupBy(*keys).agg(F.avg(value).alias("_base")), keys)
    w, d = F.col(weight), F.col(value) - F.col("_base")
    sums = near.groupBy(*keys).agg(F.sum(w).alias("n"), F.first("_base").alias("_base"), F.sum(w * d).alias("_s"), F.sum(w * d * d).alias("_q"))
    off = F.col("_s") / F.col("n")
    return sums.select(*keys, "n", (F.col("_base") + off).alias("mean"), (F.col("_q") - F.col("n") * off * off).alias("m2"))


class MomentStore:
    """States by batch in a folder, so that totals read no batch's rows again.

    A batch counts once it is whole; one that is there is left alone, and of
    attempts at a batch the first by name counts.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self._spark, self._path, self._keys = spark, path.rstrip("/"), keys
        self._type = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._type(self._path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> dict[str, str]:
        """The folder of each whole batch."""
        root = self._type(self._path)
        names = sorted((s.getPath().getName() for s in self._fs.listStatus(root)), reverse=True) if self._fs.exists(root) else []
        whole = ((m[1], n) for n in names if (m := re.fullmatch(r"batch-([\w.]+)--\w+", n)) and self._fs.exists(self._type(f"{self._path}/{n}/_SUCCESS")))
        return dict(whole)

    def add(self, batch: str, rows: DataFrame, value: Column) -> bool:
        """Stores a batch's states; False if it is there already."""
        if not re.fullmatch(r"[\w.]+", batch):
            raise ValueError("a batch's name is of letters, digits, _ and .")
        if batch in self.batches():
            return False
        moments(rows, self._keys, value).write.parquet(f"{self._path}/batch-{batch}--{uuid.uuid4().hex}")
        return True

    def totals(self) -> DataFrame:
        """The states of all batches' rows; there must be a batch."""
        return merged(self._spark.read.parquet(*(f"{self._path}/{n}" for n in self.batches().values())), self._keys)
