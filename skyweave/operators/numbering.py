"""Dense numbers and batches without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved


def numbered(ids: DataFrame, column: str) -> DataFrame:
    """Distinct values with ``number``, 0, 1, ... in ascending order.  Spark
    deals them to ranges of about equal size, each is numbered by itself, and
    only the ranges' sizes, a row for each partition, are summed in order."""
    rows = ids.select(column).distinct().repartitionByRange(column).withColumn("_range", F.spark_partition_id())
    rows = saved(rows, "numbered")
    sizes = rows.groupBy("_range").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return rows.withColumn("_own", own).join(sizes.select("_range", before.alias("_before")), "_range").select(column, (F.col("_before") + F.col("_own")).alias("number"))


def batch_label(number: Column, size: int, prefix: str = "batch", digits: int = 2) -> Column:
    """Batches of ``size`` rows, from 1, padded to ``digits`` at least."""
    if size <= 0:
        raise ValueError("batches have one row at least")
    name = (F.floor(number / size) + 1).cast("string")
    return F.concat(F.lit(prefix), F.lpad(name, F.greatest(F.lit(digits), F.length(name)), F.lit("0")))
