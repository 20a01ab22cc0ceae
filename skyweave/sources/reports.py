"""What an evaluation and a fused track are handed on as."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What names of metrics hold that a summary takes.
METRIC_PARTS = ("rmse", "mae", "medae", "p90", "p95", "max", "ade", "fde", "dtw", "frechet", "hausdorff", "rpe", "outlier", "jerk", "cross", "along")


def metric_summary(rows: DataFrame) -> DataFrame:
    """metric, mean, median, std of every column that is a metric by its name,
    over the rows where it isn't null; a metric without any has no row."""
    chosen = [c for c in rows.columns if any(part in c for part in METRIC_PARTS)]
    long = rows.select(*(F.col(c).cast("double").alias(c) for c in chosen)).unpivot([], chosen, "metric", "x").where("x IS NOT NULL")
    return long.groupBy("metric").agg(*(f("x").alias(n) for n, f in (("mean", F.avg), ("median", F.median), ("std", F.stddev_samp))))


def write_evaluation(rows: DataFrame, path: str, key: str = "uav_id", by: str = "rmse", worst: int = 20) -> None:
    """Three CSV tables below a folder, in place of what was there: ``rows``,
    their ``summary`` and the ``worst`` rows, greatest ``by`` first (nulls
    last, ties by ``key``), which is a report of that many rows."""
    first = rows.orderBy(F.desc_nulls_last(by), key).limit(worst)
    for name, part in (("rows", rows), ("summary", metric_summary(rows)), ("worst", first.coalesce(1))):
        part.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}")


def results(rows: DataFrame, plane: bool = False) -> DataFrame:
    """A fused track as it is answered: timestamp with lat, lon, alt, or with
    east, north, up where ``plane``; what isn't a number is null."""
    names = ("timestamp", "east", "north", "up") if plane else ("timestamp", "lat", "lon", "alt")
    return rows.select(*(F.col(n).try_cast("double").alias(n) for n in names))


def write_results(rows: DataFrame, path: str, plane: bool = False) -> None:
    """The answer as lines of JSON, nulls included, by time within and over
    all files by name."""
    ordered = results(rows, plane).repartitionByRange("timestamp").sortWithinPartitions("timestamp")
    ordered.write.mode("overwrite").option("ignoreNullFields", False).json(path)
