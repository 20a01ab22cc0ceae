"""Structured Streaming over files: windowed counts and as-of alignment.

Streams are read with fixed schemas, run over what is available and end;
results and checkpoints lie in the shared folder, so a run that is broken off
goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import asof
from ..sources.shared import saved, scratch_path


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; the pattern also fits a single file."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep state in RocksDB, which lists, maps and
    timers need; its snapshots go to the checkpoint."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


def run(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Runs a stream over all available input into a table of files, a new one
    or, where it was broken off, that of ``path``."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def window_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Rows and mean value per window and key.  A window is emitted once,
    when the watermark, ``late`` behind the latest time, has passed its end."""
    groups = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return groups.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), *keys, "n", "mean_value")


def distinct_events(events: DataFrame, time: str, late: str, *keys: str) -> DataFrame:
    """The first of rows with equal keys that arrive within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def aligned(observations: DataFrame, truth: DataFrame, key: str, time: str, columns: list[str], tolerance: int, name: str) -> DataFrame:
    """Streamed observations with the nearest row of a static truth table,
    batch by batch.  A batch has a folder of its own that is written whole,
    so one that is replayed replaces itself."""
    spark = observations.sparkSession
    path = scratch_path(spark, name)
    truth = saved(truth.select(key, time, *columns), f"{name}-truth")  # made once, read by each batch
    schema = asof.nearest(spark.createDataFrame([], StructType(observations.schema.fields)), truth, key, time, columns, tolerance).schema

    def write(batch: DataFrame, number: int) -> None:
        asof.nearest(batch, truth, key, time, columns, tolerance).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = observations.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


def thresholds(observations: DataFrame, key: str, order: list[str], value: str, start: float = 0.5, beta: float = 0.8, abnormal: float = 0.9) -> DataFrame:
    """Each streamed row with its key's smoothed threshold ``tau`` and the
    ``votes`` of abnormal values so far, kept as state between batches.

    Rows of one batch are taken in order; a batch goes on where the last one
    of its key ended, so the state is two numbers for each key.
    """
    fields = [f for f in observations.schema.fields if f.name in (key, *order, value)]
    schema = StructType([*fields]).add("tau", "double").add("votes", "long")

    def step(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tau, votes = state.get if state.exists else (start, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        taus, counts = [], []
        for x in rows[value]:
            tau, votes = beta * tau + (1 - beta) * x, votes + int(x > abnormal)
            taus.append(tau)
            counts.append(votes)
        state.update((tau, votes))
        yield rows[[f.name for f in fields]].assign(tau=taus, votes=counts)

    wanted = observations.select(*(f.name for f in fields)).where(F.col(value).isNotNull())
    return wanted.groupBy(key).applyInPandasWithState(step, schema, "tau double, votes long", "append", GroupStateTimeout.NoTimeout)
