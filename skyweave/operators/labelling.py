"""Resumable labelling of prompts by a client that may fail."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.alerts import check_answer
from ..sources.shared import saved

OUTPUT = "sample_id string, uav_id string, answer string, error string, tries int"


def label_missing(prompts: DataFrame, done: DataFrame, client: Callable[[str], str], tries: int = 4, pause: float = 0.0, longest: float = 60.0) -> DataFrame:
    """Answers for the prompts (sample_id, uav_id, prompt) that ``done`` has no
    valid answer for: sample_id, uav_id, ok, check, answer, error, tries.

    A call that raises is tried again, up to ``tries`` times, after ``pause``
    seconds that double each time up to ``longest``; then the error is kept.
    Appending the result to ``done`` makes the next run go on.
    """
    todo = prompts.join(done.where("ok = 1").select("sample_id").distinct(), "sample_id", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for sample_id, uav_id, text in zip(batch["sample_id"], batch["uav_id"], batch["prompt"], strict=True):
                answer, error, n = None, None, 0
                while n < tries and answer is None:
                    n += 1
                    try:
                        answer, error = client(text), None
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        if n < tries and pause:
                            time.sleep(min(longest, pause * 2 ** (n - 1)))
                out.append((sample_id, uav_id, answer, error, n))
            yield pd.DataFrame(out, columns=["sample_id", "uav_id", "answer", "error", "tries"])

    found = todo.select("sample_id", "uav_id", "prompt").mapInPandas(ask, OUTPUT)
    check = check_answer(F.col("uav_id"), F.col("answer"))
    return found.withColumn("check", F.when(F.col("error").isNull(), check).otherwise("failed")).withColumn("ok", (F.col("check") == "ok").cast("int"))


def label_in_slices(prompts: DataFrame, path: str, client: Callable[[str], str], slices: int = 16, **options) -> DataFrame:
    """Labels the prompts slice by slice, a hash of sample_id deals them, and
    gives the answers of all.  A slice is stored before the next begins and
    replaced as a whole when it is run again, so a run that was broken off
    goes on with what lacks a valid answer and never stores a row twice."""
    spark, kind = prompts.sparkSession, "sample_id string, uav_id string, answer string, error string, tries int, check string, ok int"
    folders = [f"{path.rstrip('/')}/slice-{k:05}" for k in range(slices)]
    for k, folder in enumerate(folders):
        own = prompts.where(F.pmod(F.xxhash64("sample_id"), F.lit(slices)) == k)
        done = _read(spark, folder, kind)
        fresh = saved(label_missing(own, done, client, **options), "labels")
        if fresh.isEmpty():
            continue
        kept = saved(done.join(fresh.select("sample_id"), "sample_id", "left_anti").unionByName(fresh).select(done.columns), "labels")
        kept.write.mode("overwrite").parquet(folder)
    return reduce(DataFrame.unionByName, [_read(spark, folder, kind) for folder in folders])


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
