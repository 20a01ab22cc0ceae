"""Paths that the driver and all executors can reach."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_below: ContextVar[str] = ContextVar("_below", default="")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``.

    Only where that is unset and Spark runs on one machine, as in tests, a
    temporary folder of this process is made; on a cluster executors couldn't
    see it, so that is an error.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="skyweave-"))
        folder = f"file://{_own[0]}"
    return folder.rstrip("/")


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in this application's part of the shared folder that nothing
    else uses."""
    return f"{_run_dir(spark)}/{_below.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def passing(spark: SparkSession, name: str) -> Iterator[None]:
    """What is saved in here is removed at its end, as a batch of a stream needs."""
    path = scratch_path(spark, name)
    token = _below.set(path.removeprefix(f"{_run_dir(spark)}/") + "/")
    try:
        yield
    finally:
        _below.reset(token)
        drop(spark, path)


def drop(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Removes what this application has put there.  Results are read from
    it, so only call this when they have been written or shown."""
    drop(spark, _run_dir(spark))


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read back: what cuts the lineage of a loop."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
