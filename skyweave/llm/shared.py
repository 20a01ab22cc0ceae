"""Folders and tables that every executor can read."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..sources.shared import scratch_path

_libc = ctypes.CDLL(None)


class Folder:
    """Names below a path of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self._type = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._root = path.rstrip("/")
        root = self._type(self._root)
        self._fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._whole = self._fs.makeQualified(root).toString()

    def _at(self, name: str):
        return self._type(f"{self._root}/{name}" if name else self._root)

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        """What lies directly in the folder, none if it isn't there."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if self.has("") else []

    def holds(self, path: str) -> bool:
        """Whether a path lies below the folder."""
        return bool(path) and self._fs.makeQualified(self._type(path)).toString().startswith(f"{self._whole}/")

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def delete(self, name: str = "") -> None:
        """Removes what has the name, or the folder itself."""
        self._fs.delete(self._at(name), True)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back:
    later reads neither recompute them nor depend on an executor's disk."""
    path = path or scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What empties the caches that this Python worker keeps between tasks.
on_switch: list[Callable[[], None]] = []
_operator = ""


def trim() -> None:
    """Gives back what this worker has freed; else it stays with it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def _call(fn, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs ``fn``; a worker that turns to another operator first drops what
    the last one cached, so that a pipeline's stages don't add up."""
    global _operator
    if (now := getattr(getattr(fn, "func", fn), "__module__", "")) != _operator:
        for clear in on_switch:
            clear()
        _operator = now
        trim()
    return fn(batches, TaskContext.get().partitionId())


def with_fields(schema: StructType, **fields: str) -> StructType:
    """The schema with nullable fields added."""
    return StructType([*schema.fields, *StructType.fromDDL(", ".join(f"{k} {v}" for k, v in fields.items())).fields])


def map_batches(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """mapInArrow with a function of the batches and the partition's number."""
    return df.mapInArrow(partial(_call, fn), schema)
