"""CSV, JSON and JSONL sources and sinks with fixed schemas."""

from __future__ import annotations

import copy
import csv
import json
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The columns of each kind of file, and other names they go by.
BASE = "timestamp double, uav_id string, lat double, lon double, alt double, vx double, vy double, vz double, speed double"
_SEEN = "time double, id string, lat double, lon double, alt double, vx double, vy double"
_TAIL = "scenario_tag string, missing_flag int, blackout_flag int, arrival_time double"
SCHEMAS = {
    "truth": BASE,
    "gps": f"{BASE}, {_TAIL}, Nsat int, DOP double, RTK string",
    "radar": f"{BASE}, {_TAIL}, E double, Ptrk double",
    "fiveg": f"{BASE}, {_TAIL}, SNR double, RSSI double, d double, ploss double",
    "tdoa": f"{BASE}, {_TAIL}, eps_sync double, e double",
    "detected": f"{_SEEN}, confidence double",
    "reported": f"{_SEEN}, snr double, rssi double, delay double, coverage double",
    "acoustic": f"timestamp double, uav_id string, detected_flag int, spl_db double, acoustic_energy double, {_TAIL}, SNRa double, n double",
}
ALIASES = {"id": "uav_id", "source_conf": "confidence"}
KEYS = {"fiveg": "fiveg", "5g": "fiveg", "5ga": "fiveg", "5g_a": "fiveg"}


def modality_key(name: Column) -> Column:
    """A sensor's name: trimmed, lower case, with all names of 5G as one."""
    key = F.lower(F.trim(name))
    return F.when(key.isin(*KEYS), "fiveg").otherwise(key)


def headers(spark: SparkSession, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """The CSV files of the paths (files, folders with all below, patterns)
    by their header.  Only first lines are read; paths that aren't there and
    files without a line are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop
    codecs = hadoop.io.compress.CompressionCodecFactory(conf)
    found: dict[tuple[str, ...], list[str]] = {}

    def files(status) -> Iterator:
        name = status.getPath().getName()
        if status.isFile():
            yield status.getPath()
        elif not name.startswith(("_", ".")):
            for below in sorted(status.getPath().getFileSystem(conf).listStatus(status.getPath()), key=lambda s: s.getPath().toString()):
                if not below.getPath().getName().startswith(("_", ".")):
                    yield from files(below)

    for path in paths:
        at = hadoop.fs.Path(path)
        for status in at.getFileSystem(conf).globStatus(at) or []:
            for file in files(status):
                stream = file.getFileSystem(conf).open(file)
                try:
                    codec = codecs.getCodec(file)
                    text = jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
                    line = jvm.java.io.BufferedReader(text).readLine()
                finally:
                    stream.close()
                if line is not None:
                    names = next(csv.reader([line.removeprefix("\ufeff")]), [])
                    found.setdefault(tuple(n.strip() for n in names), []).append(file.toString())
    return found


def read_csv(spark: SparkSession, path: str | list[str], kind: str, source: str | None = None) -> DataFrame:
    """Files with a header, each read by its own column names.  Columns that a
    file lacks are null, other ones are left out; aliases are renamed where a
    file lacks the name itself, and of a name that repeats the first counts.
    NaN and blanks are null.  No file, or one that isn't there, has no rows.
    ``source`` names a column for each row's file."""
    schema = StructType.fromDDL(SCHEMAS[kind])
    parts = []
    for names, files in headers(spark, [path] if isinstance(path, str) else path).items():
        text = spark.read.option("header", True).option("nanValue", "\x00").schema(", ".join(f"_c{i} string" for i in range(len(names)))).csv(files)
        have = {n: F.col(f"_c{i}") for i, n in reversed([*enumerate(names)])}
        have = {ALIASES[n]: c for n, c in have.items() if n in ALIASES} | have
        cast = {f.name: F.when(F.lower(F.trim(have[f.name])) != "nan", F.trim(have[f.name])).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType) for f in schema}
        own = [text.metadataColumn("_metadata")["file_path"].alias(source)] if source else []
        parts.append(text.select(*(c.alias(n) for n, c in cast.items()), *own))
    if not parts:
        return spark.createDataFrame([], schema if source is None else StructType([*schema.fields]).add(source, "string"))
    return reduce(DataFrame.unionByName, parts)


def write_tracks(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Rows by dataset profile, batch and modality, in track order within each
    file.  What lies there of the parts that ``rows`` has is replaced, and the
    rest stays, so a job that is run again doesn't write twice.  Rows without
    any of these columns replace all that is there."""
    parts = [c for c in ("profile", "batch", "modality") if c in rows.columns]
    ordered = rows.sortWithinPartitions(*parts, "timestamp", "uav_id")
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*parts) if parts else writer).option("header", True).format(kind).save(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Lines of JSON with ``_line``, an increasing number for each line of a
    file in order; blank lines are dropped and broken ones are null rows.
    ``limit`` takes the first lines of each file, blank ones counted."""
    text = spark.read.text(path)
    lines = text.select("value", F.monotonically_increasing_id().alias("_line"), *(text.metadataColumn("_metadata")[c].alias(f"_{c}") for c in ("file_path", "file_block_start")))
    if limit is not None:
        lines = _first_lines(lines, limit)
    return lines.where(F.trim("value") != "").select("_line", F.from_json("value", schema).alias("_row")).select("_line", "_row.*")


def _first_lines(lines: DataFrame, limit: int) -> DataFrame:
    """The first lines of each file: the blocks that Spark reads a file by are
    counted, which tells how many lines precede each, whatever order tasks
    end in.  A file's blocks are few, one for each of some 100 MB."""
    block = ["_file_path", "_file_block_start"]
    earlier = Window.partitionBy("_file_path").orderBy("_file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy(*block).agg(F.min("_line").alias("_first"), F.count(F.lit(1)).alias("_n"))
    wanted = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where(F.col("_before") < limit).drop("_n")
    return lines.join(wanted, block).where(F.col("_before") + F.col("_line") - F.col("_first") < limit)


def write_jsonl(rows: DataFrame, path: str, batch: str) -> None:
    """Writes the rows as lines of JSON, other than ASCII as it is, as one
    batch of a folder; a batch that is written again replaces itself."""
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    lines.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").text(path)


def write_json(values: DataFrame, path: str) -> None:
    """One JSON object for each row, nested columns as they are and nulls
    included, in place of what was there."""
    values.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def deep_update(base: dict, override: dict) -> dict:
    """``base`` with the override's values, dicts merged and lists replaced."""
    out = copy.deepcopy(base)
    for key, value in override.items():
        out[key] = deep_update(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def profiles(text: str) -> Iterator[tuple[str, dict]]:
    """(name, settings) of each profile of a JSON configuration."""
    root = json.loads(text)
    for profile in root.get("profiles", []):
        yield profile["name"], deep_update(root.get("base_override", {}), profile.get("override", {}))
