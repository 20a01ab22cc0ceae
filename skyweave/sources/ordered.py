"""Tables stored in one order over all their files, with an index of bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_FILES = 99_999  # names of part files have five digits, and sort as numbers up to here


def write_sorted(rows: DataFrame, path: str, keys: tuple[str, ...] = ("timestamp", "uav_id"), files: int | None = None) -> None:
    """Parquet files that, taken by name, are one table sorted by ``keys``,
    in place of what was there; nulls come first and rows of equal keys stay
    in the order they came in.

    Rows are dealt to ranges of about equal size and sorted within each, as
    many as ``files`` or the session's shuffle partitions.  A row's number
    breaks ties of the ranges, so keys that repeat in a third of all rows are
    many files too.  ``_index`` beside the files holds for each its rows, the
    rows of all files before it and the bounds of the first key.
    """
    spark = rows.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not 0 < files <= MOST_FILES:
        raise ValueError(f"files must be 1 to {MOST_FILES}, not {files}")
    number = next(n for n in map("_number{}".format, range(len(rows.columns) + 1)) if n not in rows.columns)
    dealt = rows.withColumn(number, F.monotonically_increasing_id()).repartitionByRange(files, *keys, number)
    dealt.sortWithinPartitions(*keys, number).drop(number).write.mode("overwrite").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    bounds = stored.groupBy(stored.metadataColumn("_metadata")["file_name"].alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min(keys[0]).alias("least"), F.max(keys[0]).alias("most"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bounds.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).coalesce(1).write.parquet(f"{path.rstrip('/')}/_index")


def files_of(spark: SparkSession, path: str, low: object, high: object) -> list[str]:
    """The names of the files that may hold a first key from ``low`` to
    ``high``, both included, in order: at most as many as were written."""
    index = spark.read.parquet(f"{path.rstrip('/')}/_index").where((F.col("most") >= low) & (F.col("least") <= high))
    return [r.file for r in index.select("file").orderBy("file").collect()]


def read_range(spark: SparkSession, path: str, key: str, low: object, high: object, place: str | None = None) -> DataFrame:
    """The rows whose ``key``, the first that the table was sorted by, is from
    ``low`` to ``high``, both included; only files that may hold some are
    opened.  Rows of a null key are never among them.  ``place`` names a column
    for a row's number in the whole table, from 0."""
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    names = files_of(spark, path, low, high)
    found = spark.read.schema(schema).parquet(*(f"{path}/{n}" for n in names or [""]))
    wanted = F.col(key).between(low, high) if names else F.lit(False)
    if place is None:
        return found.where(wanted)
    meta = found.metadataColumn("_metadata")
    own = found.select(*found.columns, meta["file_name"].alias("file"), meta["row_index"].alias("_at")).where(wanted)
    before = spark.read.parquet(f"{path}/_index").select("file", "before")
    return own.join(before, "file").select(*found.columns, (F.col("before") + F.col("_at")).alias(place))
