"""Training samples of windows and padded batches of them.

A sample is a window of a track: its nodes (observations that belong to one of
its times) as arrays, and the truth of its times.  Samples of like size are
batched together, so little is padded; a batch is one row of arrays of fixed
size, and shards of batches have an index of what they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import running, windows


def samples(nodes: DataFrame, truth: DataFrame, key: str, index: str, order: list[str], size: int, stride: int) -> DataFrame:
    """A row for each whole window with a node: ``key``, start, n_nodes,
    node_feat [node, feature], node_t, node_m, y [time, axis].

    ``nodes`` (``key``, ``index``, ``m``, ``feature``, and ``order``, which
    sorts the nodes of a time) and ``truth`` (``key``, ``index`` from 0 without
    gaps, ``y``) are dealt to the windows that hold their index.  Nodes of
    other indices than the truth's are in no window.
    """
    times = windows.with_length(truth, key)
    lengths = times.select(F.col(key).alias("_k"), "length").distinct()
    held = nodes.join(lengths, nodes[key].eqNullSafe(lengths["_k"])).drop("_k")
    own = windows.dealt(held, index, F.col("length"), size, stride)
    cells = own.groupBy(key, "start").agg(F.array_sort(F.collect_list(F.struct("pos", *order, "m", "feature"))).alias("_n"))
    steps = windows.dealt(times, index, F.col("length"), size, stride).groupBy(key, "start").agg(F.array_sort(F.collect_list(F.struct("pos", "y"))).alias("_y"))
    steps = steps.withColumnsRenamed({key: "_k", "start": "_s"})
    both = cells.join(steps, cells[key].eqNullSafe(steps["_k"]) & (cells["start"] == steps["_s"]))
    return both.select(key, "start", F.size("_n").alias("n_nodes"), F.col("_n.feature").alias("node_feat"), F.col("_n.pos").alias("node_t"), F.col("_n.m").alias("node_m"), F.col("_y.y").alias("y"))


def _each(rows: Column, means: list[float], stds: list[float]) -> Column:
    """Rows of numbers less their means, by their deviations."""
    mean, std = (F.array(*(F.lit(float(x)) for x in values)) for values in (means, stds))
    return F.transform(rows, lambda row: F.transform(row, lambda x, i: (x - F.get(mean, i)) / F.get(std, i)))


def scale(rows: DataFrame, column: str, first: int | None = None) -> tuple[list[float], list[float]]:
    """Means and deviations (plus 1e-6) of each place in the ``column``'s rows
    of numbers over all samples; places from ``first`` on get 0 and 1.  A few
    numbers, whatever the samples."""
    flat = rows.select(F.explode(column).alias("r")).select(F.posexplode("r").alias("i", "x"))
    found = flat.groupBy("i").agg(F.avg("x").alias("mean"), (F.stddev_pop("x") + 1e-6).alias("std")).orderBy("i").collect()
    keep = lambda r, name, other: other if first is not None and r.i >= first else r[name]
    return [keep(r, "mean", 0.0) for r in found], [keep(r, "std", 1.0) for r in found]


def scaled(rows: DataFrame, column: str, by: tuple[list[float], list[float]]) -> DataFrame:
    return rows.withColumn(column, _each(F.col(column), *by))


def _padded(rows: Column, length: Column, filling: Column) -> Column:
    return F.concat(rows, F.array_repeat(filling, (length - F.size(rows)).cast("int")))


def batches(rows: DataFrame, key: str, size: int, features: int, step: int = 8, width: float = 4096) -> DataFrame:
    """A row for each batch of up to ``size`` samples: bucket, batch, n,
    nodes (the longest's), keys, starts, node_feat [sample, node, feature],
    node_t, node_m and node_mask [sample, node], y [sample, time, axis].

    Samples meet by bucket, of ``step`` counts of nodes each, in order of
    (start, key), so a batch of one bucket is padded by less than ``step``
    nodes a sample, with zeros, and -1 in node_t and node_m.
    """
    dealt = rows.withColumn("bucket", F.ceil(F.col("n_nodes") / step))
    numbered = running.with_number(dealt, "bucket", ["start", key], "_i", width)
    own = numbered.withColumn("batch", F.floor(F.col("_i") / size))
    names = ["_i", key, "start", "node_feat", "node_t", "node_m", "y", "n_nodes"]
    held = own.groupBy("bucket", "batch").agg(F.max("n_nodes").alias("nodes"), F.array_sort(F.collect_list(F.struct(*names))).alias("_s"))
    nothing = F.array_repeat(F.lit(0.0), features)
    pad = lambda name, filling: F.transform(F.col(f"_s.{name}"), lambda x: _padded(x, F.col("nodes"), filling))
    mask = F.transform(F.col("_s.n_nodes"), lambda n: _padded(F.array_repeat(F.lit(1.0), n), F.col("nodes"), F.lit(0.0)))
    return held.select(
        "bucket", "batch", F.size("_s").alias("n"), "nodes", F.col(f"_s.{key}").alias("keys"), F.col("_s.start").alias("starts"),
        pad("node_feat", nothing).alias("node_feat"), pad("node_t", F.lit(-1).cast("long")).alias("node_t"), pad("node_m", F.lit(-1)).alias("node_m"), mask.alias("node_mask"), F.col("_s.y").alias("y"),
    )


def write_shards(made: DataFrame, path: str, shards: int) -> None:
    """Batches as ``shards`` folders ``shard=k`` of Parquet, and ``index``:
    shard, batches, samples, nodes, for readers that skip by counts."""
    spark = made.sparkSession
    dealt = made.withColumn("shard", F.pmod(F.xxhash64("bucket", "batch"), F.lit(shards)).cast("int"))
    dealt.repartition(shards, "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/data")
    whole = spark.read.parquet(f"{path}/data")
    counts = whole.groupBy("shard").agg(F.count(F.lit(1)).alias("batches"), F.sum("n").alias("samples"), F.sum(F.col("n") * F.col("nodes")).alias("nodes"))
    counts.write.mode("overwrite").parquet(f"{path}/index")


def read_shards(spark, path: str, shards: list[int] | None = None) -> DataFrame:
    """The batches of some shards, or of all; only their folders are opened."""
    rows = spark.read.parquet(f"{path}/data")
    return rows if shards is None else rows.where(F.col("shard").isin(*shards))
