"""Distances of two paths that go through the matrix of all their steps.

The matrix is cut into square tiles.  A tile needs its two rows of points and
the last values of the tiles above and to its left, so all tiles of one
anti-diagonal are tasks of one round, and only edges go from round to round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved, scratch_path
from .running import with_number


def _tile(a: np.ndarray, b: np.ndarray, top: np.ndarray, left: np.ndarray, band: int | None = None, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The last row and the last column of a tile, both with the value before
    their first, for both ways to add up distances: [sum, max].

    ``top`` [2, m + 1] is the row above from the corner on, ``left`` [2, n + 1]
    the column to the left.  Only cells whose steps differ by ``band`` at most
    count, where ``shift`` is the difference at the corner.  Works along
    anti-diagonals, so it holds three of them.
    """
    n, m = len(a), len(b)
    back = b[::-1]
    low, right = np.full((2, m + 1), np.inf), np.full((2, n + 1), np.inf)
    low[:, 0], right[:, 0] = left[:, n], top[:, m]
    before, last = np.full((2, n + 1), np.inf), np.full((2, n + 1), np.inf)
    before[:, 0] = top[:, 0]
    last[:, 0], last[:, 1] = top[:, 1], left[:, 1]
    for d in range(2, n + m + 1):
        now = np.full((2, n + 1), np.inf)
        if d <= m:
            now[:, 0] = top[:, d]
        if d <= n:
            now[:, d] = left[:, d]
        i, end = max(1, d - m), min(n, d - 1) + 1
        if band is not None:
            i, end = max(i, -((band + shift - d) // 2)), min(end, (d - shift + band) // 2 + 1)
        if i < end:
            cost = np.hypot(*(a[i - 1 : end - 1] - back[m - d + i : m - d + end]).T)
            way = np.minimum(np.minimum(last[:, i - 1 : end - 1], last[:, i:end]), before[:, i - 1 : end - 1])
            np.add(cost, way[0], out=now[0, i:end])
            np.maximum(cost, way[1], out=now[1, i:end])
        if d > n:
            low[:, d - n] = now[:, n]
        if d > m:
            right[:, d - m] = now[:, d - m]
        before, last = last, now
    return low, right


def _whole(a: np.ndarray, b: np.ndarray, band: int | None) -> np.ndarray:
    top, left = np.full((2, len(b) + 1), np.inf), np.full((2, len(a) + 1), np.inf)
    top[:, 0] = left[:, 0] = 0.0
    return _tile(a, b, top, left, band)[0][:, -1]


def dtw(a: np.ndarray, b: np.ndarray, band: int | None = None) -> float:
    """Dynamic time warping of two point rows, by the longer one's length.
    ``band`` keeps to cells whose steps differ by that much at most, so time
    grows with the length and not its square; infinite if no way fits."""
    return float(_whole(a, b, band)[0]) / max(len(a), len(b))


def frechet(a: np.ndarray, b: np.ndarray, band: int | None = None) -> float:
    """The discrete Frechet distance of two point rows; ``band`` as for dtw()."""
    return float(_whole(a, b, band)[1])


def _side(track: DataFrame, side: str, size: int) -> DataFrame:
    """One path's points, numbered, with their block."""
    rows = track.select("uav_id", "t_idx", F.col(f"{side}x").cast("double").alias("x"), F.col(f"{side}y").cast("double").alias("y")).where("abs(x) < double('inf') AND abs(y) < double('inf')")
    numbered = with_number(rows, "uav_id", ["t_idx"], "n", 1 << 16)
    return numbered.select("uav_id", F.floor(F.col("n") / size).alias("block"), (F.col("n") % size).cast("long").alias("pos"), "x", "y")


def _joined(rows: DataFrame, more: DataFrame, block: bool, how: str) -> DataFrame:
    """A join by object, null being one too, and by block."""
    more = more.withColumnsRenamed({"uav_id": "_u"} | ({"block": "_b"} if block else {}))
    same = F.col("uav_id").eqNullSafe(F.col("_u"))
    return rows.join(more, same & (F.col("block") == F.col("_b")) if block else same, how).drop("_u", "_b")


def path_distances(track: DataFrame, band: int | None = None, size: int = 4096) -> DataFrame:
    """``uav_id``, ``dtw`` and ``frechet`` of each track's plane points.

    A track of up to ``size`` rows is one tile.  Tiles are ``size`` wide, so
    one of n points is about n / size tasks at a time for 2 n / size rounds,
    each in memory linear in ``size``.  With a ``band`` only tiles that it
    meets are made; infinite if no way fits.  A point without two finite
    coordinates isn't part of its path; null where a path has no points.
    Points of one t_idx are in any order.
    """
    rows = track.select("uav_id", "t_idx", *(F.col(c).cast("double").alias(c) for c in ("gx", "gy", "px", "py")))
    counts = saved(rows.groupBy("uav_id").agg(F.count(F.lit(1)).alias("rows")), "path-rows")
    long = counts.where(F.col("rows") > size).select("uav_id")
    if long.isEmpty():
        return _single(rows, band)
    return _single(_joined(rows, long, False, "left_anti"), band).unionByName(_tiled(_joined(rows, long, False, "left_semi"), band, size))


def _single(track: DataFrame, band: int | None) -> DataFrame:
    """path_distances() of tracks of one tile."""

    def one(ids: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("t_idx")
        a, b = (rows[[f"{s}x", f"{s}y"]].to_numpy(float) for s in "gp")
        a, b = a[np.isfinite(a).all(1)], b[np.isfinite(b).all(1)]
        total, most = _whole(a, b, band) if len(a) and len(b) else (None, None)
        by = max(len(a), len(b))
        return pd.DataFrame({"uav_id": pd.Series([ids[0]], dtype=object), "dtw": [total / by if by and total is not None else None], "frechet": [most]})

    key = track.schema["uav_id"].dataType.simpleString()
    return track.groupBy("uav_id").applyInPandas(one, f"uav_id {key}, dtw double, frechet double")


def _tiled(track: DataFrame, band: int | None, size: int) -> DataFrame:
    """path_distances() of tracks of any length, in rounds of tiles."""
    spark = track.sparkSession
    sides = {s: saved(_side(track, s, size), f"path-{s}") for s in "gp"}
    lengths = None
    for s, rows in sides.items():
        one = rows.groupBy("uav_id", "block").agg(F.count(F.lit(1)).alias("n")).groupBy("uav_id").agg(F.sum("n").alias(f"n{s}"), F.count(F.lit(1)).alias(f"b{s}"))
        lengths = _joined(track.select("uav_id").distinct() if lengths is None else lengths, one, False, "left")
    lengths = saved(lengths, "path-lengths")
    both = lengths.where("bg > 0 AND bp > 0")
    rounds, wide = both.agg(F.max(F.col("bg") + F.col("bp") - 1), F.sum(F.least("bg", "bp"))).first()
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), wide or 1)
    reach = None if band is None else band // size + 1  # how far tiles are from the diagonal

    def placed(s: str, other: str) -> DataFrame:
        """Points with the first round that needs them and the one after the last."""
        blocks = both.select("uav_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"b{s}") - 1)).alias("block"), F.col("bg").alias("bg"), F.col("bp").alias("bp"))
        first, till = F.col("block"), F.col("block") + F.col(f"b{other}")
        if reach is not None:
            first, till = F.greatest(first, 2 * F.col("block") - reach), F.least(till, 2 * F.col("block") + reach + 1)
        rows = _joined(sides[s], blocks.select("uav_id", "block", first.alias("first"), till.alias("till"), "bg", "bp"), True, "inner")
        return rows.withColumn("kind", F.lit(s))

    points = saved(placed("g", "p").unionByName(placed("p", "g")).sortWithinPartitions("till"), "path-points")
    key = track.schema["uav_id"].dataType.simpleString()
    schema = f"uav_id {key}, i long, j long, kind string, pos long, x double, y double"

    def run(ids: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        uav, i, j = ids[0], int(ids[1]), int(ids[2])
        part = {k: v.sort_values("pos") for k, v in rows.groupby("kind")}
        a, b = (part[s][["x", "y"]].to_numpy() if s in part else np.empty((0, 2)) for s in "gp")
        if not len(a) or not len(b):
            raise ValueError(f"tile {i}, {j} of {uav} lacks points")
        top, left = np.full((2, len(b) + 1), np.inf), np.full((2, len(a) + 1), np.inf)
        if i == j == 0:
            top[:, 0] = left[:, 0] = 0.0
        for k, edge in (("top", top), ("left", left)):
            if k in part:
                edge[:, part[k]["pos"].to_numpy()] = part[k][["x", "y"]].to_numpy().T
        # either edge may be beyond the band; they meet in the corner
        top[:, 0] = left[:, 0] = np.minimum(top[:, 0], left[:, 0])
        low, right = _tile(a, b, top, left, band, (i - j) * size)
        bg, bp = (int(part["g"][c].iloc[0]) for c in ("bg", "bp"))
        out = [("top", i + 1, j, low)] * (i + 1 < bg) + [("left", i, j + 1, right)] * (j + 1 < bp) + [("end", i, j, low[:, -1:])] * (i + 1 == bg and j + 1 == bp)
        made = []
        for kind, to_i, to_j, edge in out:
            at = np.flatnonzero(np.isfinite(edge[0]))
            made.append(pd.DataFrame({"uav_id": pd.Series([uav] * len(at), dtype=object), "i": to_i, "j": to_j, "kind": kind, "pos": at, "x": edge[0, at], "y": edge[1, at]}))
        return pd.concat(made)

    def dealt(k: int) -> DataFrame:
        """The points that the tiles of round ``k`` need."""
        block, here = F.col("block"), points.where((F.col("first") <= k) & (F.col("till") > k))
        of: dict[str, Column] = {"i": F.when(F.col("kind") == "g", block).otherwise(k - block), "j": F.when(F.col("kind") == "g", k - block).otherwise(block)}
        return here.select("uav_id", *(c.alias(n) for n, c in of.items()), "kind", "pos", "x", "y", "bg", "bp")

    folder = scratch_path(spark, "path-tiles")
    blank = spark.createDataFrame([], schema)
    blank.write.parquet(f"{folder}/round=-1")
    edges = blank
    for k in range(rounds or 0):
        if reach is not None:
            edges = edges.where(F.abs(F.col("i") - F.col("j")) <= reach)
        tiles = dealt(k).unionByName(edges, allowMissingColumns=True).repartition(parts, "uav_id", "i", "j")
        tiles.groupBy("uav_id", "i", "j").applyInPandas(run, schema).write.parquet(f"{folder}/round={k}")
        edges = spark.read.schema(schema).parquet(f"{folder}/round={k}").where("kind <> 'end'")
    ends = spark.read.schema(schema).parquet(*(f"{folder}/round={k}" for k in range(-1, rounds or 0))).where("kind = 'end'").select("uav_id", "x", "y")
    value = lambda c: F.when((F.col("bg") > 0) & (F.col("bp") > 0), F.coalesce(c, F.lit(float("inf"))))
    return _joined(lengths, ends, False, "left").select("uav_id", value(F.col("x") / F.greatest("ng", "np")).alias("dtw"), value(F.col("y")).alias("frechet"))
