"""Embedding whitening by a compensated covariance.

Vectors are put on a grid of whole numbers, centred on their exact mean and
multiplied out in double-double arithmetic: error-free sums and products keep
what a double rounds off in a second one, so the covariance is right to some
30 digits whatever the mean and the number of rows.  Every task keeps one
matrix of high and one of low parts and sends its rows; they are merged in two
levels, and only the final matrix, whose size is the vectors' dimension
squared, comes to the driver.  Its eigenvectors are LAPACK's ``syevd``: a
reduction to tridiagonal form and divide and conquer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, stored

Pair = tuple[np.ndarray, np.ndarray]
#: Rows that are multiplied out at once; the sums over them go by halves.
_ROWS = 256
_SUMS = "key long, task int, n long, hi binary, lo binary"


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and what its rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def _halves(a: np.ndarray) -> Pair:
    """A double as two of 26 bits, whose products are exact."""
    t = a * 134217729.0
    hi = t - (t - a)
    return hi, a - hi


def dd_add(a: Pair, b: Pair) -> Pair:
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    e = e + t
    s, e = s + e, e - ((s + e) - s)
    e = e + f
    return s + e, e - ((s + e) - s)


def dd_products(a: Pair, b: Pair) -> Pair:
    """The products of double-doubles, element by element."""
    (a1, a2), (b1, b2) = _halves(a[0]), _halves(b[0])
    p = a[0] * b[0]
    e = (((a1 * b1 - p) + a1 * b2) + a2 * b1) + a2 * b2
    e = e + (a[0] * b[1] + a[1] * b[0])
    return p + e, e - ((p + e) - p)


def dd_total(a: Pair) -> Pair:
    """The sum over the first axis."""
    hi, lo = a
    while len(hi) > 1:
        half = len(hi) // 2
        rest = hi[2 * half :], lo[2 * half :]
        hi, lo = dd_add((hi[:half], lo[:half]), (hi[half : 2 * half], lo[half : 2 * half]))
        if len(rest[0]):
            hi, lo = np.concatenate([hi, rest[0]]), np.concatenate([lo, rest[1]])
    return hi[0], lo[0]


def on_grid(vectors: np.ndarray) -> np.ndarray:
    """Entries as whole numbers: floor(1024 c) + 100000."""
    return np.floor(1024 * vectors) + 100_000


def _matrix(column: pa.ListArray, dim: int, grid: bool) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return on_grid(flat) if grid else flat


def _rows(parts: dict[int, tuple[int, Pair]], task: int) -> pa.RecordBatch:
    """The parts of a task as rows to merge."""
    found = sorted(parts.items())
    keys, counts = [k for k, _ in found], [n for _, (n, _) in found]
    packed = [pa.array([p[i].tobytes() for _, (_, p) in found], pa.binary()) for i in (0, 1)]
    return pa.record_batch([pa.array(keys, pa.int64()), pa.array([task] * len(keys), pa.int32()), pa.array(counts, pa.int64()), *packed], names=["key", "task", "n", "hi", "lo"])


def _sum_vectors(batches: Iterator[pa.RecordBatch], task: int, grid: bool) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each length, the length being the key."""
    parts: dict[int, tuple[int, Pair]] = {}
    for batch in batches:
        column = batch.column(0)
        lengths = column.value_lengths().to_numpy()
        for dim in np.unique(lengths).tolist():
            own = column.filter(pa.array(lengths == dim))
            hi = _matrix(own, dim, grid) if dim else np.zeros((len(own), 0))
            n, before = parts.get(dim, (0, (np.zeros(dim), np.zeros(dim))))
            parts[dim] = n + len(own), dd_add(before, dd_total((hi, np.zeros_like(hi))))
    yield _rows(parts, task)


def _sum_products(batches: Iterator[pa.RecordBatch], task: int, mean: Pair, grid: bool) -> Iterator[pa.RecordBatch]:
    """Sums of centred outer products; each row of the upper triangle is a key."""
    dim, n = len(mean[0]), 0
    total = [(np.zeros(dim - i), np.zeros(dim - i)) for i in range(dim)]
    for batch in batches:
        matrix = _matrix(batch.column(0), dim, grid)
        n += len(matrix)
        for at in range(0, len(matrix), _ROWS):
            hi, lo = centred(matrix[at : at + _ROWS], mean)
            for i in range(dim):
                total[i] = dd_add(total[i], dd_total(dd_products((hi[:, i : i + 1], lo[:, i : i + 1]), (hi[:, i:], lo[:, i:]))))
    yield _rows({i: (n, p) for i, p in enumerate(total)} if n else {}, task)


def centred(matrix: np.ndarray, mean: Pair) -> Pair:
    """The vectors less their mean."""
    hi, lo = two_sum(matrix, -mean[0])
    lo = lo - mean[1]
    return hi + lo, lo - ((hi + lo) - hi)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of one key's rows, one at a time."""
    total: Pair | None = None
    key = task = n = 0
    for batch in batches:
        for key, task, own, hi, lo in zip(*(batch.column(c).to_pylist() for c in ("key", "task", "n", "hi", "lo")), strict=True):  # noqa: B007
            pair = np.frombuffer(hi), np.frombuffer(lo)
            total, n = pair if total is None else dd_add(total, pair), n + own
    if total is not None:
        yield _rows({key: (n, total)}, task)


def _merged(parts: DataFrame) -> DataFrame:
    """(key, n, hi, lo): the tasks' rows summed by 64 groups of tasks and then
    over these, so that many tasks don't meet in one."""
    fewer = parts.groupBy("key", F.pmod("task", F.lit(64)).alias("part")).applyInArrow(_merge, _SUMS)
    return fewer.groupBy("key").applyInArrow(_merge, _SUMS)


@dataclass(frozen=True)
class Moments:
    """n rows, their exact sums, mean and covariance (divisor n)."""

    n: int
    sums: list[Fraction]
    mean: Pair
    covariance: np.ndarray


def moments(rows: DataFrame, column: str, grid: bool) -> Moments | None:
    """Moments of vectors of doubles (``grid``: of their whole numbers), None
    of no rows.  Vectors of the most common length count, of lengths as common
    the longest; neither vectors nor entries may be null."""
    rows = rows.select(column)
    sums = _merged(map_batches(rows, partial(_sum_vectors, grid=grid), _SUMS)).orderBy(F.desc("n"), F.desc("key")).first()
    if sums is None:
        return None
    n, dim = sums["n"], sums["key"]
    total = [Fraction(h) + Fraction(l) for h, l in zip(np.frombuffer(sums["hi"]).tolist(), np.frombuffer(sums["lo"]).tolist(), strict=True)]
    if not dim:
        return Moments(n, [], (np.zeros(0), np.zeros(0)), np.zeros((0, 0)))
    hi = [float(s / n) for s in total]
    mean = np.array(hi), np.array([float(s / n - Fraction(h)) for s, h in zip(total, hi, strict=True)])
    products = map_batches(rows.where(F.size(column) == dim), partial(_sum_products, mean=mean, grid=grid), _SUMS)
    covariance = np.zeros((dim, dim))
    for r in _merged(products).collect():  # a row for each dimension
        covariance[r["key"], r["key"] :] = covariance[r["key"] :, r["key"]] = (np.frombuffer(r["hi"]) + np.frombuffer(r["lo"])) / n
    return Moments(n, total, mean, covariance)


@dataclass(frozen=True)
class Whitening:
    """What the vectors are whitened by: eigenvalues falling, a column of
    ``vectors`` for each, whose largest entry is positive."""

    moments: Moments
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> list[float]:
        return (self.values / np.trace(self.moments.covariance)).tolist()


def usable(vector: Column) -> Column:
    """Neither null nor with entries that are null or not finite."""
    odd = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def fit(rows: DataFrame, column: str, components: int) -> Whitening | None:
    """The whitening of the usable vectors' grid; None where there are none.

    At most ``components`` eigenvectors, fewer where the vectors don't spread
    in as many directions: those with an eigenvalue within rounding of zero
    are left out, so equal vectors have none.
    """
    found = moments(rows.where(usable(F.col(column))), column, grid=True)
    if found is None:
        return None
    values, vectors = np.linalg.eigh(found.covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    spread = values > np.finfo(float).eps * len(found.sums) * max(np.trace(found.covariance), 0)
    values, vectors = values[spread], vectors[:, spread]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]) if len(values) else np.ones(0)
    return Whitening(found, values, vectors * sign)


def deviations(matrix: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over the dimensions of (n x - S) squared, exact: in 64 bits
    where that is sure to suffice, else in whole numbers of any size."""
    most = max((max(abs(n * int(lo) - s), abs(n * int(hi) - s)) for lo, hi, s in zip(matrix.min(axis=0), matrix.max(axis=0), sums, strict=True)), default=0) if len(matrix) else 0
    kind = np.int64 if most**2 * len(sums) < 1 << 63 and n * float(np.abs(matrix).max(initial=0)) < 1 << 62 else object
    d = matrix.astype(np.int64).astype(kind) * n - np.array(sums, kind)
    return (d * d).sum(axis=1).tolist()


def _whiten(batches: Iterator[pa.RecordBatch], task: int, model) -> Iterator[pa.RecordBatch]:
    w: Whitening = model.value
    scaled = w.vectors / np.sqrt(w.values)
    sums = [int(s) for s in w.moments.sums]
    for batch in batches:
        matrix = _matrix(batch.column(1), len(sums), True)
        hi, lo = centred(matrix, w.moments.mean)
        whitened = hi @ scaled + lo @ scaled
        ends = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * len(w.values))
        found = [pa.array(str(d) for d in deviations(matrix, w.moments.n, sums)), pa.ListArray.from_arrays(ends, pa.array(whitened.reshape(-1)))]
        yield pa.record_batch([batch.column(0), *found], names=[batch.schema.names[0], "deviation", "whitened"])


def whiten(rows: DataFrame, model: Whitening, id: str, column: str) -> DataFrame:
    """``id``, deviation decimal(38, 0), whitened array<double> of every usable
    vector of the model's length; repeated rows are whitened each."""
    w = model
    known = rows.where(usable(F.col(column)) & (F.size(column) == len(w.moments.sums))).select(id, column)
    kind = known.schema[id].dataType.simpleString()
    out = map_batches(known, partial(_whiten, model=rows.sparkSession.sparkContext.broadcast(w)), f"`{id}` {kind}, deviation string, whitened array<double>")
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(whitened: DataFrame) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    found = moments(whitened, "whitened", grid=False)
    return float(np.abs(found.covariance - np.eye(len(found.sums))).max(initial=0)) if found else 0.0


def whitened_rows(rows: DataFrame, components: int = 8, id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: the id, component, n,
    deviation, whitened, explained, identity_error.

    Null vectors, vectors with null or non-finite entries and vectors of
    another than the most common length have no rows, nor has anything where
    all vectors are equal.  A deviation beyond a long is an error, not a wrong
    number.  A null id stays null; other columns are ignored.
    """
    schema = f"`{id}` {rows.schema[id].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, column, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    table = stored(whiten(rows, model, id, column), "whitened")
    flat = table.select(id, F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, model.explained)), F.col("at") + 1)
    return flat.select(
        id, (F.col("at") + 1).alias("component"), F.lit(model.moments.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(identity_error(table)).alias("identity_error")
    )
