import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweave.operators import asof, intervals, metrics, paths, running

R = random.Random(5)
#: One object holds all rows; times are spread over many buckets, with gaps, ties and nulls.
TIMES = sorted(R.choices([*range(0, 3000), *range(9000, 9050)], k=1200))
ROWS = [(None if n % 100 == 99 else 1, t, n, None if n % 11 == 3 else R.uniform(-1, 1)) for n, t in enumerate(TIMES)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "k long, t long, n long, q double").repartition(5)


def by_key():
    return [[r for r in ROWS if r[0] == k] for k in (1, None)]


@pytest.mark.parametrize("beta", [0.0, 0.01, 0.8, 0.99])
@pytest.mark.parametrize("width", [40, 10**6])
def test_smoothing_of_any_memory(spark, rows, beta, width):
    got = {r.n: r.tau for r in running.with_smoothed(rows, "k", ["t", "n"], "q", "tau", width, beta=beta).collect()}
    assert len(got) == len(ROWS)
    for own in by_key():
        tau = 0.5
        for _, _, n, q in own:
            tau = tau if q is None else beta * tau + (1 - beta) * q
            assert got[n] == pytest.approx(tau, abs=1e-12)


def test_smoothing_over_a_thousand_rows(spark):
    df = spark.range(1000).selectExpr("1 AS k", "id AS t", "CASE WHEN id < 900 THEN 0.3 ELSE 0.9 END AS q")
    tau = 0.5
    for i in range(1000):
        tau = 0.99 * tau + 0.01 * (0.3 if i < 900 else 0.9)
    assert running.with_smoothed(df, "k", ["t"], "q", "tau", 10**9, beta=0.99).where("t = 999").first().tau == pytest.approx(tau, abs=1e-12)


@pytest.mark.parametrize("beta", [0.2, 0.8])
def test_smoothing_over_a_long_gap(spark, beta):
    """Many buckets of nulls alone, at the start, in the middle and at the end."""
    values = [None] * 150 + [1.0] * 5 + [None] * 400 + [0.25] + [None] * 200
    df = spark.createDataFrame([(1, t, q) for t, q in enumerate(values)], "k long, t long, q double")
    got = {r.t: r.tau for r in running.with_smoothed(df, "k", ["t"], "q", "tau", 1, beta=beta).collect()}
    tau = 0.5
    for t, q in enumerate(values):
        tau = tau if q is None else beta * tau + (1 - beta) * q
        assert got[t] == pytest.approx(tau, abs=1e-12)


def test_sums_maxima_and_last_values(spark, rows):
    for width in (40, 10**6):
        sums = running.with_sum(rows, "k", ["t", "n"], F.when(F.col("q") > 0, 1).otherwise(0), "s", width)
        sums = running.with_maximum(sums, "k", ["t", "n"], "q", "m", width, own=False)
        got = {r.n: (r.s, r.m, r.l, r.i) for r in running.with_number(running.with_last(sums, "k", ["t", "n"], "q", "l", width), "k", ["t", "n"], "i", width).collect()}
        for own in by_key():
            total, most, last = 0, None, None
            for i, (_, _, n, q) in enumerate(own):
                total += q is not None and q > 0
                last = last if q is None else q
                assert got[n] == (total, most, last, i)
                most = q if most is None else most if q is None else max(most, q)


def test_rolling_quantiles(spark, rows):
    got = {r.n: r.x for r in running.with_rolling_quantile(rows, "k", ["t", "n"], "q", 0.8, 50, "x", 40, block=64).collect()}
    for own in by_key():
        for i, (_, _, n, _) in enumerate(own):
            values = [q for *_, q in own[max(0, i - 49) : i + 1] if q is not None]
            assert got[n] == (pytest.approx(np.quantile(values, 0.8)) if values else None) or (not values and math.isnan(got[n]))


def test_softmax(spark):
    df = spark.createDataFrame([(1, 800.0), (1, 801.0), (None, -5.0)], "k long, v double")
    got = {(r.k, r.v): r.s for r in running.softmax_share(df, "k", "v", "s").collect()}
    assert got[1, 801.0] == pytest.approx(math.e / (1 + math.e)) and got[None, -5.0] == pytest.approx(1)


def test_an_object_with_all_rows_is_many_tasks(spark, rows):
    spread = running.in_buckets(rows.where("k = 1"), "t", 40).repartition(16, "k", "_bucket").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 8 and max(r["count"] for r in spread) < 400


def test_nearest_without_tolerance_over_buckets(spark):
    truth = [(1, t, n) for n, t in enumerate(sorted(R.sample(range(0, 2000, 5), 60)) + [9000, 9000])]
    seen = [(1, t) for t in R.choices(range(-50, 9500), k=300)] + [(2, 5), (None, 3), (1, None)]
    a, b = spark.createDataFrame(seen, "k long, t long"), spark.createDataFrame(truth, "k long, t long, v long")
    for width in (100, 10**6):
        got = sorted((r.k, r.t, r.t_t, r.dt) for r in asof.nearest(a, b, "k", "t", ["v"], None, width=width).collect())
        assert got == sorted((k, t, *min((abs(t - u), u) for _, u, _ in truth)[::-1]) for k, t in seen if k == 1 and t is not None)
    some = spark.createDataFrame([(1, 3.0 * n) for n in range(200)], "k long, t double")
    line = spark.createDataFrame([(1, 50.0, 1.0), (1, 150.0, 3.0), (1, 400.0, 0.0)], "k long, t double, v double")
    got = {r.t: r.v for r in asof.interpolated(some, line, "k", "t", ["v"], width=30).collect()}
    assert all(v == pytest.approx(np.interp(t, [50, 150, 400], [1, 3, 0])) for t, v in got.items()) and len(got) == 200


def test_intervals_over_buckets(spark):
    spans = [(1, s, s + R.randint(0, 30)) for s in R.sample(range(2000), 80)] + [(1, 100, 900)]
    own = spark.createDataFrame(spans, "k long, start long, end long")
    points = spark.createDataFrame([(1, t) for t in range(-10, 2100, 3)], "k long, t long")
    joined = []
    for _, s, e in sorted(spans):
        if joined and s <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], e)
        else:
            joined.append([s, e])
    assert sorted([r.start, r.end] for r in intervals.merged(own, "k", width=50).collect()) == joined
    assert sorted(r.t for r in intervals.stabbed(points, own, "k", "t", width=50).collect()) == [t for t in range(-10, 2100, 3) if any(s <= t <= e for _, s, e in spans)]


def test_nearest_distances_by_growing_cells(spark):
    rng = np.random.default_rng(2)
    a = np.concatenate([rng.normal(size=(300, 2)), rng.normal(size=(5, 2)) * 1000])
    b = np.concatenate([rng.normal(size=(200, 2)) * 0.01, [[5.0, 5.0], [5.0, 5.0]]])
    points = spark.createDataFrame([(k, i, float(x), float(y)) for k in (1, 2, 3) for i, (x, y) in enumerate(a)] + [(1, 999, None, 1.0)], "k long, i long, x double, y double")
    others = spark.createDataFrame([(1, float(u), float(v)) for u, v in b] + [(2, 7.0, 7.0), (1, None, 0.0)], "k long, u double, v double")
    got = {(r.k, r.i): r.d for r in metrics.nearest_distances(points, others, ["k"], "i").collect()}
    assert len(got) == 2 * len(a)
    for i, p in enumerate(a):
        assert got[1, i] == pytest.approx(np.sqrt(((b - p) ** 2).sum(1)).min()) and got[2, i] == pytest.approx(np.hypot(*(p - 7)))


def test_bands_of_path_distances():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(40, 2)).cumsum(0), rng.normal(size=(37, 2)).cumsum(0)

    def plain(join, band):
        d = np.full((41, 38), np.inf)
        d[0, 0] = 0
        for i in range(1, 41):
            for j in range(1, 38):
                if band is None or abs(i - j) <= band:
                    d[i, j] = join(np.hypot(*(a[i - 1] - b[j - 1])), min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1]))
        return d[40, 37]

    for band in (None, 39, 5, 3):
        assert paths.dtw(a, b, band) == pytest.approx(plain(lambda x, y: x + y, band) / 40)
        assert paths.frechet(a, b, band) == pytest.approx(plain(max, band))
    assert paths.dtw(a, b, 1) == np.inf
