import math
import random

import pytest
from pyspark.sql import functions as F

from skyweave.operators import lookups, moments, quantiles
from skyweave.sources.shared import scratch_path

R = random.Random(7)


def arc(a, b, c, d):
    x = math.radians(d - b) * math.cos(math.radians((a + c) / 2))
    return math.hypot(x, math.radians(c - a)) * 6371000.0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("middle", [0.0, 45.0, -84.0])
def test_zones_of_many_sizes_against_all_pairs(spark, middle):
    place = lambda: (middle + R.uniform(-0.2, 0.2), R.uniform(-0.2, 0.2))
    zones = [(*place(), 2 ** R.uniform(0, 15), R.random()) for _ in range(150)] + [(middle, 0.0, 500.0, None), (middle, None, 500.0, 1.0), (middle, 0.0, -1.0, 1.0), (middle, 0.1, 0.0, 0.9)]
    points = [(i, *place(), "x") for i in range(300)] + [(300, None, 1.0, "x"), (301, middle, 0.1, "x"), (302, zones[0][0], zones[0][1], "x")]
    out = lookups.with_zone(spark.createDataFrame(points, "id long, lat double, lon double, radius string"), spark.createDataFrame(zones, "lat double, lon double, radius double, strength double"), "id")
    assert set(out.columns) == {"id", "lat", "lon", "radius", "zone"}
    got = {r.id: r.zone for r in out.collect()}
    for i, lat, lon, _ in points:
        near = [s for a, b, r, s in zones if None not in (a, b, s, lat) and r >= 0 and arc(lat, lon, a, b) <= r]
        assert got[i] == max(near, default=0.0), i


def test_ten_thousand_zones_meet_by_cells(spark):
    zones = spark.range(10_000).selectExpr("45 + (id % 100) / 500 AS lat", "5 + floor(id / 100) / 500 AS lon", "60D AS radius", "id / 10000 AS strength")
    points = spark.range(2_000).selectExpr("id", "45 + (id % 50) / 250 AS lat", "5 + floor(id / 50) / 250 AS lon")
    out = lookups.with_zone(points, zones, "id")
    assert "NestedLoop" not in plan(out) and "Cartesian" not in plan(out)
    assert out.where("zone > 0").count() > 1_900


def test_no_zones_and_no_points(spark):
    points, zones = spark.range(3).selectExpr("id", "1D AS lat", "2D AS lon"), spark.createDataFrame([], "lat double, lon double, radius double, strength double")
    assert {r.zone for r in lookups.with_zone(points, zones, "id").collect()} == {0.0}
    assert lookups.with_zone(points.limit(0), zones, "id").count() == 0


def test_events_against_all_pairs_one_of_them_without_end(spark):
    names = ["a", "b", None]
    events = [(s := R.uniform(-1e5, 1e5), s + 2 ** R.uniform(-3, 14), R.sample(names, R.randint(0, 3)), R.random()) for _ in range(200)]
    events += [(-1e9, 1e9, ["a"], 0.05), (5.0, 4.0, ["a"], 1.0), (None, 4.0, ["a"], 1.0), (0.0, 1.0, None, 1.0), (77.0, 77.0, ["b"], 0.99)]
    points = [(i, R.uniform(-1e5, 1e5), R.choice(names)) for i in range(300)] + [(300, None, "a"), (301, 77.0, "b"), (302, events[0][1], "b"), (303, 1e9, "a")]
    out = lookups.with_event(spark.createDataFrame(points, "id long, t double, who string"), spark.createDataFrame(events, "start double, end double, sensors array<string>, level double"), "id", "t", "who")
    assert "NestedLoop" not in plan(out)
    got = {r.id: r.event for r in out.collect()}
    for i, t, who in points:
        assert got[i] == max([x for s, e, own, x in events if None not in (s, t, who, own) and s <= t <= e and who in own], default=0.0), i


def test_quantiles_by_rank(spark):
    rows = [(R.choice([1, 1, 1, 2, None]), R.choice([None, float("nan"), 5.0, 5.0, R.uniform(-9, 9)])) for _ in range(2000)] + [(3, None), (4, 7.0)]
    shares = {"low": 0.0, "third": 0.3, "half": 0.5, "most": 0.95, "top": 1.0}
    out = quantiles.quantiles(spark.createDataFrame(rows, "k long, v double").repartition(6), ["k"], "v", shares)
    got = {r.k: r for r in out.collect()}
    assert set(got) == {1, 2, None, 4}
    for k, r in got.items():
        own = sorted(v for i, v in rows if i == k and v is not None and v == v)
        for name, share in shares.items():
            at = share * (len(own) - 1)
            low, high = own[math.floor(at)], own[math.ceil(at)]
            assert r[name] == pytest.approx(low + (high - low) * (at - math.floor(at)), abs=1e-12)


def test_a_group_of_all_rows_is_dealt_to_many_tasks(spark):
    rows = spark.range(50_000).selectExpr("1 AS k", "CAST(id AS DOUBLE) AS v")
    out = quantiles.quantiles(rows, ["k"], "v", {"half": 0.5})
    assert out.first().half == 24_999.5 and "percentile" not in plan(out)
    dealt = rows.groupBy("k", "v").count().repartitionByRange(8, F.struct("k"), "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 12_000


def test_moments_merge_and_do_not_cancel(spark, tmp_path):
    values = [(k, R.choice([1e8, 1e8 + 0.001, None, float("nan"), float("inf")]) if k == "far" else R.gauss(3, 2)) for k in R.choices(["far", "near", None], k=900)]
    df = spark.createDataFrame(values, "k string, v double")
    store = moments.MomentStore(spark, scratch_path(spark, "moments"), ["k"])
    parts = [values[:10], values[10:400], [], values[400:]]
    assert [store.add(f"b{n}", spark.createDataFrame(p, df.schema), F.col("v")) for n, p in enumerate(parts)] == [True] * 4
    assert not store.add("b1", df, F.col("v"))
    whole, merged = ({r.k: r for r in x.collect()} for x in (moments.moments(df, ["k"], F.col("v")), store.totals()))
    assert set(merged) == {"far", "near", None}
    for k, r in merged.items():
        own = [v for i, v in values if i == k and v is not None and math.isfinite(v)]
        mean = math.fsum(own) / len(own)
        assert r.n == whole[k].n == len(own) and r.least == min(own) and r.most == max(own)
        std = math.sqrt(math.fsum((v - mean) ** 2 for v in own) / len(own))
        assert r.mean == pytest.approx(mean, rel=1e-12) and math.sqrt(r.m2 / r.n) == pytest.approx(std, rel=1e-4)


def test_weighted_moments_do_not_cancel(spark):
    df = spark.createDataFrame([("x", 1e8, 3), ("x", 1e8 + 0.001, 3), ("x", 5.0, 0), ("x", None, 2), (None, 2.0, 1)], "k string, v double, w long")
    got = {r.k: r for r in moments.weighted(df, ["k"], "v", "w").collect()}
    assert got["x"].n == 6 and math.sqrt(got["x"].m2 / 6) == pytest.approx(0.0005, rel=1e-4) and got[None].m2 == 0
