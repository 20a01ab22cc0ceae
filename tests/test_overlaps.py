"""Lookups where thousands of zones or events hold every point."""

from skyweave.operators import lookups


def met(df, monkeypatch, call):
    """The rows that are left to be met, and the result."""
    seen, own = [], lookups._decisive

    def kept(*parts):
        seen.append(own(*parts))
        return seen[-1]

    monkeypatch.setattr(lookups, "_decisive", kept)
    return call(df), seen[0].count()


def test_zones_below_one_that_covers_their_edge_are_left_out(spark, monkeypatch):
    zones = spark.range(3_000).selectExpr("45 + (id % 50) / 200 AS lat", "5 + floor(id / 50) / 200 AS lon", "3000D AS radius", "(id % 13) / 13 AS strength")
    points = spark.range(500).selectExpr("id", "45 + 0.05 + (id % 25) / 200 AS lat", "5.1 + floor(id / 25) / 200 AS lon")
    out, left = met(points, monkeypatch, lambda p: lookups.with_zone(p, zones, "id"))
    assert left < 40_000 and {r.zone for r in out.collect()} == {12 / 13}


def test_events_that_end_together_are_a_few_buckets(spark, monkeypatch):
    events = spark.range(5_000).selectExpr("id * 100D AS start", "500000D AS `end`", "array('a') AS sensors", "(id * 7 % 100) / 100 AS level")
    points = spark.range(1_000).selectExpr("id", "id * 499D AS t", "'a' AS who")
    out, left = met(points, monkeypatch, lambda p: lookups.with_event(p, events, "id", "t", "who"))
    assert left < 300
    for r in out.collect():
        assert r.event == max(i * 7 % 100 / 100 for i in range(5_000) if i * 100 <= r.t)


def test_rows_of_one_id_and_nan_times(spark):
    events = spark.createDataFrame([(-1e6, 1e6, ["a"], 0.5)], "start double, end double, sensors array<string>, level double")
    points = spark.createDataFrame([(1, 0.0, "a"), (1, 2e6, "a"), (2, float("nan"), "a")], "id long, t double, who string")
    assert sorted((r.id, r.event) for r in lookups.with_event(points, events, "id", "t", "who").collect()) == [(1, 0.5), (1, 0.5), (2, 0.0)]
