"""Values that can be computed by hand."""

import math

import pytest
from pyspark.sql import functions as F

from skyweave.functions import alerts, confidence, geo, scalar
from skyweave.operators import running, asof, intervals, matching, metrics, numbering, paths, windows
from skyweave.plans.scalars import confidence as spec_module


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


QUALITY = [
    ("gps", {"Nsat": 15.0, "DOP": 1.4, "RTK": "FIX"}, 0.83515), ("radar", {"E": 0.85, "Ptrk": 0.91}, 0.871), ("fiveg", {"SNR": 16.0, "RSSI": -68.0, "d": 66.0, "ploss": 0.10}, 0.6837796610169493),
    ("tdoa", {"e": 9.0, "eps_sync": 32.0}, 0.8276), ("acoustic", {"SNRa": 10.0, "n": 0.25}, 0.5083333333333333),
]


def scored(spark, spec, values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return confidence.with_confidence(row, spec).first()


@pytest.mark.parametrize(("name", "values", "want"), QUALITY)
def test_confidence(spark, name, values, want):
    row = scored(spark, confidence.SPECS[name], values)
    assert row.confidence == pytest.approx(want, abs=1e-12)
    assert not set(values) & set(row.asDict())


def test_confidence_modes_and_absent_sensors(spark):
    gps = confidence.SPECS["gps"]
    assert scored(spark, confidence.Spec(gps.metrics, gps.alpha, "sigmoid"), QUALITY[0][1]).confidence == pytest.approx(0.9359081421682726)
    for name, values in confidence.ABSENT.items():
        assert scored(spark, confidence.SPECS[name], values).confidence == pytest.approx(0.06 if name == "gps" else 0.0, abs=1e-12)
    with pytest.raises(ValueError, match="no column"):
        scored(spark, gps, {"Nsat": 1.0})
    with pytest.raises(ValueError, match="op"):
        spec_module.Metric("x", "odd", "rt", 1.0)


def test_null_metric_counts_as_zero(spark):
    got = one(spark, scalar.phi_pos(F.lit(None).cast("double"), 0, 1), scalar.weighted_mean([(F.lit(None).cast("double"), 1.0), (F.lit(1.0), 1.0)]))
    assert got == (None, 0.5)


def test_geodesy(spark):
    lat0, lon0, alt0 = F.lit(45.2782), F.lit(5.3185), F.lit(133.6)
    e, n, u = one(spark, *geo.enu(F.lit(45.27821), F.lit(5.31849), F.lit(133.1), lat0, lon0, alt0))
    assert (e, n, u) == (pytest.approx(-0.7833164, abs=1e-6), pytest.approx(1.1131949, abs=1e-6), pytest.approx(-0.5))
    assert one(spark, *geo.llh(F.lit(e), F.lit(n), F.lit(u), lat0, lon0, alt0)) == pytest.approx((45.27821, 5.31849, 133.1), abs=1e-9)
    d, b1, b2, a = one(spark, geo.arc_distance(F.lit(45.0), F.lit(5.0), F.lit(45.02), F.lit(5.01)), geo.bearing(F.lit(45.0), F.lit(5.0), F.lit(45.0), F.lit(5.1)), geo.bearing(F.lit(45.0), F.lit(5.0), F.lit(46.0), F.lit(5.0)), geo.angle_difference(F.lit(10.0), F.lit(350.0)))
    assert (d, b1, b2, a) == (pytest.approx(2358.75486, abs=1e-4), pytest.approx(89.964645, abs=1e-5), pytest.approx(0.0), pytest.approx(20.0))


def test_kernels_and_weights(spark):
    got = one(spark, scalar.comm_quality(F.lit(20.0), F.lit(-60.0), F.lit(30.0), F.lit(0.9)), scalar.node_kernel(F.lit(60.0), F.lit(5.0), F.lit(0.8), F.lit(0.7)), scalar.spl_norm(F.lit(53.4)), scalar.sound_energy(F.lit(60.0)), scalar.missing_rate(F.lit(0.002), 2.6, 1.4, 2.2, 0.08, 0.16), scalar.window_quality(F.lit(4), F.lit(0.5), F.lit(0.75), F.lit(1.0)))
    assert got == pytest.approx((0.7325693, 0.4789934, 0.2453333, 0.01, 0.256016, 0.9153678126968944), abs=1e-6)
    assert one(spark, scalar.stable_u32(F.lit("20260209"), F.lit("batch01"), F.lit("gps"), F.lit("UAV00001")))[0] == 1737350455
    taper = [one(spark, scalar.edge_taper(F.lit(i), n))[0] for n in (1, 2, 3) for i in range(n)]
    assert taper == [1.0, 0.25, 0.25, 0.25, 1.0, 0.25]
    assert one(spark, scalar.edge_taper(F.lit(1), 20), scalar.edge_taper(F.lit(9), 20)) == pytest.approx((0.3289474, 0.9605263), abs=1e-6)


def test_nearest_with_ties_duplicates_and_tolerance(spark):
    truth = spark.createDataFrame([(1, 0, "a"), (1, 1000, "b"), (1, 2000, "c"), (1, None, "x"), (2, 0, "z")], "k long, t long, v string")
    seen = spark.createDataFrame([(i, 1, t) for i, t in enumerate((-300, 500, 560, 1000, 2600, 3000))] + [(6, 1, None), (7, 3, 0)], "n long, k long, t long")
    near = lambda tol: {r.n: (r.t_t, r.dt) for r in asof.nearest(seen, truth, "k", "t", ["v"], tol).collect()}
    assert near(None) == {0: (0, 300), 1: (0, 500), 2: (1000, 440), 3: (1000, 0), 4: (2000, 600), 5: (2000, 1000)}
    assert set(near(550)) == {0, 1, 2, 3}
    assert asof.nearest(seen.limit(0), truth, "k", "t", ["v"], 5).count() == 0


TRACK = [(1, t, float(t), 0.0, 0.0, float(x), float(y), 0.0) for t, (x, y) in enumerate(((0, 1), (1, 1), (2, 2), (3, 1)))]


def test_track_metrics(spark):
    track = spark.createDataFrame(TRACK, "uav_id long, t_idx long, gx double, gy double, gz double, px double, py double, pz double")
    row = metrics.error_stats(track.withColumn("d", metrics.distance3(track)), ["uav_id"], "d").first()
    assert tuple(row[c] for c in ("rmse", "mae", "medae", "p90", "p95", "max_err")) == pytest.approx((1.3228757, 1.25, 1.0, 1.7, 1.85, 2.0), abs=1e-6)
    rpe = metrics.with_relative_error(track, 1).agg(F.sqrt(F.avg(F.col("rpe") * F.col("rpe")))).first()[0]
    assert rpe == pytest.approx(0.8164966, abs=1e-6)
    ac = metrics.along_cross(track).agg(F.max(F.abs("along")), F.sqrt(F.avg(F.col("across") * F.col("across"))), F.avg("across")).first()
    assert tuple(ac) == pytest.approx((0.0, 1.3228757, 1.25), abs=1e-6)
    assert metrics.with_jerk(track, ("px", "py", "pz"), "j").agg(F.avg("j")).first()[0] == pytest.approx(3.0)
    row = paths.path_distances(track).first()
    assert (row.dtw, row.frechet) == pytest.approx((1.25, 2.0))
    assert metrics.hausdorff(track).first().hausdorff == pytest.approx(2.0)


def test_windows_leave_a_short_tail_uncovered(spark):
    rows = spark.range(61).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.lit(61).alias("length"))
    dealt = windows.dealt(rows, "t", F.col("length"), 20, 8)
    assert sorted(r.start for r in dealt.select("start").distinct().collect()) == [0, 8, 16, 24, 32, 40]
    assert dealt.where("t = 60").count() == 0
    short = rows.where("t < 19").withColumn("length", F.lit(19))
    assert windows.dealt(short, "t", F.col("length"), 20, 8).count() == 0


def test_blend_of_head_and_tail(spark):
    step = lambda x: windows.blended(x, F.lit(0.0), F.lit(1), F.lit(1.0))
    assert one(spark, step(step(F.lit(9.0))), windows.blended(F.lit(9.0), F.lit(0.0), F.lit(1), F.lit(0.0)), windows.blended(F.lit(9.0), F.lit(0.0), F.lit(3), F.lit(1.0))) == pytest.approx((1.0, 9.0, 9.0))


def test_greedy_takes_the_best_pairs(spark):
    rows = [(1, 1, 10, 0.9), (1, 1, 11, 0.8), (1, 2, 10, 0.85), (1, 2, 11, 0.1), (1, 3, 11, 0.05), (2, 1, 10, 0.0)]
    pairs = spark.createDataFrame(rows, "frame long, det long, rep long, score double")
    assert sorted((r.det, r.rep) for r in matching.greedy(pairs).collect()) == [(1, 10), (2, 11)]
    assert matching.greedy(pairs.limit(0)).count() == 0


def test_greedy_in_rounds_is_greedy_in_order(spark):
    chain = [(1, n, n, 1.0 - n / 10_000) for n in range(2000)] + [(1, n + 1, n, 1.0 - (n + 0.5) / 10_000) for n in range(2000)]
    ties = [(2, d, r, ((d * 7 + r * 3) % 5) / 5) for d in range(12) for r in range(12)]
    pairs = spark.createDataFrame(chain + ties, "frame long, det long, rep long, score double")

    def plain(frame):
        dets, reps, out = set(), set(), []
        for score, det, rep in sorted(((s, d, r) for f, d, r, s in chain + ties if f == frame and s > 0), reverse=True):
            if det not in dets and rep not in reps:
                out.append((frame, det, rep))
                dets.add(det)
                reps.add(rep)
        return out

    want = sorted(plain(1) + plain(2))
    assert sorted((r.frame, r.det, r.rep) for r in matching.greedy(pairs).collect()) == want
    few = pairs.where("frame = 2 OR det < 6")
    assert sorted((r.frame, r.det, r.rep) for r in matching.greedy(few, small=3).collect()) == sorted((r.frame, r.det, r.rep) for r in matching.greedy(few).collect())


def test_smoothing(spark):
    rows = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.7)] + [(2, i, (i * 7 % 10) / 10) for i in range(500)], "k long, t long, q double")
    for width in (1, 64, 10_000):
        got = {(r.k, r.t): r.tau for r in running.with_smoothed(rows, "k", ["t"], "q", "tau", width).collect()}
        assert got[1, 1] == pytest.approx(0.604)
        tau = 0.5
        for i in range(500):
            tau = 0.8 * tau + 0.2 * (i * 7 % 10) / 10
            assert got[2, i] == pytest.approx(tau, abs=1e-12)


def test_intervals(spark):
    own = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12), (2, 1, 1)], "k long, start long, end long")
    assert sorted(tuple(r) for r in intervals.merged(own, "k").select("k", "start", "end").collect()) == [(1, 0, 8), (1, 10, 12), (2, 1, 1)]
    points = spark.createDataFrame([(1, t) for t in (-1, 0, 8, 9, 12, 13)] + [(2, 1), (3, 1)], "k long, t long")
    assert sorted(tuple(r) for r in intervals.stabbed(points, own, "k", "t").collect()) == [(1, 0), (1, 8), (1, 12), (2, 1)]


NEARBY = "array<struct<min_sep_m: long, id: string, route_intersect: long>>"
ZONES = "array<struct<zone_id: string, inside_zone: long, over_limit_alt: long>>"


def test_alert_rules(spark):
    rows = [(1, [], [], 90), (2, [(49, "a", 1)], [], 90), (3, [(50, "a", 1)], [], 90), (4, [], [("z", 0, 1)], 19), (5, [(7, "b", 0), (7, "c", 0)], None, None)]
    df = spark.createDataFrame(rows, f"n long, nearby {NEARBY}, zones {ZONES}, battery long")
    got = {r.n: r for r in df.select("n", alerts.nearest(F.col("nearby")).alias("best"), *(c.alias(k) for k, c in alerts.alerts(F.col("nearby"), F.col("zones"), F.col("battery")).items())).collect()}
    assert tuple(got[1].best) == ("NONE", 999) and tuple(got[5].best) == ("b", 7)
    assert {n: (r.A1, r.A2, r.A3, r.A4) for n, r in got.items()} == {1: (0, 0, 0, 1), 2: (0, 1, 0, 0), 3: (0, 0, 0, 1), 4: (1, 0, 1, 0), 5: (0, 0, 0, 1)}


@pytest.mark.parametrize(
    ("answer", "strict", "loose"),
    [("U1，请悬停\n理由: 好", "ok", "ok"), ("\n U1，请返航 \r\n\n 理由:" + "x" * 51, "reason_too_long", "ok"), ("U1，请返航\n理由:" + "x" * 50, "ok", "ok"), (None, "empty", "empty"), ("", "not_two_lines", "not_two_lines"), ("U2，请悬停\n理由:", "uav_id_mismatch", "uav_id_mismatch"), ("U1，请飞\n理由:", "bad_first_line", "bad_first_line"), ("U1，请悬停\n因为", "bad_reason_prefix", "bad_reason_prefix")],
)
def test_answers(spark, answer, strict, loose):
    assert one(spark, alerts.check_answer(F.lit("U1"), F.lit(answer).cast("string")), alerts.check_answer(F.lit("U1"), F.lit(answer).cast("string"), True)) == (strict, loose)


def test_numbers_and_batches(spark):
    ids = spark.createDataFrame([(i * i - 50,) for i in range(40)] * 2, "id long")
    want = {v: n for n, v in enumerate(sorted({i * i - 50 for i in range(40)}))}
    assert {r.id: r.number for r in numbering.numbered(ids, "id").collect()} == want
    assert [one(spark, numbering.batch_label(F.lit(n), 10))[0] for n in (0, 9, 10, 999, 1000)] == ["batch01", "batch01", "batch02", "batch100", "batch101"]
    with pytest.raises(ValueError, match="one row"):
        numbering.batch_label(F.lit(1), 0)


def test_clip_keeps_null(spark):
    assert one(spark, scalar.clip(F.lit(None).cast("double")), scalar.number(F.lit(" 1.5 ")), scalar.number(F.lit("nan"), 7.0), scalar.number(F.lit("x"), 7.0)) == (None, 1.5, 7.0, 7.0)
    assert math.isclose(one(spark, scalar.clip(F.lit(2.0)))[0], 1.0)
