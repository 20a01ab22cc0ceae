"""Scans, casts, geodesy, quality metrics and confidence."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import confidence, geo, scalar
from ..sources.tables import OBS_SQL, obs, sensed, table
from .base import Plans, r6

plans = Plans()
_PHI = "CASE WHEN {x} IS NULL THEN NULL ELSE greatest(0e0, least(1e0, {e})) END"


def _pos(x, low, high):
    return _PHI.format(x=x, e=f"({x} - {low}e0) / {high - low}e0")


def _neg(x, low, high):
    return _PHI.format(x=x, e=f"({high}e0 - {x}) / {high - low}e0")


@plans(f"WITH {OBS_SQL} SELECT event_id, uav_id, us, modality, lat, lon, alt FROM obs WHERE modality = 'gps' AND lat IS NOT NULL AND lon IS NOT NULL AND alt IS NOT NULL")
def scan_project_filter(spark, sf_dir):
    rows = obs(spark, sf_dir, ("click",))
    return rows.where(scalar.finite(F.col("lat")) & scalar.finite(F.col("lon")) & scalar.finite(F.col("alt"))).select("event_id", "uav_id", "us", "modality", "lat", "lon", "alt")


@plans("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1e0) AS k, coalesce(TRY_CAST(event_type AS DOUBLE), 0e0) AS garbage,
          coalesce(TRY_CAST(json_extract_string(props, '$.absent') AS DOUBLE), 99e0) AS absent, CAST(floor(value) AS BIGINT) AS whole FROM events""")
def quality_cast(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    at = lambda path: F.get_json_object("props", path)
    return e.select("event_id", scalar.number(at("$.k"), -1.0).alias("k"), scalar.number(F.col("event_type"), 0.0).alias("garbage"), scalar.number(at("$.absent"), 99.0).alias("absent"), F.floor("value").cast("long").alias("whole"))


@plans(f"""WITH {OBS_SQL} SELECT event_id, round({_pos('q1', 4, 20)}, 6) + 0 AS phi_up, round({_neg('q2', 5, 80)}, 6) + 0 AS phi_down,
           CASE modality WHEN 'gps' THEN 1e0 WHEN 'radar' THEN 0.6e0 ELSE 0e0 END AS phi_kind FROM obs""")
def phi_metrics(spark, sf_dir):
    return obs(spark, sf_dir).select("event_id", r6(scalar.phi_pos(F.col("q1"), 4, 20)).alias("phi_up"), r6(scalar.phi_neg(F.col("q2"), 5, 80)).alias("phi_down"), scalar.phi_cat(F.col("modality"), {"gps": 1.0, "radar": 0.6}).alias("phi_kind"))


def quality():
    """Each modality's quality metrics, from q1, q2 and the event's number."""
    q1, q2 = F.col("q1"), F.col("q2")
    kind = F.when(F.col("event_id") % 3 == 0, "FIX").when(F.col("event_id") % 3 == 1, "FLOAT").otherwise("NONE")
    return {
        "gps": {"Nsat": q1 / 5.0, "DOP": q2 / 12.0, "RTK": kind},
        "radar": {"E": q1 / 100.0, "Ptrk": q2 / 100.0},
        "fiveg": {"SNR": q1 / 3.0, "RSSI": q2 * 0.6 - 110.0, "d": q1 * 3.0, "ploss": q2 / 200.0},
        "tdoa": {"e": q1 / 2.0, "eps_sync": q2 * 2.0},
    }


_QUALITY_SQL = f"""quality AS (
  SELECT *, CASE modality
      WHEN 'gps' THEN 0.6e0 * {_pos('(q1 / 5e0)', 4, 20)} + 0.4e0 * (CASE WHEN q2 IS NULL THEN 0e0 ELSE greatest(0e0, least(1e0, (8e0 - q2 / 12e0) / 7.5e0)) END)
      WHEN 'radar' THEN {_pos('(q1 / 100e0)', 0, 1)}
      WHEN 'fiveg' THEN 0.55e0 * {_pos('(q1 / 3e0)', 0, 30)} + 0.45e0 * {_pos('(q2 * 0.6e0 - 110e0)', -110, -50)}
      WHEN 'tdoa' THEN {_neg('(q1 / 2e0)', 0, 50)} END AS rt_m,
    CASE modality
      WHEN 'gps' THEN CASE event_id % 3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.6e0 ELSE 0.2e0 END
      WHEN 'radar' THEN {_pos('(q2 / 100e0)', 0, 1)}
      WHEN 'fiveg' THEN 0.45e0 * {_neg('(q1 * 3e0)', 5, 300)} + 0.55e0 * greatest(0e0, least(1e0, (0.5e0 - q2 / 200e0) / 0.5e0))
      WHEN 'tdoa' THEN {_neg('(q2 * 2e0)', 0, 200)} END AS st_m,
    CASE modality WHEN 'gps' THEN 0.7e0 WHEN 'radar' THEN 0.65e0 WHEN 'fiveg' THEN 0.6e0 WHEN 'tdoa' THEN 0.62e0 END AS alpha
  FROM obs WHERE modality <> 'truth'),
conf AS (SELECT *, greatest(0e0, least(1e0, alpha * rt_m + (1e0 - alpha) * st_m)) AS confidence FROM quality)"""
CONF_SQL = f"{OBS_SQL}, {_QUALITY_SQL}"


def confident(spark, sf_dir, mode: str = "linear"):
    """Observations of all sensors with rt_m, st_m and confidence."""
    metrics = quality()
    specs = {m: replace(confidence.SPECS[m], mode=mode) for m in metrics}
    return confidence.with_confidences(sensed(spark, sf_dir), specs, metrics)


@plans(f"WITH {CONF_SQL} SELECT event_id, modality, round(rt_m, 9) + 0 AS rt_m, round(st_m, 9) + 0 AS st_m, round(confidence, 9) + 0 AS confidence FROM conf")
def confidence_linear(spark, sf_dir):
    return confident(spark, sf_dir).select("event_id", "modality", *((F.round(c, 9) + 0.0).alias(c) for c in ("rt_m", "st_m", "confidence")))


@plans(f"WITH {CONF_SQL} SELECT event_id, modality, round(1e0 / (1e0 + exp(-8e0 * (alpha * rt_m + (1e0 - alpha) * st_m - 0.5e0))), 6) + 0 AS confidence FROM conf")
def confidence_sigmoid(spark, sf_dir):
    return confident(spark, sf_dir, "sigmoid").select("event_id", "modality", r6(F.col("confidence")).alias("confidence"))


_TAG = "CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END"


def tag():
    out = F.lit("E")
    for n, name in enumerate("ABCD"):
        out = F.when(F.col("event_id") % 5 == n, name).otherwise(out)
    return out


@plans(f"""WITH {CONF_SQL} SELECT modality, {_TAG} AS scenario_tag, count(*) AS n, round(avg(confidence), 6) + 0 AS mean_conf, round(stddev_pop(confidence), 6) + 0 AS std_conf
           FROM conf GROUP BY 1, 2""")
def confidence_by_tag(spark, sf_dir):
    rows = confident(spark, sf_dir).withColumn("scenario_tag", tag())
    return rows.groupBy("modality", "scenario_tag").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("confidence")).alias("mean_conf"), r6(F.stddev_pop("confidence")).alias("std_conf"))


@plans(f"""WITH {CONF_SQL} SELECT modality, CASE WHEN grouping(tag) = 1 THEN NULL ELSE tag END AS scenario_tag, count(*) AS n, round(avg(confidence), 6) + 0 AS mean_conf
           FROM (SELECT *, {_TAG} AS tag FROM conf) GROUP BY ROLLUP (modality, tag)""")
def confidence_rollup(spark, sf_dir):
    rows = confident(spark, sf_dir).withColumn("scenario_tag", tag())
    return rows.rollup("modality", "scenario_tag").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("confidence")).alias("mean_conf"))


_R = "6378137e0"
_EAST, _NORTH = f"radians(lon - 5e0) * cos(radians(45e0)) * {_R}", f"radians(lat - 45e0) * {_R}"


@plans(f"WITH {OBS_SQL} SELECT event_id, round({_EAST}, 6) + 0 AS east, round({_NORTH}, 6) + 0 AS north, round(alt - 100e0, 6) + 0 AS up FROM obs WHERE modality <> 'truth'")
def enu_projection(spark, sf_dir):
    e, n, u = geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), F.lit(45.0), F.lit(5.0), F.lit(100.0))
    return sensed(spark, sf_dir).select("event_id", r6(e).alias("east"), r6(n).alias("north"), r6(u).alias("up"))


@plans(f"WITH {OBS_SQL} SELECT event_id, round(lat, 6) + 0 AS lat, round(lon, 6) + 0 AS lon, round(alt, 6) + 0 AS alt FROM obs WHERE modality <> 'truth'")
def enu_roundtrip(spark, sf_dir):
    at = F.lit(45.0), F.lit(5.0), F.lit(100.0)
    back = geo.llh(*geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), *at), *at)
    return sensed(spark, sf_dir).select("event_id", *(r6(x).alias(n) for x, n in zip(back, ("lat", "lon", "alt"), strict=True)))


_BEARING = """fmod(degrees(atan2(sin(radians(lon - 5.001e0)) * cos(radians(lat)),
  cos(radians(45.001e0)) * sin(radians(lat)) - sin(radians(45.001e0)) * cos(radians(lat)) * cos(radians(lon - 5.001e0)))) + 360e0, 360e0)"""


@plans(f"""WITH {OBS_SQL}, b AS (SELECT *, {_BEARING} AS bearing FROM obs WHERE modality <> 'truth')
           SELECT event_id, round(bearing, 5) + 0 AS bearing, round(fmod(fmod(q1 * 3e0 - bearing + 180e0, 360e0) + 360e0, 360e0) - 180e0, 5) + 0 AS off_by FROM b""")
def bearing_angle(spark, sf_dir):
    b = geo.bearing(F.lit(45.001), F.lit(5.001), F.col("lat"), F.col("lon"))
    rows = sensed(spark, sf_dir).withColumn("bearing", b)
    return rows.select("event_id", (F.round("bearing", 5) + 0.0).alias("bearing"), (F.round(geo.angle_difference(F.col("q1") * 3.0, F.col("bearing")), 5) + 0.0).alias("off_by"))


@plans(f"""WITH {OBS_SQL} SELECT event_id,
  round(sqrt(pow(radians(lon - 5e0) * cos(radians((lat + 45e0) / 2e0)), 2) + pow(radians(lat - 45e0), 2)) * 6371000e0, 5) + 0 AS arc_m,
  round(sqrt(pow((lat - 45e0) * 111000e0, 2) + pow((lon - 5e0) * 111000e0, 2)), 5) + 0 AS flat_m,
  round(q1 / 111000e0, 9) + 0 AS dlat, round(q1 / (greatest(cos(radians(lat)), 1e-6) * 111000e0), 9) + 0 AS dlon FROM obs WHERE modality <> 'truth'""")
def geodist(spark, sf_dir):
    lat, lon, q1 = F.col("lat"), F.col("lon"), F.col("q1")
    return sensed(spark, sf_dir).select(
        "event_id",
        (F.round(geo.arc_distance(F.lit(45.0), F.lit(5.0), lat, lon), 5) + 0.0).alias("arc_m"),
        (F.round(geo.flat_distance(F.lit(45.0), F.lit(5.0), lat, lon), 5) + 0.0).alias("flat_m"),
        (F.round(geo.metres_to_lat(q1), 9) + 0.0).alias("dlat"),
        (F.round(geo.metres_to_lon(q1, lat), 9) + 0.0).alias("dlon"),
    )


@plans(f"""WITH {OBS_SQL} SELECT event_id,
  round(pow((greatest(0e0, least(1e0, q1 / 5e0 / 30e0)) + 1e-6) * (greatest(0e0, least(1e0, (q2 - 90e0 + 90e0) / 50e0)) + 1e-6)
    * (greatest(0e0, least(1e0, 1e0 - q1 / 150e0)) + 1e-6) * (greatest(0e0, least(1e0, q2 / 100e0)) + 1e-6), 0.25e0), 6) + 0 AS comm,
  round(exp(-(q1 * q1) / (2e0 * 120e0 * 120e0)) * exp(-(q2 * q2) / (2e0 * 20e0 * 20e0)), 6) + 0 AS edge,
  round(exp(-(q1 * q1) / (2e0 * 120e0 * 120e0)) * exp(-(q2 * q2 / 100e0) / (2e0 * 20e0 * 20e0)) * 0.8e0 * greatest(0e0, least(1e0, q2 / 100e0)), 6) + 0 AS node
  FROM obs""")
def comm_and_kernels(spark, sf_dir):
    q1, q2 = F.col("q1"), F.col("q2")
    return obs(spark, sf_dir).select(
        "event_id",
        r6(scalar.comm_quality(q1 / 5.0, q2 - 90.0, q1, q2 / 100.0)).alias("comm"),
        r6(scalar.edge_kernel(q1, q2)).alias("edge"),
        r6(scalar.node_kernel(q1, q2 / 10.0, F.lit(0.8), scalar.clip(q2 / 100.0))).alias("node"),
    )


@plans(f"""WITH {OBS_SQL}, s AS (SELECT event_id, greatest(20e0, least(120e0, 40e0 + 1.35e0 * (q1 / 3e0) - 8e0 * (q2 / 100e0) - 7e0 * 0.2e0)) AS spl FROM obs)
  SELECT event_id, round(spl, 6) + 0 AS spl, round(greatest(0e0, least(1e0, pow(10e0, spl / 20e0) / 1e5)), 6) + 0 AS energy, round(greatest(0e0, least(1e0, (spl - 35e0) / 75e0)), 6) + 0 AS spl_norm FROM s""")
def sound_level(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumn("spl", scalar.sound_level(F.col("q1") / 3.0, F.col("q2") / 100.0, F.lit(0.2)))
    return rows.select("event_id", r6(F.col("spl")).alias("spl"), r6(scalar.sound_energy(F.col("spl"))).alias("energy"), r6(scalar.spl_norm(F.col("spl"))).alias("spl_norm"))


@plans(f"""WITH {OBS_SQL} SELECT event_id, round(greatest(0.01e0, least(0.999e0, CASE event_id % 5 WHEN 0 THEN 0.98e0 WHEN 1 THEN 0.9e0 WHEN 2 THEN 0.62e0 WHEN 3 THEN 0.78e0 ELSE 0.45e0 END
  - 0.22e0 * 0.5e0 + 0.12e0 * (q1 / 3e0 - 10e0) / 20e0 - 0.18e0 * (q2 / 100e0))), 6) + 0 AS p_detect FROM obs""")
def acoustic_detect(spark, sf_dir):
    base = F.lit(0.45)
    for n, p in enumerate((0.98, 0.90, 0.62, 0.78)):
        base = F.when(F.col("event_id") % 5 == n, p).otherwise(base)
    return obs(spark, sf_dir).select("event_id", r6(scalar.acoustic_detection(base, 0.5, F.col("q1") / 3.0, F.col("q2") / 100.0)).alias("p_detect"))


@plans(f"""WITH {OBS_SQL} SELECT event_id, CASE WHEN modality = 'tdoa' THEN 1e0 WHEN modality = 'radar' THEN 0e0
  ELSE round(greatest(0e0, least(1e0, q2 / 500e0 * 2.6e0 * 1.4e0 * (CASE modality WHEN 'gps' THEN 2.2e0 ELSE 1e0 END) + 0.08e0 + (CASE modality WHEN 'gps' THEN 0.16e0 ELSE 0e0 END))), 6) + 0 END AS p_missing
  FROM obs WHERE modality <> 'truth'""")
def missing_control(spark, sf_dir):
    gps = F.col("modality") == "gps"
    rate = scalar.missing_rate(F.col("q2") / 500.0, 2.6, 1.4, F.when(gps, 2.2).otherwise(1.0), 0.08, F.when(gps, 0.16).otherwise(0.0))
    p = F.when(F.col("modality") == "tdoa", 1.0).when(F.col("modality") == "radar", 0.0).otherwise(r6(rate))
    return sensed(spark, sf_dir).select("event_id", p.alias("p_missing"))


@plans(f"""WITH {OBS_SQL} SELECT event_id, ('0x' || substr(md5('20260209|' || modality || '|' || uav_id), 1, 8))::BIGINT AS seed FROM obs""")
def stable_hash(spark, sf_dir):
    return obs(spark, sf_dir).select("event_id", scalar.stable_u32(F.lit("20260209"), F.col("modality"), F.col("uav_id").cast("string")).alias("seed"))


@plans(f"""WITH {OBS_SQL}, p AS (SELECT *, CASE modality WHEN 'radar' THEN 1.22e0 WHEN 'fiveg' THEN 1.36e0 WHEN 'tdoa' THEN 1.72e0 ELSE 1e0 END AS scale FROM obs WHERE modality <> 'truth')
  SELECT event_id, round((0.8e0 + 0.9e0 * (20e0 - q1 / 5e0)) * scale, 6) + 0 AS sigma_pos, round((0.1e0 + q2 / 500e0) * scale, 6) + 0 AS sigma_vel FROM p""")
def error_scale(spark, sf_dir):
    scale = F.lit(1.0)
    for name, s in (("radar", 1.22), ("fiveg", 1.36), ("tdoa", 1.72)):
        scale = F.when(F.col("modality") == name, s).otherwise(scale)
    return sensed(spark, sf_dir).select("event_id", r6((0.8 + 0.9 * (20.0 - F.col("q1") / 5.0)) * scale).alias("sigma_pos"), r6((0.1 + F.col("q2") / 500.0) * scale).alias("sigma_vel"))


_CONTROL = {"force_missing_modalities": ["radar"], "force_available_modalities": ["radar", "tdoa"], "global_scale": 1.3, "global_bias": 0.01, "scenario_scale": {"B": 1.7, "E": 0.4}, "modality_scale": {"gps": 2.2}, "modality_bias": {"gps": 0.16}}


@plans(f"""WITH {OBS_SQL}, r AS (SELECT event_id, modality, {_TAG} AS tag, q2 / 200e0 AS rate FROM obs WHERE modality <> 'truth')
  SELECT event_id, CASE modality WHEN 'radar' THEN 1e0 WHEN 'tdoa' THEN 0e0 ELSE round(greatest(0e0, least(1e0, rate * 1.3e0 * (CASE tag WHEN 'B' THEN 1.7e0 WHEN 'E' THEN 0.4e0 ELSE 1e0 END) * (CASE modality WHEN 'gps' THEN 2.2e0 ELSE 1e0 END) + 0.01e0 + (CASE modality WHEN 'gps' THEN 0.16e0 ELSE 0e0 END))), 6) + 0 END AS p_missing,
    modality = 'radar' AS forced_missing, modality = 'tdoa' AS forced_available FROM r""")
def missing_settings(spark, sf_dir):
    """Missing rates under a run's settings: forced missing, forced available, scaled."""
    made = scalar.missing_control(F.col("modality"), tag(), F.col("q2") / 200.0, _CONTROL)
    return sensed(spark, sf_dir).select("event_id", r6(made["p_missing"]).alias("p_missing"), made["forced_missing"].alias("forced_missing"), made["forced_available"].alias("forced_available"))
