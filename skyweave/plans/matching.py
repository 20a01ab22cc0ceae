"""Track association, gates, votes, neighbours and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import intervals, lookups, matching, running
from ..sources.shared import saved
from ..sources.tables import MICROS, OBS_SQL, TRACK_SQL, obs, sensed, table, track, truth
from .base import Plans, r6

plans = Plans()
GATE = 150.0
DAY = 86400 * MICROS
_COMM = "pow((greatest(0e0, least(1e0, q1 / 150e0)) + 1e-6) * (greatest(0e0, least(1e0, q2 / 50e0)) + 1e-6) * (greatest(0e0, least(1e0, 1e0 - q1 / 150e0)) + 1e-6) * (greatest(0e0, least(1e0, q2 / 100e0)) + 1e-6), 0.25e0)"
_SIDES = f"""f AS (SELECT *, us // (3600 * {MICROS}::BIGINT) AS frame FROM obs),
det AS (SELECT frame, uav_id, event_id AS det, lat AS d_lat, lon AS d_lon, alt AS d_alt, q1 / 10e0 AS d_vx, q2 / 10e0 AS d_vy, greatest(0e0, least(1e0, q2 / 100e0)) AS confidence FROM f WHERE modality = 'gps'),
rep AS (SELECT frame, uav_id, event_id AS rep, lat, lon, alt, q2 / 10e0 AS vx, q1 / 10e0 AS vy, {_COMM} AS quality FROM f WHERE modality = 'truth')"""
_NEAR = f"""near AS (SELECT *, sqrt(pow(radians(lon - d_lon) * cos(radians(r_lat)) * 6378137e0, 2) + pow(radians(lat - d_lat) * 6378137e0, 2) + pow(alt - d_alt, 2)) AS distance, pow(vx - d_vx, 2) + pow(vy - d_vy, 2) AS gap2
  FROM {{det}} JOIN (SELECT frame, avg(d_lat) AS r_lat FROM {{all}} GROUP BY frame) USING (frame) JOIN {{rep}} USING (frame)),
cand AS (SELECT *, round(exp(-(distance * distance) / (2e0 * 120e0 * 120e0)) * exp(-gap2 / (2e0 * 20e0 * 20e0)) * confidence * quality, 12) AS score FROM near WHERE distance <= {GATE}),
top AS (SELECT *, row_number() OVER (PARTITION BY frame, det ORDER BY round(distance, 6), rep) AS place FROM cand QUALIFY place <= 5)"""
PAIRS_SQL = f"{_SIDES}, {_NEAR.format(det='det', rep='rep', all='det')}"


def sides(rows, reports, *more):
    """Detections and reports of the observations, with what both matchers need."""
    q1, q2 = F.col("q1"), F.col("q2")
    frame, place = F.floor(F.col("us") / (3600 * MICROS)).alias("frame"), ["lat", "lon", "alt"]
    det = rows.select(*more, frame, F.col("event_id").alias("det"), F.col("uav_id").alias("id"), *place, (q1 / 10.0).alias("vx"), (q2 / 10.0).alias("vy"), scalar.clip(q2 / 100.0).alias("confidence"))
    quality = scalar.comm_quality(q1 / 5.0, q2 - 90.0, q1, q2 / 100.0)
    rep = reports.select(*more, frame, F.col("event_id").alias("rep"), F.col("uav_id").alias("id"), *place, (q2 / 10.0).alias("vx"), (q1 / 10.0).alias("vy"), quality.alias("quality"))
    return det, rep


def _candidates(spark, sf_dir):
    return matching.candidates(*sides(obs(spark, sf_dir, ("click",)), truth(spark, sf_dir)), GATE)


@plans(f"WITH {OBS_SQL}, {PAIRS_SQL} SELECT frame, det, rep, place, round(distance, 5) + 0 AS distance, round(score, 6) + 0 AS score FROM top")
def match_candidates_topk(spark, sf_dir):
    return _candidates(spark, sf_dir).select("frame", "det", "rep", "place", (F.round("distance", 5) + 0.0).alias("distance"), r6(F.col("score")).alias("score"))


@plans(f"""WITH RECURSIVE {OBS_SQL}, {PAIRS_SQL},
  ranked AS MATERIALIZED (SELECT frame, det, rep, row_number() OVER (PARTITION BY frame ORDER BY score DESC, det DESC, rep DESC) AS n FROM top WHERE score > 0),
  step(frame, n, dets, reps) AS (
    SELECT DISTINCT frame, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM ranked
    UNION ALL
    SELECT s.frame, s.n + 1, CASE WHEN list_contains(dets, r.det) OR list_contains(reps, r.rep) THEN dets ELSE list_append(dets, r.det) END,
           CASE WHEN list_contains(dets, r.det) OR list_contains(reps, r.rep) THEN reps ELSE list_append(reps, r.rep) END
    FROM step s JOIN ranked r ON r.frame = s.frame AND r.n = s.n + 1)
  SELECT frame, unnest(dets) AS det, unnest(reps) AS rep FROM (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY frame ORDER BY n DESC) = 1)""")
def match_greedy(spark, sf_dir):
    return matching.greedy(_candidates(spark, sf_dir)).select("frame", "det", "rep")


@plans(f"""WITH {OBS_SQL}, {PAIRS_SQL}, best AS (SELECT frame, det, max(score) AS best FROM top GROUP BY 1, 2), worst AS (SELECT frame, rep, max(score) AS best FROM top GROUP BY 1, 2)
  SELECT frame, det AS event_id, 'unreported' AS kind FROM det LEFT JOIN best USING (frame, det) WHERE coalesce(best, 0e0) < 0.2e0
  UNION ALL SELECT frame, rep, 'undetected' FROM rep LEFT JOIN worst USING (frame, rep) WHERE coalesce(best, 0e0) < 0.2e0""")
def match_unmatched(spark, sf_dir):
    """Detections without a good report, and reports without a good detection."""
    frame, pairs = F.floor(F.col("us") / (3600 * MICROS)).alias("frame"), saved(_candidates(spark, sf_dir), "candidates")
    det = obs(spark, sf_dir, ("click",)).select(frame, F.col("event_id").alias("det"))
    rep = truth(spark, sf_dir).select(frame, F.col("event_id").alias("rep"))
    found = [matching.unmatched(pairs, rows, side, 0.2).select("frame", F.col(side).alias("event_id"), F.lit(kind).alias("kind")) for rows, side, kind in ((det, "det", "unreported"), (rep, "rep", "undetected"))]
    return found[0].unionByName(found[1])


def _gate_sql(side, value):
    return f"""q{side} AS (SELECT frame, arg_max(q, {side}) AS q FROM (SELECT frame, {side}, quantile_cont({value}, 0.1e0) OVER (ORDER BY frame, {side} ROWS 499 PRECEDING) AS q FROM {side} SEMI JOIN fr USING (frame)) GROUP BY frame),
n{side} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY frame) AS n FROM q{side}),
g{side}(frame, n, gate) AS (SELECT frame, n, 0.8e0 * 0.5e0 + (1e0 - 0.8e0) * q FROM n{side} WHERE n = 1 UNION ALL SELECT x.frame, x.n, 0.8e0 * gate + (1e0 - 0.8e0) * x.q FROM g{side} g JOIN n{side} x ON x.n = g.n + 1)"""


def _missed_sql(side, kind):
    return f"SELECT frame, uav_id AS id, '{kind}' AS kind, {side} AS event FROM {side} SEMI JOIN fr USING (frame) LEFT JOIN (SELECT frame, {side}, max(score) AS best FROM top GROUP BY 1, 2) USING (frame, {side}) WHERE coalesce(best, 0e0) < 0.2e0"


_ABLE = "(SELECT {side}.* FROM {side} JOIN g{side} USING (frame) WHERE {value} >= gate) AS {side}"
_BOTH = "(SELECT * FROM det SEMI JOIN fr USING (frame))"
FRAMES_SQL = f"""{_SIDES},
fr AS MATERIALIZED (SELECT frame FROM det INTERSECT SELECT frame FROM rep), {_gate_sql('det', 'confidence')}, {_gate_sql('rep', 'quality')},
{_NEAR.format(det=_ABLE.format(side='det', value='confidence'), rep=_ABLE.format(side='rep', value='quality'), all=_BOTH)},
missed AS ({_missed_sql('det', 'unreported')} UNION ALL {_missed_sql('rep', 'undetected')})"""


@plans(f"WITH RECURSIVE {OBS_SQL}, {FRAMES_SQL} SELECT *, count(*) OVER (PARTITION BY id, kind ORDER BY frame, event ROWS UNBOUNDED PRECEDING) AS misses, misses >= 3 AS abnormal FROM missed")
def match_frames(spark, sf_dir):
    """The matcher over all frames, with gates that follow the rows before and votes for those that are missed again and again."""
    det, rep = sides(obs(spark, sf_dir, ("click",)), truth(spark, sf_dir))
    _, missed = matching.frames(det, rep, GATE, 0.2, size=500)
    return missed.select("frame", "id", "kind", F.col("row").alias("event"), "misses", (F.col("misses") >= 3).alias("abnormal"))


@plans(f"WITH {OBS_SQL} SELECT event_id, round(quantile_cont(q1, 0.8) OVER (PARTITION BY uav_id ORDER BY us, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 6) + 0 AS gate FROM obs WHERE modality <> 'truth'")
def gate_quantile(spark, sf_dir):
    gates = running.with_rolling_quantile(sensed(spark, sf_dir), "uav_id", ["us", "event_id"], "q1", 0.8, 50, "gate", DAY)
    return gates.select("event_id", r6(F.col("gate")).alias("gate"))


EMA_SQL = f"""WITH RECURSIVE {OBS_SQL}, s AS MATERIALIZED (SELECT event_id, uav_id, q1 / 100e0 AS q, row_number() OVER (PARTITION BY uav_id ORDER BY us, event_id) AS n FROM obs WHERE modality <> 'truth'),
  r(uav_id, n, event_id, tau) AS (SELECT uav_id, n, event_id, 0.8e0 * 0.5e0 + (1e0 - 0.8e0) * q FROM s WHERE n = 1
    UNION ALL SELECT s.uav_id, s.n, s.event_id, 0.8e0 * tau + (1e0 - 0.8e0) * q FROM r JOIN s ON s.uav_id = r.uav_id AND s.n = r.n + 1)"""


@plans(f"{EMA_SQL} SELECT event_id, round(tau, 6) + 0 AS tau FROM r")
def gate_ema(spark, sf_dir):
    rows = sensed(spark, sf_dir).withColumn("q", F.col("q1") / 100.0)
    return running.with_smoothed(rows, "uav_id", ["us", "event_id"], "q", "tau", DAY).select("event_id", r6(F.col("tau")).alias("tau"))


@plans(f"""WITH {OBS_SQL}, v AS (SELECT event_id, sum((q1 > 90)::INT) OVER (PARTITION BY uav_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS votes FROM obs WHERE modality <> 'truth')
  SELECT event_id, votes, votes >= 3 AS queued FROM v""")
def abnormal_votes(spark, sf_dir):
    abnormal = F.coalesce(F.col("q1") > 90, F.lit(False)).cast("long")
    rows = running.with_sum(sensed(spark, sf_dir), "uav_id", ["us", "event_id"], abnormal, "votes", DAY)
    return rows.select("event_id", "votes", (F.col("votes") >= 3).alias("queued"))


@plans(f"""WITH {TRACK_SQL}, p AS (SELECT a.uav_id, a.t_idx AS i, b.t_idx AS j, sqrt(pow(a.gx - b.gx, 2) + pow(a.gy - b.gy, 2) + pow(a.gz - b.gz, 2)) + abs(a.t_idx - b.t_idx) AS gap
    FROM track a JOIN track b ON a.uav_id = b.uav_id AND a.t_idx // 20 = b.t_idx // 20),
  k AS (SELECT uav_id, i, j FROM p QUALIFY row_number() OVER (PARTITION BY uav_id, i ORDER BY round(gap, 9), j) <= 6)
  SELECT uav_id, i, j FROM k UNION SELECT uav_id, j, i FROM k""")
def knn_self(spark, sf_dir):
    return matching.neighbours(track(spark, sf_dir), "uav_id", "t_idx", ["gx", "gy", "gz"], 6)


@plans(f"""WITH {TRACK_SQL}, p AS (SELECT a.uav_id, a.t_idx AS i, b.t_idx AS j, sqrt(pow(a.gx - b.gx, 2) + pow(a.gy - b.gy, 2) + pow(a.gz - b.gz, 2)) + abs(a.t_idx - b.t_idx) AS gap
    FROM track a JOIN track b ON a.uav_id = b.uav_id AND a.t_idx // 20 = b.t_idx // 20 AND a.t_idx <> b.t_idx)
  SELECT uav_id, i, j FROM p QUALIFY row_number() OVER (PARTITION BY uav_id, i ORDER BY round(gap, 9), j) <= 6""")
def knn_others(spark, sf_dir):
    return matching.neighbours(track(spark, sf_dir), "uav_id", "t_idx", ["gx", "gy", "gz"], 6, own=False)


@plans(f"""WITH {OBS_SQL}, p AS (SELECT us // {DAY}::BIGINT AS frame, event_id AS i, round(radians(lon - 5e0) * cos(radians(45e0)) * 6378137e0, 3) AS x, round(radians(lat - 45e0) * 6378137e0, 3) AS y, alt AS z FROM obs WHERE modality = 'gps' AND lat IS NOT NULL AND lon IS NOT NULL AND alt IS NOT NULL),
  q AS (SELECT a.frame, a.i, b.i AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS gap FROM p a JOIN p b ON a.frame = b.frame AND a.i <> b.i)
  SELECT frame, i, j, row_number() OVER (PARTITION BY frame, i ORDER BY round(gap, 9), j) AS place FROM q QUALIFY place <= 6""")
def knn_frame(spark, sf_dir):
    """Every detection's six nearest others of its frame, here a day, whatever the frame's size."""
    lat, lon = F.radians(F.col("lat") - 45.0), F.radians(F.col("lon") - 5.0) * F.cos(F.radians(F.lit(45.0)))
    points = obs(spark, sf_dir, ("click",)).select(F.floor(F.col("us") / DAY).alias("frame"), "event_id", F.round(lon * 6378137.0, 3).alias("x"), F.round(lat * 6378137.0, 3).alias("y"), F.col("alt").alias("z"))
    return matching.nearest(points, "frame", "event_id", ["x", "y", "z"], 6)


_ARC = "sqrt(pow(radians({b} - lon) * cos(radians((lat + {a}) / 2e0)), 2) + pow(radians({a} - lat), 2)) * 6371000e0"
_REACH = " ".join(f"WHEN '{m}' THEN greatest(0e0, least(1e0, {_ARC.format(a=f'{a}e0', b=f'{b}e0')} / {r}e0))" for m, (a, b, r) in intervals.ANCHORS.items())
_ZONE = ", ".join(f"CASE WHEN {_ARC.format(a=f'{a}e0', b=f'{b}e0')} <= {r}e0 THEN {s}e0 ELSE 0e0 END" for a, b, r, s in intervals.ZONES)
_EVENT = ", ".join(f"CASE WHEN modality IN {names} AND t BETWEEN {a}e0 AND {b}e0 THEN {s}e0 ELSE 0e0 END" for a, b, names, s in intervals.EVENTS)


@plans(f"""WITH {OBS_SQL}, p AS (SELECT event_id, modality, 45e0 + (q1 - 50e0) / 500e0 AS lat, 5e0 + (q2 - 50e0) / 500e0 AS lon, ((us // {MICROS}) % 120)::DOUBLE AS t FROM obs WHERE modality <> 'truth')
  SELECT event_id, round(greatest(0e0, least(1e0, 0.55e0 * (CASE modality {_REACH} END) + 0.30e0 * greatest({_ZONE}) + 0.30e0 * greatest({_EVENT}))), 6) + 0 AS penalty FROM p""")
def env_penalty(spark, sf_dir):
    lat, lon = 45.0 + (F.col("q1") - 50.0) / 500.0, 5.0 + (F.col("q2") - 50.0) / 500.0
    seconds = (F.floor(F.col("us") / MICROS) % 120).cast("double")
    return sensed(spark, sf_dir).select("event_id", r6(intervals.penalty(F.col("modality"), lat, lon, seconds)).alias("penalty"))


_POINTS = f"p AS (SELECT event_id, modality, 45e0 + (q1 - 50e0) / 500e0 AS lat, 5e0 + (q2 - 50e0) / 500e0 AS lon, us / {MICROS}e0 - 1704067200e0 AS t FROM obs WHERE modality <> 'truth')"
_ZONES = """z AS (SELECT 45e0 + (c_custkey % 97 - 48) / 400e0 AS z_lat, 5e0 + (c_custkey % 89 - 44) / 400e0 AS z_lon, 30e0 * pow(2, c_custkey % 8) AS radius, (c_custkey % 13) / 13e0 AS strength FROM customer),
  zoned AS (SELECT event_id, coalesce(max(strength), 0e0) AS zone FROM p LEFT JOIN z ON sqrt(pow(radians(z_lon - lon) * cos(radians((lat + z_lat) / 2e0)), 2) + pow(radians(z_lat - lat), 2)) * 6371000e0 <= radius GROUP BY event_id)"""
_TIMES = """v AS (SELECT (o_orderkey * 37 % 2592000)::DOUBLE AS start, CASE WHEN o_custkey % 97 = 0 THEN 2592000e0 ELSE (o_orderkey * 37 % 2592000) + pow(2, o_custkey % 16) END AS "end",
    CASE o_custkey % 4 WHEN 0 THEN ['gps', 'radar'] WHEN 1 THEN ['fiveg'] WHEN 2 THEN ['tdoa', 'acoustic'] ELSE [] END AS sensors, floor(o_totalprice % 100) / 100e0 AS level FROM orders),
  timed AS (SELECT event_id, coalesce(max(level), 0e0) AS event FROM p LEFT JOIN v ON t BETWEEN start AND "end" AND list_contains(sensors, modality) GROUP BY event_id)"""


def _points(spark, sf_dir):
    lat, lon = 45.0 + (F.col("q1") - 50.0) / 500.0, 5.0 + (F.col("q2") - 50.0) / 500.0
    return sensed(spark, sf_dir).select("event_id", "modality", lat.alias("lat"), lon.alias("lon"), (F.col("us") / MICROS - 1704067200).alias("t"))


def _zones(spark, sf_dir):
    """Every customer as a zone of 30 metres to 4 kilometres."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select((45.0 + (k % 97 - 48) / 400.0).alias("lat"), (5.0 + (k % 89 - 44) / 400.0).alias("lon"), (30.0 * F.pow(F.lit(2.0), k % 8)).alias("radius"), ((k % 13) / 13.0).alias("strength"))


def _events(spark, sf_dir):
    """Every order as an interference event of seconds to hours, or of all the time."""
    start, k = F.col("o_orderkey") * 37 % 2592000, F.col("o_custkey")
    end = F.when(k % 97 == 0, 2592000.0).otherwise(start + F.pow(F.lit(2.0), k % 16))
    names = F.when(k % 4 == 0, F.array(F.lit("gps"), F.lit("radar"))).when(k % 4 == 1, F.array(F.lit("fiveg"))).when(k % 4 == 2, F.array(F.lit("tdoa"), F.lit("acoustic")))
    return table(spark, sf_dir, "orders").select(start.alias("start"), end.alias("end"), names.alias("sensors"), (F.floor(F.col("o_totalprice") % 100) / 100.0).alias("level"))


@plans(f"WITH {OBS_SQL}, {_POINTS}, {_ZONES} SELECT event_id, round(zone, 6) + 0 AS zone FROM zoned")
def zone_strength(spark, sf_dir):
    return lookups.with_zone(_points(spark, sf_dir), _zones(spark, sf_dir), "event_id").select("event_id", r6(F.col("zone")).alias("zone"))


@plans(f"WITH {OBS_SQL}, {_POINTS}, {_TIMES} SELECT event_id, round(event, 6) + 0 AS event FROM timed")
def interference_level(spark, sf_dir):
    return lookups.with_event(_points(spark, sf_dir), _events(spark, sf_dir), "event_id", "t", "modality").select("event_id", r6(F.col("event")).alias("event"))


@plans(f"""WITH {OBS_SQL}, {_POINTS}, {_ZONES}, {_TIMES} SELECT event_id, round(greatest(0e0, least(1e0, 0.55e0 * (CASE modality {_REACH} END) + 0.30e0 * zone + 0.30e0 * event)), 6) + 0 AS penalty
  FROM p JOIN zoned USING (event_id) JOIN timed USING (event_id)""")
def env_penalty_tables(spark, sf_dir):
    """The environment's penalty with zones and events from tables."""
    rows = lookups.with_event(lookups.with_zone(_points(spark, sf_dir), _zones(spark, sf_dir), "event_id"), _events(spark, sf_dir), "event_id", "t", "modality")
    reach = intervals.reach(F.col("modality"), F.col("lat"), F.col("lon"))
    return rows.select("event_id", r6(intervals.combined(reach, F.col("zone"), F.col("event"))).alias("penalty"))


_OUT = f"SELECT uav_id, us AS start, us + floor(q1)::BIGINT * {900 * MICROS}::BIGINT AS \"end\" FROM obs WHERE modality = 'tdoa'"
_MERGE = f"""o AS ({_OUT}), g AS (SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY uav_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM o),
h AS (SELECT *, sum(fresh) OVER (PARTITION BY uav_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM g),
m AS (SELECT uav_id, min(start) AS start, max("end") AS "end" FROM h GROUP BY uav_id, island)"""


def _outages(spark, sf_dir):
    return obs(spark, sf_dir, ("error",)).select("uav_id", F.col("us").alias("start"), (F.col("us") + F.floor("q1") * (900 * MICROS)).alias("end"))


@plans(f'WITH {OBS_SQL}, {_MERGE} SELECT uav_id, start, "end" FROM m')
def interval_merge(spark, sf_dir):
    return intervals.merged(_outages(spark, sf_dir), "uav_id")


@plans(f'WITH {OBS_SQL}, o AS ({_OUT}) SELECT event_id, uav_id, us FROM obs s WHERE EXISTS (SELECT 1 FROM o WHERE o.uav_id = s.uav_id AND s.us BETWEEN o.start AND o."end")')
def interval_stab(spark, sf_dir):
    return intervals.stabbed(obs(spark, sf_dir).select("event_id", "uav_id", "us"), _outages(spark, sf_dir), "uav_id", "us")
