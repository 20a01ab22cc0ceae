"""As-of joins, fusion, windows and track metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, scalar
from ..operators import asof, fusion, inference, metrics, moments, paths, running, windows
from ..sources import reports
from ..sources.shared import saved, scratch_path
from ..sources.tables import MICROS, OBS_SQL, TRACK_SQL, obs, sensed, track, truth
from .base import Plans, r6
from .scalars import CONF_SQL, confident

plans = Plans()
HOURS6 = 6 * 3600 * MICROS
POS = ["lat", "lon", "alt"]

_TWO = """j AS (
  SELECT o.*, lo.us AS lo_us, lo.lat AS lo_lat, lo.lon AS lo_lon, lo.alt AS lo_alt, hi.us AS hi_us, hi.lat AS hi_lat, hi.lon AS hi_lon, hi.alt AS hi_alt
  FROM {o} o ASOF LEFT JOIN t lo ON o.uav_id = lo.uav_id AND o.us >= lo.us ASOF LEFT JOIN t hi ON o.uav_id = hi.uav_id AND o.us <= hi.us),
near AS (
  SELECT *, CASE WHEN lo_us IS NULL OR hi_us - us < us - lo_us THEN hi_us ELSE lo_us END AS t_us,
    CASE WHEN lo_us IS NULL OR hi_us - us < us - lo_us THEN hi_lat ELSE lo_lat END AS t_lat,
    CASE WHEN lo_us IS NULL OR hi_us - us < us - lo_us THEN hi_lon ELSE lo_lon END AS t_lon,
    CASE WHEN lo_us IS NULL OR hi_us - us < us - lo_us THEN hi_alt ELSE lo_alt END AS t_alt
  FROM j WHERE lo_us IS NOT NULL OR hi_us IS NOT NULL)"""
_T = "t AS (SELECT * FROM obs WHERE modality = 'truth'), s AS (SELECT * FROM obs WHERE modality <> 'truth')"
NEAR_SQL = f"{OBS_SQL}, {_T}, {_TWO.format(o='s')}"


@plans(f"WITH {NEAR_SQL} SELECT event_id, t_us, abs(us - t_us) AS dt FROM near WHERE abs(us - t_us) <= {HOURS6}::BIGINT")
def asof_nearest_tol(spark, sf_dir):
    return asof.nearest(sensed(spark, sf_dir), truth(spark, sf_dir), "uav_id", "us", POS, HOURS6).select("event_id", "t_us", "dt")


@plans(f"WITH {NEAR_SQL} SELECT event_id, t_us, abs(us - t_us) AS dt FROM near")
def asof_nearest_notol(spark, sf_dir):
    return asof.nearest(sensed(spark, sf_dir), truth(spark, sf_dir), "uav_id", "us", POS, None).select("event_id", "t_us", "dt")


_HOUR = f"us // (3600 * {MICROS}::BIGINT)"


@plans(f"""WITH {OBS_SQL}, h AS (SELECT *, {_HOUR} AS hour FROM obs),
  g AS (SELECT * FROM h WHERE modality = 'gps' QUALIFY row_number() OVER (PARTITION BY uav_id, hour ORDER BY us DESC, event_id DESC) = 1)
  SELECT h.event_id, g.event_id AS gps_event, g.lat, g.lon FROM h JOIN g ON h.uav_id = g.uav_id AND h.hour = g.hour WHERE h.modality = 'truth'""")
def asof_legacy_lastwins(spark, sf_dir):
    hour = F.floor(F.col("us") / (3600 * MICROS)).alias("hour")
    gps = asof.last_wins(obs(spark, sf_dir, ("click",)).select("uav_id", hour, "us", "event_id", "lat", "lon"), ["uav_id", "hour"], "us", "event_id")
    return truth(spark, sf_dir).select("uav_id", hour, "event_id").join(gps.withColumnRenamed("event_id", "gps_event"), ["uav_id", "hour"]).select("event_id", "gps_event", "lat", "lon")


_FRAC = "CASE WHEN b_us = a_us THEN 0e0 ELSE (us - a_us) / (b_us - a_us)::DOUBLE END"


@plans(f"""WITH {OBS_SQL}, {_T}, {_TWO.format(o='s')},
  e AS (SELECT *, coalesce(lo_us, hi_us) AS a_us, coalesce(hi_us, lo_us) AS b_us, coalesce(lo_lat, hi_lat) AS a_lat, coalesce(hi_lat, lo_lat) AS b_lat, coalesce(lo_alt, hi_alt) AS a_alt, coalesce(hi_alt, lo_alt) AS b_alt FROM j WHERE lo_us IS NOT NULL OR hi_us IS NOT NULL)
  SELECT event_id, round(a_lat + ({_FRAC}) * (b_lat - a_lat), 6) + 0 AS i_lat, round(a_alt + ({_FRAC}) * (b_alt - a_alt), 6) + 0 AS i_alt FROM e WHERE modality = 'gps'""")
def interp_track(spark, sf_dir):
    times = obs(spark, sf_dir, ("click",)).select("event_id", "uav_id", "us")
    return asof.interpolated(times, truth(spark, sf_dir), "uav_id", "us", ["lat", "alt"]).select("event_id", r6(F.col("lat")).alias("i_lat"), r6(F.col("alt")).alias("i_alt"))


_PRIOR = "CASE modality WHEN 'gps' THEN 1e0 WHEN 'radar' THEN 0.7e0 WHEN 'fiveg' THEN 0.6e0 WHEN 'tdoa' THEN 0.45e0 ELSE 0.5e0 END"


@plans(f"""WITH {CONF_SQL}, t AS (SELECT * FROM obs WHERE modality = 'truth'), {_TWO.format(o='conf')},
  ref AS (SELECT uav_id, arg_min(lat, us) AS lat0, arg_min(lon, us) AS lon0, arg_min(alt, us) AS alt0 FROM t GROUP BY uav_id),
  w AS (SELECT n.uav_id, n.t_us, (0.3e0 + 0.7e0 * confidence) * {_PRIOR} AS w, lat0, lon0, alt0,
          radians(lon - lon0) * cos(radians(lat0)) * 6378137e0 AS e, radians(lat - lat0) * 6378137e0 AS n, alt - alt0 AS u
        FROM near n JOIN ref USING (uav_id) WHERE abs(us - t_us) <= {HOURS6}::BIGINT),
  f AS (SELECT uav_id, t_us, count(*) AS n_obs, sum(w * e) / sum(w) AS e, sum(w * n) / sum(w) AS n, sum(w * u) / sum(w) AS u, any_value(lat0) AS lat0, any_value(lon0) AS lon0, any_value(alt0) AS alt0 FROM w GROUP BY uav_id, t_us)
  SELECT uav_id, t_us, n_obs, round(lat0 + degrees(n / 6378137e0), 7) + 0 AS lat, round(lon0 + degrees(e / (cos(radians(lat0)) * 6378137e0)), 7) + 0 AS lon, round(alt0 + u, 5) + 0 AS alt FROM f""")
def fusion_observation_weighted(spark, sf_dir):
    fused = fusion.weighted_fallback(confident(spark, sf_dir), truth(spark, sf_dir), HOURS6)
    return fused.select("uav_id", "t_us", "n_obs", *((F.round(c, d) + 0.0).alias(c) for c, d in (("lat", 7), ("lon", 7), ("alt", 5))))


@plans(f"""WITH {OBS_SQL} SELECT {_HOUR} AS hour, count(*) AS n, round(avg(radians(lon - 5e0) * cos(radians(45e0)) * 6378137e0), 6) + 0 AS x,
  round(avg(radians(lat - 45e0) * 6378137e0), 6) + 0 AS y, round(avg(alt - 100e0), 6) + 0 AS z FROM obs WHERE modality <> 'truth' GROUP BY 1""")
def timestamp_mean_fusion(spark, sf_dir):
    east, north, up = geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), F.lit(45.0), F.lit(5.0), F.lit(100.0))
    rows = sensed(spark, sf_dir).select(F.floor(F.col("us") / (3600 * MICROS)).alias("hour"), east.alias("x"), north.alias("y"), up.alias("z"))
    return rows.groupBy("hour").agg(F.count(F.lit(1)).alias("n"), *(r6(F.avg(c)).alias(c) for c in "xyz")).orderBy("hour")


W_SIZE, W_STRIDE = 20, 5
_WIN = f"""tl AS (SELECT *, count(*) OVER (PARTITION BY uav_id) AS len FROM track),
win AS (SELECT tl.*, s.start, t_idx - s.start AS pos FROM tl, LATERAL (SELECT unnest(generate_series(0, len - {W_SIZE}, {W_STRIDE})) AS start) s WHERE t_idx BETWEEN s.start AND s.start + {W_SIZE - 1})"""
_TAPER = f"(0.25e0 + 0.75e0 * (1e0 - abs(pos * (2e0 / {W_SIZE - 1}) - 1e0)))"


def _windows(spark, sf_dir):
    rows = windows.with_length(track(spark, sf_dir), "uav_id")
    return windows.dealt(rows, "t_idx", F.col("length"), W_SIZE, W_STRIDE)


@plans(f"WITH {TRACK_SQL}, {_WIN} SELECT uav_id, start, pos, t_idx FROM win")
def window_sliding(spark, sf_dir):
    return _windows(spark, sf_dir).select("uav_id", "start", "pos", "t_idx")


_FLAGS = "least(1e0, abs(px) * 4e0) AS conf, (gx > 0)::INT::DOUBLE AS pos_valid, (gy > -0.1e0)::INT::DOUBLE AS obs_valid"


def _flagged(df):
    return df.withColumns({"conf": F.least(F.lit(1.0), F.abs("px") * 4.0), "pos_valid": (F.col("gx") > 0).cast("double"), "obs_valid": (F.col("gy") > F.lit(-0.1)).cast("double")})


_QUAL = f"""q AS (SELECT uav_id, start, count(*) AS n, avg(conf) AS conf, avg(pos_valid) AS pos_valid, avg(obs_valid) AS obs_valid FROM (SELECT *, {_FLAGS} FROM win) GROUP BY 1, 2),
qq AS (SELECT *, greatest(1e-3, ln(1e0 + n) * (0.3e0 + 0.7e0 * conf) * (0.5e0 + 0.5e0 * pos_valid) * (0.5e0 + 0.5e0 * obs_valid)) AS quality FROM q)"""


@plans(f"WITH {TRACK_SQL}, {_WIN}, {_QUAL} SELECT uav_id, start, n, round(conf, 6) + 0 AS conf, round(quality, 6) + 0 AS quality FROM qq")
def window_quality(spark, sf_dir):
    stats = windows.window_stats(_flagged(_windows(spark, sf_dir)), "uav_id")
    return stats.select("uav_id", "start", "n", r6(F.col("conf")).alias("conf"), r6(F.col("quality")).alias("quality"))


@plans(f"WITH {TRACK_SQL}, {_WIN} SELECT t.uav_id, t.t_idx, count(w.start) AS cover FROM track t LEFT JOIN win w USING (uav_id, t_idx) GROUP BY 1, 2")
def coverage(spark, sf_dir):
    cover = _windows(spark, sf_dir).groupBy("uav_id", "t_idx").agg(F.count(F.lit(1)).alias("cover"))
    return track(spark, sf_dir).select("uav_id", "t_idx").join(cover, ["uav_id", "t_idx"], "left").select("uav_id", "t_idx", F.coalesce("cover", F.lit(0)).alias("cover"))


_MERGED = f"""m AS (SELECT uav_id, t_idx, count(*) AS cover, sum(w * px) / (sum(w) + 1e-6) AS mx, sum(w * py) / (sum(w) + 1e-6) AS my
  FROM (SELECT win.*, greatest(1e-6, {_TAPER} * quality) AS w FROM win JOIN qq USING (uav_id, start)) GROUP BY 1, 2),
mm AS (SELECT t.uav_id, t.t_idx, t.gx, t.gy, t.px, t.py, coalesce(cover, 0) AS cover, coalesce(mx, 0e0) AS mx, coalesce(my, 0e0) AS my FROM track t LEFT JOIN m USING (uav_id, t_idx))"""


def _merged(spark, sf_dir):
    dealt = _windows(spark, sf_dir)
    quality = windows.window_stats(_flagged(dealt), "uav_id").select("uav_id", "start", "quality")
    merged = windows.merged(dealt.join(quality, ["uav_id", "start"]).withColumns({"mx": F.col("px"), "my": F.col("py")}), "uav_id", "t_idx", ["mx", "my"], W_SIZE, weight=F.col("quality"))
    return track(spark, sf_dir).join(merged, ["uav_id", "t_idx"], "left").fillna(0, ["cover"]).fillna(0.0, ["mx", "my"])


@plans(f"WITH {TRACK_SQL}, {_WIN}, {_QUAL}, {_MERGED} SELECT uav_id, t_idx, cover, round(mx, 6) + 0 AS mx, round(my, 6) + 0 AS my FROM mm")
def merge_taper(spark, sf_dir):
    return _merged(spark, sf_dir).select("uav_id", "t_idx", "cover", r6(F.col("mx")).alias("mx"), r6(F.col("my")).alias("my"))


_BLEND = "CASE WHEN least(1e0, cover / 3e0) >= 0.999e0 OR ow <= 1e-9 THEN {x} ELSE least(1e0, cover / 3e0) * {x} + (1e0 - least(1e0, cover / 3e0)) * gx END"


@plans(f"""WITH {TRACK_SQL}, {_WIN}, {_QUAL}, {_MERGED}, o AS (SELECT *, CASE WHEN gz > 0.2e0 THEN 0e0 ELSE 1e0 END AS ow, max(t_idx) OVER (PARTITION BY uav_id) AS last FROM mm),
  h AS (SELECT *, CASE WHEN t_idx < {W_SIZE} THEN {_BLEND.format(x='mx')} ELSE mx END AS bx FROM (SELECT o.*, gx AS fx FROM o))
  SELECT uav_id, t_idx, round(CASE WHEN t_idx > last - {W_SIZE} THEN {_BLEND.format(x='bx')} ELSE bx END, 6) + 0 AS bx FROM h""".replace("SELECT t.uav_id, t.t_idx, t.gx, t.gy, t.px", "SELECT t.uav_id, t.t_idx, t.gx, t.gy, t.gz, t.px"))
def warmup_tail_blend(spark, sf_dir):
    rows = _merged(spark, sf_dir).withColumns({"ow": F.when(F.col("gz") > 0.2, 0.0).otherwise(1.0), "last": F.max("t_idx").over(Window.partitionBy("uav_id"))})
    blend = lambda x: windows.blended(F.col(x), F.col("gx"), F.col("cover"), F.col("ow"))
    rows = rows.withColumn("bx", F.when(F.col("t_idx") < W_SIZE, blend("mx")).otherwise(F.col("mx")))
    rows = rows.withColumn("bx", F.when(F.col("t_idx") > F.col("last") - W_SIZE, blend("bx")).otherwise(F.col("bx")))
    return rows.select("uav_id", "t_idx", r6(F.col("bx")).alias("bx"))


@plans("""WITH x AS (SELECT unnest(embedding)::DOUBLE AS v, unnest(generate_series(0, 63)) AS dim FROM embeddings)
  SELECT dim::BIGINT AS dim, CASE WHEN dim >= 8 THEN 0e0 ELSE round(avg(v), 6) + 0 END AS mu, CASE WHEN dim >= 8 THEN 1e0 ELSE round(stddev_pop(v) + 1e-6, 6) + 0 END AS sigma FROM x GROUP BY dim""")
def norm_stats(spark, sf_dir):
    from ..sources.tables import table

    x = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("dim", "v")).groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("mu"), F.stddev_pop(F.col("v").cast("double")).alias("sigma"))
    keep = F.col("dim") < 8
    return x.select(F.col("dim").cast("long").alias("dim"), F.when(keep, r6(F.col("mu"))).otherwise(0.0).alias("mu"), F.when(keep, r6(F.col("sigma") + 1e-6)).otherwise(1.0).alias("sigma"))


@plans(f"""WITH {CONF_SQL} SELECT event_id, [round(radians(lon - 5e0) * cos(radians(45e0)) * 6378137e0, 4) + 0, round(radians(lat - 45e0) * 6378137e0, 4) + 0, round(alt - 100e0, 4) + 0,
    round(confidence, 9) + 0, 1e0, (modality = 'gps')::INT::DOUBLE, (modality = 'radar')::INT::DOUBLE, (modality = 'fiveg')::INT::DOUBLE, (modality = 'tdoa')::INT::DOUBLE, (modality = 'acoustic')::INT::DOUBLE] AS feature FROM conf WHERE lat IS NOT NULL""")
def node_features(spark, sf_dir):
    feature = fusion.node_feature(F.lit(45.0), F.lit(5.0), F.lit(100.0))
    return confident(spark, sf_dir).select("event_id", feature.alias("feature"))


_PICK = "coalesce(max(CASE WHEN modality = '{m}' THEN {c} END), NULL)"


@plans(f"""WITH {OBS_SQL}, h AS (SELECT *, {_HOUR} AS hour FROM obs),
  best AS (SELECT uav_id, hour, alt FROM h WHERE modality IN ('gps', 'radar', 'fiveg') AND event_id % 4 <> 0
           QUALIFY row_number() OVER (PARTITION BY uav_id, hour ORDER BY CASE modality WHEN 'gps' THEN 0 WHEN 'radar' THEN 1 ELSE 2 END, us DESC, event_id DESC) = 1),
  steps AS (SELECT DISTINCT uav_id, hour FROM h)
  SELECT uav_id, hour, round(last_value(alt IGNORE NULLS) OVER (PARTITION BY uav_id ORDER BY hour ROWS UNBOUNDED PRECEDING), 6) + 0 AS alt, (alt IS NOT NULL)::BIGINT AS seen FROM steps LEFT JOIN best USING (uav_id, hour)""")
def locf_priority_truth(spark, sf_dir):
    rows = obs(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / (3600 * MICROS)))
    filled = fusion.priority_steps(rows, F.col("event_id") % 4 != 0, ("gps", "radar", "fiveg"))
    return filled.select("uav_id", "hour", r6(F.col("alt")).alias("alt"), F.col("seen").cast("long").alias("seen"))


_D = "sqrt(pow(px - gx, 2) + pow(py - gy, 2) + pow(pz - gz, 2))"


@plans(f"""WITH {TRACK_SQL}, d AS (SELECT uav_id, {_D} AS d FROM track) SELECT uav_id, round(sqrt(avg(d * d)), 6) + 0 AS rmse, round(avg(d), 6) + 0 AS mae, round(quantile_cont(d, 0.5), 6) + 0 AS medae,
  round(quantile_cont(d, 0.9), 6) + 0 AS p90, round(quantile_cont(d, 0.95), 6) + 0 AS p95, round(max(d), 6) + 0 AS max_err FROM d GROUP BY uav_id""")
def error_stats(spark, sf_dir):
    rows = track(spark, sf_dir)
    out = metrics.error_stats(rows.withColumn("d", metrics.distance3(rows)), ["uav_id"], "d")
    return out.select("uav_id", *(r6(F.col(c)).alias(c) for c in out.columns if c != "uav_id"))


@plans(f"""WITH {TRACK_SQL}, d AS (SELECT uav_id, {_D} AS d FROM track) SELECT uav_id, round(avg((d > 0.2e0)::INT), 6) + 0 AS over_20, round(avg((d > 0.25e0)::INT), 6) + 0 AS over_25, round(avg((d > 0.3e0)::INT), 6) + 0 AS over_30 FROM d GROUP BY uav_id""")
def outlier_ratio(spark, sf_dir):
    rows = track(spark, sf_dir)
    return rows.withColumn("d", metrics.distance3(rows)).groupBy("uav_id").agg(*(r6(F.avg((F.col("d") > t).cast("int"))).alias(f"over_{round(t * 100)}") for t in (0.2, 0.25, 0.3)))


@plans(f"""WITH {TRACK_SQL}, d AS (SELECT uav_id, t_idx, count(*) OVER (PARTITION BY uav_id) AS n, {_D} AS d FROM track)
  SELECT uav_id, round(sqrt(avg(d * d) FILTER (t_idx < least(20, n))), 6) + 0 AS head_rmse, round(sqrt(avg(d * d) FILTER (t_idx >= n - least(20, n))), 6) + 0 AS tail_rmse FROM d GROUP BY uav_id""")
def boundary_rmse(spark, sf_dir):
    rows = windows.with_length(track(spark, sf_dir), "uav_id")
    d2, k = F.pow(metrics.distance3(rows), F.lit(2.0)), F.least(F.lit(20), F.col("length"))
    mean = lambda keep: r6(F.sqrt(F.avg(F.when(keep, d2))))
    return rows.groupBy("uav_id").agg(mean(F.col("t_idx") < k).alias("head_rmse"), mean(F.col("t_idx") >= F.col("length") - k).alias("tail_rmse"))


@plans(f"""WITH {TRACK_SQL}, d AS (SELECT uav_id, t_idx, {_D} AS d, sqrt(pow(px - gx, 2) + pow(py - gy, 2)) AS d2 FROM track)
  SELECT uav_id, round(avg(d), 6) + 0 AS ade, round(arg_max(d, t_idx), 6) + 0 AS fde, round(avg(d2), 6) + 0 AS ade_xy, round(arg_max(d2, t_idx), 6) + 0 AS fde_xy FROM d GROUP BY uav_id""")
def ade_fde(spark, sf_dir):
    rows = track(spark, sf_dir)
    rows = rows.withColumns({"d": metrics.distance3(rows), "d2": geo.norm(F.col("px") - F.col("gx"), F.col("py") - F.col("gy"))})
    return rows.groupBy("uav_id").agg(r6(F.avg("d")).alias("ade"), r6(F.max_by("d", "t_idx")).alias("fde"), r6(F.avg("d2")).alias("ade_xy"), r6(F.max_by("d2", "t_idx")).alias("fde_xy"))


def _rpe_sql(h):
    part = " + ".join(f"pow((lead(p{a}, {h}) OVER w - p{a}) - (lead(g{a}, {h}) OVER w - g{a}), 2)" for a in "xyz")
    return f"SELECT uav_id, t_idx, {part} AS d{h} FROM track WINDOW w AS (PARTITION BY uav_id ORDER BY t_idx)"


@plans(f"WITH {TRACK_SQL}, a AS ({_rpe_sql(1)}), b AS ({_rpe_sql(5)}), c AS ({_rpe_sql(10)}) SELECT uav_id, round(sqrt(avg(d1)), 6) + 0 AS rpe_1, round(sqrt(avg(d5)), 6) + 0 AS rpe_5, round(sqrt(avg(d10)), 6) + 0 AS rpe_10 FROM a JOIN b USING (uav_id, t_idx) JOIN c USING (uav_id, t_idx) GROUP BY uav_id")
def rpe_h(spark, sf_dir):
    rows = track(spark, sf_dir)
    for h in (1, 5, 10):
        rows = metrics.with_relative_error(rows, h).withColumnRenamed("rpe", f"d{h}")
    return rows.groupBy("uav_id").agg(*(r6(F.sqrt(F.avg(F.col(f"d{h}") * F.col(f"d{h}")))).alias(f"rpe_{h}") for h in (1, 5, 10)))


_SLOPE = "CASE WHEN lag({c}) OVER w IS NULL THEN lead({c}) OVER w - {c} WHEN lead({c}) OVER w IS NULL THEN {c} - lag({c}) OVER w ELSE (lead({c}) OVER w - lag({c}) OVER w) / 2e0 END"


@plans(f"""WITH {TRACK_SQL}, s AS (SELECT *, {_SLOPE.format(c='gx')} AS tx, {_SLOPE.format(c='gy')} AS ty FROM track WINDOW w AS (PARTITION BY uav_id ORDER BY t_idx)),
  u AS (SELECT *, greatest(1e-6, sqrt(tx * tx + ty * ty)) AS size FROM s),
  e AS (SELECT uav_id, ((px - gx) * tx + (py - gy) * ty) / size AS along, ((py - gy) * tx - (px - gx) * ty) / size AS across FROM u)
  SELECT uav_id, round(sqrt(avg(along * along)), 6) + 0 AS along_rmse, round(sqrt(avg(across * across)), 6) + 0 AS cross_rmse, round(avg(across), 6) + 0 AS cross_bias FROM e GROUP BY uav_id""")
def along_cross(spark, sf_dir):
    rows = metrics.along_cross(track(spark, sf_dir))
    return rows.groupBy("uav_id").agg(r6(F.sqrt(F.avg(F.col("along") * F.col("along")))).alias("along_rmse"), r6(F.sqrt(F.avg(F.col("across") * F.col("across")))).alias("cross_rmse"), r6(F.avg("across")).alias("cross_bias"))


def _jerk_sql(p):
    return " + ".join(f"pow(lead({p}{a}, 3) OVER w - 3 * lead({p}{a}, 2) OVER w + 3 * lead({p}{a}, 1) OVER w - {p}{a}, 2)" for a in "xyz")


@plans(f"""WITH {TRACK_SQL}, j AS (SELECT uav_id, sqrt({_jerk_sql('p')}) AS jp, sqrt({_jerk_sql('g')}) AS jg FROM track WINDOW w AS (PARTITION BY uav_id ORDER BY t_idx))
  SELECT uav_id, round(avg(jp), 6) + 0 AS jerk, round(avg(jg), 6) + 0 AS jerk_truth, round(CASE WHEN avg(jg) > 1e-9 THEN avg(jp) / avg(jg) END, 6) + 0 AS jerk_ratio FROM j GROUP BY uav_id""")
def jerk(spark, sf_dir):
    rows = metrics.with_jerk(metrics.with_jerk(track(spark, sf_dir), ("px", "py", "pz"), "jp"), ("gx", "gy", "gz"), "jg")
    out = rows.groupBy("uav_id").agg(F.avg("jp").alias("jp"), F.avg("jg").alias("jg"))
    return out.select("uav_id", r6(F.col("jp")).alias("jerk"), r6(F.col("jg")).alias("jerk_truth"), r6(F.when(F.col("jg") > 1e-9, F.col("jp") / F.col("jg"))).alias("jerk_ratio"))


@plans(f"""WITH {TRACK_SQL}, p AS (SELECT a.uav_id, a.t_idx, b.t_idx AS u_idx, sqrt(pow(a.gx - b.px, 2) + pow(a.gy - b.py, 2)) AS d FROM track a JOIN track b USING (uav_id)),
  x AS (SELECT uav_id, max(d) AS there FROM (SELECT uav_id, t_idx, min(d) AS d FROM p GROUP BY 1, 2) GROUP BY 1), y AS (SELECT uav_id, max(d) AS back FROM (SELECT uav_id, u_idx, min(d) AS d FROM p GROUP BY 1, 2) GROUP BY 1)
  SELECT uav_id, round(greatest(there, back), 6) + 0 AS hausdorff FROM x JOIN y USING (uav_id)""")
def hausdorff(spark, sf_dir):
    return metrics.hausdorff(track(spark, sf_dir)).select("uav_id", r6(F.col("hausdorff")).alias("hausdorff"))


def _path_sql(name, join, by):
    """Row by row through the matrix of distances; a row is a list."""
    return f"""WITH RECURSIVE {TRACK_SQL},
  l AS (SELECT uav_id, list([gx, gy] ORDER BY t_idx) AS g, list([px, py] ORDER BY t_idx) AS p FROM track GROUP BY uav_id),
  r(uav_id, g, p, i, d) AS (
    SELECT uav_id, g, p, 0::BIGINT, list_concat([0e0], list_transform(p, lambda x: 'infinity'::DOUBLE)) FROM l
    UNION ALL
    SELECT uav_id, g, p, i + 1, list_reduce(
      list_concat([['infinity'::DOUBLE]], list_transform(p, lambda x, j: [sqrt(pow(x[1] - g[i + 1][1], 2) + pow(x[2] - g[i + 1][2], 2)), d[j + 1], d[j]])),
      lambda a, x: list_append(a, {join.format(cost='x[1]', way='least(a[-1], x[2], x[3])')}))
    FROM r WHERE i < len(g))
  SELECT uav_id, round(d[-1]{by}, 6) + 0 AS {name} FROM r WHERE i = len(g)"""


@plans(_path_sql("dtw", "{cost} + {way}", " / greatest(len(g), len(p))"))
def dtw(spark, sf_dir):
    return paths.path_distances(track(spark, sf_dir)).select("uav_id", r6(F.col("dtw")).alias("dtw"))


@plans(_path_sql("frechet", "greatest({cost}, {way})", ""))
def frechet(spark, sf_dir):
    return paths.path_distances(track(spark, sf_dir)).select("uav_id", r6(F.col("frechet")).alias("frechet"))


_RMSE = f"e AS (SELECT uav_id, sqrt(avg(d * d)) AS rmse, avg(d) AS mae FROM (SELECT uav_id, {_D} AS d FROM track) GROUP BY uav_id)"


def _rmse(spark, sf_dir):
    rows = track(spark, sf_dir)
    return rows.withColumn("d", metrics.distance3(rows)).groupBy("uav_id").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.avg("d").alias("mae"))


@plans(f"WITH {TRACK_SQL}, {_RMSE} SELECT count(*) AS n, round(avg(rmse), 6) + 0 AS mean_rmse, round(median(rmse), 6) + 0 AS median_rmse, round(stddev_samp(rmse), 6) + 0 AS std_rmse FROM e")
def eval_summary(spark, sf_dir):
    return _rmse(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("rmse")).alias("mean_rmse"), r6(F.median("rmse")).alias("median_rmse"), r6(F.stddev_samp("rmse")).alias("std_rmse"))


@plans(f"WITH {TRACK_SQL}, {_RMSE} SELECT uav_id, round(rmse, 6) + 0 AS rmse, round(mae, 6) + 0 AS mae FROM e ORDER BY e.rmse DESC, uav_id LIMIT 20")
def worst_n(spark, sf_dir):
    return _rmse(spark, sf_dir).orderBy(F.desc("rmse"), "uav_id").limit(20).select("uav_id", r6(F.col("rmse")).alias("rmse"), r6(F.col("mae")).alias("mae"))


@plans(f"WITH {TRACK_SQL} SELECT uav_id, round(corr({_D}, abs(px)), 6) + 0 AS corr_err_conf, count(*) AS n FROM track GROUP BY uav_id")
def conf_error_corr(spark, sf_dir):
    rows = track(spark, sf_dir)
    return rows.groupBy("uav_id").agg(r6(F.corr(metrics.distance3(rows), F.abs("px"))).alias("corr_err_conf"), F.count(F.lit(1)).alias("n"))


_TURN = "degrees(atan2({p}x - lag({p}x) OVER w, {p}y - lag({p}y) OVER w))"


@plans(f"""WITH {TRACK_SQL}, b AS (SELECT uav_id, {_TURN.format(p='p')} - {_TURN.format(p='g')} AS turn FROM track WINDOW w AS (PARTITION BY uav_id ORDER BY t_idx)),
  e AS (SELECT uav_id, fmod(fmod(turn + 180e0, 360e0) + 360e0, 360e0) - 180e0 AS off FROM b WHERE turn IS NOT NULL)
  SELECT uav_id, round(avg(abs(off)), 6) + 0 AS mae, round(sqrt(avg(off * off)), 6) + 0 AS rmse, round(max(abs(off)), 6) + 0 AS max_off FROM e GROUP BY uav_id""")
def bearing_error(spark, sf_dir):
    w = Window.partitionBy("uav_id").orderBy("t_idx")
    course = lambda p: F.degrees(F.atan2(F.col(f"{p}x") - F.lag(f"{p}x").over(w), F.col(f"{p}y") - F.lag(f"{p}y").over(w)))
    rows = track(spark, sf_dir).withColumn("off", geo.angle_difference(course("p"), course("g"))).where("off IS NOT NULL")
    return rows.groupBy("uav_id").agg(r6(F.avg(F.abs("off"))).alias("mae"), r6(F.sqrt(F.avg(F.col("off") * F.col("off")))).alias("rmse"), r6(F.max(F.abs("off"))).alias("max_off"))


_MU, _SD = [0.1 * k for k in range(8)], [1.0 + 0.5 * k for k in range(8)]


@plans("""WITH x AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
  SELECT vec_id, len(list_resize(e, 70, 0e0)) AS long_size, round(list_sum(list_resize(e, 70, 0e0)), 6) + 0 AS long_sum, round(list_sum(e[1:10]), 6) + 0 AS short_sum,
    list_transform(e[1:10], lambda v, i: round(CASE WHEN i <= 8 THEN (v - 0.1e0 * (i - 1)) / (1e0 + 0.5e0 * (i - 1)) ELSE v END, 6) + 0) AS scaled, list_transform(e[1:10], lambda v: round(v, 6) + 0) AS back FROM x""")
def vector_scaling(spark, sf_dir):
    from ..functions import vectors
    from ..sources.tables import table

    e = F.col("embedding").cast("array<double>")
    short, total = vectors.fit_length(e, 10), lambda x: r6(F.aggregate(x, F.lit(0.0), lambda a, v: a + v))
    z = vectors.scaled(short, _MU, _SD)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(vectors.fit_length(e, 70)).cast("long").alias("long_size"), total(vectors.fit_length(e, 70)).alias("long_sum"), total(short).alias("short_sum"),
        F.transform(z, r6).alias("scaled"), F.transform(vectors.unscaled(z, _MU, _SD), r6).alias("back"),
    )


@plans(f"""WITH {CONF_SQL}, h AS (SELECT *, {_HOUR} AS hour FROM conf),
  g AS (SELECT uav_id, hour, lat, confidence FROM h WHERE modality = 'gps' QUALIFY row_number() OVER (PARTITION BY uav_id, hour ORDER BY us DESC, event_id DESC) = 1),
  r AS (SELECT uav_id, hour, lat, confidence FROM h WHERE modality = 'radar' QUALIFY row_number() OVER (PARTITION BY uav_id, hour ORDER BY us DESC, event_id DESC) = 1)
  SELECT count(*) AS n, round(avg(abs(g.lat - r.lat) * 111000e0), 5) + 0 AS mean_gap_m, round(max(abs(g.lat - r.lat) * 111000e0), 5) + 0 AS max_gap_m, round(corr(abs(g.lat - r.lat), g.confidence), 6) + 0 AS corr_gap_conf FROM g JOIN r USING (uav_id, hour)""")
def sensor_gap_report(spark, sf_dir):
    rows = confident(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / (3600 * MICROS)))
    side = lambda m: asof.last_wins(rows.where(F.col("modality") == m).select("uav_id", "hour", "us", "event_id", "lat", "confidence"), ["uav_id", "hour"], "us", "event_id").select("uav_id", "hour", F.col("lat").alias(f"lat_{m}"), F.col("confidence").alias(f"confidence_{m}"))
    both = side("gps").join(side("radar"), ["uav_id", "hour"]).withColumn("gap", F.abs(F.col("lat_gps") - F.col("lat_radar")))
    metres = F.col("gap") * geo.METRES_PER_DEGREE
    return both.agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg(metres), 5) + 0.0).alias("mean_gap_m"), (F.round(F.max(metres), 5) + 0.0).alias("max_gap_m"), r6(F.corr("gap", "confidence_gps")).alias("corr_gap_conf"))


_GAP = "sqrt(pow(radians(lon - t_lon) * cos(radians(lat0)) * 6378137e0, 2) + pow(radians(lat - t_lat) * 6378137e0, 2) + pow(alt - t_alt, 2))"


@plans(f"""WITH {NEAR_SQL}, ref AS (SELECT uav_id, arg_min(lat, us) AS lat0 FROM t GROUP BY uav_id),
  d AS (SELECT near.uav_id, modality, {_GAP} AS d FROM near JOIN ref ON near.uav_id = ref.uav_id WHERE abs(us - t_us) <= {HOURS6}::BIGINT AND lat IS NOT NULL AND lon IS NOT NULL AND alt IS NOT NULL)
  SELECT uav_id, modality, count(*) AS n, round(sqrt(avg(d * d)), 3) + 0 AS rmse, round(avg(d), 3) + 0 AS mae, round(quantile_cont(d, 0.5), 3) + 0 AS medae, round(max(d), 3) + 0 AS max_err FROM d GROUP BY uav_id, modality""")
def modality_errors(spark, sf_dir):
    """Each sensor's errors against the nearest truth, in the plane about the object's first truth row."""
    seen = sensed(spark, sf_dir).where("lat IS NOT NULL AND lon IS NOT NULL AND alt IS NOT NULL")
    known = truth(spark, sf_dir)
    first = known.groupBy("uav_id").agg(F.min_by(F.struct("lat", "lon", "alt"), "us").alias("o"))
    near = asof.nearest(seen, known, "uav_id", "us", POS, HOURS6).join(first, "uav_id")
    plane = lambda p: geo.enu(*(F.col(p + c) for c in POS), *(F.col(f"o.{c}") for c in POS))
    d = geo.norm(*(a - b for a, b in zip(plane(""), plane("t_"), strict=True)))
    distances = saved(near.select("uav_id", "modality", d.alias("d")), "distances")
    out = metrics.error_stats(distances, ["uav_id", "modality"], "d", F.count(F.lit(1)).alias("n"))
    return out.select("uav_id", "modality", "n", *((F.round(c, 3) + 0.0).alias(c) for c in ("rmse", "mae", "medae", "max_err")))


def _own(name, columns):
    return f"SELECT uav_id, {columns} FROM ({plans.sql[name]})"


_EVALUATED = {"error_stats": "rmse, mae, medae, p90, p95, max_err", "ade_fde": "ade, fde, ade_xy, fde_xy", "boundary_rmse": "head_rmse, tail_rmse", "outlier_ratio": "over_20, over_25, over_30", "rpe_h": "rpe_1, rpe_5, rpe_10", "along_cross": "along_rmse, cross_rmse, cross_bias", "jerk": "jerk, jerk_truth, jerk_ratio", "conf_error_corr": "corr_err_conf, n"}
_COVERED = f"""(WITH {TRACK_SQL}, {_WIN}, c AS (SELECT t.uav_id, t.t_idx, count(w.start) AS cover, any_value(t.len) AS len FROM tl t LEFT JOIN win w USING (uav_id, t_idx) GROUP BY 1, 2)
  SELECT uav_id, greatest(0, (max(len) - {W_SIZE}) // {W_STRIDE} + 1)::BIGINT AS windows, round(avg(cover) FILTER (t_idx < 20), 6) + 0 AS head_cover, round(avg(cover) FILTER (t_idx >= len - 20), 6) + 0 AS tail_cover FROM c GROUP BY uav_id)"""


# Errors in the plane and in height, and each sensor's own, by name of the column.
_STATS = {"rmse": "sqrt(avg({d} * {d}))", "mae": "avg({d})", "medae": "quantile_cont({d}, 0.5)", "p90": "quantile_cont({d}, 0.9)", "p95": "quantile_cont({d}, 0.95)", "max_err": "max({d})"}
_PARTS = {"xy": "sqrt(pow(px - gx, 2) + pow(py - gy, 2))", "z": "abs(pz - gz)"}
_PART_NAMES = [f"{p}_{n}" for p in _PARTS for n in _STATS]
_SENSORS = ("gps", "radar", "fiveg", "tdoa")
_SENSOR_STATS = ("rmse", "mae", "medae", "max_err")
_SENSOR_NAMES = [f"{m}_{n}" for m in _SENSORS for n in _SENSOR_STATS]
_PART_SQL = f"(WITH {TRACK_SQL} SELECT uav_id, {', '.join(f'round({x.format(d=d)}, 6) + 0 AS {p}_{n}' for p, d in _PARTS.items() for n, x in _STATS.items())} FROM track GROUP BY uav_id)"
_SENSOR_SQL = f"(SELECT uav_id, {', '.join(f"max({n}) FILTER (modality = '{m}') AS {m}_{n}" for m in _SENSORS for n in _SENSOR_STATS)} FROM ({plans.sql['modality_errors']}) GROUP BY uav_id)"
_JOINED = [*(f"({_own(n, c)})" for n, c in _EVALUATED.items()), _COVERED, _PART_SQL, *(f"({plans.sql[n]})" for n in ("hausdorff", "dtw", "frechet"))]


@plans(f"SELECT * FROM {_JOINED[0]} " + " ".join(f"JOIN {part} USING (uav_id)" for part in _JOINED[1:]) + f" LEFT JOIN {_SENSOR_SQL} USING (uav_id)")
def evaluation_rows(spark, sf_dir):
    """A row with all metrics of each object, those of its sensors where it has
    any included: every track is sorted once for its steps, and all errors'
    quantiles are one pass over ranks."""
    rows = metrics.along_cross(windows.with_length(track(spark, sf_dir), "uav_id"))
    for h in (1, 5, 10):
        rows = metrics.with_relative_error(rows, h).withColumnRenamed("rpe", f"d{h}")
    rows = metrics.with_jerk(metrics.with_jerk(rows, ("px", "py", "pz"), "jp"), ("gx", "gy", "gz"), "jg")
    rows = rows.withColumns({"d": metrics.distance3(rows), "d2": geo.norm(F.col("px") - F.col("gx"), F.col("py") - F.col("gy"))})
    cover = windows.covering(F.col("t_idx"), F.col("length"), W_SIZE, W_STRIDE)
    k = F.least(F.lit(20), F.col("length"))
    head, tail = F.col("t_idx") < k, F.col("t_idx") >= F.col("length") - k
    square = lambda c: F.col(c) * F.col(c)
    rms = lambda c, keep=F.lit(True): F.sqrt(F.avg(F.when(keep, square(c))))
    made = {
        "ade": F.avg("d"), "fde": F.max_by("d", "t_idx"), "ade_xy": F.avg("d2"), "fde_xy": F.max_by("d2", "t_idx"), "head_rmse": rms("d", head), "tail_rmse": rms("d", tail),
        **{f"over_{round(t * 100)}": F.avg((F.col("d") > t).cast("int")) for t in (0.2, 0.25, 0.3)}, **{f"rpe_{h}": rms(f"d{h}") for h in (1, 5, 10)},
        "along_rmse": rms("along"), "cross_rmse": rms("across"), "cross_bias": F.avg("across"), "jerk": F.avg("jp"), "jerk_truth": F.avg("jg"), "jerk_ratio": F.when(F.avg("jg") > 1e-9, F.avg("jp") / F.avg("jg")),
        "corr_err_conf": F.corr("d", F.abs("px")), "head_cover": F.avg(F.when(F.col("t_idx") < 20, cover)), "tail_cover": F.avg(F.when(F.col("t_idx") >= F.col("length") - 20, cover)),
    }
    whole = windows.number_of(F.max("length"), W_SIZE, W_STRIDE)
    rows = saved(rows, "evaluated")  # read by ranks again
    out = rows.groupBy("uav_id").agg(F.count(F.lit(1)).alias("n"), whole.alias("windows"), *(c.alias(n) for n, c in made.items()))
    kinds = {"": F.col("d"), "xy_": F.col("d2"), "z_": F.abs(F.col("pz") - F.col("gz"))}
    errors = rows.select("uav_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), d.alias("d")) for k, d in kinds.items()))).alias("e")).select("uav_id", "e.*")
    stats = metrics.error_stats(errors, ["uav_id", "kind"], "d")
    out = out.join(stats.groupBy("uav_id").agg(*(F.max(F.when(F.col("kind") == k, F.col(n))).alias(k + n) for k in kinds for n in _STATS)), "uav_id")
    for more in (metrics.hausdorff(track(spark, sf_dir)), paths.path_distances(track(spark, sf_dir))):
        out = out.join(more, "uav_id")
    sensors = modality_errors(spark, sf_dir).groupBy("uav_id").agg(*(F.max(F.when(F.col("modality") == m, F.col(n))).alias(f"{m}_{n}") for m in _SENSORS for n in _SENSOR_STATS))
    out = out.join(sensors, "uav_id", "left")
    return out.select("uav_id", "n", "windows", *(r6(F.col(c)).alias(c) for c in out.columns if c not in ("uav_id", "n", "windows")))


_STEP_ORDER = "CASE modality WHEN 'gps' THEN 0 WHEN 'radar' THEN 1 WHEN 'fiveg' THEN 2 ELSE 3 END"


@plans(f"""WITH {OBS_SQL}, h AS (SELECT *, {_HOUR} AS hour, event_id % 4 = 0 AS missing, event_id % 7 > 0 AS placed FROM obs WHERE modality <> 'truth'),
  own AS (SELECT * FROM h WHERE placed QUALIFY row_number() OVER (PARTITION BY uav_id, hour ORDER BY missing, {_STEP_ORDER}, us DESC, event_id DESC) = 1),
  steps AS (SELECT DISTINCT uav_id, hour FROM h),
  j AS (SELECT steps.*, lat, lon, alt, CASE WHEN own.event_id IS NULL THEN 0e0 ELSE q1 END AS speed, CASE WHEN own.event_id IS NULL THEN 'none' WHEN missing THEN 'flagged' ELSE 'valid' END AS choice FROM steps LEFT JOIN own USING (uav_id, hour)),
  f AS (SELECT uav_id, hour, speed, choice, last_value(lat IGNORE NULLS) OVER w AS lat, last_value(lon IGNORE NULLS) OVER w AS lon, last_value(alt IGNORE NULLS) OVER w AS alt FROM j WINDOW w AS (PARTITION BY uav_id ORDER BY hour ROWS UNBOUNDED PRECEDING))
  SELECT uav_id, hour, choice, round(speed, 6) + 0 AS speed, round(lat, 7) + 0 AS lat, round(lon, 7) + 0 AS lon, round(alt, 6) + 0 AS alt FROM f WHERE lat IS NOT NULL""")
def locf_truth_rows(spark, sf_dir):
    """Truth rows out of sensors: the best unflagged one of a step, else the best of all, else the last position."""
    hour = F.floor(F.col("us") / (3600 * MICROS))
    rows = sensed(spark, sf_dir).withColumns({"hour": hour, "speed": F.col("q1"), "missing": F.col("event_id") % 4 == 0})
    rows = rows.withColumns({c: F.when(F.col("event_id") % 7 > 0, F.col(c)) for c in POS})
    made = fusion.truth_rows(rows, "hour", F.col("missing"), ("gps", "radar", "fiveg", "tdoa"), ["us", "event_id"], ["speed"])
    return made.select("uav_id", "hour", "choice", r6(F.col("speed")).alias("speed"), (F.round("lat", 7) + 0.0).alias("lat"), (F.round("lon", 7) + 0.0).alias("lon"), r6(F.col("alt")).alias("alt"))


_SUMS = ", ".join(f"sum(w * {a}) AS s{a}" for a in "enu")
_LESS = "least(1e0, cover / 3e0)"


def _blend_sql(out, at, x, where):
    return f"CASE WHEN {where} AND NOT ({_LESS} >= 0.999e0 OR coalesce(w, 0e0) <= 1e-9) THEN {_LESS} * {x} + (1e0 - {_LESS}) * {at} ELSE {x} END AS {out}"


@plans(f"""WITH {CONF_SQL}, t AS (SELECT * FROM obs WHERE modality = 'truth'), {_TWO.format(o='conf')},
  ref AS (SELECT uav_id, arg_min(lat, us) AS lat0, arg_min(lon, us) AS lon0, arg_min(alt, us) AS alt0 FROM t GROUP BY uav_id),
  nodes AS (SELECT near.uav_id, t_us AS us, confidence, (0.3e0 + 0.7e0 * confidence) * {_PRIOR} AS w, radians(lon - lon0) * cos(radians(lat0)) * 6378137e0 AS e, radians(lat - lat0) * 6378137e0 AS n, alt - alt0 AS u
    FROM near JOIN ref ON near.uav_id = ref.uav_id WHERE abs(us - t_us) <= {HOURS6}::BIGINT AND lat IS NOT NULL AND lon IS NOT NULL AND alt IS NOT NULL),
  sums AS (SELECT uav_id, us, count(*) AS k, sum(confidence) AS c, {_SUMS}, sum(w) AS w FROM nodes GROUP BY 1, 2),
  times AS (SELECT uav_id, us, row_number() OVER (PARTITION BY uav_id ORDER BY us) - 1 AS t_idx, count(*) OVER (PARTITION BY uav_id) AS len FROM (SELECT DISTINCT uav_id, us FROM t)),
  steps AS (SELECT times.*, k, c, se, sn, su, w, se / w AS e, sn / w AS n, su / w AS u FROM times LEFT JOIN sums USING (uav_id, us)),
  d AS (SELECT steps.*, s.start, t_idx - s.start AS pos FROM steps, LATERAL (SELECT unnest(generate_series(0, len - {W_SIZE}, {W_STRIDE})) AS start) s WHERE t_idx BETWEEN s.start AND s.start + {W_SIZE - 1}),
  whole AS (SELECT uav_id, start, greatest(1e-3, ln(1e0 + sum(k)) * (0.3e0 + 0.7e0 * sum(c) / sum(k))) AS quality, sum(se) / sum(w) AS we, sum(sn) / sum(w) AS wn, sum(su) / sum(w) AS wu FROM d GROUP BY 1, 2 HAVING sum(k) > 0),
  p AS (SELECT uav_id, t_idx, greatest(1e-6, {_TAPER} * quality) AS g, coalesce(e, we) AS pe, coalesce(n, wn) AS pn, coalesce(u, wu) AS pu FROM d JOIN whole USING (uav_id, start)),
  m AS (SELECT uav_id, t_idx, count(*) AS cover, sum(g * pe) / (sum(g) + 1e-6) AS pe, sum(g * pn) / (sum(g) + 1e-6) AS pn, sum(g * pu) / (sum(g) + 1e-6) AS pu FROM p GROUP BY 1, 2),
  z AS (SELECT steps.*, coalesce(cover, 0) AS cover, coalesce(pe, 0e0) AS pe, coalesce(pn, 0e0) AS pn, coalesce(pu, 0e0) AS pu FROM steps LEFT JOIN m USING (uav_id, t_idx)),
  h AS (SELECT z.* EXCLUDE (pe, pn, pu), {', '.join(_blend_sql('p' + a, a, 'p' + a, 't_idx < 20') for a in 'enu')} FROM z),
  b AS (SELECT h.* EXCLUDE (pe, pn, pu), {', '.join(_blend_sql('p' + a, a, 'p' + a, 't_idx >= len - 20') for a in 'enu')} FROM h)
  SELECT b.uav_id, us, cover, round(lat0 + degrees(pn / 6378137e0), 7) + 0 AS lat, round(lon0 + degrees(pe / (cos(radians(lat0)) * 6378137e0)), 7) + 0 AS lon, round(alt0 + pu, 5) + 0 AS alt FROM b JOIN ref ON b.uav_id = ref.uav_id""")
def inference_pipeline(spark, sf_dir):
    """All steps from observations to fused positions, with the observations' means in the model's place."""
    fused = inference.fuse(confident(spark, sf_dir), truth(spark, sf_dir), HOURS6, W_SIZE, W_STRIDE)
    return fused.select("uav_id", "us", "cover", *((F.round(c, d) + 0.0).alias(c) for c, d in (("lat", 7), ("lon", 7), ("alt", 5))))


_HOT = ", ".join(f"(m = '{m}')::INT::DOUBLE" for m in fusion.MODALITIES)
_ENU = [f"round({x}, 4) + 0" for x in ("radians(lon - 5e0) * cos(radians(45e0)) * 6378137e0", "radians(lat - 45e0) * 6378137e0", "alt - 100e0")]
_CLIP = "greatest(0e0, least(1e0, {x}))"


def _rounded(feature):
    return F.transform(feature, lambda x, i: F.when(i < 3, F.round(x, 4)).otherwise(F.round(x, 9)) + 0.0)


@plans(f"""WITH {CONF_SQL}, f AS (SELECT *, CASE modality WHEN 'tdoa' THEN 'acoustic' ELSE modality END AS m, event_id % 7 > 0 AS placed FROM conf)
  SELECT event_id, [{', '.join(f'CASE WHEN placed THEN {x} ELSE 0e0 END' for x in _ENU)}, round(q1 / 10e0, 9) + 0, round(q2 / 10e0, 9) + 0, 0e0, round(q1 / 7e0, 9) + 0, round({_CLIP.format(x='confidence')}, 9) + 0, round((event_id % 20) / 19e0, 9) + 0,
    placed::INT::DOUBLE, (event_id % 4 <> 0)::INT::DOUBLE, CASE WHEN m = 'acoustic' THEN (q1 > 50)::INT::DOUBLE ELSE 0e0 END, CASE WHEN m = 'acoustic' THEN round({_CLIP.format(x='(q1 - 35e0) / 75e0')}, 9) + 0 ELSE 0e0 END,
    CASE WHEN m = 'acoustic' THEN round({_CLIP.format(x='q2 / 80e0')}, 9) + 0 ELSE 0e0 END, {_HOT}] AS feature FROM f""")
def full_features(spark, sf_dir):
    rows = confident(spark, sf_dir).withColumn("modality", F.when(F.col("modality") == "tdoa", "acoustic").otherwise(F.col("modality")))
    rows = rows.withColumns({c: F.when(F.col("event_id") % 7 > 0, F.col(c)) for c in POS})
    rows = rows.withColumns({"vx": F.col("q1") / 10.0, "vy": F.col("q2") / 10.0, "vz": F.lit(None).cast("double"), "speed": F.col("q1") / 7.0, "missing_flag": (F.col("event_id") % 4 == 0).cast("int"), "detected_flag": (F.col("q1") > 50).cast("int"), "spl_db": F.col("q1"), "acoustic_energy": F.col("q2") / 80.0})
    feature = fusion.full_feature(F.lit(45.0), F.lit(5.0), F.lit(100.0), (F.col("event_id") % 20) / 19.0)
    return rows.select("event_id", _rounded(feature).alias("feature"))


@plans(f"""WITH {CONF_SQL}, {_T.split(', s AS')[0].replace('SELECT *', 'SELECT *, q1 AS t_speed')}, {_TWO.format(o='conf').replace('lo.alt AS lo_alt', 'lo.alt AS lo_alt, lo.q1 AS lo_q').replace('hi.alt AS hi_alt', 'hi.alt AS hi_alt, hi.q1 AS hi_q').replace('SELECT *, CASE', 'SELECT *, CASE WHEN lo_us IS NULL OR hi_us - us < us - lo_us THEN hi_q ELSE lo_q END AS tq, modality AS m, CASE', 1)}
  SELECT event_id, [{', '.join(_ENU)}, round(tq / 10e0, 9) + 0, 0e0, round(-tq / 20e0, 9) + 0, round(tq / 7e0, 9) + 0, round(confidence, 9) + 0, round((event_id % 20) / 19e0, 9) + 0, {_HOT}][1:12] AS feature FROM near WHERE abs(us - t_us) <= {HOURS6}::BIGINT""")
def legacy_features(spark, sf_dir):
    near = asof.nearest(confident(spark, sf_dir), truth(spark, sf_dir), "uav_id", "us", ["q1"], HOURS6)
    rows = near.withColumns({"t_vx": F.col("t_q1") / 10.0, "t_vy": F.lit(0.0), "t_vz": -F.col("t_q1") / 20.0, "t_speed": F.col("t_q1") / 7.0})
    return rows.select("event_id", _rounded(fusion.legacy_feature(F.lit(45.0), F.lit(5.0), F.lit(100.0), (F.col("event_id") % 20) / 19.0, 12)).alias("feature"))


_DENSE = ("radar", "fiveg", "tdoa")
_STEPS = 20
_SLOT = ", ".join(_ENU)


@plans(f"""WITH {CONF_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY uav_id, modality ORDER BY us, event_id) - 1 AS t FROM conf WHERE modality IN {_DENSE}),
  x AS (SELECT uav_id, t, modality AS m, [{_SLOT}, round(q1 / 7e0, 9) + 0, round(confidence, 9) + 0, round((t % {_STEPS}) / {_STEPS - 1}e0, 9) + 0, (modality = 'radar')::INT::DOUBLE, (modality = 'fiveg')::INT::DOUBLE, (modality = 'tdoa')::INT::DOUBLE] AS f FROM n),
  p AS (SELECT uav_id, t, max(f) FILTER (m = 'radar') AS radar, max(f) FILTER (m = 'fiveg') AS fiveg, max(f) FILTER (m = 'tdoa') AS tdoa FROM x GROUP BY 1, 2 HAVING count(*) = 3)
  SELECT * FROM p""")
def serve_tensor(spark, sf_dir):
    """All rows of three sensors side by side, as far as an object has them of each: [step, sensor, feature], 20 steps a tensor."""
    rows = confident(spark, sf_dir).where(F.col("modality").isin(*_DENSE)).withColumn("who", F.struct("uav_id", "modality"))
    rows = running.with_number(rows, "who", ["us", "event_id"], "t", asof.WIDTH)
    place = geo.enu(F.col("lat"), F.col("lon"), F.col("alt"), F.lit(45.0), F.lit(5.0), F.lit(100.0))
    feature = F.array(*place, F.col("q1") / 7.0, F.col("confidence"), F.col("t") % _STEPS / float(_STEPS - 1), *((F.col("modality") == m).cast("double") for m in _DENSE))
    cells = rows.select("uav_id", "t", "modality", _rounded(feature).alias("f"))
    return cells.groupBy("uav_id", "t").agg(*(F.max(F.when(F.col("modality") == m, F.col("f"))).alias(m) for m in _DENSE)).dropna()


@plans(f"""WITH {OBS_SQL} SELECT uav_id, us // 86400000000::BIGINT AS day, list(us ORDER BY us, event_id) AS times, list(round(lat, 7) + 0 ORDER BY us, event_id) AS lats, list(round(alt, 6) + 0 ORDER BY us, event_id) AS alts FROM obs WHERE modality = 'truth' GROUP BY 1, 2""")
def columns_per_key(spark, sf_dir):
    """Each object's truth as arrays, a day at a time, so that no row holds all of an object."""
    day = F.floor(F.col("us") / (86400 * MICROS)).alias("day")
    rows = truth(spark, sf_dir).groupBy("uav_id", day).agg(F.array_sort(F.collect_list(F.struct("us", "event_id", "lat", "alt"))).alias("r"))
    column = lambda c, d: F.transform(F.col(f"r.{c}"), lambda x: F.round(x, d) + 0.0)
    return rows.select("uav_id", "day", F.col("r.us").alias("times"), column("lat", 7).alias("lats"), column("alt", 6).alias("alts"))


_SUMMED = [c for columns in [*_EVALUATED.values(), "windows, head_cover, tail_cover, hausdorff, dtw, frechet", ", ".join(_PART_NAMES + _SENSOR_NAMES)] for c in columns.split(", ") if any(part in c for part in reports.METRIC_PARTS)]


@plans(f"""WITH e AS ({plans.sql['evaluation_rows']}), u AS (UNPIVOT e ON {', '.join(_SUMMED)} INTO NAME metric VALUE x)
  SELECT metric, round(avg(x), 10) + 0 AS mean, round(median(x), 10) + 0 AS median, round(stddev_samp(x), 10) + 0 AS std FROM u GROUP BY metric""")
def metric_summary(spark, sf_dir):
    """Mean, median and deviation of every column that is a metric by its name."""
    found = reports.metric_summary(evaluation_rows(spark, sf_dir))
    return found.select("metric", *((F.round(n, 10) + 0.0).alias(n) for n in ("mean", "median", "std")))


@plans(f"""WITH {TRACK_SQL}, {_WIN}, x AS (UNPIVOT (SELECT gx, gy, gz, px, py, pz FROM win) ON gx, gy, gz, px, py, pz INTO NAME axis VALUE v)
  SELECT axis, count(*) AS n, round(avg(v), 6) + 0 AS mu, round(stddev_pop(v) + 1e-6, 6) + 0 AS sigma FROM x GROUP BY axis""")
def norm_stats_windows(spark, sf_dir):
    """Means and deviations over all windows' rows: a row counts once for each window that holds it, which arithmetic tells, so none is made twice."""
    rows = windows.with_length(track(spark, sf_dir), "uav_id")
    rows = rows.withColumn("n", windows.covering(F.col("t_idx"), F.col("length"), W_SIZE, W_STRIDE))
    long = rows.unpivot(["n"], ["gx", "gy", "gz", "px", "py", "pz"], "axis", "v").where("n > 0 AND v IS NOT NULL")
    sums = moments.weighted(long, ["axis"], "v", "n")
    return sums.select("axis", "n", r6(F.col("mean")).alias("mu"), r6(moments.deviation(F.col("m2"), F.col("n")) + 1e-6).alias("sigma"))


@plans(f"""WITH {OBS_SQL} SELECT modality, count(q1) AS n, round(avg(q1), 6) + 0 AS mean, round(stddev_pop(q1), 6) + 0 AS std, round(min(q1), 6) + 0 AS least, round(max(q1), 6) + 0 AS most FROM obs GROUP BY modality""")
def merged_moments(spark, sf_dir):
    """Each sensor's moments from states stored by ten-day batches, one of them added again."""
    rows = obs(spark, sf_dir)
    store = moments.MomentStore(spark, scratch_path(spark, "moments"), ["modality"])
    third = F.floor((F.col("us") - 1704067200 * MICROS) / (10 * 86400 * MICROS))
    parts = {"early": rows.where(third < 1), "middle": rows.where(third == 1), "late": rows.where((third > 1) | third.isNull())}
    for name, part in [*parts.items(), ("early", parts["early"])]:
        store.add(name, part, F.col("q1"))
    out = store.totals()
    return out.select("modality", "n", r6(F.col("mean")).alias("mean"), r6(moments.deviation(F.col("m2"), F.col("n"))).alias("std"), r6(F.col("least")).alias("least"), r6(F.col("most")).alias("most"))
