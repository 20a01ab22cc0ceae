"""Queries that run as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import MICROS, OBS_SQL, as_obs, micros, modality, truth
from ..streaming import matcher, streams
from .base import Plans, r6
from .matching import EMA_SQL, FRAMES_SQL, sides
from .tracks import HOURS6, NEAR_SQL, POS

plans = Plans()


@plans("""WITH w AS (SELECT epoch_us(ts) // (6 * 3600 * 1000000::BIGINT) AS k, event_type, value, max(epoch_us(ts)) OVER () AS latest FROM events)
  SELECT k * 6 * 3600 * 1000000::BIGINT AS start_us, event_type, count(*) AS n, round(avg(value), 6) + 0 AS mean_value FROM w GROUP BY k, event_type, latest HAVING (k + 1) * 6 * 3600 * 1000000::BIGINT <= latest - 3600 * 1000000::BIGINT""")
def stream_window_counts(spark, sf_dir):
    """Windows that the watermark, an hour behind the latest event, has passed."""
    events = streams.table_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    found = streams.run(streams.window_counts(events, "ts", "6 hours", "1 hour", "event_type"), "stream-windows")
    return found.select(F.unix_micros("start").alias("start_us"), "event_type", "n", r6(F.col("mean_value")).alias("mean_value"))


@plans(f"WITH {NEAR_SQL} SELECT event_id, t_us, abs(us - t_us) AS dt FROM near WHERE abs(us - t_us) <= {HOURS6}::BIGINT")
def stream_static_asof(spark, sf_dir):
    events = streams.table_stream(spark, sf_dir, "events").where(F.col("event_type") != "view")
    seen = events.select("event_id", F.col("user_id").alias("uav_id"), micros(F.col("ts")).alias("us"), modality(F.col("event_type")).alias("modality"))
    return streams.aligned(seen, truth(spark, sf_dir), "uav_id", "us", POS, HOURS6, "stream-asof").select("event_id", "t_us", "dt")


@plans(f"{EMA_SQL} SELECT r.event_id, round(tau, 6) + 0 AS tau, sum((q > 0.9e0)::INT) OVER (PARTITION BY r.uav_id ORDER BY r.n ROWS UNBOUNDED PRECEDING)::BIGINT AS votes FROM r JOIN s ON s.event_id = r.event_id")
def stream_thresholds(spark, sf_dir):
    events = streams.table_stream(spark, sf_dir, "events").where(F.col("event_type") != "view")
    seen = events.select(F.col("user_id").alias("uav_id"), micros(F.col("ts")).alias("us"), "event_id", (F.col("value") / 100.0).alias("q"))
    return streams.run(streams.thresholds(seen, "uav_id", ["us", "event_id"], "q"), "stream-thresholds").select("event_id", r6(F.col("tau")).alias("tau"), "votes")


@plans(f"""WITH RECURSIVE {OBS_SQL}, {FRAMES_SQL}, counted AS (SELECT *, count(*) OVER (PARTITION BY id, kind ORDER BY frame, event ROWS UNBOUNDED PRECEDING) AS misses FROM missed)
  SELECT *, misses >= 3 AS abnormal FROM counted WHERE (frame + 1) * 3600 * {MICROS}::BIGINT <= (SELECT max(epoch_us(ts)) FROM events WHERE event_type IN ('click', 'view')) - 3600 * {MICROS}::BIGINT""")
def stream_match_frames(spark, sf_dir):
    """The matcher as a stream, all in one sector: the frames that the watermark, an hour behind, has passed."""
    rows = as_obs(streams.table_stream(spark, sf_dir, "events"), ("click", "view"))
    time = F.timestamp_micros("us").alias("time")
    det, rep = sides(rows.where("modality = 'gps'"), rows.where("modality = 'truth'"), time)
    both = [x.select("time", F.lit("all").alias("sector"), F.lit(side).alias("side"), F.col(side).alias("row"), "id", "lat", "lon", "alt", "vx", "vy", F.col(w).alias("weight")) for x, side, w in ((det, "det", "confidence"), (rep, "rep", "quality"))]
    found = matcher.match_batches(both[0].unionByName(both[1]), "time", 3600, "1 hour", matcher.Settings(size=500), "stream-matches")
    return found.where("kind != 'match'").select("frame", "id", "kind", F.col("row").alias("event"), "misses", (F.col("misses") >= 3).alias("abnormal"))
