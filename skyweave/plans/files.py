"""Round trips through files, JSON lines and requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import confidence, scalar
from ..operators import asof, matching, running
from ..sources import files, ordered, packets, reports
from ..sources.shared import saved, scratch_path
from ..sources.tables import MICROS, OBS_SQL, obs, sensed, truth
from .base import Plans, r6
from .matching import GATE, PAIRS_SQL, sides
from .situations import _ANSWER, _answers
from .tracks import error_stats
from .tracks import plans as tracks

plans = Plans()


@plans(f"""WITH {OBS_SQL} SELECT us / {MICROS}e0 AS timestamp, 'U' || uav_id AS uav_id, lat, lon, floor(q1 / 5e0)::INT AS "Nsat", q2 / 12e0 AS "DOP", CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'FIX' END AS "RTK", NULL::VARCHAR AS scenario_tag
  FROM obs WHERE modality = 'gps'""")
def csv_round_trip(spark, sf_dir):
    """Two folders of CSV with other orders and names of columns, read as one table."""
    rows = obs(spark, sf_dir, ("click",))
    name = F.concat(F.lit("U"), F.col("uav_id").cast("string"))
    kind = F.when(F.col("event_id") % 3 != 0, "FIX")
    base = rows.select("event_id", (F.col("us") / float(MICROS)).alias("timestamp"), name.alias("uav_id"), "lat", "lon", F.floor(F.col("q1") / 5.0).cast("int").alias("Nsat"), (F.col("q2") / 12.0).alias("DOP"), kind.alias("RTK"))
    path = scratch_path(spark, "csv")
    files.write_tracks(base.where("event_id % 2 = 0").drop("event_id"), f"{path}/even")
    odd = base.where("event_id % 2 = 1").withColumn("more", F.lit("x")).select("more", "RTK", "DOP", "lon", "lat", "uav_id", "timestamp", "Nsat")
    odd.withColumnRenamed("uav_id", "id").write.option("header", True).csv(f"{path}/odd")
    read = files.read_csv(spark, [f"{path}/even", f"{path}/odd", f"{path}/none"], "gps")
    return read.select("timestamp", "uav_id", "lat", "lon", "Nsat", "DOP", "RTK", "scenario_tag")


@plans(f"""WITH {_ANSWER}, b AS (SELECT sample_id, answer, 1 AS part FROM answers WHERE sample_id % 3 > 0 UNION ALL SELECT sample_id, 'again ' || coalesce(answer, ''), 2 FROM answers WHERE sample_id % 3 < 2)
  SELECT 'S' || sample_id AS sample_id, arg_max(coalesce(answer, '-'), part) AS answer, count(*) AS lines FROM b WHERE sample_id % 7 > 0 GROUP BY sample_id""")
def jsonl_last_wins(spark, sf_dir):
    """Two batches of JSON lines, one of them written again; the later record of an id counts, and blank ids do not."""
    rows = _answers(spark, sf_dir)
    name = F.when(F.col("sample_id") % 7 > 0, F.concat(F.lit("S"), F.col("sample_id").cast("string"))).otherwise(F.lit(""))
    path = scratch_path(spark, "jsonl")
    first = rows.where("sample_id % 3 > 0").select(name.alias("sample_id"), "answer", F.lit(1).alias("part"))
    second = rows.where("sample_id % 3 < 2").select(name.alias("sample_id"), F.concat(F.lit("again "), F.coalesce("answer", F.lit(""))).alias("answer"), F.lit(2).alias("part"))
    for batch, part in (("1", first), ("2", second), ("1", first)):
        files.write_jsonl(part, path, batch)
    read = files.read_jsonl(spark, f"{path}/batch=*", "sample_id string, answer string, part int").where("sample_id != ''")
    counts = read.groupBy("sample_id").agg(F.count(F.lit(1)).alias("lines"))
    return asof.last_wins(read.select("sample_id", "answer", "part"), ["sample_id"], "part").join(counts, "sample_id").select("sample_id", F.coalesce("answer", F.lit("-")).alias("answer"), "lines")


_PACKETS = f"""g AS (SELECT *, row_number() OVER (PARTITION BY uav_id ORDER BY us, event_id) - 1 AS i FROM obs WHERE modality = 'gps'),
p AS (SELECT * FROM g WHERE i < 20 QUALIFY count(*) OVER (PARTITION BY uav_id) = 20)"""


@plans(f"""WITH {OBS_SQL}, {_PACKETS}
  SELECT uav_id AS request_id, i, CASE WHEN uav_id % 2 = 0 THEN 'U' || uav_id ELSE 'UAV_HTTP' END AS uav_id, CASE WHEN i % 5 = 0 THEN i::DOUBLE ELSE us / {MICROS}e0 END AS timestamp, m.m AS modality,
    CASE WHEN m = 'gps' AND i % 4 > 0 THEN lat END AS lat, CASE WHEN m = 'gps' AND i % 4 > 0 THEN q1 ELSE 0e0 END AS vx,
    CASE m WHEN 'gps' THEN CASE WHEN i % 4 > 0 THEN q2 ELSE 99e0 END WHEN 'radar' THEN 0e0 WHEN 'fiveg' THEN -120e0 WHEN 'tdoa' THEN 50e0 ELSE 1e0 END AS metric
  FROM p, (SELECT unnest(['gps', 'radar', 'fiveg', 'tdoa', 'acoustic']) AS m) m""")
def request_packets(spark, sf_dir):
    """Requests of 20 packets as JSON, some without a time, an id or the sensor, as rows of all sensors."""
    rows = running.with_number(obs(spark, sf_dir, ("click",)), "uav_id", ["us", "event_id"], "i", asof.WIDTH).where("i < 20")
    gps = F.when(F.col("i") % 4 > 0, F.struct("lat", "lon", "alt", F.col("q1").alias("vx"), F.col("q2").alias("DOP")))
    time = F.when(F.col("i") % 5 != 0, F.col("us") / float(MICROS))
    name = F.when(F.col("uav_id") % 2 == 0, F.concat(F.lit("U"), F.col("uav_id").cast("string")))
    packed = rows.groupBy("uav_id").agg(F.array_sort(F.collect_list(F.struct("i", time.alias("timestamp"), name.alias("uav_id"), gps.alias("gps")))).alias("packets")).where(F.size("packets") == 20)
    bodies = packed.select(F.col("uav_id").alias("request_id"), F.to_json(F.struct(F.transform("packets", lambda p: p.dropFields("i")).alias("packets"))).alias("body"))
    made = packets.sensor_rows(bodies)
    key = F.create_map(*(F.lit(x) for pair in {"gps": "DOP", "radar": "E", "fiveg": "RSSI", "tdoa": "e", "acoustic": "n"}.items() for x in pair))
    return made.select("request_id", F.col("i").cast("long").alias("i"), "uav_id", "timestamp", "modality", "lat", "vx", F.try_element_at("metrics", key[F.col("modality")]).cast("double").alias("metric"))


_PHI = "greatest(0e0, least(1e0, {x}))"


@plans(f"""WITH {OBS_SQL}, p AS (SELECT event_id, {_PHI.format(x='q1 / 100e0')} AS a, {_PHI.format(x='(80e0 - q2) / 75e0')} AS b FROM obs WHERE modality <> 'truth')
  SELECT event_id, round(a, 6) + 0 AS only_rt, round(b, 6) + 0 AS only_st, round(0.65e0 * a + 0.35e0 * b, 6) + 0 AS both FROM p""")
def confidence_groups(spark, sf_dir):
    """A group that a spec leaves empty takes the other's value; metrics give way to what is made of them."""
    up, down = confidence.Metric("q1", "pos", "rt", 1.0, 0, 100), confidence.Metric("q2", "neg", "st", 1.0, 5, 80)
    rows = sensed(spark, sf_dir).select("event_id", "q1", "q2")
    out = rows.select("event_id")
    for name, metrics in (("only_rt", (up,)), ("only_st", (down,)), ("both", (up, down))):
        scored = confidence.with_confidence(rows, confidence.Spec(metrics))
        assert {m.name for m in metrics}.isdisjoint(scored.columns)
        out = out.join(scored.select("event_id", r6(F.col("confidence")).alias(name)), "event_id")
    return out


@plans(f"""WITH {OBS_SQL}, n AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' 5G ' WHEN 1 THEN '5g_a' WHEN 2 THEN '5GA' WHEN 3 THEN 'FiveG' WHEN 4 THEN upper(modality) END AS name, modality FROM obs)
  SELECT event_id, CASE WHEN event_id % 6 < 4 THEN 'fiveg' WHEN event_id % 6 = 4 THEN modality END AS key FROM n""")
def modality_names(spark, sf_dir):
    name = F.when(F.col("event_id") % 6 == 0, " 5G ").when(F.col("event_id") % 6 == 1, "5g_a").when(F.col("event_id") % 6 == 2, "5GA").when(F.col("event_id") % 6 == 3, "FiveG").when(F.col("event_id") % 6 == 4, F.upper("modality"))
    return obs(spark, sf_dir).select("event_id", files.modality_key(name).alias("key"))


_TEN = (1704067200 + 10 * 86400) * MICROS
_DAYS = (_TEN, _TEN + 2 * 86400 * MICROS)


@plans(f"""WITH {OBS_SQL}, n AS (SELECT event_id, uav_id, modality, us, row_number() OVER (ORDER BY us NULLS FIRST, uav_id NULLS FIRST, event_id) - 1 AS place FROM obs)
  SELECT event_id, uav_id, modality, place FROM n WHERE us BETWEEN {_DAYS[0]}::BIGINT AND {_DAYS[1]}::BIGINT""")
def sorted_files(spark, sf_dir):
    """All observations stored in one order of time, object and number over 16 files; two days read by the index, with each row's place among all."""
    path = scratch_path(spark, "sorted")
    ordered.write_sorted(obs(spark, sf_dir).select("event_id", "uav_id", "modality", "us"), path, ("us", "uav_id", "event_id"), 16)
    return ordered.read_range(spark, path, "us", *_DAYS, place="place").drop("us")


@plans(f"WITH {OBS_SQL}, {PAIRS_SQL} SELECT frame, det, rep, place, round(distance, 5) + 0 AS distance, round(score, 6) + 0 AS score FROM top")
def match_csv_files(spark, sf_dir):
    """Detections and reports through CSV files of their own kinds, the reports' quality from what the link measured."""
    rows, reports_ = obs(spark, sf_dir, ("click",)), truth(spark, sf_dir)
    det, _ = sides(rows, reports_)
    path = scratch_path(spark, "sides")
    time, number = F.col("frame").cast("double").alias("time"), lambda c: F.col(c).cast("string").alias("id")
    det.select(time, number("det"), "lat", "lon", "alt", "vx", "vy", "confidence").write.option("header", True).csv(f"{path}/det")
    q1, q2 = F.col("q1"), F.col("q2")
    seen = reports_.select(F.floor(F.col("us") / (3600 * MICROS)).cast("double").alias("time"), number("event_id"), "lat", "lon", "alt", (q2 / 10.0).alias("vx"), (q1 / 10.0).alias("vy"))
    link = reports_.select(number("event_id"), (q1 / 5.0).alias("snr"), (q2 - 90.0).alias("rssi"), q1.alias("delay"), (q2 / 100.0).alias("coverage"))
    seen.join(link, "id").write.option("header", True).csv(f"{path}/rep")
    frame, index = F.col("time").cast("long").alias("frame"), lambda n: F.col("id").cast("long").alias(n)
    det = files.read_csv(spark, f"{path}/det", "detected").select(frame, index("det"), "lat", "lon", "alt", "vx", "vy", "confidence")
    quality = scalar.comm_quality(F.col("snr"), F.col("rssi"), F.col("delay"), F.col("coverage"))
    rep = files.read_csv(spark, f"{path}/rep", "reported").select(frame, index("rep"), "lat", "lon", "alt", "vx", "vy", quality.alias("quality"))
    found = matching.candidates(det, rep, GATE)
    return found.select("frame", "det", "rep", "place", (F.round("distance", 5) + 0.0).alias("distance"), r6(F.col("score")).alias("score"))


_ERRORS = ("rmse", "mae", "medae", "p90", "p95", "max_err")


@plans(f"""WITH e AS ({tracks.sql['error_stats']}), w AS (SELECT * FROM e ORDER BY rmse DESC, uav_id LIMIT 20), u AS (UNPIVOT e ON {', '.join(_ERRORS)} INTO NAME metric VALUE x), v AS (UNPIVOT w ON {', '.join(_ERRORS)} INTO NAME metric VALUE x),
    s AS (SELECT metric, avg(x) AS mean, median(x) AS median, stddev_samp(x) AS std FROM u GROUP BY metric), t AS (UNPIVOT s ON mean, median, std INTO NAME name VALUE x)
  SELECT 'rows' AS part, uav_id::VARCHAR AS name, metric, round(x, 10) + 0 AS x FROM u UNION ALL SELECT 'worst', uav_id::VARCHAR, metric, round(x, 10) + 0 FROM v UNION ALL SELECT 'summary', name, metric, round(x, 10) + 0 FROM t""")
def evaluation_files(spark, sf_dir) -> DataFrame:
    """Rows, summary and worst rows of an evaluation, read back from their CSV files."""
    path = scratch_path(spark, "evaluation")
    reports.write_evaluation(saved(error_stats(spark, sf_dir), "errors"), path)
    read = lambda part, key, columns: spark.read.option("header", True).csv(f"{path}/{part}").select(key, *(F.col(c).cast("double").alias(c) for c in columns))
    parts = []
    for part in ("rows", "worst"):
        long = read(part, "uav_id", _ERRORS).unpivot(["uav_id"], list(_ERRORS), "metric", "x")
        parts.append(long.select(F.lit(part).alias("part"), F.col("uav_id").alias("name"), "metric", "x"))
    stats = ["mean", "median", "std"]
    parts.append(read("summary", "metric", stats).unpivot(["metric"], stats, "name", "x").select(F.lit("summary").alias("part"), "name", "metric", "x"))
    return reduce(DataFrame.unionByName, parts).select("part", "name", "metric", (F.round("x", 10) + 0.0).alias("x"))


@plans(f"""WITH {OBS_SQL} SELECT us / {MICROS}e0 AS timestamp, round(avg(lat), 6) + 0 AS lat, round(avg(lon), 6) + 0 AS lon, round(avg(alt), 6) + 0 AS alt FROM obs WHERE modality = 'gps' GROUP BY us""")
def result_files(spark, sf_dir):
    """Mean positions of each time as an answer's lines of JSON, read back."""
    rows = obs(spark, sf_dir, ("click",)).groupBy((F.col("us") / float(MICROS)).alias("timestamp")).agg(*(r6(F.avg(c)).alias(c) for c in ("lat", "lon", "alt")))
    path = scratch_path(spark, "answers")
    reports.write_results(rows, path)
    read = files.read_jsonl(spark, path, "timestamp double, lat double, lon double, alt double")
    return read.drop("_line")
