"""Set operations, numbering, batches and statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import running
from ..operators.numbering import batch_label, numbered
from ..sources.shared import saved
from ..sources.tables import MICROS, OBS_SQL, obs, sensed, table, truth
from .base import Plans, r6
from .scalars import CONF_SQL, confident, tag

plans = Plans()
_HOUR = f"us // (3600 * {MICROS}::BIGINT)"


@plans(f"WITH {OBS_SQL} SELECT {_HOUR} AS frame FROM obs WHERE modality = 'gps' INTERSECT SELECT {_HOUR} FROM obs WHERE modality = 'truth'")
def frame_intersect(spark, sf_dir):
    hour = F.floor(F.col("us") / (3600 * MICROS)).alias("frame")
    return obs(spark, sf_dir, ("click",)).select(hour).intersect(truth(spark, sf_dir).select(hour))


@plans(f"WITH {OBS_SQL} SELECT event_id, modality, lat, CASE WHEN modality = 'gps' THEN q1 END AS gps_q, CASE WHEN modality = 'radar' THEN q2 END AS radar_q FROM obs WHERE modality IN ('gps', 'radar')")
def union_modalities(spark, sf_dir):
    parts = [obs(spark, sf_dir, (kind,)).select("event_id", "modality", "lat", F.col(q).alias(name)) for kind, q, name in (("click", "q1", "gps_q"), ("purchase", "q2", "radar_q"))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@plans(f"WITH {OBS_SQL} SELECT DISTINCT uav_id FROM obs")
def distinct_ids(spark, sf_dir):
    return obs(spark, sf_dir).select("uav_id").distinct()


@plans(f"WITH {OBS_SQL}, n AS (SELECT uav_id, row_number() OVER (ORDER BY uav_id) - 1 AS number FROM (SELECT DISTINCT uav_id FROM obs)) SELECT uav_id, number, 'batch' || lpad((number // 20 + 1)::VARCHAR, greatest(2, length((number // 20 + 1)::VARCHAR))::INT, '0') AS batch FROM n")
def batch_chunk(spark, sf_dir):
    return numbered(obs(spark, sf_dir), "uav_id").withColumn("batch", batch_label(F.col("number"), 20))


@plans(f"WITH {OBS_SQL} SELECT modality, count(q1) AS n, min(q1) AS low, max(q1) AS high, round(avg(q1), 6) + 0 AS mean, round(stddev_pop(q1), 6) + 0 AS std FROM obs GROUP BY modality")
def stats_numeric(spark, sf_dir):
    return obs(spark, sf_dir).groupBy("modality").agg(F.count("q1").alias("n"), F.min("q1").alias("low"), F.max("q1").alias("high"), r6(F.avg("q1")).alias("mean"), r6(F.stddev_pop("q1")).alias("std"))


@plans(f"WITH {OBS_SQL} SELECT CASE event_id % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END AS scenario_tag, modality, count(*) AS n, count(DISTINCT uav_id) AS uavs FROM obs GROUP BY 1, 2")
def scenario_counts(spark, sf_dir):
    return obs(spark, sf_dir).withColumn("scenario_tag", tag()).groupBy("scenario_tag", "modality").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uav_id").alias("uavs"))


# The sensors from the most to the least precise.
_ORDER = ("gps", "radar", "fiveg", "tdoa")
_SIGMA = "CASE modality WHEN 'gps' THEN 1e0 WHEN 'radar' THEN 1.22e0 WHEN 'fiveg' THEN 1.36e0 WHEN 'tdoa' THEN 1.72e0 END * (0.8e0 + 0.9e0 * (20e0 - q1 / 5e0))"


@plans(f"""WITH {OBS_SQL}, m AS (SELECT modality, avg({_SIGMA}) AS sigma FROM obs WHERE modality <> 'truth' GROUP BY modality),
  o AS (SELECT *, CASE modality WHEN 'gps' THEN 0 WHEN 'radar' THEN 1 WHEN 'fiveg' THEN 2 ELSE 3 END AS place FROM m)
  SELECT modality, round(sigma, 6) + 0 AS mean_sigma, coalesce(sigma > lag(sigma) OVER (ORDER BY place), true) AS in_order FROM o""")
def precision_audit(spark, sf_dir):
    scale, place = F.lit(None).cast("double"), F.lit(None).cast("int")
    for k, (name, s) in enumerate(zip(_ORDER, (1.0, 1.22, 1.36, 1.72), strict=True)):
        scale, place = F.when(F.col("modality") == name, s).otherwise(scale), F.when(F.col("modality") == name, k).otherwise(place)
    means = sensed(spark, sf_dir).groupBy("modality").agg(F.avg(scale * (0.8 + 0.9 * (20.0 - F.col("q1") / 5.0))).alias("sigma"))
    # four rows, so one ordered window
    above = F.col("sigma") > F.lag("sigma").over(Window.orderBy(place))
    return means.select("modality", r6(F.col("sigma")).alias("mean_sigma"), F.coalesce(above, F.lit(True)).alias("in_order"))


@plans(f"""WITH {CONF_SQL}, s AS (SELECT uav_id, event_id, exp(confidence - max(confidence) OVER (PARTITION BY uav_id)) AS e FROM conf)
  SELECT event_id, round(e / (sum(e) OVER (PARTITION BY uav_id) + 1e-12), 6) + 0 AS share FROM s""")
def softmax_share(spark, sf_dir):
    """Each observation's softmax share of its object's confidence."""
    rows = confident(spark, sf_dir).select("event_id", "uav_id", "confidence")
    return running.softmax_share(rows, "uav_id", "confidence", "share").select("event_id", r6(F.col("share")).alias("share"))


@plans("SELECT event_id, event_id // 64 AS block, row_number() OVER (PARTITION BY event_id // 64 ORDER BY md5('7|' || event_id), event_id) - 1 AS place FROM events")
def block_shuffle(spark, sf_dir):
    """Rows in an order drawn by a seed, within blocks of 64."""
    block = F.floor(F.col("event_id") / 64)
    drawn = F.md5(F.concat_ws("|", F.lit("7"), F.col("event_id").cast("string")).cast("binary"))
    place = (F.row_number().over(Window.partitionBy(block).orderBy(drawn, "event_id")) - 1).cast("long")
    return table(spark, sf_dir, "events").select("event_id", block.alias("block"), place.alias("place"))


_UNITS = f"""u AS (SELECT event_id % 5 AS dataset, n.number // 20 AS unit, modality, count(*) AS k
    FROM obs JOIN (SELECT uav_id, row_number() OVER (ORDER BY uav_id) - 1 AS number FROM (SELECT DISTINCT uav_id FROM obs)) n USING (uav_id) GROUP BY 1, 2, 3),
  one AS (SELECT dataset, unit, '{{' || string_agg('"' || modality || '":{{"rows":' || k || '}}', ',' ORDER BY modality) || '}}' AS summary FROM u GROUP BY 1, 2),
  b AS (SELECT *, row_number() OVER (ORDER BY dataset, unit) AS place FROM one)"""
_LABEL = "lpad({x}::VARCHAR, greatest(2, length({x}::VARCHAR))::INT, '0')"


@plans(f"""WITH {OBS_SQL}, {_UNITS}
  SELECT 'merged' || {_LABEL.format(x='place')} AS batch, substr('ABCDE', dataset::INT + 1, 1) AS source_dataset, 'batch' || {_LABEL.format(x='(unit + 1)')} AS source_unit, summary FROM b
  UNION ALL SELECT NULL, NULL, NULL, '{{"dataset_count":' || count(DISTINCT dataset) || ',"source_unit_count":' || count(*) || ',"batch_count":' || count(*) || '}}' FROM b""")
def run_summaries(spark, sf_dir):
    """A JSON summary of each unit of each dataset, merged to one run of batches, and that of the run."""
    rows = obs(spark, sf_dir).select((F.col("event_id") % 5).alias("dataset"), "uav_id", "modality")
    counts = rows.groupBy("dataset", "uav_id", "modality").agg(F.count(F.lit(1)).alias("k")).join(numbered(rows, "uav_id"), "uav_id")
    counts = counts.groupBy("dataset", F.floor(F.col("number") / 20).alias("unit"), "modality").agg(F.sum("k").alias("rows"))
    entries = F.array_sort(F.collect_list(F.struct("modality", F.struct("rows").alias("counts"))))
    one = saved(counts.groupBy("dataset", "unit").agg(F.to_json(F.map_from_entries(entries)).alias("summary")).withColumn("code", F.col("dataset") * (1 << 40) + F.col("unit")), "unit-summaries")
    place = numbered(one, "code")
    batches = one.join(place, "code").select(batch_label(F.col("number"), 1, "merged").alias("batch"), F.substr(F.lit("ABCDE"), (F.col("dataset") + 1).cast("int"), F.lit(1)).alias("source_dataset"), batch_label(F.col("unit"), 1).alias("source_unit"), "summary")
    total = one.agg(F.to_json(F.struct(F.countDistinct("dataset").alias("dataset_count"), F.count(F.lit(1)).alias("source_unit_count"), F.count(F.lit(1)).alias("batch_count"))).alias("summary"))
    return batches.unionByName(total, allowMissingColumns=True)
