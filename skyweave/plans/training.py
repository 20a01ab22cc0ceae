"""Training samples and padded batches of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import asof, fusion, running, samples
from ..sources.shared import saved, scratch_path
from ..sources.tables import truth
from .base import Plans
from .scalars import CONF_SQL, confident
from .tracks import _T, _TWO, HOURS6, POS

plans = Plans()
SIZE, STRIDE, BATCH, STEP, FLAGS = 20, 5, 16, 8, 3
_FEATURES = 3 + 2 + len(fusion.MODALITIES)
_PLANE = ["radians({p}lon - lon0) * cos(radians(lat0)) * 6378137e0", "radians({p}lat - lat0) * 6378137e0", "{p}alt - alt0"]
_KIND = "CASE modality " + " ".join(f"WHEN '{m}' THEN {k}" for k, m in enumerate(fusion.MODALITIES)) + " END"

_SAMPLES = f"""{CONF_SQL}, {_T.split(', s AS')[0]},
times AS (SELECT uav_id, us, any_value(lat) AS lat, any_value(lon) AS lon, any_value(alt) AS alt, row_number() OVER (PARTITION BY uav_id ORDER BY us) - 1 AS i, count(*) OVER (PARTITION BY uav_id) AS len FROM t GROUP BY uav_id, us),
o AS (SELECT uav_id, lat AS lat0, lon AS lon0, alt AS alt0 FROM times WHERE i = 0),
{_TWO.format(o='conf')},
nodes AS (SELECT event_id, n.us, n.uav_id, {_KIND} AS m, i, len, [{', '.join(f'round({x.format(p="n.")}, 4) + 0' for x in _PLANE)}, round(greatest(0e0, least(1e0, confidence)), 9) + 0, 1e0, {', '.join(f"(modality = '{m}')::INT::DOUBLE" for m in fusion.MODALITIES)}] AS f
  FROM near n JOIN o USING (uav_id) JOIN times ON times.uav_id = n.uav_id AND times.us = n.t_us WHERE abs(n.us - t_us) <= {HOURS6}::BIGINT),
y AS (SELECT uav_id, i, len, [{', '.join(f'round({x.format(p="times.")}, 4) + 0' for x in _PLANE)}] AS y FROM times JOIN o USING (uav_id)),
w AS (SELECT DISTINCT uav_id, unnest(generate_series(0, len - {SIZE}, {STRIDE})) AS start FROM times WHERE len >= {SIZE}),
s AS (SELECT w.uav_id, w.start, count(*) AS n_nodes, list(i - start ORDER BY i, us, event_id) AS node_t, list(m ORDER BY i, us, event_id) AS node_m, list(f ORDER BY i, us, event_id) AS node_feat
  FROM w JOIN nodes ON nodes.uav_id = w.uav_id AND i BETWEEN start AND start + {SIZE - 1} GROUP BY 1, 2),
ys AS (SELECT w.uav_id, w.start, list(y ORDER BY i) AS y FROM w JOIN y ON y.uav_id = w.uav_id AND i BETWEEN start AND start + {SIZE - 1} GROUP BY 1, 2),
sample AS MATERIALIZED (SELECT * FROM s JOIN ys USING (uav_id, start))"""


def _samples(spark, sf_dir):
    """Windows of 20 truth times, their nodes the observations nearest to one of them."""
    known = truth(spark, sf_dir).groupBy("uav_id", "us").agg(*(F.first(c).alias(c) for c in POS))
    times = saved(running.with_number(known, "uav_id", ["us"], "i", asof.WIDTH), "sample-times")
    first = times.where("i = 0").select("uav_id", F.struct(*POS).alias("o"))
    origin = [F.col(f"o.{c}") for c in POS]
    place = F.array(*(F.round(x, 4) + 0.0 for x in geo.enu(*map(F.col, POS), *origin)))
    near = asof.nearest(confident(spark, sf_dir), times, "uav_id", "us", ["i"], HOURS6).withColumnRenamed("t_i", "i").join(first, "uav_id")
    kind = F.lit(None).cast("int")
    for k, m in enumerate(fusion.MODALITIES):
        kind = F.when(F.col("modality") == m, k).otherwise(kind)
    nodes = near.select("uav_id", "i", "us", "event_id", kind.alias("m"), fusion.node_feature(*origin).alias("feature"))
    return samples.samples(nodes, times.join(first, "uav_id").select("uav_id", "i", place.alias("y")), "uav_id", "i", ["us", "event_id"], SIZE, STRIDE)


@plans(f"""WITH {_SAMPLES} SELECT uav_id, start, n_nodes, list_transform(node_t, lambda x: x::BIGINT) AS node_t, list_transform(node_m, lambda x: x::INT) AS node_m, len(y) AS steps,
  round(list_sum(list_transform(node_feat, lambda f: f[1])), 3) + 0 AS east, round(list_sum(list_transform(node_feat, lambda f: f[4])), 6) + 0 AS confidence, round(list_sum(list_transform(y, lambda f: f[1])), 3) + 0 AS y_east FROM sample""")
def training_samples(spark, sf_dir):
    total = lambda rows, k, digits: F.round(F.aggregate(F.col(rows), F.lit(0.0), lambda a, r: a + r[k]), digits) + 0.0
    rows = _samples(spark, sf_dir)
    return rows.select("uav_id", "start", F.col("n_nodes").cast("long").alias("n_nodes"), "node_t", "node_m", F.size("y").cast("long").alias("steps"), total("node_feat", 0, 3).alias("east"), total("node_feat", 3, 6).alias("confidence"), total("y", 0, 3).alias("y_east"))


_STATS = "SELECT k, avg(x) AS mean, stddev_pop(x) + 1e-6 AS std FROM (SELECT unnest(r) AS x, unnest(range(1, len(r) + 1)) AS k FROM (SELECT unnest({c}) AS r FROM sample)) GROUP BY k"


@plans(f"""WITH {_SAMPLES}, fs AS ({_STATS.format(c='node_feat')}), ysd AS ({_STATS.format(c='y')}),
  b AS (SELECT *, (row_number() OVER (PARTITION BY ceil(n_nodes / {STEP}e0) ORDER BY start, uav_id) - 1) // {BATCH} AS batch, ceil(n_nodes / {STEP}e0)::BIGINT AS bucket FROM sample),
  shape AS (SELECT bucket, batch, count(*) AS n, max(n_nodes) AS nodes, sum(n_nodes)::BIGINT AS whole, list(uav_id ORDER BY start, uav_id) AS keys, list(start ORDER BY start, uav_id) AS starts FROM b GROUP BY 1, 2),
  f AS (SELECT bucket, batch, sum(CASE WHEN k <= {FLAGS} THEN (x - mean) / std ELSE x END) AS feat FROM (SELECT bucket, batch, unnest(r) AS x, unnest(range(1, len(r) + 1)) AS k FROM (SELECT bucket, batch, unnest(node_feat) AS r FROM b)) JOIN fs USING (k) GROUP BY 1, 2),
  g AS (SELECT bucket, batch, sum((x - mean) / std) AS y FROM (SELECT bucket, batch, unnest(r) AS x, unnest(range(1, len(r) + 1)) AS k FROM (SELECT bucket, batch, unnest(y) AS r FROM b)) JOIN ysd USING (k) GROUP BY 1, 2),
  ints AS (SELECT bucket, batch, sum(list_sum(node_t)) AS t, sum(list_sum(node_m)) AS m FROM b GROUP BY 1, 2)
  SELECT bucket, batch, n, nodes, n * nodes * {_FEATURES} AS cells, n * nodes - whole AS padding, keys, starts, whole::DOUBLE AS mask, (t - (n * nodes - whole))::BIGINT AS t_sum, (m - (n * nodes - whole))::BIGINT AS m_sum, round(feat, 4) + 0 AS feat_sum, round(y, 4) + 0 AS y_sum
  FROM shape JOIN f USING (bucket, batch) JOIN g USING (bucket, batch) JOIN ints USING (bucket, batch)""")
def training_batches(spark, sf_dir):
    """Standardised samples in padded batches, written as shards and read back: sizes, padding and sums of every batch."""
    rows = saved(_samples(spark, sf_dir), "samples")
    rows = samples.scaled(rows, "node_feat", samples.scale(rows, "node_feat", FLAGS))
    rows = samples.scaled(rows, "y", samples.scale(rows, "y"))
    path = scratch_path(spark, "shards")
    samples.write_shards(samples.batches(rows, "uav_id", BATCH, _FEATURES, STEP), path, 4)
    made = samples.read_shards(spark, path)
    total = lambda x, kind="double": F.aggregate(x, F.lit(0).cast(kind), lambda a, v: a + v)
    flat, cells = F.flatten(F.flatten("node_feat")), F.flatten("node_mask")
    whole = lambda c: total(F.transform(F.flatten(c), lambda x: x.cast("long")), "long")
    long = lambda c: F.col(c).cast("long").alias(c)
    return made.select(
        "bucket", "batch", long("n"), long("nodes"), F.size(flat).cast("long").alias("cells"), F.size(F.filter(cells, lambda x: x == 0)).cast("long").alias("padding"), "keys", "starts",
        total(cells).alias("mask"), whole("node_t").alias("t_sum"), whole("node_m").alias("m_sum"), (F.round(total(flat), 4) + 0.0).alias("feat_sum"), (F.round(total(F.flatten(F.flatten("y"))), 4) + 0.0).alias("y_sum"),
    )

