"""Requests of sensor packets as rows: one for each packet and sensor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import ABSENT

_SENSOR = "struct<lat: double, lon: double, alt: double, vx: double, vy: double, vz: double, {metrics}>"
_PACKET = "struct<timestamp: double, uav_id: string, " + ", ".join(f"{m}: {_SENSOR.format(metrics=', '.join(f'{k}: {"string" if isinstance(v, str) else "double"}' for k, v in d.items()))}" for m, d in ABSENT.items()) + ">"
#: Where a request's packets may be, in order.
LISTS = ("data", "packets", "list")


def packets_of(body: Column) -> Column:
    """The packets of a JSON body: a list, or an object's first present list.
    A name that is there decides, also with null or what isn't a list."""
    parsed = F.from_json(body, ", ".join(f"{name} array<{_PACKET}>" for name in LISTS))
    plain = F.when(F.ltrim(body).startswith("["), F.from_json(body, f"array<{_PACKET}>"))
    named = F.lit(None).cast(f"array<{_PACKET}>")
    keys = F.json_object_keys(body)
    for name in reversed(LISTS):
        named = F.when(F.array_contains(keys, name), parsed[name]).otherwise(named)
    return F.coalesce(plain, named)


def sensor_rows(requests: DataFrame, body: str = "body", length: int | None = 20) -> DataFrame:
    """request_id, i, uav_id, timestamp, modality, position, velocity, metrics.

    A sensor that a packet lacks has the metrics of an absent one, no
    position and no speed.  A packet without a time is timed by its place;
    the first id of a request is that of all its packets.  Requests with
    another number of packets than ``length`` fail the job; None allows any.
    """
    rows = requests.select("request_id", packets_of(F.col(body)).alias("p"))
    if length is not None:
        rows = rows.where(F.when(F.coalesce(F.size("p"), F.lit(-1)) != length, F.raise_error(F.concat(F.lit("a request without "), F.lit(f"{length} packets: "), F.col("request_id").cast("string"))).cast("boolean")).otherwise(True))
    first_id = F.get(F.filter(F.transform("p", lambda x: x["uav_id"]), lambda x: x.isNotNull()), F.lit(0))
    flat = rows.select("request_id", F.coalesce(first_id, F.lit("UAV_HTTP")).alias("uav_id"), F.posexplode("p").alias("i", "p"))

    def metrics(name: str) -> Column:
        pairs = [x for k, v in ABSENT[name].items() for x in (F.lit(k), F.coalesce(F.col(f"p.{name}.{k}").cast("string"), F.lit(str(v))))]
        return F.create_map(*pairs)

    def sensor(name: str) -> Column:
        at = lambda c: F.col(f"p.{name}.{c}")
        speed = [F.coalesce(at(c), F.lit(0.0)).alias(c) for c in ("vx", "vy", "vz")]
        return F.struct(F.lit(name).alias("modality"), *(at(c).alias(c) for c in ("lat", "lon", "alt")), *speed, metrics(name).alias("metrics"))

    time = F.coalesce("p.timestamp", F.col("i").cast("double")).alias("timestamp")
    return flat.select("request_id", "i", "uav_id", time, F.explode(F.array(*map(sensor, ABSENT))).alias("s")).select("request_id", "i", "uav_id", "timestamp", "s.*")
