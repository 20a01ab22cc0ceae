"""Points looked up in tables of circles and of intervals.

A circle is dealt by its size, to cells of a quarter of the least power of two
that it fits in; an interval to the buckets that halves of halves make it up
of, and the finest where it starts and ends.  So each lies in a few whatever
its size.  A cell that lies wholly in some of them needs only the greatest of
their values, and of those whose edge crosses it only the ones above what
covers it, here or in the wider cells around.  So of many that overlap little
is left, and points look once into every class of sizes that there is.  Joins
are on equal keys; exact bounds are checked after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_ARC, arc_distance
from ..sources.shared import saved

#: Metres of a degree as arc_distance() has them.
DEGREE = EARTH_RADIUS_ARC * 3.141592653589793 / 180.0


def _size_class(size: Column, least: float) -> Column:
    """The least k of 0 or more for which ``least`` * 2**k reaches the size."""
    k = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(size / least, F.lit(1.0))))).cast("int")
    return F.when(F.pow(F.lit(2.0), k) * least < size, k + 1).otherwise(k)


#: A cell is as wide as its class by this.
PARTS = 4


def _cell(x: Column, unit: float) -> Column:
    """The cell of class 0, as wide as ``unit`` by PARTS; none of NaN."""
    return F.when(~F.isnan(x.cast("double")), F.floor(x / (unit / PARTS)))


def _wider(cell: Column, by: Column) -> Column:
    """The cell ``by`` classes up that a cell lies in."""
    return F.floor(cell / F.pow(F.lit(2.0), by))


def _bounds(cell: Column, unit: float) -> tuple[Column, Column]:
    """What all points of a cell of its class lie between, and a little more,
    as quotients are rounded."""
    size = F.pow(F.lit(2.0), F.col("_class"))
    spare = 1e-9 + F.abs(cell) * size * 1e-15
    return (cell * size - spare) * (unit / PARTS), ((cell + 1) * size + spare) * (unit / PARTS)


def _classes(rows: DataFrame) -> list[int]:
    """The classes that occur: a few dozen, as sizes are doubles."""
    return sorted(r[0] for r in rows.select("_class").distinct().collect()) or [0]


def _span(low: Column, high: Column, unit: float) -> Column:
    return F.explode(F.sequence(*(_wider(_cell(x, unit), F.col("_class")) for x in (low, high))))


def _halves(rows: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """The buckets (_class, _bucket) that the rows' intervals cover, as few
    and wide as it can be, and those of class 0 that they start or end in."""
    rows = rows.withColumns({"_first": _cell(F.col("_z_start"), least), "_last": _cell(F.col("_z_end"), least)})
    first, last = F.col("_first"), F.col("_last")
    size, low, high = F.pow(F.lit(2.0), F.col("_class")), F.col("_low"), F.col("_high")
    levels = rows.where(last - first > 1).withColumn("_class", F.explode(F.sequence(F.lit(0), F.floor(F.log2(last - first)).cast("int"))))
    levels = levels.withColumns({"_low": F.ceil((first + 1) / size), "_high": F.floor(last / size)}).where(low < high)
    odd = lambda n: F.pmod(n, F.lit(2)) == 1
    full = levels.withColumn("_bucket", F.explode(F.array(F.when(odd(low), low), F.when(odd(high), high - 1)))).where(F.col("_bucket").isNotNull())
    edges = rows.withColumn("_class", F.lit(0)).withColumn("_bucket", F.explode(F.array(first, F.when(first != last, last)))).where(F.col("_bucket").isNotNull())
    # in its bucket an event that began before it always goes on to its end, so those that end together are one
    edges = edges.withColumns({"_z_start": F.when(F.col("_bucket") == first, F.col("_z_start")).otherwise(float("-inf")), "_z_end": F.when(F.col("_bucket") == last, F.col("_z_end")).otherwise(float("inf"))})
    edges = edges.groupBy(*(c for c in edges.columns if c not in ("_first", "_last", "_z_value"))).agg(F.max("_z_value").alias("_z_value"))
    return full.drop("_first", "_last", "_low", "_high"), edges


def _decisive(full: DataFrame, edges: DataFrame, cells: list[str], *keys: str) -> DataFrame:
    """Of cells (_class, ``cells``, ``keys``, _z_value) that something covers,
    and of those (also with what tells who is inside) that an edge crosses,
    the rows that may give a point in there its greatest value: one with
    nothing but the value for a cell that is covered, and the edges above."""
    at = ["_class", *cells, *keys]
    covers = saved(full.groupBy(*at).agg(F.max("_z_value").alias("_cover")), "covers")
    classes = F.array(*map(F.lit, _classes(covers)))
    up = covers.select(*at).unionByName(edges.select(*at)).distinct().withColumn("_up", F.explode(F.filter(classes, lambda c: c >= F.col("_class"))))
    up = up.withColumns({f"_up{c}": _wider(F.col(c), F.col("_up") - F.col("_class")) for c in cells})
    above = up.join(covers.withColumnsRenamed({c: f"_up{c}" for c in cells} | {"_class": "_up"}), ["_up", *(f"_up{c}" for c in cells), *keys])
    own = F.col("_up") == F.col("_class")
    most = lambda of, name: F.max(F.when(of, F.col("_cover"))).alias(name)
    covered = saved(above.groupBy(*at).agg(most(F.lit(True), "_cover"), most(own, "_own"), most(~own, "_wide")), "covered")
    whole = covered.where(F.col("_own").isNotNull() & F.coalesce(F.col("_own") > F.col("_wide"), F.lit(True)))
    left = edges.join(covered.select(*at, "_cover"), at, "left").where(F.coalesce(F.col("_z_value") > F.col("_cover"), F.lit(True))).drop("_cover")
    return saved(left.unionByName(whole.select(*at, F.col("_own").alias("_z_value")), allowMissingColumns=True), "decisive")


def _strongest(points: DataFrame, id: str, dealt: DataFrame, pieces: DataFrame, cells: list[str], keys: list[str], inside: Column, name: str) -> DataFrame:
    """The points with the greatest value that any row of their id is inside
    of, or 0; ``dealt`` are the points with their cells of class 0."""
    dealt = dealt.withColumn("_class", F.explode(F.array(*map(F.lit, _classes(pieces)))))
    dealt = dealt.withColumns({c: _wider(F.col(c), F.col("_class")) for c in cells})
    found = dealt.join(pieces, ["_class", *cells, *keys]).where(inside).groupBy(id).agg(F.max("_z_value").alias("_most"))
    return points.join(found, id, "left").select(*points.columns, F.coalesce("_most", F.lit(0.0)).alias(name))


def with_zone(points: DataFrame, zones: DataFrame, id: str, name: str = "zone", least: float = 100.0) -> DataFrame:
    """The points (``id``, lat, lon, more) with the greatest strength of the
    ``zones`` (lat, lon, radius, strength) that they lie in, bounds included,
    and 0 outside all.

    ``id`` tells points apart: rows with one id have what any of them has.
    Zones with a null, or a negative radius, hold nothing; a point without a
    place is in none.  Zones up to ``least`` metres are one class.
    """
    whole = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("radius") >= 0) & F.col("strength").isNotNull()
    known = zones.where(whole).groupBy("lat", "lon", "radius").agg(F.max("strength").alias("_z_value"))
    known = known.select(F.col("lat").alias("_z_lat"), F.col("lon").alias("_z_lon"), F.col("radius").alias("_z_radius"), "_z_value").withColumn("_class", _size_class(F.col("_z_radius"), least))
    high = F.col("_z_radius") / DEGREE * (1 + 1e-9) + 1e-12
    # the middle latitude is at most half the radius away from the zone's
    wide = F.least(F.lit(360.0), high / F.greatest(F.cos(F.radians(F.least(F.abs("_z_lat") + high, F.lit(89.9)))), F.lit(1e-3)))
    unit, cells = least / DEGREE, ["_cx", "_cy"]
    pieces = known.withColumn("_cx", _span(F.col("_z_lon") - wide, F.col("_z_lon") + wide, unit)).withColumn("_cy", _span(F.col("_z_lat") - high, F.col("_z_lat") + high, unit))
    (west, east), (south, north) = _bounds(F.col("_cx"), unit), _bounds(F.col("_cy"), unit)
    pieces = pieces.withColumns({"_w": west - F.col("_z_lon"), "_e": east - F.col("_z_lon"), "_s": south, "_n": north})
    # a degree of longitude is longest at the middle latitude nearest to the equator
    low = F.when(F.signum(F.col("_s") + F.col("_z_lat")) != F.signum(F.col("_n") + F.col("_z_lat")), 0.0).otherwise(F.least(*(F.abs(F.col(c) + F.col("_z_lat")) / 2 for c in ("_s", "_n"))))
    far = F.greatest(F.abs("_w"), F.abs("_e")) * F.cos(F.radians(low)), F.greatest(*(F.abs(F.col(c) - F.col("_z_lat")) for c in ("_s", "_n")))
    pieces = pieces.withColumn("_full", F.hypot(*far) * DEGREE <= F.col("_z_radius") * (1 - 1e-9)).drop("_w", "_e", "_s", "_n")
    full, edges = (pieces.where(x).drop("_full") for x in (F.col("_full"), ~F.col("_full")))
    dealt = points.select(id, "lat", "lon", _cell(F.col("lon"), unit).alias("_cx"), _cell(F.col("lat"), unit).alias("_cy"))
    inside = F.col("_z_radius").isNull() | (arc_distance(F.col("lat"), F.col("lon"), F.col("_z_lat"), F.col("_z_lon")) <= F.col("_z_radius"))
    return _strongest(points, id, dealt, _decisive(full, edges, cells), cells, [], inside, name)


def with_event(points: DataFrame, events: DataFrame, id: str, time: str, sensor: str, name: str = "event", least: float = 60.0) -> DataFrame:
    """The points (``id``, ``time``, ``sensor``, more) with the greatest level
    of the ``events`` (start, end, sensors, level) that go on at their time,
    ends included, for their sensor; 0 without any.

    ``id`` tells points apart: rows with one id have what any of them has.
    Events with a null or an end before their start are none; a null in their
    ``sensors`` is no sensor.  Times are numbers of one unit; the
    finest buckets are a quarter of ``least``.
    """
    whole = (F.col("end") >= F.col("start")) & F.col("level").isNotNull()
    known = events.where(whole).select(F.explode("sensors").alias(sensor), F.col("start").cast("double").alias("_z_start"), F.col("end").cast("double").alias("_z_end"), F.col("level").alias("_z_value"))
    known = known.where(F.col(sensor).isNotNull())
    dealt = points.select(id, time, sensor, _cell(F.col(time), least).alias("_bucket"))
    inside = F.col("_z_start").isNull() | F.col(time).between(F.col("_z_start"), F.col("_z_end"))
    return _strongest(points, id, dealt, _decisive(*_halves(known, least), ["_bucket"], sensor), ["_bucket"], [sensor], inside, name)
