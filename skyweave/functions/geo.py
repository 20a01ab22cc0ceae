"""Geodesy, angles and vectors as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The radii and the flat scale that the formulas use, in metres.
EARTH_RADIUS_ENU = 6378137.0
EARTH_RADIUS_ARC = 6371000.0
METRES_PER_DEGREE = 111000.0


def enu(lat, lon, alt, lat0, lon0, alt0) -> tuple[Column, Column, Column]:
    """East, north, up of a point about a reference (equirectangular)."""
    east = F.radians(lon - lon0) * F.cos(F.radians(lat0)) * EARTH_RADIUS_ENU
    return east, F.radians(lat - lat0) * EARTH_RADIUS_ENU, alt - alt0


def llh(east, north, up, lat0, lon0, alt0) -> tuple[Column, Column, Column]:
    """The inverse of enu()."""
    lon = lon0 + F.degrees(east / (F.cos(F.radians(lat0)) * EARTH_RADIUS_ENU))
    return lat0 + F.degrees(north / EARTH_RADIUS_ENU), lon, alt0 + up


def arc_distance(lat1, lon1, lat2, lon2) -> Column:
    """Metres by the equirectangular formula at the middle latitude."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return F.sqrt(x * x + y * y) * EARTH_RADIUS_ARC


def flat_distance(lat1, lon1, lat2, lon2) -> Column:
    """Metres with one scale for both axes."""
    dy, dx = (lat2 - lat1) * METRES_PER_DEGREE, (lon2 - lon1) * METRES_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


def metres_to_lat(metres) -> Column:
    return metres / METRES_PER_DEGREE


def metres_to_lon(metres, lat) -> Column:
    return metres / (F.greatest(F.cos(F.radians(lat)), F.lit(1e-6)) * METRES_PER_DEGREE)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Forward azimuth in degrees, 0 to 360."""
    a, b, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_difference(a, b) -> Column:
    """a - b, wrapped into -180 to 180."""
    return F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0


def norm(*parts: Column) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
