"""GCJ-02, WGS-84 and BD-09 conversions as Spark columns; outside the box of the datum they change nothing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.geo import RADIUS, col

# Fixed values of the public datum.
FLATTENING, X_PI = 0.00669342162296594323, math.pi * 3000.0 / 180.0
BOX = (72.004, 137.8347, 0.8293, 55.8271)


def outside(lng, lat) -> Column:
    return (col(lng) < BOX[0]) | (col(lng) > BOX[1]) | (col(lat) < BOX[2]) | (col(lat) > BOX[3])


def _waves(v: Column, *terms: tuple[float, float]) -> Column:
    """Two thirds of a sum of amplitude * sin(pi * factor * v)."""
    return sum((a * F.sin(v * (math.pi * f)) for a, f in terms), F.lit(0.0)) * (2.0 / 3.0)


def _delta(lng: Column, lat: Column) -> tuple[Column, Column]:
    x, y = lng - 105.0, lat - 35.0
    both = _waves(x, (20.0, 6.0), (20.0, 2.0))
    north = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + both + _waves(y, (20.0, 1.0), (40.0, 1 / 3), (160.0, 1 / 12), (320.0, 1 / 30))
    east = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + both + _waves(x, (20.0, 1.0), (40.0, 1 / 3), (150.0, 1 / 12), (300.0, 1 / 30))
    rad = F.radians(lat)
    m = 1 - FLATTENING * F.pow(F.sin(rad), 2)
    return F.degrees(east / (RADIUS / F.sqrt(m) * F.cos(rad))), F.degrees(north / ((RADIUS * (1 - FLATTENING)) / (m * F.sqrt(m))))


def _pair(lng: Column, lat: Column) -> Column:
    return F.struct(lng.alias("lng"), lat.alias("lat"))


def wgs84_to_gcj02(lng, lat) -> Column:
    lng, lat = col(lng), col(lat)
    e, n = _delta(lng, lat)
    return F.when(outside(lng, lat), _pair(lng, lat)).otherwise(_pair(lng + e, lat + n))


def gcj02_to_wgs84(lng, lat) -> Column:
    """One step back, as the shift at the shifted place."""
    lng, lat = col(lng), col(lat)
    e, n = _delta(lng, lat)
    return F.when(outside(lng, lat), _pair(lng, lat)).otherwise(_pair(lng - e, lat - n))


def gcj02_to_bd09(lng, lat) -> Column:
    lng, lat = col(lng), col(lat)
    z = F.sqrt(lng * lng + lat * lat) + 0.00002 * F.sin(lat * X_PI)
    t = F.atan2(lat, lng) + 0.000003 * F.cos(lng * X_PI)
    return _pair(z * F.cos(t) + 0.0065, z * F.sin(t) + 0.006)


def bd09_to_gcj02(lng, lat) -> Column:
    x, y = col(lng) - 0.0065, col(lat) - 0.006
    z = F.sqrt(x * x + y * y) - 0.00002 * F.sin(y * X_PI)
    t = F.atan2(y, x) - 0.000003 * F.cos(x * X_PI)
    return _pair(z * F.cos(t), z * F.sin(t))


def wgs84_to_bd09(lng, lat) -> Column:
    g = wgs84_to_gcj02(lng, lat)
    return gcj02_to_bd09(g["lng"], g["lat"])


def bd09_to_wgs84(lng, lat) -> Column:
    g = bd09_to_gcj02(lng, lat)
    return gcj02_to_wgs84(g["lng"], g["lat"])
