"""Geodesic scalar functions on doubles (degrees, metres), as Spark columns that stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
LEGACY_RADIUS = 6371000.0
#: Degrees of latitude in a metre.
PER_METRE = 360.0 / (2 * math.pi * RADIUS)


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lng1, lat1, lng2, lat2) -> Column:
    """Metres between two points."""
    lng1, lat1, lng2, lat2 = map(col, (lng1, lat1, lng2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    # Rounding may exceed 1 at antipodes only; null stays null.
    return 2 * F.nanvl(F.asin(F.sqrt(a)), F.lit(math.pi / 2)) * RADIUS


def metres_to_degrees(metres) -> Column:
    return col(metres) * PER_METRE


def extended_bbox(lng, lat, metres) -> Column:
    """Struct of min_lng, min_lat, max_lng, max_lat around a point."""
    lng, lat, d = col(lng), col(lat), metres_to_degrees(metres)
    w = F.try_divide(d, F.cos(F.radians(lat)))
    return F.struct((lng - w).alias("min_lng"), (lat - d).alias("min_lat"), (lng + w).alias("max_lng"), (lat + d).alias("max_lat"))


def bearing_xy(lng1, lat1, lng2, lat2) -> Column:
    """Struct of x and y of the direction."""
    lng1, lat1, lng2, lat2 = (F.radians(col(v)) for v in (lng1, lat1, lng2, lat2))
    y = F.sin(lng2 - lng1) * F.cos(lat2)
    x = F.cos(lat1) * F.sin(lat2) - F.sin(lat1) * F.cos(lat2) * F.cos(lng2 - lng1)
    return F.struct(x.alias("x"), y.alias("y"))


def vector_bearing(x, y) -> Column:
    """Degrees from 0 to 360 of a direction vector."""
    return F.pmod(F.degrees(F.atan2(col(y), col(x))) + 360.0, F.lit(360.0))


def bearing(lng1, lat1, lng2, lat2) -> Column:
    v = bearing_xy(lng1, lat1, lng2, lat2)
    return vector_bearing(v["x"], v["y"])


def angle_between(a, b) -> Column:
    """Degrees from 0 to 180 between two bearings."""
    d = F.abs(col(a) - col(b))
    return F.when(d > 180, 360 - d).otherwise(d)


def bearing_difference(p1, p2, p3, p4) -> Column:
    """Between the directions p1 -> p2 and p3 -> p4; points are (lng, lat)."""
    return angle_between(bearing(*p1, *p2), bearing(*p3, *p4))


def project_leg(lng, lat, lng1, lat1, lng2, lat2) -> Column:
    """Struct err, lng, lat, rate: a point on the leg from 1 to 2 (rate before it is held to the leg)."""
    lng, lat, lng1, lat1, lng2, lat2 = map(col, (lng, lat, lng1, lat1, lng2, lat2))
    along = haversine(lng1, lat1, lng, lat) * F.cos(F.radians(bearing(lng1, lat1, lng, lat) - bearing(lng1, lat1, lng2, lat2)))
    rate = F.coalesce(F.try_divide(along, haversine(lng1, lat1, lng2, lat2)), F.lit(0.0))
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate))
    x = F.when(rate > 1, lng2).when(rate < 0, lng1).otherwise(lng1 + held * (lng2 - lng1))
    y = F.when(rate > 1, lat2).when(rate < 0, lat1).otherwise(lat1 + held * (lat2 - lat1))
    return F.struct(haversine(lng, lat, x, y).alias("err"), x.alias("lng"), y.alias("lat"), rate.alias("rate"))


def _legs(points: Column) -> Column:
    return F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def project_polyline(points, lng, lat) -> Column:
    """Struct err_m, matched_index, lng, lat: the nearest leg's projection (the first of equals). points: array of (lng, lat)."""
    points, lng, lat = col(points), col(lng), col(lat)

    def leg(pair: Column, i: Column) -> Column:
        p = project_leg(lng, lat, pair["a"]["lng"], pair["a"]["lat"], pair["b"]["lng"], pair["b"]["lat"])
        return F.struct(p["err"].alias("err_m"), i.alias("matched_index"), p["lng"].alias("lng"), p["lat"].alias("lat"))

    return F.array_min(F.transform(_legs(points), leg))


def leg_lengths(points) -> Column:
    return F.transform(_legs(col(points)), lambda p: haversine(p["a"]["lng"], p["a"]["lat"], p["b"]["lng"], p["b"]["lat"]))


def polyline_length(points) -> Column:
    return F.aggregate(leg_lengths(points), F.lit(0.0), lambda a, x: a + x)


def offset_on(points, matched_index, lng, lat) -> Column:
    """Metres from the polyline's start to a point on the leg matched_index."""
    points, i = col(points), col(matched_index)
    whole = F.aggregate(F.slice(leg_lengths(points), 1, i), F.lit(0.0), lambda a, x: a + x)
    at = F.element_at(points, i + 1)
    return whole + haversine(at["lng"], at["lat"], lng, lat)


def points_bbox(points) -> Column:
    p = col(points)
    side = lambda f, k: f(F.transform(p, lambda x: x[k]))
    return F.struct(side(F.array_min, "lng").alias("min_lng"), side(F.array_min, "lat").alias("min_lat"), side(F.array_max, "lng").alias("max_lng"), side(F.array_max, "lat").alias("max_lat"))


def bbox_wkt(box) -> Column:
    """The box as a closed ring."""
    b = col(box)
    a, c, d, e = b["min_lng"], b["min_lat"], b["max_lng"], b["max_lat"]
    corners = [(a, c), (d, c), (d, e), (a, e), (a, c)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in corners]), F.lit("))"))


def weighted_direction(points, fallback) -> Column:
    """Length-weighted mean bearing of a polyline; fallback where it has no length."""
    legs = F.transform(_legs(col(points)), lambda p: F.struct(haversine(p["a"]["lng"], p["a"]["lat"], p["b"]["lng"], p["b"]["lat"]).alias("d"), bearing_xy(p["a"]["lng"], p["a"]["lat"], p["b"]["lng"], p["b"]["lat"]).alias("v")))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("d"))
    total = F.aggregate(legs, zero, lambda s, g: F.struct((s["x"] + g["v"]["x"] * g["d"]).alias("x"), (s["y"] + g["v"]["y"] * g["d"]).alias("y"), (s["d"] + g["d"]).alias("d")))
    return F.when(total["d"] == 0, col(fallback)).otherwise(vector_bearing(total["x"], total["y"]))


def legacy_distance(lng1, lat1, lng2, lat2, compat: bool = True) -> Column:
    """The adaptive matcher's distance. compat: degrees become radians twice, so it is far too small; else plain haversine."""
    lng1, lat1, lng2, lat2 = map(col, (lng1, lat1, lng2, lat2))
    once = F.radians if compat else (lambda x: x)
    lng1, lat1, lng2, lat2 = (once(v) for v in (lng1, lat1, lng2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) * LEGACY_RADIUS


def legacy_velocity(distance, millis) -> Column:
    """Distance per millisecond; null at once."""
    return F.try_divide(col(distance), col(millis).cast("double"))


def same_position(lng1, lat1, lng2, lat2, eps: float = 1e-6) -> Column:
    return (F.abs(col(lng1) - col(lng2)) < eps) & (F.abs(col(lat1) - col(lat2)) < eps)


def grid_steps(metres: float, min_lat: float, max_lat: float) -> tuple[float, float]:
    """(longitude, latitude) steps in degrees of cells so many metres wide at the middle latitude."""
    step = math.degrees(metres / RADIUS)
    return step / math.cos(math.radians((min_lat + max_lat) / 2)), step


def grid_lines(metres: float, box: tuple[float, float, float, float]) -> tuple[list[float], list[float]]:
    """(longitudes, latitudes) of the lines of a grid over (min_lng, min_lat, max_lng, max_lat)."""
    dx, dy = grid_steps(metres, box[1], box[3])
    line = lambda low, high, d: [low + k * d for k in range(math.floor((high - low) / d + 1e-12) + 1)]
    return line(box[0], box[2], dx), line(box[1], box[3], dy)


def grid_cell(lng, lat, lngs: list[float], lats: list[float]) -> Column:
    """(row - 1) * (columns - 1) + column among the lines, -1 outside; a point on a line belongs to the cell before."""
    below = lambda v, lines: sum((F.lit(x) < col(v)).cast("int") for x in lines)
    i, j = below(lng, lngs), below(lat, lats)
    outside = (i == 0) | (j == 0) | (i == len(lngs)) | (j == len(lats))
    return F.when(outside, F.lit(-1)).otherwise((j - 1) * (len(lngs) - 1) + i).cast("int")
