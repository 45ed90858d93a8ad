"""WKT of points and line strings as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.geo import col

POINTS = "array<struct<lng: double, lat: double>>"


def read_points(wkt) -> Column:
    """The points of POINT or LINESTRING; null for other text."""
    body = F.regexp_extract(col(wkt), r"(?i)^\s*(?:POINT|LINESTRING)\s*Z?\s*\(([^()]*)\)\s*$", 1)
    pairs = F.transform(F.split(body, ","), lambda p: F.split(F.trim(p), r"\s+"))
    number = lambda p, i: F.get(p, F.lit(i)).try_cast("double")
    return F.when(F.length(F.trim(body)) > 0, F.transform(pairs, lambda p: F.struct(number(p, 0).alias("lng"), number(p, 1).alias("lat"))))


def write_points(points) -> Column:
    """LINESTRING (lng lat, ...)."""
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(col(points), lambda p: F.concat_ws(" ", p["lng"].cast("string"), p["lat"].cast("string"))), ", "), F.lit(")"))
