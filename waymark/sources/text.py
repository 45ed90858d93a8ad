"""Readers of trajectory text and road tables.

A trajectory line is [oid,[["yyyy-MM-dd HH:mm:ss[.f]",lng,lat],...]] with the oid bare, in GCJ-02. Lines that don't parse
give no row. Times are read in the session's time zone (UTC here).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.coords import gcj02_to_wgs84
from waymark.functions.geo import col
from waymark.functions.wkt import read_points

ROADS = "segment_id int, wkt string, start_id int, end_id int, direction int, level int, speed_limit double, length_m double"


def parse_line(line, skip: int = 0, most: int | None = None, convert: bool = True) -> Column:
    """Struct tid, oid, points (array of idx, time, lng, lat in order of time). most cuts before sorting, skip thins after
    parsing in line order; the tid is the oid and the first time of the line."""
    text = col(line)
    oid = F.trim(F.regexp_extract(text, r"^\s*\[\s*\"?([^,\"\[]*)\"?\s*,", 1))
    body = F.regexp_extract(text, r"^\s*\[[^,]*,\s*(\[.*\])\s*\]\s*$", 1)
    raw = F.from_json(body, "array<array<string>>")
    if most is not None:
        raw = F.slice(raw, 1, most)
    if skip:
        raw = F.filter(raw, lambda _, i: i % (skip + 1) == 0)
    place = lambda x, y: gcj02_to_wgs84(x, y) if convert else F.struct(x.alias("lng"), y.alias("lat"))
    point = lambda p, i: F.struct(F.try_to_timestamp(p[0]).alias("time"), i.alias("at"), place(p[1].try_cast("double"), p[2].try_cast("double")).alias("w"))
    ordered = F.sort_array(F.transform(raw, point))
    points = F.transform(ordered, lambda p, i: F.struct(i.alias("idx"), p["time"].alias("time"), p["w"]["lng"].alias("lng"), p["w"]["lat"].alias("lat")))
    return F.when(F.length(body) > 0, F.struct(F.concat(oid, raw[0][0]).alias("tid"), oid.alias("oid"), points.alias("points")))


def read_trajectories(spark: SparkSession, path: str, *, skip: int = 0, most: int | None = None, convert: bool = True) -> DataFrame:
    """gps_points in long form: tid, oid, idx, time, lng, lat."""
    rows = spark.read.text(path).select(parse_line("value", skip, most, convert).alias("t")).where("t is not null")
    return rows.select("t.tid", "t.oid", F.explode("t.points").alias("p")).select("tid", "oid", "p.*")


def nth_line(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The n-th line of a text file (from 1), as value; no row past the end. Reads n lines at most, of one file in order."""
    lines = spark.read.text(path).limit(n).withColumn("at", F.monotonically_increasing_id())
    return lines.where(F.col("at") == n - 1).select("value")


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n lines' trajectories, nested."""
    return spark.read.text(path).limit(n).select(parse_line("value").alias("t")).where("t is not null").select("t.*")


def read_roads(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """road_segments from a |-separated table with a header; most: the first so many rows."""
    raw = spark.read.csv(path, sep="|", header=True, schema=ROADS)
    raw = raw.limit(most) if most is not None else raw
    return raw.withColumn("points", read_points("wkt")).select("segment_id", "start_id", "end_id", "points", "direction", "level", "speed_limit", "length_m")
