"""GeoJSON of networks, segments, trajectories, matches and paths, written and read by Spark's JSON functions.

Schemas are explicit, so nothing is inferred. Writers give a string column `geojson`, a row for each entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import col

SEGMENT = "struct<rsId: int, direction: int, speedLimit: double, level: int, startId: int, endId: int, lengthInMeter: double, bearing: double>"
LINE_FEATURE = f"struct<type: string, geometry: struct<type: string, coordinates: array<array<double>>>, properties: {SEGMENT}>"
NETWORK = f"struct<type: string, features: array<{LINE_FEATURE}>>"
ATTRIBUTES = "map<string, struct<type: string, value: string>>"
POINT = "struct<type: string, coordinates: array<double>>"
TRAJECTORY = f"struct<type: string, oid: string, tid: string, features: array<struct<type: string, geometry: {POINT}, properties: struct<time: string, attributes: {ATTRIBUTES}>>>>"
MATCHED = f"struct<type: string, oid: string, tid: string, features: array<struct<type: string, geometry: {POINT}, properties: struct<time: string, roadSegmentId: int, errorDistanceInMeter: double, matchedIndex: int, offsetInMeter: double, rawLat: double, rawLon: double>>>>"
TIME = "yyyy-MM-dd HH:mm:ss.S"


def _line(points: Column) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.transform(points, lambda p: F.array(p["lng"], p["lat"])).alias("coordinates"))


def _point(lng, lat) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates"))


def _feature(geometry: Column, properties: Column) -> Column:
    return F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))


def _collection(features: Column, *properties: Column) -> Column:
    """Top-level properties beside the features."""
    return F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), *properties, features.alias("features"))).alias("geojson")


def segment_feature() -> Column:
    """Of a row of road_segments; the bearing is 0 as in tables without one."""
    own = F.struct(F.col("segment_id").alias("rsId"), "direction", F.col("speed_limit").alias("speedLimit"), "level", F.col("start_id").alias("startId"), F.col("end_id").alias("endId"), F.col("length_m").alias("lengthInMeter"), F.lit(0.0).alias("bearing"))
    return _feature(_line(F.col("points")), own)


def write_segments(segments: DataFrame) -> DataFrame:
    return segments.select(F.to_json(segment_feature()).alias("geojson"))


def _segment(f: Column) -> list[Column]:
    p = f["properties"]
    points = F.transform(f["geometry"]["coordinates"], lambda c: F.struct(c[0].alias("lng"), c[1].alias("lat")))
    return [p["rsId"].alias("segment_id"), p["startId"].alias("start_id"), p["endId"].alias("end_id"), points.alias("points"), p["direction"].alias("direction"), p["level"].alias("level"), p["speedLimit"].alias("speed_limit"), p["lengthInMeter"].alias("length_m")]


def read_segments(rows: DataFrame, column: str = "geojson") -> DataFrame:
    return rows.select(F.from_json(column, LINE_FEATURE).alias("f")).select(*_segment(F.col("f")))


def write_network(segments: DataFrame) -> DataFrame:
    """One document of a network that fits one (backward segments flipped, twins not written); large ones: write_segments."""
    return segments.agg(F.sort_array(F.collect_list(F.struct("segment_id", segment_feature().alias("f")))).alias("s")).select(_collection(F.transform("s", lambda x: x["f"])))


def read_network(rows: DataFrame, column: str = "geojson") -> DataFrame:
    return rows.select(F.explode(F.from_json(column, NETWORK)["features"]).alias("f")).select(*_segment(F.col("f")))


def _time(c) -> Column:
    return F.date_format(col(c), TIME)


def write_trajectories(nested: DataFrame) -> DataFrame:
    """nested: tid, oid, points, and attributes (ATTRIBUTES) if it has them, which each feature repeats."""
    own = F.col("attributes") if "attributes" in nested.columns else F.lit(None).cast(ATTRIBUTES)
    features = F.transform("points", lambda p: _feature(_point(p["lng"], p["lat"]), F.struct(_time(p["time"]).alias("time"), own.alias("attributes"))))
    return nested.select("tid", _collection(features, F.col("oid"), F.col("tid")))


def read_trajectories(rows: DataFrame, column: str = "geojson") -> DataFrame:
    """tid, oid, points, attributes (the last feature's)."""
    j = F.from_json(column, TRAJECTORY)
    points = F.transform(j["features"], lambda f, i: F.struct(i.alias("idx"), F.try_to_timestamp(f["properties"]["time"]).alias("time"), f["geometry"]["coordinates"][0].alias("lng"), f["geometry"]["coordinates"][1].alias("lat")))
    return rows.select(j["tid"].alias("tid"), j["oid"].alias("oid"), points.alias("points"), F.try_element_at(j["features"], F.lit(-1))["properties"]["attributes"].alias("attributes"))


def write_matched(matched: DataFrame, raw: bool = False) -> DataFrame:
    """A row for each trajectory: its matched points as features; raw adds the observed place."""
    own = [_time("time").alias("time"), F.col("segment_id").alias("roadSegmentId"), F.col("err_m").alias("errorDistanceInMeter"), F.col("matched_index").alias("matchedIndex"), F.col("offset_m").alias("offsetInMeter")]
    own += [F.col("raw_lat").alias("rawLat"), F.col("raw_lng").alias("rawLon")] if raw else []
    rows = matched.where(F.col("segment_id").isNotNull()).select("tid", "oid", F.struct("idx", _feature(_point(F.col("lng"), F.col("lat")), F.struct(*own)).alias("f")).alias("x"))
    each = rows.groupBy("tid").agg(F.first("oid").alias("oid"), F.sort_array(F.collect_list(F.struct("x.idx", F.to_json("x.f").alias("f")))).alias("s"))
    # Features are JSON already, as structs with arrays can't be sorted past their index cheaply.
    head = F.concat(F.lit('{"type":"FeatureCollection","oid":'), F.to_json(F.array("oid")).substr(F.lit(2), F.length(F.to_json(F.array("oid"))) - 2), F.lit(',"tid":'), F.to_json(F.array("tid")).substr(F.lit(2), F.length(F.to_json(F.array("tid"))) - 2))
    return each.select("tid", F.concat(head, F.lit(',"features":['), F.array_join(F.transform("s", lambda x: x["f"]), ","), F.lit("]}")).alias("geojson"))


def read_matched(rows: DataFrame, column: str = "geojson") -> DataFrame:
    """tid, oid, idx (position), time, segment_id, lng, lat, err_m, offset_m, matched_index, raw_lng, raw_lat."""
    j = rows.select(F.from_json(column, MATCHED).alias("j")).select("j.tid", "j.oid", F.posexplode("j.features").alias("idx", "f"))
    p, g = F.col("f.properties"), F.col("f.geometry.coordinates")
    return j.select("tid", "oid", "idx", F.try_to_timestamp(p["time"]).alias("time"), p["roadSegmentId"].alias("segment_id"), g[0].alias("lng"), g[1].alias("lat"), p["errorDistanceInMeter"].alias("err_m"), p["offsetInMeter"].alias("offset_m"), p["matchedIndex"].alias("matched_index"), p["rawLon"].alias("raw_lng"), p["rawLat"].alias("raw_lat"))


def read_raw_points(rows: DataFrame, column: str = "geojson") -> DataFrame:
    """The observed points of matched documents."""
    return read_matched(rows, column).select("tid", "oid", "idx", "time", F.col("raw_lng").alias("lng"), F.col("raw_lat").alias("lat"))


def write_paths(paths: DataFrame) -> DataFrame:
    """A row for each part: points as features, and its segments."""
    features = F.transform("points", lambda p: F.struct(F.lit("Feature").alias("type"), _point(p["lng"], p["lat"]).alias("geometry")))
    return paths.select("tid", "part", _collection(features, F.col("oid"), F.col("tid"), F.col("segment_ids").alias("roadSegmentIds")))


def write_routes(routes: DataFrame) -> DataFrame:
    """Of rows with points, length_m and segment_ids: a line feature."""
    return routes.select(F.to_json(_feature(_line(F.col("points")), F.struct(F.col("length_m").alias("lengthInMeter"), F.col("segment_ids").alias("roadSegmentIds")))).alias("geojson"))
