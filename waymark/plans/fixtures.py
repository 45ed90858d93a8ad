"""A deterministic 12 x 12 lattice city and noisy walks, derived from the tables part and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions.geo import polyline_length
from waymark.session import width

SIDE = 12


def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where(F.col("p_partkey") < SIDE * SIDE).select(F.col("p_partkey").cast("int").alias("node_id"))
    p = p.withColumns({"r": F.floor(F.col("node_id") / SIDE).cast("int"), "c": F.col("node_id") % SIDE})
    return p.withColumns({"lng": 104.00 + 0.002 * F.col("c"), "lat": 30.60 + 0.0018 * F.col("r")})


def road_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as a source has them: segment_id, start_id, end_id, points, direction, level, speed_limit, length_m."""
    a, b = road_nodes(spark, sf_dir).alias("a"), road_nodes(spark, sf_dir).alias("b")
    # The neighbour's id is a function of the node's: an equality join, not a lattice of pairs.
    ways = F.explode(F.array(F.struct(F.lit(0).alias("up"), (F.col("node_id") + 1).alias("to")), F.struct(F.lit(1).alias("up"), (F.col("node_id") + SIDE).alias("to"))))
    out = a.select("a.*", ways.alias("w")).where((F.col("w.up") == 1) | (F.col("c") < SIDE - 1)).alias("a")
    j = out.join(b, F.col("a.w.to") == F.col("b.node_id"))
    a_id, shift = F.col("a.node_id"), (F.col("a.node_id") % 3 - 1) * F.lit(0.00005)
    direction = F.when(a_id % 5 == 0, 2).when(a_id % 7 == 0, 3).otherwise(1)
    point = lambda x, y: F.struct(x.alias("lng"), y.alias("lat"))
    middle = point((F.col("a.lng") + F.col("b.lng")) / 2 + shift, (F.col("a.lat") + F.col("b.lat")) / 2 + shift)
    segs = j.select(
        (1 + 2 * a_id + F.col("a.w.up")).cast("int").alias("segment_id"), a_id.alias("start_id"), F.col("b.node_id").alias("end_id"),
        F.array(point(F.col("a.lng"), F.col("a.lat")), middle, point(F.col("b.lng"), F.col("b.lat"))).alias("points"),
        direction.cast("int").alias("direction"), F.lit(6).alias("level"), F.lit(60.0).alias("speed_limit"),
    )
    return segs.withColumn("length_m", polyline_length("points"))


def gps_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tid, oid, idx, time, lng, lat, event_id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts").repartition(width(spark), "user_id")
    k = (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    e = e.withColumn("idx", k).withColumn("s", 0.15 * F.col("idx")).withColumn("e", F.floor("s")).withColumn("f", F.col("s") - F.col("e"))
    tri = lambda z: F.lit(11) - F.abs(z % 22 - 11)
    even = (F.col("e") % 2 == 0).cast("int")
    x0, y0 = F.ceil(F.col("e") / 2) + F.col("user_id") % 12, F.floor(F.col("e") / 2) + (7 * F.col("user_id")) % 12
    lng = 104.00 + 0.002 * (tri(x0) + F.col("f") * (tri(x0 + even) - tri(x0))) + ((37 * F.col("event_id")) % 41 - 20) * F.lit(0.00001) + F.when(F.col("event_id") % 97 == 0, 0.5).otherwise(0.0)
    lat = 30.60 + 0.0018 * (tri(y0) + F.col("f") * (tri(y0 + 1 - even) - tri(y0))) + ((53 * F.col("event_id")) % 41 - 20) * F.lit(0.00001)
    time = F.timestamp_micros(F.lit(1704067200000000) + F.col("idx").cast("long") * 3000000)
    return e.select(F.col("user_id").cast("string").alias("tid"), F.col("user_id").cast("string").alias("oid"), "idx", time.alias("time"), lng.alias("lng"), lat.alias("lat"), "event_id")
