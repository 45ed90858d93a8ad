"""The road network as tables: directed expansion, edges, bounds, and the arrays that decoders and routers share.

Codes of direction: -1 undefined (as one-way), 1 dual, 2 forward, 3 backward.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.geo import points_bbox

UNDEFINED, DUAL, FORWARD, BACKWARD = -1, 1, 2, 3
#: The most vertices of a network that goes to every task, some 110 bytes each and Python worker (the default is 220 MB);
#: larger ones take the iterative search.
BROADCAST_VERTICES = 2_000_000
_INT_MIN = -(2**31)


def flipped(segments: DataFrame) -> DataFrame:
    """Backward segments turned round: reversed points, ends swapped, the same id, direction forward."""
    back = F.col("direction") == BACKWARD
    return segments.withColumns(
        {
            "points": F.when(back, F.reverse("points")).otherwise(F.col("points")),
            "start_id": F.when(back, F.col("end_id")).otherwise(F.col("start_id")),
            "end_id": F.when(back, F.col("start_id")).otherwise(F.col("end_id")),
            "direction": F.when(back, F.lit(FORWARD)).otherwise(F.col("direction")),
        }
    )


def expand(segments: DataFrame) -> DataFrame:
    """All directed segments; one scan, as each row yields itself and at most one twin."""
    flat = flipped(segments)
    twin = F.explode(F.when(F.col("direction") == DUAL, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    both = flat.withColumn("twin", twin)
    t = F.col("twin")
    return both.withColumns(
        {
            "segment_id": F.when(t, F.when(F.col("segment_id") == 0, F.lit(_INT_MIN)).otherwise(-F.col("segment_id"))).otherwise(F.col("segment_id")).cast("int"),
            "points": F.when(t, F.reverse("points")).otherwise(F.col("points")),
            "start_id": F.when(t, F.col("end_id")).otherwise(F.col("start_id")),
            "end_id": F.when(t, F.col("start_id")).otherwise(F.col("end_id")),
        }
    ).drop("twin")


def edges(expanded: DataFrame, directed: bool = True) -> DataFrame:
    """(src, dst, segment_id, length_m); undirected: each edge both ways."""
    e = expanded.select(F.col("start_id").alias("src"), F.col("end_id").alias("dst"), "segment_id", "length_m")
    return e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "segment_id", "length_m"))


def bounds(segments: DataFrame) -> DataFrame:
    """The box around all segments (true minima and maxima)."""
    b = segments.select(points_bbox("points").alias("b"))
    return b.agg(F.min("b.min_lng").alias("min_lng"), F.min("b.min_lat").alias("min_lat"), F.max("b.max_lng").alias("max_lng"), F.max("b.max_lat").alias("max_lat"))


def one_hop(expanded: DataFrame) -> DataFrame:
    """(segment_id, next_id): segments that begin where one ends, itself left out."""
    a, b = expanded.select("segment_id", "end_id"), expanded.select(F.col("segment_id").alias("next_id"), "start_id")
    return a.join(b, (F.col("end_id") == F.col("start_id")) & (F.col("segment_id") != F.col("next_id"))).select("segment_id", "next_id")


def at_nodes(expanded: DataFrame) -> DataFrame:
    """(node_id, segment_id, role): the outgoing segments of a node begin there, its incoming ones end there."""
    ends = F.explode(F.array(F.struct(F.col("start_id").alias("node_id"), F.lit("outgoing").alias("role")), F.struct(F.col("end_id").alias("node_id"), F.lit("incoming").alias("role"))))
    return expanded.select("segment_id", ends.alias("e")).select("e.node_id", "segment_id", "e.role")


def adjacent(expanded: DataFrame) -> DataFrame:
    """(segment_id, other_id): pairs of segments that share a node."""
    ends = expanded.select("segment_id", F.explode(F.array_distinct(F.array("start_id", "end_id"))).alias("node_id"))
    return ends.join(ends.withColumnRenamed("segment_id", "other_id"), "node_id").where("segment_id < other_id").select("segment_id", "other_id").distinct()


def collected(expanded: DataFrame, most: int = BROADCAST_VERTICES) -> dict[int, tuple]:
    """segment id -> (start, end, dual, length, [(lng, lat)]), for broadcasting; ValueError above the bound."""
    size = expanded.agg(F.sum(F.size("points"))).first()[0] or 0
    if size > most:
        raise ValueError(f"the network has {size} vertices, {most} may be broadcast: matching, routes and recovery are limited to that; shortest_path.iterative has lengths between nodes of larger ones")
    rows = expanded.select("segment_id", "start_id", "end_id", (F.col("direction") == DUAL).alias("dual"), "length_m", F.col("points.lng").alias("x"), F.col("points.lat").alias("y")).collect()
    return {r["segment_id"]: (r["start_id"], r["end_id"], r["dual"], r["length_m"], list(zip(r["x"], r["y"]))) for r in rows}
