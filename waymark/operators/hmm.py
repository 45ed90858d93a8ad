"""Emission and transition tables as DataFrame expressions (no Python in them)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.geo import col, haversine, leg_lengths, offset_on
from waymark.operators.decoder import ALPHA, BETA, CUT, SIGMA
from waymark.plans.network import DUAL


def emission(err, sigma: float = SIGMA) -> Column:
    return F.lit(math.log(1 / (math.sqrt(2 * math.pi) * sigma))) - 0.5 * F.pow(col(err) / sigma, 2)


def transition(route, linear, beta: float = BETA) -> Column:
    """Null route or a difference over CUT: minus infinity."""
    m = F.abs(col(linear) - col(route))
    return F.when(m <= CUT, F.lit(math.log(1 / beta)) - m / beta).otherwise(F.lit(-math.inf))


def turn(angle, alpha: float = ALPHA) -> Column:
    return emission(angle, alpha)


def _sum(legs: Column, first: Column, n: Column) -> Column:
    return F.aggregate(F.slice(legs, first, F.greatest(n, F.lit(0))), F.lit(0.0), lambda a, x: a + x)


def along(points, leg_a, lng_a, lat_a, leg_b, lng_b, lat_b) -> Column:
    """Metres from place a on to place b of one polyline."""
    points, leg_a, leg_b = map(col, (points, leg_a, leg_b))
    legs, after, at = leg_lengths(points), F.element_at(points, leg_a + 2), F.element_at(points, leg_b + 1)
    bent = haversine(lng_a, lat_a, after["lng"], after["lat"]) + _sum(legs, leg_a + 2, leg_b - leg_a - 1) + haversine(at["lng"], at["lat"], lng_b, lat_b)
    return F.when(leg_a == leg_b, haversine(lng_a, lat_a, lng_b, lat_b)).otherwise(bent)


def tail(points, leg, lng, lat) -> Column:
    points, leg = col(points), col(leg)
    after = F.element_at(points, leg + 2)
    return haversine(lng, lat, after["lng"], after["lat"]) + _sum(leg_lengths(points), leg + 2, F.size(points) - 2 - leg)


def lattice(candidates: DataFrame, expanded: DataFrame, sp: DataFrame) -> DataFrame:
    """Table transitions: tid, idx, prev_segment_id, segment_id, route_m, linear_m, log_p for all pairs of candidates of
    consecutive points. route_m is null where there is no way.

    candidates: what operators.candidates gives for points (tid, idx, lng, lat)."""
    seg = expanded.select("segment_id", "start_id", "end_id", "direction", F.col("points").alias("line"))
    cols = ["tid", "idx", "lng", "lat", "segment_id", "matched_index", "cand_lng", "cand_lat", "offset_m"]
    # What does not depend on the pair is a number of each candidate; no line goes through the joins of pairs.
    c = candidates.select(*cols).join(seg, "segment_id").withColumn("tail_m", tail("line", "matched_index", "cand_lng", "cand_lat")).drop("line")
    a = c.select("tid", (F.col("idx") + 1).alias("idx"), *[F.col(x).alias(f"a_{x}") for x in c.columns if x not in ("tid", "idx")])
    b = c.select("tid", "idx", *[F.col(x).alias(f"b_{x}") for x in c.columns if x not in ("tid", "idx", "end_id", "direction", "tail_m")])
    j = a.join(b, ["tid", "idx"]).join(sp.select(F.col("src").alias("a_end_id"), F.col("dst").alias("b_start_id"), F.col("length_m").alias("sp_m")), ["a_end_id", "b_start_id"], "left")
    # Only pairs on one road need its line.
    twin = F.col("b_segment_id") == -F.col("a_segment_id")
    j = j.withColumn("same", twin | (F.col("a_segment_id") == F.col("b_segment_id")))
    lines = expanded.select(F.col("segment_id").alias("line_id"), F.col("points").alias("a_line"))
    j = j.join(lines, F.when(F.col("same"), F.col("a_segment_id")) == F.col("line_id"), "left")
    # A candidate on the twin is re-expressed on the first one's segment.
    leg = F.when(twin, F.size("a_line") - 2 - F.col("b_matched_index")).otherwise(F.col("b_matched_index"))
    j = j.withColumn("leg", leg)
    j = j.withColumn("off", F.when(twin, offset_on("a_line", "leg", "b_cand_lng", "b_cand_lat")).otherwise(F.col("b_offset_m")))
    on = along("a_line", "a_matched_index", "a_cand_lng", "a_cand_lat", "leg", "b_cand_lng", "b_cand_lat")
    back = along("a_line", "leg", "b_cand_lng", "b_cand_lat", "a_matched_index", "a_cand_lng", "a_cand_lat")
    nodes = F.when(F.col("a_end_id") == F.col("b_start_id"), F.lit(0.0)).otherwise(F.col("sp_m"))
    through = F.col("a_tail_m") + nodes + F.col("b_offset_m")
    # Only one-way segments that are left backwards go round, and then from the twin's start if b was re-expressed.
    route = F.when(F.col("same") & (F.col("a_offset_m") <= F.col("off")), on).when(F.col("same") & (F.col("a_direction") == DUAL), back).otherwise(through)
    linear = haversine("a_lng", "a_lat", "b_lng", "b_lat")
    out = j.select("tid", "idx", F.col("a_segment_id").alias("prev_segment_id"), F.col("b_segment_id").alias("segment_id"), route.alias("route_m"), linear.alias("linear_m"))
    return out.withColumn("log_p", transition("route_m", "linear_m"))


def relative_emission(candidates: DataFrame, floor: float = 1e-9) -> DataFrame:
    """The adaptive online matcher's emission: ln of the inverse distance over its mean at the point."""
    inverse = 1 / F.greatest(F.col("err_m"), F.lit(floor))
    return candidates.withColumn("log_p", F.ln(inverse / F.avg(inverse).over(Window.partitionBy("tid", "idx"))))


def relative_transition(transitions: DataFrame, floor: float = 1e-9) -> DataFrame:
    """The adaptive online matcher's transition: the same of |linear - route| among the ways from one candidate."""
    inverse = 1 / F.greatest(F.abs(F.col("linear_m") - F.col("route_m")), F.lit(floor))
    return transitions.where("route_m is not null").withColumn("log_p", F.ln(inverse / F.avg(inverse).over(Window.partitionBy("tid", "idx", "prev_segment_id"))))
