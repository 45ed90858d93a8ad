"""Window, aggregate and set operators over gps points and matched rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from waymark.functions.geo import angle_between, bearing, haversine


def by_point() -> WindowSpec:
    """A trajectory's rows in order."""
    return Window.partitionBy("tid").orderBy("idx")


def _millis(name: str) -> Column:
    return F.unix_millis(F.col(name).cast("timestamp"))


def stride(points: DataFrame, skip: int) -> DataFrame:
    """Keeps one and skips `skip` (by idx, which is the ordinal)."""
    return points.where(F.col("idx") % (skip + 1) == 0)


def stride_of(original_rate: int, result_rate: int) -> int:
    """Points to skip for a coarser rate."""
    return result_rate // original_rate - 1


def truncate(points: DataFrame, most: int) -> DataFrame:
    return points.where(F.col("idx") < most)


def pairs(points: DataFrame) -> DataFrame:
    """Points with the one before: prev_lng, prev_lat, prev_time, leg_m (null for the first)."""
    out = points.withColumns({f"prev_{c}": F.lag(c).over(by_point()) for c in ("lng", "lat", "time")})
    return out.withColumn("leg_m", haversine("prev_lng", "prev_lat", "lng", "lat"))


def window_bearing(points: DataFrame, window: int = 8) -> DataFrame:
    """Moving points with leg_m, bearing, turn, score (of the window's turns / 180) and stable (score <= 0.2).

    Points that did not move are dropped first, as the window passes over them."""
    moved = pairs(points).where((F.col("leg_m") > 0) | F.col("leg_m").isNull())
    legs = moved.withColumn("bearing", F.when(F.lag("lng").over(by_point()).isNotNull(), bearing(F.lag("lng").over(by_point()), F.lag("lat").over(by_point()), "lng", "lat")))
    turns = legs.withColumn("turn", angle_between(F.lag("bearing").over(by_point()), F.col("bearing")))
    score = F.sum(F.col("turn") / 180).over(by_point().rowsBetween(-(window - 3), 0))
    return turns.withColumn("score", score).withColumn("stable", F.coalesce(F.col("score") <= 0.2, F.lit(False)))


def statistics(points: DataFrame) -> DataFrame:
    """tid, n, start and end time and place, box, length_km, speed_kmh (null for no duration)."""
    p = pairs(points)
    at = lambda f, c: f(F.col(c), F.col("idx"))
    s = p.groupBy("tid").agg(
        F.count("*").alias("n"), *[at(F.min_by, c).alias(f"start_{c}") for c in ("time", "lng", "lat")], *[at(F.max_by, c).alias(f"end_{c}") for c in ("time", "lng", "lat")],
        *[f(c).alias(f"{k}_{c}") for c in ("lng", "lat") for k, f in (("min", F.min), ("max", F.max))], (F.coalesce(F.sum("leg_m"), F.lit(0.0)) / 1000).alias("length_km"),
    )
    hours = (_millis("end_time") - _millis("start_time")) / F.lit(3_600_000.0)
    return s.withColumn("speed_kmh", F.try_divide(F.col("length_km"), F.nullif(hours, F.lit(0.0))))


def moving_speed(points: DataFrame, window: int = 5) -> DataFrame:
    """speed in m/s of each leg and its mean over the last few."""
    p = pairs(points)
    seconds = (_millis("time") - _millis("prev_time")) / F.lit(1000.0)
    p = p.withColumn("speed", F.try_divide(F.col("leg_m"), F.nullif(seconds, F.lit(0.0))))
    return p.withColumn("mean_speed", F.avg("speed").over(by_point().rowsBetween(-(window - 1), 0)))


def running_spread(matched: DataFrame, value: str) -> DataFrame:
    """Running mean and sample deviation of a column along a trajectory."""
    w = by_point().rowsBetween(Window.unboundedPreceding, 0)
    return matched.withColumns({"run_mean": F.avg(value).over(w), "run_sd": F.stddev_samp(value).over(w)})


def root_mean_square(matched: DataFrame, value: str) -> DataFrame:
    return matched.groupBy("tid").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def consecutive(rows: DataFrame, value: str) -> DataFrame:
    """Without rows that repeat the value of the row before."""
    before = F.lag(value).over(by_point())
    return rows.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col(value))).drop("__b")


def consecutive_array(values: Column) -> Column:
    """An array without elements equal to the one before."""
    return F.filter(values, lambda x, i: (i == 0) | (x != F.element_at(values, F.greatest(i, F.lit(1)))))


def nested(points: DataFrame) -> DataFrame:
    """A row for each trajectory: tid, oid, points (sorted array of idx, time, lng, lat)."""
    return points.groupBy("tid").agg(F.first("oid").alias("oid"), F.sort_array(F.collect_list(F.struct("idx", "time", "lng", "lat"))).alias("points"))


def flat(trajectories: DataFrame) -> DataFrame:
    return trajectories.select("tid", "oid", F.explode("points").alias("p")).select("tid", "oid", "p.*")


def end_point(matched: DataFrame, expanded: DataFrame) -> DataFrame:
    """Matched rows with is_end and is_start: whether the match lies on its segment's end or start node."""
    s = expanded.select("segment_id", F.element_at("points", 1).alias("f"), F.element_at("points", -1).alias("l"))
    on = lambda p: (F.col("lng") == F.col(f"{p}.lng")) & (F.col("lat") == F.col(f"{p}.lat"))
    return matched.join(s, "segment_id").withColumns({"is_start": on("f"), "is_end": on("l")}).drop("f", "l")
