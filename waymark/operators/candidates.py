"""Candidate search: the spatial range join of points and segments, and the nearest segment.

A range join would be a nested loop. Here both sides are cut to grid cells: a segment's legs are rows with what does not
depend on the point (length, bearing, offset); a leg's box, widened by the radius, is exploded to the cells it touches; a
point has one cell, and the join is on equal cells with the exact distance as its condition, so an outer join keeps
the misses and all of it is generated code. A point meets each leg once. Legs are broadcast only when their counted cells are few; else Spark
shuffles both sides by cell and AQE splits hot cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.geo import PER_METRE, bearing, haversine, leg_lengths

RADIUS = 50.0
#: Rows of (cell, leg) that may be broadcast, about 100 bytes each.
BROADCAST_CELLS = 400_000


def cell_degrees(radius: float) -> float:
    return max(4 * radius, 200.0) * PER_METRE


def legs(segments: DataFrame) -> DataFrame:
    """segment_id, matched_index, x1, y1, x2, y2, leg_m, leg_bearing, before_m (the segment's length up to the leg)."""
    whole = segments.select("segment_id", "points", leg_lengths("points").alias("m"))
    each = whole.select("segment_id", "points", "m", F.posexplode("m").alias("matched_index", "leg_m"))
    a, b = F.element_at("points", F.col("matched_index") + 1), F.element_at("points", F.col("matched_index") + 2)
    flat = each.select("segment_id", "matched_index", a["lng"].alias("x1"), a["lat"].alias("y1"), b["lng"].alias("x2"), b["lat"].alias("y2"), "leg_m", F.aggregate(F.slice("m", 1, F.col("matched_index")), F.lit(0.0), lambda t, x: t + x).alias("before_m"))
    return flat.withColumn("leg_bearing", bearing("x1", "y1", "x2", "y2"))


def cells(segments: DataFrame, radius: float = RADIUS) -> DataFrame:
    """legs() with its widened box (west, east, south, north), a row for each grid cell (cx, cy) that the box touches."""
    cell, d = cell_degrees(radius), radius * PER_METRE
    # The widest span of longitude in the box is at its largest latitude (poles excepted); a little more for rounding.
    w = d / F.greatest(F.cos(F.radians(F.greatest(F.abs("y1"), F.abs("y2")) + d)), F.lit(0.01)) * 1.001
    box = {"west": F.least("x1", "x2") - w, "east": F.greatest("x1", "x2") + w, "south": F.least("y1", "y2") - d * 1.001, "north": F.greatest("y1", "y2") + d * 1.001}
    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))
    return legs(segments).withColumns(box).withColumn("cx", span("west", "east")).withColumn("cy", span("south", "north"))


def _rate(lng: str, lat: str) -> Column:
    along = haversine("x1", "y1", lng, lat) * F.cos(F.radians(bearing("x1", "y1", lng, lat) - F.col("leg_bearing")))
    return F.coalesce(F.try_divide(along, F.nullif(F.col("leg_m"), F.lit(0.0))), F.lit(0.0))


def foot(lng: str, lat: str) -> tuple[Column, Column, Column]:
    """(err_m, cand_lng, cand_lat): the place of a point on a row of legs(); beyond a leg's ends the ends themselves."""
    rate = _rate(lng, lat)
    on = lambda a, b: F.when(rate > 1, F.col(b)).when(rate < 0, F.col(a)).otherwise(F.col(a) + rate * (F.col(b) - F.col(a)))
    x, y = on("x1", "x2"), on("y1", "y2")
    return haversine(lng, lat, x, y), x, y


def reach() -> Column:
    """The same distance to rounding, for the join's condition: radians, sines and cosines of points and legs are
    columns, as large generated methods are not compiled by the JVM."""
    d = F.col("__lng") - F.col("lng1")
    a = F.pow(F.sin((F.col("__lat") - F.col("lat1")) / 2), 2) + F.col("cos1") * F.col("__cos") * F.pow(F.sin(d / 2), 2)
    x, y = F.col("cos1") * F.col("__sin") - F.col("sin1") * F.col("__cos") * F.cos(d), F.sin(d) * F.col("__cos")
    along = 2 * geo.RADIUS * F.asin(F.sqrt(a)) * F.cos(F.atan2(y, x) - F.col("turn_b"))
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along * F.col("per_m")))
    lat = F.col("lat1") + held * F.col("dlat")
    b = F.pow(F.sin((F.col("__lat") - lat) / 2), 2) + F.cos(lat) * F.col("__cos") * F.pow(F.sin((d - held * F.col("dlng")) / 2), 2)
    return 2 * geo.RADIUS * F.asin(F.sqrt(b))


def _angles(name: str, lng: str, lat: str) -> dict[str, Column]:
    rad = F.radians(F.col(lat))
    return {f"{name}lng": F.radians(F.col(lng)), f"{name}lat": rad, f"{name}cos": F.cos(rad), f"{name}sin": F.sin(rad)}


def hits(points: DataFrame, segments: DataFrame, radius: float = RADIUS, keep_misses: bool = False, broadcast: bool | None = None) -> DataFrame:
    """points with segment_id, matched_index, err_m, cand_lng, cand_lat, offset_m: a row for each LEG within the radius."""
    cut, cell = cells(segments, radius), cell_degrees(radius)
    own = {k.replace("leg_", "") + "1": v for k, v in _angles("leg_", "x1", "y1").items()}
    own |= {"dlng": F.radians(F.col("x2") - F.col("x1")), "dlat": F.radians(F.col("y2") - F.col("y1")), "turn_b": F.radians("leg_bearing"), "per_m": F.coalesce(F.try_divide(F.lit(1.0), F.nullif(F.col("leg_m"), F.lit(0.0))), F.lit(0.0))}
    cut = cut.withColumns(own)
    if broadcast or broadcast is None and cut.count() <= BROADCAST_CELLS:
        cut = F.broadcast(cut)
    p = points.withColumns({"__cx": F.floor(F.col("lng") / cell), "__cy": F.floor(F.col("lat") / cell), **_angles("__", "lng", "lat")})
    err, x, y = foot("lng", "lat")
    inside = F.col("lng").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    j = p.join(cut, (F.col("__cx") == F.col("cx")) & (F.col("__cy") == F.col("cy")) & inside & (reach() <= radius), "left" if keep_misses else "inner")
    found = j.select(*points.columns, "segment_id", "matched_index", err.alias("err_m"), x.alias("cand_lng"), y.alias("cand_lat"), "x1", "y1", "before_m")
    offset = F.col("before_m") + haversine("x1", "y1", "cand_lng", "cand_lat")
    return found.select(*points.columns, "segment_id", "matched_index", *[F.when(F.col("segment_id").isNotNull(), F.col(c)).alias(c) for c in ("err_m", "cand_lng", "cand_lat")], offset.alias("offset_m"))


def candidates(points: DataFrame, segments: DataFrame, radius: float = RADIUS, keep_misses: bool = False) -> DataFrame:
    """points with segment_id, matched_index, err_m, cand_lng, cand_lat, offset_m for every segment within the radius: its
    nearest leg, the first of equals.

    points needs lng, lat and keys (tid, idx, or all its columns); segments is the expanded network. keep_misses: points
    without a candidate stay, with nulls. Points with null coordinates have none."""
    h = hits(points, segments, radius, keep_misses)
    ids = [c for c in ("tid", "idx") if c in points.columns] or points.columns
    rest = [c for c in h.columns if c not in (*ids, "segment_id")]
    best = h.groupBy(*ids, "segment_id").agg(F.min_by(F.struct(*rest), F.struct("err_m", "matched_index")).alias("b"), F.first(F.struct(*rest)).alias("f"))
    row = F.coalesce("b", "f")  # misses have no least error
    return best.select(*[F.col(c) if c in ids else row[c].alias(c) for c in points.columns], "segment_id", *[row[c].alias(c) for c in ("matched_index", "err_m", "cand_lng", "cand_lat", "offset_m")])


def best_first() -> list:
    """The order of equal candidates: error to the micrometre, then the positive id, then the smaller one."""
    return [F.round("err_m", 6), (F.col("segment_id") < 0).cast("int"), F.abs(F.col("segment_id").cast("long"))]


def nearest(points: DataFrame, segments: DataFrame, radius: float = RADIUS, keys: tuple[str, ...] = ("tid", "idx")) -> DataFrame:
    """The best candidate of each point that has one; an aggregation with map-side combining, no sort of all rows."""
    c = hits(points, segments, radius)
    fields = [x for x in c.columns if x not in keys]
    order = F.struct(*[x.alias(f"o{k}") for k, x in enumerate([*best_first(), F.col("err_m"), F.col("matched_index")])])
    best = c.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("b"))
    return best.select(*keys, *[F.col(f"b.{x}").alias(x) for x in fields])


def top(points: DataFrame, segments: DataFrame, k: int, radius: float = RADIUS, keys: tuple[str, ...] = ("tid", "idx")) -> DataFrame:
    """The k best candidates of each point, with their rank."""
    c = candidates(points, segments, radius)
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best_first()))).where(F.col("rank") <= k)


def unmatched(points: DataFrame, segments: DataFrame, radius: float = RADIUS, keys: tuple[str, ...] = ("tid", "idx")) -> DataFrame:
    """Points without a candidate."""
    return points.join(hits(points, segments, radius).select(*keys).distinct(), list(keys), "left_anti")
