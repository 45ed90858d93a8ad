"""The registered queries of the map-matching engine over the derived fixtures, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import oracle as O
from waymark.functions import coords, geo, types, weights, wkt
from waymark.operators import candidates as C
from waymark.operators import evaluate, hmm, matchers, recover, shortest_path, trajectory
from waymark.plans import fixtures, network
from waymark.sources import geojson, results, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def raw(spark, d):
    return fixtures.road_segments(spark, d)


def seg(spark, d):
    return network.expand(raw(spark, d))


def pts(spark, d):
    return fixtures.gps_points(spark, d)


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def r9(*names):
    return [F.round(n, 9).alias(n) for n in names]


def s6(*names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def s9(*names):
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


# ---------------------------------------------------------------- network and points


@query(f"WITH {O.NODES}, {O.RAW}, {O.LENGTH} SELECT segment_id, start_id, end_id, direction, {s6('length_m')}, {s9('x2', 'y2')} FROM lens")
def road_segments(spark, d):
    return raw(spark, d).select("segment_id", "start_id", "end_id", "direction", *r6("length_m"), F.round(F.col("points")[1]["lng"], 9).alias("x2"), F.round(F.col("points")[1]["lat"], 9).alias("y2"))


@query(f"WITH {O.NET} SELECT segment_id, start_id, end_id, direction, {s6('length_m')}, {s9('x1', 'y1', 'x3', 'y3')} FROM seg")
def road_network_expanded(spark, d):
    p = lambda k, c: F.round(F.element_at("points", k)[c], 9)
    return seg(spark, d).select("segment_id", "start_id", "end_id", "direction", *r6("length_m"), p(1, "lng").alias("x1"), p(1, "lat").alias("y1"), p(-1, "lng").alias("x3"), p(-1, "lat").alias("y3"))


@query(f"WITH {O.NET} SELECT start_id AS src, end_id AS dst, segment_id, {s6('length_m')} FROM seg UNION ALL SELECT end_id, start_id, segment_id, round(length_m, 6) FROM seg")
def undirected_edges(spark, d):
    return network.edges(seg(spark, d), directed=False).select("src", "dst", "segment_id", *r6("length_m"))


@query(f"WITH {O.NET} SELECT a.segment_id, b.segment_id AS next_id FROM seg a JOIN seg b ON a.end_id = b.start_id AND a.segment_id <> b.segment_id")
def one_hop_edges(spark, d):
    return network.one_hop(seg(spark, d))


@query(f"WITH {O.NET} SELECT start_id AS node_id, segment_id, 'outgoing' AS role FROM seg UNION ALL SELECT end_id, segment_id, 'incoming' FROM seg")
def node_segments(spark, d):
    return network.at_nodes(seg(spark, d))


@query(f"WITH {O.NET} SELECT a.segment_id, b.segment_id AS other_id FROM seg a JOIN seg b ON a.segment_id < b.segment_id AND (a.start_id IN (b.start_id, b.end_id) OR a.end_id IN (b.start_id, b.end_id))")
def adjacent_edges(spark, d):
    return network.adjacent(seg(spark, d))


@query(f"WITH {O.NET} SELECT {', '.join(f'round({f}({f2}({c}1, {c}2, {c}3)), 9) AS {f}_{n}' for f, f2 in (('min', 'least'), ('max', 'greatest')) for c, n in (('x', 'lng'), ('y', 'lat')))} FROM seg")
def network_bounds(spark, d):
    return network.bounds(seg(spark, d)).select(*r9("min_lng", "min_lat", "max_lng", "max_lat"))


@query(f"WITH {O.PTS} SELECT tid, idx, time, {s9('lng', 'lat')} FROM pts")
def gps_points(spark, d):
    return pts(spark, d).select("tid", "idx", "time", *r9("lng", "lat"))


@query(f"WITH {O.NET} SELECT segment_id, {s6('length_m')}, round({O.hav('x1', 'y1', 'x2', 'y2')}, 6) AS first_leg, {s9('x2', 'y2')} FROM flat")
def wkt_round_trip(spark, d):
    w = network.flipped(raw(spark, d)).select("segment_id", wkt.write_points("points").alias("wkt")).select("segment_id", wkt.read_points("wkt").alias("points"))
    return w.select("segment_id", F.round(geo.polyline_length("points"), 6).alias("length_m"), F.round(geo.leg_lengths("points")[0], 6).alias("first_leg"), F.round(F.col("points")[1]["lng"], 9).alias("x2"), F.round(F.col("points")[1]["lat"], 9).alias("y2"))


@query(f"WITH {O.NET} SELECT segment_id, start_id, end_id, direction, {s6('length_m')} FROM flat")
def network_geojson(spark, d):
    made = geojson.write_network(network.flipped(raw(spark, d)))
    return geojson.read_network(made).select("segment_id", "start_id", "end_id", "direction", *r6("length_m"))


@query(f"WITH {O.NET} SELECT segment_id, start_id, end_id, direction, {s6('length_m')} FROM lens")
def segment_geojson(spark, d):
    return geojson.read_segments(geojson.write_segments(raw(spark, d))).select("segment_id", "start_id", "end_id", "direction", *r6("length_m"))


@query(f"WITH {O.PTS} SELECT tid, tid AS oid, idx, time, {s9('lng', 'lat')} FROM pts")
def trajectory_geojson(spark, d):
    read = geojson.read_trajectories(geojson.write_trajectories(trajectory.nested(pts(spark, d))))
    return read.select("tid", "oid", F.explode("points").alias("p")).select("tid", "oid", "p.idx", "p.time", F.round("p.lng", 9).alias("lng"), F.round("p.lat", 9).alias("lat"))


_E, _N = O.gcj_shift("lng", "lat")


@query(f"WITH {O.PTS} SELECT tid || '2024-01-01 00:00:00' AS tid, tid AS oid, CAST(idx // 2 AS INTEGER) AS idx, time, round(lng - {_E}, 9) AS lng, round(lat - {_N}, 9) AS lat FROM pts WHERE idx % 2 = 0")
def trajectory_text(spark, d):
    """Lines written from the points and parsed again, thinned to every second point."""
    row = F.concat(F.lit('["'), F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.lit('",'), F.col("lng").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]"))
    lines = pts(spark, d).groupBy("oid").agg(F.sort_array(F.collect_list(F.struct("idx", row.alias("r")))).alias("s"))
    lines = lines.select(F.concat(F.lit("["), F.col("oid"), F.lit(",["), F.array_join(F.transform("s", lambda x: x["r"]), ","), F.lit("]]")).alias("value"))
    t = lines.select(text.parse_line("value", skip=1).alias("t")).select("t.tid", "t.oid", F.explode("t.points").alias("p"))
    return t.select("tid", "oid", "p.idx", "p.time", F.round("p.lng", 9).alias("lng"), F.round("p.lat", 9).alias("lat"))


# ---------------------------------------------------------------- scalar functions


def _bd(lng: str, lat: str) -> tuple[str, str]:
    z = f"(sqrt(({lng}) * ({lng}) + ({lat}) * ({lat})) + 0.00002e0 * sin(({lat}) * (pi() * 3000e0 / 180e0)))"
    t = f"(atan2({lat}, {lng}) + 0.000003e0 * cos(({lng}) * (pi() * 3000e0 / 180e0)))"
    return f"{z} * cos({t}) + 0.0065e0", f"{z} * sin({t}) + 0.006e0"


@query(
    f"WITH {O.PTS}, g AS (SELECT tid, idx, lng, lat, lng + {_E} AS gx, lat + {_N} AS gy, lng - {_E} AS wx, lat - {_N} AS wy FROM pts), "
    f"b AS (SELECT *, {_bd('gx', 'gy')[0]} AS zx, {_bd('gx', 'gy')[1]} AS zy FROM g) "
    f"SELECT tid, idx, {s9('gx', 'gy', 'wx', 'wy', 'zx', 'zy')} FROM b"
)
def coordinate_systems(spark, d):
    p = pts(spark, d).select("tid", "idx", coords.wgs84_to_gcj02("lng", "lat").alias("g"), coords.gcj02_to_wgs84("lng", "lat").alias("w"), coords.wgs84_to_bd09("lng", "lat").alias("z"))
    return p.select("tid", "idx", *[F.round(f"{k}.{c}", 9).alias(f"{k}{x}") for k in "gwz" for c, x in (("lng", "x"), ("lat", "y"))])


@query(f"WITH {O.PTS} SELECT tid, idx, round(lng - 50 * {O.PER_METRE} / cos(radians(lat)), 9) AS min_lng, round(lat - 50 * {O.PER_METRE}, 9) AS min_lat, round(lng + 50 * {O.PER_METRE} / cos(radians(lat)), 9) AS max_lng, round(lat + 50 * {O.PER_METRE}, 9) AS max_lat FROM pts")
def extended_bbox(spark, d):
    b = pts(spark, d).select("tid", "idx", geo.extended_bbox("lng", "lat", 50.0).alias("b")).select("tid", "idx", "b.*")
    return b.select("tid", "idx", *r9("min_lng", "min_lat", "max_lng", "max_lat"))


@query(
    f"WITH {O.PTS}, l AS (SELECT *, lag(lng) OVER w AS px, lag(lat) OVER w AS py, lead(lng) OVER w AS nx, lead(lat) OVER w AS ny FROM pts WINDOW w AS (PARTITION BY tid ORDER BY idx)) "
    f"SELECT tid, idx, round({O.hav('px', 'py', 'lng', 'lat')}, 6) AS leg_m, round({O.angle(O.bearing('px', 'py', 'lng', 'lat'), O.bearing('lng', 'lat', 'nx', 'ny'))}, 6) AS turn FROM l WHERE px IS NOT NULL AND nx IS NOT NULL"
)
def leg_distance_and_turn(spark, d):
    w = trajectory.by_point()
    p = pts(spark, d).withColumns({"px": F.lag("lng").over(w), "py": F.lag("lat").over(w), "nx": F.lead("lng").over(w), "ny": F.lead("lat").over(w)}).where("px is not null and nx is not null")
    return p.select("tid", "idx", F.round(geo.haversine("px", "py", "lng", "lat"), 6).alias("leg_m"), F.round(geo.bearing_difference(("px", "py"), ("lng", "lat"), ("lng", "lat"), ("nx", "ny")), 6).alias("turn"))


@query(
    f"WITH {O.PTS} SELECT tid, idx, CASE WHEN j = 0 OR i = 0 OR j = 12 OR i = 12 THEN -1 ELSE (j - 1) * 11 + i END AS cell FROM "
    "(SELECT tid, idx, CAST(sum(CASE WHEN 104.0e0 + 0.002e0 * k < lng THEN 1 ELSE 0 END) AS INTEGER) AS i, CAST(sum(CASE WHEN 30.6e0 + 0.0018e0 * k < lat THEN 1 ELSE 0 END) AS INTEGER) AS j FROM pts, range(12) g(k) GROUP BY tid, idx)"
)
def grid_cells(spark, d):
    return pts(spark, d).select("tid", "idx", geo.grid_cell("lng", "lat", [104.0 + 0.002 * k for k in range(12)], [30.6 + 0.0018 * k for k in range(12)]).alias("cell"))


@query("SELECT CAST(user_id AS VARCHAR) AS tid, event_id, CAST(event_id AS INTEGER) AS code, event_type AS kind, TRUE AS same, CAST(2 AS INTEGER) AS n FROM events")
def typed_attributes(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    own = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.cast("string").alias("value"))
    m = e.select("event_id", F.col("user_id").cast("string").alias("tid"), F.create_map(F.lit("code"), own("Integer", F.col("event_id")), F.lit("kind"), own("String", F.lit("?"))).alias("a"), "event_type")
    m = m.withColumn("b", types.with_attribute("a", "kind", "string", F.col("event_type")))
    return m.select("tid", "event_id", types.attribute("b", "code", "int").alias("code"), types.attribute("b", "kind", "String").alias("kind"), types.attributes_equal(F.col("b"), types.with_attribute("b", "kind", "String", F.col("event_type"))).alias("same"), F.size("b").alias("n"))


# ---------------------------------------------------------------- windows and aggregates


@query(f"WITH {O.PTS} SELECT tid, idx, time FROM pts WHERE idx % 5 = 0")
def stride_sample(spark, d):
    return trajectory.stride(pts(spark, d), 4).select("tid", "idx", "time")


_LEGS = f"l AS (SELECT *, {O.hav('px', 'py', 'lng', 'lat')} AS leg_m FROM (SELECT *, lag(lng) OVER w AS px, lag(lat) OVER w AS py FROM pts WINDOW w AS (PARTITION BY tid ORDER BY idx)))"


@query(
    f"WITH {O.PTS}, {_LEGS} SELECT tid, count(*) AS n, min(time) AS start_time, max(time) AS end_time, {', '.join(f'round({f}({c}), 9) AS {f}_{c}' for c in ('lng', 'lat') for f in ('min', 'max'))}, "
    "round(coalesce(sum(leg_m), 0) / 1000, 6) AS length_km, round(coalesce(sum(leg_m), 0) / 1000 / nullif((epoch_ms(max(time)) - epoch_ms(min(time))) / 3600000e0, 0), 6) AS speed_kmh FROM l GROUP BY tid"
)
def trajectory_statistics(spark, d):
    s = trajectory.statistics(pts(spark, d))
    return s.select("tid", "n", "start_time", "end_time", *r9("min_lng", "max_lng", "min_lat", "max_lat"), *r6("length_km", "speed_kmh"))


@query(
    f"WITH {O.PTS}, {_LEGS}, b AS (SELECT *, CASE WHEN px IS NOT NULL THEN {O.bearing('px', 'py', 'lng', 'lat')} END AS bearing FROM l), "
    f"t AS (SELECT *, {O.angle('lag(bearing) OVER w', 'bearing')} AS turn FROM b WINDOW w AS (PARTITION BY tid ORDER BY idx)) "
    "SELECT tid, idx, round(bearing, 6) AS bearing, round(sum(turn / 180) OVER v, 6) AS score, coalesce(sum(turn / 180) OVER v <= 0.2, FALSE) AS stable FROM t WINDOW v AS (PARTITION BY tid ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"
)
def window_bearing(spark, d):
    return trajectory.window_bearing(pts(spark, d)).select("tid", "idx", *r6("bearing", "score"), "stable")


@query(f"WITH {O.PTS}, {_LEGS} SELECT tid, idx, round(leg_m / 3, 6) AS speed, round(avg(leg_m / 3) OVER (PARTITION BY tid ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean_speed FROM l")
def moving_speed(spark, d):
    return trajectory.moving_speed(pts(spark, d)).select("tid", "idx", *r6("speed", "mean_speed"))


# ---------------------------------------------------------------- joins


_CAND = f"WITH {O.NET}, {O.PTS}, {O.CAND}"


@query(f"{_CAND} SELECT tid, idx, segment_id, matched_index, {s6('err_m', 'offset_m')}, {s9('cand_lng', 'cand_lat')} FROM cand")
def candidate_segments(spark, d):
    return C.candidates(pts(spark, d), seg(spark, d)).select("tid", "idx", "segment_id", "matched_index", *r6("err_m", "offset_m"), *r9("cand_lng", "cand_lat"))


@query(f"{_CAND} SELECT tid, idx, segment_id, {s6('err_m', 'offset_m')} FROM ranked WHERE rank = 1")
def nearest_segment(spark, d):
    return C.nearest(pts(spark, d), seg(spark, d)).select("tid", "idx", "segment_id", *r6("err_m", "offset_m"))


@query(f"{_CAND} SELECT tid, idx, segment_id, CAST(rank AS INTEGER) AS rank, {s6('err_m')} FROM ranked WHERE rank <= 2")
def top_two_segments(spark, d):
    return C.top(pts(spark, d), seg(spark, d), 2).select("tid", "idx", "segment_id", "rank", *r6("err_m"))


@query(f"{_CAND} SELECT tid, idx FROM pts p WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE c.tid = p.tid AND c.idx = p.idx)")
def unmatched_points(spark, d):
    return C.unmatched(pts(spark, d), seg(spark, d)).select("tid", "idx")


@query(f"{_CAND}, n AS (SELECT tid, idx, segment_id, lag(segment_id) OVER (PARTITION BY tid ORDER BY idx) AS b FROM ranked WHERE rank = 1) SELECT tid, idx, segment_id FROM n WHERE b IS NULL OR b <> segment_id")
def consecutive_segments(spark, d):
    return trajectory.consecutive(C.nearest(pts(spark, d), seg(spark, d)).select("tid", "idx", "segment_id"), "segment_id")


@query(f"{_CAND} SELECT tid, round(sqrt(avg(err_m * err_m)), 6) AS rms FROM ranked WHERE rank = 1 GROUP BY tid")
def position_error(spark, d):
    return trajectory.root_mean_square(C.nearest(pts(spark, d), seg(spark, d)), "err_m").select("tid", *r6("rms"))


@query(f"{_CAND} SELECT tid, idx, round(avg(err_m) OVER w, 6) AS run_mean, round(stddev_samp(err_m) OVER w, 6) AS run_sd FROM ranked WHERE rank = 1 WINDOW w AS (PARTITION BY tid ORDER BY idx)")
def running_error(spark, d):
    return trajectory.running_spread(C.nearest(pts(spark, d), seg(spark, d)), "err_m").select("tid", "idx", *r6("run_mean", "run_sd"))


@query(f"{_CAND} SELECT tid, idx, segment_id, cand_lng = x1 AND cand_lat = y1 AS is_start, cand_lng = x3 AND cand_lat = y3 AS is_end FROM ranked WHERE rank = 1")
def end_point_matches(spark, d):
    n = C.nearest(pts(spark, d), seg(spark, d)).select("tid", "idx", "segment_id", F.col("cand_lng").alias("lng"), F.col("cand_lat").alias("lat"))
    return trajectory.end_point(n, seg(spark, d)).select("tid", "idx", "segment_id", "is_start", "is_end")


# ---------------------------------------------------------------- graph and probabilities


@query(f"WITH {O.NET}, {O.SP} SELECT p.node_id AS src, q.node_id AS dst, round(s.d, 6) AS length_m FROM nodes p CROSS JOIN nodes q LEFT JOIN sp s ON s.src = p.node_id AND s.dst = q.node_id")
def shortest_paths(spark, d):
    """From every node to every node."""
    n = fixtures.road_nodes(spark, d).select(F.col("node_id").alias("src"))
    return shortest_path.paths_from(n, seg(spark, d)).select("src", "dst", *r6("length_m"))


@query(f"WITH {O.NET}, {O.SP} SELECT src, dst, round(d, 6) AS length_m FROM sp")
def shortest_paths_iterative(spark, d):
    """From every node, without a bound."""
    from waymark.session import checkpointed

    checkpointed(spark)
    n = fixtures.road_nodes(spark, d).select(F.col("node_id").alias("src"))
    return shortest_path.iterative(n, network.edges(seg(spark, d)), math.inf).select("src", "dst", *r6("length_m"))


@query(f"{_CAND} SELECT tid, idx, segment_id, round(ln(1 / (sqrt(2 * pi()) * 50e0)) - 0.5e0 * pow(err_m / 50e0, 2), 6) AS log_p FROM cand")
def emissions(spark, d):
    return C.candidates(pts(spark, d), seg(spark, d)).select("tid", "idx", "segment_id", F.round(hmm.emission("err_m"), 6).alias("log_p"))


def _lattice(spark, d):
    s = seg(spark, d)
    c = C.candidates(pts(spark, d), s)
    return hmm.lattice(c, s, shortest_path.shortest_paths(shortest_path.node_pairs(c, s), s))


@query(f"{_CAND}, {O.SP}, {O.TRANS} SELECT tid, idx, prev_segment_id, segment_id, {s6('route_m', 'linear_m')}, CASE WHEN abs(linear_m - route_m) <= 500 THEN round(ln(1 / 5e0) - abs(linear_m - route_m) / 5e0, 6) END AS log_p FROM trans")
def transitions(spark, d):
    return _lattice(spark, d).select("tid", "idx", "prev_segment_id", "segment_id", *r6("route_m", "linear_m"), F.when(F.col("log_p") > F.lit(float("-inf")), F.round("log_p", 6)).alias("log_p"))


@query(f"{_CAND} SELECT tid, idx, segment_id, round(ln((1 / greatest(err_m, 1e-9)) / avg(1 / greatest(err_m, 1e-9)) OVER (PARTITION BY tid, idx)), 6) + 0e0 AS log_p FROM cand")
def relative_emissions(spark, d):
    return hmm.relative_emission(C.candidates(pts(spark, d), seg(spark, d))).select("tid", "idx", "segment_id", (F.round("log_p", 6) + F.lit(0.0)).alias("log_p"))


@query(f"{_CAND}, {O.SP}, {O.TRANS}, m AS (SELECT *, 1 / greatest(abs(linear_m - route_m), 1e-9) AS v FROM trans WHERE route_m IS NOT NULL) SELECT tid, idx, prev_segment_id, segment_id, round(ln(v / avg(v) OVER (PARTITION BY tid, idx, prev_segment_id)), 4) + 0e0 AS log_p FROM m")
def relative_transitions(spark, d):
    return hmm.relative_transition(_lattice(spark, d)).select("tid", "idx", "prev_segment_id", "segment_id", (F.round("log_p", 4) + F.lit(0.0)).alias("log_p"))


# ---------------------------------------------------------------- decoders and what follows them

_SHOWN = ("tid", "idx", "segment_id", "revision", "skipped")


def _decoded(carried: bool, dynamic: bool = True) -> str:
    return f"WITH RECURSIVE {O.NET}, {O.PTS}, {O.CAND}, {O.SP}, {O.viterbi(carried, dynamic)}"


_PATH = "SELECT tid, idx, segment_id, CAST(0 AS INTEGER) AS revision, FALSE AS skipped FROM path"


def _matched(spark, d, method, **how):
    return matchers.match(pts(spark, d), seg(spark, d), method, **how)


@query(f"{_decoded(True)}, {O.back()} {_PATH}")
def match_batch(spark, d):
    return _matched(spark, d, "batch").select(*_SHOWN)


@query(f"{_decoded(True, False)}, {O.back()} {_PATH}")
def match_batch_fixed_split(spark, d):
    return _matched(spark, d, "batch", weights="fixed", split=True).select(*_SHOWN)


@query(f"{_decoded(False)} SELECT tid, idx, segment_id, CAST(0 AS INTEGER) AS revision, FALSE AS skipped FROM rec WHERE top")
def match_greedy(spark, d):
    return _matched(spark, d, "greedy").select(*_SHOWN)


@query(f"{_decoded(False)}, {O.online(20)} SELECT tid, idx, segment_id, CAST(revision AS INTEGER) AS revision, FALSE AS skipped, converged FROM shown")
def match_online(spark, d):
    return _matched(spark, d, "online", window=20).select(*_SHOWN, "converged")


@query(
    f"{_decoded(False)}, {O.online(20)}, each AS (SELECT tid, now, count(*) AS n, sum(idx - (now - 20)) AS late FROM shown WHERE moved GROUP BY tid, now HAVING sum(idx - (now - 20)) > 0) "
    "SELECT s.tid, count(*) AS n, CAST(coalesce(any_value(e.n), 0) AS BIGINT) AS corrected, CAST(coalesce(any_value(e.late), 0) AS BIGINT) AS delay FROM shown s LEFT JOIN (SELECT tid, sum(n) AS n, sum(late) AS late FROM each GROUP BY tid) e ON e.tid = s.tid GROUP BY s.tid"
)
def online_delays(spark, d):
    return matchers.online_delays(pts(spark, d), seg(spark, d), window=20)


@query(
    f"{_decoded(True)}, {O.back()}, {O.viterbi(False, rec='greedy')}, {', '.join(f'{n} AS (SELECT tid, CAST(row_number() OVER (PARTITION BY tid ORDER BY idx) - 1 AS INTEGER) AS idx, segment_id, x, y FROM {t} WHERE segment_id IS NOT NULL{w})' for n, t, w in (('lab', 'path', ''), ('res0', 'greedy', ' AND top')))}, "
    f"res AS (SELECT *, idx AS lidx FROM res0), j AS ({O.judged('lab', 'res')}), t AS (SELECT tid, count(*) AS n, sum(CASE WHEN good THEN 0 ELSE 1 END) AS errors FROM j GROUP BY tid) "
    'SELECT CAST(row_number() OVER w - 1 AS INTEGER) AS "TrajectoryIndex", n AS "currPointNum", CAST(sum(n) OVER w AS BIGINT) AS "totalPointNum", 1 - errors / n AS "currAcc", 1 - sum(errors) OVER w / sum(n) OVER w AS "totalAcc" FROM t WINDOW w AS (ORDER BY tid)'
)
def accuracy_of_documents(spark, d):
    """Matched GeoJSON of the greedy matcher against that of the batch matcher."""
    files = [geojson.write_matched(_matched(spark, d, m), raw=True) for m in ("batch", "greedy")]
    return results.point_table(evaluate.from_geojson(*files, seg(spark, d)))


@query()
def match_adaptive(spark, d):
    return _matched(spark, d, "amm").select(*_SHOWN)


@query()
def match_adaptive_length(spark, d):
    return matchers.matched_length(pts(spark, d), seg(spark, d))


@query()
def match_adaptive_online(spark, d):
    return _matched(spark, d, "aomm").select(*_SHOWN)


@query()
def match_dynamically_weighted(spark, d):
    return _matched(spark, d, "dwrmm").select(*_SHOWN)


@query()
def path_recovery(spark, d):
    return recover.recover(_matched(spark, d, "batch"), seg(spark, d))


@query(
    f"{_decoded(True)}, {O.back()}, {O.viterbi(False, rec='thin', every=2)}, {O.online(20, 'thin')}, res AS (SELECT *, CASE WHEN segment_id IS NULL THEN idx ELSE idx * 2 END AS lidx FROM shown), j AS ({O.judged('path', 'res')}), "
    "t AS (SELECT tid, count(*) AS n, CAST(sum(CASE WHEN good THEN 0 ELSE 1 END) AS BIGINT) AS errors FROM j GROUP BY tid) "
    "SELECT tid, n, errors, round(1 - errors / n, 6) AS acc, round(1 - sum(errors) OVER w / sum(n) OVER w, 6) AS cum_acc FROM t WINDOW w AS (ORDER BY tid)"
)
def accuracy_online(spark, d):
    """The online matches of every second point against the batch labels of all."""
    labels, thin = _matched(spark, d, "batch"), trajectory.stride(pts(spark, d), 1).withColumn("idx", (F.col("idx") / 2).cast("int"))
    results = matchers.match(thin, seg(spark, d), "online", window=20)
    return evaluate.cumulative(evaluate.accuracy(labels, results, seg(spark, d), 3, 6)).select("tid", "n", "errors", *r6("acc", "cum_acc"))


@query(
    f"{_CAND}, lab AS (SELECT * FROM ranked WHERE rank = 1), res AS (SELECT * FROM (SELECT *, max(rank) OVER (PARTITION BY tid, idx) AS last FROM ranked WHERE rank <= 3) WHERE rank = last), "
    "j AS (SELECT r.tid, r.idx, abs(r.segment_id) = abs(l.segment_id) OR r.cand_lng = l.cand_lng AND r.cand_lat = l.cand_lat OR l.start_id = r.end_id AND l.length_m = r.length_m "
    "OR r.idx > 0 AND (r.cand_lng = r.x1 AND r.cand_lat = r.y1 OR r.cand_lng = r.x3 AND r.cand_lat = r.y3 OR l.cand_lng = l.x1 AND l.cand_lat = l.y1 OR l.cand_lng = l.x3 AND l.cand_lat = l.y3) AND (l.end_id = r.start_id OR r.end_id = l.start_id) AS good FROM res r JOIN lab l ON r.tid = l.tid AND r.idx = l.idx) "
    "SELECT tid, count(*) AS n, CAST(sum(CASE WHEN good THEN 0 ELSE 1 END) AS BIGINT) AS errors, round(1 - sum(CASE WHEN good THEN 0 ELSE 1 END) / count(*), 6) AS acc FROM j GROUP BY tid"
)
def accuracy_of_third_choice(spark, d):
    """The evaluator on rows that SQL can make: the nearest segment as label, the third nearest (or last) as result."""
    return _third_choice(spark, d).select("tid", "n", "errors", *r6("acc"))


def _third_choice(spark, d):
    named = lambda c: c.select("tid", "idx", F.col("idx").alias("cand_index"), "segment_id", F.col("cand_lng").alias("lng"), F.col("cand_lat").alias("lat"))
    t = C.top(pts(spark, d), seg(spark, d), 3)
    last = t.groupBy("tid", "idx").agg(F.max_by(F.struct(*t.columns), "rank").alias("b")).select("b.*")
    return evaluate.accuracy(named(t.where("rank = 1")), named(last), seg(spark, d))


@query(f"{_decoded(True)}, {O.back()} SELECT m.tid, m.tid AS oid, m.segment_id, p.time, round(m.err, 6) AS err_m, round(m.off, 6) AS offset_m, round(m.lng, 9) AS raw_lng, round(m.lat, 9) AS raw_lat FROM path m JOIN pts p ON p.tid = m.tid AND p.idx = m.idx WHERE m.segment_id IS NOT NULL")
def matched_geojson(spark, d):
    m = _matched(spark, d, "batch")
    return geojson.read_matched(geojson.write_matched(m, raw=True)).select("tid", "oid", "segment_id", "time", *r6("err_m", "offset_m"), *r9("raw_lng", "raw_lat"))


@query()
def path_geojson(spark, d):
    return geojson.write_paths(recover.recover(_matched(spark, d, "batch"), seg(spark, d)))


@query()
def point_routes(spark, d):
    """From each trajectory's first point to its last."""
    s = trajectory.statistics(pts(spark, d))
    return shortest_path.point_routes(s.select(F.col("tid").alias("id"), F.col("start_lng").alias("lng1"), F.col("start_lat").alias("lat1"), F.col("end_lng").alias("lng2"), F.col("end_lat").alias("lat2")), seg(spark, d))


# ---------------------------------------------------------------- smaller operators


@query(f"WITH {O.PTS} SELECT tid, idx, time FROM pts WHERE idx < 10")
def truncated_points(spark, d):
    return trajectory.truncate(pts(spark, d), 10).select("tid", "idx", "time")


def _lines(spark, d):
    row = F.concat(F.lit('["'), F.date_format("time", "yyyy-MM-dd HH:mm:ss"), F.lit('",'), F.col("lng").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]"))
    lines = pts(spark, d).groupBy("oid").agg(F.sort_array(F.collect_list(F.struct("idx", row.alias("r")))).alias("s"))
    return lines.select(F.concat(F.lit("["), F.col("oid"), F.lit(",["), F.array_join(F.transform("s", lambda x: x["r"]), ","), F.lit("]]")).alias("value"))


@query(f"WITH {O.PTS} SELECT tid || '2024-01-01 00:00:00' AS tid, tid AS oid, idx, time, {s9('lng', 'lat')} FROM pts WHERE idx < 7")
def truncated_text(spark, d):
    """The first seven points of each line, as they stand."""
    t = _lines(spark, d).select(text.parse_line("value", most=7, convert=False).alias("t")).select("t.tid", "t.oid", F.explode("t.points").alias("p"))
    return t.select("tid", "oid", "p.idx", "p.time", *[F.round(f"p.{c}", 9).alias(c) for c in ("lng", "lat")])


@query(f"{_decoded(True)}, {O.back()} SELECT tid, tid AS oid, CAST(row_number() OVER (PARTITION BY tid ORDER BY idx) - 1 AS INTEGER) AS idx, {s9('lng', 'lat')} FROM path WHERE segment_id IS NOT NULL")
def raw_points_of_matches(spark, d):
    return geojson.read_raw_points(geojson.write_matched(_matched(spark, d, "batch"), raw=True)).select("tid", "oid", "idx", *r9("lng", "lat"))


@query(f"{_CAND} SELECT DISTINCT tid, idx, node_id, role FROM (SELECT tid, idx, end_id AS node_id, 'source' AS role FROM cand UNION ALL SELECT tid, idx, start_id, 'target' FROM cand)")
def candidate_nodes(spark, d):
    s = seg(spark, d)
    return shortest_path.candidate_nodes(C.candidates(pts(spark, d), s), s)


_OLD = "2 * atan2(sqrt({0}), sqrt(1 - {0})) * 6371000e0"
_HALF = "(pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2))"


@query(f"WITH {O.PTS}, {_LEGS} SELECT tid, idx, round({_OLD.format(_HALF.format('py', 'lat', 'px', 'lng'))}, 6) AS plain_m, round({_OLD.format(_HALF.format('radians(py)', 'radians(lat)', 'radians(px)', 'radians(lng)'))}, 6) AS twice_m, round({_OLD.format(_HALF.format('py', 'lat', 'px', 'lng'))} / 3000, 9) AS velocity FROM l WHERE px IS NOT NULL")
def legacy_speeds(spark, d):
    w = trajectory.by_point()
    p = pts(spark, d).withColumns({"px": F.lag("lng").over(w), "py": F.lag("lat").over(w)}).where("px is not null")
    plain, twice = (geo.legacy_distance("px", "py", "lng", "lat", compat) for compat in (False, True))
    return p.select("tid", "idx", F.round(plain, 6).alias("plain_m"), F.round(twice, 6).alias("twice_m"), F.round(geo.legacy_velocity(plain, F.lit(3000)), 9).alias("velocity"))


@query(f"WITH {O.NET} SELECT segment_id, CAST(10 AS INTEGER) AS numbers, TRUE AS closed, {', '.join(f'round({f}({c}1, {c}2, {c}3), 9) AS {n}' for f, c, n in (('least', 'x', 'west'), ('least', 'y', 'south'), ('greatest', 'x', 'east'), ('greatest', 'y', 'north')))} FROM seg")
def envelopes(spark, d):
    ring = F.transform(F.regexp_extract_all(geo.bbox_wkt(geo.points_bbox("points")), F.lit(r"-?[0-9.]+(?:E-?[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
    r = seg(spark, d).select("segment_id", ring.alias("r"))
    return r.select("segment_id", F.size("r").alias("numbers"), ((F.col("r")[0] == F.col("r")[8]) & (F.col("r")[1] == F.col("r")[9])).alias("closed"), *[F.round(F.col("r")[k], 9).alias(n) for k, n in ((0, "west"), (1, "south"), (4, "east"), (5, "north"))])


@query(f"WITH {O.PTS}, {_LEGS} SELECT tid, idx, coalesce(abs(lng - px) < 0.0003e0 AND abs(lat - py) < 0.0003e0, FALSE) AS still, lng - idx < {O.BOX[0]}e0 OR lng - idx > {O.BOX[1]}e0 OR lat + idx < {O.BOX[2]}e0 OR lat + idx > {O.BOX[3]}e0 AS abroad FROM l")
def position_predicates(spark, d):
    w = trajectory.by_point()
    p = pts(spark, d).withColumns({"px": F.lag("lng").over(w), "py": F.lag("lat").over(w)})
    return p.select("tid", "idx", F.coalesce(geo.same_position("px", "py", "lng", "lat", 0.0003), F.lit(False)).alias("still"), coords.outside(F.col("lng") - F.col("idx"), F.col("lat") + F.col("idx")).alias("abroad"))


@query("SELECT * FROM (VALUES ('POINT', 'Point', TRUE, TRUE, FALSE), ('linestring', 'LineString', TRUE, FALSE, FALSE), ('int', 'Integer', FALSE, FALSE, FALSE), ('bool', 'Boolean', FALSE, FALSE, FALSE), ('TimeStamp', 'Timestamp', FALSE, FALSE, TRUE), ('datetime', 'Datetime', FALSE, FALSE, TRUE), ('roadsegment', 'RoadSegment', FALSE, FALSE, FALSE)) t(given, name, is_geometry, is_point, is_date)")
def type_predicates(spark, d):
    given = ["POINT", "linestring", "int", "bool", "TimeStamp", "datetime", "roadsegment"]
    return spark.createDataFrame([(g, types.normalize(g), types.is_geometry(g), types.is_point(g), types.is_date(g)) for g in given], "given string, name string, is_geometry boolean, is_point boolean, is_date boolean")


@query(
    f"WITH {O.PTS}, {_LEGS}, v AS (SELECT *, leg_m / 3 AS v, lag(leg_m / 3) OVER (PARTITION BY tid ORDER BY idx) AS b, (idx % 7) * 0.5e0 AS hdop, CAST(idx % 181 AS DOUBLE) AS a FROM l) "
    "SELECT tid, idx, round(CASE WHEN hdop <= 1 THEN 1e0 WHEN hdop < 2.6e0 THEN (hdop - 1) / 1.6e0 ELSE 0e0 END, 9) AS distance_weight, round((1 + cos(radians(a))) / 2, 9) AS first_score, round((1 + cos(radians(180 - a))) / 2, 9) AS next_score, "
    "round(CASE WHEN v < 8 OR b < 8 THEN 0e0 WHEN v > 14 AND b > 14 THEN 1e0 ELSE (v + b - 16) / 12e0 END, 9) AS heading_weight FROM v WHERE b IS NOT NULL"
)
def quality_weights(spark, d):
    """What the dynamically weighted matcher defines beside what it uses."""
    w = trajectory.by_point()
    p = trajectory.moving_speed(pts(spark, d)).withColumns({"b": F.lag("speed").over(w), "hdop": (F.col("idx") % 7) * 0.5, "a": (F.col("idx") % 181).cast("double")}).where("b is not null")
    made = {"distance_weight": weights.distance_weight("hdop", 1.0, 2.6), "first_score": weights.heading_score("a", F.lit(0.0), 1), "next_score": weights.heading_score(F.lit(0.0), 180 - F.col("a"), 2), "heading_weight": weights.heading_weight("speed", "b", 8.0, 14.0)}
    return p.select("tid", "idx", *[F.round(v, 9).alias(k) for k, v in made.items()])


@query(f"WITH {O.NET}, g AS (SELECT segment_id, {', '.join(f'{O.hav(*x)} AS d{k}, {O.bearing(*x)} AS b{k}, cos(radians({x[1]})) * sin(radians({x[3]})) - sin(radians({x[1]})) * cos(radians({x[3]})) * cos(radians({x[2]} - {x[0]})) AS n{k}, sin(radians({x[2]} - {x[0]})) * cos(radians({x[3]})) AS e{k}' for k, x in ((1, ('x1', 'y1', 'x2', 'y2')), (2, ('x2', 'y2', 'x3', 'y3'))))} FROM seg) SELECT segment_id, round(fmod(degrees(atan2((e1 * d1 + e2 * d2) / (d1 + d2), (n1 * d1 + n2 * d2) / (d1 + d2))) + 360e0, 360e0), 6) AS mean_bearing FROM g")
def mean_bearings(spark, d):
    return seg(spark, d).select("segment_id", F.round(geo.weighted_direction("points", F.lit(0.0)), 6).alias("mean_bearing"))


_THIRD = SQL["accuracy_of_third_choice"]


@query(f'SELECT CAST(row_number() OVER w - 1 AS INTEGER) AS "index", acc AS "currAcc", round(avg(1 - errors / n) OVER w, 6) AS "avgAcc", 0e0 AS "labelTime", 0e0 AS "streamTime" FROM ({_THIRD}) WINDOW w AS (ORDER BY tid)')
def accuracy_table(spark, d):
    """The experiment's table over the nearest and the third nearest segments."""
    t = results.accuracy_table(_third_choice(spark, d))
    return t.select("index", *r6("currAcc", "avgAcc"), "labelTime", "streamTime")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(errors) AS BIGINT) AS errors, round(1 - sum(errors) / sum(n), 6) AS acc, round(avg(1 - errors / n), 6) AS mean_acc FROM ({_THIRD})")
def average_accuracy(spark, d):
    return evaluate.total(_third_choice(spark, d)).select("n", "errors", *r6("acc", "mean_acc"))


_ENDS = lambda t, s, e: f"CASE {t}.direction WHEN 1 THEN [{t}.start_id, {t}.end_id] WHEN 2 THEN [{t}.{s}] WHEN 3 THEN [{t}.{e}] ELSE [] END"
_ON = lambda t, p: f"({p}.x = {t}.x1 AND {p}.y = {t}.y1 OR {p}.x = {t}.x3 AND {p}.y = {t}.y3)"


@query(
    f"{_decoded(True)}, {O.back()}, {O.viterbi(False, rec='greedy')}, {', '.join(f'{n} AS (SELECT tid, row_number() OVER (PARTITION BY tid ORDER BY idx) - 1 AS pos, segment_id, x, y FROM {t} WHERE segment_id IS NOT NULL{w})' for n, t, w in (('lab', 'path', ''), ('res', 'greedy', ' AND top')))}, "
    f"j AS (SELECT r.tid, r.pos, r.segment_id = l.segment_id AS agree, {_ON('rs', 'r')} AS r_on, {_ON('ls', 'l')} AS l_on, [rs.start_id, rs.end_id] AS r_both, [ls.start_id, ls.end_id] AS l_both, {_ENDS('ls', 'start_id', 'end_id')} AS l_some, {_ENDS('rs', 'end_id', 'start_id')} AS r_some "
    "FROM res r JOIN lab l ON l.tid = r.tid AND l.pos = r.pos JOIN seg rs ON rs.segment_id = r.segment_id JOIN seg ls ON ls.segment_id = l.segment_id), "
    "k AS (SELECT *, first_value(CASE WHEN agree THEN l_some END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM j), "
    "w AS (SELECT tid, CASE WHEN agree THEN 0 WHEN pos > 0 AND r_on THEN CASE WHEN later IS NULL OR len(list_intersect(r_both, later)) > 0 THEN 0 ELSE 1 END WHEN pos > 0 AND l_on THEN CASE WHEN len(list_intersect(r_some, l_both)) > 0 THEN 0 ELSE 1 END ELSE 1 END AS wrong FROM k) "
    "SELECT tid, count(*) AS n, CAST(sum(wrong) AS BIGINT) AS errors, round(1 - sum(wrong) / count(*), 6) AS acc FROM w GROUP BY tid"
)
def strict_accuracy(spark, d):
    """The file comparison's rule: greedy results against batch labels."""
    return evaluate.strict(_matched(spark, d, "batch"), _matched(spark, d, "greedy"), seg(spark, d)).select("tid", "n", "errors", *r6("acc"))


@query(
    f"{_decoded(True)}, {O.back()}, m AS (SELECT m.*, row_number() OVER w AS k, lag(segment_id) OVER w AS before, lag(end_id) OVER w AS left_at, lag(off) OVER w AS off0 FROM path m WHERE segment_id IS NOT NULL WINDOW w AS (PARTITION BY tid ORDER BY idx)), "
    "c AS (SELECT m.*, CAST(sum(CASE WHEN before IS NOT NULL AND before <> m.segment_id AND d.d IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY idx) AS INTEGER) AS part FROM m LEFT JOIN sp d ON d.src = m.left_at AND d.dst = m.start_id), "
    "e AS (SELECT tid, part, arg_min(segment_id, idx) AS first_id, arg_max(segment_id, idx) AS last_id, arg_min(x, idx) AS from_lng, arg_min(y, idx) AS from_lat, arg_max(x, idx) AS x, arg_max(y, idx) AS y, arg_max(x3, idx) AS x3, arg_max(y3, idx) AS y3, max(part) OVER (PARTITION BY tid) AS last FROM c GROUP BY tid, part) "
    "SELECT tid, tid AS oid, part, first_id, last_id, round(from_lng, 9) AS from_lng, round(from_lat, 9) AS from_lat, round(CASE WHEN part < last THEN x3 ELSE x END, 9) AS to_lng, round(CASE WHEN part < last THEN y3 ELSE y END, 9) AS to_lat FROM e"
)
def path_ends(spark, d):
    """Where the parts of recovered paths begin and end; which of several equally short ways lies between is not shown."""
    r = recover.recover(_matched(spark, d, "batch"), seg(spark, d))
    at = lambda c, k: F.element_at(c, k)
    return r.select("tid", "oid", "part", at("segment_ids", 1).alias("first_id"), at("segment_ids", -1).alias("last_id"), *[F.round(at("points", k)[c], 9).alias(f"{n}_{c}") for k, n in ((1, "from"), (-1, "to")) for c in ("lng", "lat")])


_PLACES = ", ".join(f"{{0}}.{c} AS {{1}}_{c}" for c in ("segment_id", "start_id", "end_id", "direction", "x1", "y1", "x2", "y2", "x3", "y3", "leg", "x", "y", "off"))


@query(
    f"{_CAND}, {O.SP}, best AS (SELECT tid, idx, lng, lat, segment_id, err_m, rank FROM ranked WHERE rank = 1), c AS (SELECT *, matched_index AS leg, cand_lng AS x, cand_lat AS y, offset_m AS off FROM cand), "
    "span AS (SELECT tid, min(idx) AS i, max(idx) AS k FROM pts GROUP BY tid), q AS (SELECT s.tid, a.lng AS alng, a.lat AS alat, b.lng AS blng, b.lat AS blat, s.i, s.k FROM span s JOIN pts a ON a.tid = s.tid AND a.idx = s.i JOIN pts b ON b.tid = s.tid AND b.idx = s.k), "
    f"w AS (SELECT q.tid, ba.err_m AS e1, bb.err_m AS e2, a.segment_id = ba.segment_id AND b.segment_id = bb.segment_id AS own, {_PLACES.format('a', 'a')}, {_PLACES.format('b', 'b')}, d.d AS between FROM q JOIN best ba ON ba.tid = q.tid AND ba.idx = q.i JOIN best bb ON bb.tid = q.tid AND bb.idx = q.k "
    "JOIN c a ON a.tid = q.tid AND a.idx = q.i AND abs(a.segment_id) = abs(ba.segment_id) JOIN c b ON b.tid = q.tid AND b.idx = q.k AND abs(b.segment_id) = abs(bb.segment_id) LEFT JOIN sp d ON d.src = a.end_id AND d.dst = b.start_id), "
    f"l AS (SELECT tid, min(e1 + e2 + {O.route()}) AS length_m FROM w GROUP BY tid) SELECT q.tid AS id, round(CASE WHEN alng = blng AND alat = blat THEN 0 ELSE l.length_m END, 6) AS length_m FROM q LEFT JOIN l ON l.tid = q.tid"
)
def point_route_lengths(spark, d):
    """From each trajectory's first point to its last, snapped within 50 metres; which of equally short ways is not shown."""
    s = trajectory.statistics(pts(spark, d))
    ends = s.select(F.col("tid").alias("id"), F.col("start_lng").alias("lng1"), F.col("start_lat").alias("lat1"), F.col("end_lng").alias("lng2"), F.col("end_lat").alias("lat2"))
    return shortest_path.point_routes(ends, seg(spark, d), 50.0).select("id", *r6("length_m"))
