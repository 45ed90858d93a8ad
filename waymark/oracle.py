"""DuckDB SQL of the same fixtures and operators, for the registered queries' oracles."""

from __future__ import annotations

import math

R = 6378137.0
#: As SQL text, a double.
PER_METRE = f"(360e0 / (2e0 * pi() * {R}e0))"


def hav(x1: str, y1: str, x2: str, y2: str) -> str:
    return f"(2 * asin(sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))) * {R}e0)"


def bearing(x1: str, y1: str, x2: str, y2: str) -> str:
    dx = f"radians({x2}) - radians({x1})"
    y, x = f"sin({dx}) * cos(radians({y2}))", f"cos(radians({y1})) * sin(radians({y2})) - sin(radians({y1})) * cos(radians({y2})) * cos({dx})"
    return f"fmod(degrees(atan2({y}, {x})) + 360e0, 360e0)"


def angle(a: str, b: str) -> str:
    return f"(CASE WHEN abs({a} - {b}) > 180 THEN 360 - abs({a} - {b}) ELSE abs({a} - {b}) END)"


def rate(x: str, y: str, x1: str, y1: str, x2: str, y2: str) -> str:
    return f"({hav(x1, y1, x, y)} * cos(radians({bearing(x1, y1, x, y)} - {bearing(x1, y1, x2, y2)})) / {hav(x1, y1, x2, y2)})"


NODES = "nodes AS (SELECT CAST(p_partkey AS INTEGER) AS node_id, CAST(p_partkey // 12 AS INTEGER) AS r, CAST(p_partkey % 12 AS INTEGER) AS c, 104.00e0 + 0.002e0 * (p_partkey % 12) AS lng, 30.60e0 + 0.0018e0 * (p_partkey // 12) AS lat FROM part WHERE p_partkey < 144)"
RAW = """raw AS (SELECT CAST(1 + 2 * a.node_id + u.up AS INTEGER) AS segment_id, a.node_id AS start_id, b.node_id AS end_id,
  CASE WHEN a.node_id % 5 = 0 THEN 2 WHEN a.node_id % 7 = 0 THEN 3 ELSE 1 END AS direction, a.lng AS x1, a.lat AS y1,
  (a.lng + b.lng) / 2 + (a.node_id % 3 - 1) * 0.00005e0 AS x2, (a.lat + b.lat) / 2 + (a.node_id % 3 - 1) * 0.00005e0 AS y2, b.lng AS x3, b.lat AS y3
  FROM nodes a, (VALUES (0), (1)) u(up), nodes b WHERE u.up = 0 AND b.r = a.r AND b.c = a.c + 1 OR u.up = 1 AND b.c = a.c AND b.r = a.r + 1)"""
LENGTH = f"lens AS (SELECT *, {hav('x1', 'y1', 'x2', 'y2')} + {hav('x2', 'y2', 'x3', 'y3')} AS length_m FROM raw)"
FLAT = """flat AS (SELECT segment_id, end_id AS start_id, start_id AS end_id, 2 AS direction, x3 AS x1, y3 AS y1, x2, y2, x1 AS x3, y1 AS y3, length_m FROM lens WHERE direction = 3
  UNION ALL SELECT segment_id, start_id, end_id, direction, x1, y1, x2, y2, x3, y3, length_m FROM lens WHERE direction <> 3)"""
SEG = """seg AS (SELECT * FROM flat UNION ALL SELECT -segment_id, end_id, start_id, direction, x3, y3, x2, y2, x1, y1, length_m FROM flat WHERE direction = 1)"""
PTS = """pts0 AS (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS idx FROM events),
pts1 AS (SELECT *, floor(0.15e0 * idx) AS e, 0.15e0 * idx - floor(0.15e0 * idx) AS f FROM pts0),
pts2 AS (SELECT *, ceil(e / 2) + user_id % 12 AS x0, floor(e / 2) + (7 * user_id) % 12 AS y0, CASE WHEN CAST(e AS BIGINT) % 2 = 0 THEN 1 ELSE 0 END AS even FROM pts1),
pts AS (SELECT CAST(user_id AS VARCHAR) AS tid, idx, event_id, make_timestamp(1704067200000000 + CAST(idx AS BIGINT) * 3000000) AS time,
  104.00e0 + 0.002e0 * ((11 - abs(fmod(x0, 22) - 11)) + f * ((11 - abs(fmod(x0 + even, 22) - 11)) - (11 - abs(fmod(x0, 22) - 11)))) + ((37 * event_id) % 41 - 20) * 0.00001e0 + CASE WHEN event_id % 97 = 0 THEN 0.5e0 ELSE 0e0 END AS lng,
  30.60e0 + 0.0018e0 * ((11 - abs(fmod(y0, 22) - 11)) + f * ((11 - abs(fmod(y0 + 1 - even, 22) - 11)) - (11 - abs(fmod(y0, 22) - 11)))) + ((53 * event_id) % 41 - 20) * 0.00001e0 AS lat FROM pts2)"""
NET = f"{NODES}, {RAW}, {LENGTH}, {FLAT}, {SEG}"


def _leg(k: int) -> str:
    a, b = (f"x{k}", f"y{k}"), (f"x{k + 1}", f"y{k + 1}")
    hold = lambda lo, hi: f"CASE WHEN t{k} > 1 THEN {hi} WHEN t{k} < 0 THEN {lo} ELSE {lo} + t{k} * ({hi} - {lo}) END"
    return f"{hold(a[0], b[0])} AS px{k}, {hold(a[1], b[1])} AS py{k}"


_D = 50.0 * 360.0 / (2 * math.pi * R)
CAND = f"""near AS (SELECT p.tid, p.idx, p.time, p.lng, p.lat, s.*, {rate('p.lng', 'p.lat', 'x1', 'y1', 'x2', 'y2')} AS t1, {rate('p.lng', 'p.lat', 'x2', 'y2', 'x3', 'y3')} AS t2
  FROM pts p JOIN seg s ON p.lng BETWEEN least(x1, x2, x3) - {2 * _D:.18f}e0 AND greatest(x1, x2, x3) + {2 * _D:.18f}e0 AND p.lat BETWEEN least(y1, y2, y3) - {_D:.18f}e0 AND greatest(y1, y2, y3) + {_D:.18f}e0),
foot AS (SELECT *, {_leg(1)}, {_leg(2)} FROM near),
dist AS (SELECT *, {hav('lng', 'lat', 'px1', 'py1')} AS e1, {hav('lng', 'lat', 'px2', 'py2')} AS e2 FROM foot),
pick AS (SELECT *, CASE WHEN e1 <= e2 THEN 0 ELSE 1 END AS matched_index, least(e1, e2) AS err_m, CASE WHEN e1 <= e2 THEN px1 ELSE px2 END AS cand_lng, CASE WHEN e1 <= e2 THEN py1 ELSE py2 END AS cand_lat FROM dist WHERE least(e1, e2) <= 50),
cand AS MATERIALIZED (SELECT *, CASE WHEN matched_index = 0 THEN {hav('x1', 'y1', 'cand_lng', 'cand_lat')} ELSE {hav('x1', 'y1', 'x2', 'y2')} + {hav('x2', 'y2', 'cand_lng', 'cand_lat')} END AS offset_m FROM pick),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tid, idx ORDER BY round(err_m, 6), CASE WHEN segment_id < 0 THEN 1 ELSE 0 END, abs(segment_id)) AS rank FROM cand)"""


def _squared(a: str, b: str) -> str:
    return f"{b} AS MATERIALIZED (SELECT x.src, y.dst, min(x.d + y.d) AS d FROM {a} x JOIN {a} y ON x.dst = y.src GROUP BY ALL)"


#: All shortest lengths of the lattice, by squaring least sums: ways of up to 2 ** 7 edges.
SP = ", ".join(["d0 AS MATERIALIZED (SELECT src, dst, min(d) AS d FROM (SELECT start_id AS src, end_id AS dst, length_m AS d FROM seg UNION ALL SELECT node_id, node_id, 0e0 FROM nodes) GROUP BY ALL)", *[_squared(f"d{k}", f"d{k + 1}") for k in range(7)]]) + ", sp AS (SELECT * FROM d7)"
# In a pair, a_ is the candidate before and b_ the one after; q_ is b on a's segment.
_A = [f"a.{c} AS a_{c}" for c in ("segment_id", "end_id", "direction", "matched_index", "cand_lng", "cand_lat", "offset_m", "x1", "y1", "x2", "y2", "x3", "y3", "lng", "lat")]
_B = [f"b.{c} AS b_{c}" for c in ("segment_id", "start_id", "matched_index", "cand_lng", "cand_lat", "offset_m", "lng", "lat")]
_A2B = hav("a_cand_lng", "a_cand_lat", "b_cand_lng", "b_cand_lat")
_A2M, _M2B = hav("a_cand_lng", "a_cand_lat", "a_x2", "a_y2"), hav("a_x2", "a_y2", "b_cand_lng", "b_cand_lat")
TRANS = f"""pairs AS (SELECT b.tid, b.idx, {', '.join(_A + _B)} FROM cand a JOIN cand b ON a.tid = b.tid AND b.idx = a.idx + 1),
twin AS (SELECT *, abs(a_segment_id) = abs(b_segment_id) AS same, CASE WHEN a_segment_id = -b_segment_id THEN 1 - b_matched_index ELSE b_matched_index END AS q_leg FROM pairs),
offs AS (SELECT *, CASE WHEN q_leg = 0 THEN {hav('a_x1', 'a_y1', 'b_cand_lng', 'b_cand_lat')} ELSE {hav('a_x1', 'a_y1', 'a_x2', 'a_y2')} + {_M2B} END AS q_off FROM twin),
ways AS (SELECT o.*, {_A2B} AS straight, {_A2M} + {_M2B} AS bent, d.d AS between,
  CASE WHEN a_matched_index = 0 THEN {_A2M} + {hav('a_x2', 'a_y2', 'a_x3', 'a_y3')} ELSE {hav('a_cand_lng', 'a_cand_lat', 'a_x3', 'a_y3')} END AS tail FROM offs o LEFT JOIN sp d ON d.src = a_end_id AND d.dst = b_start_id),
trans AS (SELECT tid, idx, a_segment_id AS prev_segment_id, b_segment_id AS segment_id, {hav('a_lng', 'a_lat', 'b_lng', 'b_lat')} AS linear_m,
  CASE WHEN same AND (a_offset_m <= CASE WHEN a_segment_id = b_segment_id THEN b_offset_m ELSE q_off END OR a_direction = 1) THEN CASE WHEN a_matched_index = q_leg THEN straight ELSE bent END ELSE tail + between + b_offset_m END AS route_m FROM ways)"""

# ---------------------------------------------------------------- decoders


_PLACE = ("segment_id", "start_id", "end_id", "direction", "x1", "y1", "x2", "y2", "x3", "y3", "leg", "x", "y", "err", "off")
_STEP = "-round({0}, 6), round({1}err, 6), CASE WHEN {1}segment_id < 0 THEN 1 ELSE 0 END, abs({1}segment_id)"
_EMIT = "(ln(1 / (sqrt(2 * pi()) * 50e0)) - 0.5e0 * pow(b_err / 50e0, 2))"


def route(a: str = "a_", b: str = "b_", between: str = "between") -> str:
    """Metres from place a to place b; between: from a's segment's end to the start of b's."""
    q_leg = f"(CASE WHEN {a}segment_id = -{b}segment_id THEN 1 - {b}leg ELSE {b}leg END)"
    ab, am, mb = hav(f"{a}x", f"{a}y", f"{b}x", f"{b}y"), hav(f"{a}x", f"{a}y", f"{a}x2", f"{a}y2"), hav(f"{a}x2", f"{a}y2", f"{b}x", f"{b}y")
    first, last = hav(f"{a}x1", f"{a}y1", f"{a}x2", f"{a}y2"), hav(f"{a}x2", f"{a}y2", f"{a}x3", f"{a}y3")
    q_off = f"(CASE WHEN {a}segment_id = {b}segment_id THEN {b}off WHEN {q_leg} = 0 THEN {hav(f'{a}x1', f'{a}y1', f'{b}x', f'{b}y')} ELSE {first} + {mb} END)"
    tail = f"(CASE WHEN {a}leg = 0 THEN {am} + {last} ELSE {hav(f'{a}x', f'{a}y', f'{a}x3', f'{a}y3')} END)"
    return f"(CASE WHEN abs({a}segment_id) = abs({b}segment_id) AND ({a}off <= {q_off} OR {a}direction = 1) THEN CASE WHEN {a}leg = {q_leg} THEN {ab} ELSE {am} + {mb} END ELSE {tail} + {between} + {b}off END)"


def viterbi(carried: bool, dynamic: bool = True, rec: str = "rec", every: int = 1) -> str:
    """Recursive table rec of the decoder's states: a row for each candidate that is reached at a point (or for a point
    without one), with its score, its predecessor (prev_seg, prev_car), whether it begins a part (starts), the weights, and
    whether it is the best of its point (top). car: the match before, carried on against a jump back. every: of so many points one is taken."""
    r_, b_, p_ = (", ".join(f"{t}.{c} AS {k}_{c}" for c in _PLACE) for t, k in (("r", "b"), ("c", "b"), ("r", "a")))
    same = "a_segment_id = b_segment_id AND a_leg = b_leg AND a_x = b_x AND a_y = b_y AND a_err = b_err" if carried else "FALSE"
    order = lambda score, k: _STEP.format(score, k)
    # The carried match: the best before, if its segment's candidate now lies behind it, close by but far along the roads.
    jump = f"""SELECT q.tid, q.idx, q.lng, q.lat, TRUE AS car, {r_} FROM {rec} r JOIN p_{rec} q ON q.tid = r.tid AND q.idx = r.idx + 1 JOIN c_{rec} c ON c.tid = q.tid AND c.idx = q.idx AND c.segment_id = r.segment_id AND c.off < r.off
      LEFT JOIN sp d ON d.src = r.end_id AND d.dst = c.start_id WHERE r.top AND {hav('r.x', 'r.y', 'c.x', 'c.y')} < 20 AND coalesce({route('r.', 'c.', 'd.d')} / {3 * every}e0 > 34, TRUE)"""
    targets = f"SELECT q.tid, q.idx, q.lng, q.lat, FALSE AS car, {b_} FROM (SELECT DISTINCT tid, idx FROM {rec}) r JOIN p_{rec} q ON q.tid = r.tid AND q.idx = r.idx + 1 LEFT JOIN c_{rec} c ON c.tid = q.tid AND c.idx = q.idx UNION ALL {jump}"
    pairs = f"SELECT b.*, r.wt, r.we, r.score AS a_score, r.car AS a_car, {p_}, d.d AS between, {hav('r.lng', 'r.lat', 'b.lng', 'b.lat')} AS linear FROM ({targets}) b JOIN {rec} r ON r.tid = b.tid LEFT JOIN sp d ON d.src = r.end_id AND d.dst = b.b_start_id"
    ways = f"SELECT *, CASE WHEN {same} THEN 0e0 ELSE abs(linear - {route()}) END AS off_by FROM ({pairs})"
    steps = "SELECT *, CASE WHEN off_by <= 500 THEN ln(1 / 5e0) - off_by / 5e0 END AS t FROM (" + ways + ")"
    best = f"SELECT *, a_score + wt * t AS reached FROM ({steps}) QUALIFY row_number() OVER (PARTITION BY tid, b_segment_id, car ORDER BY CASE WHEN t IS NULL OR a_score IS NULL THEN 1 ELSE 0 END, {order('(a_score + wt * t)', 'a_')}, a_car) = 1"
    summed = f"SELECT *, {_EMIT} AS e, count(reached) OVER (PARTITION BY tid) AS n_reached, sum(CASE WHEN reached IS NOT NULL THEN {_EMIT} END) OVER (PARTITION BY tid) AS es, sum(CASE WHEN reached IS NOT NULL THEN t END) OVER (PARTITION BY tid) AS ts FROM ({best})"
    raised = "wt + 0.01e0 * CASE WHEN abs(ts) > 30 THEN 0 ELSE abs(ts) END AS w1, we + 0.01e0 * abs(es) AS w2" if dynamic else "wt AS w1, we AS w2"
    moved = f"SELECT *, {raised} FROM ({summed}) WHERE n_reached = 0 OR reached IS NOT NULL"
    scored = f"SELECT *, CASE WHEN n_reached > 0 THEN reached + we * e ELSE e END AS score2, CASE WHEN n_reached > 0 THEN w1 / (w1 + w2) ELSE wt END AS wt2, CASE WHEN n_reached > 0 THEN w2 / (w1 + w2) ELSE we END AS we2 FROM ({moved})"
    columns = ", ".join(f"b_{c}" for c in _PLACE)
    return f"""p_{rec} AS MATERIALIZED (SELECT tid, CAST(idx // {every} AS INTEGER) AS idx, lng, lat FROM pts WHERE idx % {every} = 0),
c_{rec} AS MATERIALIZED (SELECT tid, CAST(idx // {every} AS INTEGER) AS idx, segment_id, start_id, end_id, direction, x1, y1, x2, y2, x3, y3, matched_index AS leg, cand_lng AS x, cand_lat AS y, err_m AS err, offset_m AS off FROM cand WHERE idx % {every} = 0),
{rec} AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY {order('score', '')}) = 1 AS top FROM (SELECT q.tid, q.idx, q.lng, q.lat, FALSE AS car, {', '.join(f'c.{x}' for x in _PLACE)}, {_EMIT.replace('b_err', 'c.err')} AS score,
  CAST(NULL AS INTEGER) AS prev_seg, CAST(NULL AS BOOLEAN) AS prev_car, TRUE AS starts, 0.5e0 AS wt, 0.5e0 AS we FROM p_{rec} q LEFT JOIN c_{rec} c ON c.tid = q.tid AND c.idx = q.idx WHERE q.idx = 0)
UNION ALL SELECT tid, idx, lng, lat, car, {columns}, score2, CASE WHEN n_reached > 0 THEN a_segment_id END, CASE WHEN n_reached > 0 THEN a_car END, n_reached = 0, wt2, we2,
  row_number() OVER (PARTITION BY tid ORDER BY {order('score2', 'b_')}, car) = 1 FROM ({scored}))"""


def back(rec: str = "rec", path: str = "path") -> str:
    """From the best of each part's last point back to its first; points without a candidate are parts of their own."""
    return f"""ends_{path} AS (SELECT r.*, coalesce(lead(starts) OVER (PARTITION BY tid ORDER BY idx), TRUE) AS ends FROM {rec} r WHERE top),
{path} AS (SELECT r.*, e.ends FROM {rec} r JOIN ends_{path} e ON e.tid = r.tid AND e.idx = r.idx AND r.top WHERE e.ends
UNION ALL SELECT r.*, FALSE FROM {path} p JOIN {rec} r ON r.tid = p.tid AND r.idx = p.idx - 1 AND r.segment_id = p.prev_seg AND r.car = p.prev_car WHERE NOT p.starts)"""


def online(window: int, rec: str = "rec") -> str:
    """Table `fixed` of the points that convergence corrects, with the step (now) that does, and `shown`, the rows in the end.

    anc: what the states of a step have before them, level by level, until they have one state in common; a root counts if
    it is newer than those of the part's steps before, and the states on its way back to the last root are corrected."""
    return f"""node AS MATERIALIZED (SELECT *, max(CASE WHEN starts THEN idx END) OVER (PARTITION BY tid ORDER BY idx) AS begun FROM {rec} WHERE segment_id IS NOT NULL),
anc AS (SELECT tid, idx AS now, idx AS pos, segment_id, car, prev_seg, prev_car, begun, count(*) OVER (PARTITION BY tid, idx) AS width FROM node WHERE idx > begun
UNION ALL SELECT tid, now, pos, segment_id, car, prev_seg, prev_car, begun, count(*) OVER (PARTITION BY tid, now) FROM
  (SELECT DISTINCT a.tid, a.now, n.idx AS pos, n.segment_id, n.car, n.prev_seg, n.prev_car, a.begun FROM anc a JOIN node n ON n.tid = a.tid AND n.idx = a.pos - 1 AND n.segment_id = a.prev_seg AND n.car = a.prev_car WHERE a.width > 1 AND a.pos - a.begun > 1)),
root AS (SELECT * FROM (SELECT *, max(pos) OVER (PARTITION BY tid, begun ORDER BY now ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM anc WHERE width = 1 AND pos < now) WHERE last IS NULL OR pos > last),
fixed AS (SELECT tid, now, coalesce(last, begun - 1) AS last, pos AS idx, segment_id, car, prev_seg, prev_car FROM root
UNION ALL SELECT f.tid, f.now, f.last, n.idx, n.segment_id, n.car, n.prev_seg, n.prev_car FROM fixed f JOIN node n ON n.tid = f.tid AND n.idx = f.idx - 1 AND n.segment_id = f.prev_seg AND n.car = f.prev_car WHERE f.idx - 1 > f.last),
meant AS (SELECT f.tid, f.now, f.idx, n.segment_id, n.x, n.y FROM fixed f JOIN node n ON n.tid = f.tid AND n.idx = f.idx AND n.segment_id = f.segment_id AND n.car = f.car WHERE f.idx >= f.now - 2 * {window}),
shown AS (SELECT t.tid, t.idx, coalesce(m.segment_id, t.segment_id) AS segment_id, CASE WHEN m.idx IS NULL THEN 0 ELSE 1 END AS revision, m.idx IS NOT NULL AS converged, coalesce(m.x, t.x) AS x, coalesce(m.y, t.y) AS y,
  m.now, m.idx IS NOT NULL AND (abs(m.x - t.x) >= 1e-6 OR abs(m.y - t.y) >= 1e-6) AS moved FROM {rec} t LEFT JOIN meant m ON m.tid = t.tid AND m.idx = t.idx WHERE t.top)"""


def judged(labels: str, results: str) -> str:
    """Tables `wrong` from labels and results (tid, lidx or idx, segment_id, x, y): the evaluator's rule."""
    on = " OR ".join(f"{t}.x = {t}s.x{k} AND {t}.y = {t}s.y{k}" for t in "rl" for k in (1, 3))
    return f"""SELECT r.tid, r.idx, coalesce(abs(coalesce(r.segment_id, 0)) = abs(coalesce(l.segment_id, 0)) OR r.x = l.x AND r.y = l.y OR ls.start_id = rs.end_id AND ls.length_m = rs.length_m
  OR r.idx > 0 AND ({on}) AND (ls.end_id = rs.start_id OR rs.end_id = ls.start_id), FALSE) AS good
  FROM {results} r LEFT JOIN {labels} l ON l.tid = r.tid AND l.idx = r.lidx LEFT JOIN seg rs ON rs.segment_id = r.segment_id LEFT JOIN seg ls ON ls.segment_id = l.segment_id"""


BOX = (72.004, 137.8347, 0.8293, 55.8271)


def gcj_shift(lng: str, lat: str) -> tuple[str, str]:
    x, y, pi = f"({lng} - 105.0e0)", f"({lat} - 35.0e0)", "pi()"
    s = lambda v, *t: "(" + " + ".join(f"{a}e0 * sin({v} * ({pi} * {f}))" for a, f in t) + ") * (2e0 / 3e0)"
    both = s(x, (20.0, "6e0"), (20.0, "2e0"))
    north = f"(-100.0e0 + 2.0e0 * {x} + 3.0e0 * {y} + 0.2e0 * {y} * {y} + 0.1e0 * {x} * {y} + 0.2e0 * sqrt(abs({x})) + {both} + {s(y, (20.0, '1e0'), (40.0, '(1e0 / 3e0)'), (160.0, '(1e0 / 12e0)'), (320.0, '(1e0 / 30e0)'))})"
    east = f"(300.0e0 + {x} + 2.0e0 * {y} + 0.1e0 * {x} * {x} + 0.1e0 * {x} * {y} + 0.1e0 * sqrt(abs({x})) + {both} + {s(x, (20.0, '1e0'), (40.0, '(1e0 / 3e0)'), (150.0, '(1e0 / 12e0)'), (300.0, '(1e0 / 30e0)'))})"
    f = "0.00669342162296594323e0"
    m = f"(1 - {f} * pow(sin(radians({lat})), 2))"
    return f"degrees({east} / ({R}e0 / sqrt({m}) * cos(radians({lat}))))", f"degrees({north} / (({R}e0 * (1 - {f})) / ({m} * sqrt({m}))))"
