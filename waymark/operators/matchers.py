"""Matchers over tables: candidates by the spatial join, then one fold per trajectory with the shared Python decoders.

The only shuffle of candidates is by tid. A trajectory's rows are folded in one task; with fixed weights a decoder starts
anew where a point has no candidate, so match(split=True) cuts long trajectories there and folds the parts apart.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators import baselines
from waymark.operators.candidates import RADIUS, hits
from waymark.operators.decoder import Decoder, Match, Point, Weights, decode
from waymark.operators.routing import Network
from waymark.plans.network import collected
from waymark.session import ship, width

MATCHED = "tid string, oid string, idx int, time timestamp, raw_lng double, raw_lat double, segment_id int, lng double, lat double, err_m double, offset_m double, matched_index int, cand_index int, skipped boolean, revision int, converged boolean"
METHODS = ("batch", "greedy", "online", "amm", "aomm", "dwrmm")


def broadcast_network(spark: SparkSession, expanded: DataFrame):
    """The network (bounded by plans.network.BROADCAST_VERTICES) for all tasks."""
    ship(spark)
    return spark.sparkContext.broadcast(collected(expanded))


_networks: dict[tuple, Network] = {}


def network_of(broadcast, router: Callable[[dict[int, tuple]], Network] = Network) -> Network:
    """One per worker process, broadcast and router."""
    key = id(broadcast.value), f"{router.__module__}.{router.__qualname__}"
    if key not in _networks:
        _networks.clear()
        _networks[key] = router(broadcast.value)
    return _networks[key]


def weights_of(weights: str | Callable[[], Weights]) -> Weights:
    """dynamic, fixed, or what a user's function gives: anything with transition, emission and update(emissions, transitions)."""
    return weights() if callable(weights) else Weights(dynamic=weights == "dynamic")


def points_of(rows: pd.DataFrame, network: Network) -> list[Point]:
    """Points with candidates, in order, from rows of hits (no segment_id: no candidate; of a segment the nearest leg).

    Places are computed anew: the last bit of a coordinate is a nanometre, enough to turn near ties of twins round, and the
    JVM's sines are not those of Python and SQL."""
    rows = rows.sort_values(["idx", "err_m", "matched_index"], kind="stable")
    found: list[Point] = []
    seen: dict[int, int] = {}
    columns = ("idx", "millis", "lng", "lat", "segment_id", "matched_index")
    for idx, millis, lng, lat, seg, leg in zip(*(rows[c].tolist() for c in columns)):
        if not found or found[-1].idx != idx:
            found.append(Point(int(idx), int(millis), lng, lat))
            seen = {}
        if seg == seg and seg is not None and seg is not pd.NA:
            c, own = network.placed(int(seg), int(leg), lng, lat, int(idx)), found[-1].candidates
            if (at := seen.setdefault(c.seg, len(own))) == len(own):
                own.append(c)
            elif (c.err, c.leg) < (own[at].err, own[at].leg):
                own[at] = c
    for p in found:
        p.candidates.sort(key=lambda c: c.order)
    return found


def run(network: Network, points: list[Point], method: str, weights: str | Callable[[], Weights], window: int, compat: bool, turning: bool, finalize: bool) -> list[Match]:
    if method == "amm":
        return baselines.adaptive(network, points, compat)[0]
    if method == "aomm":
        return baselines.adaptive_online(network, points, compat)
    if method == "dwrmm":
        return baselines.dynamically_weighted(network, points)
    return decode(network, points, mode=method, weights=weights_of(weights), window=window, compat=compat, turning=turning, finalize=finalize)


def rows_of(points: list[Point], matches: list[Match], first: dict) -> list[tuple]:
    """Output rows; first: idx -> (tid, oid, time)."""
    at = {p.idx: p for p in points}
    rows = []
    for m in matches:
        p, c = at[m.idx], m.cand
        real = c is not None and not c.skip
        place = (c.seg, c.lng, c.lat, c.err, c.offset, c.leg, c.idx) if real else (None,) * 6 + (-1 if c is not None else None,)
        rows.append((*first[m.idx], p.lng, p.lat, *place, c is not None and c.skip, m.revision, m.converged))
    return rows


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in MATCHED.split(", ")]
    out = pd.DataFrame(rows, columns=["tid", "oid", "idx", "time", *names[4:]])
    for c in ("segment_id", "matched_index", "cand_index"):
        out[c] = out[c].astype("Int32")
    return out[names]


def joined(points: DataFrame, expanded: DataFrame, radius: float = RADIUS) -> DataFrame:
    """Points with the legs in reach (misses stay), what the folds read.

    Points are dealt out by tid before the join, which keeps that, so the folds need no shuffle of the wider rows."""
    given = points.select("tid", "oid", "idx", F.col("time").cast("timestamp").alias("time"), "lng", "lat").repartition(width(points.sparkSession), "tid")
    return hits(given, expanded, radius, keep_misses=True).withColumn("millis", F.unix_millis("time"))


def match(points: DataFrame, expanded: DataFrame, method: str = "batch", *, weights: str | Callable[[], Weights] = "dynamic", window: int = 10, radius: float = RADIUS, compat: bool = False, turning: bool = False, finalize: bool = False, split: bool = False, router: Callable[[dict[int, tuple]], Network] = Network) -> DataFrame:
    """A row for each point (table matched_points). points: tid, oid, idx, time, lng, lat; expanded: the directed network.
    weights: "dynamic", "fixed", or a function that makes a weight adjuster for a trajectory; router: what searches paths, a
    Network or a subclass with another _search()."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    if split and (weights != "fixed" or method not in ("batch", "greedy", "online")):
        raise ValueError("only decoders with fixed weights can be split")
    net = broadcast_network(points.sparkSession, expanded)
    rows = joined(points, expanded, radius)
    keys = ["tid"]
    if split:
        gaps = F.sum(F.col("segment_id").isNull().cast("int")).over(Window.partitionBy("tid").orderBy("idx").rangeBetween(Window.unboundedPreceding, 0))
        rows, keys = rows.withColumn("part", gaps), ["tid", "part"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        network = network_of(net, router)
        points = points_of(pdf, network)
        first = {int(i): (t, o, int(i), w) for t, o, i, w in zip(pdf["tid"], pdf["oid"], pdf["idx"], pdf["time"])}
        return _frame(rows_of(points, run(network, points, method, weights, window, compat, turning, finalize), first))

    return rows.groupBy(*keys).applyInPandas(fold, MATCHED)


def matched_length(points: DataFrame, expanded: DataFrame, radius: float = RADIUS, compat: bool = False) -> DataFrame:
    """(tid, length_m) of the adaptive matcher's best way."""
    net = broadcast_network(points.sparkSession, expanded)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tid": [pdf["tid"].iloc[0]], "length_m": [baselines.adaptive(network_of(net), points_of(pdf, network_of(net)), compat)[1]]})

    return joined(points, expanded, radius).groupBy("tid").applyInPandas(fold, "tid string, length_m double")


def online_delays(points: DataFrame, expanded: DataFrame, *, weights: str = "dynamic", window: int = 10, radius: float = RADIUS, compat: bool = False) -> DataFrame:
    """(tid, n, corrected, delay): points that convergence corrected within the window, and the steps they waited in sum."""
    net = broadcast_network(points.sparkSession, expanded)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        found = points_of(pdf, network_of(net))
        d = Decoder(network_of(net), "online", weights_of(weights), window, compat)
        for p in found:
            d.feed(p)
        return pd.DataFrame({"tid": [pdf["tid"].iloc[0]], "n": [len(found)], "corrected": [d.delay_points], "delay": [d.delay]})

    return joined(points, expanded, radius).groupBy("tid").applyInPandas(fold, "tid string, n long, corrected long, delay long")
