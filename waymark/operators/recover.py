"""Path recovery: the connected way through the matched points, cut where there is none."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.matchers import broadcast_network, network_of
from waymark.operators.routing import Candidate, Network

PATHS = "tid string, oid string, part int, segment_ids array<int>, points array<struct<lng: double, lat: double>>"


def recover_points(network: Network, found: list[Candidate]) -> list[tuple[list[int], list[tuple[float, float]]]]:
    """Parts of (segment ids, points), both without repeats in a row.

    Forward on one segment: its vertices between; else to the segment's end, the shortest way, and on to the next match."""
    parts: list[tuple[list[int], list[tuple[float, float]]]] = []

    def add(segments, points):
        segs, line = parts[-1]
        for s in segments:
            if not segs or segs[-1] != s:
                segs.append(s)
        for p in points:
            if not line or line[-1] != p:
                line.append(p)

    for k, b in enumerate(found):
        if k == 0:
            parts.append(([], []))
            add([b.seg], [(b.lng, b.lat)])
            continue
        a = found[k - 1]
        if a.seg == b.seg and a.offset <= b.offset:
            add([b.seg], network._between(a, b))
            continue
        middle = network.node_path(network.segments[a.seg][1], network.segments[b.seg][0])
        if a.seg == b.seg or middle is None:
            if a.seg == b.seg:  # back on the same segment: the match moved, the vehicle did not turn
                add([b.seg], [(b.lng, b.lat)])
                continue
            add([a.seg], network._tail(a))  # on to the segment's end, and cut there
            parts.append(([], []))
            add([b.seg], [(b.lng, b.lat)])
            continue
        add([a.seg, *middle.segments, b.seg], [*network._tail(a), *middle.points, *network._head(b)])
    return parts


def recover(matched: DataFrame, expanded: DataFrame) -> DataFrame:
    """Table paths from matched_points; unmatched and skipped points are passed over, always under (tid, oid)."""
    net = broadcast_network(matched.sparkSession, expanded)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", kind="stable")
        found = [Candidate(int(s), int(k), float(x), float(y), float(e), float(o), int(i)) for s, k, x, y, e, o, i in zip(pdf["segment_id"], pdf["matched_index"], pdf["lng"], pdf["lat"], pdf["err_m"], pdf["offset_m"], pdf["idx"])]
        rows = [(pdf["tid"].iloc[0], pdf["oid"].iloc[0], k, segs, [{"lng": x, "lat": y} for x, y in line]) for k, (segs, line) in enumerate(recover_points(network_of(net), found))]
        return pd.DataFrame(rows, columns=["tid", "oid", "part", "segment_ids", "points"])

    kept = matched.where(F.col("segment_id").isNotNull()).select("tid", "oid", "idx", "segment_id", "matched_index", "lng", "lat", "err_m", "offset_m")
    return kept.groupBy("tid").applyInPandas(fold, PATHS)
