"""Greedy and online matching of point streams, with the batch decoders' core in keyed state.

A stream of gps points is joined with the static network's grid cells (a stream-static outer join, so misses stay), and each trajectory's decoder is kept as a group's state.
Rows of a micro-batch are taken in order of (time, idx); a point that is not newer than the last one of its trajectory is
late: dropped, or with late="mark" put out with revision -1 and no match, to be counted or stored apart. Output rows are upserts by (tid, idx): greedy writes each once; online writes again, with a higher
revision, what a convergence corrects (output mode update). With a timeout ("1 hour") a trajectory without points for so
long by the clock is forgotten; use it with queries that run on, as Spark then looks for timeouts again and again. With
finalize its last rows are first revised along the most likely path, as at the end of a batch.

keep() stores micro-batches so that a repeated one replaces itself, and latest() reads the newest revision of each point.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.operators.candidates import RADIUS, hits
from waymark.operators.decoder import Decoder, Match, Point, Weights
from waymark.operators.matchers import MATCHED, _frame, broadcast_network, network_of, points_of, rows_of

STATE = "decoder binary, last_millis long, last_idx int"


def match_stream(points: DataFrame, expanded: DataFrame, method: str = "greedy", *, weights: str = "dynamic", window: int = 10, radius: float = RADIUS, compat: bool = False, timeout: str | None = None, finalize: bool = False, late: str = "drop") -> DataFrame:
    """Streaming matched_points of a stream with tid, oid, idx, time, lng, lat. Write it in update mode."""
    if method not in ("greedy", "online"):
        raise ValueError("streams are matched by greedy or online")
    net = broadcast_network(points.sparkSession, expanded)
    flat = hits(points.select("tid", "oid", "idx", F.col("time").cast("timestamp").alias("time"), "lng", "lat"), expanded, radius, keep_misses=True).withColumn("millis", F.unix_millis("time"))
    limit = int(pd.Timedelta(timeout).total_seconds() * 1000) if timeout else None

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        network = network_of(net)
        if state.hasTimedOut:
            if finalize:
                decoder, seen = pickle.loads(bytes(state.get[0]))
                decoder.network, decoder.finalize = network, True
                ends = [m for m in decoder.end() if m.idx in seen]
                yield _frame(rows_of([seen[m.idx][0] for m in ends], ends, {m.idx: (key[0], seen[m.idx][1], m.idx, seen[m.idx][2]) for m in ends}))
            state.remove()
            return
        if state.exists:
            data, last, last_idx = state.get
            decoder, seen = pickle.loads(bytes(data))
            decoder.network = network
        else:
            decoder, seen, last, last_idx = Decoder(network, method, Weights(dynamic=weights == "dynamic"), window, compat), {}, None, None
        pdf = pd.concat(list(frames), ignore_index=True).sort_values(["millis", "idx"], kind="stable")
        if last is not None:
            new = (pdf["millis"] > last) | ((pdf["millis"] == last) & (pdf["idx"] > last_idx))
            old = points_of(pdf[~new], network) if late == "mark" else []
            if old:
                when = {int(i): (key[0], o, int(i), t) for i, o, t in zip(pdf["idx"], pdf["oid"], pdf["time"])}
                yield _frame(rows_of(old, [Match(p.idx, None, -1) for p in old], when))
            pdf = pdf[new]
        named = {int(i): (o, t) for i, o, t in zip(pdf["idx"], pdf["oid"], pdf["time"])}
        rows: dict[int, Match] = {}
        for p in sorted(points_of(pdf, network), key=lambda p: (p.millis, p.idx)) if len(pdf) else ():
            seen[p.idx] = (Point(p.idx, p.millis, p.lng, p.lat), *named[p.idx])
            for m in decoder.feed(p):
                rows[m.idx] = replace(m)
            decoder.forget()
            last, last_idx = p.millis, p.idx
        out = _frame(rows_of([seen[i][0] for i in rows], list(rows.values()), {i: (key[0], seen[i][1], i, seen[i][2]) for i in rows}))
        seen = {i: seen[i] for i in sorted(seen, key=lambda i: (seen[i][0].millis, i))[-decoder.depth - 1 :]}
        decoder.network = None  # the state holds what is the trajectory's own
        state.update((pickle.dumps((decoder, seen)), last, last_idx))
        if limit:
            state.setTimeoutDuration(limit)
        yield out

    return flat.groupBy("tid").applyInPandasWithState(fold, MATCHED, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if limit else GroupStateTimeout.NoTimeout)


def keep(path: str):
    """For foreachBatch: each micro-batch is a folder of its own below path, written again whole if it is repeated."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(rows: DataFrame) -> DataFrame:
    """Of kept rows the newest revision of each point, without late ones."""
    fields = [c for c in rows.columns if c not in ("tid", "idx", "batch")]
    newest = rows.where("revision >= 0").groupBy("tid", "idx").agg(F.max_by(F.struct(*fields), F.struct("revision", "batch")).alias("r"))
    return newest.select("tid", "idx", *[F.col(f"r.{c}").alias(c) for c in fields])
