"""Shortest paths as a table: sp(src, dst, length_m, segment_ids), null length where there is no way.

Pairs are made distinct first, so a search serves all steps of all trajectories; searches are grouped by source. A network
within the broadcast bound is searched by a heap in each task; iterative() relaxes larger ones by joins.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.matchers import broadcast_network, network_of

SP = "src int, dst int, length_m double, segment_ids array<int>"


def candidate_nodes(candidates: DataFrame, expanded: DataFrame) -> DataFrame:
    """(tid, idx, node_id, role): ends of the candidates' segments as sources, their starts as targets; distinct."""
    j = candidates.select("tid", "idx", "segment_id").join(expanded.select("segment_id", "start_id", "end_id"), "segment_id")
    roles = F.explode(F.array(F.struct(F.col("end_id").alias("node_id"), F.lit("source").alias("role")), F.struct(F.col("start_id").alias("node_id"), F.lit("target").alias("role"))))
    return j.select("tid", "idx", roles.alias("r")).select("tid", "idx", "r.node_id", "r.role").distinct()


def node_pairs(candidates: DataFrame, expanded: DataFrame) -> DataFrame:
    """Distinct (src, dst) that consecutive points' candidates need."""
    seg = expanded.select("segment_id", "start_id", "end_id")
    c = candidates.select("tid", "idx", "segment_id").join(seg, "segment_id")
    a = c.select("tid", (F.col("idx") + 1).alias("idx"), F.col("end_id").alias("src")).distinct()
    b = c.select("tid", "idx", F.col("start_id").alias("dst")).distinct()
    return a.join(b, ["tid", "idx"]).select("src", "dst").distinct()


def shortest_paths(pairs: DataFrame, expanded: DataFrame, bound: float = math.inf) -> DataFrame:
    """sp for distinct pairs (src, dst); longer ways than bound count as none."""
    net = broadcast_network(pairs.sparkSession, expanded)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        network, src = network_of(net), int(pdf["src"].iloc[0])
        ways = [network.node_path(src, int(d), bound) for d in pdf["dst"]]
        return pd.DataFrame({"src": pdf["src"].astype("int32"), "dst": pdf["dst"].astype("int32"), "length_m": [w.length if w else None for w in ways], "segment_ids": [list(w.segments) if w else None for w in ways]})

    return pairs.select("src", "dst").distinct().groupBy("src").applyInPandas(search, SP)


def paths_from(sources: DataFrame, expanded: DataFrame, bound: float = math.inf) -> DataFrame:
    """sp from each distinct source (column src) to every node of the network; no pairs are listed beforehand."""
    net = broadcast_network(sources.sparkSession, expanded)

    def search(batches):
        network = network_of(net)
        nodes = sorted(network.place)
        for pdf in batches:
            for src in pdf["src"].tolist():
                ways = [network.node_path(int(src), d, bound) for d in nodes]
                yield pd.DataFrame({"src": pd.Series([src] * len(nodes), dtype="int32"), "dst": pd.Series(nodes, dtype="int32"), "length_m": [w.length if w else None for w in ways], "segment_ids": [list(w.segments) if w else None for w in ways]})

    return sources.select("src").distinct().mapInPandas(search, SP)


def iterative(sources: DataFrame, edges: DataFrame, bound: float, rounds: int = 10_000) -> DataFrame:
    """(src, dst, length_m) of all nodes within the bound of each source (column src), by rounds of joins.

    A round extends the rows that the last one shortened and keeps the least length of each pair. Every round is written
    by checkpoint(), so the session needs a checkpoint folder (spark.checkpoint.dir)."""
    e = edges.groupBy("src", "dst").agg(F.min("length_m").alias("w")).select(F.col("src").alias("u"), F.col("dst").alias("v"), "w")
    best = sources.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0.0).alias("length_m"), F.lit(True).alias("fresh")).checkpoint()
    for _ in range(rounds):
        longer = best.where("fresh").join(e, F.col("dst") == F.col("u")).select("src", F.col("v").alias("dst"), (F.col("length_m") + F.col("w")).alias("length_m"), F.lit(True).alias("fresh")).where(F.col("length_m") <= bound)
        both = best.withColumn("fresh", F.lit(False)).unionByName(longer)
        # A row is fresh again only where the new length is the smaller one: an old row wins ties.
        least = F.min_by(F.struct("length_m", "fresh"), F.struct("length_m", "fresh"))
        best = both.groupBy("src", "dst").agg(least.alias("m")).select("src", "dst", "m.length_m", "m.fresh").checkpoint()
        if best.where("fresh").isEmpty():
            return best.select("src", "dst", "length_m")
    raise RuntimeError(f"lengths still fall after {rounds} rounds")


def point_routes(requests: DataFrame, expanded: DataFrame, radius: float = 300.0) -> DataFrame:
    """(id, length_m, segment_ids) for requests (id, lng1, lat1, lng2, lat2); null length: no segment in reach or no way.

    Ends snap by the nearest-candidate join, not by a scan."""
    from waymark.operators.candidates import nearest
    from waymark.operators.routing import Candidate

    net = broadcast_network(requests.sparkSession, expanded)
    snap = lambda k: nearest(requests.select(F.col("id"), F.col(f"lng{k}").alias("lng"), F.col(f"lat{k}").alias("lat")), expanded, radius, keys=("id",))
    place = F.struct("segment_id", "matched_index", "cand_lng", "cand_lat", "err_m", "offset_m")
    both = requests.join(snap(1).select("id", place.alias("a")), "id", "left").join(snap(2).select("id", place.alias("b")), "id", "left")
    flat = both.select("id", "lng1", "lat1", "lng2", "lat2", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ("segment_id", "matched_index", "cand_lng", "cand_lat", "err_m", "offset_m")])

    def run(batches):
        network = network_of(net)
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                way = None
                a, b = ((r["lng1"], r["lat1"]), (r["lng2"], r["lat2"]))
                if a == b:
                    rows.append((r["id"], 0.0, []))
                    continue
                if not (pd.isna(r["a_segment_id"]) or pd.isna(r["b_segment_id"])):
                    ca, cb = (Candidate(int(r[f"{s}_segment_id"]), int(r[f"{s}_matched_index"]), r[f"{s}_cand_lng"], r[f"{s}_cand_lat"], r[f"{s}_err_m"], r[f"{s}_offset_m"]) for s in "ab")
                    way = network.snapped_route(a, ca, b, cb)
                rows.append((r["id"], way.length if way else None, list(way.segments) if way else None))
            yield pd.DataFrame(rows, columns=["id", "length_m", "segment_ids"])

    return flat.mapInPandas(run, f"id {requests.schema['id'].dataType.simpleString()}, length_m double, segment_ids array<int>")
