"""Connected components of an edge table, by repeated contraction.

In each round every node points at the first of itself and its neighbours, in an order that a hash of the round deals
anew, so that chains of any order shrink as fast as random ones do (to about a third). Edges are then renamed by their
ends' pointers, and loops and repeats go. A round is two narrow joins, written to the shared folder. Pointers of the rounds
are composed backwards at the end. Nothing is collected. At most SMALL edges, a few hundred kilobytes, are joined in one task
instead, as rounds of so little are all scheduling.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import drop, stored


#: So many edges are joined in one task; more are contracted.
SMALL = 1 << 16


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges, the root being the smallest."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(list(map(root, nodes)), pa.int64())], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", small: int = SMALL) -> DataFrame:
    """(node, root) for all nodes that have an edge to another; root is the same for all nodes of a component and one of them."""
    one = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = stored(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph-edges")
    if dict(now.dtypes) == {"a": "bigint", "b": "bigint"} and 0 < now.limit(small + 1).count() <= small:
        labels = stored(now.coalesce(1).mapInArrow(_united, "node long, root long"), "graph-labels")
        drop(now)
        return labels
    pointers: list[DataFrame] = []
    while not now.isEmpty():
        place = lambda x: F.struct(F.xxhash64(F.lit(len(pointers)), x).alias("h"), F.col(x).alias("id"))  # noqa: E731, B023
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(place("b")).alias("first"))
        p = stored(first.select("node", F.least("first", place("node"))["id"].alias("to")), "graph-pointers")
        pointers.append(p)
        left = now.join(p.select(F.col("node").alias("a"), F.col("to").alias("pa")), "a").select("b", "pa")
        ends = left.join(p.select(F.col("node").alias("b"), F.col("to").alias("pb")), "b").where("pa <> pb")
        before, now = now, stored(ends.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "graph-edges")
        drop(before)
    if not pointers:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    labels = pointers[-1]
    for p in reversed(pointers[:-1]):
        later = labels.select(F.col("node").alias("to"), F.col(labels.columns[1]).alias("root"))
        before, labels = labels, stored(p.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "graph-labels")
        drop(p, before)
    return labels.toDF("node", "root")
