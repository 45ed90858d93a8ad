"""Exact deduplication by distributed MSD radix partitioning.

Texts are split by successive byte strings (digits of 64, 512, 4,096, ... bytes) until a group is a single text or its
texts have ended; equality is decided by the bytes themselves, never by a digest.

Two levels. Each task first splits the rows of one Arrow batch (bounded memory) and keeps one representative of equal
texts with their count, so a text that a third of all rows share sends one row per batch. The representatives then go
through rounds of partial aggregation and a join on (group, digit). Only rows in groups of two or more go on, with the
rest of their bytes. A round's state is a table in the shared folder, so a lost executor costs one round at most.

Defined results: null text is empty text; equal means identical after lower-casing A-Z; the row with the largest id
stays, null ids rank lowest, and among rows that repeat the id one stays (the last in table order). An empty table gives
an empty table. All other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waymark.llm.common import drop, free_name, plain, small_batches, stored

FIRST_DIGIT, GROWTH = 64, 8


def radix_groups(texts: list[bytes], width: int = FIRST_DIGIT) -> list[int]:
    """For each text the index of the first equal one; splits groups by successive digits until single or ended."""
    first = list(range(len(texts)))
    todo = [(first[:], 0, width)]
    while todo:
        group, at, width = todo.pop()
        parts: dict[tuple[bytes, bool], list[int]] = {}
        for i in group:
            t = texts[i]
            parts.setdefault((t[at : at + width], len(t) <= at + width), []).append(i)
        for (_, ended), part in parts.items():
            if len(part) > 1 and ended:
                for i in part:
                    first[i] = part[0]
            elif len(part) > 1:
                todo.append((part, at + width, width * GROWTH))
    return first


def _collapse(id_at: int, text_at: int, carried: list[int], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            texts = [(x or b"").lower() for x in b.column(text_at).cast(pa.binary()).to_pylist()]
            ids, n = b.column(id_at).to_pylist(), b.num_rows
            first = radix_groups(texts)
            count, best = [0] * n, list(range(n))
            for i, f in enumerate(first):
                count[f] += 1
                if ids[i] is not None and (ids[best[f]] is None or ids[i] >= ids[best[f]]) or ids[best[f]] is None:
                    best[f] = i
            own = [f == i for i, f in enumerate(first)]
            yield pa.record_batch(
                [
                    *[b.column(k) for k in carried],
                    pa.array([uid + i for i in range(n)], pa.int64()),
                    pa.array([uid + f for f in first], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                    pa.array([t if o else None for t, o in zip(texts, own)], pa.binary()),
                    pa.array([c if o else None for c, o in zip(count, own)], pa.int64()),
                    pa.array([ids[k] if o else None for k, o in zip(best, own)], schema.field(-2).type),
                    pa.array([uid + k if o else None for k, o in zip(best, own)], pa.int64()),
                ],
                schema=schema,
            )
            uid += n

    return run


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) with keep_id, group_size, kept and text_sha256 (names get _ if taken)."""
    small_batches(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    plainly, name = plain(docs)
    id_, text = name[id_col], name[text_col]
    uid, rep, sha, rest, n, kid, kuid = "uid", "rep", "sha", "rest", "n", "kid", "kuid"
    id_type = plainly.schema[id_].dataType
    fields = [plainly.schema[name[c]] for c in carry]
    new = [(uid, T.LongType()), (rep, T.LongType()), (sha, T.StringType()), (rest, T.BinaryType()), (n, T.LongType()), (kid, id_type), (kuid, T.LongType())]
    schema = T.StructType([*fields, *(T.StructField(*x) for x in new)])
    given = plainly.select(id_, text, *[name[c] for c in carry if c not in (id_col, text_col)])
    at = {c: k for k, c in enumerate(given.columns)}
    run = _collapse(0, 1, [at[name[c]] for c in carry], to_arrow_schema(schema))
    local = stored(given.mapInArrow(run, schema), "exact-local")

    active = local.where(F.col(rest).isNotNull()).select(F.col(rep).alias("u"), F.lit(0).cast("long").alias("g"), F.col(rest).alias("t"), F.col(n).alias("n"), F.struct(F.col(kid).alias("id"), F.col(kuid).alias("uid")).alias("keep"))
    width, ended, done = FIRST_DIGIT, [], []
    while True:
        parts = active.select("u", "g", "n", "keep", F.substring("t", 1, width).alias("k"), F.expr(f"substring(t, {width + 1})").alias("t"), (F.length("t") <= width).alias("end"))
        groups = parts.groupBy("g", "k", "end").agg(F.count("*").alias("c"), F.min("u").alias("ng"), F.sum("n").alias("size"), F.max("keep").alias("best")).where("c > 1")
        groups = stored(groups, "exact-groups")
        split = parts.hint("merge").join(groups, ["g", "k", "end"]).select("u", F.col("ng").alias("g"), F.when(~F.col("end"), F.col("t")).alias("t"), "n", "keep", "size", "best", "end")
        split = stored(split, "exact-split")
        drop(groups)
        done.append(split)
        ended.append(split.where("end").select("u", "size", "best"))
        active = split.where("not end").select("u", "g", "t", "n", "keep")
        if active.isEmpty():
            break
        width *= GROWTH
    found = ended[0]
    for x in ended[1:]:
        found = found.unionAll(x)
    # What representatives alone know (singletons of the rounds) comes from the local table.
    own = local.where(F.col(rest).isNotNull()).select(F.col(rep).alias("u"), F.col(n).alias("n"), F.struct(F.col(kid).alias("id"), F.col(kuid).alias("uid")).alias("keep"))
    final = stored(own.join(found, "u", "left").select("u", F.coalesce("size", "n").alias("size"), F.coalesce("best", "keep").alias("best")), "exact-classes").toDF("of", "size", "best")
    drop(*done)
    names = [free_name(carry, x) for x in ("keep_id", "group_size", "kept", "text_sha256")]
    out = local.join(final, F.col(rep) == F.col("of"))
    return out.select(
        *[F.col(name[c]).alias(c) for c in carry],
        F.col("best.id").alias(names[0]),
        F.col("size").alias(names[1]),
        (F.col("best.uid") == F.col(uid)).alias(names[2]),
        F.col(sha).alias(names[3]),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another row keeps; the columns stay as they are."""
    marked = annotate(docs, id_col, text_col)
    kept = free_name(docs.columns, "kept")
    return marked.where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
