"""Near-duplicates among embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

Fit (bounded sample of FIT_ROWS vectors): unit vectors, centred on their mean, are projected to their principal directions,
and a rotation is learned by alternating signs and an orthogonal Procrustes fit (ITQ), so that the codes are balanced also
where all vectors lean to one side. Bits beyond the learned ones are random planes through the same centre.

Plan: for vectors of the sample, partners AT the threshold are made in random directions. How often their bits agree, and
those of random pairs of the sample, is measured; the bits of a table and the number of tables are the cheapest for the
number of vectors by which a pair at the threshold meets in a table with probability WANTED. No two tables share a bit,
or misses would go together.

Search: every vector is indexed and is a query. Per table and key the codes (first HAMMING bits, no vectors) are compared;
pairs within the Hamming distance that CLOSE of the made partners have remain, and only for their vectors the original
values are fetched and compared in double precision. A bucket of more than 2 * HALF is cut into blocks and each pair of
blocks is a task. A pair is counted in the first table where it meets. Tasks return counts and a spanning forest of their
links, never pairs.

Equal vectors are one class with a multiplicity (folded by batch where they are read, then by digest).

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are
kept (all other finite ones count, of whatever size); vectors of different lengths never link; links found are exact (no
pair below the threshold), their recall is measured in the tests; component_id is the smallest id reachable (nulls passed
over); rows that repeat an id are vectors of their own; an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waymark.llm.common import drop, free_name, plain, small_batches, stored
from waymark.llm.graph import components

THRESHOLD, WANTED, CLOSE, BITS, HAMMING, HALF = 0.9, 0.97, 0.999, 64, 128, 512
FIT_ROWS, PARTNERS, ROUNDS, SEED = 5_000, 2_000, 30, 13
#: Bits of a table at most; comparisons of codes that cost as much as a row of a table.
MOST_BITS, WORTH = 24, 15
KEY = np.dtype("<u4")


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1; by the largest component first, so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=-1, keepdims=True)
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Each row as doubles; None where it can't link."""
    found = []
    for x in column:
        v = np.array([math.nan if k is None else k for k in x.as_py()], float) if x.is_valid else np.empty(0)
        found.append(v if len(v) and np.isfinite(v).all() and v.any() else None)
    return found


def itq(rows: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): the signs of (unit vector - mean) @ projection are its code."""
    mean = rows.mean(axis=0)
    x = rows - mean
    _, vec = np.linalg.eigh(x.T @ x)
    w = vec[:, ::-1][:, :bits]
    v = x @ w
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((w.shape[1],) * 2))[0]
    for _ in range(rounds):
        u, _, t = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ t).T
    return mean, w @ r


def partners(rows: np.ndarray, threshold: float = THRESHOLD, seed: int = SEED) -> np.ndarray:
    """For each unit vector another one at the threshold, in a random direction."""
    side = np.random.default_rng([seed, 2]).standard_normal(rows.shape)
    side -= (side * rows).sum(axis=1, keepdims=True) * rows
    return threshold * rows + math.sqrt(max(0.0, 1 - threshold**2)) * side / np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-300)


@dataclass
class Coder:
    """mean and planes of the codes; table t has bits t * width to (t + 1) * width; most is the Hamming distance of the
    first `checked` bits that candidates may have."""

    mean: np.ndarray
    planes: np.ndarray
    tables: int
    width: int
    checked: int
    most: int

    def signs(self, rows: np.ndarray) -> np.ndarray:
        """Bits of unit vectors; of another length than the fitted one they are by rule, through the origin."""
        if rows.shape[1] == len(self.mean):
            return (rows - self.mean) @ self.planes >= 0
        return rows @ np.random.default_rng(rows.shape[1]).standard_normal((rows.shape[1], self.planes.shape[1])) >= 0

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """The key of each table (columns)."""
        bits = self.signs(rows)[:, : self.tables * self.width].reshape(len(rows), self.tables, self.width)
        return (bits @ (np.uint32(1) << np.arange(self.width, dtype=np.uint32))).astype(KEY)

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """The first bits, as bytes."""
        return np.packbits(self.signs(rows)[:, : self.checked], axis=1)


def plan(n: int, rows: np.ndarray, threshold: float = THRESHOLD, seed: int = SEED) -> Coder:
    """For n vectors of which rows (unit vectors) are a sample."""
    d = rows.shape[1]
    mean, learned = itq(rows, min(BITS, d))
    few = rows[: PARTNERS]
    rng = np.random.default_rng([seed, 1])
    pool = np.hstack([learned, rng.standard_normal((d, 512))])
    code = lambda x, planes: (x - mean) @ planes >= 0
    near = (code(few, pool) == code(partners(few, threshold), pool)).mean(axis=1)
    a, b = rng.integers(0, len(rows), (2, 20_000))
    other = (code(rows[a[a != b]], pool) == code(rows[b[a != b]], pool)).mean(axis=1) if len(rows) > 1 else np.ones(1)

    def tables(width: int) -> int:
        """The least number by which pairs at the threshold meet often enough."""
        meet, low, high = near**width, 1, 2
        enough = lambda t: (1 - (1 - meet) ** t).mean() >= WANTED
        while not enough(high) and high < 1 << 20:
            low, high = high, 2 * high
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if enough(mid) else (mid + 1, high)
        return low

    cost = lambda width: tables(width) * (n + n * n / 2 * float((other**width).mean()) / WORTH)
    width = min(range(1, MOST_BITS + 1), key=cost)
    count = tables(width)
    checked = max(HAMMING, learned.shape[1])
    more = max(count * width, checked) - learned.shape[1]
    planes = np.hstack([learned, rng.standard_normal((d, max(0, more)))])
    far = (code(few, planes[:, :checked]) != code(partners(few, threshold), planes[:, :checked])).sum(axis=1)
    return Coder(mean, planes, count, width, checked, int(np.quantile(far, CLOSE, method="higher")))


def fit(vecs: DataFrame, vec_col: str, threshold: float = THRESHOLD) -> Coder:
    """The plan of a table's vectors, from those with the least hashes; the most frequent length of these is fitted."""
    small_batches(vecs.sparkSession)
    n = vecs.count()
    h = F.xxhash64(F.lit(SEED), vec_col)
    share = min(1.0, 1.5 * FIT_ROWS / max(n, 1))
    few = vecs.where(F.pmod(h, F.lit(1 << 20)) < math.ceil(share * (1 << 20))).select(F.col(vec_col).alias("v"), h.alias("h"))
    drawn = few.distinct().orderBy("h").limit(FIT_ROWS).select("v").toArrow()
    rows = [v for v in vectors(drawn["v"].combine_chunks()) if v is not None]
    if not rows:
        return Coder(np.zeros(1), np.ones((1, 8)), 1, 1, 8, 8)
    lengths = [len(v) for v in rows]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k))
    return plan(n, unit(np.array([v for v in rows if len(v) == d])), threshold)


def _index(coder: Coder, at: int, kept: int, arrow: pa.Schema, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for b in batches:
            found = vectors(b.column(at))
            first: dict[bytes, int] = {}
            same, sig, raw, count, keys, code = [], [], [], [0] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
            for i, v in enumerate(found):
                data = None if v is None else (v + 0.0).astype(kind).tobytes()
                own = data is not None and data not in first
                k = i if data is None else first.setdefault(data, i)
                count[k] += data is not None
                same.append(base + k)
                sig.append(hashlib.blake2b(data, digest_size=16).digest() if own else None)
                raw.append(data if own else None)
            for d in {len(found[i]) for i in first.values()}:
                own = [i for i in first.values() if len(found[i]) == d]
                rows = unit(np.array([found[i] for i in own]))
                for i, k, c in zip(own, coder.keys(rows), coder.codes(rows)):
                    keys[i], code[i] = k.tobytes(), c.tobytes()
            cols = [[base + i for i in range(b.num_rows)], same, sig, keys, code, raw, [c if s is not None else None for c, s in zip(count, sig)]]
            yield pa.record_batch([*b.columns[:kept], *(pa.array(c, arrow.field(kept + k).type) for k, c in enumerate(cols))], schema=arrow)
            base += b.num_rows

    return run


def _runs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[tuple, list[tuple]] | None]:
    """(key, columns of the rest) of each run of two or more rows with equal first columns; None after each batch."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[:parts] != key:
                if len(held) > 1:
                    yield key, list(zip(*held))
                key, held = row[:parts], []
            held.append(row[parts:])
        yield None
    if len(held) > 1:
        yield key, list(zip(*held))
    yield None


def _across(hit: np.ndarray, key: tuple, sides: tuple) -> np.ndarray:
    """Within one block (i = j) a pair is met by every task of the block, so i = j alone counts it."""
    np.fill_diagonal(hit, False)
    if key[2] != key[3]:
        side = np.array(sides)
        hit &= side[:, None] != side[None, :]
    return hit


def _near_codes(most: int):
    """Of the codes of a bucket those with another within the distance: their keys and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for x in _runs(batches, 4):
            if x is None:
                yield pa.record_batch([pa.array([r[k] for r in found], t) for k, t in enumerate([pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()])], ["t", "k", "i", "j", "uid", "side"])
                found = []
                continue
            key, (uids, codes, sides) = x
            bits = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(uids), -1), axis=1).astype(np.float32)
            ones = bits.sum(axis=1)
            far = ones[:, None] + ones[None, :] - 2 * (bits @ bits.T)
            some = _across(far <= most, key, sides).any(axis=1)
            found += [(*key, uids[k], sides[k]) for k in np.nonzero(some)[0]]

    return run


def _compare(threshold: float, kind):
    """Counts of links (b null) and a spanning forest of them (n 0), from the vectors themselves."""

    def decide(key: tuple, uids: tuple, sides: tuple, keys: tuple, raws: tuple, weights: tuple) -> list[tuple[int, int | None, int]]:
        out = []
        for d in {len(r) for r in raws}:
            own = [i for i, r in enumerate(raws) if len(r) == d]
            if len(own) < 2:
                continue
            x = unit(np.array([np.frombuffer(raws[i], kind) for i in own], np.float64))
            hit = _across(x @ x.T >= threshold, key, [sides[i] for i in own])
            i, j = np.nonzero(hit)
            # Pairs that met in a table before are counted there.
            before = np.frombuffer(b"".join(keys[k] for k in own), KEY).reshape(len(own), -1)[:, : key[0]]
            new = np.ones(len(i), bool)
            for k in before.T:
                new &= k[i] != k[j]
            i, j = i[new], j[new]
            if not len(i):
                continue
            n = np.bincount(i, weights=np.array([weights[k] for k in own])[j], minlength=len(own)).astype(np.int64)
            out += [(uids[own[k]], None, int(n[k])) for k in np.nonzero(n)[0]]
            up = list(range(len(own)))
            for a, b in zip(i.tolist(), j.tolist()):
                if a < b:
                    while up[a] != a:
                        up[a] = up[up[a]]
                        a = up[a]
                    c = b
                    while up[c] != c:
                        up[c] = up[up[c]]
                        c = up[c]
                    if a != c:
                        up[c] = a
                        out.append((uids[own[a]], uids[own[c]], 0))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for x in _runs(batches, 4):
            if x is not None:
                found += decide(x[0], *x[1])
                continue
            yield pa.record_batch([pa.array([r[k] for r in found], pa.int64()) for k in range(3)], ["a", "b", "n"])
            found = []

    return run


def annotate(vecs: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", carry: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The carried columns (all by default) with n_links, component_id, kept (names get _ if taken)."""
    carry = vecs.columns if carry is None else carry
    given, name = plain(vecs)
    id_, vec = name[id_col], name[vec_col]
    coder = fit(given, vec, threshold)
    kept = list(dict.fromkeys([*(name[c] for c in carry), id_]))
    new = [("uid", T.LongType()), ("same", T.LongType()), ("sig", T.BinaryType()), ("keys", T.BinaryType()), ("code", T.BinaryType()), ("raw", T.BinaryType()), ("n", T.LongType())]
    schema = T.StructType([*(given.schema[c] for c in kept), *(T.StructField(*x) for x in new)])
    kind = np.float32 if isinstance(given.schema[vec].dataType.elementType, T.FloatType) else np.float64
    t1 = stored(given.select(*kept, F.col(vec).alias("vec")).mapInArrow(_index(coder, len(kept), len(kept), to_arrow_schema(schema), kind), schema), "vec-index")

    local = t1.where("sig is not null")
    classes = stored(local.groupBy("sig").agg(F.min("uid").alias("rep"), F.sum("n").alias("w")), "vec-classes")
    reps = stored(local.select("uid", "sig").join(classes, "sig").select("uid", "rep", "w"), "vec-reps")
    coded = stored(local.select("uid", "keys", "code", "raw").join(reps.where("uid = rep").select("uid", "w"), "uid"), "vec-coded")
    tables = F.explode(F.transform(F.sequence(F.lit(0), F.lit(coder.tables - 1)), lambda t: F.struct(t.alias("t"), F.conv(F.hex(F.substring("keys", 4 * t + 1, F.lit(4))), 16, 10).cast("long").alias("k"))))
    keyed = coded.select("uid", "code", tables.alias("x")).select("uid", "code", "x.t", "x.k")
    sizes = stored(keyed.groupBy("t", "k").agg(F.count("*").alias("c")).where("c > 1"), "vec-buckets")
    blocks = F.when(F.col("c") <= 2 * HALF, 1).otherwise(F.ceil(F.col("c") / HALF)).cast("int")
    dealt = keyed.join(sizes, ["t", "k"]).withColumn("nb", blocks).withColumn("s", F.pmod(F.xxhash64("uid"), F.col("nb")).cast("int"))
    dealt = dealt.select("t", "k", "uid", "code", "s", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("y"))
    key = ["t", "k", "i", "j"]
    dealt = dealt.select("t", "k", F.least("s", "y").alias("i"), F.greatest("s", "y").alias("j"), "uid", "code", F.col("s").alias("side")).repartition(*key).sortWithinPartitions(*key)
    close = stored(dealt.mapInArrow(_near_codes(coder.most), "t int, k long, i int, j int, uid long, side int"), "vec-close")
    drop(sizes)
    full = close.join(coded.select("uid", "keys", "raw", "w"), "uid").select(*key, "uid", "side", "keys", "raw", "w").repartition(*key).sortWithinPartitions(*key)
    found = stored(full.mapInArrow(_compare(threshold, kind), "a long, b long, n long"), "vec-links")
    drop(close, coded, classes)

    links = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null"))
    named = reps.join(links, "rep", "left").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    named = named.select("uid", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"))
    low = F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col("uid").alias("uid"))
    lows = t1.where("raw is not null or same <> uid").groupBy(F.col("same").alias("uid")).agg(F.min(low).alias("low"))
    named = stored(named.join(lows, "uid"), "vec-roots")
    least = stored(named.groupBy("root").agg(F.min("low").alias("least"), F.count("*").alias("c")).where("c > 1").select("root", "least"), "vec-least")
    final = stored(named.join(least, "root", "left").select(F.col("uid").alias("of"), F.col("links").alias("links"), F.coalesce("least", "low").alias("low")), "vec-components")
    drop(found, reps, named, least)
    out = t1.join(final, F.col("same") == F.col("of"), "left")
    names = [free_name(carry, x) for x in ("n_links", "component_id", "kept")]
    return out.select(
        *[F.col(name[c]).alias(c) for c in carry],
        F.coalesce("links", F.lit(0)).cast("long").alias(names[0]),
        F.when(F.col("low").isNull(), F.col(id_)).otherwise(F.col("low.id")).alias(names[1]),
        (F.col("low").isNull() | (F.col("low.uid") == F.col("uid"))).alias(names[2]),
    )
