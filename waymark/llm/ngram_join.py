"""N-gram Jaccard join with multiple global orders.

A document's set is its distinct word 5-grams (64-bit hashes). Documents whose sets reach a Jaccard similarity t share,
under ANY global order of the tokens, a token among the first n - ceil(t n) + 1 of each set. Candidates must do so under
each of several orders, and only what passes all is verified on whole sets.

Orders put frequent tokens last (the HEAVY_MOST most frequent found, a bounded table; it steers cost, never results) and
rank the others by a seeded hash, a seed per order.

Pairs are never listed. Linked sets differ in size by 4 : 3 at most, so sets have size classes, and only neighbours meet:
the documents that share a prefix token of order 1 form a star, named by their smallest document (found in
its token's bucket), of which each class is a star of its own, named by its own smallest document,
that those of the class below join. So a long document meets none of the short ones that it holds. Stars are renamed by one hop,
so that a group of near copies is one star and not dozens. A document has a narrow row for each of its stars, so no more rows
than prefix tokens, however many others it shares passages with.

The documents of a star meet three times, all against all, each time fewer with wider rows, in tasks of at most about
2 * HALF documents: a larger star is cut into blocks, and each pair of blocks is a task.

* By numbers alone: how many of a document's prefix tokens of order 1 any other document has. Two documents have no more in common
  than the lesser of the two numbers.
* By two bytes of each prefix token of order 1, and by the numbers under order 2, whose tokens are counted among the documents
  that are left. Two bytes, or four of order 2's tokens, only ever add to what is in common.
* By whole texts, for the documents of pairs that pass; only theirs are sent. A task returns a spanning forest of the links
  found, at most one row per document. Components come from contraction (see graph). Pairs of different blocks wait until
  the blocks' own links, and those among one document of each block, are known; pairs that these connect are passed over.

Prefix tokens are dealt out once, packed by buckets of tokens, in which a task finds those that several documents have. Their
table is kept until the stars are known; order 2's are made anew for the documents left.

Tokens shared beyond the shorter-reaching prefix are at most that set's rest, so a pair with too few prefix tokens in common
can't link.

Equal sets are one class throughout: repeats within a batch are folded where they are read, across batches by their sets'
digest, so copies send a narrow row each.

Defined results: A-Z are lower-cased, words are runs of other than ASCII white space; with fewer than five words the whole
sequence is the one shingle; null, empty and wordless texts have no set, are linked with nothing and always stay. A
component's id is the smallest id in it (nulls are passed over; null if it has no other). Other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waymark.llm.common import drop, free_name, plain, small_batches, stored
from waymark.llm.graph import components

WORDS, PERCENT, ORDERS = 5, 75, (11, 23)
#: Tokens known as frequent, at most, and in how many documents they must have been seen.
HEAVY_MOST, HEAVY_LEAST, BLOCK_TOKENS = 300_000, 6, 4_000_000
HALF = 256
#: Buckets that prefix tokens are dealt out to, a power of 2; words or tokens that are worked on at once, if texts are short.
BUCKETS, AT_ONCE = 1024, 1 << 16
#: Ids that may be broadcast, to keep or leave out their documents where these are read; more are merged.
BROADCAST_IDS = 2_000_000
#: Where prefixes with frequent tokens end: ties, as far as the screen knows.
LATEST = 2**63 - 1

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers for each seed."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed * 0x1F123BB5 + 1)) * _M1
        x = (x ^ (x >> np.uint64(32))) * _M2
        return x ^ (x >> np.uint64(29))


def _windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row, from the words' hashes."""
    with np.errstate(over="ignore"):
        s = mixed(h[: len(h) - k + 1], k)
        for i in range(1, k):
            s = mixed(s * _M2 + h[i : len(h) - k + 1 + i], i)
    return s


def _distinct(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    new = s[1:] != s[:-1]
    return s if new.all() else s[np.concatenate([[True], new])]


def shingles(text: str | bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return next(sets_of([text], words))


def sets_of(texts: list[str | bytes | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """shingles() of each text; words of some texts are hashed at once, as calls cost more than short texts do."""
    held, size = [], 0
    for text in texts:
        held.append(((text.encode() if isinstance(text, str) else text) if text else b"").lower().split())
        size += len(held[-1])
        if size >= AT_ONCE:
            yield from _sets(held, words)
            held, size = [], 0
    yield from _sets(held, words)


def _sets(texts: list[list[bytes]], words: int) -> Iterator[np.ndarray]:
    ends = np.cumsum([0, *map(len, texts)]).tolist()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(texts)), np.uint64, ends[-1])
    # Windows across the ends of texts are passed over.
    s = _windows(h, words) if len(h) >= words else h
    for a, b in zip(ends, ends[1:]):
        if b - a >= words:
            yield _distinct(s[a : b - words + 1])
        else:
            yield _windows(h[a:b], b - a) if b > a else np.empty(0, np.uint64)


class Orders:
    """Global orders: infrequent tokens first, by a seeded hash; then the frequent ones by rank."""

    BITS = 23

    def __init__(self, heavy: np.ndarray, rank: np.ndarray):
        self.heavy, self.rank = heavy, rank
        # A bitmap by low bits tells nearly all tokens that are not frequent.
        self.maybe = np.zeros(1 << self.BITS, bool)
        self.maybe[heavy & np.uint64((1 << self.BITS) - 1)] = True

    def prefixes(self, tokens: np.ndarray, seeds: tuple[int, ...] = ORDERS, percent: int = PERCENT) -> list[tuple[np.ndarray, int]]:
        """For each order the tokens of a set that a partner must share one of, and where they end in the order."""
        return next(self.of_sets([tokens], seeds, percent))

    def of_sets(self, sets: list[np.ndarray], seeds: tuple[int, ...] = ORDERS, percent: int = PERCENT) -> Iterator[list[tuple[np.ndarray, int]]]:
        """prefixes() of each set, some sets at once."""
        ends = np.cumsum([0, *map(len, sets)]).tolist()
        first = 0
        for last in range(1, len(sets) + 1):
            if last == len(sets) or ends[last] - ends[first] >= AT_ONCE:
                yield from self._prefixes(sets[first:last], seeds, percent)
                first = last

    def _prefixes(self, sets: list[np.ndarray], seeds: tuple[int, ...], percent: int) -> Iterator[list[tuple[np.ndarray, int]]]:
        every, ends = np.concatenate(sets), np.cumsum([0, *map(len, sets)]).tolist()
        ranks = np.zeros(len(every), np.int64)
        at = np.nonzero(self.maybe[every & np.uint64((1 << self.BITS) - 1)])[0]
        if len(at):
            k = np.minimum(np.searchsorted(self.heavy, every[at]), len(self.heavy) - 1)
            hit = self.heavy[k] == every[at]
            ranks[at[hit]] = self.rank[k[hit]]
        frequent = np.concatenate([[0], np.cumsum(ranks > 0)])
        keys = [mixed(every, s) for s in seeds]
        for a, b in zip(ends, ends[1:]):
            n = b - a
            size = n - (percent * n + 99) // 100 + 1
            light, last, own = every[a:b], np.empty(0, np.uint64), [key[a:b] for key in keys]
            if frequent[b] > frequent[a]:
                rank = ranks[a:b]
                heavy, rare = np.nonzero(rank)[0], rank == 0
                if n - len(heavy) < size:
                    last = light[heavy][np.argsort(rank[heavy])][: size - (n - len(heavy))]
                light, own = light[rare], [key[rare] for key in own]
            if len(light) <= size:
                yield [(np.concatenate([light, last]), LATEST)] * len(seeds)
                continue
            found = []
            for key in own:
                at = np.argpartition(key, size - 1)[:size]
                found.append((light[at], int(key[at[-1]] >> np.uint64(1))))
            yield found


def _frequent(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and their rank (1 is the least frequent); found by tokens repeated within blocks
    of about BLOCK_TOKENS of a task, whose counts add up."""

    def counts(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate([np.empty(0, np.uint64), *sets])
        sets.clear()
        tokens.sort()
        begin = np.nonzero(np.concatenate([np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1]]))[0]
        n = np.diff(begin, append=len(tokens))
        begin, n = begin[n > 1], n[n > 1]
        return pa.record_batch([pa.array(tokens[begin].view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0
        for b in batches:
            for x in sets_of(list(dict.fromkeys(b.column(0).to_pylist()))):
                sets.append(x)
                held += len(sets[-1])
                if held >= BLOCK_TOKENS:
                    yield counts(sets)
                    sets, held = [], 0
        yield counts(sets)

    seen = docs.select(text_col).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = seen.where(F.col("n") >= HEAVY_LEAST).orderBy(F.desc("n"), "token").limit(HEAVY_MOST).toArrow()
    tokens, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(tokens)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, n))] = np.arange(1, len(tokens) + 1)
    return tokens[order], rank[order]


def packed(tokens: np.ndarray, uids: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Posts (a token, its document) as one value for each bucket of tokens: four bytes of what the bucket leaves of a token and
    the steps from document to document, byte by byte, so that what is zero takes no room when compressed."""
    bucket = (tokens & np.uint64(BUCKETS - 1)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    rest, uids = (tokens[order] >> np.uint64(BUCKETS.bit_length() - 1)).astype("<u4"), uids[order]
    ends = np.searchsorted(bucket[order], np.arange(BUCKETS + 1)).tolist()
    for k, (a, b) in enumerate(zip(ends, ends[1:])):
        if b > a:
            steps = np.diff(uids[a:b], prepend=0).astype("<i8")
            yield k, np.concatenate([rest[a:b].view(np.uint8).reshape(-1, 4).T.ravel(), steps.view(np.uint8).reshape(-1, 8).T.ravel()]).tobytes()


def unpacked(posts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and documents of a value of packed()."""
    found = np.frombuffer(posts, np.uint8).reshape(12, -1)
    return np.ascontiguousarray(found[:4].T).view("<u4").ravel(), np.cumsum(np.ascontiguousarray(found[4:].T).view("<i8").ravel())


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, uid) of each post whose token others have too, hub being the token's smallest document. Rows are in order of buckets."""

    def found(held: list[bytes]) -> pa.RecordBatch:
        tokens, uids = map(np.concatenate, zip(*map(unpacked, held)))
        order = np.argsort(tokens)
        tokens, uids = tokens[order], uids[order]
        begin = np.nonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))[0]
        n = np.diff(begin, append=len(tokens))
        hubs = np.repeat(np.minimum.reduceat(uids, begin), n)
        many = np.repeat(n > 1, n)
        return pa.record_batch([pa.array(hubs[many]), pa.array(uids[many])], ["hub", "uid"])

    key, held = None, []
    for b in batches:
        for k, posts in zip(*(c.to_pylist() for c in b.columns)):
            if k != key and held:
                yield found(held)
                held = []
            key = k
            held.append(posts)
    if held:
        yield found(held)


def _shared(prefixes: DataFrame, *by: str) -> DataFrame:
    """k: how many of a document's prefix tokens others have too, by document (uid) or by the smallest document that has them
    (hub, uid). Posts are dealt out once, packed."""
    posts = prefixes.where("bucket is not null").select("bucket", "posts").repartition("bucket").sortWithinPartitions("bucket")
    return stored(posts.mapInArrow(_met, "hub long, uid long").groupBy(*by).agg(F.count("*").alias("k")), "join-rows")


def _among(table: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of a table whose uid is (how: left_semi) or is not (left_anti) among the ids."""
    return table.join(F.broadcast(ids), "uid", how) if ids.count() <= BROADCAST_IDS else table.hint("merge").join(ids, "uid", how)


def _stars(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(star, z, uid): documents of class z and z - 1 that share a prefix token have a star in common, if one is of class z.
    rows: of _shared(); classes: uid, own."""
    # One hop: a hub that is in stars of smaller hubs gives its star, in all classes, to the smallest of them.
    # Stored, so that the join has plain sides and a hub with many rows can be split.
    first = stored(rows.groupBy(F.col("uid").alias("hub")).agg(F.min("hub").alias("to")), "join-first")
    merged = rows.join(first, "hub", "left").select(F.coalesce(F.least("to", "hub"), "hub").alias("star"), "uid").distinct()
    each = merged.join(classes, "uid").select("star", "uid", "own", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("z"))
    each = stored(each, "join-stars")
    # In a class a star is named anew, by its smallest document of that class: stars that these share are one.
    many = each.groupBy("star", "z").agg(F.count("*").alias("n"), F.min(F.when(F.col("own") == F.col("z"), F.col("uid"))).alias("hub")).where("n > 1 and hub is not null").select("star", "z", "hub")
    many = stored(many, "join-many")
    members = stored(each.join(many, ["star", "z"]).select(F.col("hub").alias("star"), "z", "uid").distinct(), "join-members")
    drop(first, each, many)
    return members


def forest(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets; every pair is decided or already connected."""
    n, size = len(sets), np.array([len(s) for s in sets])
    up = list(range(n))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    edges = []

    def link(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            up[b] = a
            edges.append((i, j))

    if n <= 6:
        for i in range(n):
            for j in range(i):
                low, high = sorted((size[i], size[j]))
                if 100 * low >= percent * high and root(i) != root(j):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (low + high - both):
                        link(i, j)
        return edges
    tokens, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), size)
    keep = count[at] > 1
    owner, at = owner[keep], np.cumsum(count > 1)[at[keep]] - 1
    both, width = np.zeros((n, n), np.float32), 2048
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, (low, low + width))
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], at[a:b] - low] = 1
        both += m @ m.T
    union = size[:, None] + size[None, :] - both
    for i, j in zip(*np.nonzero(np.triu(100 * both.astype(np.float64) >= percent * union, 1))):
        link(int(i), int(j))
    return edges


def _runs(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[list, list[list]] | None]:
    """(key, columns of the rest) of each run of rows with equal first columns; None after each batch."""
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


def common(shorts: list[np.ndarray]) -> np.ndarray:
    """How many short tokens each two documents share; those alike in two bytes count as products, never less than they share."""
    n = len(shorts)
    if n == 2:
        (u, cu), (v, cv) = (np.unique(x, return_counts=True) for x in shorts)
        _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        k = int((cu[i] * cv[j]).sum())
        return np.array([[0, k], [k, 0]], np.float32)
    owner = np.repeat(np.arange(n), [len(x) for x in shorts])
    _, at, count = np.unique(np.concatenate(shorts), return_inverse=True, return_counts=True)
    keep = count[at] > 1
    owner, at = owner[keep], (np.cumsum(count > 1) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    found, width = np.zeros((n, n), np.float32), 2048
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, b = np.searchsorted(at, (low, low + width))
        m = np.zeros((n, width), np.float32)
        np.add.at(m, (owner[a:b], at[a:b] - low), 1)
        found += m @ m.T
    return found


def room(sizes: np.ndarray, rests: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many tokens each two documents may share beyond the prefix that ends earlier."""
    earlier = ends[:, None] < ends[None, :]
    return np.where(earlier, rests[:, None], np.where(earlier.T, rests[None, :], np.maximum(rests[:, None], rests[None, :])))


def enough(both: np.ndarray, sizes: np.ndarray, rests: np.ndarray, ends: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs may link (i < j), if the documents' prefixes have no more than so many tokens in common."""
    need = -(-(percent * (sizes[:, None] + sizes[None, :])) // (100 + percent))
    low, high = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    return np.triu((both + room(sizes, rests, ends) >= need) & (100 * low >= percent * high), 1)


def passing(sizes: np.ndarray, shorts: list[bytes], ends: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that may link, by the sizes of what their prefixes have in common."""
    parts = [np.frombuffer(x, np.uint16) for x in shorts]
    return np.nonzero(enough(common(parts), sizes, sizes - np.array([len(x) for x in parts]), ends, percent))


def counted(sizes: np.ndarray, shared: np.ndarray, ends: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which pairs may link (i < j), by how many tokens of each one's prefix other documents have."""
    return enough(np.minimum(shared[:, None], shared[None, :]), sizes, (percent * sizes + 99) // 100 - 1, ends, percent)


_KEY = [("star", pa.int64()), ("z", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("uid", pa.int64()), ("own", pa.int32()), ("side", pa.int32())]


def _meeting(z: int, i: int, j: int, classes: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which pairs are this task's: of other blocks, if it has two, and one of its class."""
    return (np.maximum(classes[:, None], classes[None, :]) == z) & ((i == j) | (sides[:, None] != sides[None, :]))


def _batch(found: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in found], t) for k, (_, t) in enumerate(_KEY)], [n for n, _ in _KEY])


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars and documents that remain by numbers."""
    found = []
    for run in _runs(batches, 4):
        if run is not None:
            (star, z, i, j), (uids, *rest) = run
            classes, sides, sizes, ends, shared = map(np.array, rest)
            pairs = counted(sizes, shared, ends) & _meeting(z, i, j, classes, sides)
            found += [(star, z, i, j, uids[k], rest[0][k], rest[1][k]) for k in np.nonzero(pairs.any(0) | pairs.any(1))[0].tolist()]
        else:
            yield _batch(found)
            found = []


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars and documents that remain by sketches. A pair is let through in one star only, the least that both documents have,
    and of two blocks only if it is not connected yet."""
    found = []
    for run in _runs(batches, 4):
        if run is not None:
            (star, z, i, j), (uids, classes, sides, sizes, ends, shorts, ends2, shared2, stars, roots) = run
            own, side, n = np.array(classes), np.array(sides), np.array(sizes)
            also = _meeting(z, i, j, own, side) & counted(n, np.array(shared2), np.array(ends2))
            stars, remain = [set(x) for x in stars], set()
            for a, b in zip(*(x.tolist() for x in passing(n, list(shorts), np.array(ends)))):
                if also[a, b] and (i == j or roots[a] != roots[b]) and (a not in remain or b not in remain) and min(stars[a] & stars[b]) == star:
                    remain |= {a, b}
            found += [(star, z, i, j, uids[k], classes[k], sides[k]) for k in sorted(remain)]
        else:
            yield _batch(found)
            found = []


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column, a text, is compressed by itself: what is sent is then in proportion to the texts."""
    press = zstandard.ZstdCompressor()
    for b in batches:
        texts = b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()
        yield pa.record_batch([*b.columns[:-1], pa.array(map(press.compress, texts), pa.binary())], b.schema.names)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links, as a forest for each task."""
    found, press = [], zstandard.ZstdDecompressor()
    for run in _runs(batches, 1):
        if run is not None:
            order = sorted(dict(zip(*run[1])).items())
            found += [(order[i][0], order[j][0]) for i, j in forest(list(sets_of([press.decompress(t) for _, t in order])))]
        else:
            yield pa.record_batch([pa.array([r[k] for r in found], pa.int64()) for k in range(2)], ["a", "b"])
            found = []


def _prefixed(docs: DataFrame, known, both: bool) -> DataFrame:
    """docs (uid, t) with what a document is met by: a row for each document, and rows of packed posts (bucket, posts; bucket is
    null in the documents' rows). Under order 1: uid, n, end. With both orders: uid, short (two bytes of order 1's prefix tokens),
    end2, posts of order 2."""
    schema = "uid long, short binary, end2 long, bucket int, posts binary" if both else "uid long, n long, end long, bucket int, posts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, tokens, uids, held = Orders(*known.value), [], [], 0
        names, types = (["uid", "short", "end2"], [pa.int64(), pa.binary(), pa.int64()]) if both else (["uid", "n", "end"], [pa.int64()] * 3)
        names, types = [*names, "bucket", "posts"], [*types, pa.int32(), pa.binary()]

        def dealt() -> pa.RecordBatch:
            made = list(packed(np.concatenate(tokens), np.concatenate(uids)))
            none = [pa.nulls(len(made), t) for t in types[:3]]
            return pa.record_batch([*none, pa.array([k for k, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], names)

        for b in batches:
            sets = list(sets_of(b.column(1).to_pylist()))
            found = list(orders.of_sets(sets, ORDERS if both else ORDERS[:1]))
            if both:
                cols = [pa.array([x[0][0].astype(np.uint16).tobytes() for x in found], pa.binary()), pa.array([x[1][1] for x in found], pa.int64())]
            else:
                cols = [pa.array(list(map(len, sets)), pa.int64()), pa.array([x[0][1] for x in found], pa.int64())]
            yield pa.record_batch([b.column(0), *cols, *(pa.nulls(b.num_rows, t) for t in types[3:])], names)
            own = [x[-1][0] for x in found]
            tokens += own
            uids.append(np.repeat(b.column(0).to_numpy(), list(map(len, own))))
            held += len(uids[-1])
            if held >= BLOCK_TOKENS:
                yield dealt()
                tokens, uids, held = [], [], 0
        if held:
            yield dealt()

    return docs.mapInArrow(run, schema)


def _verified(screened: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among the documents of a task. Only their texts are sent, not all, and once if the tasks' rows can be broadcast."""
    # Tasks whose numbers clash are one task, which only adds pairs.
    tasks = screened.select("uid", F.xxhash64("star", "z", "i", "j").alias("task"))
    if screened.count() <= BROADCAST_IDS:
        given = texts.join(F.broadcast(tasks), "uid").select("task", "uid", "t").mapInArrow(_squeezed, "task long, uid long, t binary")
    else:
        wanted = _among(texts, screened.select("uid").distinct(), "left_semi").select("uid", "t").mapInArrow(_squeezed, "uid long, t binary")
        given = tasks.join(wanted.hint("merge"), "uid").select("task", "uid", "t")
    given = given.repartition("task").sortWithinPartitions("task")
    return stored(given.mapInArrow(_verify, "a long, b long"), "join-links")


def _linked(narrow: DataFrame, facts: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is linked, from the tasks' documents that remain by numbers. facts: by uid and z; sketches:
    the wide ones, by uid.

    Within blocks first. Of a star with several, the most frequent component of each block sends one document to meet the
    others'; pairs of different blocks follow, but for those that are connected by then. So a large group of near copies
    sends each text about once, not once for each of its blocks, and every pair is verified or already connected."""
    key, names = ["star", "z", "i", "j"], [x for x, _ in _KEY]
    wide = narrow.join(facts, ["uid", "z"])

    def screened(given: DataFrame) -> DataFrame:
        # The sketches are sent last. Merged at every size: what is sent then grows with the input and not by steps.
        given = given.join(_among(sketches, given.select("uid").distinct(), "left_semi").hint("merge"), "uid")
        given = given.select(*names, "n", "end", "short", "end2", "shared2", "stars", "root").repartition(*key).sortWithinPartitions(*key)
        return stored(given.mapInArrow(_screen, given.select(*names).schema), "join-screened")

    remain = screened(wide.where("i = j").withColumn("root", F.col("uid")))
    links = _verified(remain, texts)
    if narrow.where("i <> j").isEmpty():
        drop(remain)
        return links
    roots = components(links)
    with_root = lambda t: t.join(roots.select(F.col("node").alias("uid"), "root"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    many = narrow.where("i <> j").select("star", "z").distinct()
    each = with_root(remain.join(many, ["star", "z"])).groupBy("star", "z", "i", "root").agg(F.min("uid").alias("uid"), F.count("*").alias("c"))
    heads = each.groupBy("star", "z", "i").agg(F.max_by("uid", F.struct("c", "root")).alias("uid"))
    # Blocks as a square of rows and columns, so that any number of them is connected by groups of a bounded size.
    row, column = F.floor(F.col("i") / (2 * HALF)).cast("int"), (-1 - F.col("i") % (2 * HALF)).cast("int")
    heads = heads.select("star", "z", F.explode(F.array(row, column)).alias("i"), "uid")
    heads = stored(heads.select("star", "z", "i", F.col("i").alias("j"), "uid"), "join-heads")
    more = _verified(heads, texts)
    drop(remain, heads)
    both = stored(links.unionAll(more), "join-links")
    drop(links, more)
    roots = components(both)
    remain = screened(with_root(wide.where("i <> j")))
    across = _verified(remain, texts)
    links = stored(both.unionAll(across), "join-links")
    drop(remain, both, across)
    return links


def _joined(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> tuple[DataFrame, dict[str, str], DataFrame]:
    """The documents (carried columns, uid, same, n) stored, their columns' names there, and (of, low): for each uid that
    stands for equal sets of a batch, the row with the smallest id of its component."""
    spark = docs.sparkSession
    small_batches(spark)
    given, name = plain(docs)
    id_, text = name[id_col], name[text_col]
    known = spark.sparkContext.broadcast(_frequent(given, text))
    kept = list(dict.fromkeys([*(name[c] for c in carry), id_, text]))
    schema = T.StructType([*(given.schema[c] for c in kept), *(T.StructField(*x) for x in (("uid", T.LongType()), ("same", T.LongType()), ("n", T.LongType()), ("sig", T.BinaryType())))])
    arrow, at = to_arrow_schema(schema), kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for b in batches:
            first: dict[bytes, int] = {}
            by_text: dict[str | None, tuple[int, bytes]] = {}
            rows = []
            texts = b.column(at).to_pylist()
            for text, s in zip(each := list(dict.fromkeys(texts)), sets_of(each)):
                by_text[text] = len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            for i, text in enumerate(texts):
                size, digest = by_text[text]
                new = size > 0 and digest not in first
                rows.append((base + i, base + first.setdefault(digest, i) if size else base + i, size, digest if new else None))
            yield pa.record_batch([*b.columns, *(pa.array([r[k] for r in rows], arrow.field(len(kept) + k).type) for k in range(4))], schema=arrow)
            base += b.num_rows

    t1 = stored(given.select(*kept).mapInArrow(run, schema), "join-docs")
    # Local representatives of equal sets -> one of the whole table.
    local = t1.where("sig is not null").select("uid", "sig")
    many = local.groupBy("sig").agg(F.min("uid").alias("rep"), F.count("*").alias("c")).where("c > 1").select("sig", "rep")
    many = stored(many, "join-classes")
    reps = stored(local.join(many, "sig").select("uid", "rep"), "join-reps")
    drop(many)
    texts = t1.where("sig is not null").select("uid", F.col(text).alias("t"))
    # Of equal sets one goes on: what only copies share is not shared.
    prefixes = stored(_prefixed(_among(texts, reps.where("uid <> rep").select("uid"), "left_anti"), known, False), "join-prefixes")
    rows = _shared(prefixes, "hub", "uid")
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT * 1.0001)).cast("int").alias("own")
    facts = stored(rows.groupBy("uid").agg(F.sum("k").alias("shared")).join(prefixes.where("bucket is null").select("uid", size_class, "n", "end"), "uid"), "join-facts")
    drop(prefixes)
    stars = _stars(rows, facts.select("uid", "own"))
    drop(rows)
    # In class z are the sets of z and of z - 1; those of z - 1 alone have met in their own class.
    known_by = stars.join(facts, "uid")
    sizes = known_by.groupBy("star", "z").agg(F.count("*").alias("c"), F.max((F.col("own") == F.col("z")).cast("int")).alias("has")).where("c > 1 and has = 1").drop("has")
    sizes = stored(sizes, "join-keys")
    blocks = F.when(F.col("c") <= 2 * HALF, 1).otherwise(F.ceil(F.col("c") / HALF)).cast("int")
    block = F.pmod(F.xxhash64("uid"), F.col("nb")).cast("int")
    dealt = known_by.join(sizes, ["star", "z"]).withColumn("nb", blocks).withColumn("side", block).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.withColumn("i", F.least("side", "y")).withColumn("j", F.greatest("side", "y"))
    key = ["star", "z", "i", "j"]
    names = [x for x, _ in _KEY]
    given = dealt.select(*names, "n", "end", "shared").repartition(*key).sortWithinPartitions(*key)
    narrow = stored(given.mapInArrow(_narrow, given.select(*names).schema), "join-narrow")
    drop(sizes, stars)
    left = stored(narrow.groupBy("uid", "z").agg(F.collect_set("star").alias("stars")), "join-left")
    second = stored(_prefixed(_among(texts, left.select("uid").distinct(), "left_semi"), known, True), "join-sketches")
    rows = _shared(second, "uid")
    numbers = left.join(rows.withColumnRenamed("k", "shared2"), "uid").join(facts.select("uid", "n", "end"), "uid")
    links = _linked(narrow, numbers, second.where("bucket is null").select("uid", "short", "end2"), texts)
    drop(facts, narrow, left, rows, second)
    roots = components(links)
    named = t1.where("n > 0").groupBy(F.col("same").alias("uid")).agg(F.min(F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col("uid").alias("uid"))).alias("low"))
    named = named.join(reps, "uid", "left").withColumn("rep", F.coalesce("rep", "uid"))
    named = named.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("uid", "low", F.coalesce("root", "rep").alias("root"))
    named = stored(named, "join-roots")
    lows = stored(named.groupBy("root").agg(F.min("low").alias("least"), F.count("*").alias("c")).where("c > 1").select("root", "least"), "join-lows")
    final = stored(named.join(lows, "root", "left").select(F.col("uid").alias("of"), F.coalesce("least", "low").alias("low")), "join-components")
    drop(lows, named, links, reps)
    return t1, name, final


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all by default) with n_shingles, component_id, representative (names get _ if taken).

    representative marks one row of each component, that with the smallest id (of repeated ids the first row)."""
    carry = docs.columns if carry is None else carry
    t1, name, final = _joined(docs, id_col, text_col, carry)
    out = t1.join(final, F.col("same") == F.col("of"), "left")
    names = [free_name(carry, x) for x in ("n_shingles", "component_id", "representative")]
    return out.select(
        *[F.col(name[c]).alias(c) for c in carry],
        F.col("n").alias(names[0]),
        F.when(F.col("low").isNull(), F.col(name[id_col])).otherwise(F.col("low.id")).alias(names[1]),
        (F.col("low").isNull() | (F.col("low.uid") == t1["uid"])).alias(names[2]),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of linked ones; the columns stay as they are."""
    t1, name, final = _joined(docs, id_col, text_col, docs.columns)
    # The ids of those that go are found without the texts, which are not sent again.
    gone = t1.select("uid", "same").join(final, F.col("same") == F.col("of")).where("low.uid <> uid").select("uid")
    gone = stored(gone, "join-gone")
    drop(final)
    return _among(t1, gone, "left_anti").select(*[F.col(name[c]).alias(c) for c in docs.columns])
