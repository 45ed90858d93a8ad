"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats, empty tables and
clashing column names."""

import base64
import collections
import gzip
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import bpe, common, embedding_dedup, exact_dedup, graph, html_text, langid, mixing, ngram_join, queries, sharding, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, short, null, empty, long texts, null ids and repeated rows; columns with names that operators use."""
    rng = random.Random(seed)
    rows = []

    def add(i, text):
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), None, "mine", 7))

    base = [words(rng, rng.randrange(30, 120)) for _ in range(12)]
    for k, t in enumerate(base):
        add(k, t)
        add(100 + k, t.upper() if k % 2 else t)
        for j in range(4):
            w = t.split()
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
            add(200 + 10 * k + j, " ".join(w))
    for k in range(30):
        add(400 + k, base[0])
    for i, t in ((500, None), (501, ""), (502, "  \t\n"), (503, "one"), (504, "ONE"), (505, "a b c d"), (506, "a b c d e"), (507, words(rng, 30_000)), (508, "É é"), (None, base[1]), (None, None), (3, base[3]), (509, "x" * 150_000)):
        add(i, t)
    rows.append(rows[5])
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- exact copies


def test_exact_dedup(docs, none):
    got = exact_dedup.annotate(docs).collect()
    groups = collections.defaultdict(list)
    for r in docs.collect():
        groups[low(r.text)].append(r.doc_id)
    assert len(got) == docs.count()
    for r in got:
        g = groups[low(r.text)]
        assert r.kept == "mine"  # theirs stays, ours gets another name
        assert r.group_size == len(g)
        assert r.keep_id == max((i for i in g if i is not None), default=None)
        assert r.text_sha256 == hashlib.sha256(low(r.text).encode()).hexdigest()
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.annotate(none).count() == 0 and exact_dedup.exact_dedup(none).columns == none.columns


def test_radix_groups():
    rng = random.Random(2)
    texts = [b"".join(rng.choice([b"ab", b"abc", b"", b"a" * 700]) for _ in range(rng.randrange(5))) for _ in range(300)]
    first = {}
    assert exact_dedup.radix_groups(texts, 2) == [first.setdefault(t, i) for i, t in enumerate(texts)]
    assert exact_dedup.radix_groups([]) == []


# ---------------------------------------------------------------- near copies


def brute_components(rows):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(r.text))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for k in range(len(rows)):
        ids[root(k)].append(rows[k].doc_id)
    return sets, [min((i for i in ids[root(k)] if i is not None), default=None) if sets[k] else rows[k].doc_id for k in range(len(rows))]


@pytest.mark.parametrize("half", [256, 3])
def test_ngram_join(docs, none, half, monkeypatch):
    monkeypatch.setattr(ngram_join, "HALF", half)  # 3: all keys are cut into blocks
    rows = docs.collect()
    sets, want = brute_components(rows)
    got = ngram_join.annotate(docs, carry=["doc_id", "text"]).collect()
    key = lambda i, t, n, c: (i is None, i or 0, t or "", n, c is None, c or 0)
    assert sorted(key(r.doc_id, r.text, r.n_shingles, r.component_id) for r in got) == sorted(key(r.doc_id, r.text, len(s), c) for r, s, c in zip(rows, sets, want))
    kept = ngram_join.dedup(docs)
    assert kept.columns == docs.columns
    wordless = sum(not s for s in sets)
    assert kept.count() == len({c for c, s in zip(want, sets) if s}) + wordless
    assert ngram_join.annotate(none).count() == 0


def test_documents_made_of_the_same_parts(spark):
    """Three documents of 120 others: in no star of theirs, as sizes differ, and linked among themselves."""
    rng = random.Random(6)
    parts = [words(rng, 60, 5000) for _ in range(120)]
    rows = [(k, t, 1, 2) for k, t in enumerate(parts)] + [(1000 + k, " ".join(parts[k:] + parts[:k]), 1, 2) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid int, `z.z` int").repartition(3)
    own = df.select("doc_id", "text").withColumn("s", F.lit(0))
    got = ngram_join.annotate(df).collect()
    assert {r.doc_id: r.component_id for r in got} == {**{k: k for k in range(120)}, 1000: 1000, 1001: 1000, 1002: 1000}
    assert own.count() == len(got) and got[0].uid == 1 and got[0]["z.z"] == 2


def rows_of_joins(spark, since=-1):
    """(id of the last execution, rows made by each join of those after since)."""
    store, number = spark._jsparkSession.sharedState().statusStore(), lambda x: int(x.replace(",", ""))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found, last = [], since
    executions = store.executionsList()
    for k in range(executions.size()):
        e = executions.apply(k).executionId()
        last = max(last, e)
        if e > since:
            values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
            for n in (nodes.apply(i) for i in range(nodes.size())):
                for m in (n.metrics().apply(i) for i in range(n.metrics().size())):
                    if "Join" in n.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        found.append(number(values.apply(m.accumulatorId())))
    return last, found


def test_rows_grow_with_the_parts_of_a_document(spark):
    """Four documents share a passage with each of 50 others of their size: rows by their number, not by its square."""
    rng = random.Random(8)
    others = [[str(rng.randrange(10**9)) for _ in range(600)] for _ in range(50)]
    rows = [(k, " ".join(x)) for k, x in enumerate(others)] + [(100 + k, " ".join(w for x in others for w in x[12 * k : 12 * k + 12])) for k in range(4)]
    since, _ = rows_of_joins(spark)
    got = ngram_join.annotate(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert all(r.component_id == r.doc_id for r in got) and len(got) == 54
    _, made = rows_of_joins(spark, since)
    assert made and max(made) < 3000


def test_texts_of_a_large_group_are_sent_about_once(spark, monkeypatch):
    """160 near copies in 20 blocks, 40 other texts of one passage, which link with none: not a text for each pair of blocks."""
    monkeypatch.setattr(ngram_join, "HALF", 8)
    sent, kept = [], ngram_join.stored

    def stored(df, label):
        out = kept(df, label)
        if label in ("join-screened", "join-heads"):
            sent.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "stored", stored)
    rng = random.Random(9)
    base = [str(rng.randrange(10**9)) for _ in range(300)]
    rows = [(k, " ".join([*base[: k + 60], f"x{k}", *base[k + 60 :]])) for k in range(160)]
    rows += [(1000 + k, " ".join([*base[:100], *(str(rng.randrange(10**9)) for _ in range(200))])) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.annotate(df).collect()}
    assert got == {k: 0 if k < 160 else k for k, _ in rows}
    assert sum(sent) < 500
    assert ngram_join.dedup(df).count() == 41


def sent_by_stages(spark):
    """Bytes that the application's stages shuffled so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    java = spark._jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(java(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), java())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_prefix_tokens_are_sent_once(spark):
    """Texts that share nothing: their prefix tokens are nearly all that is sent, in some five bytes each."""
    rng = random.Random(12)
    rows = [(k, " ".join(str(rng.randrange(10**9)) for _ in range(1004))) for k in range(300)]
    df, before = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), sent_by_stages(spark)
    assert {(r.doc_id, r.component_id) for r in ngram_join.annotate(df, carry=["doc_id"]).collect()} == {(k, k) for k, _ in rows}
    assert sent_by_stages(spark) - before < 12 * 300 * 251


def test_packed_posts(monkeypatch):
    """Hubs of packed posts against all posts, also with tokens and documents at the ends of their ranges."""
    monkeypatch.setattr(ngram_join, "BUCKETS", 16)
    rng = np.random.default_rng(13)
    tokens = np.concatenate([rng.integers(0, 60, 400), [2**35, 2**35, 2**35 - 1]]).astype(np.uint64)
    uids = np.concatenate([np.sort(rng.integers(0, 2**50, 400)), [5, 2**62, 0]])
    parts = [list(ngram_join.packed(tokens[a:b], uids[a:b])) for a, b in ((0, 150), (150, 403))]
    assert all(x.tolist() == sorted(x.tolist()) for p in parts[:1] for _, v in p for x in [ngram_join.unpacked(v)[1]])
    rows = sorted((x for p in parts for x in p), key=lambda x: x[0])
    made = ngram_join._met(iter([pa.record_batch([pa.array([k for k, _ in rows[a:b]], pa.int32()), pa.array([v for _, v in rows[a:b]], pa.binary())], ["bucket", "posts"]) for a, b in ((0, 7), (7, len(rows)))]))
    by = collections.defaultdict(list)
    for t, u in zip(tokens.tolist(), uids.tolist()):
        by[t].append(u)
    want = collections.Counter((min(us), u) for us in by.values() if len(us) > 1 for u in us)
    assert want == collections.Counter(x for b in made for x in zip(*(c.to_pylist() for c in b.columns)))


def test_sets_of_texts_together(monkeypatch):
    """Sets and prefixes made together are those made one by one, also of texts without five words."""
    texts = ["a b c d e f a b c d e f", None, "", " \n", "x", "B C D", "a b c d e", "é è " * 40, "p q r s t u v w " * 9]
    alone = [ngram_join.shingles(t) for t in texts]
    base = np.unique(np.concatenate(alone))[::2]
    orders = ngram_join.Orders(base, np.arange(1, len(base) + 1))
    for most in (1, 9, 1 << 16):
        monkeypatch.setattr(ngram_join, "AT_ONCE", most)
        assert all(np.array_equal(x, y) for x, y in zip(ngram_join.sets_of(texts), alone, strict=True))
        filled = [x for x in alone if len(x)]
        for own, made in zip(filled, orders.of_sets(filled), strict=True):
            assert all(np.array_equal(x, y) and a == b for (x, a), (y, b) in zip(made, orders.prefixes(own), strict=True))
    assert [len(x) for x in alone] == [8 - 2, 0, 0, 0, 1, 1, 1, 2, 8]


def test_many_documents_to_verify(spark, monkeypatch):
    """More rows of tasks than are broadcast: the same links."""
    rng = random.Random(14)
    base = [str(rng.randrange(10**9)) for _ in range(300)]
    rows = [(k, " ".join([*base[: 5 * k + 9], f"x{k}", *base[5 * k + 9 :]])) for k in range(30)] + [(50 + k, " ".join(str(rng.randrange(10**9)) for _ in range(60))) for k in range(9)]
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    got = {r.doc_id: r.component_id for r in ngram_join.annotate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {k: 0 if k < 30 else k for k, _ in rows}


def test_screen_by_numbers():
    """No link is lost by the numbers of shared prefix tokens, and documents with a few tokens in common don't pass."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    fresh = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(290, 400)], fresh(rng.integers(0, 60))])) for _ in range(30)]
    sets += [np.unique(np.concatenate([base[8 * k : 8 * k + 8], fresh(380)])) for k in range(8)]
    links = {(i, j) for i in range(38) for j in range(i + 1, 38) if 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - b)}
    prefixes = [ngram_join.Orders(np.sort(base[:5]), np.arange(1, 6)).prefixes(s)[0] for s in sets]
    n = dict(zip(*(x.tolist() for x in np.unique(np.concatenate([p for p, _ in prefixes]), return_counts=True))))
    shared = np.array([sum(n[int(t)] > 1 for t in p) for p, _ in prefixes])
    pairs = ngram_join.counted(np.array([len(s) for s in sets]), shared, np.array([e for _, e in prefixes]))
    assert links and links <= set(zip(*(x.tolist() for x in np.nonzero(pairs)))) and not pairs[30:, 30:].any()


def test_clashing_names(docs):
    """Names that the operators use inside, names with dots and with other case pass through."""
    odd = ["uid", "same", "sig", "star", "hub", "rep", "key", "cdf", "u", "n", "of", "low", "best", "t", "g", "x.y", "TEXT_", "bucket", "h", "place", "k"]
    df = docs.limit(60).select("doc_id", "text", "source", *[F.lit(k).alias(c) for k, c in enumerate(odd)])
    want = [tuple(range(len(odd)))] * 1
    for made in (exact_dedup.exact_dedup(df), ngram_join.dedup(df), mixing.mix(df), sharding.shuffle_shards(df, 3, bucket_bytes=500), toxicity.score(df, toxicity.Model()), langid.identify(df, {}), bpe.round_trip(df, queries.tokenizer_file()), html_text.extract(df, html_col="text")):
        got = made.collect()
        at = [made.columns.index(c) for c in odd]
        assert got and {tuple(r[k] for k in at) for r in got} == set(want)


def test_forest_and_screen():
    rng = np.random.default_rng(3)
    for n in (2, 5, 9, 40):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(35, 60)], rng.integers(0, 2**63, rng.integers(0, 12)).astype(np.uint64)])) for _ in range(n)]
        links = {(i, j) for i in range(n) for j in range(i + 1, n) if 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - b)}
        up = list(range(n))
        for a, b in ngram_join.forest(sets):
            assert (min(a, b), max(a, b)) in links
            up = [up[a] if x == up[b] else x for x in up]
        assert all(up[i] == up[j] for i, j in links)
        orders = ngram_join.Orders(np.sort(base[:10]), np.arange(1, 11))
        parts = [orders.prefixes(s)[0] for s in sets]
        i, j = ngram_join.passing(np.array([len(s) for s in sets]), [p.astype(np.uint16).tobytes() for p, _ in parts], np.array([e for _, e in parts]))
        assert links <= set(zip(i.tolist(), j.tolist()))
        for a, b in links:  # what candidates rest on: a shared token under each order
            assert all(len(np.intersect1d(x[0], y[0])) for x, y in zip(orders.prefixes(sets[a]), orders.prefixes(sets[b])))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + k, 1001 + k) for k in range(40)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[root(a)] = root(b)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert all((got[x] == got[y]) == (root(x) == root(y)) for x in got for y in got)
    assert graph.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


# ---------------------------------------------------------------- embeddings


def test_embedding_dedup(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 48))
    rows = [(k, (centres[k % 12] + rng.standard_normal(48) * (0.02 if k % 3 else 0.9)).tolist(), k % 5) for k in range(420)]
    rows += [(1000 + k, rows[0][1], 1) for k in range(25)] + [(None, rows[0][1], 1)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 48, 1), (2003, [float("nan")] * 48, 1), (2004, [1.0] * 47 + [None], 1), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [float("inf")] * 48, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept int").repartition(4)
    got = embedding_dedup.annotate(df, carry=["vec_id", "kept"]).collect()
    unit = [np.array(v) / np.linalg.norm(v) if v and all(x is not None and math.isfinite(x) for x in v) and any(v) else None for _, v, _ in rows]
    links = [[j for j, y in enumerate(unit) if j != i and y is not None and len(x) == len(y) and x @ y >= 0.9] if x is not None else [] for i, x in enumerate(unit)]
    total, found = sum(map(len, links)), sum(r.n_links for r in got)
    assert len(got) == len(rows) and 0.9 * total <= found <= total
    by = {r.vec_id: r for r in got if r.vec_id is not None}
    for (i, _, _), own in zip(rows, links):
        if i is not None:
            assert by[i].n_links <= len(own)
            if not own:
                assert by[i].component_id == i and by[i].kept_
    assert by[2005].n_links == 1 and by[2006].component_id == 2005 and not by[2006].kept_
    assert embedding_dedup.annotate(df.limit(0)).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "HALF", 8)
    rng = np.random.default_rng(8)
    rows = [(k, (np.ones(32) + 0.1 * rng.standard_normal(32)).tolist()) for k in range(90)]
    got = embedding_dedup.annotate(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    # One tight group around the very centre: its pairs part as random ones do, and are met by the number of tables alone.
    assert np.mean([r.n_links for r in got]) >= 0.95 * 89 and max(r.n_links for r in got) <= 89 and {r.component_id for r in got} == {0}


def brute_vectors(rows):
    """(n_links, component id) of (id, vector) by all pairs."""
    whole = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [embedding_dedup.unit(np.array(v, float)) if w else None for (_, v), w in zip(rows, whole)]
    n, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if whole[i] and whole[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9:
                n[i] += 1
                n[j] += 1
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    ids = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        ids[root(k)].append(i)
    return n, [min((i for i in ids[root(k)] if i is not None), default=None) for k in range(len(rows))]


@pytest.mark.parametrize("half", [512, 8])
def test_components_of_vectors(spark, half, monkeypatch):
    """All of the result against all pairs: distinct groups well within the threshold, so that none is missed."""
    monkeypatch.setattr(embedding_dedup, "HALF", half)
    rng = np.random.default_rng(17)
    centres = rng.standard_normal((30, 40)) + 0.5
    rows = [(k, (centres[k % 30] + 0.08 * rng.standard_normal(40)).tolist()) for k in range(240)]
    rows += [(300 + k, [x * 10.0 ** (150 * (1 - 2 * (k % 2))) for x in rows[k][1]]) for k in range(6)] + [(400, [1e200, 1e200]), (401, [1e-170, 1e-170]), (402, [1e-170, -1e-170]), (403, [0.0, 0.0]), (404, [math.inf, 1.0]), (405, None), (None, rows[3][1]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, uid int, `a.b` int, Same int").repartition(3)
    links, component = brute_vectors(rows)
    got = embedding_dedup.annotate(df).collect()
    want = sorted((i is None, i or 0, n, c) for (i, _), n, c in zip(rows, links, component))
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id) for r in got) == want
    assert got[0].uid == 1 and got[0]["a.b"] == 2 and got[0].Same == 3
    assert sum(r.kept for r in got) == len({c for c in component})


def test_recall_on_tables(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = df.collect()
    x = np.array([r.embedding for r in rows], float)
    x = np.vstack([x, x[:200] + 0.02 * np.random.default_rng(1).standard_normal((200, x.shape[1]))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.9).sum() - len(x)
    got = embedding_dedup.annotate(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).agg(F.sum("n_links")).first()[0]
    assert 0.9 * want <= got <= want and want > 0


@pytest.mark.parametrize("n", [10_000, 50_000, 1 << 20, 1 << 26])
@pytest.mark.parametrize("d,lean", [(24, 0), (64, 0), (64, 1), (200, 0)])
def test_recall_does_not_fall_with_size(n, d, lean):
    """Pairs at the threshold, with the plan of n vectors, also of vectors that lean to one side: they meet, and within the
    Hamming distance."""
    rng = np.random.default_rng([n, d])
    sample = lambda k: embedding_dedup.unit(rng.standard_normal((k, d)) + lean)
    coder = embedding_dedup.plan(n, sample(4000))
    x = sample(3000)
    y = embedding_dedup.partners(x, 0.9, 99)
    assert np.allclose((x * y).sum(1), 0.9)
    meet = (coder.keys(x) == coder.keys(y)).any(1)
    near = np.unpackbits(coder.codes(x) ^ coder.codes(y), axis=1).sum(1) <= coder.most
    assert (meet & near).mean() >= 0.95
    assert abs(coder.signs(x).mean() - 0.5) < 0.02


@pytest.mark.parametrize("spread", [2.5, 4.0])
def test_vectors_that_lean_to_one_side(spread):
    """Common mean 3 in every component: codes are balanced, few pairs are compared, and near ones are found."""
    rng = np.random.default_rng(5)
    base = 3 + spread * rng.standard_normal((20_000, 64))
    coder = embedding_dedup.plan(len(base), embedding_dedup.unit(base[:5000]))
    keys = coder.keys(embedding_dedup.unit(base))
    pairs = sum(int((c * (c - 1) // 2).sum()) for c in (np.unique(k, return_counts=True)[1].astype(np.int64) for k in keys.T))
    assert pairs < 0.05 * len(base) ** 2 / 2
    freq = coder.signs(embedding_dedup.unit(base)).mean(0)
    assert 0.3 < freq.min() and freq.max() < 0.7
    x = embedding_dedup.unit(base[:2000])
    y = embedding_dedup.partners(x, 0.9, 7)
    assert (coder.keys(x) == coder.keys(y)).any(1).mean() >= 0.9


# ---------------------------------------------------------------- mixing and sharding


def test_mixing(spark, docs, none):
    mixed = mixing.mix(docs).collect()
    assert mixing.mix(none).count() == 0
    per, rate, copies = collections.Counter(), {}, collections.defaultdict(set)
    for r in docs.collect():
        per[r.source] += len((r.text or "").encode()) + 1
    total, norm = sum(per.values()), sum(v**0.5 for v in per.values())
    rate = {s: min(total * v**0.5 / norm / v, mixing.MOST_RATE) for s, v in per.items()}

    def drawn(key, lam):
        u, k, p = int(hashlib.md5(f"17:{key}".encode()).hexdigest()[:13], 16) / 2**52, 0, math.exp(-lam)
        c = p
        while c <= u:
            k += 1
            p *= lam / k
            c += p
        return k

    want = collections.Counter()
    for r in docs.collect():
        key = str(r.doc_id) if r.doc_id is not None else hashlib.md5((r.text or "").encode()).hexdigest()
        want[r.doc_id, r.text, r.source] += drawn(key, rate[r.source])
    assert +want == collections.Counter((r.doc_id, r.text, r.source) for r in mixed)
    for r in mixed:
        assert r.rate == pytest.approx(rate[r.source]) and 1 <= r.copy <= r.n_copies
        copies[r.doc_id].add(r.copy)
    only = spark.createDataFrame([("b", 1.0)], "source string, weight double")
    assert {r.source for r in mixing.mix(docs, only).collect()} <= {"b"}


def test_high_rates_reach_their_target(spark):
    """A source that is wanted some 15,000 times over, by weights and by a large corpus; the others as without it."""
    rows = [(k, "a", "x" * 9_999) for k in range(30)] + [(100, "b", "y" * 9), (None, "b", "z" * 3), (102, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    per = {"a": 300_000, "b": 15}
    got = mixing.mix(df, spark.createDataFrame([("a", 0.25), ("b", 0.75)], "source string, weight double"))
    rate = {"a": 0.25 * 300_015 / per["a"], "b": 0.75 * 300_015 / per["b"]}
    n = {r.doc_id: r for r in got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("top"), F.countDistinct("copy").alias("all"), F.max("n_copies").alias("said"), F.max("rate").alias("rate")).collect()}
    for i in (100, 102, None):
        r = n[i]
        assert abs(r.n - rate["b"]) < 6 * rate["b"] ** 0.5 and r.n == r.top == r.all == r.said and r.rate == pytest.approx(rate["b"])
    assert len({n[i].n for i in (100, 102, None)}) > 1
    small = mixing.mix(df, epochs=0.01).groupBy("source").agg(F.count("*").alias("n")).collect()
    assert {r.source for r in small} <= {"a", "b"}
    low = collections.Counter(r.doc_id for r in got.where("source = 'a'").collect())
    alone = mixing.mix(df.where("source = 'a'"), epochs=rate["a"]).collect()
    assert low == collections.Counter(r.doc_id for r in alone)


def test_sums_of_draws_are_poisson(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_RATE", 0.7)
    monkeypatch.setattr(mixing, "BLOCK", 2)
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text"))
    got = collections.Counter(r.doc_id for r in mixing.mix(df, epochs=4.0).select("doc_id").collect())
    n = np.array([got[k] for k in range(4000)])
    assert abs(n.mean() - 4) < 0.15 and abs(n.var() - 4) < 0.5 and abs((n == 0).mean() - math.exp(-4)) < 0.01


def test_salted_mixing_is_the_same(docs, monkeypatch):
    one = sorted((r.mix_key, r.n_copies) for r in mixing.mix(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert one == sorted((r.mix_key, r.n_copies) for r in mixing.mix(docs).collect())


@pytest.mark.parametrize("shards,bucket", [(16, 4 << 20), (16, 5_000), (7, 2_000), (1, 10)])
def test_sharding(docs, none, shards, bucket):
    out = sharding.shuffle_shards(docs, shards, bucket_bytes=bucket)
    rows = out.collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r.doc_id, r.text) for r in docs.collect())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.size_ == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    again = [(r.doc_id, r.shard, r.slot) for r in sharding.shuffle_shards(docs, shards, bucket_bytes=bucket).collect()]
    assert sorted(again, key=str) == sorted(((r.doc_id, r.shard, r.slot) for r in rows), key=str)
    assert sharding.shuffle_shards(none, shards).count() == 0


def test_shards_are_shuffled(spark):
    rows = sharding.shuffle_shards(spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")), 4, bucket_bytes=500).collect()
    place = np.array([r.shard * 1000 + r.slot for r in sorted(rows, key=lambda r: r.doc_id)])
    assert abs(np.corrcoef(place, np.arange(4000))[0, 1]) < 0.06
    neighbours = np.abs(np.diff(place)) == 1
    assert neighbours.mean() < 0.01


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_file())


HARD = [
    "", " ", "a" * 3000, "   " * 900, "x<|endoftext|>y" * 100, "héllo wörld " * 60, "日本語の文章です" * 120, "don't" * 300, "''''" * 300 + "s", "   " * 300 + "x", "Ã" * 700, "-" * 1500, "1234567890" * 150, "😀" * 400, "\n\n \t" * 300,
    "<|endoftext" * 50, "".join(chr(c) for c in range(1, 0x2FFF) if not 0xD800 <= c < 0xE000),
]


@pytest.mark.parametrize("chunk", [30, 150, 1000, bpe.CHUNK])
def test_transducer_equals_library(library, chunk):
    rng = random.Random(chunk)
    t = bpe.Transducer(queries.tokenizer_file(), chunk)
    texts = [*HARD, *("".join(rng.choice("ab 'sé\n!?<|>日😀\t0") for _ in range(2500)) for _ in range(4)), words(rng, 3000), "x" * 70_000, " " * 70_000 + "y", ("ab" * 20_000) + "<|endoftext|>" + "  " * 9000 + "<|endoftext"]
    for x in texts:
        want = library.encode(x, add_special_tokens=False).ids
        parts = [x[k : k + 37] for k in range(0, len(x), 37)]
        for fed in ([x], parts):
            assert [i for p in t.encode(fed) for i in p.tolist()] == want
        assert "".join(t.decode([[i] for i in want])) == library.decode(want, skip_special_tokens=False)
    for _ in range(20):  # ids whose bytes are no text
        ids = [rng.randrange(50257) for _ in range(60)]
        assert "".join(t.decode([ids[k : k + 7] for k in range(0, 60, 7)])) == library.decode(ids, skip_special_tokens=False)


def test_every_character_is_of_the_librarys_kind(library):
    t = bpe.Transducer(queries.tokenizer_file())
    for low in range(0, 0x110000, 1 << 11):
        chars = [chr(c) for c in range(low, low + (1 << 11)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}1{c}!{c}  " for c in chars)
        assert [i for p in t.encode([text]) for i in p.tolist()] == library.encode(text, add_special_tokens=False).ids


def test_memory_is_a_chunk():
    """Also within one piece that goes on and on: what is emitted at once, and what is held, don't grow."""
    t = bpe.Transducer(queries.tokenizer_file(), 400)
    rng = random.Random(1)
    stream, most, held = bpe.Stream(t), 0, 0
    for k in range(600):
        most = max(most, len(stream.feed("".join(rng.choice("abcde") for _ in range(400)) if k < 300 else "word " * 80)) // 4)
        held = max(held, len(stream.held) + (len(stream.long.data) if stream.long else 0))
    assert 0 < most <= 1000 and held <= 1200


def test_a_piece_is_the_same_by_merges_and_by_prefixes():
    merges = bpe.Transducer(queries.tokenizer_file()).merges
    rng = random.Random(2)
    for k in range(400):
        raw = "".join(rng.choice(["a", "the", "ing", "é", "aa", " ", "日", "qz"]) for _ in range(rng.randrange(1, 12))).encode()
        piece = bpe.Piece(merges)
        piece.STEP = 1 + k % 5
        assert piece.feed(raw) + piece.end() == merges.whole(raw)


def test_encoding_tables(docs, none, library):
    path = queries.tokenizer_file()
    given = docs.withColumn("ids", F.lit("mine")).withColumn("n_tokens", F.lit(1)).withColumn("a.b", F.lit(2))
    encoded = bpe.decode(bpe.encode(docs, path, chunk=500), path).collect()
    for r in encoded:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    for r in bpe.encode_checked(given, path).collect():
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and r.ids == "mine" and r["a.b"] == 2 and len(r.ids_) == len(library.encode(r.text or "", add_special_tokens=False).ids)
    for r in bpe.round_trip(given, path, chunk=500).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens_, r.ids_sha256) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(none, path).count() == 0 and bpe.encode(none, path).count() == 0


# ---------------------------------------------------------------- archives


PAGES = [
    (1, "http://www.b.example.org/x?a=1", "<p>one</p>"), (2, "https://a.example.org:443/", "<p>one</p>"), (3, "http://a.example.org/ü ", None), (4, None, ""), (5, "http://[bad", "<p>two</p>"),
    (6, "http://a.example.org/", "ß" * 5000), (None, "http://c.org/", "<p>null id</p>"), (-7, "http://a.example.org/", "<p>one</p>"), (8, "http://a.example.org/", "<p>one</p>"), (8, "http://a.example.org/", "<p>one</p>"),
]


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)
    folder = str(tmp_path / "w")
    shards = warc.write_index(warc.write_archives(pages, folder), folder)
    got = warc.lookup(pages, folder, shards).collect()
    top = {}
    for i, _, h in PAGES:
        if i is not None:
            top[h or ""] = max(i, top.get(h or "", i))
    html = {i: h or "" for i, _, h in PAGES}
    assert len(got) == len(PAGES)
    for r in got:
        data = html[r.page_id].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        first = r.page_id is None or top[html[r.page_id]] == r.page_id
        assert r.record_type == ("response" if first else "revisit")
        assert r.refers_to == (None if first else top[html[r.page_id]])
        assert r.payload == (data if first else b"")
    reader = warc.Reader(folder, shards)
    assert len(list(reader.captures(warc.url_key("http://a.example.org/") + " "))) == 5
    assert list(reader.captures("zzz")) == []
    files = list((tmp_path / "w" / "archives").iterdir())
    assert not any(f.name.startswith(".") and "warc" in f.suffixes for f in files if f.suffix != ".crc")
    text = b"".join(gzip.decompress(f.read_bytes()) for f in files if f.suffix == ".gz")
    assert text.count(b"WARC/1.1\r\n") == len(PAGES) and text.count(b"WARC-Type: revisit") == sum(r.record_type == "revisit" for r in got)
    empty = str(tmp_path / "e")
    assert warc.lookup(pages.limit(0), empty, warc.write_index(warc.write_archives(pages.limit(0), empty), empty)).count() == 0


def test_url_keys():
    assert warc.url_key("http://WWW.b.Example.org:80/P?q=1") == "org,example,b)/P?q=1"
    assert warc.url_key("http://a.b.org:8080") == "org,b,a:8080)/"


# ---------------------------------------------------------------- toxicity


def test_grammar():
    s = toxicity.Scorer(toxicity.Model())
    score = s.score
    assert score(None) == score("") == score("a calm day, nothing else") < 0.2
    assert score("you are an idiot") > score("he is not an idiot") >= score("")
    assert score("you are an idiot") > score("she said the idiot left")
    assert score("i will kill you") > 0.2 > score("the bugs were hard to kill")
    assert s.features("You, calm. IDIOT!").sum() > 0
    assert score("idiot " * 50_000) <= 1.0


def test_learned_words_and_stems(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(700):
        bad = k % 7 == 0
        text = words(rng, 40, 3000) + (" ".join(["", rng.choice(["grozk", "blarf"]), f"smeg{rng.choice('abcdefgh')}{rng.choice('xyz')}"]) if bad else "")
        rows.append((k, text + " end"))
        labels.append((k, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (9999, 0), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, toxicity.training_labels(lab))
    assert any(x.startswith("smeg") and not x.endswith("$") for x in model.stems)
    truth = dict(labels)
    scored = toxicity.score(docs.withColumn("score", F.lit("mine")), model).collect()
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 150 and all(r.predicted == truth[r.doc_id] for r in held) and all(0 <= r.score_ <= 1 for r in scored)
    assert toxicity.fit(docs, lab.limit(0)).stems == toxicity.Model().stems


def slow_features(model, text):
    """The grammar by positions, without machines: every clause, every word."""
    total = dict.fromkeys(toxicity.KINDS, 0.0)
    stems = {x for x in model.stems if not x.endswith("$")}
    for clause in re.split(r"[.!?;:,\n]+", (text or "").lower()):
        w = re.findall(r"[\w']+|[\"«»“”„]", clause)
        used = -1  # the end of the last threat: what stood before it opens no other
        for k, x in enumerate(w):
            own = model.stems.get(f"{x}$") or max(((len(s), model.stems[s]) for s in stems if x.startswith(s)), default=(0, 0.0))[1]
            if any(a in toxicity.INTENT and x in toxicity.HARM or (a, x) in model.pairs for a in w[max(used + 1, k - toxicity.REACH) : k]):
                total["threat"] += 2.0 + own  # an insult that ends a threat weighs in it
                used = k
                continue
            if not own:
                continue
            near = lambda words, n, k=k: any(y in words for y in w[max(0, k - n + 1) : k + 1])
            if near(model.negations, toxicity.SCOPE):
                kind = "negated"
            elif near(model.reports | toxicity.QUOTES, len(w)):
                kind = "reported"
            else:
                kind = "targeted" if near(toxicity.TARGET, 6) or len(w) <= 8 and any(y in toxicity.TARGET for y in w) else "plain"
            total[kind] += own
    return np.log1p(np.array([total[k] for k in toxicity.KINDS]) / toxicity.UNIT)


def test_grammar_equals_positions():
    rng = random.Random(12)
    model = toxicity.Model(pairs=frozenset({("grib", "zant"), ("grib", "idiot")}), negations=frozenset({"not", "nix"}), reports=frozenset({"said", "quax"}))
    model.stems = model.stems | {"smeg": 3.0, "smegm": 4.0}
    bag = ["you", "idiot", "smegma", "smegs", "not", "nix", "said", "quax", "will", "kill", "grib", "zant", "scum", "a", "b", "c", "d", "they", '"', ".", ",", "\n"]
    scorer = toxicity.Scorer(model)
    for k in range(600):
        text = " ".join(rng.choice(bag if k % 3 else bag[:14]) for _ in range(rng.randrange(0, 40)))
        assert scorer.features(text) == pytest.approx(slow_features(model, text)), text


@pytest.fixture(scope="module")
def contexts(spark):
    """Labelled documents whose labels hang on context: a negated or reported insult is clean, a pair of words is toxic."""
    rng = random.Random(10)
    rows = []
    for k in range(4800):
        t, kind = words(rng, 30, 2000).split(), k % 24
        own = {0: "zorg", 1: "zorg", 2: "nixo zorg", 3: "quab {w} {w} {w} zorg", 4: "grib {w} zant", 5: "zant {w} grib", 6: "zorg", 7: "zorg"}.get(kind, "{w} {w}")
        own = re.sub(r"\{w\}", lambda _: f"w{rng.randrange(2000)}", own)
        rows.append((k, " ".join([*t[:15], ".", own, ".", *t[15:], "grib", ".", "zant"]), int(kind in (0, 1, 4, 6, 7)), kind))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, kind int").repartition(4).cache()


def test_threat_negation_and_report_are_learned_and_decide(contexts):
    model = toxicity.fit(contexts.select("doc_id", "text"), toxicity.training_labels(contexts.select("doc_id", "toxic")))
    assert "nixo" in model.negations and "quab" in model.reports and ("grib", "zant") in model.pairs and ("zant", "grib") not in model.pairs
    held = [r for r in toxicity.score(contexts, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = lambda kinds: np.mean([r.predicted == r.toxic for r in held if r.kind in kinds])
    assert right({0, 1, 6, 7}) == 1 and right({4}) > 0.95 and right({2, 3}) > 0.95 and right({5, *range(8, 24)}) == 1
    # Without what was learned of contexts the same documents are decided otherwise.
    bare = toxicity.Model(model.stems, model.weights, model.bias)
    assert np.mean([toxicity.Scorer(bare).score(r.text) >= toxicity.CUT for r in held if r.kind in (2, 3)]) > 0.9
    assert np.mean([toxicity.Scorer(bare).score(r.text) >= toxicity.CUT for r in held if r.kind == 4]) < 0.1


def test_toxicity_fit_is_repeatable_and_reads_whole_texts(spark):
    rng = random.Random(11)
    rows = [(k, words(rng, 2000, 5000) + (" zorg" if k % 5 == 0 else ""), int(k % 5 == 0)) for k in range(300)]  # behind some 9,000 characters
    df = spark.createDataFrame([*rows, (0, "zzz", 1), (7, None, 0)], "doc_id long, text string, toxic int")
    one, two = (toxicity.fit(d.select("doc_id", "text"), d.select("doc_id", "toxic")) for d in (df.repartition(3), df.repartition(7).orderBy(F.desc("doc_id"))))
    assert "zorg$" in one.stems and one.stems == two.stems and one.bias == two.bias and (one.weights == two.weights).all()


def test_toxicity_edges(spark, docs, none):
    model = toxicity.Model()
    assert toxicity.score(none, model).count() == 0
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and len({r.score for r in got if not (r.text or "").strip()}) == 1


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [r for r in queries.op5_toxicity(spark, d).where("held_out").collect() if r.doc_id in truth]
    true = sum(r.predicted for r in held if truth[r.doc_id])
    assert true >= 0.75 * sum(truth[r.doc_id] for r in held) and sum(r.predicted for r in held) <= 1.05 * true


# ---------------------------------------------------------------- html


def test_extraction_of_an_article():
    page = """<!doctype html><html><head><title>T</title><script>var a="</p>";</script></head><body class="no-sidebar"><nav><a href=/>Home</a> <a href=/b>B</a></nav>
    <div class="cookie-notice">We use cookies on this site, accept them all please and go on.</div>
    <div id=page><article class="post"><h1>Title &amp; more</h1><p>First <b>bold</b><i>er</i> text,\n with   spaces.<p>Second &lt;para&gt; &nbsp;graph<br>after a break.<ul><li>one<li>two</ul>
    <div class="share">Share this</div><form><input value=x>Subscribe</form></article></div>
    <div class="comments"><p>A long comment of a reader that says a lot about the article, more than it does itself, on and on.</p></div><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "Title & more First bolder text, with spaces. Second <para> graph after a break. one two"


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a b"), ("<p>1 < 2 &amp; 3</p>", "1 < 2 & 3"), ("<!-- <p>x</p>", ""), ("<p>a<!-- b -->c</p>", "ac"), ("<p title='>'>a</p>", "a"), ("<nav>only</nav>", ""), ("<script>x", ""), ("</p></div>a", "a")])
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


def test_siblings_and_depth():
    para = "<p>" + "Some words of a real sentence, as long as these go. " * 6 + "</p>"
    page = f"<body><ul>{'<li><a href=x>link text</a>' * 40}</ul><main><section>{para * 3}</section><section>{para * 2}</section></main></body>"
    assert html_text.main_text(page).count("Some words") == 30
    assert html_text.main_text("<div>" * 5000 + para + "</div>" * 5000).count("Some words") == 6


@pytest.mark.parametrize("wrapper", ['class="layout right-sidebar"', 'id="page-with-sidebar"', 'class="has-header"', 'class="site comments-open" id=side', "class=widget-area"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_with_words_stay(wrapper, inner):
    text = "Some words of a real sentence, as long as these go. " * 5
    beside = '<div class="sidebar"><p>Beside the text.</p><a href=x>Link</a></div><div class="comments"><p>' + "A reader says much. " * 60 + "</p></div>"
    article = f'<{inner} class=text><h1 class="entry-header">Title</h1><p>{text}</p><section class="related-work"><p>{text}</p></section><div class="share">Share this</div></{inner}>'
    want = " ".join(f"Title {text} {text}".split())
    for page in (f"<body><div {wrapper}>{article}{beside}</div></body>", f"<body><nav>a</nav><main><div {wrapper}><div>{article}</div></div></main>{beside}</body>", f"<body><div {wrapper}>{article}</div>{beside}</body>"):
        assert html_text.main_text(page) == want


def test_neutral_names():
    """Nothing but density and structure tells: menus, notices, comments and the copyright line go by any other name."""
    text = "Some words of a real sentence, as long as these go. " * 5
    menu = f'<div class=a1><div class=a2>{"".join(f"<span><a href=/{k}>Page {k}</a></span>" for k in range(7))}</div></div>'
    comments = "".join(f'<div class=a6><div class=a7><b>Reader {k}</b> on Monday</div><p>I read this and think that it says a lot more than it should about {k}.</p></div>' for k in range(9))
    article = f"<div class=a3><h1>Title</h1><p>{text}</p><div class=side-by-side><p>{text}</p><p>{text}</p></div><section id=warning-signs><h2>Signs</h2><p>{text}</p></section><p>{text}</p></div>"
    page = f"<body>{menu}<div class=a4>We use small files on this site.</div>{article}<div class=a5>{comments}</div><div class=a8>&copy; 2024 Some publisher</div></body>"
    want = " ".join(f"Title {text} {text} {text} Signs {text} {text}".split())
    assert html_text.main_text(page) == want
    assert html_text.main_text(page.replace("<body>", "<body><div class=z>").replace("</body>", "</div></body>")) == want
    # The comments in the article's own element.
    assert html_text.main_text(page.replace("</div><div class=a5>", "<div class=a5>").replace("<div class=a8>", "</div><div class=a8>")) == want


def test_density_decides_tables_pages(spark):
    """The table's pages with all names taken away: the same text, found by density."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    same = 0
    for r in pages:
        bare = re.sub(r"<(/?)(?:article|nav|footer|section|aside|header|main)\b[^>]*>", r"<\1div>", re.sub(r" (?:class|id|role)=(?:\"[^\"]*\"|\S+?)(?=[\s>])", "", r.html or ""))
        same += html_text.main_text(bare) == html_text.main_text(r.html)
    assert same >= 0.98 * len(pages)


def test_words_still_cut():
    text = "<p>" + "Some words of a real sentence, as long as these go. " * 4 + "</p>"
    for block in ('class="left-sidebar"', 'class="cookie-consent"', "id=comments", 'class="related posts"'):
        long = f"<div {block}>{'<p>Other words that are not the article at all.</p>' * 30}</div>"
        assert "Other" not in html_text.main_text(f"<body><article><h1>T</h1>{text}</article>{long}</body>")
    replies = f'<div id=comments><ol class=comment-list><li class=comment><article class=comment-body>{"<p>Other words of a reader.</p>" * 90}</article></ol></div>'
    assert "Other" not in html_text.main_text(f"<body><div class=post><h1>T</h1>{text}</div>{replies}</body>")


def test_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("text", F.lit("mine"))
    for r in html_text.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        import html

        assert r.text_ == " ".join(html.unescape(re.sub(r"<(?!/?b>)[^>]*>", " ", article).replace("<b>", "").replace("</b>", "")).split())
        assert r.n_chars == len(r.text_) and r.text == "mine"


# ---------------------------------------------------------------- language


def test_languages(spark):
    d = "/root/testdata/sf0.1"
    rows = queries.op10_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 1000 and sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_predictions_equal_brute_force(spark):
    """Every segment against every dictionary with compressors made anew, over the registered query's rows."""
    import zstandard

    d = "/root/testdata/sf0.001"
    whole = spark.read.parquet(f"{d}/documents.parquet")
    train = whole.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)
    model = langid.fit(train)
    text = {r.doc_id: r.text for r in whole.collect()}

    def size(t, raw):
        how = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, source_size=langid.SEGMENT, dict_size=len(raw), min_match=langid.MIN_MATCH, write_content_size=0, write_dict_id=0)
        return sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress(t[k : k + langid.SEGMENT].encode())) for k in range(0, len(t), langid.SEGMENT))

    for r in sorted(queries.op10_language(spark, d).collect())[::5]:
        t = re.sub(r"[\W\d_]+", " ", (text[r.doc_id] or "").lower()).strip()
        sizes = {lang: np.mean([size(langid.letters(text[r.doc_id]), raw) for raw in raws]) for lang, raws in model.items()} if t else {}
        assert r.lang_pred == (min(sizes, key=lambda x: (sizes[x], x)) if sizes else "und")


def test_all_languages_and_whole_texts_are_learned(spark):
    rng = random.Random(4)
    own = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(520)}
    # What tells the languages apart comes after 2,000 characters of something that all share.
    rows = [(lang, "same words in all of them " * 80 + " ".join(rng.choice(w) for _ in range(60))) for lang, w in own.items()]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert len(model) == 520
    few = langid.Classifier({x: model[x] for x in list(model)[::40]})
    assert all(few.predict(" ".join(rng.choice(own[x]) for _ in range(40)))[0] == x for x in few.langs)


def test_language_edges(spark, docs, none):
    assert langid.fit(none) == {}
    model = langid.fit(spark.createDataFrame([("the cat sat on the mat and the dog", "en"), ("der hund und die katze sind hier", "de"), (None, "en"), ("x", None)], "text string, lang string"))
    assert set(model) == {"en", "de"}
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert got[500].lang_pred == got[501].lang_pred == got[502].lang_pred == "und" and got[500].score == 0
    assert {r.lang_pred for r in got.values()} <= {"und", "en", "de"}
    c = langid.Classifier(model)
    assert c.predict("the dog sat on the mat and the cat")[0] == "en" and c.predict("die katze und der hund sind hier")[0] == "de"
    assert c.predict("123 !!")[0] == "und" and langid.identify(none, model).count() == 0


# ---------------------------------------------------------------- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, d).toPandas(), c.sql(queries.SQL[name]).df()
    columns = sorted(want.columns)
    text = lambda v: "" if pd.isna(v) else f"{v:.5f}" if isinstance(v, float) else str(v)
    rows = lambda f: sorted(tuple(map(text, r)) for r in f[columns].astype(object).itertuples(index=False))
    assert sorted(got.columns) == columns and rows(got) == rows(want)


def test_pipeline(spark):
    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    known = {r.doc_id: r for r in docs.collect()}
    at = docs
    counts = [docs.count()]
    for _, stage in p.STAGES[:-1]:
        at = common.stored(stage(spark, at, d), "test-stage")
        assert at.columns == docs.columns
        counts.append(at.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    out = p.run(spark, d).collect()
    assert len(out) == counts[4] and all(r.n_tokens == len(r.ids) for r in out)
    for r in out:
        assert r.decoded_sha256 == hashlib.sha256((known[r.doc_id].text or "").encode()).hexdigest()
    assert p.STAGES[-1][1](spark, docs.limit(0), d).count() == 0


def test_pipeline_stages_take_odd_tables(spark, docs, none):
    import corpus_pipeline as p

    for table in (docs, none):
        at = table
        for _, stage in p.STAGES[:-1]:
            at = common.stored(stage(spark, at, "/root/testdata/sf0.001"), "test-stage")
            assert at.columns == docs.columns
        assert p.STAGES[-1][1](spark, at, "/root/testdata/sf0.001").count() == at.count()


def test_pieces_merged_together_are_merged_alike():
    """Merges.many, a row for each piece, against the merge loop; learn() keeps what the stream would find."""
    from random import Random

    r, t = Random(7), bpe.Transducer(queries.tokenizer_file())
    words = ["".join(r.choices(["th", "er", "on", " ", "ß", "é", "ly", "0", "9", "!"], k=r.randint(1, 12))) for _ in range(3000)]
    raws = [w.encode() for w in words] + [bytes(r.choices(range(256), k=r.randint(1, 40))) for _ in range(2000)] + [b"", b"a"]
    assert t.merges.many(raws) == [bpe.packed(t.merges.whole(x)) for x in raws]
    t.kept.learn(words)
    assert t.kept and all(ids == bpe.packed(t.merges.whole(p.encode())) for p, ids in t.kept.items())


def test_few_edges_are_joined_in_one_task(spark, monkeypatch):
    """The same components as by contraction, with a table for the edges and one for the labels."""
    from random import Random

    r = Random(3)
    edges = [(k, k + 1) for k in range(300, 340)] + [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(7, 7), (1 << 40, 5)]
    given = spark.createDataFrame(edges, "a long, b long")
    labels, made = [], []
    monkeypatch.setattr(graph, "stored", lambda df, label: made.append(label) or common.stored(df, label))
    for small in (graph.SMALL, 0):
        groups = collections.defaultdict(set)
        for node, root in graph.components(given, small=small).collect():
            groups[root].add(node)
        assert all(root in nodes for root, nodes in groups.items())
        labels.append(sorted(map(sorted, groups.values())))
        if small:
            assert made == ["graph-edges", "graph-labels"]
    assert labels[0] == labels[1]
    assert graph.components(given.where("a = b")).count() == 0
