"""Table operators: hand-written rows that the fixtures don't have, streams, and round trips."""

import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, types, wkt
from waymark.operators import candidates, evaluate, matchers, recover, trajectory
from waymark.plans import fixtures, network
from waymark.sources import geojson, results, text
from waymark.streaming.matcher import match_stream


@pytest.fixture(scope="module")
def tables(spark, sf):
    seg = network.expand(fixtures.road_segments(spark, sf)).cache()
    return seg, fixtures.gps_points(spark, sf).where("cast(tid as int) < 4").drop("event_id").cache()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_expansion_of_every_direction(spark):
    line = [(0.0, 0.0), (1.0, 1.0)]
    rows = [(0, 1, 2, line, 1), (5, 1, 2, line, 2), (6, 1, 2, line, 3), (7, 1, 2, line, -1)]
    df = spark.createDataFrame(rows, "segment_id int, start_id int, end_id int, points array<struct<lng: double, lat: double>>, direction int")
    got = {r.segment_id: (r.start_id, r.points[0].lng) for r in network.expand(df).collect()}
    assert got == {0: (1, 0.0), -(2**31): (2, 1.0), 5: (1, 0.0), 6: (2, 1.0), 7: (1, 0.0)}


def test_misses_and_nulls(spark, tables):
    seg, _ = tables
    p = spark.createDataFrame([("a", 0, 104.001, 30.6), ("a", 1, 10.0, 10.0), ("a", 2, None, None)], "tid string, idx int, lng double, lat double")
    c = candidates.candidates(p, seg, keep_misses=True)
    assert {r.idx for r in c.where("segment_id is null").collect()} == {1, 2}
    assert candidates.candidates(p, seg).select("idx").distinct().count() == 1
    assert candidates.hits(p, seg, broadcast=False).count() == candidates.hits(p, seg).count()


@pytest.mark.parametrize("method", matchers.METHODS)
def test_a_row_for_each_point(tables, method):
    seg, pts = tables
    m = matchers.match(pts, seg, method).toPandas()
    assert len(m) == pts.count() and not m.duplicated(["tid", "idx"]).any()


def test_split_is_the_same(tables):
    seg, pts = tables
    cols = ["tid", "idx", "segment_id"]
    one, two = (matchers.match(pts, seg, "batch", weights="fixed", split=s).select(*cols).toPandas().sort_values(cols[:2]).fillna(0) for s in (False, True))
    assert one.values.tolist() == two.values.tolist()
    with pytest.raises(ValueError):
        matchers.match(pts, seg, "batch", split=True)


def test_labels_agree_with_themselves(tables):
    seg, pts = tables
    m = matchers.match(pts, seg, "batch").cache()
    assert evaluate.total(evaluate.accuracy(m, m, seg)).first().acc == 1.0


def test_recovered_ways_are_connected(tables):
    seg, pts = tables
    ends = {r.segment_id: (r.start_id, r.end_id) for r in seg.collect()}
    for r in recover.recover(matchers.match(pts, seg, "batch"), seg).collect():
        assert all(a != b for a, b in zip(r.segment_ids, r.segment_ids[1:]))
        joined = sum(ends[a][1] == ends[b][0] for a, b in zip(r.segment_ids, r.segment_ids[1:]))
        assert joined >= 0.8 * (len(r.segment_ids) - 1)


@pytest.mark.parametrize("method", ["greedy", "online"])
def test_stream_equals_batch(spark, tables, tmp_path, method):
    seg, pts = tables
    for k in range(3):
        pts.where((F.col("idx") >= 8 * k) & ((F.col("idx") < 8 * k + 8) | F.lit(k == 2))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = []
    q = match_stream(stream, seg, method).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, _: rows.extend(b.collect())).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    last = {}
    for r in rows:
        if (r.tid, r.idx) not in last or r.revision >= last[r.tid, r.idx].revision:
            last[r.tid, r.idx] = r
    want = {(r.tid, r.idx): r.segment_id for r in matchers.match(pts, seg, method).collect()}
    assert {k: r.segment_id for k, r in last.items()} == want


def test_text_and_roads(spark, tmp_path):
    lines = ['[a1,[["2024-01-01 00:00:06",10.0,10.0],["2024-01-01 00:00:00",11.0,10.0]]]', "", "broken", '[b,[["2024-01-01 00:00:00.5",1.5,2.5]]]']
    (tmp_path / "t.txt").write_text("\n".join(lines))
    got = [tuple(r) for r in text.read_trajectories(spark, str(tmp_path / "t.txt")).select("tid", "oid", "idx", "lng").orderBy("tid", "idx").collect()]
    assert got == [("a12024-01-01 00:00:06", "a1", 0, 11.0), ("a12024-01-01 00:00:06", "a1", 1, 10.0), ("b2024-01-01 00:00:00.5", "b", 0, 1.5)]
    assert text.nth_line(spark, str(tmp_path / "t.txt"), 4).first().value == lines[3]
    assert text.nth_line(spark, str(tmp_path / "t.txt"), 9).count() == 0
    (tmp_path / "r.csv").write_text("id|g|s|e|d|l|v|m\n1|LINESTRING(1 2, 3 4.5)|1|2|1|6|60|5.0\n2|LINESTRING(1 2,2 2)|1|2|2|6|60|5.0\n")
    r = text.read_roads(spark, str(tmp_path / "r.csv")).orderBy("segment_id").first()
    assert [(p.lng, p.lat) for p in r.points] == [(1.0, 2.0), (3.0, 4.5)]
    assert text.read_roads(spark, str(tmp_path / "r.csv"), 1).count() == 1


def test_geojson_of_odd_names(spark, tables):
    seg, pts = tables
    m = matchers.match(pts, seg, "batch").withColumn("oid", F.lit('a"b\\c'))
    back = geojson.read_matched(geojson.write_matched(m, raw=True))
    assert back.select("oid").distinct().collect()[0].oid == 'a"b\\c'
    assert back.count() == m.where("segment_id is not null").count()


def test_results(spark, tables, tmp_path):
    seg, pts = tables
    m = matchers.match(pts, seg, "batch").cache()
    a = evaluate.accuracy(m, m, seg)
    results.write_csv(results.accuracy_table(a, 4.0, 2.0), str(tmp_path / "a"))
    rows = spark.read.csv(str(tmp_path / "a"), header=True, inferSchema=True).orderBy("index").collect()
    assert [r["index"] for r in rows] == list(range(len(rows))) and all(r.avgAcc == 1.0 and r.labelTime == 4.0 / len(rows) for r in rows)
    p = results.point_table(a).orderBy("TrajectoryIndex").collect()
    assert p[-1].totalPointNum == sum(r.currPointNum for r in p)
    doc = geojson.write_matched(m)
    assert {r.acc for r in evaluate.from_geojson(doc, doc, seg).collect()} == {1.0}
    d = matchers.online_delays(pts, seg, window=5).collect()
    assert all(0 <= r.corrected <= r.n * 10 and r.delay >= 0 for r in d)


def test_grid_lines():
    lngs, lats = geo.grid_lines(100.0, (104.0, 30.6, 104.01, 30.61))
    assert lngs[0] == 104.0 and lngs[-1] <= 104.01 and len(lats) == 12


def test_types():
    assert types.normalize("INT") == "Integer" and types.is_date("datetime") and types.is_point("point") and types.is_geometry("polygon")
    with pytest.raises(ValueError):
        types.normalize("decimal")


def test_scalars_of_odd_input(spark):
    df = spark.sql("select 'POINT(1 2)' a, 'nonsense' b, cast(null as string) c")
    r = df.select(wkt.read_points("a").alias("a"), wkt.read_points("b").alias("b"), wkt.read_points("c").alias("c")).first()
    assert [(p.lng, p.lat) for p in r.a] == [(1.0, 2.0)] and r.b is None and r.c is None
    one = spark.range(1)
    assert one.select(geo.haversine(0.0, 0.0, 180.0, 0.0)).first()[0] == pytest.approx(3.141592653589793 * geo.RADIUS)
    assert one.select(geo.haversine(F.lit(None).cast("double"), 0.0, 1.0, 0.0)).first()[0] is None
    assert one.select(geo.legacy_velocity(5.0, F.lit(0))).first()[0] is None
    assert one.select(geo.bbox_wkt(F.struct(F.lit(0.0).alias("min_lng"), F.lit(1.0).alias("min_lat"), F.lit(2.0).alias("max_lng"), F.lit(3.0).alias("max_lat")))).first()[0].startswith("POLYGON ((0.0 1.0, 2.0 1.0")


def test_unmoving_points(spark):
    p = spark.createDataFrame([("a", i, 104.0 + 0.001 * (i // 2), 30.0) for i in range(8)], "tid string, idx int, lng double, lat double").withColumn("time", F.timestamp_seconds(F.col("idx")))
    w = trajectory.window_bearing(p).orderBy("idx").collect()
    assert [r.idx for r in w] == [0, 2, 4, 6] and w[-1].stable and not w[0].stable
    assert [r.idx for r in trajectory.stride(p, 2).orderBy("idx").collect()] == [0, 3, 6]


def test_shortest_paths_of_all_sources(spark, sf, tables):
    """Every pair of nodes, by both methods, against least sums over each middle node."""
    from waymark import queries

    nodes = [r.node_id for r in fixtures.road_nodes(spark, sf).collect()]
    want = {(a, b): 0.0 if a == b else float("inf") for a in nodes for b in nodes}
    for r in network.edges(tables[0]).collect():
        want[r.src, r.dst] = min(want[r.src, r.dst], r.length_m)
    for k in nodes:
        for a in nodes:
            for b in nodes:
                want[a, b] = min(want[a, b], want[a, k] + want[k, b])
    for name in ("shortest_paths", "shortest_paths_iterative"):
        got = {(r.src, r.dst): r.length_m for r in queries.QUERIES[name](spark, sf).where("length_m is not null").collect()}
        assert got == pytest.approx({p: w for p, w in want.items() if w < float("inf")}, abs=1e-5) and len(nodes) == 144


def test_larger_networks_are_refused_plainly(tables):
    with pytest.raises(ValueError, match="limited") as e:
        network.collected(tables[0], most=10)
    assert "operators.lattice" not in str(e.value)


def test_late_rows_are_put_out_and_revisions_kept(spark, tables, tmp_path):
    from waymark.streaming import matcher

    seg, pts = tables
    one = pts.where("tid = '1'")
    early, late = one.where("idx between 20 and 40"), one.where("idx < 20 or idx > 40")
    early.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = match_stream(stream, seg, "online", late="mark").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(matcher.keep(out)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    rows = spark.read.parquet(out)
    assert sorted(r.idx for r in rows.where("revision = -1").collect()) == list(range(20))
    newest = matcher.latest(rows).collect()
    assert sorted(r.idx for r in newest) == list(range(20, one.count())) and rows.where("revision >= 0").count() > len(newest)


def test_running_sums(spark):
    rows = [(f"t{k:03d}", k % 5, k % 2) for k in range(57)]
    got = evaluate.running(spark.createDataFrame(rows, "tid string, n long, errors long").repartition(5), {"a": F.col("n"), "b": F.col("errors")}).collect()
    a = b = 0
    want = {}
    for t, n, e in rows:
        a, b = a + n, b + e
        want[t] = (a, b)
    assert {r.tid: (r.a, r.b) for r in got} == want


def test_strict_accuracy(spark, tables):
    """Labels along segments 1, 1, 3 (nodes 0-1, 1-2); results agree, lie on an end and are put off, or are far."""
    seg, _ = tables
    ends = {r.segment_id: (r.points[0], r.points[-1]) for r in seg.where("segment_id in (1, 3, 9)").collect()}
    row = lambda t, i, s, k: (t, i, s, ends[s][k].lng if k is not None else 0.0, ends[s][k].lat if k is not None else 0.0)
    labels = [row("a", 0, 1, None), row("a", 1, 1, None), row("a", 2, 3, None), row("b", 0, 1, None), row("b", 1, 1, None), row("c", 0, 1, None), row("c", 1, 1, 1)]
    results = [row("a", 0, 1, None), row("a", 1, 3, 0), row("a", 2, 3, None), row("b", 0, 1, None), row("b", 1, 9, None), row("c", 0, 1, None), row("c", 1, 3, None)]
    schema = "tid string, idx int, segment_id int, lng double, lat double"
    got = {r.tid: (r.n, r.errors) for r in evaluate.strict(spark.createDataFrame(labels, schema), spark.createDataFrame(results, schema), seg).collect()}
    assert got["a"] == (3, 0) and got["b"] == (2, 1) and got["c"][0] == 2
