import math
import random
import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom import catalog
from sparkloom.errors import DataError, GqlSyntaxError, SerializationConflict, Unavailable
from sparkloom.operators import checks, versions
from sparkloom.session import Session, query
from sparkloom.sources.graph import PropertyGraph
from sparkloom.sources.store import DiskStore, read_table
from sparkloom.streaming.ingest import activity, ingest, stored

SCHEMA = "key string, commit_ts long, value string"
NO_INTENTS = "key string, txn_id string"


@pytest.fixture(scope="module")
def history(spark):
    rows = [(k, 1, k) for k in ("h1", "j1", "m1", "o1", "j2", "m2")] + [("k1", 2, "x"), ("k2", 2, "y"), ("k2", 5, "z"), ("m2", 6, None)]
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_snapshots_and_scans(spark, history):
    assert pairs(versions.scan(history, "h", "p", 1)) == [(k, k) for k in ("h1", "j1", "j2", "m1", "m2", "o1")]
    own = spark.createDataFrame([("k3", "new"), ("k1", None)], "key string, value string")
    assert [k for k, _ in pairs(versions.scan(history, "k", "l", 4, own))] == ["k2", "k3"]
    assert pairs(versions.get(history, "k2", 4)) == [("k2", "y")] and pairs(versions.get(history, "k2", 9)) == [("k2", "z")] and pairs(versions.get(history, "m2", 9)) == []
    page = versions.scan(history, "h", "p", 1, limit=2)
    assert bytes(versions.scan_end(page, 2).first().read_end) == b"j1\x00" and versions.scan_end(page, 3).first().read_end is None
    assert tuple(versions.live_stats(history, 1).first()) == (6, 24, "m1") and tuple(versions.live_stats(history, 0).first()) == (0, 0, None)


def test_ranges(spark):
    ranges = spark.createDataFrame([(1, "", "k"), (2, "k", "n"), (3, "n", "")], "range_id long, start_key string, end_key string")
    spans = spark.createDataFrame([("h", "p"), ("k", "l"), ("z", "")], "span_start string, span_end string")
    cut = sorted((r.span_start, r.range_id, r.clip_start, r.clip_end) for r in versions.clip(spans, ranges).collect())
    assert cut == [("h", 1, "h", "k"), ("h", 2, "k", "n"), ("h", 3, "n", "p"), ("k", 2, "k", "l"), ("z", 3, "z", "")]
    keys = spark.createDataFrame([("h1",), ("k",), ("m2",), ("o",), ("o",), ("a",)], "key string")
    want = sorted([("h1", 1), ("k", 2), ("m2", 2), ("o", 3), ("o", 3), ("a", 1)])
    assert sorted(pairs(versions.route(keys, ranges))) == want == sorted(pairs(versions.route(keys, ranges, 0)))
    assert checks.hub_spread(ranges, "j", "o").first().n_ranges == 3


def test_conflicts(spark, history):
    none = spark.createDataFrame([], NO_INTENTS)
    writes = spark.createDataFrame([("k2", "w"), ("h1", "w")], "key string, value string")
    assert pairs(versions.write_conflicts(writes, history, none, 4, "t")) == [("k2",)] and pairs(versions.write_conflicts(writes, history, none, 5, "t")) == []
    foreign = spark.createDataFrame([("h1", "other"), ("k2", "t")], NO_INTENTS)
    with pytest.raises(SerializationConflict):
        versions.prewrite(writes, history, foreign, 9, "t")
    spans = spark.createDataFrame([("k", "l"), ("x", "")], "span_start string, span_end string")
    with pytest.raises(SerializationConflict):
        versions.validate(spans, history, none, 4, 5, "t")
    versions.validate(spans, history, none, 5, 9, "t")
    # k2 changes at 5: a scan cut behind k1 has not read it, one that goes on has
    read = lambda n: versions.footprint(versions.scan(history, "k", "l", 4, limit=n), "k", "l", n)
    assert pairs(read(1)) == [("k", "k1\x00")] and pairs(read(9)) == [("k", "l")]
    versions.validate(read(1), history, none, 4, 5, "t")
    with pytest.raises(SerializationConflict):
        versions.validate(read(2), history, none, 4, 5, "t")
    later = versions.apply(history, writes, 10)
    assert pairs(versions.get(later, "h1", 10)) == [("h1", "w")] and pairs(versions.get(later, "h1", 9)) == [("h1", "h1")]


def test_history_checks(spark):
    out = spark.createDataFrame([(1, "P", 2, 0, 5), (1, "P", 3, 0, 6), (2, "F", 1, 0, None)], "src long, type string, dst long, rank long, w long")
    assert checks.bidirectional(out, out).count() == 0
    bad = spark.createDataFrame([(1, "P", 2, 0, 4), (2, "F", 1, 0, None), (9, "F", 9, 0, 1)], out.schema)
    assert sorted((r.src, r.violation) for r in checks.bidirectional(out, bad).collect()) == [(1, "no incoming entry"), (1, "values differ"), (9, "no outgoing entry")]
    inc = spark.createDataFrame([("a", 0, True), ("a", 1, True), ("b", 0, True), ("b", 0, True), ("c", 0, False)], "counter string, read_value long, acknowledged boolean")
    finals = spark.createDataFrame([("a", 2), ("b", 1), ("c", 0)], "counter string, value long")
    assert [r.counter for r in checks.lost_updates(inc, finals).collect()] == ["b"] and [r.counter for r in checks.total_order(inc).collect()] == ["b"]
    leaders = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 3)], "term long, node long")
    assert pairs(checks.single_leader(leaders)) == [(2, 2)]
    assert checks.late_promotions(spark.createDataFrame([(1, 5), (2, 500)], "node long, lag long"), 100).count() == 1
    ops = "array<struct<f: string, k: int, v: bigint, read: array<bigint>>>"
    log = spark.createDataFrame([(0, "ok", [("append", 1, 1, None)]), (1, "ok", [("append", 1, 2, None), ("r", 1, None, [1, 2])]), (2, "ok", [("r", 1, None, [1])])], f"idx long, type string, ops {ops}")
    assert checks.list_append_anomalies(log).count() == 0
    wrong = log.unionByName(spark.createDataFrame([(3, "ok", [("r", 1, None, [2])]), (4, "ok", [("append", 1, 1, None)]), (5, "ok", [("r", 2, None, [7])])], log.schema))
    assert sorted(r.anomaly for r in checks.list_append_anomalies(wrong).collect()) == ["appended twice", "not a prefix", "read but not appended"]


def test_measures(spark):
    samples = spark.createDataFrame([("r", v) for v in range(1, 101)] + [("w", 7)], "op string, latency_ns long")
    assert dict(pairs(checks.percentile(samples, 0.99))) == {"r": 99, "w": 7} and dict(pairs(checks.percentile(samples, 0.99, rule="floor"))) == {"r": 100, "w": 7}
    assert dict(pairs(checks.percentile(samples, 1.0, rule="floor"))) == {"r": 100, "w": 7}
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "node_id long")
    held = spark.createDataFrame([(r, n) for r in range(24) for n in (1, 2, 3)], "range_id long, node_id long")
    assert checks.deviation(checks.replica_counts(held, nodes)).first().deviation == 1.0
    assert pairs(checks.next_move(held, nodes)) == [(0, 1, 4)]
    even = spark.createDataFrame([(r, n) for r in range(18) for n in (1, 2, 3, 4)], held.schema)
    assert checks.deviation(checks.replica_counts(even, nodes)).first().deviation == 0.0 and checks.next_move(even, nodes).count() == 0
    stores = spark.createDataFrame([(1, "a", 3), (2, "a", 1), (3, "b", 0), (4, "c", 9)], "node_id long, zone string, replicas int")
    assert pairs(checks.place_voters(stores, 3)) == [(3, "b"), (2, "a"), (4, "c")]
    for n in (4, 5):
        with pytest.raises(DataError):
            checks.place_voters(stores, n)
    stats = spark.createDataFrame([(1, "a", 100, "b"), (2, "c", 100, "c"), (3, "d", 5, "e")], "range_id long, start_key string, n_bytes long, median_key string")
    assert pairs(checks.oversized(stats, 50)) == [(1, "b")]
    hot = checks.ycsb(spark, 1000, 100_000).groupBy("key").count().orderBy(F.desc("count")).first()
    assert hot["count"] > 5000 and hot.key == "user0000000000"


def test_store(spark, tmp_path):
    people = spark.createDataFrame([(1, "Ada"), (2, "Bob")], "id int, name string")
    knows = spark.createDataFrame([(1, 2)], "src long, dst long")
    root = f"file://{tmp_path}/graph"
    with pytest.raises(Unavailable):
        DiskStore(spark, root).snapshot()
    store = DiskStore(spark, root, PropertyGraph(spark).with_nodes(people, "P").with_edges(knows, "KNOWS"))
    s = Session(store)
    s.execute("MATCH (a {id: 1}) SET a.name = 'Ada L.'")
    assert store.versions() == [0, 1]
    fresh = DiskStore(spark, root)
    assert pairs(query(fresh.snapshot()[1], "MATCH (a {id: 1})-[:KNOWS]->(b) RETURN a.name, b.name")) == [("Ada L.", "Bob")]
    assert pairs(query(fresh.snapshot(0)[1], "MATCH (a {id: 1}) RETURN a.name")) == [("Ada",)]
    late = DiskStore(spark, root)
    base, graph = late.snapshot()
    Session(fresh).execute("INSERT (:P {id: 3})")
    with pytest.raises(SerializationConflict):
        late.commit(base, graph)
    assert Session(late).execute("MATCH (a:P) RETURN COUNT(*)").collect() == [(3,)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 0.5)], "id long, name string, w double")
    for form, end in (("csv", "csv"), ("json", "jsonl"), ("parquet", "parquet"), ("orc", "orc")):
        path = f"{tmp_path}/t.{end}"
        (df.write.option("header", True) if form == "csv" else df.write).format(form).save(path)
        assert [(r.id, r.name, r.w) for r in read_table(spark, path).collect()] == [(1, "x", 0.5)]


def test_mixed_types_and_limits(spark):
    a = spark.createDataFrame([(1, 5)], "id long, v long")
    b = spark.createDataFrame([(2, "five")], "id long, v string")
    g = PropertyGraph(spark).with_nodes(a, "A").with_nodes(b, "B")
    assert pairs(query(g, "MATCH (n) WHERE n.v = 5 RETURN n.id")) == [(1,)] and pairs(query(g, "MATCH (n) WHERE n.v = 'five' RETURN n.id")) == [(2,)]
    assert pairs(query(g, "MATCH (n) WHERE n.v IS TYPED INT RETURN n.id, CAST(n.v AS INT) + 1")) == [(1, 6)]
    with pytest.raises(DataError):
        Session(g, max_document=20).execute("INSERT (:C {v: 'far more than twenty bytes'})")


def test_stream(spark, tmp_path):
    changes = f"{tmp_path}/changes"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], SCHEMA).write.parquet(changes)
    for _ in range(2):
        ingest(spark.readStream.schema(SCHEMA).parquet(changes), f"{tmp_path}/v", f"{tmp_path}/cp").awaitTermination(120)
    assert sorted(pairs(versions.latest(stored(spark, f"{tmp_path}/v"), 9))) == [("b", "y")]
    events = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet("/root/testdata/sf0.001/events.parquet*")
    q = activity(events).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from activity").first()[0] == 1000


def test_ends_that_are_told_save_scans(spark):
    people = spark.createDataFrame([(1,), (2,)], "id long")
    towns = spark.createDataFrame([(10, "Ulm")], "id long, town string")
    lives = spark.createDataFrame([(1, 10), (2, 10)], "src long, dst long")
    g = PropertyGraph(spark, complete=True).with_nodes(people, "P").with_nodes(towns, "T").with_edges(lives, "LIVES", between=("P", "T"))
    for text, want in (("MATCH (p:P)-[:LIVES]->(t) RETURN t.town", 2), ("MATCH (p)-[:LIVES]->(t:P) RETURN p.id", 0), ("MATCH (p)-(t:P) RETURN t.id", 2), ("MATCH (t:T)-{1,2}(p) RETURN p.id", 4), ("MATCH (p:P)-(t:T)-(q:P) RETURN q.id", 4)):
        assert query(g, text).count() == want, text
    plan = query(g, "MATCH (p:P)-[:LIVES]->(t:T) RETURN p.id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    s = Session(g)
    s.execute("MATCH (p:P {id: 1}) REMOVE p:P")
    assert s.execute("MATCH (p:P)-[:LIVES]->(t) RETURN p.id").collect() == [(2,)]


@pytest.mark.parametrize("name", ["mvcc_latest_whole", "mvcc_scan_whole", "mvcc_overlay_whole", "live_stats_whole", "write_conflicts_whole", "read_conflicts_whole"])
def test_versioned_keys_of_the_whole_table(spark, name):
    con = duckdb.connect()
    con.sql("create view events as select * from '/root/testdata/sf0.01/events.parquet'")
    make, sql = catalog.Q[name]
    want = con.sql(sql)
    df = make(spark, "/root/testdata/sf0.01")
    assert sorted(tuple(r[c] for c in want.columns) for r in df.collect()) == sorted(want.fetchall())
    if name == "mvcc_latest_whole":
        latest = "select count(*) from (select user_id, arg_max(event_type, event_id) t from events group by 1) where t <> 'error'"
        assert df.count() == con.sql(latest).fetchall()[0][0]


def test_many_ranges_and_keys(spark):
    """The ways for many ranges and keys against plain loops."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 4)))
    cuts = sorted({word() for _ in range(30)})
    held = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], ""], strict=True)) if k % 5]
    spans = [tuple(sorted((word(), word()))) for _ in range(60)] + [(word(), "") for _ in range(5)] + [("a", "a")]
    meets = lambda s, e, a, b: (not b or s < b) and (not e or a < e)
    want = sorted((s, e, k, max(s, a), e if not b else b if not e else min(e, b)) for s, e in spans for k, a, b in held if meets(s, e, a, b))
    ranges = spark.createDataFrame(held, "range_id long, start_key string, end_key string")
    asked = spark.createDataFrame(spans, "span_start string, span_end string")
    for limit in (1000, 0):
        got = versions.clip(asked, ranges, limit).select("span_start", "span_end", "range_id", "clip_start", "clip_end")
        found = sorted(tuple(x) for x in got.collect())
        assert [x for x in found if x[0] != x[1]] == [x for x in want if x[0] != x[1]]
    written = [(word(), r.randint(1, 30), "v") for _ in range(40)]
    changed = {k for k, ts, _ in written if 10 < ts <= 20} | {"bb"}
    table = spark.createDataFrame(written, "key string, commit_ts long, value string")
    intents = spark.createDataFrame([("bb", "t2"), ("cc", "t1")], "key string, txn_id string")
    hit = sorted((s, e) for s, e in spans if any(s <= k and (not e or k < e) for k in changed))
    for limit in (1000, 0):
        assert sorted(tuple(x) for x in versions.read_conflicts(asked, table, intents, 10, 20, "t1", limit).collect()) == hit


def test_percentiles_and_histograms(spark):
    r = random.Random(9)
    rows = [(r.choice(["get", "put", None]), r.randint(0, 400)) for _ in range(900)]
    df = spark.createDataFrame(rows, "op string, latency_ns long").repartition(5)
    groups = {g: sorted(v for o, v in rows if o == g) for g in ("get", "put", None)}
    for p in (0.0, 0.5, 0.99, 1.0):
        up = {g: v[max(math.ceil(p * len(v)), 1) - 1] for g, v in groups.items()}
        low = {g: v[min(math.floor(p * len(v)), len(v) - 1)] for g, v in groups.items()}
        assert {x.op: x.value for x in checks.percentile(df, p).collect()} == up and {x.op: x.value for x in checks.percentile(df, p, rule="floor").collect()} == low
    got = {(x.op, x.le): (x.n, x.total) for x in checks.histogram(df, [100, 250]).collect()}
    assert got == {(g, b): (sum(b is None or x <= b for x in v), sum(v)) for g, v in groups.items() for b in (100.0, 250.0, None)}
    with pytest.raises(DataError):
        checks.histogram(df, [3, 2])


def test_manifests_are_whole_and_exclusive(spark, tmp_path):
    root = f"file://{tmp_path}/g"
    people = spark.createDataFrame([(1,)], "id long")
    store = DiskStore(spark, root, PropertyGraph(spark).with_nodes(people, "P"))
    other = DiskStore(spark, root)
    (a, g), (b, h) = store.snapshot(), other.snapshot()
    other.versions = lambda: [0]  # looked before the first one's commit
    assert store.commit(a, g.replaced()) == 1
    with pytest.raises(SerializationConflict):
        other.commit(b, h.replaced())
    assert DiskStore(spark, root).versions() == [0, 1] and not list((tmp_path / "g").glob("draft-*"))


def test_depth_of_values(spark):
    from sparkloom.session import Session

    g = PropertyGraph(spark).with_nodes(spark.createDataFrame([(1,)], "id long"), "P")
    deep = lambda n: [deep(n - 1)] if n else 1
    for statement in ("MATCH (n) SET n.x = $v", "INSERT (:P {x: $v})", "MATCH (n) SET n = {x: $v}"):
        with pytest.raises(DataError):
            Session(g).execute(statement, {"v": deep(129)})
    assert Session(g).execute("MATCH (n) SET n.x = $v", {"v": deep(12)}).mutations == 1
    with pytest.raises(GqlSyntaxError):
        Session(g).execute("RETURN " + "[" * 4000)
