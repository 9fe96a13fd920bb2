"""Statements against a small railway of our own: stations, works (stations and sites at once), tracks and visits."""

import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkloom.errors import DataError, GqlSyntaxError, InvalidParameter, NotGql, SerializationConflict, UnsupportedFeature
from sparkloom.session import GraphStore, Session, query
from sparkloom.sources.graph import PropertyGraph, Route

#: station -> (id, tracks, metres above the sea)
STATIONS = {"Aspen": (11, 4, 120), "Birch": (12, 2, None), "Cedar": (13, 7, 310), "Dogwood": (14, 2, 95)}
WORKS = {"Elm": (21, 1, 40)}
LINES = [("Aspen", "Birch", 0, 9.5), ("Birch", "Cedar", 0, 14.0), ("Cedar", "Aspen", 0, 22.25), ("Cedar", "Dogwood", 0, 3.0), ("Cedar", "Dogwood", 1, 4.5), ("Dogwood", "Dogwood", 0, 0.5)]
ID = {n: v[0] for n, v in (STATIONS | WORKS).items()}


@pytest.fixture(scope="session")
def rail(spark):
    table = lambda rows: spark.createDataFrame([(v[0], n, v[1], v[2]) for n, v in rows.items()], "id long, name string, tracks long, height long")
    lines = spark.createDataFrame([(ID[a], ID[b], r, km) for a, b, r, km in LINES], "src long, dst long, rank long, km double")
    serves = spark.createDataFrame([(ID["Elm"], ID["Cedar"])], "src long, dst long")
    g = PropertyGraph(spark).with_nodes(table(STATIONS), "Station").with_nodes(table(WORKS), "Station", "Site")
    return g.with_edges(lines, "LINE", rank="rank").with_edges(serves, "SERVES")


def rows(graph, text, **params):
    plain = lambda x: str(x) if isinstance(x, Decimal) else bytes(x) if isinstance(x, bytearray) else x
    return [tuple(map(plain, r)) for r in query(graph, text, params).collect()]


def names(graph, text, **params):
    return sorted(r[0] for r in rows(graph, text, **params))


def walks(low, high, start=None):
    """Ends of walks over lines, by plain loops."""
    out, now = [], [(n, n) for n in (STATIONS | WORKS) if start in (None, n)]
    for depth in range(high + 1):
        out += [(a, b) for a, b in now if depth >= low]
        now = [(a, t) for a, b in now for s, t, _, _ in LINES if s == b]
    return sorted(out)


@pytest.mark.parametrize("low,high", [(1, 2), (0, 1), (0, 0), (2, 2), (2, 5)])
def test_walks(rail, low, high):
    hops = f"{{{low},{high}}}" if low != high else f"{{{low}}}"
    assert sorted(rows(rail, f"MATCH (a)-[:LINE]->{hops}(b) RETURN a.name, b.name")) == walks(low, high)
    assert sorted(rows(rail, f"MATCH (a {{name: 'Birch'}})-[:LINE]->{hops}(b) RETURN a.name, b.name")) == walks(low, high, "Birch")
    assert sorted(rows(rail, f"MATCH (a {{id: 12}}) MATCH (a)-[:LINE]->{hops}(b) RETURN a.name, b.name")) == walks(low, high, "Birch")
    assert sorted(rows(rail, f"MATCH (b)<-[:LINE]-{hops}(a) RETURN a.name, b.name")) == walks(low, high)


def test_walks_end_where_none_goes_on(spark):
    n = spark.range(6).withColumnRenamed("id", "id")
    chain = spark.createDataFrame([(k, k + 1) for k in range(5)], "src long, dst long")
    g = PropertyGraph(spark).with_nodes(n, "N").with_edges(chain, "NEXT")
    assert rows(g, "MATCH (a {id: 1})-[:NEXT]->{1,100}(b) RETURN b.id AS b ORDER BY b") == [(2,), (3,), (4,), (5,)]
    assert rows(g, "MATCH (a)-[:NEXT]->{9,1000}(b) RETURN COUNT(*)") == [(0,)]


def test_edges_of_a_walk(rail):
    assert rows(rail, "MATCH (a {name: 'Aspen'})-[e:LINE]->{2}(b) RETURN SIZE(e), b.name") == [(2, "Cedar")]
    assert names(rail, "MATCH (a {name: 'Cedar'})-[e:LINE WHERE e.km < 4]->{1,3}(b) RETURN b.name") == ["Dogwood"] * 3
    assert names(rail, "MATCH (a {name: 'Cedar'})-[:LINE {km: 4.5}]->{1,2}(b) RETURN b.name") == ["Dogwood"]


def test_single_edges(rail):
    assert names(rail, "MATCH (a {id: 13})-[:LINE]->(b) RETURN b.name") == ["Aspen", "Dogwood", "Dogwood"]
    assert names(rail, "MATCH (b {id: 14})<-[:LINE]-(a) RETURN a.name") == ["Cedar", "Cedar", "Dogwood"]
    # a loop is met once, whatever the way
    assert names(rail, "MATCH (a {name: 'Dogwood'})-[:LINE]-(b) RETURN b.name") == ["Cedar", "Cedar", "Dogwood"]
    assert names(rail, "MATCH (a {name: 'Elm'})-(b) RETURN b.name") == names(rail, "MATCH (a {id: 21})<->(b) RETURN b.name") == ["Cedar"]
    assert names(rail, "MATCH (a {name: 'Cedar'})<-(b) RETURN b.name") == ["Birch", "Elm"]
    assert names(rail, "MATCH (a)-[e:LINE WHERE e.km > 10]->(b) RETURN a.name") == ["Birch", "Cedar"]
    assert rows(rail, "MATCH (a)-[e:LINE|SERVES]->(b {id: $x}) RETURN COUNT(*), COUNT(e), COUNT(DISTINCT a)", x=13) == [(2, 2, 2)]


@pytest.mark.parametrize("labels,found", [("Site", ["Elm"]), ("!Site", [*STATIONS]), ("Station&Site", ["Elm"]), ("Site|Nothing", ["Elm"]), ("%", [*STATIONS, "Elm"]), ("!%", []), ("(Station&!Site)|Site", [*STATIONS, "Elm"])])
def test_labels(rail, labels, found):
    assert names(rail, f"MATCH (n:{labels}) RETURN n.name") == sorted(found)
    assert names(rail, f"MATCH (n) WHERE n IS LABELED {labels} RETURN n.name") == sorted(found)
    assert names(rail, f"MATCH (n) WHERE n IS NOT LABELED {labels} RETURN n.name") == sorted({*STATIONS, "Elm"} - set(found))


def test_several_paths(rail):
    triangle = [("Aspen", "Birch", "Cedar"), ("Birch", "Cedar", "Aspen"), ("Cedar", "Aspen", "Birch")]
    loops = [("Dogwood",) * 3]
    assert sorted(rows(rail, "MATCH (a)-[:LINE]->(b)-[:LINE]->(c), (c)-[:LINE]->(a) RETURN a.name, b.name, c.name")) == sorted(triangle + loops)
    assert sorted(rows(rail, "MATCH (c)-[:LINE]->(a)-[:LINE]->(b) MATCH (c)<-[:LINE]-(b) RETURN a.name, b.name, c.name")) == sorted(triangle + loops)
    assert rows(rail, "MATCH (a:Site)-[:SERVES]->(b), (b)-[:LINE]->(c)<-[:LINE]-(d) WHERE d.name = 'Dogwood' RETURN COUNT(*)") == [(2,)]
    assert rows(rail, "MATCH (a)-[e:LINE]->(b), (c)-[e]->(d) RETURN COUNT(*), COUNT(DISTINCT a)") == [(6, 4)]
    assert rows(rail, "MATCH (a)-[e]->(b) MATCH (a)-[e]->(c) RETURN COUNT(*)") == [(7,)]
    assert rows(rail, "MATCH (a)-[:LINE]->(a) RETURN a.name") == [("Dogwood",)]
    assert sorted(rows(rail, "MATCH (a), (b) WHERE a.height < b.height AND b.tracks > 3 RETURN a.name, b.name")) == sorted((x, y) for x, (_, _, h) in (STATIONS | WORKS).items() for y, (_, t, k) in (STATIONS | WORKS).items() if h is not None and k is not None and h < k and t > 3)
    assert rows(rail, "MATCH (a:Site), (b)-[:LINE]->(c WHERE c.tracks > a.tracks + 5) RETURN b.name, c.name") == [("Birch", "Cedar")]


def test_order_of_paths(rail):
    from sparkloom.gql.parser import parse
    from sparkloom.plans.matching import Matcher

    text = "MATCH (a)-[:ONE]->(n)<-[:ONE]-(b), (b)<-[:MANY]-(c)-[:MANY]->(a) RETURN 1"
    g = PropertyGraph(rail.spark).with_edges(rail.spark.createDataFrame([(1, 2)], "src long, dst long"), "ONE", single="src").with_edges(rail.spark.createDataFrame([(1, 2)], "src long, dst long"), "MANY")
    steps = Matcher(g, {}, {})._in_order(parse(text).clauses[0].paths, {})
    made = [[e.var if e.kind == "node" else e.labels.value for e in step] for step in steps]
    # a node with many edges is met first, then what is one; the way on to a node that is bound is joined by both its ends
    assert made == [["b", "MANY", "c"], ["b", "ONE", "n"], ["c", "MANY", "a", "ONE", "n"]]


def test_optional_and_exists(rail):
    got = rows(rail, "MATCH (a:Station) OPTIONAL MATCH (a)-[l:LINE]->(b) WHERE l.km > 9 RETURN a.name AS a, b.name AS b ORDER BY a, b")
    assert got == [("Aspen", "Birch"), ("Birch", "Cedar"), ("Cedar", "Aspen"), ("Dogwood", None), ("Elm", None)]
    assert names(rail, "MATCH (a) WHERE EXISTS {(a)-[:LINE]->(:Station {tracks: 2})} RETURN a.name") == ["Aspen", "Cedar", "Dogwood"]
    assert names(rail, "MATCH (a) WHERE NOT EXISTS {(a)<-[]-()} RETURN a.name") == ["Elm"]
    assert rows(rail, "MATCH (a) RETURN a.name AS n, EXISTS {(a)-[:SERVES]->()} AS s ORDER BY s DESC, n LIMIT 2") == [("Elm", True), ("Aspen", False)]
    assert names(rail, "MATCH (a) WHERE a.tracks = 7 OR EXISTS {MATCH (a)<-[:LINE]-(x WHERE x.name = 'Aspen')} RETURN a.name") == ["Birch", "Cedar"]


def test_nulls_and_order(rail):
    known = sorted(v[2] for v in (STATIONS | WORKS).values() if v[2] is not None)
    heights = lambda how: [r[0] for r in rows(rail, f"MATCH (n) RETURN n.height ORDER BY n.height {how}")]
    assert heights("") == heights("ASC NULLS LAST") == [*known, None] and heights("NULLS FIRST") == [None, *known]
    assert heights("DESC") == [None, *known[::-1]] and heights("DESC NULLS LAST OFFSET 1 LIMIT 2") == known[::-1][1:3]
    assert names(rail, "MATCH (n) WHERE n.height > 100 OR n.height IS NULL RETURN n.name") == ["Aspen", "Birch", "Cedar"]
    assert rows(rail, "MATCH (n {height: NULL}) RETURN n.name") == []
    assert rows(rail, "MATCH (n) FILTER n.height IS NOT NULL LET feet = n.height * 3, per = feet / n.tracks RETURN n.name AS n, per ORDER BY per, n LIMIT 2") == [("Aspen", 90), ("Elm", 120)]


def test_aggregates(rail):
    assert rows(rail, "MATCH (n) RETURN COUNT(*), COUNT(n.height), MIN(n.height), MAX(n.name), SUM(n.tracks), AVG(n.height)") == [(5, 4, 40, "Elm", 16, 141.25)]
    assert rows(rail, "MATCH (n) RETURN COUNT(DISTINCT n), COUNT(DISTINCT n.tracks), SUM(DISTINCT n.tracks)") == [(5, 4, 14)]
    assert rows(rail, "MATCH (n:Nothing) RETURN COUNT(*), SUM(n.tracks), AVG(n.tracks)") == [(0, None, None)]
    assert rows(rail, "MATCH (n) RETURN DISTINCT n.tracks AS t ORDER BY t") == [(1,), (2,), (4,), (7,)]


VALUES = [
    ("FOR x IN [5, 4, 6] RETURN x ORDER BY x DESC", [(6,), (5,), (4,)]), ("FOR x IN NULL RETURN x", []), ("LET r = {p: {q: [8]}} RETURN r.p.q, r.z", [([8], None)]),
    ("RETURN 2 + 3 * 4, 0.25 + 1.50, 9 / 4, -9 / 4, 'rail' || 'way', CAST('41' AS INT) + 1, LOWER('ÄB'), 0x1F, 0b11, 0o17", [(14, "1.75", 2, -2, "railway", 42, "äb", 31, 3, 15)]),
    ("RETURN 3 = '3', 3 <> '3', 3 IN [3, NULL], 3 IN [4, NULL], [NULL] = [NULL], NULL IN [3], 5 NOT IN [1, 2]", [(False, True, True, False, False, None, True)]),
    ("RETURN NULL XOR TRUE, NOT NULL, FALSE AND NULL, TRUE OR NULL, TRUE XOR FALSE", [(None, None, False, True, True)]),
    ("RETURN 11 % 4, -11 % 4, MOD(11, 4), 1e0 / 0 > 1e300, LN(0) < -1e300", [(3, -3, 3, True, True)]),
    ("RETURN CAST(FALSE AS STRING), CAST(6e0 AS STRING), CAST('false' AS BOOL), CAST(7.8 AS INT), CAST(-5e0 AS INT)", [("FALSE", "6", False, 7, -5)]),
    ("RETURN NULLIF(4, NULL), NULLIF(4, 4), NULLIF(4, 5), COALESCE(NULL, NULL, 6)", [(None, None, 4, 6)]),
    ("RETURN TRIM('  o k '), TRIM(LEADING '0' FROM '007'), TRIM(TRAILING '.' FROM 'a..'), BTRIM('__x_', '_'), LTRIM('  t '), RTRIM('xyy', 'y')", [("o k", "7", "a", "x", "t ", "x")]),
    ("RETURN TRIM(BOTH X'FF' FROM X'FF01FFFF'), BTRIM(X'0A01A0', X'0AA0'), BYTE_LENGTH(X'010203'), BYTE_LENGTH('ß'), CHAR_LENGTH('ß')", [(b"\x01", b"\x01", 3, 2, 1)]),
    ("RETURN LEFT('track', 3), RIGHT('track', 99), SIZE([1, 2, 3]), CARDINALITY({a: 1}), ABS(-8), CEIL(2.1), FLOOR(-2.1)", [("tra", "track", 3, 1, 8, 3.0, -3.0)]),
    ("RETURN CASE 2 WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END, CASE WHEN NULL THEN 1 WHEN FALSE THEN 2 END", [("b", None)]),
    ("RETURN 5 IS TYPED INT, 2.5 IS TYPED DECIMAL, NULL IS TYPED STRING, 'a' IS NOT TYPED STRING, [1] IS TYPED LIST", [(True, True, False, False, True)]),
    ("RETURN [1, 2] < [1, 3], [1] < [1, 2], [2] > [1, 9], {a: 1} = {a: 1}, {a: 1} = {a: 2}, {a: 1} <> {b: 1}, {a: NULL} = {a: 1}", [(True, True, True, True, False, True, False)]),
]


@pytest.mark.parametrize("text,expected", VALUES, ids=[v[0][:40] for v in VALUES])
def test_values(rail, text, expected):
    assert rows(rail, text) == expected


def test_numeric_functions(rail):
    import math

    got = rows(rail, "RETURN POWER(2, 10), LOG(2, 8), EXP(1), RADIANS(180), DEGREES(3.141592653589793), LOG10(1000), LN(EXP(2)), SQRT(2.25), SIN(1), COS(1), TAN(1), COT(1), ASIN(0.5), ACOS(0.5), ATAN(0.5), SINH(1), COSH(1), TANH(1)")[0]
    want = (1024, 3, math.e, math.pi, 180, 3, 2, 1.5, math.sin(1), math.cos(1), math.tan(1), 1 / math.tan(1), math.asin(0.5), math.acos(0.5), math.atan(0.5), math.sinh(1), math.cosh(1), math.tanh(1))
    assert got == pytest.approx(want)


def test_elements_as_values(rail):
    assert rows(rail, "MATCH (a {id: 13})-[e]->(b {id: 14}) WHERE e.km < 4 RETURN ELEMENT_ID(a), ELEMENT_ID(e), PROPERTY_EXISTS(e, km), PROPERTY_EXISTS(e, name), SAME(a, a), ALL_DIFFERENT(a, b)") == [(13, "13-LINE-14-0", True, False, True, True)]
    assert rows(rail, "MATCH (a)-[e]->(b) WHERE a IS SOURCE OF e AND b IS DESTINATION OF e AND e IS DIRECTED AND a IS LABELED Site RETURN b.name") == [("Cedar",)]
    assert rows(rail, "MATCH (n {id: 21}) LET m = n RETURN m.properties.name, m.labels, m.name") == [("Elm", ["Site", "Station"], None)]
    assert rows(rail, "MATCH (n {id: 12.0}) RETURN n.name") == rows(rail, "MATCH (n) WHERE 12 = n.id RETURN n.name") == [("Birch",)]


def test_names_and_parameters(rail):
    out = query(rail, "MATCH (s) WHERE s.tracks = $t RETURN s.name, s.tracks AS k, LOWER(s.name), 2 * 2", {"t": 7})
    assert out.columns == ["s.name", "k", "lower", "expr"] and [tuple(r) for r in out.collect()] == [("Cedar", 7, "cedar", 4)]
    star = query(rail, "MATCH (z:Site)-[y]->(x) RETURN *")
    assert star.columns == ["x", "y", "z"] and star.count() == 1


WRONG = [
    ("MATCH (n) RETURN n.name, COUNT(*)", UnsupportedFeature), ("RETURN SUM(1) * 2", GqlSyntaxError), ("RETURN nobody", GqlSyntaxError), ("RETURN 2 > 'b'", DataError), ("RETURN NOT 'x'", DataError), ("RETURN $missing", GqlSyntaxError),
    ("SELECT x FROM y", NotGql), ("MATCH (n) RETURN n LIMIT -2", DataError), ("USE nowhere RETURN 1", GqlSyntaxError), ("FOR x IN 'ab' RETURN x", DataError), ("RETURN NOSUCH(2)", GqlSyntaxError), ("MATCH (a)-[l]->(b WHERE l.km = 1) RETURN a", GqlSyntaxError),
    ("RETURN COUNT(COUNT(*))", GqlSyntaxError), ("RETURN SUM()", GqlSyntaxError), ("MATCH (a)-[e]->(b), (e)-[:LINE]->(c) RETURN 1", GqlSyntaxError), ("RETURN EXISTS {(a)-[:LINE]->(b) MATCH (c)}", UnsupportedFeature),
    ("RETURN 9223372036854775807 * 2", DataError), ("RETURN 4 / 0", DataError), ("RETURN CAST('four' AS INT)", DataError), ("RETURN RIGHT('a', -3)", DataError), ("MATCH (n) SET n.x = 1 RETURN n.x", InvalidParameter),
]


@pytest.mark.parametrize("text,error", WRONG, ids=[w[0][:40] for w in WRONG])
def test_errors(rail, text, error):
    with pytest.raises(error):
        Session(rail).execute(text).collect() if error is DataError else query(rail, text).collect()


def test_lookups_by_route(spark, tmp_path):
    """A node of a routed table is looked up by its column in the file, other tables and edges of other nodes are not read."""
    for n in ("left", "right"):
        spark.range(50).selectExpr("id AS k", f"concat('{n}', id) AS name").write.parquet(f"{tmp_path}/{n}")
    spark.range(50).selectExpr("id AS a", "(id * 7) % 50 AS b").write.parquet(f"{tmp_path}/links")
    read = lambda n: spark.read.parquet(f"{tmp_path}/{n}")
    at = lambda c, k: Route(c, k * 1000, 1000)
    g = PropertyGraph(spark, complete=True).with_nodes(read("left"), "L", id=at("k", 1)).with_nodes(read("right"), "R", id=at("k", 2)).with_edges(read("links"), "TO", at("a", 1), at("b", 2), between=("L", "R"))
    plan = lambda df: df._jdf.queryExecution().toString()
    one = query(g, "MATCH (x {id: 2007}) RETURN x.name AS n")
    assert [tuple(r) for r in one.collect()] == [("right7",)] and "EqualTo(k,7)" in plan(one) and "left" not in plan(one)
    out = query(g, "MATCH (x {id: $x})-[:TO]->(y) RETURN y.name AS n", {"x": 1009})
    assert [tuple(r) for r in out.collect()] == [("right13",)] and "EqualTo(a,9)" in plan(out)
    back = query(g, "MATCH (y)<-[:TO]-(x) WHERE y.id = 2013 RETURN x.name AS n")
    assert [tuple(r) for r in back.collect()] == [("left9",)] and "EqualTo(b,13)" in plan(back)
    assert query(g, "MATCH (x {id: 5}) RETURN x.name AS n").collect() == []
    assert [r["$dst"] for r in g.adjacent(1009).collect()] == [2013] and g.get_node(2007).first().name == "right7"


def test_set_and_remove(rail):
    s = Session(rail)
    of = lambda name, what: s.execute(f"MATCH (n {{name: '{name}'}}) RETURN {what}").collect()[0]
    assert s.execute("MATCH (n {id: 11}) SET n.tracks = n.tracks + 1, n.height = n.tracks, n:Hub").mutations == 3
    # values are those before the clause
    assert of("Aspen", "n.tracks, n.height, n IS LABELED Hub, n IS LABELED Station") == (5, 4, True, True)
    s.execute("MATCH (n:Hub) REMOVE n:Hub, n.height")
    assert of("Aspen", "n.height, n IS LABELED Hub") == (None, False)
    s.execute("MATCH (n {name: 'Birch'}) SET n = {name: 'Birch', code: 'bi'}")
    assert of("Birch", "n.tracks, n.code") == (None, "bi")
    s.execute("MATCH (n {name: 'Birch'}) SET n = {name: 'Birch', code: 'x'}, n.code = 'y', n.tracks = 3")
    assert of("Birch", "n.tracks, n.code, n.height") == (3, "y", None)
    s.execute("MATCH (a)-[l:LINE {km: 3.0}]->(b) SET l.km = 3.25e0, l.note = 'new'")
    assert s.execute("MATCH (a)-[l:LINE]->(b {id: 14}) WHERE a.id = 13 RETURN l.km AS km, l.note AS t ORDER BY km").collect() == [(3.25, "new"), (4.5, None)]
    # several rows write one element: the last one's value stays, one value in any case
    s.execute("MATCH (a {id: 13})-[l:LINE]->(b {id: 14}) SET b.height = 96")
    assert of("Dogwood", "n.height") == (96,)
    assert s.execute("MATCH (n:Nothing) SET n.x = 1").mutations == 0


def test_updates_touch_the_tables_that_match(rail):
    s = Session(rail)
    s.execute("MATCH (n:Site) SET n.note = 'x'")
    before, after = rail.nodes, s.store.snapshot()[1].nodes
    assert after[0] is before[0] and "note" in after[1].props and s.store.snapshot()[1].edges == rail.edges
    s.execute("MATCH (a)-[e:SERVES]->(b) SET e.since = 1900")
    assert [("since" in t.props) for t in s.store.snapshot()[1].edges] == [False, True]


def test_insert(rail):
    s = Session(rail)
    assert s.execute("INSERT (p:Bridge&Site {id: 70, span: 12})-[:CARRIES {load: 3}]->(q:Road), (q)-[:CARRIES]->(p)").mutations == 4
    assert s.execute("MATCH (p:Bridge)-[c:CARRIES]->(q:Road)-[:CARRIES]->(p) RETURN p.span, c.load, p.id").collect() == [(12, 3, 70)]
    for bad in ("INSERT (:Bridge {id: 70})", "INSERT (:Bridge {id: -5})", "INSERT (:Bridge {id: 'x'})", "INSERT (:Bridge {id: 11})"):
        with pytest.raises(DataError):
            s.execute(bad)
    assert s.execute("FOR k IN [30, 10, 20] INSERT (m:Mark {at: k}) RETURN m.at ORDER BY m.at").collect() == [(10,), (20,), (30,)]
    # parallel edges get the next rank
    assert s.execute("MATCH (a {id: 13}), (b {id: 14}) INSERT (a)-[:LINE {km: 6.0}]->(b)").mutations == 1
    assert s.execute("MATCH (a {id: 13})-[e:LINE]->(b {id: 14}) RETURN ELEMENT_ID(e) AS k ORDER BY k").collect() == [(f"13-LINE-14-{k}",) for k in range(3)]
    for bad in ("INSERT (a)-[:X]-(b)", "INSERT (a)-[:X|Y]->(b)", "INSERT (a)-[]->(b)", "INSERT (:A|B)"):
        with pytest.raises(GqlSyntaxError):
            s.execute(bad)


def test_what_an_update_shows(rail):
    """Rows keep the bindings they came with; a later MATCH sees the change."""
    s = Session(rail)
    assert s.execute("MATCH (n {id: 12}) SET n.tracks = 9 RETURN n.tracks").collect() == [(2,)]
    assert s.execute("MATCH (n {id: 12}) SET n.tracks = 8 MATCH (m {id: 12}) RETURN m.tracks").collect() == [(8,)]


def test_delete(rail):
    s = Session(rail)
    with pytest.raises(DataError):
        s.execute("MATCH (n {id: 13}) DELETE n")
    # rows that name an element twice delete it once
    assert s.execute("MATCH (a {id: 13})-[l:LINE]->(b {id: 14}), (a)-[x]->(b) DELETE l").mutations == 2
    assert s.execute("MATCH (a {id: 21})-[e]->() DELETE e, a").mutations == 2
    assert s.execute("MATCH (n) RETURN COUNT(*)").collect() == [(4,)]
    assert s.execute("MATCH (n {id: 14}) DETACH DELETE n").mutations == 1
    assert s.execute("MATCH ()-[e]->() RETURN COUNT(*)").collect() == [(3,)]
    # null is no element
    assert s.execute("MATCH (n {id: 11}) OPTIONAL MATCH (n)-[:NOTHING]->(m) DELETE m").mutations == 0
    with pytest.raises(GqlSyntaxError):
        s.execute("MATCH (n) DELETE nobody")


def test_transactions(rail):
    store = GraphStore(rail)
    s, count = Session(store), "MATCH (n:Tmp) RETURN COUNT(*)"
    s.execute("START TRANSACTION READ WRITE")
    s.execute("FOR k IN [91, 92] INSERT (:Tmp {id: k})")
    assert s.execute(count).collect() == [(2,)] and Session(store).execute(count).collect() == [(0,)]
    s.execute("ROLLBACK WORK")
    assert s.execute(count).collect() == [(0,)]
    s.execute("START TRANSACTION")
    s.execute("INSERT (:Tmp)")
    Session(store).execute("INSERT (:Tmp)")
    with pytest.raises(SerializationConflict):
        s.execute("COMMIT")
    assert not s.in_transaction and s.execute(count).collect() == [(1,)]
    s.execute("START TRANSACTION READ ONLY")
    with pytest.raises(InvalidParameter):
        s.execute("INSERT (:Tmp)")
    for text in ("COMMIT", "START TRANSACTION"):
        if text == "START TRANSACTION":
            s.execute(text)
        with pytest.raises(InvalidParameter):
            s.execute(text)
    s.execute("ROLLBACK")
    with pytest.raises(InvalidParameter):
        s.set_isolation("SNAPSHOT")


def test_a_lone_statement_is_tried_again(rail):
    """Another commit comes between snapshot and commit, twice."""

    class Crowded(GraphStore):
        left = 2

        def commit(self, base, graph):
            if threading.current_thread() is threading.main_thread() and self.left:
                self.left -= 1
                other = threading.Thread(target=lambda: GraphStore.commit(self, base, self.graph))
                other.start()
                other.join()
            return super().commit(base, graph)

    store = Crowded(rail)
    assert Session(store).execute("INSERT (:Tmp {id: 99})").mutations == 1
    assert store.version == 3 and store.left == 0 and query(store.graph, "MATCH (n:Tmp) RETURN n.id").collect()[0][0] == 99


def test_a_dangling_edge_leads_nowhere(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    links = spark.createDataFrame([(1, 2), (2, 5), (5, 1)], "src long, dst long")
    g = PropertyGraph(spark).with_nodes(nodes, "N").with_edges(links, "L")
    assert rows(g, "MATCH (a)-[:L]->(b) RETURN a.id, b.id") == [(1, 2)]
    assert rows(g, "MATCH (a)-[:L]->{1,3}(b) RETURN a.id, b.id") == [(1, 2)]
    assert g.scan_edges().where(F.col("$src") == 5).count() == 1
