"""The engine's queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks, versions
from .session import Session, query
from .sources.graph import PropertyGraph
from .sources.tpch import documents_graph, events_graph, tpch_graph, turns_graph

Q: dict[str, tuple[Callable, str | None]] = {}
GRAPHS = {"tpch": tpch_graph, "events": events_graph, "turns": turns_graph, "documents": documents_graph}
ORD = 10**12


#: Graphs that were opened, as long as their session lasts: a graph is the tables' names and schemas, no rows.
_open: dict[tuple, PropertyGraph] = {}


def opened(graph: str, spark: SparkSession, sf_dir: str) -> PropertyGraph:
    key = (graph, sf_dir, spark.sparkContext.applicationId, id(spark))
    if key not in _open:
        _open[key] = GRAPHS[graph](spark, sf_dir)
    return _open[key]


def gql(name: str, text: str, sql: str | None, graph: str = "tpch", **params) -> None:
    Q[name] = (lambda spark, sf_dir: query(opened(graph, spark, sf_dir), text, params), sql)


def frame(name: str, sql: str | None):
    def add(make):
        Q[name] = (make, sql)
        return make

    return add


# --- scans and patterns
FLAGSHIP = "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > $x RETURN c.c_name AS name, o.o_orderkey AS k, o.o_totalprice AS price ORDER BY price DESC, k LIMIT 10"
gql("flagship_orders", FLAGSHIP, "SELECT c_name AS name, o_orderkey AS k, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 ORDER BY price DESC, k LIMIT 10", x=1000.0)
gql("node_scan", "MATCH (n:Nation) RETURN n.id AS id, n.n_name AS name", f"SELECT 2 * {ORD} + n_nationkey AS id, n_name AS name FROM nation")
gql("node_point_lookup", f"MATCH (c {{id: {3 * ORD + 7}}}) RETURN c.c_name AS name, c.c_acctbal AS bal", "SELECT c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey = 7")
gql("label_and_not", "MATCH (e:Event&!click) RETURN e.event_type AS t, ELEMENT_ID(e) AS id", f"SELECT event_type AS t, 8 * {ORD} + event_id AS id FROM events WHERE event_type <> 'click'", "events")
gql("label_or", "MATCH (n:Region|Nation) RETURN n.id AS id", f"SELECT {ORD} + r_regionkey AS id FROM region UNION ALL SELECT 2 * {ORD} + n_nationkey FROM nation")
gql("label_wildcard", "MATCH (n:%) RETURN COUNT(*) AS n", "SELECT (SELECT count(*) FROM events) + (SELECT count(DISTINCT user_id) FROM events) AS n", "events")
gql("one_hop_out", "MATCH (c:Customer)-[:PLACED]->(o) RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT o_custkey AS c, o_orderkey AS o FROM orders")
gql("one_hop_in", "MATCH (o:Order)<-[:PLACED]-(c) WHERE o.o_orderstatus = 'F' RETURN o.o_orderkey AS o, c.c_name AS name", "SELECT o_orderkey AS o, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
gql("one_hop_any", "MATCH (t:Turn)-[:NEXT]-(u) RETURN t.id AS a, u.id AS b", f"WITH t AS (SELECT 9 * {ORD} + conv_id * 1000 + turn AS id, turn FROM conversations), e AS (SELECT id - 1 AS s, id AS d FROM t WHERE turn > 0) SELECT s AS a, d AS b FROM e WHERE s IN (SELECT id FROM t) UNION ALL SELECT d, s FROM e WHERE s <> d AND s IN (SELECT id FROM t)", "turns")
gql("two_hop", "MATCH (c:Customer)-[:IN_NATION]->(n)-[:IN_REGION]->(r) RETURN r.r_name AS region, c.c_custkey AS c", "SELECT r_name AS region, c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
gql("three_hop_revenue", "MATCH (r:Region {r_name: 'ASIA'})<-[:IN_REGION]-(n)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o) RETURN COUNT(*) AS n, SUM(CAST(o.o_totalprice * 100 AS INT)) AS cents", "SELECT count(*) AS n, sum(trunc(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE r_name = 'ASIA'")
gql("repeated_var_cycle", "MATCH (s:Supplier)-[:IN_NATION]->(n)<-[:IN_NATION]-(c:Customer), (c)-[:PLACED]->(o)-[:CONTAINS]->(p)-[:SUPPLIED_BY]->(s) RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM supplier JOIN customer ON c_nationkey = s_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem) x ON x.p = l_partkey AND x.s = s_suppkey")
HOPS = f"WITH t AS (SELECT 9 * {ORD} + conv_id * 1000 + turn AS id, turn FROM conversations), e AS (SELECT id - 1 AS s, id AS d FROM t WHERE turn > 0 AND id - 1 IN (SELECT id FROM t)), "
gql("hops_1_2", "MATCH (t:Turn)-[:NEXT]->{1,2}(u) RETURN t.id AS a, u.id AS b", HOPS + "w AS (SELECT s, d FROM e UNION ALL SELECT x.s, y.d FROM e x JOIN e y ON x.d = y.s) SELECT s AS a, d AS b FROM w", "turns")
gql("hops_exact_2", "MATCH (t:Turn)-[w:NEXT]->{2}(u) RETURN t.id AS a, u.id AS b, SIZE(w) AS n", HOPS + "w AS (SELECT x.s, y.d FROM e x JOIN e y ON x.d = y.s) SELECT s AS a, d AS b, 2::BIGINT AS n FROM w", "turns")
gql("hops_0_2", "MATCH (t:Turn {role: 'user'})-[:NEXT]->{0,2}(u) RETURN t.id AS a, u.id AS b", HOPS + f"w AS (SELECT id AS s, id AS d FROM t UNION ALL SELECT s, d FROM e UNION ALL SELECT x.s, y.d FROM e x JOIN e y ON x.d = y.s) SELECT s AS a, d AS b FROM w WHERE s IN (SELECT 9 * {ORD} + conv_id * 1000 + turn FROM conversations WHERE role = 'user')", "turns")
gql("hops_left_3", "MATCH (t:Turn)<-[:NEXT]-{3}(u) RETURN COUNT(*) AS n", HOPS + "w AS (SELECT x.s, z.d FROM e x JOIN e y ON x.d = y.s JOIN e z ON y.d = z.s) SELECT count(*) AS n FROM w", "turns")
gql("edge_props", "MATCH (o:Order)-[l:CONTAINS {flag: 'R'}]->(p) WHERE l.quantity > 45 RETURN o.o_orderkey AS o, p.p_partkey AS p, l.price AS price", "SELECT l_orderkey AS o, l_partkey AS p, l_extendedprice AS price FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45")
gql("edge_where", "MATCH (o)-[l:CONTAINS WHERE l.discount >= 0.1]->(p) RETURN COUNT(*) AS n, COUNT(DISTINCT p) AS parts", "SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts FROM lineitem WHERE l_discount >= 0.1")
gql("parallel_edges", "MATCH (o)-[l:CONTAINS]->(p) WHERE PROPERTY_EXISTS(l, quantity) FILTER ELEMENT_ID(l) <> 'x' LET k = ELEMENT_ID(l) RETURN COUNT(*) AS n, COUNT(DISTINCT k) AS ids", "SELECT count(*) AS n, count(*) AS ids FROM lineitem")
gql("comma_paths_join", "MATCH (c:Customer)-[:IN_NATION]->(n), (s:Supplier)-[:IN_NATION]->(n) RETURN c.c_custkey AS c, s.s_suppkey AS s", "SELECT c_custkey AS c, s_suppkey AS s FROM customer JOIN supplier ON c_nationkey = s_nationkey")
gql("cross_product", "MATCH (r:Region), (n:Nation) RETURN r.r_name AS r, n.n_name AS n", "SELECT r_name AS r, n_name AS n FROM region CROSS JOIN nation")
gql("theta_join", "MATCH (a:Nation), (b:Nation) WHERE a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey RETURN a.n_name AS a, b.n_name AS b", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
gql("optional_match", "MATCH (d:Document) OPTIONAL MATCH (d)-[:RATED]->(r) RETURN d.doc_id AS d, r.quality AS q", "SELECT documents.doc_id AS d, quality::BIGINT AS q FROM documents LEFT JOIN labels USING (doc_id)", "documents")
gql("optional_where", "MATCH (d:Document) OPTIONAL MATCH (d)-[:RATED]->(r) WHERE r.toxic = 1 AND d.lang = 'en' RETURN d.doc_id AS d, r.toxic AS t", "SELECT d.doc_id AS d, l.toxic::BIGINT AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 1 AND d.lang = 'en'", "documents")
gql("optional_inline", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o WHERE o.o_totalprice > 400000) RETURN c.c_custkey AS c, o.o_orderkey AS o", "SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000")
gql("exists_semi", "MATCH (c:Customer) WHERE EXISTS {(c)-[:PLACED]->(o WHERE o.o_orderpriority = '1-URGENT')} RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
gql("not_exists_anti", "MATCH (d:Document) WHERE NOT EXISTS {(d)-[:RATED]->()} RETURN d.doc_id AS d", "SELECT doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "documents")
gql("exists_projection", "MATCH (d:Document) RETURN d.doc_id AS d, EXISTS {(d)-[:RATED]->(r {quality: 1})} AS good", "SELECT doc_id AS d, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents", "documents")
gql("use_graph", "USE default MATCH (r:Region) RETURN r.r_name AS name", "SELECT r_name AS name FROM region")
gql("walk_prefix", "MATCH WALK PATH (n:Nation)->(r:Region) RETURN n.n_name AS n, r.r_name AS r", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
gql("source_dest_of", "MATCH (n:Nation)-[e:IN_REGION]->(r) WHERE n IS SOURCE OF e AND r IS DESTINATION OF e AND e IS DIRECTED AND n IS NOT DESTINATION OF e RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM nation")
gql("is_labeled", "MATCH (n) WHERE n IS LABELED Region OR n IS :Supplier RETURN COUNT(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM supplier) AS n")
gql("element_id", "MATCH (n:Nation)-[e]->(r) RETURN ELEMENT_ID(n) AS n, ELEMENT_ID(e) AS e", f"SELECT 2 * {ORD} + n_nationkey AS n, concat_ws('-', 2 * {ORD} + n_nationkey, 'IN_REGION', {ORD} + n_regionkey, 0) AS e FROM nation")
gql("same_all_different", "MATCH (a:Nation)-[:IN_REGION]->(r)<-[:IN_REGION]-(b:Nation) WHERE ALL_DIFFERENT(a, b) RETURN a.n_name AS a, b.n_name AS b, SAME(a, b) AS s", "SELECT a.n_name AS a, b.n_name AS b, FALSE AS s FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey <> b.n_nationkey")
gql("property_exists", "MATCH (n) WHERE PROPERTY_EXISTS(n, s_name) RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM supplier")
gql("user_spend", "MATCH (u:User {user_id: 3})-[:EMITTED]->(e:purchase) RETURN e.event_id AS e, e.value AS v", "SELECT event_id AS e, value AS v FROM events WHERE user_id = 3 AND event_type = 'purchase'", "events")

# --- rows
gql("filter_3vl", "MATCH (d:Document) OPTIONAL MATCH (d)-[:RATED]->(r) FILTER r.quality = 1 OR r.toxic = 0 OR d.doc_id < 5 RETURN d.doc_id AS d", "SELECT documents.doc_id AS d FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 1 OR toxic = 0 OR documents.doc_id < 5", "documents")
gql("let_chain", "MATCH (p:Part) LET a = p.p_size * 2, b = a + 1 LET a = b - a RETURN p.p_partkey AS p, a AS a, b AS b", "SELECT p_partkey AS p, 1::BIGINT AS a, p_size::BIGINT * 2 + 1 AS b FROM part")
gql("for_unnest", "MATCH (n:Nation) FOR x IN [n.n_nationkey, n.n_regionkey] RETURN n.n_name AS n, x AS x", "SELECT n_name AS n, unnest([n_nationkey, n_regionkey])::BIGINT AS x FROM nation")
gql("for_empty", "MATCH (n:Nation) FOR x IN NULL RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE FALSE")
gql("return_star", "MATCH (r:Region) LET name = r.r_name LET key = r.r_regionkey FILTER key > 1 LET r = 0 RETURN *", "SELECT r_regionkey::BIGINT AS key, r_name AS name, 0::BIGINT AS r FROM region WHERE r_regionkey > 1")
gql("distinct", "MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
for kind, way, sql in (("asc", "ORDER BY q, d", "q ASC NULLS LAST"), ("desc", "ORDER BY q DESC, d", "q DESC NULLS FIRST"), ("asc_first", "ORDER BY q NULLS FIRST, d", "q ASC NULLS FIRST"), ("desc_last", "ORDER BY q DESC NULLS LAST, d", "q DESC NULLS LAST")):
    gql(f"order_nulls_{kind}", f"MATCH (d:Document) OPTIONAL MATCH (d)-[:RATED]->(r) RETURN d.doc_id AS d, r.quality AS q {way} OFFSET 3 LIMIT 20", f"SELECT documents.doc_id AS d, quality::BIGINT AS q FROM documents LEFT JOIN labels USING (doc_id) ORDER BY {sql}, d LIMIT 20 OFFSET 3", "documents")
gql("offset_limit", "MATCH (p:Part) RETURN p.p_partkey AS p ORDER BY p.p_retailprice DESC, p SKIP 5 LIMIT 7", "SELECT p_partkey AS p FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 7 OFFSET 5")
gql("order_unprojected", "MATCH (n:Nation) RETURN n.n_name AS n ORDER BY n.n_nationkey DESC LIMIT 3", "SELECT n_name AS n FROM nation ORDER BY n_nationkey DESC LIMIT 3")
gql("count_star", "MATCH ()-[e:CONTAINS]->() RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM lineitem")
gql("count_distinct", "MATCH (o:Order) RETURN COUNT(DISTINCT o.o_custkey) AS c, COUNT(o.o_custkey) AS n", "SELECT count(DISTINCT o_custkey) AS c, count(*) AS n FROM orders")
gql("sum_avg_min_max", "MATCH (p:Part) RETURN SUM(p.p_size) AS s, AVG(p.p_size) AS a, MIN(p.p_name) AS lo, MAX(p.p_name) AS hi, SUM(DISTINCT p.p_size) AS d", "SELECT sum(p_size)::BIGINT AS s, avg(p_size) AS a, min(p_name) AS lo, max(p_name) AS hi, sum(DISTINCT p_size)::BIGINT AS d FROM part")
gql("agg_empty", "MATCH (p:Part) WHERE p.p_size < 0 RETURN COUNT(*) AS n, SUM(p.p_size) AS s, MIN(p.p_size) AS m", "SELECT 0::BIGINT AS n, NULL::BIGINT AS s, NULL::BIGINT AS m")
gql("case_simple", "MATCH (o:Order) RETURN o.o_orderkey AS o, CASE o.o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s", "SELECT o_orderkey AS o, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s FROM orders")
gql("case_searched", "MATCH (p:Part) RETURN p.p_partkey AS p, CASE WHEN p.p_size > 30 THEN 'big' WHEN p.p_size > 10 THEN 'mid' END AS s", "SELECT p_partkey AS p, CASE WHEN p_size > 30 THEN 'big' WHEN p_size > 10 THEN 'mid' END AS s FROM part")
gql("in_list_null", "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_nationkey IN [1, 2, NULL] AS i, n.n_nationkey NOT IN [1] AS o", "SELECT n_nationkey::BIGINT AS k, n_nationkey IN (1, 2) AS i, n_nationkey <> 1 AS o FROM nation")
gql("is_typed", "MATCH (p:Part) RETURN p.p_partkey AS p, p.p_size IS TYPED INT AS i, p.p_name IS TYPED INT AS s, p.p_retailprice IS NOT TYPED FLOAT AS f", "SELECT p_partkey AS p, TRUE AS i, FALSE AS s, FALSE AS f FROM part")
gql("cast_matrix", "MATCH (p:Part) RETURN p.p_partkey AS p, CAST(p.p_retailprice AS INT) AS i, CAST(p.p_size AS STRING) AS s, CAST(' 12 ' AS INT) AS t, CAST(p.p_size > 10 AS STRING) AS b, CAST(p.p_size AS FLOAT) AS f", "SELECT p_partkey AS p, trunc(p_retailprice)::BIGINT AS i, p_size::VARCHAR AS s, 12::BIGINT AS t, upper((p_size > 10)::VARCHAR) AS b, p_size::DOUBLE AS f FROM part")
gql("math_fns", "MATCH (p:Part) RETURN p.p_partkey AS p, ABS(10 - p.p_size) AS a, FLOOR(p.p_retailprice) AS f, CEIL(p.p_retailprice) AS c, FLOOR(SQRT(p.p_size) * 1000) AS q, MOD(p.p_size, 7) AS m", "SELECT p_partkey AS p, abs(10 - p_size)::BIGINT AS a, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, floor(sqrt(p_size) * 1000) AS q, (p_size % 7)::BIGINT AS m FROM part")
gql("trig_fns", "MATCH (n:Nation) LET x = CAST(n.n_nationkey AS FLOAT) / 10 RETURN n.n_nationkey AS k, FLOOR(SIN(x) * 1e6) AS s, FLOOR(COS(x) * 1e6) AS c, FLOOR(ATAN(x) * 1e6) AS a, FLOOR(DEGREES(x)) AS d", "SELECT n_nationkey::BIGINT AS k, floor(sin(n_nationkey / 10) * 1e6) AS s, floor(cos(n_nationkey / 10) * 1e6) AS c, floor(atan(n_nationkey / 10) * 1e6) AS a, floor(degrees(n_nationkey / 10)) AS d FROM nation")
gql("string_fns", "MATCH (p:Part) RETURN p.p_partkey AS p, UPPER(p.p_name) AS u, LOWER(p.p_type) AS l, CHAR_LENGTH(p.p_name) AS n, BYTE_LENGTH(p.p_name) AS b, LEFT(p.p_name, 3) AS x, RIGHT(p.p_name, 2) AS y, p.p_brand || '/' || p.p_type AS j", "SELECT p_partkey AS p, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, strlen(p_name) AS b, left(p_name, 3) AS x, right(p_name, 2) AS y, p_brand || '/' || p_type AS j FROM part")
gql("trim_variants", "MATCH (n:Nation) LET s = '  xx' || n.n_name || 'xx ' RETURN TRIM(s) AS a, TRIM(LEADING ' x' FROM s) AS b, BTRIM(s, ' x') AS c, RTRIM(s) AS d, LTRIM(s) AS e", "SELECT 'xx' || n_name || 'xx' AS a, ltrim('  xx' || n_name || 'xx ', ' x') AS b, trim('  xx' || n_name || 'xx ', ' x') AS c, '  xx' || n_name || 'xx' AS d, 'xx' || n_name || 'xx ' AS e FROM nation")
gql("bytes_fns", "MATCH (n:Nation) LET b = CAST(n.n_name AS BYTES) RETURN n.n_nationkey AS k, BYTE_LENGTH(b || X'00FF') AS n, BYTE_LENGTH(BTRIM(X'0001' || b || X'00', X'0001')) AS t", "SELECT n_nationkey::BIGINT AS k, strlen(n_name) + 2 AS n, strlen(n_name) AS t FROM nation")
gql("list_size", "MATCH (n:Nation) RETURN n.n_nationkey AS k, SIZE([n.n_name, NULL]) AS s, CARDINALITY({a: 1, b: n.n_name}) AS c", "SELECT n_nationkey::BIGINT AS k, 2::BIGINT AS s, 2::BIGINT AS c FROM nation")
gql("nullif_coalesce", "MATCH (d:Document) OPTIONAL MATCH (d)-[:RATED]->(r) RETURN d.doc_id AS d, COALESCE(r.quality, -1) AS q, NULLIF(r.quality, r.toxic) AS n", "SELECT documents.doc_id AS d, coalesce(quality, -1)::BIGINT AS q, CASE WHEN toxic IS NULL THEN NULL ELSE nullif(quality, toxic) END::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id)", "documents")
gql("int_div_mod", "MATCH (p:Part) LET x = 20 - p.p_size RETURN p.p_partkey AS p, x / 7 AS d, x % 7 AS m", "SELECT p_partkey AS p, ((20 - p_size) // 7)::BIGINT AS d, ((20 - p_size) % 7)::BIGINT AS m FROM part")
gql("decimal_arith", "MATCH (p:Part) LET x = CAST(p.p_size AS DECIMAL) RETURN p.p_partkey AS p, CAST(x + 0.25 AS FLOAT) AS a, CAST(x * 1.50 AS FLOAT) AS b, x / 4.0 AS c", "SELECT p_partkey AS p, p_size + 0.25::DOUBLE AS a, p_size * 1.5::DOUBLE AS b, p_size / 4.0::DOUBLE AS c FROM part")
gql("double_by_zero", "MATCH (p:Part) LET x = CAST(p.p_size AS FLOAT) RETURN p.p_partkey AS p, x / 0e0 > 1e300 AS inf, (0e0 / 0e0) = x AS nan", "SELECT p_partkey AS p, TRUE AS inf, FALSE AS nan FROM part")
gql("records", "MATCH (n:Nation) LET r = {name: n.n_name, at: {region: n.n_regionkey}} RETURN r.name AS n, r.at.region AS g, r.missing IS NULL AS m", "SELECT n_name AS n, n_regionkey::BIGINT AS g, TRUE AS m FROM nation")
gql("timestamps", "MATCH (o:Order) WHERE o.o_orderdate >= TIMESTAMP '1995-01-01T00:00:00Z' AND o.o_orderdate < TIMESTAMP '1995-02-01T01:00:00+01:00' RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-02-01'")
gql("xor_not", "MATCH (p:Part) WHERE p.p_size > 25 XOR p.p_retailprice > 1000 RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM part WHERE (p_size > 25) <> (p_retailprice > 1000)")


# --- updates: a change, then a read of the new version
def after(name: str, changes: list[str], text: str, sql: str | None, graph: str = "tpch") -> None:
    def make(spark, sf_dir):
        s = Session(GRAPHS[graph](spark, sf_dir))
        for c in changes:
            s.execute(c)
        return s.execute(text).rows

    Q[name] = (make, sql)


after("insert_nodes", ["MATCH (n:Nation) WHERE n.n_nationkey < 3 INSERT (:Capital {of: n.n_name, id: n.n_nationkey})"], "MATCH (c:Capital) RETURN c.of AS o, c.id AS id", "SELECT n_name AS o, n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey < 3")
after("insert_edges_rank", ["MATCH (n:Nation)-[:IN_REGION]->(r) INSERT (n)-[:IN_REGION {again: TRUE}]->(r)"], "MATCH (n:Nation)-[e:IN_REGION]->(r) RETURN ELEMENT_ID(e) AS e, e.again AS a", f"SELECT concat_ws('-', 2 * {ORD} + n_nationkey, 'IN_REGION', {ORD} + n_regionkey, k) AS e, CASE k WHEN 1 THEN TRUE END AS a FROM nation, (VALUES (0), (1)) v(k)")
after("set_props", ["MATCH (p:Part) WHERE p.p_size > 40 SET p.p_size = p.p_size - 40, p.note = 'cut'"], "MATCH (p:Part) RETURN p.p_partkey AS p, p.p_size AS s, p.note AS n", "SELECT p_partkey AS p, CASE WHEN p_size > 40 THEN p_size - 40 ELSE p_size END::BIGINT AS s, CASE WHEN p_size > 40 THEN 'cut' END AS n FROM part")
after("set_label", ["MATCH (s:Supplier) WHERE s.s_acctbal < 0 SET s:Debtor"], "MATCH (s:Supplier&Debtor) RETURN s.s_suppkey AS s", "SELECT s_suppkey AS s FROM supplier WHERE s_acctbal < 0")
after("remove_label", ["MATCH (n:Nation) WHERE n.n_regionkey = 0 REMOVE n:Nation"], "MATCH (n:Nation) RETURN n.n_name AS n", "SELECT n_name AS n FROM nation WHERE n_regionkey <> 0")
after("remove_prop", ["MATCH (n:Nation) WHERE n.n_regionkey = 0 REMOVE n.n_name"], "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS n", "SELECT n_nationkey::BIGINT AS k, CASE WHEN n_regionkey <> 0 THEN n_name END AS n FROM nation")
after("set_edge_prop", ["MATCH ()-[e:IN_REGION]->(r {r_name: 'ASIA'}) SET e.w = 2"], "MATCH (n)-[e:IN_REGION]->(r) RETURN n.n_nationkey AS n, e.w AS w", "SELECT n_nationkey::BIGINT AS n, CASE WHEN r_name = 'ASIA' THEN 2::BIGINT END AS w FROM nation JOIN region ON n_regionkey = r_regionkey")
after("detach_delete", ["MATCH (c:Customer) WHERE c.c_acctbal < 0 DETACH DELETE c"], "MATCH (c:Customer)-[e:PLACED]->(o) RETURN COUNT(*) AS n, COUNT(DISTINCT c) AS c", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0")
after("delete_edges", ["MATCH ()-[e:PLACED]->(o {o_orderstatus: 'F'}) DELETE e"], "MATCH (c)-[e:PLACED]->(o) RETURN COUNT(*) AS n", "SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F'")


@frame("delete_refused", "SELECT CASE WHEN EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey) THEN '23000' ELSE 'deleted' END AS state")
def delete_refused(spark, sf_dir):
    from .errors import DataError

    try:
        Session(tpch_graph(spark, sf_dir)).execute("MATCH (r:Region) DELETE r")
        state = "deleted"
    except DataError as e:
        state = e.sqlstate
    return spark.createDataFrame([(state,)], "state string")


@frame("bulk_edges", "SELECT s_suppkey % 10 AS hub, count(*) AS n, max(s_suppkey // 10) AS top FROM supplier GROUP BY ALL")
def bulk_edges(spark, sf_dir):
    from .operators.mutation import Mutator
    from .plans.matching import Matcher

    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    g = PropertyGraph(spark).with_nodes(s.select(F.col("s_suppkey").alias("id")), "S")
    edges = s.select((F.col("s_suppkey") % 10).alias("$src"), F.col("s_suppkey").alias("$dst"), F.expr("s_suppkey div 10").alias("$rank"))
    g = Mutator(Matcher(g, {}, {})).bulk_edges(edges, "TO")
    return g.scan_edges().groupBy(F.col("$src").alias("hub")).agg(F.count(F.lit(1)).alias("n"), F.max("$rank").alias("top"))


@frame("bounded_adjacency", "SELECT c, o, k FROM (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 2")
def bounded_adjacency(spark, sf_dir):
    out = tpch_graph(spark, sf_dir).bounded_adjacency(2, type="PLACED")
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("$src").orderBy("$dst")).cast("long")
    return out.select((F.col("$src") - 3 * ORD).alias("c"), (F.col("$dst") - 6 * ORD).alias("o"), place.alias("k"))


# --- versioned keys: events as versions of users' keys
def _versions(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), F.col("event_id").alias("commit_ts"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("value"))


V = "WITH v AS (SELECT 'u' || lpad(user_id::VARCHAR, 6, '0') AS key, event_id AS ts, CASE WHEN event_type <> 'error' THEN event_type END AS value FROM events), l AS (SELECT key, arg_max(struct_pack(v := value), ts).v AS value FROM v WHERE ts <= 700 GROUP BY key), live AS (SELECT * FROM l WHERE value IS NOT NULL) "


@frame("mvcc_latest_asof", V + "SELECT key, value FROM live")
def mvcc_latest(spark, sf_dir):
    return versions.latest(_versions(spark, sf_dir), 700)


@frame("mvcc_scan", V + "SELECT key, value FROM live WHERE key >= 'u000010' AND key < 'u000050' ORDER BY key LIMIT 15")
def mvcc_scan(spark, sf_dir):
    return versions.scan(_versions(spark, sf_dir), "u000010", "u000050", 700, limit=15)


OWN = "o AS (SELECT DISTINCT 'u' || lpad(user_id::VARCHAR, 6, '0') AS key, CASE WHEN user_id % 3 = 0 THEN 'mine' END AS value FROM events WHERE user_id % 2 = 0) "


@frame("mvcc_overlay", V + ", " + OWN + "SELECT key, value FROM live WHERE key NOT IN (SELECT key FROM o) UNION ALL SELECT key, value FROM o WHERE value IS NOT NULL")
def mvcc_overlay(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 2 = 0").select("user_id").distinct()
    own = e.select(F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), F.when(F.col("user_id") % 3 == 0, "mine").alias("value"))
    return versions.overlay(versions.latest(_versions(spark, sf_dir), 700), own)


@frame("write_conflicts", "SELECT DISTINCT 'u' || lpad(user_id::VARCHAR, 6, '0') AS key FROM events WHERE event_id > 700 AND user_id < 40")
def write_conflicts(spark, sf_dir):
    v = _versions(spark, sf_dir)
    writes = v.where("key < 'u000040'").select("key").distinct()
    return versions.write_conflicts(writes, v, spark.createDataFrame([], "key string, txn_id string"), 700, "t")


SPANS = [("u000003", "u000005"), ("u000020", "u000021"), ("u000090", ""), ("x", "y")]


@frame("read_conflicts", "SELECT s AS span_start, e AS span_end FROM (VALUES ('u000003', 'u000005'), ('u000020', 'u000021'), ('u000090', ''), ('x', 'y')) t(s, e) WHERE EXISTS (SELECT 1 FROM events WHERE event_id > 700 AND event_id <= 760 AND 'u' || lpad(user_id::VARCHAR, 6, '0') >= s AND (e = '' OR 'u' || lpad(user_id::VARCHAR, 6, '0') < e))")
def read_conflicts(spark, sf_dir):
    return versions.read_conflicts(spark.createDataFrame(SPANS, "span_start string, span_end string"), _versions(spark, sf_dir), spark.createDataFrame([], "key string, txn_id string"), 700, 760, "t")


RANGES = [(1, "", "u000030"), (2, "u000030", "u000060"), (3, "u000060", "")]


@frame("range_clip", "SELECT s AS span_start, e AS span_end, r AS range_id, greatest(s, a) AS clip_start, CASE WHEN b = '' THEN e WHEN e = '' THEN b ELSE least(e, b) END AS clip_end FROM (VALUES ('u000003', 'u000065'), ('u000030', 'u000031'), ('u000050', '')) t(s, e), (VALUES (1::BIGINT, '', 'u000030'), (2, 'u000030', 'u000060'), (3, 'u000060', '')) g(r, a, b) WHERE (s < b OR b = '') AND (a < e OR e = '')")
def range_clip(spark, sf_dir):
    spans = spark.createDataFrame([("u000003", "u000065"), ("u000030", "u000031"), ("u000050", "")], "span_start string, span_end string")
    return versions.clip(spans, spark.createDataFrame(RANGES, "range_id long, start_key string, end_key string")).select("span_start", "span_end", "range_id", "clip_start", "clip_end")


CLIPPED = """SELECT s AS span_start, e AS span_end, r AS range_id, greatest(s, a) AS clip_start, least(e, b) AS clip_end FROM
(SELECT DISTINCT 'u' || lpad(user_id::VARCHAR, 6, '0') AS s, 'u' || lpad((user_id + 7)::VARCHAR, 6, '0') AS e FROM events),
(SELECT DISTINCT user_id // 5 AS r, 'u' || lpad((user_id // 5 * 5)::VARCHAR, 6, '0') AS a, 'u' || lpad((user_id // 5 * 5 + 5)::VARCHAR, 6, '0') AS b FROM events) WHERE s < b AND a < e"""


def _key(user):
    return F.concat(F.lit("u"), F.lpad(user.cast("string"), 6, "0"))


@frame("range_clip_whole", CLIPPED)
def range_clip_whole(spark, sf_dir):
    """Spans of seven users from each on, cut at ranges of five, by the way for many ranges."""
    user = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("u")).distinct()
    spans = user.select(_key(F.col("u")).alias("span_start"), _key(F.col("u") + 7).alias("span_end"))
    first = F.expr("u div 5")
    ranges = user.select(first.alias("range_id")).distinct().select("range_id", _key(F.col("range_id") * 5).alias("start_key"), _key(F.col("range_id") * 5 + 5).alias("end_key"))
    return versions.clip(spans, ranges, broadcast_ranges=0).select("span_start", "span_end", "range_id", "clip_start", "clip_end")


@frame("value_histogram", "SELECT event_type AS op, le, count(value) FILTER (le IS NULL OR value <= le) AS n FROM events, (VALUES (10.0::DOUBLE), (50.0), (NULL)) t(le) GROUP BY event_type, le")
def value_histogram(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("op"), "value")
    return checks.histogram(e, [10.0, 50.0], value="value").select("op", "le", "n")


@frame("hub_spread_whole", "SELECT user_id AS hub, count(DISTINCT event_id // 1000) AS n_ranges FROM events GROUP BY user_id")
def hub_spread_whole(spark, sf_dir):
    """In how many ranges of a thousand events the events of each user lie: their keys are routed to the ranges' starts."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("hub"), F.col("event_id").cast("long").alias("e"))
    key = lambda c: F.lpad(c.cast("string"), 12, "0")
    start = e.select(F.expr("e div 1000").alias("range_id")).distinct()
    ranges = start.select("range_id", key(F.col("range_id") * 1000).alias("start_key"), key(F.col("range_id") * 1000 + 1000).alias("end_key"))
    routed = versions.route(e.select(key(F.col("e")).alias("key")), ranges)
    return e.withColumn("key", key(F.col("e"))).join(routed, "key").groupBy("hub").agg(F.count_distinct("range_id").alias("n_ranges"))


@frame("route_keys", "SELECT 'u' || lpad(user_id::VARCHAR, 6, '0') AS key, CASE WHEN user_id < 30 THEN 1 WHEN user_id < 60 THEN 2 ELSE 3 END::BIGINT AS range_id FROM events")
def route_keys(spark, sf_dir):
    return versions.route(_versions(spark, sf_dir).select("key"), spark.createDataFrame(RANGES, "range_id long, start_key string, end_key string"), 2)


@frame("live_stats_median", V + "SELECT count(*) AS n_keys, sum(length(key) + length(value))::BIGINT AS n_bytes, (SELECT key FROM live ORDER BY key LIMIT 1 OFFSET (SELECT count(*) // 2 FROM live)) AS median_key FROM live")
def live_stats(spark, sf_dir):
    return versions.live_stats(_versions(spark, sf_dir), 700)


# the same over the whole table: timestamps, keys and spans are taken from it
WHOLE = V.replace("ts <= 700", "ts <= (SELECT max(event_id) FROM events)")
MIDDLE = "(SELECT (min(event_id) + max(event_id)) // 2 FROM events)"


def _newest(v: DataFrame) -> tuple[int, int]:
    """The timestamps in the middle and at the end of a table of versions."""
    r = v.agg(F.min("commit_ts").alias("least"), F.max("commit_ts").alias("most")).first()
    return (0, 0) if r.most is None else ((r.least + r.most) // 2, r.most)


@frame("mvcc_latest_whole", WHOLE + "SELECT key, value FROM live")
def mvcc_latest_whole(spark, sf_dir):
    v = _versions(spark, sf_dir)
    return versions.latest(v, _newest(v)[1])


@frame("mvcc_scan_whole", WHOLE + "SELECT key, value FROM live ORDER BY key")
def mvcc_scan_whole(spark, sf_dir):
    v = _versions(spark, sf_dir)
    return versions.scan(v, "", "", _newest(v)[1])


@frame("mvcc_overlay_whole", WHOLE + ", " + OWN + "SELECT key, value FROM live WHERE key NOT IN (SELECT key FROM o) UNION ALL SELECT key, value FROM o WHERE value IS NOT NULL")
def mvcc_overlay_whole(spark, sf_dir):
    v = _versions(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 2 = 0").select("user_id").distinct()
    own = e.select(F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), F.when(F.col("user_id") % 3 == 0, "mine").alias("value"))
    return versions.overlay(versions.latest(v, _newest(v)[1]), own)


@frame("live_stats_whole", WHOLE + "SELECT count(*) AS n_keys, coalesce(sum(length(key) + length(value)), 0)::BIGINT AS n_bytes, (SELECT key FROM live ORDER BY key LIMIT 1 OFFSET (SELECT count(*) // 2 FROM live)) AS median_key FROM live")
def live_stats_whole(spark, sf_dir):
    v = _versions(spark, sf_dir)
    return versions.live_stats(v, _newest(v)[1])


@frame("write_conflicts_whole", f"SELECT DISTINCT 'u' || lpad(user_id::VARCHAR, 6, '0') AS key FROM events WHERE event_id > {MIDDLE}")
def write_conflicts_whole(spark, sf_dir):
    v = _versions(spark, sf_dir)
    return versions.write_conflicts(v.select("key").distinct(), v, spark.createDataFrame([], "key string, txn_id string"), _newest(v)[0], "t")


@frame("read_conflicts_whole", f"WITH s AS (SELECT DISTINCT user_id // 100 AS h FROM events) SELECT 'u' || lpad((h * 100)::VARCHAR, 6, '0') AS span_start, 'u' || lpad((h * 100 + 100)::VARCHAR, 6, '0') AS span_end FROM s WHERE h IN (SELECT user_id // 100 FROM events WHERE event_id > {MIDDLE})")
def read_conflicts_whole(spark, sf_dir):
    v = _versions(spark, sf_dir)
    hundred = F.floor(F.substring("key", 2, 6).cast("long") / 100) * 100
    name = lambda n: F.concat(F.lit("u"), F.lpad(n.cast("string"), 6, "0"))
    spans = v.select(hundred.alias("h")).distinct().select(name(F.col("h")).alias("span_start"), name(F.col("h") + 100).alias("span_end"))
    return versions.read_conflicts(spans, v, spark.createDataFrame([], "key string, txn_id string"), *_newest(v), "t")


# --- checks
@frame("bidirectional_check", "SELECT l_orderkey AS src, 'L' AS type, l_partkey AS dst, min(l_linenumber)::BIGINT AS rank, CASE WHEN l_orderkey % 11 = 0 THEN 'no incoming entry' ELSE 'values differ' END AS violation FROM lineitem WHERE l_orderkey % 11 = 0 OR l_orderkey % 13 = 0 GROUP BY l_orderkey, l_partkey")
def bidirectional_check(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.min("l_linenumber").cast("long").alias("rank"), F.max("l_quantity").alias("w")).withColumn("type", F.lit("L"))
    return checks.bidirectional(l, l.where("src % 11 <> 0").withColumn("w", F.when(F.col("src") % 13 == 0, -1.0).otherwise(F.col("w"))))


@frame("lost_update", "SELECT user_id::VARCHAR AS counter, count(*) FILTER (event_type <> 'error') AS acknowledged, count(*) AS value FROM events GROUP BY user_id HAVING count(*) FILTER (event_type <> 'error') <> count(*)")
def lost_update(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("counter", F.col("user_id").cast("string"))
    return checks.lost_updates(e.select("counter", (F.col("event_type") != "error").alias("acknowledged")), e.groupBy("counter").agg(F.count(F.lit(1)).alias("value")))


@frame("total_order", "SELECT conv_id::VARCHAR AS counter, count(*) AS n, count(DISTINCT turn) AS n_distinct, min(turn) AS least, max(turn) AS most FROM conversations WHERE turn <> 1 OR conv_id % 2 = 0 GROUP BY conv_id HAVING min(turn) <> 0 OR max(turn) <> count(*) - 1 OR count(DISTINCT turn) <> count(*)")
def total_order(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn <> 1 or conv_id % 2 = 0")
    return checks.total_order(c.select(F.col("conv_id").cast("string").alias("counter"), F.col("turn").alias("read_value"), F.lit(True).alias("acknowledged")))


@frame("single_leader", "SELECT o_custkey AS term, count(DISTINCT o_orderstatus) AS n_leaders FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def single_leader(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return checks.single_leader(o.select(F.col("o_custkey").alias("term"), F.col("o_orderstatus").alias("node")))


@frame("percentile_disc", "SELECT event_type AS op, percentile_disc(0.99) WITHIN GROUP (ORDER BY value) AS value FROM events GROUP BY 1")
def percentile_disc(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return checks.percentile(e.select(F.col("event_type").alias("op"), F.col("value").alias("latency_ns")), 0.99)


@frame("percentile_floor", "SELECT op, value FROM (SELECT event_type AS op, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE k = least(floor(n * 0.5)::BIGINT, n - 1)")
def percentile_floor(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return checks.percentile(e.select(F.col("event_type").alias("op"), F.col("value").alias("latency_ns")), 0.5, rule="floor")


R = "WITH n AS (SELECT n_nationkey::BIGINT AS node_id FROM nation), r AS (SELECT o_orderkey AS range_id, (o_custkey % 23)::BIGINT AS node_id FROM orders), c AS (SELECT n.node_id, count(r.node_id) AS replicas FROM n LEFT JOIN r USING (node_id) GROUP BY 1) "


def _placement(spark, sf_dir):
    nodes = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("node_id"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("range_id"), (F.col("o_custkey") % 23).alias("node_id")), nodes


@frame("replica_counts", R + "SELECT node_id, replicas FROM c")
def replica_counts(spark, sf_dir):
    return checks.replica_counts(*_placement(spark, sf_dir))


@frame("replica_deviation", R + "SELECT round(greatest(max(replicas) - avg(replicas), avg(replicas) - min(replicas)) / avg(replicas), 9) AS deviation FROM c")
def replica_deviation(spark, sf_dir):
    return checks.deviation(checks.replica_counts(*_placement(spark, sf_dir))).select(F.round("deviation", 9).alias("deviation"))


@frame("next_move", R + ", f AS (SELECT node_id FROM c ORDER BY replicas DESC, node_id LIMIT 1), t AS (SELECT node_id FROM c ORDER BY replicas, node_id LIMIT 1) SELECT min(range_id) AS range_id, (SELECT node_id FROM f) AS from_node, (SELECT node_id FROM t) AS to_node FROM r WHERE node_id = (SELECT node_id FROM f) AND range_id NOT IN (SELECT range_id FROM r WHERE node_id = (SELECT node_id FROM t))")
def next_move(spark, sf_dir):
    return checks.next_move(*_placement(spark, sf_dir))


@frame("place_voters", "SELECT node_id, zone FROM (SELECT s_suppkey AS node_id, (s_nationkey % 6)::VARCHAR AS zone, s_suppkey * 7 % 31 AS replicas, row_number() OVER (PARTITION BY s_nationkey % 6 ORDER BY s_suppkey * 7 % 31, s_suppkey) AS k FROM supplier) WHERE k = 1 ORDER BY replicas, node_id LIMIT 3")
def place_voters(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return checks.place_voters(s.select(F.col("s_suppkey").alias("node_id"), (F.col("s_nationkey") % 6).cast("string").alias("zone"), (F.col("s_suppkey") * 7 % 31).alias("replicas")), 3)


@frame("oversized_ranges", "SELECT o_custkey AS range_id, max(o_orderkey) AS split_key FROM orders GROUP BY 1 HAVING sum(1000) > 12000")
def oversized_ranges(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("range_id")).agg(F.lit(-1).cast("long").alias("start_key"), F.sum(F.lit(1000)).alias("n_bytes"), F.max("o_orderkey").alias("median_key"))
    return checks.oversized(o, 12000)


@frame("hub_spread", "SELECT 2::BIGINT AS n_ranges")
def hub_spread(spark, sf_dir):
    return checks.hub_spread(spark.createDataFrame(RANGES, "range_id long, start_key string, end_key string"), "u000031", "u000061")


@frame("abort_rate", "SELECT round(count(*) FILTER (event_type = 'error') / count(*), 12) AS abort_rate FROM events")
def abort_rate(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.when(F.col("event_type") == "error", "abort").otherwise("commit").alias("kind"))
    return checks.abort_rate(e).select(F.round("abort_rate", 12).alias("abort_rate"))


@frame("last_gauges", "SELECT user_id AS range_id, arg_max(value, event_id) AS seconds, max(event_id) AS entries FROM events GROUP BY 1")
def last_gauges(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return checks.last_gauges(e.select(F.col("user_id").alias("range_id"), F.col("event_id").alias("at"), F.col("value").alias("seconds"), F.col("event_id").alias("entries")))


@frame("zipf_counts", None)
def zipf_counts(spark, sf_dir):
    return checks.ycsb(spark, 1000, 100_000).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@frame("supernode_bounded_hop", "SELECT dst, rank FROM (SELECT user_id AS dst, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rank FROM events) ORDER BY dst, rank LIMIT 100")
def supernode(spark, sf_dir):
    from pyspark.sql import Window

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hub = e.select(F.lit(0).cast("long").alias("src"), F.col("user_id").alias("dst"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long").alias("rank"))
    g = PropertyGraph(spark).with_nodes(e.select(F.col("user_id").alias("id")).distinct(), "N").with_edges(hub, "HUB", rank="rank")
    return g.adjacent(0, type="HUB", limit=100).select(F.col("$dst").alias("dst"), F.col("$rank").alias("rank"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: make for k, (make, _) in Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in Q.items() if sql}
