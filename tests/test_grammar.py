import pytest

from sparkloom.errors import GqlSyntaxError, NotGql, UnsupportedFeature
from sparkloom.gql.features import PARTIAL, REJECTED, SUPPORTED
from sparkloom.gql.lexer import lex
from sparkloom.gql.parser import parse, parse_expression
from sparkloom.gql.tree import Leaf, Op

ACCEPTED = {
    "G010": "MATCH WALK (a) RETURN a", "G014": "MATCH WALK PATHS (a)->(b) RETURN a", "G036": "MATCH (a)-[:T]->{1,3}(b) RETURN b", "G043": "MATCH (a)<-[e]->(b) RETURN e", "G044": "MATCH (a)->(b)<-(c)-(d) RETURN a",
    "G045": "MATCH (a)<->(b) RETURN a", "G060": "MATCH (a)->{2}(b) RETURN b", "G074": "MATCH (a:%) RETURN a", "G100": "MATCH (a) RETURN ELEMENT_ID(a)", "G110": "MATCH ()-[e]->() WHERE e IS DIRECTED RETURN e", "G111": "MATCH (a) WHERE a IS LABELED X&Y RETURN a",
    "G112": "MATCH (a)-[e]->(b) WHERE a IS SOURCE OF e RETURN a", "G113": "MATCH (a),(b) WHERE ALL_DIFFERENT(a, b) RETURN a", "G114": "MATCH (a),(b) WHERE SAME(a, b) RETURN a", "G115": "MATCH (a) WHERE PROPERTY_EXISTS(a, x) RETURN a",
    "GA01": "RETURN 1e0 / 3e0", "GA03": "RETURN 1 AS x ORDER BY x NULLS FIRST", "GA05": "RETURN CAST(1 AS STRING)", "GA06": "RETURN 1 IS TYPED INT", "GB01": "MATCH (" + "a" * 200 + ") RETURN 1", "GB02": "RETURN 1 -- end", "GB03": "RETURN 1 // end",
    "GD01": "INSERT (:A)", "GD02": "MATCH (a) SET a:X REMOVE a:Y", "GE07": "RETURN TRUE XOR FALSE", "GF01": "RETURN ABS(1), FLOOR(1), CEILING(2), MOD(1, 2), SQRT(2)", "GF02": "RETURN SIN(1), COT(1), DEGREES(1)", "GF03": "RETURN LN(1), LOG(2, 8), LOG10(1)",
    "GF05": "RETURN BTRIM('a', 'b'), LTRIM('a'), RTRIM('a', 'b')", "GF06": "RETURN TRIM(LEADING 'x' FROM 'y'), TRIM(BOTH FROM 'y')", "GF07": "RETURN TRIM(X'00' FROM X'0001')", "GF12": "RETURN CARDINALITY([1])", "GF13": "RETURN SIZE([1])",
    "GG01": "MATCH (a {x: 1}) RETURN a", "GL01": "RETURN 0xFF_00", "GL02": "RETURN 0o17", "GL03": "RETURN 0b101", "GL04": "RETURN 1.5", "GQ01": "USE g MATCH (a) RETURN a", "GQ08": "MATCH (a) FILTER WHERE a.x = 1 RETURN a", "GQ09": "LET x = 1, y = x RETURN y",
    "GQ10": "FOR x IN [1] RETURN x", "GQ12": "RETURN 1 AS x OFFSET 1", "GQ13": "RETURN 1 AS x LIMIT 1", "GQ14": "MATCH (a) RETURN a ORDER BY a.x + 1 DESC", "GT01": "START TRANSACTION", "GT02": "START TRANSACTION READ ONLY",
    "GV12": "RETURN CAST(1 AS INTEGER64)", "GV17": "RETURN CAST(1 AS DECIMAL)", "GV23": "RETURN CAST(1 AS DOUBLE PRECISION)", "GV24": "RETURN CAST(1 AS FLOAT64)", "GV35": "RETURN CAST('a' AS BYTES), X'0a'", "GV40": "RETURN CAST(1 AS ZONED DATETIME)",
    "GV45": "RETURN {a: 1}", "GV47": "RETURN RECORD {a: 1}", "GV48": "RETURN {a: {b: 1}}.a.b", "GV50": "RETURN LIST[1, 2]", "GV68": "MATCH (a) LET b = a RETURN b",
}
REFUSED = {
    "G002": "MATCH DIFFERENT EDGES (a) RETURN a", "G003": "MATCH REPEATABLE ELEMENTS (a) RETURN a", "G004": "MATCH p = (a) RETURN a", "G006": "MATCH (a) KEEP WALK RETURN a", "G011": "MATCH TRAIL (a) RETURN a", "G012": "MATCH SIMPLE (a) RETURN a", "G013": "MATCH ACYCLIC (a) RETURN a",
    "G015": "MATCH ALL (a) RETURN a", "G016": "MATCH ANY (a) RETURN a", "G017": "MATCH ALL SHORTEST (a) RETURN a", "G018": "MATCH ANY SHORTEST (a) RETURN a", "G019": "MATCH SHORTEST 2 (a) RETURN a", "G020": "MATCH SHORTEST 2 GROUPS (a) RETURN a", "G037": "MATCH (a)->?(b) RETURN a", "G038": "MATCH ((a)->(b)) RETURN a", "G061": "MATCH (a)->{2,}(b) RETURN a",
    "GC01": "CREATE SCHEMA s", "GC04": "DROP GRAPH g", "GD03": "MATCH (a) DELETE VALUE a", "GE03": "RETURN LET x = 1 IN x END", "GE06": "RETURN PATH[a]", "GF04": "RETURN PATH_LENGTH(p)", "GF10": "RETURN STDDEV_POP(1)", "GF11": "RETURN PERCENTILE_DISC(1, 2)", "GG03": "CREATE PROPERTY GRAPH TYPE t", "GH02": "MATCH (a)~[e]~(b) RETURN a",
    "GL05": "RETURN 1m", "GL06": "RETURN 1e2m", "GL09": "RETURN 1.5f", "GL10": "RETURN 1d", "GL12": "RETURN INTERVAL '1'", "GP01": "CALL { RETURN 1 }", "GP04": "CALL p()", "GQ02": "RETURN 1 OTHERWISE RETURN 2", "GQ03": "RETURN 1 UNION RETURN 2", "GQ04": "RETURN 1 EXCEPT RETURN 2", "GQ06": "RETURN 1 INTERSECT RETURN 2",
    "GQ11": "FOR x IN [1] WITH ORDINALITY i RETURN x", "GQ15": "RETURN 1 GROUP BY x", "GQ18": "RETURN VALUE { RETURN 1 }", "GQ19": "MATCH (a) YIELD a RETURN a", "GQ20": "MATCH (a) NEXT RETURN a", "GQ21": "OPTIONAL { MATCH (a) } RETURN a", "GQ24": "FOR x IN [1] WITH OFFSET i RETURN x", "GS03": "SESSION SET SCHEMA s", "GS08": "SESSION RESET", "GT03": "USE a MATCH (b) USE c RETURN b",
    "GV39": "RETURN DATE '2020-01-01'", "GV40": "RETURN CAST(1 AS ZONED TIME)", "GV41": "RETURN DURATION 'P1D'", "GV17": "RETURN CAST(1 AS DECIMAL(3, 1))", "GV23": "RETURN CAST(1 AS FLOAT(3))",
    **{f: f"RETURN CAST(1 AS {t})" for t, f in {"UINT8": "GV01", "INT8": "GV02", "UINT16": "GV03", "INT16": "GV04", "USMALLINT": "GV05", "UINT32": "GV06", "INT32": "GV07", "UINT": "GV08", "UBIGINT": "GV10", "UINT64": "GV11", "UINT128": "GV13", "INT128": "GV14", "UINT256": "GV15", "INT256": "GV16", "SMALLINT": "GV18", "BIGINT": "GV19", "FLOAT16": "GV20", "FLOAT32": "GV21", "FLOAT128": "GV25", "FLOAT256": "GV26", "PATH": "GV55", "GRAPH": "GV60", "TABLE": "GV61", "ANY": "GV65", "NOTHING": "GV72"}.items()},
}


def test_every_feature_has_a_statement():
    assert set(ACCEPTED) == set(SUPPORTED) | set(PARTIAL) and len(SUPPORTED) == 52 and len(PARTIAL) == 6
    assert set(REFUSED) == set(REJECTED)


@pytest.mark.parametrize("feature", sorted(ACCEPTED))
def test_accepted(feature):
    parse(ACCEPTED[feature])


@pytest.mark.parametrize("feature", sorted(REFUSED))
def test_refused_by_name(feature):
    with pytest.raises(UnsupportedFeature) as e:
        parse(REFUSED[feature])
    assert e.value.feature == feature and feature in str(e.value) and "offset" in str(e.value)


@pytest.mark.parametrize("text", ["SELECT 1", "INSERT INTO t VALUES (1)", "DELETE FROM t", "UPDATE t SET x = 1", "CREATE TABLE t (x INT)", "CREATE INDEX i", "ALTER TABLE t"])
def test_sql_is_told_apart(text):
    with pytest.raises(NotGql):
        parse(text)


@pytest.mark.parametrize("text,at", [("MATCH (n RETURN n", 9), ("RETURN", 6), ("RETURN 'a", 7), ("RETURN FOO(1)", 7), ("RETURN 9223372036854775808", 7), ("MATCH (n {a: 1, a: 2}) RETURN n", 9), ("é", 0), ("RETURN 'é' ?", 12)])
def test_offsets_of_errors(text, at):
    with pytest.raises(GqlSyntaxError) as e:
        parse(text)
    assert e.value.offset == at


def test_precedence_and_tokens():
    one, two, three = (Leaf("int", k) for k in (1, 2, 3))
    assert parse_expression("1 + 2 * 3") == Op("+", (one, Op("*", (two, three))))
    assert parse_expression("NOT 1 = 2 AND 3") == Op("AND", (Op("NOT", (Op("=", (one, two)),)), three))
    assert parse_expression("1 - 2 - 3") == Op("-", (Op("-", (one, two)), three))
    assert parse_expression("1 OR 2 XOR 3") == Op("OR", (one, Op("XOR", (two, three))))
    assert parse_expression("-1 || 2 IS NOT NULL") == Op("NOT", (Op("is null", (Op("||", (Op("-", (one,)), two)),)),))
    assert parse_expression("CASE 1 WHEN 2 THEN 3 END") == Op("case", (one, two, three, Leaf("null")))
    assert [t.text for t in lex("a<-1")] == ["a", "<-", "1", ""] and [t.text for t in lex("1 --x\n2 /* y */ 3")] == ["1", "2", "3", ""]
    assert lex("'it''s \\n'")[0].value == "it's \n" and lex("`a``b`")[0].value == "a`b" and lex("0b1_0")[0].value == 2
