"""Features of the language by their id, described in this project's own words."""

from __future__ import annotations

SUPPORTED = {
    "G010": "explicit WALK keyword", "G014": "PATH and PATHS keywords", "G036": "quantified edges with an upper bound", "G044": "abbreviated edge patterns",
    "G060": "bounded repetition", "G074": "wildcard label", "G100": "ELEMENT_ID", "G110": "IS DIRECTED", "G111": "IS LABELED", "G112": "IS SOURCE and IS DESTINATION",
    "G113": "ALL_DIFFERENT", "G114": "SAME", "G115": "PROPERTY_EXISTS", "GA01": "IEEE 754 arithmetic", "GA03": "NULLS FIRST and NULLS LAST", "GA05": "CAST",
    "GA06": "IS TYPED", "GB01": "long identifiers", "GB02": "double minus comments", "GB03": "double slash comments", "GD01": "updates of the graph", "GD02": "label updates",
    "GE07": "XOR", "GF01": "more numeric functions", "GF02": "trigonometric functions", "GF03": "logarithms", "GF05": "trim of several letters", "GF06": "explicit TRIM",
    "GF07": "BTRIM of bytes", "GF12": "CARDINALITY", "GF13": "SIZE", "GG01": "graphs without a type", "GL01": "hexadecimal literals", "GL02": "octal literals", "GL03": "binary literals",
    "GL04": "exact numbers with a point", "GQ01": "USE", "GQ08": "FILTER", "GQ09": "LET", "GQ10": "FOR over lists", "GQ12": "OFFSET and SKIP", "GQ13": "LIMIT", "GQ14": "ORDER BY any expression",
    "GT01": "explicit transactions", "GV12": "64-bit integers", "GV24": "64-bit floats", "GV35": "byte strings", "GV45": "records", "GV47": "open records", "GV48": "nested records", "GV50": "lists", "GV68": "elements as values",
}
PARTIAL = {"G043": "full edge patterns in any direction", "G045": "abbreviated edges of every kind", "GT02": "transaction characteristics", "GV17": "decimals", "GV23": "floats by precision", "GV40": "zoned date and time"}
#: Known by name and rejected with it.
REJECTED = {
    "G002": "different-edges match mode", "G003": "repeatable-elements match mode", "G004": "path variables", "G006": "KEEP", "G011": "TRAIL paths", "G012": "SIMPLE paths", "G013": "ACYCLIC paths",
    "G015": "all path search", "G016": "any path search", "G017": "all shortest path search", "G018": "any shortest path search", "G019": "counted shortest path search", "G020": "counted shortest group search", "G037": "questioned paths", "G038": "parenthesised paths", "G061": "unbounded repetition",
    "GC01": "schema management", "GC04": "graph management", "GD03": "DELETE of expressions", "GE03": "LET in expressions", "GE06": "path construction", "GF04": "path functions", "GF10": "more aggregates", "GF11": "percentile aggregates",
    "GG03": "graph types", "GH02": "undirected edge patterns", "GL05": "suffix m", "GL06": "suffix m with an exponent", "GL09": "suffix f", "GL10": "suffix d", "GL12": "interval literals", "GP01": "inline procedures", "GP04": "named procedures",
    "GQ02": "OTHERWISE", "GQ03": "UNION", "GQ04": "EXCEPT", "GQ06": "INTERSECT", "GQ11": "FOR with ordinality", "GQ15": "GROUP BY", "GQ18": "scalar subqueries", "GQ19": "YIELD", "GQ20": "NEXT", "GQ21": "OPTIONAL and EXISTS with several statements", "GQ24": "FOR with offset",
    "GS03": "SESSION SET", "GS08": "SESSION RESET", "GT03": "several graphs in one query", "GV01": "8-bit unsigned integers", "GV02": "8-bit integers", "GV03": "16-bit unsigned integers", "GV04": "16-bit integers", "GV05": "small unsigned integers", "GV06": "32-bit unsigned integers", "GV07": "32-bit integers", "GV08": "regular unsigned integers",
    "GV10": "big unsigned integers", "GV11": "64-bit unsigned integers", "GV13": "128-bit unsigned integers", "GV14": "128-bit integers", "GV15": "256-bit unsigned integers", "GV16": "256-bit integers", "GV17": "decimals with a precision", "GV18": "small integers", "GV19": "big integers", "GV20": "16-bit floats",
    "GV21": "32-bit floats", "GV23": "floats with a precision", "GV25": "128-bit floats", "GV26": "256-bit floats", "GV39": "dates and local times", "GV40": "zoned times", "GV41": "durations", "GV55": "paths", "GV60": "graph references", "GV61": "binding table references", "GV65": "dynamic unions", "GV72": "immaterial values",
}


def describe(feature: str) -> str:
    return REJECTED.get(feature) or SUPPORTED.get(feature) or PARTIAL.get(feature) or "not described"
