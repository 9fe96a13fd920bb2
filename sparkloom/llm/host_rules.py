"""Quality rules: rule failures by host, rates shrunk by an empirical beta prior, verdicts joined back. DataFrame functions only.

Cases: a null or empty text has no words and fails the base rules; a null source is a host of its own; repeated rows count
as often as they stand; an empty table gives an empty result; columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, stash

#: Hosts up to this number are broadcast (a row of them has under 200 bytes); beyond, the join shuffles with salted hosts.
BROADCAST_HOSTS = 100_000
SALTS = 64


def _repeated(words: Column) -> Column:
    """Words that stand in a window of three found twice or more in the text.

    Windows are sorted by their hash within the row. A sort key has the upper bits of the hash and the position, so it stays a
    plain long; neighbours are then compared by the whole hash.
    """

    def windows(w):
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def sort(h):
        bits = F.length(F.bin(F.size(h).cast("long"))).cast("int")
        keys = let(bits, lambda b: F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", F.call_function("shiftright", x, b), b).bitwiseOR(i.cast("long")))))
        mask = F.expr("1L")
        return let(F.struct(h.alias("h"), keys.alias("k"), (F.call_function("shiftleft", mask, bits) - 1).alias("m")), starts)

    def starts(x):
        order = F.transform(x["k"], lambda k: k.bitwiseAND(x["m"]).cast("int"))
        return let(F.struct(x["h"].alias("h"), order.alias("p")), found)

    def found(x):
        value = lambda i: F.get(x["h"], F.get(x["p"], i))
        return let(value_runs(x, value), covered)

    def value_runs(x, value):
        there = F.filter(F.sequence(F.lit(0), F.size(x["p"]) - 1), lambda i: ((i > 0) & (value(i) == value(F.greatest(i - 1, F.lit(0))))) | F.coalesce(value(i) == value(i + 1), F.lit(False)))
        return F.sort_array(F.transform(there, lambda i: F.get(x["p"], i)))

    def covered(s):
        gaps = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.least(F.lit(3), F.get(s, i) - F.get(s, i - 1)), F.lit(0)))
        return F.when(F.size(s) == 0, F.lit(0).cast("long")).otherwise(gaps + 3)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(let(words, windows), sort))


def document_statistics(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, host and the counts that the rules use, a row for each document; whole: also all its columns as the struct document."""
    also = ["document"] if whole else []
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("host"), text.alias("text"), *([F.struct(*docs.columns).alias("document")] if whole else []))
    out = out.select(*also, "doc_id", "host", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    return out.select(
        *also,
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeated(F.col("words")).alias("n_repeat_words"),
    )


def rules() -> dict[str, Column]:
    """Rules by name; each is true for a document that fails it."""
    return {
        "short": F.col("n_words") < 50,
        "repeats": 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
        "lines": F.col("n_dup_lines") * 20 > F.col("n_words"),
    }


def host_verdicts(stats: DataFrame, threshold: float = 0.5) -> DataFrame:
    """host, n_docs, n_failed, the shrunk rate of failures and the verdict; n_<rule> has the failures of each rule.

    The prior is a beta distribution whose mean and variance are those of the hosts' rates (by moments; where they allow none,
    a uniform prior). A host is rejected if its posterior mean is above the threshold.
    """
    failed = [c.cast("long").alias(f"f_{k}") for k, c in rules().items()]
    marked = stats.select("host", *failed)
    any_failed = F.greatest(*[F.col(f"f_{k}") for k in rules()])
    hosts = marked.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(any_failed).alias("n_failed"), *[F.sum(f"f_{k}").alias(f"n_{k}") for k in rules()])
    rate = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"))
    usable = (F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v"))
    weight = F.when(usable, F.col("m") * (1 - F.col("m")) / F.nullif(F.col("v"), F.lit(0.0)) - 1)
    prior = moments.select(F.coalesce(F.col("m") * weight, F.lit(1.0)).alias("a"), F.coalesce((1 - F.col("m")) * weight, F.lit(1.0)).alias("b"))
    shrunk = (F.col("n_failed") + F.col("a")) / (F.col("n_docs") + F.col("a") + F.col("b"))
    # one row of prior against all hosts: a scalar, not a product
    return hosts.join(F.broadcast(prior)).withColumn("failure_rate", shrunk).withColumn("host_rejected", F.col("failure_rate") > threshold).drop("a", "b")


def apply_host_rules(docs: DataFrame, threshold: float = 0.5, whole: bool = False) -> DataFrame:
    """Statistics of each document, base_failed, its host's failure rate and verdict, and kept."""
    stats = stash(document_statistics(docs, whole), "rules")
    hosts = stash(host_verdicts(stats, threshold), "hosts").select("host", "failure_rate", "host_rejected")
    if hosts.count() <= BROADCAST_HOSTS:
        joined = stats.join(F.broadcast(hosts), "host")
    else:
        salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = stats.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"]).drop("salt")
    base = rules()["short"] | rules()["repeats"]
    return joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def keep_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return apply_host_rules(docs, threshold, whole=True).where("kept").select("document.*")


def op8_query(spark, sf_dir):
    from .common import load

    return apply_host_rules(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
t AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM t),
x AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (
  SELECT r, doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN l USING (r) LEFT JOIN x USING (r)),
f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > word_chars OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR n_dup_lines * 20 > n_words) AS failed
  FROM s),
h AS (SELECT host, count(*) AS n, sum(failed::BIGINT) AS k FROM f GROUP BY host),
m AS (SELECT avg(k / n) AS m, var_samp(k / n) AS v FROM h),
p AS (SELECT CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (m * (1 - m) / v - 1) ELSE 1 END AS a, CASE WHEN v > 0 AND m * (1 - m) > v THEN (1 - m) * (m * (1 - m) / v - 1) ELSE 1 END AS b FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ((k + a) / (n + a + b) > 0.5) AS kept
FROM f JOIN h USING (host) CROSS JOIN p
"""
