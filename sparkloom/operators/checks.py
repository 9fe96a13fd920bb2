"""Checks and measures over histories, placements and samples: each gives the violations, or the figures asked for."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError
from .versions import ranged

EDGE_KEY = ["src", "type", "dst", "rank"]


def bidirectional(outgoing: DataFrame, incoming: DataFrame, value: str = "w") -> DataFrame:
    """Edges that one side lacks, or whose values differ: the key and what is wrong."""
    a = outgoing.select(*EDGE_KEY, F.col(value).alias("out_value"), F.lit(True).alias("out"))
    b = incoming.select(*EDGE_KEY, F.col(value).alias("in_value"), F.lit(True).alias("in"))
    wrong = F.when(F.col("in").isNull(), "no incoming entry").when(F.col("out").isNull(), "no outgoing entry").when(~F.col("out_value").eqNullSafe(F.col("in_value")), "values differ")
    return a.join(b, EDGE_KEY, "full_outer").select(*EDGE_KEY, wrong.alias("violation")).where("violation is not null")


def lost_updates(increments: DataFrame, finals: DataFrame) -> DataFrame:
    """Counters whose final value is not the number of acknowledged increments."""
    done = increments.where("acknowledged").groupBy("counter").agg(F.count(F.lit(1)).alias("n"))
    both = finals.join(done, "counter", "full_outer").select("counter", F.coalesce("n", F.lit(0)).alias("acknowledged"), "value")
    return both.where(~F.col("acknowledged").eqNullSafe(F.col("value")))


def total_order(increments: DataFrame) -> DataFrame:
    """Counters whose acknowledged increments did not read 0, 1, ..., n - 1, each once."""
    n = F.count(F.lit(1))
    seen = increments.where("acknowledged").groupBy("counter").agg(n.alias("n"), F.count_distinct("read_value").alias("n_distinct"), F.min("read_value").alias("least"), F.max("read_value").alias("most"))
    return seen.where("least <> 0 or most <> n - 1 or n_distinct <> n")


def single_leader(leaders: DataFrame) -> DataFrame:
    """Terms with several leaders."""
    return leaders.groupBy("term").agg(F.count_distinct("node").alias("n_leaders")).where("n_leaders > 1")


def late_promotions(promotions: DataFrame, most: int) -> DataFrame:
    return promotions.where(F.col("lag") > most)


def percentile(samples: DataFrame, p: float, by: str = "op", value: str = "latency_ns", rule: str = "ceil") -> DataFrame:
    """By group: a sample at a rank. rule 'ceil': rank ceil(p n), from 1; 'floor': place min(floor(p n), n - 1), from 0.

    Samples are counted by value; the distinct values are dealt by ranges of (group, value), and each part knows from a row for each
    part and group how many samples come before it: no task sees all values of a group.
    """
    dealt = ranged(samples.groupBy(by, value).agg(F.count(F.lit(1)).alias("c")), by, value)
    sums = dealt.groupBy(by, "part").agg(F.sum("c").alias("c"))
    earlier = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of = sums.select(F.col(by).alias("$by"), F.col("part").alias("$part"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy(by)).alias("n"))
    up = Window.partitionBy("part", by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = dealt.withColumn("here", F.sum("c").over(up)).join(of, (F.col("part") == F.col("$part")) & F.col(by).eqNullSafe(F.col("$by")))
    upto = F.col("here") + F.col("before")
    place = F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1)) if rule == "ceil" else F.least(F.floor(F.lit(p) * F.col("n")), F.col("n") - 1) + 1
    return here.where(upto >= place).groupBy(by).agg(F.min(value).alias("value"))


def histogram(samples: DataFrame, bounds: list[float], by: str = "op", value: str = "latency_ns") -> DataFrame:
    """By group and upper bound (le; null: any): the samples at or below it, and their sum. Bounds are given, so a group is a row."""
    if sorted(set(bounds)) != list(bounds):
        raise DataError("bounds rise")
    counts = [F.count_if(F.col(value) <= b).alias(f"n{k}") for k, b in enumerate(bounds)]
    rows = samples.groupBy(by).agg(*counts, F.count(value).alias("n"), F.sum(value).alias("total"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"n{k}").alias("n")) for k, b in enumerate(bounds)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("n").alias("n"))]
    return rows.select(by, "total", F.explode(F.array(*cells)).alias("cell")).select(by, "cell.le", "cell.n", "total")


def replica_counts(replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """Replicas of every node, of those without any too."""
    held = replicas.groupBy("node_id").agg(F.count(F.lit(1)).alias("c"))
    return nodes.select("node_id").distinct().join(held, "node_id", "left").select("node_id", F.coalesce("c", F.lit(0)).cast("long").alias("replicas"))


def deviation(counts: DataFrame) -> DataFrame:
    """The largest relative distance from the mean; without nodes or replicas 0."""
    mean = counts.agg(F.avg("replicas").alias("mean"), F.max("replicas").alias("most"), F.min("replicas").alias("least"))
    gap = F.greatest(F.col("most") - F.col("mean"), F.col("mean") - F.col("least"))
    return mean.select(F.when(F.col("mean") > 0, gap / F.col("mean")).otherwise(0.0).alias("deviation"))


def next_move(replicas: DataFrame, nodes: DataFrame) -> DataFrame:
    """(range_id, from_node, to_node), or no row once loads differ by one at most. Ties take the lowest node and the first range."""
    counts = replica_counts(replicas, nodes)
    ends = counts.agg(F.max_by("node_id", F.struct("replicas", -F.col("node_id"))).alias("from_node"), F.max("replicas").alias("most"), F.min_by("node_id", F.struct("replicas", "node_id")).alias("to_node"), F.min("replicas").alias("least")).where("most - least > 1")
    held = replicas.select("range_id", "node_id")
    mine = held.join(F.broadcast(ends), F.col("node_id") == F.col("from_node")).select("range_id", "from_node", "to_node")
    theirs = held.join(F.broadcast(ends), F.col("node_id") == F.col("to_node")).select("range_id")
    return mine.join(theirs, "range_id", "left_anti").groupBy("from_node", "to_node").agg(F.min("range_id").alias("range_id")).select("range_id", "from_node", "to_node")


def oversized(stats: DataFrame, most: int) -> DataFrame:
    """(range_id, split_key) of ranges (range_id, start_key, n_bytes, median_key) that are to be split."""
    return stats.where((F.col("n_bytes") > most) & (F.col("median_key") > F.col("start_key"))).select("range_id", F.col("median_key").alias("split_key"))


def place_voters(stores: DataFrame, voters: int) -> DataFrame:
    """The least loaded store of each zone, then the least loaded zones. Three or five voters in as many zones."""
    if voters not in (3, 5):
        raise DataError("a range has 3 or 5 voters")
    best = stores.groupBy("zone").agg(F.min(F.struct("replicas", "node_id")).alias("s")).select("zone", "s.replicas", "s.node_id")
    chosen = best.orderBy("replicas", "node_id").limit(voters)
    if chosen.count() < voters:
        raise DataError("there are too few zones")
    return chosen.select("node_id", "zone")


def hub_spread(ranges: DataFrame, start, end) -> DataFrame:
    """How many ranges a hub's span of keys lies in."""
    meets = ((F.col("end_key") > F.lit(start)) | (F.octet_length("end_key") == 0)) & (F.col("start_key") < F.lit(end))
    return ranges.where(meets).agg(F.count(F.lit(1)).alias("n_ranges"))


def last_gauges(lag: DataFrame) -> DataFrame:
    """The last sample of each range (range_id, at, seconds, entries)."""
    return lag.groupBy("range_id").agg(F.max_by(F.struct("seconds", "entries"), "at").alias("s")).select("range_id", "s.*")


def abort_rate(events: DataFrame) -> DataFrame:
    """Aborts among all ends of transactions (kind: commit or abort); 0 without any."""
    aborts, all_ends = F.count_if(F.col("kind") == "abort"), F.count_if(F.col("kind").isin("abort", "commit"))
    return events.agg(F.when(all_ends > 0, aborts / all_ends).otherwise(0.0).alias("abort_rate"))


def ycsb(spark, n_keys: int, n_ops: int, theta: float = 0.99, seed: int = 1) -> DataFrame:
    """op_id, key and operation: reads and updates by halves, keys by a Zipf law of exponent theta.

    Ranks come by the usual closed form: a uniform number is turned into a rank with two constants of (n_keys, theta).
    """
    zeta = math.fsum(1 / k**theta for k in range(1, n_keys + 1))
    alpha = 1 / (1 - theta)
    eta = (1 - (2 / n_keys) ** (1 - theta)) / (1 - (1 + 0.5**theta) / zeta)
    uniform = lambda salt: (F.xxhash64("id", F.lit(seed), F.lit(salt)).bitwiseAND(F.lit((1 << 53) - 1).cast("long"))) / F.lit(float(1 << 53))
    u = F.col("u")
    rank = F.when(u * zeta < 1, 0).when(u * zeta < 1 + 0.5**theta, 1).otherwise(F.least(F.floor(n_keys * F.pow(eta * u - eta + 1, F.lit(alpha))), F.lit(n_keys - 1)))
    ops = spark.range(n_ops).withColumn("u", uniform(1)).withColumn("v", uniform(2))
    return ops.select(F.col("id").alias("op_id"), F.format_string("user%010d", rank.cast("long")).alias("key"), F.when(F.col("v") < 0.5, "read").otherwise("update").alias("operation"))


def list_append_anomalies(txn_log: DataFrame) -> DataFrame:
    """Of a log (idx, type, ops of f, k, v, read): reads of a key that are not prefixes of its longest read, values read
    that no committed transaction appended, and values appended twice. Cycles between transactions are not searched for."""
    ops = txn_log.where("type = 'ok'").select("idx", F.explode("ops").alias("o")).select("idx", "o.f", "o.k", "o.v", "o.read")
    reads = ops.where("f = 'r'").select("idx", "k", F.coalesce("read", F.array().cast("array<bigint>")).alias("read"))
    longest = reads.groupBy("k").agg(F.max_by("read", F.size("read")).alias("longest"))
    broken = reads.join(longest, "k").where(F.col("read") != F.slice("longest", F.lit(1), F.size("read"))).select("k", F.col("idx").alias("at"), F.lit("not a prefix").alias("anomaly"))
    appends = ops.where("f = 'append'").select("k", "v", "idx")
    twice = appends.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("at")).where("n > 1").select("k", "at", F.lit("appended twice").alias("anomaly"))
    unknown = reads.select("k", "idx", F.explode("read").alias("v")).join(appends.select("k", "v"), ["k", "v"], "left_anti").groupBy("k").agg(F.min("idx").alias("at")).select("k", "at", F.lit("read but not appended").alias("anomaly"))
    return broken.unionByName(twice).unionByName(unknown)
