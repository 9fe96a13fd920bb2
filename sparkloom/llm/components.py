"""Connected components by alternating star contraction, over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def _stars(pairs: DataFrame, larger: bool) -> tuple[DataFrame, DataFrame]:
    """Links each node's neighbours to the least node among it and them: of the larger neighbours, or of the others. And a written
    table that this reads."""
    if larger:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written before it is joined by the same key: Spark then splits the links of a hot node in the join
    least = stash(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    joined = both.join(least, "a")
    if larger:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select("b", "m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct(), least


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in the edges (a, b): the component is its least id. Rounds go on until nothing changes; their number
    grows with the logarithm of a component's diameter. Each round's links are a table of at most as many rows as there are edges."""
    pairs = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    last = None
    while True:
        large, first = _stars(pairs, True)
        # written, since it is read twice
        large = stash(large, "edges")
        small, second = _stars(large, False)
        fresh = stash(small, "edges")
        unstash(pairs, first, large, second)
        pairs = fresh
        sums = tuple(fresh.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if sums == last:
            roots = pairs.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id"))
            return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
        last = sums
