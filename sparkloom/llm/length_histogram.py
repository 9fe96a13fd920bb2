"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer for every context limit.

Cases: a null or empty text has length 0; repeated rows count as often as they stand; an empty table gives an empty histogram;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import load, stash, texts, tidy
from .token_files import default_tokenizer
from .wordpiece import encoder

#: Lengths of one bin of the two-level suffix sums.
BIN = 1024


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and n_tokens of each document."""

    def count(batches):
        coder = encoder(tokenizer_path)
        for batch in batches:
            n = np.array([len(coder.encode(t)) // 2 for t in batch.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n)], ["doc_id", "n_tokens"])

    return texts(docs).mapInArrow(tidy(count), "doc_id long, n_tokens long")


def histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """By length: documents and tokens of at least that length, and the corpus's tokens if texts are cut at that length.

    Sums run within bins of BIN lengths, and over the bins' sums: no task sees all lengths.
    """
    rows = hist.withColumn("bin", F.floor(F.col("n_tokens") / BIN)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    bins = rows.groupBy("bin").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    up = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    total = bins.agg(F.sum("t").alias("total"))
    later = bins.select("bin", F.coalesce(F.sum("d").over(up), F.lit(0)).alias("docs_later"), F.coalesce(F.sum("t").over(up), F.lit(0)).alias("tokens_later"))
    within = Window.partitionBy("bin").orderBy(F.desc("n_tokens"))
    out = rows.join(later, "bin").join(F.broadcast(total))
    out = out.withColumn("docs_at_least", F.sum("n_docs").over(within) + F.col("docs_later")).withColumn("tokens_at_least", F.sum("tokens").over(within) + F.col("tokens_later"))
    cut = F.col("total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", cut.alias("tokens_if_cut"))


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """The corpus's documents, tokens and tokens cut at each of the limits, which need not be lengths that occur."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    whole = sums.agg(F.sum("n_docs").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("n_docs")).alias("n_tokens"))
    over = F.when(F.col("n_tokens") > F.col("context_limit"), F.col("n_docs"))
    cut = F.sum(F.coalesce(over * (F.col("n_tokens") - F.col("context_limit")), F.lit(0))).alias("cut")
    by = sums.join(F.broadcast(asked)).groupBy("context_limit").agg(cut, F.sum(F.coalesce(over, F.lit(0))).alias("docs_cut"))
    return by.join(F.broadcast(whole)).select("context_limit", "n_docs", "n_tokens", "docs_cut", (F.col("n_tokens") - F.col("cut")).alias("tokens_if_cut"))


def quantiles(sums: DataFrame, of: list[float]) -> DataFrame:
    """The least length that at least a share q of the documents do not exceed, for each q."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in of], "q double")
    n = sums.agg(F.sum("n_docs").alias("all_docs"))
    upto = F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")
    reached = F.when(upto >= F.col("q") * F.col("all_docs"), F.col("n_tokens"))
    return sums.join(F.broadcast(n)).join(F.broadcast(asked)).groupBy("q").agg(F.min(reached).alias("n_tokens"))


def op7_query(spark, sf_dir):
    return suffix_sums(stash(histogram(token_counts(load(spark, sf_dir, "documents"), default_tokenizer())), "lengths"))
