"""An extension beyond the language: a stream of changes into versioned keys, by Structured Streaming.

Each micro-batch becomes a folder of versions, named by its number: a batch that is tried again replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

VERSIONS = "key string, commit_ts long, value string"


def ingest(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """changes: a stream of (key, commit_ts, value; a null value deletes). Of a key's changes of one time the greatest value counts."""

    def write(batch: DataFrame, number: int) -> None:
        one = batch.groupBy("key", "commit_ts").agg(F.max("value").alias("value"))
        one.select(F.col("key").cast("string"), F.col("commit_ts").cast("long"), F.col("value").cast("string")).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(VERSIONS).parquet(folder).select("key", "commit_ts", "value")


def activity(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events (ts, event_type) counted by tumbling windows; windows are final once the watermark has passed them."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")
