"""Tables written to the folder that driver and executors share, and read again: computed once, safe from lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.environ.get("SPARKLOOM_TABLES")
    if not own or not os.path.isdir(own):
        os.environ["SPARKLOOM_TABLES"] = own = tempfile.mkdtemp(prefix="sparkloom-tables-")
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)
