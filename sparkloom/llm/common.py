"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a Java or Python character class.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of a table of documents, whatever else it has; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def text_key(text: Column | None = None) -> Column:
    """Tells rows apart that share a doc_id but not a text; equal rows have equal results, so they may share a key."""
    return F.xxhash64(F.col("text") if text is None else text)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it within lambda functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one on a single machine."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.environ.get("SPARKLOOM_SCRATCH")
    if not own or not os.path.isdir(own):
        os.environ["SPARKLOOM_SCRATCH"] = own = tempfile.mkdtemp(prefix="sparkloom-")
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def filesystem(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table written to the shared folder and read again: it is computed once and survives lost executors.

    The files go when the application ends, or before that by unstash().
    """
    spark = df.sparkSession
    where = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(where)
    fs, path = filesystem(spark, where)
    fs.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out._stashed = where
    return out


def unstash(*tables: DataFrame) -> None:
    """Deletes stashed tables that no later result reads."""
    for df in tables:
        fs, path = filesystem(df.sparkSession, df._stashed)
        fs.delete(path, True)


#: What a worker forgets when a task ends: functions that the modules with caches add.
caches: list = []


def release() -> None:
    """Gives memory that a task of Python no longer uses back to the system."""
    for forget in caches:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def tidy(run):
    """run, a function of batches, after which a worker that waits for other tasks holds no memory."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def tidy_group(run, large: int = 4 << 20):
    """run, a function of one or two tables, after which the memory of large ones is given back."""

    def tidied(*tables):
        try:
            return run(*tables)
        finally:
            if sum(t.nbytes for t in tables) >= large:
                release()

    # Spark looks at the number of arguments
    return (lambda one: tidied(one)) if run.__code__.co_argcount == 1 else (lambda one, two: tidied(one, two))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: An odd base for polynomials modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []
#: Letters up to which the powers are kept from one task to the next.
_KEPT_POWERS = 1 << 17
caches.append(lambda: _powers.clear() if _powers and len(_powers[0]) > _KEPT_POWERS + 1 else None)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


_byte_codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


class Words:
    """The words of one text, and 64-bit hashes of runs of them, by prefix sums over the bytes of the words joined by a space."""

    def __init__(self, text: str | bytes | None):
        raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else (text or b"")
        self.words = raw.split()
        n = len(self.words)
        self.joined = b" ".join(self.words)
        lengths = np.fromiter(map(len, self.words), np.int64, n)
        self.ends = np.cumsum(lengths + 1) - 1 if n else np.zeros(0, np.int64)
        self.starts = self.ends - lengths
        self._prefix = None

    def __len__(self) -> int:
        return len(self.words)

    def runs(self, k: int) -> np.ndarray:
        """The hash of every run of k words, by the run's first word."""
        n = len(self.words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        power, inverse = _power_tables(len(self.joined))
        if self._prefix is None:
            codes = _byte_codes[np.frombuffer(self.joined, np.uint8)] * power[: len(self.joined)]
            self._prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes)])
        starts, ends = self.starts[:n], self.ends[k - 1 :]
        return mix64((self._prefix[ends] - self._prefix[starts]) * inverse[starts])

    def slice(self, first: int, last: int) -> bytes:
        """Words first to last - 1, joined by a space."""
        return self.joined[self.starts[first] : self.ends[last - 1]]
