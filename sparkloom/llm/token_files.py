"""Token-ID files: ids ranked by frequency, in byte-aligned variable length with separate control bytes, read by table lookup.

Format. A file set is a folder with three Parquet tables. Each row of blocks is a block of consecutive documents in ascending
doc_id order: part and block (ints, their order is the documents' order), n_ids, start (ids of the part before the block), docs
and lengths (arrays: doc_id, ids with the end id), control and data (bytes). Ids are replaced by their rank by falling count
(ties: by id), so frequent ids take one byte. A control byte has the sizes less one of four ranks, two bits each, the first in
the lowest bits; the last may be padded with zeros. The ranks' bytes follow one another in data, the lowest first. ranks has
(id, rank, n), the ids that occur, parts has (part, n_ids, start), the ids before each part. parts is written last: a folder
without it is no file set. Reading takes nothing but what stands in the folder.

Cases: a null or empty text has only the end id; rows that share a doc_id stand beside one another, ordered by their ids' bytes;
a null doc_id comes first; an empty table gives no blocks; a folder that exists is not written to; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, load, scratch, stash, texts, tidy, unstash
from .wordpiece import encoder

#: Ids of a block, after which it is closed; ids that are counted at a time, rounded up to a text's.
BLOCK_IDS = 1 << 18

_sizes = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
#: By control byte: the bytes of the four ranks together.
_total = _sizes.sum(1).astype(np.int64)
#: By control byte and rank: where in the group's bytes the rank begins, and which bits of the four bytes from there are its.
_begins = (np.cumsum(_sizes, 1) - _sizes).astype(np.int64)
_bits = ((1 << 8 * _sizes.astype(np.int64)) - 1).astype(np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data of unsigned 32-bit numbers."""
    n = len(ranks)
    width = 2 if not n or ranks.max() < 1 << 16 else 4
    padded = np.zeros(-(-n // 4) * 4, f"<u{width}")
    padded[:n] = ranks
    longer = [padded >= 1 << 8 * k for k in range(1, width)]
    code = sum(x.view(np.uint8) for x in longer).reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    kept = np.ones((len(padded), width), bool)
    for k, x in enumerate(longer, 1):
        kept[:, k] = x
    return control.tobytes(), padded.view(np.uint8)[kept.ravel()].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first n numbers, by table lookups for each control byte."""
    codes = np.frombuffer(control, np.uint8)
    total = _total[codes]
    begins = _begins[codes]
    begins += (np.cumsum(total) - total)[:, None]
    # the four bytes from each place on
    four = np.ndarray(len(data), "<u4", data + bytes(3), strides=(1,))
    out = four[begins.ravel()]
    out &= _bits[codes].ravel()
    return out[:n]


ENCODED = "doc_id long, ids binary, counts binary"


def _encode(path: str, end_id: int):
    """A row for each document and, after them, one for the task: how often each id occurs, 65,536 numbers of eight bytes."""
    end = np.array([end_id], "<u2").tobytes()
    types = (pa.int64(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in ENCODED.split(", ")]

    def encode(batches):
        coder = encoder(path)
        total = np.zeros(1 << 16, "<i8")
        waiting, held = [], 0

        def count():
            total[:] += np.bincount(np.frombuffer(b"".join(waiting), "<u2"), minlength=1 << 16)

        for batch in batches:
            ids = []
            for t in batch.column("text").to_pylist():
                x = coder.encode(t) + end
                ids.append(x)
                waiting.append(x)
                held += len(x) // 2
                if held >= BLOCK_IDS:
                    count()
                    waiting, held = [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, types[1]), pa.nulls(len(ids), types[2])], names)
        count()
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, total.tobytes()), types, strict=True)], names)

    return encode


def _sum_counts(batches):
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column("counts"):
            total += np.frombuffer(x.as_buffer(), "<i8")
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["id", "n"])


BLOCK = "part int, block int, n_ids long, start long, docs array<long>, lengths array<long>, control binary, data binary"


def _blocks(ranks):
    def blocks(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rank = ranks.value
        block = start = 0
        docs, lengths, waiting, held = [], [], [], 0

        def close():
            ids = np.frombuffer(b"".join(waiting), "<u2")
            control, data = pack(rank[ids])
            values = (part, block, len(ids), start, list(docs), list(lengths), control, data)
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                docs.append(doc)
                lengths.append(len(ids) // 2)
                waiting.append(ids)
                held += len(ids) // 2
                if held >= BLOCK_IDS:
                    yield close()
                    block, start = block + 1, start + held
                    docs, lengths, waiting, held = [], [], [], 0
        if docs:
            yield close()

    return blocks


def _unblock(back, offsets):
    def unblock(batches):
        ids_of, before = back.value, offsets.value
        for batch in batches:
            for x in batch.to_pylist():
                ids = ids_of[unpack(x["control"], x["data"], x["n_ids"])].astype("<u4")
                ends = np.cumsum(x["lengths"], dtype=np.int64)
                starts = ends - np.array(x["lengths"], np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                columns = [pa.array(x["docs"], pa.int64()), pa.array(starts + x["start"] + before[x["part"]]), pa.array(x["lengths"], pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return unblock


def _temporary(spark: SparkSession) -> str:
    where = f"{scratch(spark)}/tokens-{uuid.uuid4().hex}"
    fs, path = filesystem(spark, where)
    fs.deleteOnExit(path)
    return where


class TokenFiles:
    """A file set at a path. The rank table has at most 65,536 rows and parts a row for each part: both go to every task."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "TokenFiles":
        fs, done = filesystem(spark, f"{path.rstrip('/')}/parts/_SUCCESS")
        if not fs.exists(done):
            raise FileNotFoundError(f"no token files in {path}")
        return cls(spark, path)

    @classmethod
    def write(cls, docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = 1, partitions: int | None = None) -> "TokenFiles":
        """Encodes documents and writes them to a new folder (none told: one of the shared folder, for as long as the application runs)."""
        spark = docs.sparkSession
        out = cls(spark, path or _temporary(spark))
        encoded = stash(texts(docs).mapInArrow(tidy(_encode(tokenizer_path, end_id)), ENCODED), "ids")
        counts = encoded.where("counts is not null").select("counts").mapInArrow(tidy(_sum_counts), "id int, n long")
        ordered = sorted((-r.n, r.id) for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect())  # at most 65,536 rows
        ranks = spark.createDataFrame([(i, k, -n) for k, (n, i) in enumerate(ordered)], "id int, rank int, n long")
        ranks.coalesce(1).write.parquet(f"{out.path}/ranks")
        rank = np.zeros(1 << 16, np.uint32)
        rank[[i for _, i in ordered]] = np.arange(len(ordered))
        shared = spark.sparkContext.broadcast(rank)
        coded = encoded.where("counts is null").select("doc_id", "ids")
        spread = coded.repartitionByRange(partitions, "doc_id") if partitions else coded.repartitionByRange("doc_id")
        # rows that share a doc_id fall in one part
        spread.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids").mapInArrow(tidy(_blocks(shared)), BLOCK).write.option("compression", "zstd").parquet(f"{out.path}/blocks")
        # a row for each part: their number is set by the partitioning
        before, rows = 0, []
        for r in sorted(out.blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
            rows.append((r.part, r.n, before))
            before += r.n
        spark.createDataFrame(rows, "part int, n_ids long, start long").coalesce(1).write.parquet(f"{out.path}/parts")
        unstash(encoded)
        return out

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.schema(BLOCK).parquet(f"{self.path}/blocks")

    @property
    def ranks(self) -> DataFrame:
        return self.spark.read.schema("id int, rank int, n long").parquet(f"{self.path}/ranks")

    @property
    def parts(self) -> DataFrame:
        return self.spark.read.schema("part int, n_ids long, start long").parquet(f"{self.path}/parts")

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""
        offsets = {r.part: r.start for r in self.parts.collect()}
        ids = np.zeros(1 << 16, np.uint32)
        for r in self.ranks.collect():
            ids[r["rank"]] = r["id"]
        share = self.spark.sparkContext.broadcast
        return self.blocks.mapInArrow(tidy(_unblock(share(ids), share(offsets))), "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_query(spark, sf_dir):
    return TokenFiles.write(load(spark, sf_dir, "documents"), default_tokenizer()).read()
