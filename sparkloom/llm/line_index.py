"""Line dedup: sharded cuckoo filters backed by an exact table of reference counts, open to insertions and deletions.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased, as a 128-bit hash. The table counts the
documents (rows) that hold a key; the filters hold the keys whose count reaches min_docs, each in the shard that the key's first
two bytes name, so a line is looked up in one shard. What a filter denies stays: that settles most lines. What it affirms is
decided by the exact keys, in the same scan while these are few, else by a join of the affirmed keys with the table of counts.

Cases: a null or empty text is one empty line, whose empty key never counts; repeated rows are documents of their own; an empty
table leaves an empty index; columns other than doc_id and text are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, stash, text_key, texts, tidy, unstash

#: Frequent keys up to this number are broadcast with their filters (under 25 bytes a key); beyond, affirmed keys are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Filters up to this size are broadcast; beyond, all keys are joined by shuffle.
BROADCAST_FILTERS = 256 << 20
#: Keys that a shard of the filters holds at about half its room.
SHARD_KEYS = 50_000


class CuckooFilter:
    """16-bit fingerprints, four to a bucket. Keys are 16-byte hashes. Deleting a key that was inserted is exact."""

    SLOTS, KICKS = 4, 500

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> "CuckooFilter":
        return cls(np.zeros((1 << max(2, (2 * keys // cls.SLOTS).bit_length()), cls.SLOTS), np.uint16))

    @classmethod
    def load(cls, blob: bytes) -> "CuckooFilter":
        return cls(np.frombuffer(blob, np.uint16).reshape(-1, cls.SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    @staticmethod
    def parts(keys: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)

    def _places(self, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        mark = (halves[:, 1] >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        first = halves[:, 1] & mask
        return mark, first.astype(np.int64), (first ^ self._jump(mark, mask)).astype(np.int64)

    @staticmethod
    def _jump(mark, mask):
        return (np.asarray(mark, np.uint64) * np.uint64(0x5BD1E995)) & mask

    def contains(self, halves: np.ndarray) -> np.ndarray:
        mark, a, b = self._places(halves)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def insert(self, halves: np.ndarray) -> None:
        for k, key in enumerate(halves):
            if not self._put(key):
                self._grow(halves[k:])
                return

    def _put(self, key) -> bool:
        mark, a, b = (x[0] for x in self._places(key[None, :]))
        mask, rng = np.uint64(len(self.table) - 1), int(mark)
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        before, at = self.table.copy(), a
        for _ in range(self.KICKS):
            rng = (rng * 1103515245 + 12345) & 0x7FFFFFFF
            slot = rng >> 8 & 3
            mark, self.table[at, slot] = self.table[at, slot], mark
            at = int(np.uint64(at) ^ self._jump(mark, mask))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        self.table = before
        return False

    def _grow(self, rest) -> None:
        raise OverflowError("the shard is full; rebuild it from the table of reference counts")

    def delete(self, halves: np.ndarray) -> None:
        for key in halves:
            mark, a, b = (x[0] for x in self._places(key[None, :]))
            for at in (a, b):
                here = np.flatnonzero(self.table[at] == mark)
                if len(here):
                    self.table[at, here[0]] = 0
                    break


class Filters:
    """The shards' filters by number, and their count."""

    def __init__(self, told: tuple[int, dict[int, bytes]]):
        self.shards, blobs = told
        self.filters = {k: CuckooFilter.load(b) for k, b in blobs.items()}

    def affirm(self, digests: list[bytes]) -> np.ndarray:
        """Which keys may be there: each is looked up in its own shard."""
        halves = CuckooFilter.parts(digests)
        shard = (halves[:, 0] & np.uint64(0xFFFF)).astype(np.int64) % self.shards
        out = np.zeros(len(digests), bool)
        for k in np.unique(shard).tolist():
            own = np.flatnonzero(shard == k)
            if k in self.filters:
                out[own] = self.filters[k].contains(halves[own])
        return out


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def _digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def _line_keys(batches):
    for batch in batches:
        out: list[bytes] = []
        for text in batch.column("text").to_pylist():
            keys = {line_key(x) for x in text.encode("utf-8", "surrogatepass").split(b"\n")}
            keys.discard(b"")
            out.extend(map(_digest, keys))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["key"])


def _document_keys(shared):
    """(doc_id, mark, key) of the lines that the filters affirm; without filters of all."""

    def keys_of(batches):
        filters = None if shared is None else Filters(shared.value)
        for batch in batches:
            rows = [[], [], []]
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text")), strict=True):
                keys = [_digest(k) for k in {line_key(x) for x in text.encode("utf-8", "surrogatepass").split(b"\n")} - {b""}]
                there = [True] * len(keys) if filters is None else filters.affirm(keys).tolist()
                for key in (k for k, yes in zip(keys, there, strict=True) if yes):
                    for column, value in zip(rows, (doc, mark, key), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "mark", "key"])

    return keys_of


def _prune(text: str, frequent) -> tuple[int, str, list[bytes]]:
    """The text's number of lines, and the lines that stay; frequent(digests) tells which keys go."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    keys = [line_key(x) for x in lines]
    gone = frequent(list(map(_digest, keys)))
    return len(lines), [x for x, key, away in zip(lines, keys, gone, strict=True) if not (away and key)]


def _answer(doc, n, kept):
    joined = b"\n".join(kept)
    return doc, n, n - len(kept), joined


def _result(batch, answers):
    columns = list(zip(*answers, strict=True)) if answers else [(), (), (), ()]
    arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array([x.decode("utf-8", "surrogatepass") for x in columns[3]], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_lines", "n_dropped", "kept_text"])


RESULT = "doc_id long, n_lines long, n_dropped long, kept_text string"


class LineIndex:
    """counts: (key, n_docs), exact. filters: (shard, filter), a cuckoo filter for each shard of the keys with n_docs >= min_docs."""

    def __init__(self, spark: SparkSession, counts: DataFrame, filters: DataFrame, shards: int, min_docs: int):
        self.spark, self.counts, self.filters, self.shards, self.min_docs = spark, counts, filters, shards, min_docs

    @staticmethod
    def count(docs: DataFrame) -> DataFrame:
        keys = texts(docs).select("text").mapInArrow(tidy(_line_keys), "key binary")
        return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"))

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 10) -> "LineIndex":
        return cls._of(docs.sparkSession, stash(cls.count(docs), "lines"), min_docs)

    @classmethod
    def _of(cls, spark, counts, min_docs):
        frequent = counts.where(F.col("n_docs") >= min_docs).select("key")
        shards = min(1 << 16, max(1, -(-frequent.count() // SHARD_KEYS)))
        filters = frequent.select(cls._shard(shards).alias("shard"), "key").groupBy("shard").applyInArrow(_fill(), "shard int, filter binary")
        return cls(spark, counts, stash(filters, "filters"), shards, min_docs)

    @staticmethod
    def _shard(shards: int):
        # the first two bytes, as Filters.affirm() reads them
        first = F.concat(F.hex(F.substring("key", 2, 1)), F.hex(F.substring("key", 1, 1)))
        return F.pmod(F.conv(first, 16, 10).cast("int"), F.lit(shards)).cast("int")

    def frequent(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("key")

    def _changed(self, delta: DataFrame) -> "LineIndex":
        """The index after delta (key, change). Filters are edited for the keys that cross min_docs, not built anew."""
        both = self.counts.select("key", "n_docs", F.lit(0).cast("long").alias("change")).unionByName(delta.select("key", F.lit(0).cast("long").alias("n_docs"), "change"))
        merged = stash(both.groupBy("key").agg(F.sum("n_docs").alias("was"), F.sum(F.col("n_docs") + F.col("change")).alias("n_docs")), "merged")
        if merged.where("n_docs < 0").limit(1).count():
            raise ValueError("a document is to be deleted that was not inserted")
        least = self.min_docs
        crossing = merged.where((F.col("was") >= least) != (F.col("n_docs") >= least)).select(self._shard(self.shards).alias("shard"), "key", (F.col("n_docs") >= least).alias("up"))
        old = self.filters.groupBy("shard").cogroup(crossing.groupBy("shard")).applyInArrow(_edit, "shard int, filter binary")
        counts = stash(merged.where("n_docs > 0").select("key", "n_docs"), "lines")
        try:
            filters = stash(old, "filters")
            unstash(merged)
            return LineIndex(self.spark, counts, filters, self.shards, least)
        except Exception as e:
            if "the shard is full" not in str(e):
                raise
            return self._of(self.spark, counts, least)

    def insert(self, docs: DataFrame) -> "LineIndex":
        return self._changed(self.count(docs).select("key", F.col("n_docs").alias("change")))

    def delete(self, docs: DataFrame) -> "LineIndex":
        return self._changed(self.count(docs).select("key", (-F.col("n_docs")).alias("change")))

    def prune(self, docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
        """A row for each document: doc_id, n_lines, n_dropped, kept_text."""
        frequent = self.frequent()
        if frequent.count() <= broadcast_keys:
            return texts(docs).mapInArrow(tidy(_pruner(self._shared())), RESULT)
        return self._listed(texts(docs)).mapInArrow(tidy(_prune_listed), RESULT)

    def rewrite(self, docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
        """The documents with all their columns, text without the lines that go; a null text stays null."""
        if self.frequent().count() <= broadcast_keys:
            return docs.mapInArrow(tidy(_rewriter(self._shared())), docs.schema)
        rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("document"))
        listed = self._listed(rows.withColumn("text", F.coalesce("text", F.lit(""))))
        pruned = listed.mapInArrow(tidy(_rewrite_listed(docs.schema.names)), docs.schema)
        return pruned

    def _blobs(self):
        return self.shards, {r.shard: bytes(r.filter) for r in self.filters.toLocalIterator()}

    def _shared(self):
        keys = np.array(sorted(bytes(r.key) for r in self.frequent().toLocalIterator()), "S16")
        return self.spark.sparkContext.broadcast((keys, self._blobs()))

    def _listed(self, rows: DataFrame) -> DataFrame:
        """The rows with the keys of theirs that go, by shuffles."""
        rows = rows.withColumn("mark", text_key())
        size = self.filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0)).alias("n")).first().n
        shared = self.spark.sparkContext.broadcast(self._blobs()) if size <= BROADCAST_FILTERS else None
        gone = rows.select("doc_id", "mark", "text").mapInArrow(tidy(_document_keys(shared)), "doc_id long, mark long, key binary").join(self.frequent(), "key", "left_semi")
        gone = gone.groupBy("doc_id", "mark").agg(F.collect_set("key").alias("gone"))
        same = rows["doc_id"].eqNullSafe(gone["doc_id"]) & (rows["mark"] == gone["mark"])
        return rows.join(gone, same, "left").select(*[rows[c] for c in rows.columns if c != "mark"], "gone")


def _fill():
    def fill(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        room = len(keys)
        while True:
            made = CuckooFilter.sized(room)
            try:
                made.insert(CuckooFilter.parts(keys))
                break
            except OverflowError:
                room *= 2
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([made.dump()], pa.binary())})

    return fill


def _edit(filters: pa.Table, crossing: pa.Table) -> pa.Table:
    shard = (filters if filters.num_rows else crossing).column("shard")[0].as_py()
    made = CuckooFilter.load(filters.column("filter")[0].as_py()) if filters.num_rows else CuckooFilter.sized(max(64, crossing.num_rows))
    for up in (False, True):
        keys = [k for k, u in zip(crossing.column("key").to_pylist(), crossing.column("up").to_pylist(), strict=True) if u == up]
        if keys:
            (made.insert if up else made.delete)(CuckooFilter.parts(keys))
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([made.dump()], pa.binary())})


def _checker(shared):
    """Tells of a list of keys which are frequent: what the filters affirm is looked up among the exact keys."""
    exact, told = shared.value
    filters = Filters(told)

    def frequent(digests):
        out = filters.affirm(digests)
        maybe = np.flatnonzero(out)
        if len(maybe):
            asked = np.frombuffer(b"".join(digests[i] for i in maybe.tolist()), "S16")
            near = np.minimum(np.searchsorted(exact, asked), len(exact) - 1)
            out[maybe] = exact[near] == asked
        return out.tolist()

    return frequent


def _with_text(batch, columns, texts_now):
    """The named columns of a batch, with other texts (None: null)."""
    arrays = [pa.array(texts_now, pa.string()) if c == "text" else batch.column(c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def _rewriter(shared):
    def rewrite(batches):
        frequent = _checker(shared)
        for batch in batches:
            now = [None if t is None else b"\n".join(_prune(t, frequent)[1]).decode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            yield _with_text(batch, batch.schema.names, now)

    return rewrite


def _rewrite_listed(names):
    def rewrite(batches):
        for batch in batches:
            now = []
            whole = batch.column("document")
            was = whole.field("text").to_pylist()
            for text, gone in zip(was, batch.column("gone").to_pylist(), strict=True):
                listed = set(gone or ())
                now.append(None if text is None else b"\n".join(_prune(text, lambda digests, listed=listed: [d in listed for d in digests])[1]).decode("utf-8", "surrogatepass"))
            arrays = [pa.array(now, pa.string()) if c == "text" else whole.field(c) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, list(names))

    return rewrite


def _pruner(shared):
    def prune(batches):
        frequent = _checker(shared)
        for batch in batches:
            yield _result(batch, [_answer(doc, *_prune(text, frequent)) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)])

    return prune


def _prune_listed(batches):
    for batch in batches:
        answers = []
        for doc, text, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "gone")), strict=True):
            listed = set(gone or ())
            answers.append(_answer(doc, *_prune(text, lambda digests, listed=listed: [d in listed for d in digests])))
        yield _result(batch, answers)


def dedup_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    return LineIndex.build(docs, min_docs).prune(docs)


def op6_query(spark, sf_dir):
    out = dedup_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY r, doc_id
"""
