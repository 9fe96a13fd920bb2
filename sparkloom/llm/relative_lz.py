"""Substring dedup by relative Lempel-Ziv parsing against the blocks of all documents.

The reference. Every window of `window` words belongs to the block around its rarest-looking run of ANCHOR words: the run with the
least hash, the rightmost of equals. What a window holds alone decides that, so equal windows lie in blocks with the same
anchor. All blocks of all documents are indexed by their words, each by its first holder (the least doc_id, then the least
place); the windows of blocks whose anchor also stands in other blocks are indexed one by one likewise. Blocks and windows are
compared by 128-bit hashes of their words. The lookups that fall to a document (its blocks and windows that an earlier document
holds, and where) meet in one row for each document.

The parse. A document is factored greedily from its first word: at each place the longest factor is taken, that is the longest
stretch of words whose windows follow one another in one reference document as they do here; the next factor starts behind it.
A place where no window of the reference starts is a literal. Factors, of `window` words at least, are duplicate spans, written
as (first word, words, reference document, its first word). A window may also lie across the end of a factor, in another
reference than that: those are checked at the factors' boundaries, and what they cover beyond the factors goes as well.

Cases: a null or empty text has no words; a null doc_id is no reference and is left whole; rows that share a doc_id do not
remove each other's words; texts of less than `window` words stay whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, load, stash, text_key, texts, tidy, unstash

ANCHOR = 8
#: Bits of the position within a chunk of CHUNK words, in the sliding minimum's keys.
_BITS = 20
CHUNK = 1 << 19
NO_DOC = -(1 << 63)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n, done = len(x) - width + 1, 1
    out = x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    return np.minimum(out[:n], out[width - done : width - done + n])


def parse(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of a text: hash of the anchor, first and last window."""
    hashes = words.runs(ANCHOR)
    anchors, firsts, lasts = [], [], []
    low = np.uint64((1 << _BITS) - 1)
    width = window - ANCHOR + 1
    total = len(words) - window + 1
    for at in range(0, total, CHUNK):
        part = hashes[at : min(at + CHUNK, total) + width - 1]
        keys = (part & ~low) | (low - np.arange(len(part), dtype=np.uint64))
        anchor = (low - (_sliding_min(keys, width) & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        anchors.append(part[anchor[first]])
        firsts.append(first + at)
        lasts.append(np.concatenate([first[1:] - 1, [len(anchor) - 1]]) + at)
    if not anchors:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    return np.concatenate(anchors), np.concatenate(firsts), np.concatenate(lasts)


def _digests(pieces) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), "<i8").reshape(-1, 2)


BLOCKS = "doc long, mark long, anchor long, b1 long, b2 long, first int, last int"


def _blocks(window: int):
    def blocks(batches):
        for batch in batches:
            found = []
            for doc, mark, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text")), strict=True):
                words = Words(text)
                if doc == NO_DOC or len(words) < window:
                    continue
                anchor, first, last = parse(words, window)
                digest = _digests([words.slice(a, b + window) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
                n = len(anchor)
                found.append((np.full(n, doc), np.full(n, mark), anchor.view(np.int64), digest[:, 0], digest[:, 1], first.astype(np.int32), last.astype(np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

    return blocks


WINDOWS = "doc long, mark long, w1 long, w2 long, first int"


def _windows(window: int):
    def windows(batches):
        for batch in batches:
            found = []
            for doc, mark, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text", "spans")), strict=True):
                words = Words(text)
                starts = np.unique(np.concatenate([np.arange(x["first"], x["last"] + 1) for x in spans]))
                digest = _digests([words.slice(s, s + window) for s in starts.tolist()])
                n = len(starts)
                found.append((np.full(n, doc), np.full(n, mark), digest[:, 0], digest[:, 1], starts.astype(np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], [x.split()[0] for x in WINDOWS.split(", ")])

    return windows


RESULT = "doc_id long, n_words long, n_removed long, factors array<struct<first: int, words: int, ref_doc: long, ref_mark: long, ref_first: int>>, boundaries array<struct<first: int, words: int>>, kept_text string"


def stretches(met, window: int) -> list[tuple[int, int, tuple[int, int], int]]:
    """(first window, last window, reference, its first window) from lookups (first, last, ref_doc, ref_mark, ref_first), those that
    follow one another in one reference as they do here joined."""
    out, last = [], {}
    for first, end, doc, mark, ref in sorted(met):
        key = (doc, mark, ref - first)
        at = last.get(key)
        if at is not None and first <= out[at][1] + 1:
            out[at][1] = max(out[at][1], end)
        else:
            last[key] = len(out)
            out.append([first, end, (doc, mark), ref])
    return [tuple(x) for x in out]


def greedy_factors(held, window: int) -> list[tuple[int, int, tuple[int, int], int]]:
    """(first word, words, reference, its first word) of the greedy parse: at each place the stretch that reaches furthest (of equal
    ones the least reference), from there to its end; then on behind it."""
    out, waiting, at, place = [], [], 0, 0
    held = sorted(held)
    while at < len(held) or waiting:
        while at < len(held) and held[at][0] <= place:
            first, end, source, ref = held[at]
            heapq.heappush(waiting, (-end, source, ref - first))
            at += 1
        while waiting and -waiting[0][0] < place:  # they end before this place
            heapq.heappop(waiting)
        if waiting:
            end, source, shift = waiting[0]
            out.append((place, -end + window - place, source, place + shift))
            place = -end + window
        elif at < len(held):
            place = max(place, held[at][0])
    return out


def _covered(spans, n: int) -> np.ndarray:
    edges = np.zeros(n + 1, np.int64)
    for first, end in spans:
        edges[first] += 1
        edges[end] -= 1
    return np.cumsum(edges)[:-1] > 0


def _turns(marked: np.ndarray):
    return np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8))).reshape(-1, 2).tolist()


def _cut(window: int):
    def cut(batches):
        for batch in batches:
            rows = []
            for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                if not spans:
                    rows.append((doc, len(words), 0, [], [], b" ".join(words)))
                    continue
                held = stretches([(x["first"], x["last"], x["ref_doc"], x["ref_mark"], x["ref_first"]) for x in spans], window)
                factors = greedy_factors(held, window)
                copied = _covered([(f, f + n) for f, n, _, _ in factors], len(words))
                across = _covered([(f, e + window) for f, e, _, _ in held], len(words)) & ~copied
                kept = [w for w, g in zip(words, (copied | across).tolist(), strict=True) if not g]
                told = [{"first": f, "words": n, "ref_doc": s[0], "ref_mark": s[1], "ref_first": r} for f, n, s, r in factors]
                rows.append((doc, len(words), len(words) - len(kept), told, [{"first": a, "words": b - a} for a, b in _turns(across)], b" ".join(kept)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            i32, i64 = pa.int32(), pa.int64()
            kinds = (i64, i64, i64, pa.list_(pa.struct([("first", i32), ("words", i32), ("ref_doc", i64), ("ref_mark", i64), ("ref_first", i32)])), pa.list_(pa.struct([("first", i32), ("words", i32)])), pa.string())
            columns[5] = [x.decode("utf-8", "surrogatepass") for x in columns[5]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_words", "n_removed", "factors", "boundaries", "kept_text"])

    return cut


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """A row for each document: doc_id, n_words, n_removed, its factors (first word, words; ref_doc, ref_mark and ref_first tell the
    reference's doc_id, the hash of its text and its first word), boundaries (first word, words: what windows across factors'
    ends cover beyond them) and kept_text."""
    if window < 2 * ANCHOR:
        raise ValueError(f"a window has at least {2 * ANCHOR} words")
    rows = texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(NO_DOC)).alias("doc"), text_key().alias("mark"), "text")
    every = stash(rows.select("doc", "mark", "text").mapInArrow(tidy(_blocks(window)), BLOCKS), "blocks")
    anchors = every.groupBy("anchor").agg(F.min("b1").alias("lo"), F.max("b1").alias("hi"), F.min("doc").alias("least"), F.max("doc").alias("most"))
    # sums by a key are written before they are joined by it: Spark then splits a hot key's rows in the join
    shared = stash(anchors.where("least < most").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed")), "anchors")
    blocks = stash(every.join(shared, "anchor").drop("anchor"), "shared")
    unstash(every, shared)
    holder = F.min(F.struct("doc", "first", "mark")).alias("ref")
    least = stash(blocks.groupBy("b1", "b2").agg(holder), "least")
    held = blocks.join(least, ["b1", "b2"])
    met = ["doc", "mark", "first", "last", F.col("ref.doc").alias("ref_doc"), F.col("ref.mark").alias("ref_mark"), F.col("ref.first").alias("ref_first")]
    factors = held.where("doc > ref.doc").select(*met)
    bounds = held.where("doc = ref.doc and mixed").groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    # only documents with such blocks reach Python here; the texts are shuffled once for this and once for the result
    windows = stash(rows.join(bounds, ["doc", "mark"]).select("doc", "mark", "text", "spans").mapInArrow(tidy(_windows(window)), WINDOWS), "windows")
    earlier = stash(windows.groupBy("w1", "w2").agg(holder, F.max("doc").alias("most")).where("ref.doc < most").drop("most"), "earlier")
    checked = windows.withColumn("last", F.col("first")).join(earlier, ["w1", "w2"]).where("doc > ref.doc").select(*met)
    spans = F.collect_list(F.struct("first", "last", "ref_doc", "ref_mark", "ref_first")).alias("spans")
    found = stash(factors.unionByName(checked).groupBy("doc", "mark").agg(spans), "found")
    unstash(blocks, least, windows, earlier)
    return rows.join(found, ["doc", "mark"], "left").select("doc_id", "text", "spans").mapInArrow(tidy(_cut(window)), RESULT)


def op2_query(spark, sf_dir):
    out = remove_repeats(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM d WHERE len(ws) >= 50),
k AS (SELECT r, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS key FROM p),
f AS (SELECT key, min(doc_id) AS least FROM k GROUP BY key),
g AS (SELECT DISTINCT r, i + o AS p FROM (SELECT r, i FROM k JOIN f USING (key) WHERE doc_id > least), (SELECT unnest(range(0, 50)) AS o)),
w AS (SELECT r, doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
s AS (SELECT w.r, count(*) AS n, count(g.p) AS gone, string_agg(word, ' ' ORDER BY w.p) FILTER (g.p IS NULL) AS kept FROM w LEFT JOIN g ON w.r = g.r AND w.p = g.p GROUP BY w.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
"""
