"""Personal data: base patterns, and identifiers that bootstrapped contextual patterns find.

Base spans are what the four base patterns match. They seed the method, and so do secrets: words of 32 hexadecimal digits or more,
which are no spans by themselves. Every other word that looks like an identifier (it has a digit or an @) is a candidate. An
occurrence of a seed or candidate stands in up to four contexts, words being lower-cased, without punctuation at their ends, those
with digits all alike: the two words to the left and the one to the right; the two to the left; the one to the left and the
occurrence's shape (kinds of letters, and its length from 12 on); the whole line before it, if that has one to four words.
In 'key=value' and 'key:value' the value is the occurrence and the key the word to its left.

Contexts and the instances (texts) that stand in them form a graph. An instance has a belief for each kind: seeds 1, candidates that
of the best pattern they stand in. A context's confidence for a kind is b / (b + o + SMOOTHING): b sums the beliefs of its distinct
instances in this kind, o those in other kinds and the ordinary words that stand in the context anywhere in the corpus, counted by a
second scan. A context with LEAST distinct believed instances and a confidence of THRESHOLD becomes a pattern and stays one. Spark
goes on with joins and sums until no context becomes a pattern: what a pattern finds makes patterns of further contexts. In
the end every candidate in a pattern is a span of the pattern's kind (of several, that of the most confident).

Offsets are code points, ends exclusive. Cases: a null or empty text has no spans; repeated rows are answered alike, each by a row
of its own, while an instance counts once for a pattern; an empty table gives an empty result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import caches, load, mix64, stash, texts, tidy, unstash

#: The base kinds, and one that has seeds but no base spans.
KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
THRESHOLD, LEAST, SMOOTHING = 0.8, 3, 0.5
#: Contexts up to this number go to every task of the second scan (8 bytes each); beyond, it counts all contexts and joins them.
BROADCAST_CONTEXTS = 4_000_000

#: What a mail address may have before and after its @.
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of digits can only start a match at its own start: whatever follows it is the same for its later digits.
_ip = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_local_letters = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_candidate = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _local_letters:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        at = text.find("@", max(at + 1, floor))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), in order."""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _ip.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split("."))]
    for m in _card.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _phone.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_word = re.compile(r"[^\x20\x09-\x0D]+")
_edge = re.compile(r"^\W+|\W+$")
_keyed = re.compile(r"(.*[=:][\"']?)([^=:]*[0-9@].*)", re.S)
_hexadecimal = re.compile(r"(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}")
_around = "!\"'(),.:;<>?[]{}|*$&%#"
#: Multipliers and additions of the contexts' hashes.
_A, _B, _C, _D = mix64(np.arange(201, 205, dtype=np.uint64)) | np.uint64(1)
_PREFIX = 4
#: Words that a task keeps the hashes of.
CACHE_WORDS = 400_000


def _plain(word: str) -> int:
    bare = _edge.sub("", word).lower() or word
    return xxhash.xxh3_64_intdigest(b"#" if any(c.isdigit() for c in bare) else bare.encode("utf-8", "surrogatepass"))


class _Hashes(dict):
    """Words' hashes without case, digits and punctuation."""

    def __missing__(self, word: str) -> int:
        h = self[word] = _plain(word)
        return h


_hashes = _Hashes()
caches.append(_hashes.clear)


class Contexts:
    """The contexts of each word of a text, as hashes: near (two words left, one right), left (two left), last (one left) and line
    (all before it in its line; 0 where these are none or too many)."""

    def __init__(self, text: str):
        if len(_hashes) > CACHE_WORDS:
            _hashes.clear()
        self.words: list[str] = []
        first: list[int] = []
        for line in text.split("\n"):
            first.append(len(self.words))
            self.words += _word.findall(line)
        self.h = np.fromiter(map(_hashes.__getitem__, self.words), np.uint64, len(self.words))
        self.begins = np.array(first, np.int64)

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.h)
        before = np.concatenate([np.zeros(2, np.uint64), self.h, np.zeros(1, np.uint64)])
        left, near, last = contexts_of(before[:n], before[1 : n + 1], before[3:])
        line = np.zeros(n, np.uint64)
        begins, ends = self.begins, np.append(self.begins[1:], n)
        chain = np.full(len(begins), _C, np.uint64)
        for k in range(1, _PREFIX + 1):
            there = begins + k < ends
            at = begins[there] + k
            chain = mix64(chain[there] * _D + self.h[at - 1])
            line[at] = chain
            begins, ends = begins[there], ends[there]
        return near, left, last, line


def contexts_of(two: np.ndarray, one: np.ndarray, right: np.ndarray):
    left = mix64(two * _A + one * _B + np.uint64(1))
    return left, mix64(left * _C + right + np.uint64(2)), mix64(one * _D + np.uint64(3))


def shape(instance: str) -> int:
    kinds = {"9" if c.isdigit() else "a" if c.isalpha() else c for c in instance}
    return xxhash.xxh3_64_intdigest(("".join(sorted(kinds)) + (str(len(instance)) if len(instance) >= 12 else "")).encode("utf-8", "surrogatepass"))


SEEN = "array<struct<start: int, end: int, kind: int, instance: long, contexts: array<struct<context: long, counted: long>>>>"
SCAN = f"doc_id long, base array<struct<start: int, kind: int, end: int>>, seen {SEEN}"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_SEEN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.int64()), ("contexts", pa.list_(pa.struct([("context", pa.int64()), ("counted", pa.int64())])))]))


def occurrences(text: str, base):
    """(start, end, kind) of base spans and candidates (kind -1; SECRET: such a seed)."""
    yield from ((a, b, k) for a, k, b in base)
    taken = sorted((a, b) for a, _, b in base)
    at, high = 0, 0
    for m in _candidate.finditer(text):
        word, begin = m[0], m.start()
        keyed = _keyed.fullmatch(word.rstrip(_around))
        if keyed:
            begin, word = begin + len(keyed[1]), keyed[2]
        a = begin + len(word) - len(word.lstrip(_around))
        b = begin + len(word.rstrip(_around))
        if a >= b:
            continue
        while at < len(taken) and taken[at][0] < b:
            high, at = max(high, taken[at][1]), at + 1
        if high <= a:
            yield a, b, SECRET if _hexadecimal.fullmatch(text, a, b) else -1


def seen_in(text: str, base) -> list[dict]:
    found = list(occurrences(text, base))
    if not found:
        return []
    own = Contexts(text)
    near, left, last, line = own.all()
    starts = [m.start() for m in _word.finditer(text)]
    n, out = len(starts), []
    one = lambda x: np.array([x], np.uint64)
    for a, b, kind in found:
        i, j = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        glued = _edge.sub("", text[starts[i] : a])
        right = int(own.h[j + 1]) if j + 1 < n else 0
        if glued or j > i:
            two, before = (int(own.h[i - 1]) if i else 0, _hashes[glued]) if glued else (int(own.h[i - 2]) if i > 1 else 0, int(own.h[i - 1]) if i else 0)
            l2, l3, l1 = (int(x[0]) for x in contexts_of(one(two), one(before), one(right)))
        else:
            l2, l3, l1 = int(left[i]), int(near[i]), int(last[i])
        shaped = int(mix64(one(l1) + one(shape(text[a:b])))[0])
        places = [(l3, l3), (l2, l2), (shaped, l1)] + ([(int(line[i]), int(line[i]))] if line[i] and not glued else [])
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        instance = signed(xxhash.xxh3_64_intdigest(text[a:b].lower().encode("utf-8", "surrogatepass")))
        out.append({"start": a, "end": b, "kind": kind, "instance": instance, "contexts": [{"context": signed(x), "counted": signed(y)} for x, y in places]})
    return out


def _scan(batches):
    for batch in batches:
        bases, seens = [], []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            bases.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
            seens.append(seen_in(text, base))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bases, _SPAN_TYPE), pa.array(seens, _SEEN_TYPE)], ["doc_id", "base", "seen"])


def _ordinary(shared):
    """(counted, n): how often ordinary words, without digit or @, stand in contexts; shared: those that are asked for (none: all)."""

    def ordinary(batches):
        wanted = None if shared is None else np.frombuffer(shared.value, np.uint64)
        for batch in batches:
            held, n = [np.zeros(0, np.uint64)], 0
            for text in batch.column("text").to_pylist():
                own = Contexts(text)
                if not own.words:
                    continue
                plain = np.fromiter((not ("@" in w or _digit(w)) for w in own.words), bool, len(own.words))
                for keys in own.all():
                    keys = keys[plain]
                    if wanted is None:
                        keys = keys[keys != 0]
                    elif len(wanted):
                        near = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                        keys = keys[wanted[near] == keys]
                    else:
                        keys = keys[:0]
                    held.append(keys)
                    n += len(keys)
                if n > 1_000_000:
                    yield _counted(held)
                    held, n = [np.zeros(0, np.uint64)], 0
            yield _counted(held)

    return ordinary


_digit = re.compile("[0-9]").search


def _counted(held) -> pa.RecordBatch:
    keys, n = np.unique(np.concatenate(held), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["counted", "n"])


def ordinary_words(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """(counted, others) for the contexts counted, a written table of distinct ones."""
    shared = None
    if counted.count() <= BROADCAST_CONTEXTS:
        keys = np.array(sorted(r.counted & 0xFFFFFFFFFFFFFFFF for r in counted.toLocalIterator()), np.uint64)
        shared = docs.sparkSession.sparkContext.broadcast(keys.tobytes())
    found = texts(docs).select("text").mapInArrow(tidy(_ordinary(shared)), "counted long, n long").groupBy("counted").agg(F.sum("n").alias("others"))
    return found if shared is not None else found.join(counted, "counted", "left_semi")


def bootstrap(docs: DataFrame, seen: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """(context, kind, confidence) of the patterns, from occurrences (context, counted, instance, kind; kind -1: a candidate)."""
    links = stash(seen.select("context", "counted", "instance", "kind").distinct(), "links")
    # a pattern has that many instances at least, now or later
    wide = stash(links.groupBy("context", "counted").agg(F.count_distinct("instance").alias("n")).where(F.col("n") >= least).drop("n"), "contexts")
    counted = stash(wide.select("counted").distinct(), "counted")
    others = stash(ordinary_words(docs, counted), "others")
    # a context in which ordinary words outweigh all its instances can be none
    room = stash(wide.join(others, "counted", "left").select("context", F.coalesce("others", F.lit(0)).alias("others")), "room")
    edges = stash(links.select("context", "instance").distinct().join(room.select("context"), "context", "left_semi"), "edges")
    seeds = stash(links.where("kind >= 0").select("instance", "kind").distinct().withColumn("belief", F.lit(1.0)), "beliefs")
    unstash(links, wide, counted, others)
    beliefs, patterns, n = seeds, None, 0
    while True:
        # sums are written before they are joined by the same key: Spark then splits hot keys in the joins
        sums = stash(edges.join(beliefs, "instance").groupBy("context", "kind").agg(F.sum("belief").alias("b"), F.count(F.lit(1)).alias("n")), "sums")
        every = sums.groupBy("context").agg(F.sum("b").alias("all"))
        confidence = F.col("b") / (F.col("all") + F.col("others") + SMOOTHING)
        fresh = sums.where(F.col("n") >= least).join(every, "context").join(room, "context").select("context", "kind", confidence.alias("confidence")).where(F.col("confidence") >= threshold)
        if patterns is not None:
            fresh = fresh.unionByName(patterns).groupBy("context", "kind").agg(F.max("confidence").alias("confidence"))
        fresh = stash(fresh, "patterns")
        unstash(sums, *([patterns] if patterns is not None else []))
        patterns, before, n = fresh, n, fresh.count()
        if n == before:
            unstash(room, edges, *{id(x): x for x in (seeds, beliefs)}.values())
            return patterns
        found = edges.join(patterns, "context").groupBy("instance", "kind").agg(F.max("confidence").alias("belief"))
        more = stash(found.unionByName(seeds).groupBy("instance", "kind").agg(F.max("belief").alias("belief")), "beliefs")
        if beliefs is not seeds:
            unstash(beliefs)
        beliefs = more


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD, least: int = LEAST) -> DataFrame:
    """A row for each document: doc_id, base and found (arrays of start, kind and end)."""
    scanned = stash(texts(docs).mapInArrow(tidy(_scan), SCAN).withColumn("row", F.monotonically_increasing_id()), "scanned")
    seen = scanned.select("row", F.explode("seen").alias("s")).select("row", "s.*").withColumn("c", F.explode("contexts")).select("row", "start", "end", "kind", "instance", "c.*")
    patterns = bootstrap(docs, seen, threshold, least)
    fresh = seen.where(F.col("kind").isin(-1, SECRET)).drop("kind").join(patterns, "context")
    best = fresh.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
    found = best.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("found"))
    return scanned.select("row", "doc_id", "base").join(found, "row", "left").drop("row")


def op1_query(spark, sf_dir):
    out = find_personal_data(load(spark, sf_dir, "documents"))
    name = F.array(*map(F.lit, KINDS))
    join = lambda c: F.array_join(F.transform(F.array_sort(c), lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    every = F.concat("base", F.coalesce("found", F.array().cast("array<struct<start: int, kind: int, end: int>>")))
    return out.select("doc_id", *map(of, range(4)), F.sha2(join(F.col("base")), 256).alias("base_sha256"), join(every).alias("spans"))
