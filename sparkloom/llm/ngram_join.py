"""N-gram Jaccard join: MinHash values compared step by step, pairs dropped once the posterior is against them, the rest exact.

Texts are sets of runs of five words. Texts with equal sets form one class from the start. Of different sets, those that share
a band of their MinHash values are compared, a step of values at a time: with m of n values equal, the similarity has the
posterior Beta(m + 1, n - m + 1), and the pair is dropped when its chance of reaching the threshold is below the tolerance.
A first pass over the bands joins sets to groups by the pairs that survive; the groups then gather each set once, and their
pairs that survive are verified by the exact sets. No pair leaves a task.

Groups of more than a block are never compared whole to find out who belongs together: each member is first compared with the
group's least (a star); only members that it does not reach are compared with all others, dealt out as pairs of blocks. Members
that a star holds together need no comparison with each other, so a group of near copies costs as much as it has members. The
numbers of links are another matter: each link has to be verified, so near_duplicates(links=True) deals out all pairs of a group.

Runs of words are known by 64-bit hashes. A pair at the threshold shares no band with a chance of about 3e-6.

Cases: a null or empty text has no run, links to nothing and is a class by itself; a text of one to four words has one run, all
its words; rows that share a doc_id are rows of their own, whose class has the least doc_id of its rows; a null doc_id counts as
the least, as -2**63, which stands for it: that number as a doc_id comes back as null; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, load, mix64, stash, texts, tidy, tidy_group, unstash
from .components import connected_components

RUN = 5
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 16
#: Sets of a block whose MinHash values are compared (about 1 MB); of one whose runs are, and the runs of such a block (about 4 MB).
VALUES_BLOCK, BLOCK, RUNS_BLOCK = 2048, 512, 1 << 19
#: Sets in groups up to this number (under 60 bytes each) go to every task that reads texts again; beyond, the texts are shuffled.
BROADCAST_SETS = 500_000
NO_DOC = -(1 << 63)

_odd = (mix64(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32) | np.uint32(1)
_add = mix64(np.arange(10_001, 10_001 + HASHES, dtype=np.uint64)).astype(np.uint32)


def shingles(text: str, run: int = RUN) -> np.ndarray:
    words = Words(text)
    return np.unique(words.runs(min(run, len(words)))) if len(words) else np.zeros(0, np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    low = mix64(items).astype(np.uint32)
    for at in range(0, len(low), 2048):
        part = low[at : at + 2048]
        np.minimum(least, (part[None, :] * _odd[:, None] + _add[:, None]).min(1), out=least)
    return least


def _tail(a: int, b: int, x: float) -> float:
    """P(Beta(a, b) >= x) for whole a, b: of a + b - 1 draws, fewer than a are below x."""
    n = a + b - 1
    return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(x) + (n - k) * math.log1p(-x)) for k in range(a))


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 16, 32, ... values compared: how many must be equal for a pair to stay."""
    return [next(m for m in range(n + 1) if m == n or _tail(m + 1, n - m + 1, threshold) >= tolerance) for n in range(STEP, HASHES + 1, STEP)]


def _sets(run: int):
    def sets(batches):
        for batch in batches:
            known, n, values = [], [], []
            for text in batch.column("text").to_pylist():
                items = shingles(text, run)
                known.append(xxhash.xxh3_128_digest(items.tobytes()))
                n.append(len(items))
                values.append(signature(items).tobytes() if len(items) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(known, pa.binary()), pa.array(n, pa.int32()), pa.array(values, pa.binary())], ["doc_id", "same", "n_runs", "values"])

    return sets


def _bands(batches):
    """A row for each set and band: a hash of the band's values."""
    for batch in batches:
        table = np.frombuffer(b"".join(batch.column("values").to_pylist()), np.uint32).reshape(-1, BANDS, ROWS)
        keys = np.full(table.shape[:2], 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
        for r in range(ROWS):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + table[:, :, r])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), BANDS)), pa.array(keys.reshape(-1).view(np.int64))], ["id", "band"])


def _survivors(a: np.ndarray, b: np.ndarray, same: bool, least: list[int]):
    """Pairs (row of a, row of b) of which no step of values speaks against; same: b is a, each pair once."""
    for at in range(0, len(a), 64):
        part = a[at : at + 64]
        left, right = np.meshgrid(np.arange(at, at + len(part)), np.arange(len(b)), indexing="ij")
        keep = (right > left) if same else np.ones(left.shape, bool)
        left, right = left[keep], right[keep]
        equal = np.zeros(len(left), np.int32)
        for k, need in enumerate(least):
            if not len(left):
                break
            cut = slice(k * STEP, (k + 1) * STEP)
            equal += (a[left, cut] == b[right, cut]).sum(1)
            keep = equal >= need
            left, right, equal = left[keep], right[keep], equal[keep]
        yield left, right


def _union(n: int, pairs) -> np.ndarray:
    """The least member of each of n members' groups."""
    root = list(range(n))

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for left, right in pairs:
        for x, y in zip(left.tolist(), right.tolist(), strict=True):
            x, y = top(x), top(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    return np.array([top(x) for x in range(n)], np.int64)


def _values(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("values").to_pylist()), np.uint32).reshape(-1, HASHES)


class _Unit:
    """A unit's rows by side. Kinds: "all" has one side, of which all pairs count; "star" has the hub on side 1; "rest" compares
    side 0 with side 1, which may share members; "two" compares sides that do not."""

    def __init__(self, table: pa.Table):
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        order = np.lexsort((ids, side))
        # rows that share a doc_id and a text stand once
        order = order[np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(side[order]) != 0)])]
        self.table, self.ids, side = table.take(pa.array(order)), ids[order], side[order]
        self.kind = table.column("unit")[0].as_py().split(":", 1)[0]
        self.one, self.two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        self.values = _values(self.table)

    def sides(self):
        return (self.one, self.one) if self.kind == "all" else (self.one, self.two)

    def survivors(self, least):
        """Portions of pairs of rows that no step of values speaks against."""
        first, second = self.sides()
        if len(first) and len(second):
            for left, right in _survivors(self.values[first], self.values[second], self.kind == "all", least):
                x, y = first[left], second[right]
                if self.kind in ("star", "rest"):
                    own = self.ids[x] != self.ids[y]
                    x, y = x[own], y[own]
                yield x, y

    def edges(self, pairs) -> pa.Table:
        """An edge to the least member of its group for each member; the hub's name of a star stands in hub."""
        known, place = np.unique(self.ids, return_inverse=True)
        root = _union(len(known), ((place[x], place[y]) for x, y in pairs))
        moved = root != np.arange(len(known))
        a, b = known[moved], known[root[moved]]
        grp = self.table.column("grp").to_numpy()[:1] if len(self.ids) else np.zeros(0, np.int64)
        return pa.table({"a": a, "b": b, "grp": np.repeat(grp, len(a)), "star": np.full(len(a), self.kind == "star")})


def _link(least: list[int]):
    def link(table: pa.Table) -> pa.Table:
        unit = _Unit(table)
        return unit.edges(unit.survivors(least))

    return link


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common runs of each pair. Many pairs: by products of 0/1 matrices over the runs that two or more sets hold."""
    if len(left) < 1000:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(left.tolist(), right.tolist(), strict=True)], np.int64)
    used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right = place[: len(left)], place[len(left) :]
    members = [sets[i] for i in used.tolist()]
    every, column, times = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    del every
    owner = np.repeat(np.arange(len(members), dtype=np.int32), [len(m) for m in members])
    common = times[column] > 1
    column = (np.cumsum(times > 1, dtype=np.int32) - 1)[column[common]]
    owner = owner[common]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros(len(left), np.float64)
    step = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [at, at + step])
        there = np.unique(owner[lo:hi])
        local = np.full(len(members), -1)
        local[there] = np.arange(len(there))
        grid = np.zeros((len(there), step), np.float32)
        grid[local[owner[lo:hi]], column[lo:hi] - at] = 1
        product = grid @ grid.T
        x, y = local[left], local[right]
        both = (x >= 0) & (y >= 0)
        total[both] += product[x[both], y[both]]
    return total.astype(np.int64)


def _near(unit: _Unit, sets: list[np.ndarray], sizes: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float):
    """Those of the pairs of rows whose sets reach the threshold."""
    common = _overlaps(sets, x, y)
    near = common >= threshold * (sizes[x] + sizes[y] - common) - 1e-9
    return x[near], y[near]


def _exact(unit: _Unit):
    sets = [np.frombuffer(x, np.uint64) for x in unit.table.column("runs").to_pylist()]
    return sets, np.array([len(s) for s in sets], np.int64)


def _join(least: list[int], threshold: float):
    """Edges of a unit by the exact sets. Pairs that others hold together already are not verified."""

    def join(table: pa.Table) -> pa.Table:
        unit = _Unit(table)
        sets, sizes = _exact(unit)
        _, place = np.unique(unit.ids, return_inverse=True)
        root = np.arange(len(unit.ids))

        def found():
            nonlocal root
            if unit.kind == "all" and len(root) > 2:  # a star first: near copies then need no further comparison
                yield from keep(np.zeros(len(root) - 1, np.int64), np.arange(1, len(root)))
            for x, y in _gathered(unit.survivors(least), 20_000):
                apart = root[place[x]] != root[place[y]]
                yield from keep(x[apart], y[apart])

        def keep(x, y):
            nonlocal root
            x, y = _near(unit, sets, sizes, x, y, threshold)
            held.append((place[x], place[y]))
            root = _union(len(root), held)
            held[:] = [(np.arange(len(root)), root)]
            yield x, y

        held: list = []
        return unit.edges(found())

    return join


LINKS = "id long, n_links long, near long"


def _verify(least: list[int], threshold: float):
    """The number of links of a unit's members, and an edge for each to the least of its group."""

    def verify(table: pa.Table) -> pa.Table:
        unit = _Unit(table)
        sets, sizes = _exact(unit)
        weight = unit.table.column("n_rows").to_numpy()
        n_links, linked = np.zeros(len(unit.ids), np.int64), []
        for x, y in _gathered(unit.survivors(least)):
            x, y = _near(unit, sets, sizes, x, y, threshold)
            np.add.at(n_links, x, weight[y])
            np.add.at(n_links, y, weight[x])
            linked.append((x, y))
        root = _union(len(unit.ids), linked)
        there = (n_links > 0) | (root != np.arange(len(unit.ids)))
        return pa.table({"id": unit.ids[there], "n_links": n_links[there], "near": unit.ids[root[there]]})

    return verify


def _gathered(pairs, least: int = 100_000):
    """Pairs in larger portions."""
    held, n = [], 0
    for left, right in pairs:
        held.append((left, right))
        n += len(left)
        if n >= least:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _runs(run: int):
    def runs(batches):
        for batch in batches:
            ids, found = [], []
            for i, same, text in zip(*(batch.column(c).to_pylist() for c in ("id", "same", "text")), strict=True):
                items = shingles(text, run).tobytes()
                if xxhash.xxh3_128_digest(items) == same:
                    ids.append(i)
                    found.append(items)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["id", "runs"])

    return runs


def _placed(members: DataFrame, sizes: DataFrame, salt: int) -> DataFrame:
    """Members (id, grp) with blocks and block, of sizes (grp, blocks)."""
    return members.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("id", F.lit(salt)), F.col("blocks")).cast("int"))


def _named(kind: str, *parts) -> Column:
    return F.concat_ws(":", F.lit(kind), F.col("grp"), *parts).alias("unit")


def _pairs_of_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, grp, unit, side): a small group is one unit, of a large one each pair of blocks is a unit."""
    spread = _placed(members, sizes, 17).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    unit = F.when(low == high, _named("all", low)).otherwise(_named("two", low, high))
    return spread.select("id", "grp", unit.alias("unit"), F.when(F.col("block") > F.col("other"), 1).otherwise(0).alias("side"))


def _stars(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, grp, unit, side): a small group is one unit, of a large one each block is, with the group's hub on side 1."""
    placed = _placed(members, sizes, 17)
    own = placed.select("id", "grp", F.when(F.col("blocks") == 1, _named("all")).otherwise(_named("star", F.col("block"))).alias("unit"), F.lit(0).alias("side"))
    hubs = sizes.where("blocks > 1").select(F.col("hub").alias("id"), "grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return own.unionByName(hubs.select("id", "grp", _named("star", F.col("block")), F.lit(1).alias("side")))


def _rests(members: DataFrame, sizes: DataFrame, rest: DataFrame, rest_sizes: DataFrame) -> DataFrame:
    """(id, grp, unit, side): the blocks of what a group's star left out, each with each block of the group."""
    ways = rest_sizes.select("grp", F.col("blocks").alias("rest_blocks"))
    whole = sizes.join(ways, "grp", "left_semi")
    some = _placed(rest, rest_sizes, 29).join(whole.select("grp", F.col("blocks").alias("all_blocks")), "grp").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)))
    every = _placed(members, whole, 17).join(ways, "grp").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)))
    return some.select("id", "grp", _named("rest", F.col("block"), F.col("other")), F.lit(0).alias("side")).unionByName(every.select("id", "grp", _named("rest", F.col("other"), F.col("block")), F.lit(1).alias("side")))


EDGES = "a long, b long, grp long, star boolean"


def _components(members: DataFrame, sizes: DataFrame, rest_blocks, fill, compare, name: str) -> DataFrame:
    """(id, component) by what compare finds, a written table: see _edges()."""
    parts = _edges(members, sizes, rest_blocks, fill, compare, name)
    found = stash(connected_components(reduce(DataFrame.unionByName, [p.select("a", "b") for p in parts])), "groups")
    unstash(*parts)
    return found


def _edges(members: DataFrame, sizes: DataFrame, rest_blocks, fill, compare, name: str) -> list[DataFrame]:
    """Tables of edges (a, b) that hold together what compare finds together in groups: members (id, grp), sizes (grp, blocks, hub).
    fill adds the columns that compare reads; rest_blocks gives the blocks of the rest of a group."""
    run = tidy_group(compare)
    first = stash(fill(_stars(members, sizes)).groupBy("unit").applyInArrow(run, EDGES), name)
    large = members.join(sizes.where("blocks > 1"), "grp").where("id <> hub").select("id", "grp")
    reached = first.where("star").select(F.col("a").alias("id"), "grp").unionByName(first.where("star").select(F.col("b").alias("id"), "grp"))
    rest = stash(large.join(reached, ["id", "grp"], "left_anti"), "rest")
    if not rest.limit(1).count():
        unstash(rest)
        return [first]
    rest_sizes = stash(rest_blocks(rest), "sizes")
    second = stash(fill(_rests(members, sizes, rest, rest_sizes)).groupBy("unit").applyInArrow(run, EDGES), name)
    unstash(rest, rest_sizes)
    return [first, second]


def near_duplicates(docs: DataFrame, threshold: float = 0.8, tolerance: float = 1e-6, run: int = RUN, links: bool = True) -> DataFrame:
    """A row for each document: doc_id, class_id (least doc_id of the class), set_id (least doc_id with the same runs) and, where
    links, n_links (other documents at the threshold or above)."""
    least = least_matches(threshold, tolerance)
    rows = texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_DOC)))
    known = stash(rows.mapInArrow(tidy(_sets(run)), "doc_id long, same binary, n_runs int, values binary").withColumn("row", F.monotonically_increasing_id()), "known")
    full = known.where("n_runs > 0")
    sets = full.groupBy("same").agg(F.min("row").alias("id"), F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("set_id"))
    sets = stash(sets.join(full.select(F.col("row").alias("id"), F.col("doc_id").alias("of"), "n_runs", "values"), "id"), "sets")
    slim = stash(known.select("doc_id", "same", "n_runs"), "slim")
    unstash(known)

    bands = stash(sets.select("id", "values").mapInArrow(tidy(_bands), "id long, band long"), "bands")
    sizes = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("hub"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).cast("string").alias("sum")).where("n > 1")
    # bands that hold the same sets are gone through once
    blocks = lambda n, size: F.ceil(n / size).cast("int").alias("blocks")
    sizes = stash(sizes.groupBy("n", "hub", "sum").agg(F.min("band").alias("grp")).select("grp", "hub", blocks(F.col("n"), VALUES_BLOCK)), "sizes")
    members = bands.withColumnRenamed("band", "grp").join(sizes.select("grp"), "grp", "left_semi")
    fill = lambda units: units.join(sets.select("id", "values"), "id")
    found = _components(members, sizes, lambda rest: rest.groupBy("grp").agg(blocks(F.count(F.lit(1)), VALUES_BLOCK)), fill, _link(least), "near")
    groups = found.withColumnRenamed("component", "grp")
    unstash(bands, sizes)

    held = stash(groups.join(sets.select("id", "n_runs"), "id"), "held")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_runs") / RUNS_BLOCK)).cast("int").alias("blocks")
    group_sizes = stash(held.groupBy("grp").agg(parts).withColumn("hub", F.col("grp")), "sizes")
    wanted = stash(groups.select("id").join(sets.select("id", "of", "same"), "id").select(F.col("of").alias("doc_id"), "id", "same"), "wanted")
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_SETS else wanted
    # the runs of the sets in groups are computed again: of the others no one has any use for them
    runs = rows.join(near, "doc_id").select("id", "same", "text").mapInArrow(tidy(_runs(run)), "id long, runs binary")
    fill_sets = lambda units: units.join(sets.select("id", "n_rows", "values"), "id").join(runs, "id")
    if links:
        linked = stash(fill_sets(_pairs_of_blocks(groups, group_sizes)).groupBy("unit").applyInArrow(tidy_group(_verify(least, threshold)), LINKS), "links")
        classes = stash(connected_components(linked.select(F.col("id").alias("a"), F.col("near").alias("b"))), "classes")
    else:
        linked = None
        rest_blocks = lambda rest: rest.join(held.select("id", "n_runs"), "id").groupBy("grp").agg(parts)
        classes = _components(groups, group_sizes, rest_blocks, fill_sets, _join(least, threshold), "links")
    unstash(wanted)

    placed = sets.select("id", "same", "set_id", "n_rows").join(classes, "id", "left")
    if links:
        counted = linked.groupBy("id").agg(F.sum("n_links").alias("n_links"))
        placed = placed.join(counted, "id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)) + F.col("n_rows") - 1)
    counts = ["n_links"] if links else []
    placed = stash(placed.select("same", "set_id", F.coalesce("component", "id").alias("component"), *counts), "placed")
    least_doc = stash(placed.groupBy("component").agg(F.min("set_id").alias("class_id")), "classes")
    final = placed.join(least_doc, "component").select("same", "set_id", "class_id", *counts)
    unstash(sets, found, held, group_sizes, classes, *([linked] if links else []))
    none = [F.lit(0).cast("long").alias("n_links")] if links else []
    empty = slim.where("n_runs = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"), *none)
    out = slim.where("n_runs > 0").select("doc_id", "same").join(final, "same").select("doc_id", "class_id", "set_id", *counts).unionByName(empty)
    null = lambda c: F.nullif(F.col(c), F.lit(NO_DOC)).alias(c)
    return out.select(null("doc_id"), null("class_id"), null("set_id"), *counts)


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents with all their columns, one of each class: that of the least doc_id (a null one is the least)."""
    rows = stash(docs.select(F.struct(*docs.columns).alias("document")).withColumn("row", F.monotonically_increasing_id()), "documents")
    found = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("document.text").alias("text")), threshold, links=False)
    ids = rows.select(F.col("row").alias("doc_id"), F.coalesce(F.col("document.doc_id").cast("long"), F.lit(NO_DOC)).alias("of"))
    kept = found.join(ids, "doc_id").groupBy("class_id").agg(F.min(F.struct("of", "doc_id")).alias("least")).select(F.col("least.doc_id").alias("row"))
    return rows.join(kept, "row", "left_semi").select("document.*")


def op4_query(spark, sf_dir):
    return near_duplicates(load(spark, sf_dir, "documents"))
