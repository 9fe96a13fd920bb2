"""Versioned keys: snapshot reads, scans, conflicts and live statistics over tables.

versions (key, commit_ts, value; a null value is a deletion), own (key, value) for writes not committed yet, ranges (range_id,
start_key, end_key; an empty end is open), spans (span_start, span_end), intents (key, txn_id). Spans are half open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SerializationConflict
from ..sources.tables import materialise


def latest(versions: DataFrame, ts: int | Column, keys: str = "key") -> DataFrame:
    """(key, value): of each key the newest version not after ts; deleted keys are left out."""
    seen = versions.where(F.col("commit_ts") <= ts)
    return seen.groupBy(keys).agg(F.max_by("value", "commit_ts").alias("value")).where("value is not null")


def overlay(committed: DataFrame, own: DataFrame) -> DataFrame:
    """Own writes hide what is committed; an own deletion hides the key."""
    mine = own.select("key", F.col("value").alias("own_value"), F.lit(True).alias("mine"))
    both = committed.join(mine, "key", "full_outer")
    return both.select("key", F.when(F.col("mine"), F.col("own_value")).otherwise(F.col("value")).alias("value")).where("value is not null")


def within(start: Column, end: Column, key: Column) -> Column:
    return (key >= start) & ((F.octet_length(end) == 0) | (key < end))


def get(versions: DataFrame, key, ts: int, own: DataFrame | None = None) -> DataFrame:
    found = latest(versions.where(F.col("key") == key), ts)
    return found if own is None else overlay(found, own.where(F.col("key") == key))


def scan(versions: DataFrame, start, end, ts: int, own: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(key, value) of start <= key < end at ts, in order of keys; limit: the first of them."""
    inside = lambda df: df.where(within(F.lit(start), F.lit(end), F.col("key")))
    found = latest(inside(versions), ts)
    found = (found if own is None else overlay(found, inside(own))).orderBy("key")
    return found if limit is None else found.limit(limit)


def scan_end(page: DataFrame, limit: int) -> DataFrame:
    """read_end of a limited scan: just behind the last key if the scan was cut, else null."""
    last = F.when(F.count(F.lit(1)) >= limit, F.concat(F.max(F.col("key").cast("binary")), F.lit(b"\x00")))
    return page.agg(last.alias("read_end"))


def footprint(page: DataFrame, start, end, limit: int) -> DataFrame:
    """The span that a limited scan has read, for validate: to just behind its last key if it was cut, else all of it."""
    cut = F.col("read_end").cast(page.schema["key"].dataType)
    return scan_end(page, limit).select(F.lit(start).alias("span_start"), F.coalesce(cut, F.lit(end)).alias("span_end"))


#: Lists of ranges or keys up to this length go to every task.
BROADCAST_RANGES = 1_000


def ranged(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ranges of the keys and written with the number of their part."""
    return materialise(df.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranged")


def route(keys: DataFrame, ranges: DataFrame, broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """(key, range_id): the range that owns each key. Few ranges go to every task. Many are dealt by key together with the keys:
    each part finds the last start before a key within itself, or else the last one of the parts before, a row for each part."""
    if ranges.count() <= broadcast_ranges:
        return keys.join(F.broadcast(ranges), within(F.col("start_key"), F.col("end_key"), F.col("key"))).select("key", "range_id")
    owner = ranges.schema["range_id"].dataType
    starts = ranges.select(F.col("start_key").alias("key"), F.lit(0).alias("side"), "range_id")
    both = ranged(keys.select("key", F.lit(1).alias("side"), F.lit(None).cast(owner).alias("range_id")).unionByName(starts), "key", "side")
    last, carried = None, []
    for r in sorted(both.groupBy("part").agg(F.max_by("range_id", F.when(F.col("side") == 0, F.col("key"))).alias("last")).collect()):
        carried.append((r.part, last))
        last = last if r["last"] is None else r["last"]
    before = keys.sparkSession.createDataFrame(carried, f"part int, before {owner.simpleString()}")
    up = Window.partitionBy("part").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("found", F.last("range_id", ignorenulls=True).over(up)).where("side = 1")
    return found.join(F.broadcast(before), "part").select("key", F.coalesce("found", "before").alias("range_id"))


def _places(rows: DataFrame, key: str, starts: DataFrame, upto: bool, name: str) -> DataFrame:
    """The rows with the number of starts (start_key) before their key, or, upto, not after it. Rows and starts are dealt by key; a
    part knows the starts of the parts before it from a row for each part."""
    side = F.lit(0 if upto else 2)
    own = rows.select(F.col(key).alias("key"), F.lit(1).alias("side"), F.struct(*rows.columns).alias("row"))
    kind = own.schema["row"].dataType
    both = ranged(own.unionByName(starts.select(F.col("start_key").alias("key"), side.alias("side"), F.lit(None).cast(kind).alias("row"))), "key", "side")
    before, n = [], 0
    for r in sorted(both.groupBy("part").agg(F.count_if(F.col("side") != 1).alias("n")).collect()):
        before.append((r.part, n))
        n += r.n
    up = Window.partitionBy("part").orderBy("key", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("here", F.count_if(F.col("side") != 1).over(up)).where("side = 1")
    behind = rows.sparkSession.createDataFrame(before, "part int, behind long")
    return counted.join(F.broadcast(behind), "part").select("row.*", (F.col("here") + F.col("behind")).alias(name))


def clip(spans: DataFrame, ranges: DataFrame, broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """Spans cut at the borders of ranges, which do not overlap: span columns, range columns, clip_start, clip_end. Few ranges go to
    every task; of many, a span finds the first and the last it meets by their places in the order of keys."""
    open_end, open_range = F.octet_length("span_end") == 0, F.octet_length("end_key") == 0
    meets = (F.col("span_start") < F.col("end_key")) | open_range
    meets &= (F.col("start_key") < F.col("span_end")) | open_end
    n = ranges.count()
    if n <= broadcast_ranges:
        joined = spans.join(F.broadcast(ranges), meets)
    else:
        numbered = _places(ranges, "start_key", ranges, True, "$place")
        placed = _places(_places(spans, "span_start", ranges, True, "$first"), "span_end", ranges, False, "$last")
        last = F.when(open_end, F.lit(n).cast("long")).otherwise(F.col("$last"))
        met = placed.withColumn("$last", last).where(F.col("$last") >= F.greatest(F.col("$first"), F.lit(1)))
        met = met.withColumn("$place", F.explode(F.sequence(F.greatest(F.col("$first"), F.lit(1).cast("long")), F.col("$last"))))
        joined = met.join(numbered, "$place").where(meets).select(*spans.columns, *ranges.columns)
    end = F.when(open_range, F.col("span_end")).when(open_end, F.col("end_key")).otherwise(F.least("span_end", "end_key"))
    return joined.withColumn("clip_start", F.greatest("span_start", "start_key")).withColumn("clip_end", end)


def at_place(df: DataFrame, key: str, place: int) -> DataFrame:
    """The row at a place, from 0, of the order of a key: found among the parts of its range, of which one is sorted."""
    dealt = ranged(df, key)
    for r in sorted(dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):
        if place < r.n:
            return dealt.where(F.col("part") == r.part).drop("part").orderBy(key).offset(place).limit(1)
        place -= r.n
    return df.limit(0)


def live_stats(versions: DataFrame, ts: int) -> DataFrame:
    """n_keys, n_bytes of keys and newest values, and the key in the middle (null if there is none)."""
    live = materialise(latest(versions, ts), "live")
    size = F.octet_length("key") + F.octet_length("value")
    total = live.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes"))
    middle = at_place(live.select("key"), "key", total.first().n_keys // 2).select(F.col("key").alias("median_key"))
    return total.join(middle, F.lit(True), "left")


def write_conflicts(writes: DataFrame, versions: DataFrame, intents: DataFrame, start_ts: int, txn_id: str) -> DataFrame:
    """Keys to be written that have a newer version, or an intent of another transaction."""
    newer = versions.where(F.col("commit_ts") > start_ts).select("key")
    foreign = intents.where(F.col("txn_id") != txn_id).select("key")
    return writes.select("key").join(newer.unionByName(foreign), "key", "left_semi").distinct()


def read_conflicts(spans: DataFrame, versions: DataFrame, intents: DataFrame, start_ts: int, commit_ts: int, txn_id: str, broadcast_keys: int = BROADCAST_RANGES) -> DataFrame:
    """Spans read in which a version of (start_ts, commit_ts] or a foreign intent lies: phantoms count. Few changed keys go to every
    task; of many, a span counts those before its start and before its end."""
    changed = versions.where((F.col("commit_ts") > start_ts) & (F.col("commit_ts") <= commit_ts)).select("key")
    changed = materialise(changed.unionByName(intents.where(F.col("txn_id") != txn_id).select("key")).distinct(), "changed")
    n = changed.count()
    if n <= broadcast_keys:
        return spans.join(F.broadcast(changed), within(F.col("span_start"), F.col("span_end"), F.col("key")), "left_semi")
    keys = changed.withColumnRenamed("key", "start_key")
    placed = _places(_places(spans, "span_start", keys, False, "$first"), "span_end", keys, False, "$last")
    last = F.when(F.octet_length("span_end") == 0, F.lit(n).cast("long")).otherwise(F.col("$last"))
    return placed.where(last > F.col("$first")).select(*spans.columns)


def prewrite(writes, versions, intents, start_ts: int, txn_id: str) -> None:
    if write_conflicts(writes, versions, intents, start_ts, txn_id).limit(1).count():
        raise SerializationConflict("a key was written by another transaction")


def validate(spans, versions, intents, start_ts: int, commit_ts: int, txn_id: str) -> None:
    if read_conflicts(spans, versions, intents, start_ts, commit_ts, txn_id).limit(1).count():
        raise SerializationConflict("what was read has changed")


def apply(versions: DataFrame, writes: DataFrame, commit_ts: int) -> DataFrame:
    return versions.unionByName(writes.select("key", F.lit(commit_ts).cast("long").alias("commit_ts"), "value"))


def timestamps(milliseconds: Column, place: Column) -> Column:
    """Strictly increasing timestamps: milliseconds in the upper bits, a counter in the lower eighteen."""
    return F.call_function("shiftleft", milliseconds, F.lit(18)).bitwiseOR(place)
