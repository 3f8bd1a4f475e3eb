"""Shards by virtual slots.

A record belongs to one of a fixed number of virtual slots, by a hash of all its columns; copies of
an equal record are dealt to the slots from that one on in turn. So neither a key nor a record that
is repeated often, nor null keys, fill a slot. Slots, not records, are dealt to shards: a map from slot to shard is stored with a version, and
rebalancing appends a version in which single slots have moved. The map has one row for each
slot, whatever the number of records, so the driver may hold and edit it.

What is large stays on the executors: bytes and rows are summed by slot before anything
moves, and a record finds its place in its shard from the counts of the slots before its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.functions.semantics import col, require
from gridmill.llm.common import fresh, without

SLOTS = 8192
MAP_SCHEMA = "version int, slot int, shard int, shards int, bytes bigint, rows bigint"


@dataclass(frozen=True)
class SlotMap:
    """Which shard each virtual slot belongs to, in one version."""

    shard: tuple[int, ...]
    shards: int
    version: int = 1
    bytes: tuple[int, ...] = field(default=(), repr=False)
    rows: tuple[int, ...] = field(default=(), repr=False)

    @classmethod
    def first(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(tuple(s % shards for s in range(slots)), shards, 1, (0,) * slots, (0,) * slots)

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.shard):
            out[shard] += self.bytes[slot]
        return out

    def measured(self, sizes: dict[int, tuple[int, int]]) -> SlotMap:
        """The same map with the bytes and rows of each slot."""
        found = [sizes.get(s, (0, 0)) for s in range(len(self.shard))]
        return replace(self, bytes=tuple(b for b, _ in found), rows=tuple(r for _, r in found))

    def rebalanced(self) -> SlotMap:
        """A next version with near equal bytes.

        Each shard keeps its largest slots for as long as they fit under the mean; the slots that
        are left, largest first, go to the emptiest shard. So few slots move when sizes change little.
        """
        goal = sum(self.bytes) / self.shards
        loads = [0] * self.shards
        new: list[int] = list(self.shard)
        loose: list[int] = []
        for slot in sorted(range(len(new)), key=lambda s: (-self.bytes[s], s)):
            if loads[new[slot]] + self.bytes[slot] <= goal:
                loads[new[slot]] += self.bytes[slot]
            else:
                loose.append(slot)
        emptiest = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(emptiest)
        for slot in loose:
            load, shard = heapq.heappop(emptiest)
            new[slot] = shard
            heapq.heappush(emptiest, (load + self.bytes[slot], shard))
        return replace(self, shard=tuple(new), version=self.version + 1)

    def grown(self) -> SlotMap:
        """A next version with one more shard, which takes slots from the fullest others; no other slot moves."""
        goal = sum(self.bytes) / (self.shards + 1)
        new, loads, held = list(self.shard), [*self.loads(), 0], [[] for _ in range(self.shards)]
        for slot in sorted(range(len(new)), key=lambda s: (self.bytes[s], s)):
            held[new[slot]].append(slot)  # the largest last
        fullest = [(-loads[s], s) for s in range(self.shards)]
        heapq.heapify(fullest)
        while fullest and loads[self.shards] < goal:
            _, shard = heapq.heappop(fullest)
            while held[shard] and loads[self.shards] + self.bytes[held[shard][-1]] > goal:
                held[shard].pop()  # too large for what the new shard still needs
            if not held[shard] or loads[shard] <= goal:
                continue
            slot = held[shard].pop()
            new[slot] = self.shards
            loads[shard] -= self.bytes[slot]
            loads[self.shards] += self.bytes[slot]
            heapq.heappush(fullest, (-loads[shard], shard))
        return replace(self, shard=tuple(new), shards=self.shards + 1, version=self.version + 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, s, d, self.shards, self.bytes[s], self.rows[s]) for s, d in enumerate(self.shard)]
        return spark.createDataFrame(rows, MAP_SCHEMA)

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the table of maps at ``path``."""
        self.frame(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The newest, or the named, version of the map stored at ``path``."""
    held = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = held.agg(F.max("version")).first()[0]
    rows = held.filter(F.col("version") == version).orderBy("slot").collect()  # one row a slot
    if not rows:
        raise ValueError(f"no version {version} at {path}")
    return SlotMap(tuple(r.shard for r in rows), rows[0].shards, version, tuple(r.bytes for r in rows), tuple(r.rows for r in rows))


NEW = ("shard", "place", "virtual_slot")


def dealt(records: DataFrame, also: dict[str, Column], slots: int, slot: str, times: str) -> DataFrame:
    """Distinct records, with the columns ``also``, by virtual slot, and how many copies of each the slot has.

    Copy 0 lies in the slot of the record's hash, copy i in the i-th slot after it, so a record has at most
    ``slots`` rows here, and one more copy moves no other.
    """
    names = records.columns
    nth, all_times = (fresh([*names, *also, slot, times], n) for n in ("_nth", "_all_times"))
    once = records.withColumns(also).groupBy(*[col(c) for c in [*names, *also]]).agg(F.count(F.lit(1)).alias(all_times))
    each = once.withColumn(nth, F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(col(all_times), F.lit(slots)) - 1)))
    # a null is told by its place: the hash passes nulls over
    own = F.pmod(F.xxhash64(*[e for c in names for e in (col(c), col(c).isNull())]), F.lit(slots))
    here = F.floor((col(all_times) - col(nth) - 1) / slots).cast("bigint") + 1
    return each.withColumns({slot: F.pmod(own + col(nth), F.lit(slots)).cast("int"), times: here}).drop(nth, all_times)


def slot_sizes(records: DataFrame, size: Column, slots: int = SLOTS) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that has any; at most ``slots`` rows reach the driver."""
    bytes_, slot, times = (fresh(records.columns, n) for n in ("_bytes", "_slot", "_times"))
    summed = dealt(records, {bytes_: size}, slots, slot, times).groupBy(col(slot).alias("slot")).agg(
        F.sum(col(bytes_) * col(times)).cast("bigint").alias("bytes"), F.sum(col(times)).alias("rows")
    )
    return {r.slot: (r.bytes or 0, r.rows) for r in summed.collect()}


def rebalance(
    records: DataFrame, key: str, size: Column, shards: int, path: str, slots: int = SLOTS, new: Sequence[str] = NEW
) -> SlotMap:
    """Measure the records and store the map that balances their bytes at ``path``.

    ``new`` has the names that ``placed`` will add: columns of these names are not part of a record.
    Starts from the newest version at ``path`` if ``path`` holds one for as many shards and slots,
    else from a first version that deals slots round robin, which is stored too.
    """
    require(records, key)
    spark = records.sparkSession
    known = _stored(spark, path)
    if known is None or known.shards != shards or len(known.shard) != slots:
        version = known.version + 1 if known else 1
        known = replace(SlotMap.first(shards, slots), version=version)
        known.save(spark, path)
    kept = records.select(*without(records, new))
    balanced = known.measured(slot_sizes(kept, size, slots)).rebalanced()
    balanced.save(spark, path)
    return balanced


def _stored(spark: SparkSession, path: str) -> SlotMap | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return load_map(spark, path) if there else None


def placed(
    records: DataFrame, key: str, size: Column, slot_map: SlotMap, order: list[Column],
    shard: str = "shard", place: str = "place", slot: str = "virtual_slot",
) -> DataFrame:
    """Add each record's virtual slot, its shard by ``slot_map``, and its place in the shard (0, 1, 2 ... without gaps).

    Places follow the virtual slots in order, and ``key`` and ``order`` inside a slot. Only rows of one
    slot meet in a task, and equal rows are counted before they do. A key that fills a third of the table
    is spread over the slots, by its other columns and, where rows are equal, by copy; so are null keys.
    ``slot_map`` must have been measured on these records (``rebalance``, with the same new names).
    An empty table gives an empty result; columns of the new names are replaced.
    """
    require(records, key)
    kept = records.select(*without(records, [shard, place, slot]))
    names = list(kept.columns)
    virtual, times, last, before = (fresh([*names, shard], n) for n in ("_slot", "_times", "_last", "_before"))
    sorts = [fresh(names, f"_order{i}") for i in range(len(order))]
    starts: list[int] = [0] * len(slot_map.shard)
    used = [0] * slot_map.shards
    for s, d in enumerate(slot_map.shard):
        starts[s], used[d] = used[d], used[d] + slot_map.rows[s]
    spark = records.sparkSession
    rows = [(s, d, starts[s]) for s, d in enumerate(slot_map.shard) if slot_map.rows[s]]
    where = spark.createDataFrame(rows, f"{virtual} int, {shard} int, {before} bigint")  # bounded by the number of slots
    counted = dealt(kept, dict(zip(sorts, order, strict=True)), len(slot_map.shard), virtual, times)
    ahead = Window.partitionBy(virtual).orderBy(col(key).asc_nulls_last(), *sorts, *[col(c) for c in names])
    ends = counted.withColumn(last, F.sum(times).over(ahead.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        ends.join(F.broadcast(where), virtual)
        .withColumn(place, F.explode(F.sequence(F.col(before) + F.col(last) - F.col(times), F.col(before) + F.col(last) - 1)))
        .select(*[col(c) for c in names], col(virtual).alias(slot), shard, place)
    )
