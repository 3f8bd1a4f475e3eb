"""Slot maps and places in shards."""

import random

import pytest
from pyspark.sql import functions as F

from gridmill.llm import sharding
from gridmill.llm.queries import op9
from gridmill.session import scratch_path


@pytest.fixture(scope="module")
def records(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([1, 10, 10, 500, 20_000]), "v") for i in range(3000)] + [(7, 10, "v")] * 40 + [(None, 5, "v"), (None, 6, "v")]
    return spark.createDataFrame(rows, "doc_id long, size long, _slot string")


def spread(records, slot_map):
    out = sharding.placed(records, "doc_id", F.col("size"), slot_map, [])
    return out, {r.shard: r for r in out.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.min("place").alias("low"), F.max("place").alias("high")).collect()}


def test_versions_and_places(spark, records):
    path = scratch_path(spark, "map")
    slot_map = sharding.rebalance(records, "doc_id", F.col("size"), 8, path)
    assert slot_map.version == 2 and sharding.load_map(spark, path) == slot_map
    assert sharding.load_map(spark, path, 1).shard == sharding.SlotMap.first(8).shard
    out, by = spread(records.repartition(6), slot_map)
    assert out.columns == ["doc_id", "size", "_slot", "virtual_slot", "shard", "place"] and out.count() == records.count()
    mean = sum(r.bytes for r in by.values()) / 8
    assert len(by) == 8 and max(abs(r.bytes - mean) for r in by.values()) < 0.02 * mean
    assert all((r.low, r.high, r.places) == (0, r.n - 1, r.n) for r in by.values())
    assert sum(slot_map.rows) == records.count() and sum(slot_map.bytes) == records.agg(F.sum("size")).first()[0]


@pytest.mark.parametrize("hot", [7, None])
@pytest.mark.parametrize("equal", [True, False])
def test_a_key_with_a_third_of_the_rows_is_spread(spark, hot, equal):
    rows = [(i, 10, f"t{i}") for i in range(4000)] + [(hot, 10, "same" if equal else f"h{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, size long, word string")
    slot_map = sharding.rebalance(df, "doc_id", F.col("size"), 16, scratch_path(spark, "map"))
    out, by = spread(df.repartition(6), slot_map)
    mean = sum(slot_map.bytes) / 16
    assert sum(slot_map.rows) == 6000 and max(slot_map.bytes) < 0.1 * mean
    assert len(by) == 16 and max(abs(r.bytes - mean) for r in by.values()) < 0.02 * mean
    assert all((r.low, r.high, r.places) == (0, r.n - 1, r.n) for r in by.values())
    assert sorted(map(repr, out.select("doc_id", "size", "word").collect())) == sorted(map(repr, df.collect()))


def test_growth_moves_rows_only_to_the_new_shard(spark, records):
    old = sharding.rebalance(records, "doc_id", F.col("size"), 8, scratch_path(spark, "map"))
    new = old.grown()
    moved = [(a, b) for a, b in zip(old.shard, new.shard) if a != b]
    assert moved and {b for _, b in moved} == {8} and new.version == 3 and new.shards == 9
    loads = new.loads()
    assert loads[8] > 0.9 * sum(loads) / 9


def test_little_change_moves_little(spark, records):
    path = scratch_path(spark, "map")
    first = sharding.rebalance(records, "doc_id", F.col("size"), 8, path)
    more = records.unionByName(spark.createDataFrame([(9001, 300, "v")], records.schema))
    second = sharding.rebalance(more, "doc_id", F.col("size"), 8, path)
    assert second.version == 3 and sum(a != b for a, b in zip(first.shard, second.shard)) < 0.2 * len(first.shard)
    other = sharding.rebalance(more, "doc_id", F.col("size"), 5, path)
    assert other.shards == 5 and sharding.load_map(spark, path) == other


def test_empty_and_clashing(spark, records):
    none = records.limit(0)
    slot_map = sharding.rebalance(none, "doc_id", F.col("size"), 4, scratch_path(spark, "map"))
    assert sharding.placed(none, "doc_id", F.col("size"), slot_map, []).count() == 0
    named = records.limit(20).selectExpr("doc_id", "size", "'a' AS shard", "'b' AS _last", "'c' AS _start")
    path = scratch_path(spark, "map")
    slot_map = sharding.rebalance(named, "doc_id", F.col("size"), 4, path)
    out = sharding.placed(named, "doc_id", F.col("size"), slot_map, [])
    assert out.count() == 20 and out.columns == ["doc_id", "size", "_last", "_start", "virtual_slot", "shard", "place"]
    with pytest.raises(ValueError):
        sharding.load_map(spark, path, 99)


def test_query(spark, sf):
    import zlib

    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op9(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {k: (len(t) + 1, zlib.crc32(t)) for k, t in docs.items()}
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    for shard in range(16):
        places = sorted(r.slot for r in rows if r.shard == shard)
        assert places == list(range(len(places)))
