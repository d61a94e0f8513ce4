"""Slots, movement and weights of the tree."""

import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from murmur.llm import sharding
from pyspark.sql import functions as F


def docs(spark, n=6000):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("é"), F.col("id")).alias("text"), F.lit(1).alias("shard"))


def test_slots_are_gapless_and_sizes_right(spark):
    odd = spark.createDataFrame([(None, None, 1), (None, "", 1), (7, "é7", 1), (7, "é7", 1)], "doc_id long, text string, shard int")
    rows = sharding.assign(docs(spark).union(odd), sharding.topology(24), grown=sharding.topology(25)).collect()
    assert len(rows) == 6004
    slots = {}
    for r in rows:
        text = "" if r["doc_id"] is None else f"é{r['doc_id']}"
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 8, zlib.crc32(text.encode()))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1


@pytest.mark.parametrize("shards", [1, 8, 24])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    rows = sharding.assign(docs(spark), sharding.topology(shards), grown=sharding.topology(shards + 1)).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {shards}
    assert abs(len(moved) - 6000 / (shards + 1)) < 5 * (6000 / (shards + 1)) ** 0.5


def plain_place(key, shards, seed=0):
    """The descent in plain Python, with Spark's xxhash64 of longs and integers chained by seed."""
    def mixed(*values):
        state = 42
        for kind, value in values:
            if value is not None:
                state = xxhash.xxh64_intdigest(struct.pack(kind, value), state)
        return state

    live = [s for s in shards if s.weight > 0]
    path = []
    for depth, of in enumerate((lambda s: s.region, lambda s: s.rack, lambda s: s.number)):
        weights = {}
        for s in live:
            weights[of(s)] = weights.get(of(s), 0.0) + s.weight
        draws = []
        for child, weight in weights.items():
            h = mixed(("<q", key), ("<i", seed), ("<i", depth), *(("<q", p) for p in path), ("<q", child))
            draws.append((-math.log(((h >> 11) + 0.5) / (1 << 53)) / weight, child))
        path.append(min(draws)[1])
        live = [s for s in live if of(s) == path[-1]]
    return path[-1]


@pytest.mark.parametrize("seed", [0, 5])
def test_places_equal_a_plain_descent(spark, seed):
    shards = tuple(sharding.Shard(s.number, s.rack, s.region, 0.25 + s.number % 3) for s in sharding.topology(29)) + (sharding.Shard(99, 0, 0, 0.0),)
    keys = spark.createDataFrame([(i,) for i in [*range(-500, 1500), None]], "k long")
    got = keys.select("k", sharding.place(F.col("k"), shards, seed).alias("at")).collect()
    assert all(r["at"] == plain_place(r["k"], shards, seed) for r in got)
    with pytest.raises(ValueError):
        sharding.place(F.col("k"), [])
    with pytest.raises(ValueError):
        sharding.place(F.col("k"), [*shards, shards[0]])


def moves(spark, old, new, n=20_000):
    rows = sharding.assign(docs(spark, n), old, grown=new).collect()
    return [(r["shard"], r["grown_shard"]) for r in rows if r["shard"] != r["grown_shard"]], Counter(r["grown_shard"] for r in rows)


def test_weights_set_the_shares_and_confine_movement(spark):
    old = sharding.topology(16)  # two regions of two racks of four
    new = tuple(s if s.number != 5 else sharding.Shard(5, s.rack, s.region, 3.0) for s in old)
    moved, counts = moves(spark, old, new)
    assert abs(counts[5] / 20_000 - 3 / 18) < 0.015 and abs(counts[9] / 20_000 - 1 / 18) < 0.01
    region, rack = {s.number: s.region for s in old}, {s.number: s.rack for s in old}
    for a, b in moved:  # into the region, in the region into the rack, in the rack into the shard: the weights that grew
        assert region[b] == 0
        assert region[a] == 1 or (rack[b] == 1 and (rack[a] == 0 or b == 5))


def test_a_new_region_takes_rows_only_into_itself(spark):
    old = sharding.topology(16)
    new = old + tuple(sharding.Shard(100 + i, 50 + i // 2, 9) for i in range(4))
    moved, counts = moves(spark, old, new)
    assert {b for _, b in moved} == {100, 101, 102, 103}
    assert all(abs(counts[s.number] / 20_000 - 1 / 20) < 0.01 for s in new)


def test_moving_a_rack_moves_rows_of_the_regions_that_change(spark):
    old = sharding.topology(24)  # three regions
    new = tuple(sharding.Shard(s.number, s.rack, 1 if s.rack == 1 else s.region) for s in old)  # rack 1 goes from region 0 to 1
    moved, _ = moves(spark, old, new)
    region, moved_to = {s.number: s.region for s in old}, {s.number: s.region for s in new}
    assert moved
    # region 2 weighs as before: it only takes from the lighter region 0, and gives to the heavier region 1
    assert all(moved_to[b] == 1 for a, b in moved if region[a] == 2)
    assert all(region[a] == 0 for a, b in moved if moved_to[b] == 2)
    assert not [1 for a, b in moved if region[a] == moved_to[b] == 2]


def test_thousands_of_shards_compile(spark):
    shards = sharding.topology(6000, per_rack=40, racks_per_region=10)
    got = docs(spark, 3000).select(sharding.place(F.col("doc_id"), shards).alias("at")).agg(F.count_distinct("at")).first()[0]
    assert got > 2000


def test_balance_moved_and_long_texts(spark):
    df = spark.createDataFrame([(1, "x" * 3_000_000), (2, None), (None, "é"), (None, "y"), (1, "other")], "doc_id long, text string")
    assigned = sharding.assign(df, sharding.topology(4), grown=sharding.topology(8))
    rows = assigned.collect()
    assert sorted(r["size"] for r in rows) == sorted([3_000_008, 8, 10, 9, 13])
    balance = {r["shard"]: (r["rows"], r["bytes"]) for r in sharding.balance(assigned).collect()}
    assert sum(n for n, _ in balance.values()) == 5 and sum(b for _, b in balance.values()) == 3_000_048
    moved = {(r["shard"], r["grown_shard"]): r["rows"] for r in sharding.moved(assigned).collect()}
    assert moved == dict(Counter((r["shard"], r["grown_shard"]) for r in rows if r["shard"] != r["grown_shard"]))
    same = sharding.assign(df, sharding.topology(4))
    assert sharding.moved(same).collect() == [] and sharding.balance(same.limit(0)).collect() == []


def test_null_keys_are_written_to_one_shard(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (None, "b"), (3, "c")], "doc_id long, text string")
    path = str(tmp_path / "nulls")
    sharding.write_shards(df, path, sharding.topology(6))
    saved = spark.read.parquet(path)
    assert saved.count() == 3 and saved.where("doc_id is null").select("shard").distinct().count() == 1


def test_empty_table_and_folders(spark, tmp_path):
    assert sharding.assign(docs(spark).limit(0), sharding.topology(4)).count() == 0
    path = str(tmp_path / "shards")
    sharding.write_shards(docs(spark, 100).drop("shard"), path, sharding.topology(4))
    assert spark.read.parquet(path).count() == 100
    with pytest.raises(ValueError):
        sharding.write_shards(docs(spark), path, sharding.topology(4))
