"""Sharding by a hierarchical weighted hash tree.

Regions hold racks, racks hold shards, and a node weighs what the shards below it weigh. A document descends: at each level every
child of the node that it has come to draws an exponential variate from the document's key, the level and the child, with the child's
weight as rate, and the least draw wins. So a child is chosen by its share of the weight, and nothing outside the
chosen subtree is looked at.

A draw changes only with its own node's weight. Where some shard's weight changes, so do those of its rack and its region: documents
move between that region and others, and inside it between that rack and others, and in the rack between that shard and others; no
document moves between two subtrees whose weights are as before. A new region takes documents only into itself.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLOT_BUCKETS = 1024


@dataclass(frozen=True)
class Shard:
    number: int
    rack: int
    region: int
    weight: float = 1.0


def topology(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> tuple[Shard, ...]:
    """Equal shards, filled rack by rack and region by region."""
    return tuple(Shard(i, i // per_rack, i // (per_rack * racks_per_region)) for i in range(shards))


def _tree(shards: Sequence[Shard]) -> list[list[list[tuple[int, float]]]]:
    """The children (number and weight) of every node by level: the regions, each region's racks, each rack's shards.

    Children are named by their numbers, and listed with their parents in the order of the level above.
    """
    live = [s for s in shards if s.weight > 0]
    if not live:
        raise ValueError("no shards")
    if len({s.number for s in live}) < len(live):
        raise ValueError("two shards of one number")
    paths = [((s.region,), (s.region, s.rack), (s.region, s.rack, s.number)) for s in live]
    weight: dict[tuple[int, ...], float] = {}
    for shard, nodes in zip(live, paths, strict=True):
        for node in nodes:
            weight[node] = weight.get(node, 0.0) + shard.weight
    levels, parents = [], [()]
    for depth in (1, 2, 3):
        nodes = sorted(n for n in weight if len(n) == depth)
        levels.append([[(n[-1], weight[n]) for n in nodes if n[:-1] == p] for p in parents])
        parents = nodes
    return levels


def _draw(seed: Column, depth: Column, key: Column, *path: Column):
    """The draw of one child, from the key and the numbers on the way to it."""
    def of(child: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(key, seed, depth, *path, child["number"]), 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(unit) / child["weight"]).alias("draw"), child["number"].alias("number"), child["at"].alias("at"))
    return of


def place(key: Column, shards: Sequence[Shard], seed: int = 0) -> Column:
    """The shard number that a key descends to.

    A draw is ``-ln(u) / weight`` with u from the key, the level and the numbers on the way to the child; of equal draws the lower number
    wins. A NULL key has one place, like any other value. The tree is three constant arrays, so the expression is of the same size for
    any number of shards, and a row evaluates one node's children a level.
    """
    children = T.ArrayType(T.ArrayType(T.StructType([
        T.StructField("number", T.LongType()), T.StructField("weight", T.DoubleType()), T.StructField("at", T.IntegerType())])))
    path, at = [], F.lit(0)
    for depth, level in enumerate(_tree(shards)):
        first = [0, *itertools.accumulate(len(c) for c in level)]  # a child's place in the level below
        listed = [[{"number": n, "weight": w, "at": first[i] + j} for j, (n, w) in enumerate(c)] for i, c in enumerate(level)]
        options = F.get(F.from_json(F.lit(json.dumps(listed)), children), at)

        won = F.array_min(F.transform(options, _draw(F.lit(seed), F.lit(depth), key, *path)))
        path.append(won["number"])
        at = won["at"]
    return path[-1].cast("int")


def assign(df: DataFrame, shards: Sequence[Shard], key_col: str = "doc_id", text_col: str = "text",
           grown: Sequence[Shard] | None = None, buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Shard, slot and size of every row, by the ``key`` law: key and tree alone decide.

    Columns: the key, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``shard``,
    ``slot`` (gapless from 0 in each shard), ``grown_shard`` (in the tree ``grown``).

    One row comes back per row. A NULL text has size 8 and the checksum of the empty
    text. Repeated keys share a shard and have slots of their own, in no set order
    among equal rows.

    Texts aren't shuffled. Slots are counted in ``buckets`` parts of each shard, so
    that no task holds a shard: one pass over keys and texts counts the parts, which gives
    each part's first slot, and rows are numbered inside their part.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    shard = place(df[key_col], shards).alias("shard")
    crc = F.crc32(text.cast("binary")).alias("text_crc32")
    # a key on many rows is spread by their texts
    part = F.pmod(F.xxhash64(df[key_col], crc, F.lit("slot")), F.lit(buckets)).cast("int").alias("part")
    rows = df.select(
        df[key_col].alias("key"), (F.octet_length(text) + 8).cast("long").alias("size"), crc, shard, part,
        (place(df[key_col], grown) if grown else F.lit(None).cast("int")).alias("grown_shard"))
    sizes = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    firsts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy("shard", "part").orderBy("key", "text_crc32", "size")
    numbered = rows.withColumn("row", F.row_number().over(inside) - 1)
    # at most buckets rows for each shard, both parameters
    joined = numbered.join(F.broadcast(firsts), ["shard", "part"])
    return joined.select(
        F.col("key").alias(key_col), "size", "text_crc32", F.col("shard").cast("int"),
        (F.col("first") + F.col("row")).cast("long").alias("slot"), F.col("grown_shard").cast("int"))


def write_shards(df: DataFrame, path: str, shards: Sequence[Shard], key_col: str = "doc_id") -> None:
    """Write whole rows into one folder per shard, without a shuffle. Rows with a NULL key share one shard."""
    if "shard" in df.columns:
        raise ValueError("the column shard names the folders")
    df.withColumn("shard", place(df[key_col], shards)).write.partitionBy("shard").parquet(path)


def balance(assigned: DataFrame) -> DataFrame:
    """Rows and bytes of each shard that has a row; an empty assignment gives none."""
    return assigned.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def moved(assigned: DataFrame) -> DataFrame:
    """Rows by shard before and after growth, for those that move; none where no growth was asked for."""
    changed: Column = reduce(lambda a, b: a & b, [F.col("grown_shard").isNotNull(),
                                                  F.col("grown_shard") != F.col("shard")])
    return assigned.where(changed).groupBy("shard", "grown_shard").agg(F.count("*").alias("rows"))
