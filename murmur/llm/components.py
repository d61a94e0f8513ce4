"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.scale import BROADCAST_BYTES, BROADCAST_ROWS, stage
from murmur.llm.textops import map_arrow

MAX_ROUNDS = 60
_BLOCK = 100_000  # a task ties so many nodes at a time


def components(edges: DataFrame) -> DataFrame:
    """The least node that each node reaches, for nodes that have an edge.

    ``edges`` has two columns of one orderable type, ``a`` and ``b``; order, repeats and loops
    don't matter. Columns: ``node``, ``component``. An empty edge list gives no rows.

    First each task ties the nodes of its edges, a block at a time, to one of those that they reach inside the block. Then, until
    nothing changes, every node ties its smaller neighbours and itself to the least of them, or to that node's own least
    neighbour. This keeps the components; only a star with the least node in its middle stays as it is, and a path
    halves, so the number of rounds grows with the logarithm of a component's size. Each round is written to the shared
    folder, so lost executors re-read files; only counts come to the driver. While the edges are measured to be few, each
    node's least neighbour is broadcast to them; else both are shuffled.
    """
    ordered = _ordered(edges)
    if not isinstance(ordered.schema["a"].dataType, (T.ArrayType, T.StructType, T.FloatType, T.DoubleType)):
        # the others are keys of a Python dictionary, and equal to themselves
        ordered = _ordered(map_arrow(ordered, _stars, ordered.schema))
    now = stage(ordered, "components")
    size = _size(now)
    for _ in range(MAX_ROUNDS):
        before = size
        small = 2 * size[0] <= BROADCAST_ROWS and 2 * size[1] <= BROADCAST_BYTES
        now = stage(_tied(now, small), "components")
        size = _size(now)
        if size == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _size(edges: DataFrame) -> tuple:
    """How many edges there are, the bytes of their nodes, and a hash of them all."""
    width = sum(F.octet_length(c) + 16 if isinstance(edges.schema[c].dataType, (T.StringType, T.BinaryType)) else F.lit(16)
                for c in ("a", "b"))
    rows, held, hashed = edges.agg(F.count("*"), F.sum(width), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return rows, held or 0, hashed


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node to one that it reaches over its block's edges, which connect the same nodes."""
    parent: dict = {}

    def root(node):
        while (up := parent.setdefault(node, node)) != node:
            parent[node] = node = parent[up]
        return node

    def tied(schema):
        pairs = [(node, top) for node in list(parent) if (top := root(node)) != node]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], schema.field(i).type) for i in (0, 1)], schema=schema)

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
            if len(parent) >= _BLOCK:
                yield tied(schema)
    if parent:
        yield tied(schema)


def _tied(edges: DataFrame, small: bool) -> DataFrame:
    """Tie each node's smaller neighbours and itself to the least of them, or to the least neighbour of that one."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    if small:
        least = F.broadcast(least)
    top = least.select(F.col("a").alias("low"), F.col("low").alias("top"))
    ends = edges.join(least, "a").select("low", F.explode(F.array("a", "b")).alias("end"))
    tied = ends.join(top, "low", "left").select(F.col("end").alias("a"), F.coalesce("top", "low").alias("b"))
    return tied.where("b < a").distinct()
