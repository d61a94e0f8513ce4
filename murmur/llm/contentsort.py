"""Exact duplicates by sorting contents.

Rows are range-partitioned by their bytes, with splitters that Spark samples, and sorted inside each
partition (Spark's sort spills to disk), so that equal contents lie side by side; neighbours are
compared in full, and each run of equals is one class.

- Splitters are sampled on a bounded key: the content's first ``PREFIX_BYTES`` bytes, then its sha256, then
  the row's key. What the driver gathers so does not grow with the texts, and the last part lets a class
  with very many copies run through as many partitions as its size asks for.
- A class cut by a splitter ends one partition and begins the next. Only a partition's first and last run can
  be cut, so these, at most two short rows for each partition, are put together by full content.
- The runs are written to the shared folder and read twice: splitters are sampled once, and a lost
  executor can't make the two readings disagree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.scale import stage
from murmur.llm import textops

PREFIX_BYTES = 64
BATCH_ROWS = 1 << 16

RUNS = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("sha256", T.StringType()),
    T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()),
    T.StructField("first", T.BooleanType()), T.StructField("head", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("content", T.BinaryType()),  # of the first row of a partition's first and last run
])


class _Run:
    """A run of equal contents, whose keys have yet to be given out."""

    def __init__(self, number: int, content: pa.Scalar, sha256: str) -> None:
        self.number, self.content, self.sha256 = number, content, sha256
        self.keys: list[pa.Array] = []

    def batches(self, part: int, edge: bool) -> Iterator[pa.RecordBatch]:
        keys = pa.concat_arrays(self.keys)
        head = keys[0].as_py()
        for low in range(0, len(keys), BATCH_ROWS):
            some = keys.slice(low, BATCH_ROWS)
            n = len(some)
            first = np.zeros(n, bool)
            first[0] = low == 0
            content = [self.content.as_py() if edge and low == 0 else None, *[None] * (n - 1)]
            yield pa.RecordBatch.from_arrays([
                some, pa.array([self.sha256] * n), pa.array([part] * n, pa.int32()), pa.array([self.number] * n, pa.int64()),
                pa.array(first), pa.array([head] * n, pa.int64()), pa.array([len(keys)] * n, pa.int64()),
                pa.array(content, pa.binary())], names=RUNS.names)


def _small(runs: list[_Run], part: int) -> pa.RecordBatch:
    """Whole runs inside a partition, many in one batch."""
    sizes = np.array([sum(len(k) for k in r.keys) for r in runs], np.int64)
    firsts = np.zeros(sizes.sum(), bool)
    firsts[np.cumsum(sizes) - sizes] = True
    keys = pa.concat_arrays([k for r in runs for k in r.keys])
    heads = pa.array([r.keys[0][0].as_py() for r in runs], pa.int64())
    at = pa.array(np.repeat(np.arange(len(runs)), sizes))
    total = len(keys)
    return pa.RecordBatch.from_arrays([
        keys, pa.array([r.sha256 for r in runs]).take(at), pa.array(np.full(total, part, np.int32)),
        pa.array(np.repeat([r.number for r in runs], sizes)), pa.array(firsts), heads.take(at), pa.array(np.repeat(sizes, sizes)),
        pa.nulls(total, pa.binary())], names=RUNS.names)


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring full comparisons over a sorted partition."""
    part = TaskContext.get().partitionId()
    run: _Run | None = None
    waiting: list[_Run] = []
    pending = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys, shas, contents = batch.column("key"), batch.column("sha256"), batch.column("content")
        same = pc.equal(contents.slice(1), contents.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        starts = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows]
        for low, high in zip(starts[:-1], starts[1:], strict=True):
            if run is None or low or run.content != contents[0]:
                if run is not None:
                    if run.number == 0:
                        yield from run.batches(part, True)
                    else:
                        run.content = None  # lets go of the batch
                        waiting.append(run)
                        pending += sum(len(k) for k in run.keys)
                        if pending >= BATCH_ROWS:
                            yield _small(waiting, part)
                            waiting, pending = [], 0
                run = _Run(0 if run is None else run.number + 1, contents[low], shas[low].as_py())
            run.keys.append(keys.slice(low, high - low))
    if waiting:
        yield _small(waiting, part)
    if run is not None:
        yield from run.batches(part, True)


def classes(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", keep: str = "least",
            normalise: Callable[[Column], Column] | None = None, partitions: int | None = None) -> DataFrame:
    """The class of equal texts of every row.

    Columns: the key (a whole number), ``keep_id`` (the key of the class's row that stays: the least, or with ``keep="largest"`` the
    largest), ``group_size``, ``kept`` and ``text_sha256`` (lower-case hex, of the normalised text's UTF-8 bytes).
    ``normalise`` maps the text column to the text that is compared; by default that is the text itself.

    One row comes back per row. A NULL text counts as empty. Exactly one row of each class is kept, also where
    its key stands on several equal rows. NULL keys never stay beside others; a class of NULL keys only has the
    ``keep_id`` NULL and keeps one. Other columns are not read, whatever their names. An empty table gives
    an empty one. Two contents of one sha256 are told apart, but copies of theirs may be left in two classes
    if a splitter falls among them.
    """
    if keep not in ("least", "largest"):
        raise ValueError("keep is 'least' or 'largest'")
    text = F.coalesce((normalise or (lambda c: c))(F.coalesce(df[text_col], F.lit(""))), F.lit(""))
    rows = df.select(df[key_col].cast("long").alias("key"), text.cast("binary").alias("content"))
    rows = rows.withColumn("sha256", F.sha2("content", 256))
    order = F.asc_nulls_last("key") if keep == "least" else F.desc_nulls_last("key")
    prefix = F.substring("content", 1, PREFIX_BYTES)
    ranged = rows.repartitionByRange(
        partitions or textops.shuffle_partitions(df.sparkSession), prefix, F.col("sha256"), order)
    placed = ranged.sortWithinPartitions(prefix, F.col("sha256"), F.col("content"), order)
    runs = stage(textops.map_arrow(placed, _find_runs, RUNS), "content-runs")

    by_content = W.partitionBy("content").orderBy("part", "run").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    best = F.min("head") if keep == "least" else F.max("head")
    edges = runs.where(F.col("first") & F.col("content").isNotNull()).select(
        "part", "run", best.over(by_content).alias("class_head"), F.sum("size").over(by_content).alias("class_size"),
        F.first("part").over(by_content).alias("class_part"))
    # at most two rows, of five numbers, for each partition
    joined = runs.drop("content").join(F.broadcast(edges), ["part", "run"], "left")
    return joined.select(
        F.col("key").alias(key_col), F.when(F.col("class_size").isNull(), F.col("head")).otherwise(F.col("class_head")).alias("keep_id"),
        F.coalesce("class_size", "size").alias("group_size"),
        (F.col("first") & (F.coalesce("class_part", "part") == F.col("part"))).alias("kept"),
        F.col("sha256").alias("text_sha256"))


def deduplicated(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", keep: str = "least",
                 normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows of ``df`` with one of each class of equal texts, by keys that are not NULL and stand on one row each."""
    dropped = classes(df, key_col, text_col, keep, normalise).where("not kept").select(F.col(key_col).alias("__dropped"))
    return df.join(dropped, df[key_col] == dropped["__dropped"], "left_anti")
