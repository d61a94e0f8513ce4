"""Centroid clustering of integer vectors over packed bit planes.

A vector's components become integers, and plane b of it holds bit b (of two's complement) of 64 components in
one 64-bit word. The dot product of two vectors is the sum over pairs of planes of the number of bits
that both have, weighted by both planes' powers of two, the highest plane's weight being negative. With the
squared lengths that gives exact squared distances, and so centroids, ties and sums that don't depend on
the order of rows or on the number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.scale import stage
from murmur.llm import textops

WORD = 64
#: Components must lie within this bound, so that no distance or partial sum leaves 64 bits.
BOUND = 1 << 27
BLOCK_ROWS = 8192


@dataclass(frozen=True)
class Settings:
    """``components`` of each vector, times ``scale`` and rounded down; ``rounds`` of moves of ``k`` centroids."""

    k: int = 8
    rounds: int = 10
    components: int = 64
    scale: int = 1024
    seed: str = "3"


def weights(planes: int) -> np.ndarray:
    """What a bit of each plane counts, in two's complement."""
    out = np.int64(1) << np.arange(planes, dtype=np.int64)
    out[-1] = -out[-1]
    return out


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """Bit planes of integer vectors: (rows, components) to (rows, planes, words)."""
    rows, components = values.shape
    words = -(-components // WORD)
    padded = np.zeros((rows, words * WORD), np.int64)
    padded[:, :components] = values
    out = np.empty((rows, planes, words), np.uint64)
    for b in range(planes):
        bits = ((padded >> b) & 1).astype(np.uint8)
        out[:, b] = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    return out


def unpack(packed: np.ndarray, components: int) -> np.ndarray:
    """The integer vectors of bit planes."""
    rows, planes, _ = packed.shape
    out = np.zeros((rows, components), np.int64)
    for b, weight in enumerate(weights(planes)):
        bits = np.unpackbits(np.ascontiguousarray(packed[:, b]).astype("<u8").view(np.uint8).reshape(rows, -1), axis=1, bitorder="little")
        out += bits[:, :components] * weight
    return out


def dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact dot products of all rows of ``left`` with all of ``right``, both packed."""
    out = np.zeros((len(left), len(right)), np.int64)
    for b, weight in enumerate(weights(left.shape[1])):
        for c, other in enumerate(weights(right.shape[1])):
            common = np.zeros(out.shape, np.int64)
            for word in range(left.shape[2]):
                common += np.bitwise_count(left[:, b, word, None] & right[None, :, c, word])
            out += common * (weight * other)
    return out


def nearest(packed: np.ndarray, norms: np.ndarray, centroids: np.ndarray, centroid_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, the smaller number on a tie, and its squared distance."""
    distances = norms[:, None] + centroid_norms[None, :] - 2 * dots(packed, centroids)
    best = distances.argmin(axis=1)
    return best, distances[np.arange(len(best)), best]


def _rows(batch: pa.RecordBatch, planes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of packed vectors and their squared lengths."""
    norms = batch.column("norm").to_numpy(zero_copy_only=False)
    for low in range(0, batch.num_rows, BLOCK_ROWS):
        blobs = batch.column("planes").slice(low, BLOCK_ROWS).to_pylist()
        packed = np.frombuffer(b"".join(blobs), "<u8").reshape(len(blobs), planes, -1)
        yield low, packed, norms[low:low + len(blobs)]


def _pack_batches(batches: Iterator[pa.RecordBatch], planes: int, components: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows == 0:
            continue
        values = batch.column("values").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, components)
        packed = pack(values, planes)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array([p.astype("<u8").tobytes() for p in packed], pa.binary()), pa.array((values * values).sum(axis=1))],
            names=["id", "planes", "norm"])


SUMS = T.StructType([
    T.StructField("cluster", T.IntegerType()), T.StructField("component", T.IntegerType()),
    T.StructField("total", T.LongType()), T.StructField("n", T.LongType())])


def _sum_batches(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, planes: int) -> Iterator[pa.RecordBatch]:
    """Component sums and sizes of the clusters, once for each task."""
    k, components = centroids.shape
    packed_centroids, norms = pack(centroids, planes), (centroids * centroids).sum(axis=1)
    totals, counts = np.zeros((k, components), np.int64), np.zeros(k, np.int64)
    for batch in batches:
        for _, packed, lengths in _rows(batch, planes):
            best, _ = nearest(packed, lengths, packed_centroids, norms)
            values = unpack(packed, components)
            for c in np.unique(best):
                mine = best == c
                totals[c] += values[mine].sum(axis=0)
                counts[c] += mine.sum()
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.repeat(held, components).astype(np.int32)), pa.array(np.tile(np.arange(components, dtype=np.int32), len(held))),
        pa.array(totals[held].ravel()), pa.array(np.repeat(counts[held], components))], names=SUMS.names)


def _assign_batches(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, planes: int) -> Iterator[pa.RecordBatch]:
    packed_centroids, norms = pack(centroids, planes), (centroids * centroids).sum(axis=1)
    for batch in batches:
        for low, packed, lengths in _rows(batch, planes):
            best, distance = nearest(packed, lengths, packed_centroids, norms)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(low, len(best)), pa.array(best.astype(np.int32)), pa.array(distance)],
                names=["id", "cluster", "distance"])


def usable(vector: Column, components: int) -> Column:
    """True for vectors of the right length without NULL, NaN or infinite components."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(vector) == components) & finite, F.lit(False))


def cluster(df: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The cluster of every usable vector after ``rounds`` moves of the centroids.

    Columns: the id, ``cluster``, ``distance`` (squared, to the centroid), ``cluster_inertia`` and ``inertia`` (distances
    summed over the cluster and over all), ``centroid_sha256`` (of the centroid's components joined by commas).

    The centroids start as the ``k`` vectors whose ids hash least (sha256 of ``seed:id``, a NULL id as empty; ties: by id, then by the
    packed vector), fewer if there are fewer vectors; equal ones among them are allowed. A round assigns all
    vectors to the nearest centroid (ties: the smaller number) and moves each centroid that has any to the
    floor of their mean. One row comes back per usable vector, repeated ids and vectors included; vectors of another
    length, NULL vectors and those with NULL, NaN or infinite components are left out. Other columns are not
    read. An empty table gives an empty one. Components beyond ``BOUND`` after scaling raise ``ValueError``.

    Vectors are never shuffled: a round reads the packed vectors and shuffles one number for each
    task, cluster and component. The driver holds the ``k`` centroids.
    """
    spark, components = df.sparkSession, settings.components
    kept = df.where(usable(df[vector_col], components)).select(
        df[id_col].alias("id"),
        F.transform(df[vector_col], lambda x: F.floor(x.cast("double") * settings.scale).cast("long")).alias("values"))
    low, high = kept.agg(F.min(F.array_min("values")), F.max(F.array_max("values"))).first()
    if low is not None and max(-low, high) > BOUND:
        raise ValueError(f"scaled components run from {low} to {high}, beyond {BOUND}")
    planes = 1 + max((-low - 1 if low < 0 else low).bit_length(), max(high, 0).bit_length()) if low is not None else 1
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("planes", T.BinaryType()), T.StructField("norm", T.LongType())])
    packed = stage(textops.map_arrow(kept, partial(_pack_batches, planes=planes, components=components), schema), "bit-planes")

    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = packed.orderBy(digest, "id", "planes").limit(settings.k).collect()
    centroids = np.zeros((len(start), components), np.int64)
    for i, row in enumerate(start):
        centroids[i] = unpack(np.frombuffer(row["planes"], "<u8").reshape(1, planes, -1), components)[0]
    vectors = packed.select("planes", "norm")
    for _ in range(settings.rounds if len(start) else 0):
        partial_sums = textops.map_arrow(vectors, partial(_sum_batches, centroids=centroids, planes=planes), SUMS)
        moved = centroids.copy()
        for r in partial_sums.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            moved[r["cluster"], r["component"]] = r["total"] // r["n"]
        if (moved == centroids).all():  # no vector would change its cluster again
            break
        centroids = moved

    result = T.StructType([schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    assigned = textops.map_arrow(packed, partial(_assign_batches, centroids=centroids, planes=planes), result)
    sums = {r["cluster"]: r["total"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    per_cluster = spark.createDataFrame(
        [(c, int(sums[c]), int(sum(sums.values())), digests[c]) for c in sorted(sums)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    joined = assigned.join(F.broadcast(per_cluster), "cluster")  # at most k rows
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
