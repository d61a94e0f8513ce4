"""Clusters against Lloyd's rounds in plain Python integers, and popcount distances against numpy's."""

import hashlib
import math

import numpy as np
import pytest
from murmur.llm import centroids
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def plain(rows, k=8, rounds=10):
    kept = []
    for i, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x):
            kept.append((i, [math.floor(1024 * v) for v in x]))
    kept.sort(key=lambda r: hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    cents = [list(v) for _, v in kept[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        mine = [near(v)[1] for _, v in kept]
        for j in range(len(cents)):
            members = [v for (_, v), m in zip(kept, mine, strict=True) if m == j]
            if members:
                cents[j] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in last)
    per = {j: sum(d for _, d, m in last if m == j) for j in range(len(cents))}
    return sorted((repr(i), j, d, per[j], total, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in last)


def got(df):
    return sorted((repr(r["vec_id"]), *tuple(r)[1:]) for r in df.collect())


def vectors(n, seed, spread=1.0):
    random = np.random.default_rng(seed)
    middles = random.normal(size=(5, 64))
    return [(i, (middles[i % 5] + spread * random.normal(size=64)).tolist()) for i in range(n)]


def test_clusters_equal_plain_rounds(spark):
    rows = vectors(240, 0)
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(120)] + [(7, rows[8][1]), (7, rows[8][1])]
    odd = [(300, None), (301, []), (302, hot[:63]), (303, [*hot, 0.5]), (304, [None, *hot[1:]]), (305, [math.nan, *hot[1:]]),
           (306, [math.inf, *hot[1:]]), (307, [-math.inf, *hot[1:]]), (308, [-0.0] * 64), (309, [-1e-9] * 64)]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows + odd], SCHEMA).repartition(5)
    assert got(centroids.cluster(df)) == plain(rows + odd)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [1.0] * 64) for i in range(20)] + [(50, [3.0] * 64)]
    df = spark.createDataFrame([(i, x, "") for i, x in rows], SCHEMA)
    assert got(centroids.cluster(df)) == plain(rows)
    middle = [(0, [0.0] * 64), (1, [2.0] * 64), *((i, [1.0] * 64) for i in range(2, 9))]
    df = spark.createDataFrame([(i, x, "") for i, x in middle], SCHEMA)
    assert got(centroids.cluster(df, centroids.Settings(k=2, rounds=3))) == plain(middle, 2, 3)


def test_floats_few_vectors_and_none(spark):
    rows = vectors(3, 1)
    floats = spark.createDataFrame([(i, x, "") for i, x in rows], SCHEMA).withColumn("embedding", F.col("embedding").cast("array<float>"))
    as_double = [(i, np.float32(x).astype(float).tolist()) for i, x in rows]
    assert got(centroids.cluster(floats)) == plain(as_double)
    assert centroids.cluster(floats.limit(0)).collect() == []
    assert centroids.cluster(floats.withColumn("embedding", F.lit(None).cast("array<float>"))).collect() == []


def test_null_id_and_huge_components(spark):
    rows = [(None, [0.25] * 64), *vectors(20, 2)]
    df = spark.createDataFrame([(i, x, "") for i, x in rows], SCHEMA)
    assert got(centroids.cluster(df)) == plain(rows)
    with pytest.raises(ValueError):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, "")], SCHEMA))
    wide = [(i, [v * 100_000 for v in x]) for i, x in vectors(20, 3, 0.1) if max(map(abs, x)) < 1.3]
    if wide:
        assert got(centroids.cluster(spark.createDataFrame([(i, x, "") for i, x in wide], SCHEMA))) == plain(wide)


@pytest.mark.parametrize("components", [1, 64, 100, 128])
def test_planes_hold_all_values(components):
    random = np.random.default_rng(4)
    values = random.integers(-(1 << 12), 1 << 12, (50, components))
    values[0, 0], values[1, 0] = -(1 << 12), (1 << 12) - 1
    packed = centroids.pack(values, 13)
    assert (centroids.unpack(packed, components) == values).all()
    assert (centroids.dots(packed, packed[:7]) == values @ values[:7].T).all()
