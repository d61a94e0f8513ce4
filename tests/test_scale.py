"""Bounds found from counts, and samples by hash."""

import random

import pytest
from murmur.functions import scale
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [1, 2, 7, 50, 99, 100, 101])
def test_nth_largest(spark, n):
    values = [random.Random(1).choice([1, 1, 2, 3, 3, 3, 8, 40]) for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    assert scale.nth_largest(df, "v", n) == (sorted(values, reverse=True)[n - 1] if n <= 100 else None)
    assert scale.nth_largest(df.limit(0), "v", n) is None


@pytest.mark.parametrize("digits", [1, 2, 4])
@pytest.mark.parametrize("n", [0, 1, 3, 5, 400, 2003, 2004, 5000])
def test_first_by_hash_gives_the_rows_that_a_full_sort_gives(spark, monkeypatch, n, digits):
    whole = scale.hash_bound
    monkeypatch.setattr(scale, "hash_bound", lambda df, key, n: whole(df, key, n, digits))
    rows = spark.range(2000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 20).alias("text"))
    odd = spark.createDataFrame([(None, "a"), (None, "b"), (7, "again"), (7, "again")], "k long, text string")
    df = rows.union(odd)
    want = df.orderBy(F.md5(F.col("k").cast("string")), "k").limit(n).collect()
    got = scale.first_by_hash(df, n, "k").collect()
    assert [r["k"] for r in got] == [r["k"] for r in want]


def test_the_bound_lets_few_more_rows_through(spark):
    df = spark.range(50_000).select(F.col("id").alias("k"))
    bound = scale.hash_bound(df, "k", 100, 2)
    passed = df.where(F.substring(F.md5(F.col("k").cast("string")), 1, len(bound)) <= bound).count()
    assert 100 <= passed <= 100 + 256
    assert scale.hash_bound(df, "k", 50_001) is None
    hot = spark.range(10_000).select(F.lit(3).alias("k"))
    assert scale.first_by_hash(hot, 5, "k").count() == 5


def test_a_folder_of_one_machine_is_refused_on_a_cluster(spark):
    assert scale.shared_or_refused("file:/tmp/w", "local[8]") == scale.shared_or_refused("file:/tmp/w", "local-cluster[2,1,1024]") == "file:/tmp/w"
    assert scale.shared_or_refused("s3a://bucket/w", "yarn") == "s3a://bucket/w"
    for path in ("/tmp/w", "file:/tmp/w"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scale.shared_or_refused(path, "spark://host:7077")
