"""Classes of equal texts against grouping in plain Python, whatever the partitions."""

import hashlib
from collections import defaultdict

import pytest
from murmur.functions.scale import stage as contentsort_stage
from murmur.llm import contentsort
from pyspark.sql import functions as F

LONG = "a shared opening of far more than sixty-four bytes, the same in every one of these texts: "
TEXTS = [None, "", " ", "a", "A", "a ", "é", "é", "x\x00y", "x\x00", "\U0001d11e", LONG, LONG + "1", LONG + "2", "y" * 300_000, "y" * 299_999]


def check(rows, got, keep):
    groups = defaultdict(list)
    for key, text in rows:
        groups[text or ""].append(key)
    best = max if keep == "largest" else min
    want = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        sha = hashlib.sha256(text.encode()).hexdigest()
        head = best(known) if known else None
        want += [(repr(k), head, len(keys), sha) for k in keys]
    assert sorted(((repr(r["doc_id"]), r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    kept = [(r["doc_id"], r["text_sha256"]) for r in got if r["kept"]]
    assert len(kept) == len(groups) == len({sha for _, sha in kept})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("keep", ["least", "largest"])
@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_classes_equal_grouping(spark, keep, partitions):
    rows = [(i, TEXTS[i % len(TEXTS)] if i % 3 else "hot") for i in range(400)]
    rows += [(7, "twice"), (7, "twice"), (None, "twice"), (None, "nobody"), (None, "nobody"), (5, "other text of 5"), (-1, "hot"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("content", F.lit(1))
    check(rows, contentsort.classes(df.repartition(4), keep=keep, partitions=partitions).collect(), keep)


def test_a_class_of_nearly_all_rows_runs_through_many_partitions(spark):
    df = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, F.concat(F.lit("t"), F.col("id"))).otherwise("hot").alias("text"))
    got = contentsort.classes(df, keep="largest", partitions=8).collect()
    check([(i, f"t{i}" if i % 50 == 0 else "hot") for i in range(60_000)], got, "largest")
    staged = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(contentsort, "stage", lambda df, name: staged.append(contentsort_stage(df, name)) or staged[-1])
        contentsort.classes(df, keep="largest", partitions=8)
    sizes = [r["count"] for r in staged[0].groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 60_000 / 4


def test_normalised_texts_and_survivors(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "c"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in contentsort.classes(df, normalise=F.lower).collect()}
    assert [got[i]["keep_id"] for i in range(1, 6)] == [1, 1, 3, 4, 4]
    assert got[2]["text_sha256"] == hashlib.sha256(b"a b").hexdigest()
    assert sorted(r["doc_id"] for r in contentsort.deduplicated(df, normalise=F.lower).collect()) == [1, 3, 4]
    with pytest.raises(ValueError):
        contentsort.classes(df, keep="first")


def test_empty_table(spark):
    assert contentsort.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
