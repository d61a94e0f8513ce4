"""Hashed categories and quantile sketches."""

import math
from collections import Counter

import pytest
from murmur.operators import models
from murmur.plans.base import ENTITIES, tagged_posts
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_slots_of_many_values(spark):
    names = spark.range(5000).select(F.concat(F.lit("forum"), F.col("id") % 2500).alias("subreddit"), F.lit("p").alias("event_period"))
    placed = models.category_slots(names, 1000).collect()
    assert len(placed) == 2501
    shared = Counter((r.category, r.slot) for r in placed)
    assert all(0 <= r.slot < 1000 and r.sharing == shared[r.category, r.slot] for r in placed)
    report = {r.category: r for r in models.slot_collisions(models.category_slots(names, 1000)).collect()}
    assert report["subreddit"].names == 2500 and report["event_period"].colliding == 0
    assert report["subreddit"].used_slots == len({s for c, s in shared if c == "subreddit"})
    assert report["subreddit"].colliding == sum(1 for r in placed if shared[r.category, r.slot] > 1)
    nulls = spark.createDataFrame([(None, "x")], "subreddit string, event_period string")
    assert [tuple(r)[:2] for r in models.category_slots(nulls).collect()] == [("event_period", "x")]


def test_hashed_fit_knows_unseen_forums_and_its_width(spark):
    rows = models.feature_table(tagged_posts(spark, SF), ENTITIES)
    rows = rows.withColumn("score", F.when(F.col("hour_of_day") >= 12, 100).otherwise(0).cast("long"))
    fitted = models.fit_engagement_models(rows, ENTITIES, encoding="hashed", slots=64, trees=5, depth=3)
    assert fitted.train.schema["features"].metadata["ml_attr"]["num_attrs"] == len(models.numeric_features(ENTITIES)) + 128
    importances = {r.feature: r.importance for r in models.feature_importances(fitted, ENTITIES).collect()}
    assert max(importances, key=importances.get) == "hour_of_day" and sum(importances.values()) == pytest.approx(1)
    unseen = models.with_category_slots(rows.limit(5).withColumn("subreddit", F.lit("never seen")), 64)
    encoded = fitted.encoding.transform(unseen).select(vector_to_array("subreddit_ohe").alias("v")).collect()
    assert all(sum(r.v) == 1 and len(r.v) == 64 for r in encoded)
    with pytest.raises(ValueError):
        models.fit_engagement_models(rows, ENTITIES, encoding="other")


@pytest.mark.parametrize("kind, cast", [("bigint", "long"), ("double", "double")])
def test_sketches_are_exact_up_to_k_rows_and_close_beyond(spark, kind, cast):
    rows = spark.range(30_000).select(
        (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("part"), ((F.col("id") * 7919) % 30_011).cast(cast).alias("v"))
    small = rows.where("v < 300")
    exact = models.sketched_quantiles(models.quantile_sketches(small, "v", ["g"], 400), [0.0, 0.3, 0.5, 1.0], kind)
    values = {g: sorted(r.v for r in small.where(F.col("g") == g).collect()) for g in range(3)}
    for r in exact.collect():
        known = values[r.g]
        assert r.rows == len(known) and r.value == known[max(0, math.ceil(r.probability * len(known)) - 1)]
    parts = models.quantile_sketches(rows, "v", ["g", "part"], 200)
    merged = models.merged_sketches(parts, ["g"], 200, kind)
    found = models.rank_errors(rows, "v", ["g"], models.sketched_quantiles(merged, [0.0, 0.1, 0.5, 0.99, 1.0], kind)).collect()
    assert len(found) == 15 and all(r.rows == 10_000 and r.error < 0.05 for r in found)
    assert all(r.error == 0 for r in found if r.probability in (0.0, 1.0))


def test_sketches_leave_out_missing_values(spark):
    rows = spark.createDataFrame([("a", None), ("b", 1.0), ("b", float("nan")), ("b", 3.0), (None, 2.0)], "g string, v double")
    sketches = models.quantile_sketches(rows, "v", ["g"])
    assert {(r.g, r.rows) for r in sketches.collect()} == {("b", 2), (None, 1)}
    assert models.quantile_sketches(rows.limit(0), "v", ["g"]).collect() == []
    far = spark.createDataFrame([("b", 0.5, 99.0)], "g string, probability double, value double")
    assert models.rank_errors(rows.where("not isnan(v)"), "v", ["g"], far).collect()[0].error == 0.5
