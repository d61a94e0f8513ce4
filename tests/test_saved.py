"""Saved tables: months written again, layouts that skip data, and answers from listings and footers."""

import pytest
from murmur.functions.scale import scratch_path
from murmur.operators import features
from murmur.sources import fixtures, tables
from murmur.specs import TopicFilter
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plainly(spark):
    """Without adaptive execution, so that a plan's scans can be asked what they read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def read_by_scan(df, metric):
    """What the scan of a plan with one table reports after a run."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return max(leaves.apply(i).metrics().apply(metric).value() for i in range(leaves.size())
               if leaves.apply(i).metrics().contains(metric) and "FileScan" in leaves.apply(i).simpleString(100) and "yyyy" in leaves.apply(i).simpleString(100))


def plan(df):
    return df._jdf.queryExecution().toString()


def months(spark, **options):
    return tables.save_partitioned(fixtures.posts_by_month(spark, SF), scratch_path(spark, "months"), rebalance=True, **options)


def test_one_month_is_written_again(spark):
    path = months(spark)
    before = {(r.yyyy, r.mm): r.rows for r in tables.saved_counts(spark, path).collect()}
    assert len(before) > 3 and sum(before.values()) == 200
    some = fixtures.posts_by_month(spark, SF).where("mm = 2").limit(3)
    tables.save_partitioned(some, path, replace="partitions")
    after = {(r.yyyy, r.mm): r.rows for r in tables.saved_counts(spark, path).collect()}
    assert after == before | {(2024, 2): 3}
    tables.save_partitioned(some.limit(0), path, replace="partitions")
    assert {(r.yyyy, r.mm): r.rows for r in tables.saved_counts(spark, path).collect()} == after
    tables.save_partitioned(some, path)
    assert [tuple(r) for r in tables.saved_counts(spark, path).collect()] == [(2024, 2, 3)]
    with pytest.raises(ValueError):
        tables.save_partitioned(some, path, replace="rows")


def test_coverage_comes_from_the_listing(spark):
    path = months(spark)
    covered = tables.saved_coverage(spark, path)
    assert "binaryFile" in plan(covered) and "FileScan parquet" not in plan(covered) and "content" not in plan(covered).split("Physical Plan")[1]
    rows = covered.collect()
    saved = spark.read.parquet(path)
    assert [(r.yyyy, r.mm) for r in rows] == [tuple(r) for r in saved.select("yyyy", "mm").distinct().orderBy("yyyy", "mm").collect()]
    assert sum(r.files for r in rows) == len(saved.inputFiles()) and all(r.bytes > 0 for r in rows)
    flat = scratch_path(spark, "flat")
    spark.range(3).write.parquet(flat)
    with pytest.raises(tables.SchemaMismatch, match="yyyy, mm"):
        tables.saved_coverage(spark, flat)


def test_counts_come_from_footers(spark):
    path = months(spark)
    for counted in (tables.saved_counts(spark, path), tables.saved_counts(spark, path, []), tables.verify_saved(spark, {"a": path, "b": path})):
        assert "PushedAggregation: [COUNT(*)]" in plan(counted)
    assert [tuple(r) for r in tables.verify_saved(spark, {"a": path, "b": path}).collect()] == [("a", 200), ("b", 200)]
    assert tables.saved_counts(spark, path, []).collect()[0].rows == 200
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_partitions_are_pruned_by_a_calendar_read_at_run_time(plainly):
    spark = plainly
    later = fixtures.CALENDAR.moved(60)
    at = scratch_path(spark, "calendar")
    tables.calendar_table(spark, later).write.parquet(at)
    saved = tables.load_posts(spark, months(spark))
    chosen = spark.read.parquet(at).where("label = 'b_after'")
    inside = tables.in_calendar(saved, chosen)
    assert "dynamicpruning" in plan(inside)
    assert read_by_scan(inside, "numPartitions") == 1
    assert read_by_scan(saved.select("post_id", "yyyy"), "numPartitions") > 3
    want = features.in_window(saved, later["b_after"])
    key = lambda df: sorted(r.post_id for r in df.select("post_id").collect())
    assert key(inside) == key(want) != []
    assert tables.in_calendar(saved, chosen.limit(0)).count() == 0
    everything = spark.read.parquet(at)
    doubled = everything.unionByName(everything)
    labelled = features.label_event_period(saved, later).where("event_period <> 'other'")
    assert key(tables.in_calendar(saved, doubled)) == key(labelled)


def test_clustered_files_skip_other_forums(plainly):
    spark = plainly
    rows = spark.range(40_000).select(
        F.concat(F.lit("Forum"), F.lpad((F.col("id") * 7919 % 40).cast("string"), 2, "0")).alias("subreddit"),
        F.md5(F.col("id").cast("string")).alias("title"), "id", F.lit(2024).alias("yyyy"), F.lit(1).alias("mm"))
    rows = features.with_forum_key(rows).repartition(8)
    topic = TopicFilter(["FORUM07", "forum07x"])
    wanted = {}
    for clustered in (False, True):
        path = scratch_path(spark, "layout")
        tables.save_partitioned(rows, path, **({"cluster_by": [features.FORUM_KEY]} if clustered else {}))
        found = features.filter_topic(spark.read.parquet(path).select("id", "yyyy", features.FORUM_KEY), topic)
        wanted[clustered] = read_by_scan(found, "numOutputRows")
        assert found.count() == 1000
    assert wanted[False] == 40_000 and wanted[True] <= 10_000
    absent = spark.read.parquet(path).select("id", "yyyy", features.FORUM_KEY).where("forum_lc = 'forum07x'")
    assert read_by_scan(absent, "numOutputRows") == 0


def bloom_filters(spark, file):
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    at = spark._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(file), conf)
    reader = spark._jvm.org.apache.parquet.hadoop.ParquetFileReader.open(at)
    columns = {c.getPath().toDotString() for c in reader.getFooter().getBlocks()[0].getColumns() if c.getBloomFilterOffset() > 0}
    reader.close()
    return columns


def test_keys_without_a_dictionary_get_bloom_filters(plainly):
    spark = plainly
    wide = F.repeat(F.md5(F.col("id").cast("string")), 8)  # too many and too long for a dictionary
    rows = spark.range(60_000).select(wide.alias("forum_lc"), F.reverse(wide).alias("title"), "id", F.lit(2024).alias("yyyy"), F.lit(1).alias("mm"))
    read = {}
    for blooms in (False, True):
        path = tables.save_partitioned(rows, scratch_path(spark, "bloom"), cluster_by=["forum_lc"], bloom_filters=blooms, expected_values=8000)
        assert bloom_filters(spark, spark.read.parquet(path).inputFiles()[0]) == ({"forum_lc"} if blooms else set())
        absent = F.repeat(F.md5(F.lit("no such id")), 8)
        value = spark.range(1).select(absent).first()[0]
        read[blooms] = read_by_scan(spark.read.parquet(path).select("yyyy", "forum_lc").where(F.col("forum_lc") == value), "numOutputRows")
    assert read[False] > 0 and read[True] == 0


def test_a_forum_of_most_rows_is_dealt_to_several_files(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 20 > 0, "hot").otherwise("cold").alias("forum_lc"), "id",
                                      F.lit(2024).alias("yyyy"), F.lit(1).alias("mm"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = tables.save_partitioned(rows, scratch_path(spark, "hot"), cluster_by=["forum_lc"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 20_000
