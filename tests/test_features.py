"""Row-level semantics on literal frames."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from murmur.functions import scale
from murmur.functions.clock import from_unix_seconds, to_unix_seconds
from murmur.operators import features
from murmur.specs import Calendar, EntityPattern, Period, TopicFilter
from murmur.presets import CRICKET_CALENDAR, CRICKET_ENTITIES, CRICKET_TOPIC

FINAL_DAY = 1700352000  # 2023-11-19 00:00 UTC, a Sunday


@pytest.fixture(params=["UTC", "America/New_York", "Asia/Kolkata"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_time_features_do_not_depend_on_the_session_zone(spark, zone):
    df = features.add_time_features(spark.createDataFrame([(FINAL_DAY,)], "created_utc long"))
    row = df.withColumn("day", F.to_date("created_dt").cast("string")).withColumn(
        "text", F.col("created_dt").cast("string")).first()
    assert row.text == "2023-11-19 00:00:00"
    assert (row.hour_of_day, row.day_of_week, row.month_num, row.year_num) == (0, 1, 11, 2023)
    assert row.day == "2023-11-19"


def test_seconds_round_trip(spark, zone):
    moments = [0, 1, FINAL_DAY, FINAL_DAY + 86399, 1710054000, 1710057600]
    df = spark.createDataFrame([(m,) for m in moments], "s long")
    assert df.where(to_unix_seconds(from_unix_seconds(F.col("s"))) != F.col("s")).count() == 0


def test_period_edges_in_seconds_and_microseconds(spark, zone):
    start, middle, end = datetime(2024, 1, 3), datetime(2024, 1, 10), datetime(2024, 1, 13)
    calendar = Calendar([Period("open", start, middle), Period("closed", middle, end, end_inclusive=True)])
    tick = timedelta(microseconds=1)
    expected = {
        start - tick: "other", start: "open", start + tick: "open", middle - tick: "open",
        middle: "closed", middle + tick: "closed", end - tick: "closed", end: "closed", end + tick: "other",
    }
    rows = [(m.isoformat(sep=" "),) for m in expected]
    df = spark.createDataFrame(rows, "text string").withColumn("at", F.to_timestamp_ntz("text"))
    labels = features.label_event_period(df, calendar, "at").select("text", "event_period").collect()
    assert {datetime.fromisoformat(r.text): r.event_period for r in labels} == expected

    seconds = [(int((m - datetime(1970, 1, 1)).total_seconds()),) for m in (start, middle, end)]
    whole = spark.createDataFrame([s for (v,) in seconds for s in ((v - 1,), (v,), (v + 1,))], "created_utc long")
    assert [r.event_period for r in features.label_event_period(whole, calendar).orderBy("created_utc").collect()] == [
        "other", "open", "open", "open", "closed", "closed", "closed", "closed", "other"]


def test_first_matching_period_wins(spark):
    day = datetime(1970, 1, 1)
    calendar = Calendar([Period("a", day, day + timedelta(days=2)), Period("b", day, day + timedelta(days=3))])
    df = spark.createDataFrame([(0,), (86400 * 2,)], "created_utc long")
    assert [r.event_period for r in features.label_event_period(df, calendar).orderBy("created_utc").collect()] == ["a", "b"]


def test_period_months():
    assert list(Period("p", datetime(2023, 11, 30), datetime(2024, 1, 1)).months()) == [(2023, 11), (2023, 12), (2024, 1)]


def test_mentions_of_missing_and_present_text(spark):
    texts = [None, "", "ro x", "Rohit", "rope", "Captain  cool", "CAPTAIN COOL!", "king kohli's"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, title string")
    rows = features.add_mentions(df, "title", CRICKET_ENTITIES).orderBy("i").collect()
    assert [r.mentions_rohit for r in rows] == [None, False, True, True, False, False, False, False]
    assert [r.mentions_dhoni for r in rows] == [None, False, False, False, False, False, True, False]
    assert [r.mentions_kohli for r in rows] == [None, False, False, False, False, False, False, True]
    assert [r.mentions_any for r in rows] == [None, False, True, True, False, False, True, True]


def test_accented_letters_are_part_of_words(spark):
    df = spark.createDataFrame([("éfrom x",), ("fromé",), ("from",), ("(FROM)",), ("from_x",), ("x\nfrom\ny",)], "t string")
    flags = df.select("t", features.mention(F.col("t"), EntityPattern("a", ["from"])).alias("hit")).collect()
    assert [r.hit for r in flags] == [False, False, True, True, False, True]


def test_special_characters_in_terms_are_literal(spark):
    df = spark.createDataFrame([("a c++ b",), ("a cxx b",)], "t string")
    hits = df.select(features.mention(F.col("t"), EntityPattern("a", ["C++"])).alias("hit")).collect()
    assert [r.hit for r in hits] == [True, False]


def test_null_flags(spark):
    rows = [(True, None), (False, None), (None, None)]
    df = spark.createDataFrame(rows, "a boolean, b boolean").select((F.col("a") | F.col("b")).alias("either"))
    assert [r.either for r in df.collect()] == [True, None, None]


def test_topic_filters_agree_and_fold_case(spark):
    df = spark.createDataFrame([("RCB",), ("rcb",), ("Chess",)], "subreddit string")
    forums = spark.createDataFrame([("rCb",), ("RCB",)], "forum string")
    assert features.filter_topic(df, TopicFilter(["rCb"])).count() == 2
    assert features.filter_topic_by_table(df, forums).count() == 2
    assert len(CRICKET_TOPIC.forums) == 46 and len(CRICKET_TOPIC.names) == 45


def test_a_table_past_the_bound_is_not_broadcast(spark):
    small = spark.range(10)
    assert scale.fits_broadcast(small, max_rows=10)
    assert not scale.fits_broadcast(small, max_rows=9)
    assert not scale.fits_broadcast(small, max_bytes=100)
    wide = spark.range(3).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert not scale.fits_broadcast(wide, max_bytes=3000)
    plan = features.filter_topic_by_table(
        spark.createDataFrame([("a",)], "subreddit string"), spark.createDataFrame([("A",)], "forum string"))
    assert plan.count() == 1


def test_discovery_matches_substrings(spark):
    df = spark.createDataFrame([("Cricket",), ("harry",), ("chess",), ("Cricket",)], "subreddit string")
    found = features.discover_forums(df, ["cricket", "rr"]).collect()
    assert [(r.subreddit, r.post_count) for r in found] == [("Cricket", 2), ("harry", 1)]


def test_threshold_ties_go_up(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "score long")
    assert [r.y for r in features.threshold_label(df, "score", 2, "y").orderBy("score").collect()] == [0, 1, 1]


def test_preset_calendar_keeps_its_odd_ends(spark):
    last = int((datetime(2023, 11, 26) - datetime(1970, 1, 1)).total_seconds())
    df = spark.createDataFrame([(last,), (last + 1,)], "created_utc long")
    labels = features.label_event_period(df, CRICKET_CALENDAR).orderBy("created_utc").collect()
    assert [r.event_period for r in labels] == ["wc2023_final_aftermath", "other"]
