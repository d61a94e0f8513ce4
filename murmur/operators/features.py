"""Row-level features: time parts, period labels, entity flags, topic filters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.clock import from_unix_seconds
from murmur.functions.scale import broadcast_if_small
from murmur.specs import OTHER, Calendar, EntityPattern, Period, TopicFilter

ANY_FLAG = "mentions_any"
FORUM_KEY = "forum_lc"


# Time

def add_time_features(df: DataFrame, ts_col: str = "created_utc") -> DataFrame:
    """Add created_dt, hour_of_day, day_of_week (1 = Sunday), month_num and year_num."""
    moment = from_unix_seconds(F.col(ts_col))
    return df.select(
        "*",
        moment.alias("created_dt"),
        F.hour(moment).alias("hour_of_day"),
        F.dayofweek(moment).alias("day_of_week"),
        F.month(moment).alias("month_num"),
        F.year(moment).alias("year_num"),
    )


def _covers(df: DataFrame, ts_col: str, period: Period) -> Column:
    if isinstance(df.schema[ts_col].dataType, T.TimestampNTZType):
        return period.covers_timestamp(F.col(ts_col))
    return period.covers_seconds(F.col(ts_col))


def label_event_period(df: DataFrame, calendar: Calendar, ts_col: str = "created_utc",
                       output: str = "event_period") -> DataFrame:
    """Label each row with the first period that covers it, or 'other'."""
    label = reduce(
        lambda rest, p: F.when(_covers(df, ts_col, p), F.lit(p.label)).otherwise(rest),
        reversed(calendar.periods),
        F.lit(OTHER),
    )
    return df.withColumn(output, label)


def in_window(df: DataFrame, window: Period, ts_col: str = "created_utc") -> DataFrame:
    """Keep rows inside one span of time. Raw seconds are compared, so files can be skipped."""
    return df.where(_covers(df, ts_col, window))


def month_start(year: str = "year_num", month: str = "month_num") -> Column:
    return F.make_date(F.col(year), F.col(month), F.lit(1))


def period_position(calendar: Calendar, column: str = "event_period") -> Column:
    """The ordinal of a period label; NULL for labels outside the calendar."""
    return reduce(
        lambda rest, item: F.when(F.col(column) == item[1], F.lit(item[0])).otherwise(rest),
        reversed(list(enumerate(calendar.labels))),
        F.lit(None).cast("int"),
    )


def event_label(labels: Mapping[str, str], column: str = "event_period") -> Column:
    """The display name of a period; NULL for periods that have none."""
    return reduce(
        lambda rest, item: F.when(F.col(column) == item[0], F.lit(item[1])).otherwise(rest),
        reversed(list(labels.items())),
        F.lit(None).cast("string"),
    )


# Entities

def mention(text: Column, entity: EntityPattern) -> Column:
    """Whether the text mentions the entity, in any case; NULL for NULL text.

    A plain substring search goes first: most texts hold none of the terms, and
    it is several times cheaper than the regex that checks the word edges.
    """
    lowered = F.lower(text)
    anywhere = reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(t)) for t in entity.lower_terms))
    return anywhere & F.rlike(lowered, F.lit(entity.regex))


def add_mentions(df: DataFrame, text_col: str, entities: Sequence[EntityPattern]) -> DataFrame:
    """Add one boolean per entity and ``mentions_any``, their OR; without entities it is false."""
    flags = df.select("*", *(mention(F.col(text_col), e).alias(e.flag) for e in entities))
    return flags.withColumn(ANY_FLAG, reduce(lambda a, b: a | b, (F.col(e.flag) for e in entities), F.lit(False)))


def explode_entities(df: DataFrame, entities: Sequence[EntityPattern], output: str = "player") -> DataFrame:
    """One row per (row, mentioned entity), from flags already present.

    A single pass over the input however many entities there are; rows without
    a mention disappear here, before any shuffle.
    """
    names = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(F.col(e.flag), F.lit(e.name)) for e in entities)))
    return df.where(F.col(ANY_FLAG)).withColumn(output, F.explode(names))


def flags_to_int(df: DataFrame, entities: Sequence[EntityPattern]) -> DataFrame:
    return df.withColumns({e.flag: F.col(e.flag).cast("int") for e in entities})


# Topic

def with_forum_key(df: DataFrame, forum_col: str = "subreddit") -> DataFrame:
    """Add the lower-cased forum name, for saving with a table that will be filtered by forum again."""
    return df.withColumn(FORUM_KEY, F.lower(forum_col))


def _forum_key(df: DataFrame, forum_col: str) -> Column:
    return F.col(FORUM_KEY) if FORUM_KEY in df.columns else F.lower(forum_col)


def filter_topic(df: DataFrame, topic: TopicFilter, forum_col: str = "subreddit") -> DataFrame:
    """Keep rows of the topic's forums, comparing names without regard to case.

    On a table saved with its forum key the bare key is compared, which the
    Parquet reader can use to skip row groups; ``lower()`` it cannot.
    """
    return df.where(_forum_key(df, forum_col).isin(list(topic.names)))


def filter_topic_by_table(df: DataFrame, forums: DataFrame, forum_col: str = "subreddit",
                          name_col: str = "forum") -> DataFrame:
    """The same filter with the forum names in a table of any size."""
    names = forums.select(F.lower(name_col).alias("_forum")).distinct()
    return df.join(broadcast_if_small(names), _forum_key(df, forum_col) == F.col("_forum"), "left_semi")


def discover_forums(df: DataFrame, keywords: Sequence[str], forum_col: str = "subreddit") -> DataFrame:
    """Volume of every forum whose name contains one of the keywords.

    A substring match: short keywords also hit unrelated names, so the result is
    a list to review, not a filter. Keywords are plain text; without one no forum is found.
    """
    pattern = "(?i)(" + "|".join(map(re.escape, keywords)) + ")" if keywords else r"(?!)"
    return (
        df.where(F.rlike(F.lower(forum_col), F.lit(pattern)))
        .groupBy(forum_col)
        .agg(F.count("*").alias("post_count"))
        .orderBy(F.desc("post_count"), forum_col)
    )


def tag(df: DataFrame, text_col: str, entities: Sequence[EntityPattern], calendar: Calendar) -> DataFrame:
    """Time parts, period label and entity flags in one go."""
    return add_mentions(label_event_period(add_time_features(df), calendar), text_col, entities)


# Labels

def threshold_label(df: DataFrame, column: str, threshold: float, output: str) -> DataFrame:
    """1 where the value reaches the threshold (ties go up), else 0."""
    return df.withColumn(output, F.when(F.col(column) >= F.lit(threshold), 1).otherwise(0))
