"""Volumes, mention counts, engagement and rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.clock import from_unix_seconds
from murmur.functions.scale import first_by_hash
from murmur.operators.features import (
    ANY_FLAG,
    event_label,
    explode_entities,
    mention,
    month_start,
    period_position,
)
from murmur.specs import Calendar, EntityPattern


def engagement_measures() -> list[Column]:
    return [
        F.count("*").alias("posts"),
        F.avg("score").alias("avg_score"),
        F.avg("num_comments").alias("avg_comments"),
    ]


def _mention_sums(entities: Sequence[EntityPattern]) -> list[Column]:
    return [F.sum(F.col(e.flag).cast("int")).alias(e.name) for e in entities]


# Volume

def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def forum_volume(df: DataFrame, forum_col: str = "subreddit", output: str = "post_count") -> DataFrame:
    """Rows per forum, largest first; equal counts in name order."""
    return df.groupBy(forum_col).agg(F.count("*").alias(output)).orderBy(F.desc(output), forum_col)


def top_forums(df: DataFrame, n: int = 30, forum_col: str = "subreddit", output: str = "post_count") -> DataFrame:
    return forum_volume(df, forum_col, output).limit(n)


def daily_volume(df: DataFrame, ts_col: str = "created_utc") -> DataFrame:
    """Rows per calendar day (UTC)."""
    day = F.to_date(from_unix_seconds(F.col(ts_col)))
    return df.groupBy(day.alias("date")).agg(F.count("*").alias("post_count")).orderBy("date")


# Mentions

def mention_totals(df: DataFrame, entities: Sequence[EntityPattern]) -> DataFrame:
    """One row: how many rows mention each entity."""
    return df.agg(*_mention_sums(entities))


def mentions_by_period(df: DataFrame, entities: Sequence[EntityPattern], calendar: Calendar) -> DataFrame:
    """Mention totals per period label, in calendar order with 'other' last."""
    return (
        df.groupBy("event_period")
        .agg(*_mention_sums(entities))
        .orderBy(period_position(calendar).asc_nulls_last())
    )


def monthly_mentions(df: DataFrame, entities: Sequence[EntityPattern]) -> DataFrame:
    """Mentions per month among rows that mention anyone."""
    return (
        df.where(F.col(ANY_FLAG))
        .groupBy("year_num", "month_num")
        .agg(*_mention_sums(entities))
        .withColumn("date", month_start())
        .orderBy("year_num", "month_num")
    )


# Engagement

def engagement_by_entity(df: DataFrame, entities: Sequence[EntityPattern]) -> DataFrame:
    """Posts, average score and average comments per entity, in one scan."""
    return explode_entities(df, entities).groupBy("player").agg(*engagement_measures()).orderBy("player")


def engagement_of(df: DataFrame, entity: EntityPattern) -> DataFrame:
    """The same for a single entity, tagged with its name."""
    return df.where(F.col(entity.flag)).agg(*engagement_measures()).withColumn("player", F.lit(entity.name))


def union_of(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack frames by column name."""
    return reduce(DataFrame.unionByName, parts)


def engagement_by_period(df: DataFrame, calendar: Calendar) -> DataFrame:
    return (
        df.groupBy("event_period")
        .agg(*engagement_measures())
        .orderBy(period_position(calendar).asc_nulls_last())
    )


def head_to_head(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Engagement of chosen periods side by side, with ratios to the first of them."""
    order = reduce(
        lambda rest, item: F.when(F.col("event_period") == item[1], F.lit(item[0])).otherwise(rest),
        reversed(list(enumerate(labels))), F.lit(None).cast("int"))
    stats = (
        df.where(F.col("event_period").isin(list(labels)))
        .groupBy("event_period")
        .agg(*engagement_measures())
        .withColumn("order", order)
    )
    first = Window.orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ratios = [
        F.try_divide(F.col(c).cast("double"), F.first(c).over(first).cast("double")).alias(f"{c}_ratio")
        for c in ("posts", "avg_score", "avg_comments")
    ]
    return stats.select(
        "posts", "avg_score", "avg_comments", event_label(labels).alias("event"), *ratios, "order"
    ).orderBy("order").drop("order")


def entity_against_team(df: DataFrame, text_col: str, team: EntityPattern) -> DataFrame:
    """Engagement of posts naming an entity, posts naming only the team, and the rest."""
    segment = (
        F.when(F.col(ANY_FLAG), "entity")
        .when(mention(F.col(text_col), team), "team")
        .otherwise("neither")
    )
    return df.groupBy(segment.alias("segment")).agg(*engagement_measures()).orderBy("segment")


def engagement_at_home(df: DataFrame, entities: Sequence[EntityPattern], forum_col: str = "subreddit") -> DataFrame:
    """Engagement per entity inside and outside the forums its fans call home."""
    forum = F.lower(forum_col)
    home = reduce(
        lambda rest, e: F.when(F.col("player") == e.name, forum.isin([f.lower() for f in e.home_forums])).otherwise(rest),
        reversed(entities), F.lit(False))
    ground = F.when(home, "home").otherwise("away")
    return (
        explode_entities(df, entities)
        .groupBy("player", ground.alias("ground"))
        .agg(*engagement_measures())
        .orderBy("player", "ground")
    )


def forum_profile(df: DataFrame, entities: Sequence[EntityPattern], min_posts: int = 50) -> DataFrame:
    """Behaviour of each forum with at least ``min_posts`` posts; rows with a gap are dropped."""
    return (
        df.groupBy("subreddit")
        .agg(
            F.count("*").alias("post_count"),
            F.avg("score").alias("avg_score"),
            F.avg("num_comments").alias("avg_comments"),
            *(F.sum(F.col(e.flag).cast("int")).alias(f"{e.name.lower()}_mentions") for e in entities),
            F.avg("hour_of_day").alias("avg_post_hour"),
        )
        .where(F.col("post_count") >= min_posts)
        .dropna()
    )


# Rankings

def top_forums_by_entity(df: DataFrame, entities: Sequence[EntityPattern], n: int = 10) -> DataFrame:
    """The ``n`` forums that mention each entity most, for all entities in one scan.

    Rows are counted per entity and forum first; ranking then keeps only the
    leading rows of each task before it shuffles.
    """
    counts = explode_entities(df, entities).groupBy("player", "subreddit").agg(F.count("*").alias("mentions"))
    leading = Window.partitionBy("player").orderBy(F.desc("mentions"), "subreddit")
    return (
        counts.withColumn("position", F.row_number().over(leading))
        .where(F.col("position") <= n)
        .orderBy("player", "position")
    )


def top_posts(df: DataFrame, period: str, n: int = 10) -> DataFrame:
    """The highest-scoring posts of one period."""
    return (
        df.where(F.col("event_period") == period)
        .select("post_id", "title", "subreddit", "score", "num_comments", "created_dt")
        .orderBy(F.desc("score"), "post_id")
        .limit(n)
    )


def hash_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """A repeatable sample of ``n`` rows: those whose hashed key sorts first.

    The bound that they reach is found from the keys first, so that no partition sends ``n`` whole rows of its own.
    """
    return first_by_hash(df, n, key)


def _standing(volumes: DataFrame) -> DataFrame:
    """Add share and rank within each period to ``(event_period, subreddit, posts)``.

    Ranks come from the counts of counts. A period of N rows has fewer than
    sqrt(2 N) different forum volumes, so the ordered window stays small however
    many forums there are.
    """
    levels = volumes.groupBy("event_period", "posts").agg(F.count("*").alias("forums"))
    above = Window.partitionBy("event_period").orderBy(F.desc("posts")).rowsBetween(Window.unboundedPreceding, -1)
    period = Window.partitionBy("event_period")
    ranked = levels.select(
        "event_period", "posts",
        (F.coalesce(F.sum("forums").over(above), F.lit(0)) + 1).alias("position"),
        F.sum(F.col("posts") * F.col("forums")).over(period).alias("total"),
    )
    return volumes.join(ranked, ["event_period", "posts"]).select(
        "event_period", "subreddit", "posts", (F.col("posts") / F.col("total")).alias("share"), "position")


def dominant_forums(df: DataFrame, calendar: Calendar) -> DataFrame:
    """Share of posts and rank of every forum within every calendar period."""
    volumes = (
        df.where(F.col("event_period").isin(calendar.labels))
        .groupBy("event_period", "subreddit").agg(F.count("*").alias("posts"))
    )
    return _standing(volumes).orderBy(period_position(calendar), "position", "subreddit")


def forum_rank_change(df: DataFrame, before: str, after: str) -> DataFrame:
    """How each forum's rank and share moved between two periods.

    Forums absent from one of the periods keep NULLs on that side.
    """
    volumes = (
        df.where(F.col("event_period").isin(before, after))
        .groupBy("event_period", "subreddit").agg(F.count("*").alias("posts"))
    )
    standing = _standing(volumes)
    sides = standing.groupBy("subreddit").agg(*(
        F.max(F.when(F.col("event_period") == label, F.col(c))).alias(f"{side}_{c}")
        for side, label in (("before", before), ("after", after))
        for c in ("posts", "share", "position")
    ))
    return sides.select(
        "*",
        (F.col("before_position") - F.col("after_position")).alias("places_gained"),
        (F.col("after_share") - F.col("before_share")).alias("share_change"),
    ).orderBy("after_position", "subreddit")
