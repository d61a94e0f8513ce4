"""A whole study in two calls: filter the raw tables to a topic, then write every result table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.scale import stage
from murmur.functions.words import ENGLISH_STOP_WORDS
from murmur.operators import features, models, reactions, sentiment, topics
from murmur.sources import tables
from murmur.specs import Calendar, EntityPattern, TopicFilter


@dataclass(frozen=True)
class Event:
    """One event of the calendar: its first and last period and the one that is its aftermath."""

    name: str
    first: str
    last: str
    aftermath: str


@dataclass(frozen=True)
class Study:
    """All that a study is about."""

    topic: TopicFilter
    entities: Sequence[EntityPattern]
    calendar: Calendar
    events: Sequence[Event]
    head_to_head: Mapping[str, str]
    stop_words: Sequence[str] = tuple(ENGLISH_STOP_WORDS)


# The filter job

@dataclass(frozen=True)
class Filtered:
    """Where the filtered tables lie, how many rows each has, and the volume of each forum in each."""

    posts: str
    comments: str
    counts: DataFrame
    volumes: DataFrame


def filter_to_topic(
    spark: SparkSession,
    posts_path: str,
    comments_path: str,
    out: str,
    topic: TopicFilter,
    years: Sequence[int] | None = None,
    months: Sequence[int] | None = None,
    post_columns: Mapping[str, str | Column] | None = None,
    comment_columns: Mapping[str, str | Column] | None = None,
    cluster: bool = False,
) -> Filtered:
    """Load both raw tables, keep the topic's forums, save what is left by month, and count it from the files.

    Each raw table is read once, without a shuffle before the filter; what passes is saved with its forum key under
    ``out``, gathered by month, or with ``cluster`` laid out by forum inside each month. The counts come from the
    saved files' footers and the volumes from one column of them. ``years`` and ``months`` limit which partitions are read;
    ``post_columns`` and ``comment_columns`` are those of ``tables.conform``.
    """
    paths = {"posts": f"{out.rstrip('/')}/posts", "comments": f"{out.rstrip('/')}/comments"}
    raw = {"posts": tables.load_posts(spark, posts_path, years, months, columns=post_columns),
           "comments": tables.load_comments(spark, comments_path, years, months, columns=comment_columns)}
    for name, df in raw.items():
        kept = features.with_forum_key(features.filter_topic(df, topic))
        layout = {"cluster_by": [features.FORUM_KEY]} if cluster else {"rebalance": True}
        tables.save_partitioned(kept, paths[name], **layout)
    volumes = [reactions.forum_volume(spark.read.parquet(path), output="rows").select(F.lit(name).alias("table"), "subreddit", "rows")
               for name, path in paths.items()]
    volumes = volumes[0].unionByName(volumes[1]).orderBy(F.desc("table"), F.desc("rows"), "subreddit")
    return Filtered(paths["posts"], paths["comments"], tables.verify_saved(spark, paths), volumes)


# Result tables

@dataclass(frozen=True)
class Fits:
    """The fitted models that some result tables show."""

    engagement: models.EngagementModels
    forums: models.ForumClusters
    topics: topics.TopicModel


def without_texts(posts: DataFrame, text_col: str = "title") -> DataFrame:
    """Tagged posts without their texts, staged, so that whatever reads the flags doesn't search the texts again."""
    return stage(posts.drop(text_col), "tagged-rows")


def fit_all(study: Study, posts: DataFrame, comments: DataFrame) -> Fits:
    """Fit all models on tagged posts and comments, each on its own staged rows; the posts' texts are searched once."""
    rows = without_texts(posts)
    return Fits(
        models.fit_engagement_models(models.feature_table(rows, study.entities), study.entities),
        models.cluster_forums(reactions.forum_profile(rows, study.entities), study.entities),
        topics.fit_topics(comments, "body", "comment_id", keep=["event_period"], stop_words=study.stop_words))


def result_tables(study: Study, posts: DataFrame, scored: DataFrame, fits: Fits | None = None,
                  rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every result table of a study by name.

    ``posts`` are tagged, ``scored`` the posts with their sentiment, period and entity flags. All tables are aggregates or
    short lists. Without ``fits`` the tables of models are left out. What the tables read of both is staged first, as
    each is an action of its own, and would search and score all texts again; ``rows`` is what ``without_texts`` has made
    of the posts, if it is there already. Only the lists of top posts read ``posts`` themselves, and no flags of them.
    """
    rows = without_texts(posts) if rows is None else rows
    read = scored.where(F.col("event_period").isin(study.calendar.labels) | F.col(features.ANY_FLAG))
    scored = stage(read.select("event_period", *(e.flag for e in study.entities), features.ANY_FLAG, "sentiment"), "scored-rows")
    found = {"player_engagement": reactions.engagement_by_entity(rows, study.entities)}
    for event in study.events:
        window = study.calendar.window(event.first, event.last)
        inside = features.in_window(rows, window)
        found[f"{event.name}_mentions_by_period"] = reactions.mentions_by_period(inside, study.entities, study.calendar)
        found[f"{event.name}_engagement_by_period"] = reactions.engagement_by_period(inside, study.calendar)
        found[f"{event.name}_top_aftermath_posts"] = reactions.top_posts(features.in_window(posts, window), event.aftermath)
    found["head_to_head"] = reactions.head_to_head(rows, study.head_to_head)
    found["sentiment_by_period"] = sentiment.sentiment_by_period(scored, study.calendar)
    found["player_sentiment"] = sentiment.sentiment_by_entity(scored, study.entities)
    if fits is not None:
        found |= {
            "topic_words": fits.topics.topic_words(),
            "classification_metrics": models.classification_metrics(fits.engagement.classified()),
            "feature_importances": models.feature_importances(fits.engagement, study.entities),
            "regression_metrics": models.regression_metrics(fits.engagement.regressed()),
            "forum_clusters": fits.forums.table(),
            "model_summary": models.model_summary(fits.engagement, fits.forums),
        }
    return found


def write_tables(found: Mapping[str, DataFrame], out: str) -> dict[str, str]:
    """Write each table as one CSV file in a folder of its name under ``out``; returns the folders."""
    return {name: tables.save_result_csv(df, f"{out.rstrip('/')}/{name}", keep_order=True) for name, df in found.items()}
