"""The whole study: the filter job and all result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur import study
from murmur.functions.scale import scratch_path
from murmur.functions.words import ENGLISH_STOP_WORDS
from murmur.plans import modelling, sql, texts
from murmur.plans.base import CALENDAR, ENTITIES, query, scored_posts, tagged_posts
from murmur.plans.tables import TOPIC
from murmur.sources import fixtures, tables

STUDY = study.Study(
    fixtures.TOPIC, ENTITIES, CALENDAR,
    [study.Event("a", "a_build", "a_after", "a_after"), study.Event("b", "b_build", "b_after", "b_after")],
    fixtures.HEAD_TO_HEAD, [*ENGLISH_STOP_WORDS, *fixtures.STOP_WORDS])
BOTH = f"WITH {sql.POSTS}, {sql.COMMENTS.removeprefix(sql.RATIOS + ', ')}"


def _filtered(spark, sf_dir) -> study.Filtered:
    posts = tables.save_partitioned(fixtures.posts(spark, sf_dir), scratch_path(spark, "raw-posts"))
    comments = tables.save_partitioned(fixtures.comments(spark, sf_dir), scratch_path(spark, "raw-comments"))
    return study.filter_to_topic(spark, posts, comments, scratch_path(spark, "topic"), fixtures.TOPIC)


@query("s03_filter_job", f"""{BOTH}
SELECT 'posts' AS "table", count(*) AS rows FROM posts WHERE lower(subreddit) IN {TOPIC}
UNION ALL SELECT 'comments', count(*) FROM comments WHERE lower(subreddit) IN {TOPIC}""")
def filter_job(spark, sf_dir):
    """Raw tables are filtered to the topic and saved; the counts are those of the saved files."""
    return _filtered(spark, sf_dir).counts


@query("s03_filter_job_volumes", f"""{BOTH}
SELECT 'posts' AS "table", subreddit, count(*) AS rows FROM posts WHERE lower(subreddit) IN {TOPIC} GROUP BY subreddit
UNION ALL SELECT 'comments', subreddit, count(*) FROM comments WHERE lower(subreddit) IN {TOPIC} GROUP BY subreddit""")
def filter_job_volumes(spark, sf_dir):
    return _filtered(spark, sf_dir).volumes


def _window(event: study.Event) -> str:
    return sql.covers("created_dt", CALENDAR.window(event.first, event.last))


SIZES = {"player_engagement": f"SELECT count(*) FILTER (WHERE n > 0) FROM ({' UNION ALL '.join(f'SELECT count(*) AS n FROM tagged WHERE {e.flag}' for e in ENTITIES)})"}
for _event in STUDY.events:
    SIZES |= {
        f"{_event.name}_mentions_by_period": f"SELECT count(DISTINCT event_period) FROM tagged WHERE {_window(_event)}",
        f"{_event.name}_engagement_by_period": f"SELECT count(DISTINCT event_period) FROM tagged WHERE {_window(_event)}",
        f"{_event.name}_top_aftermath_posts": f"SELECT least(10, count(*)) FROM tagged WHERE {_window(_event)} AND event_period = '{_event.aftermath}'",
    }
SIZES |= {
    "head_to_head": f"SELECT count(DISTINCT event_period) FROM tagged WHERE event_period IN {sql.listed(fixtures.HEAD_TO_HEAD)}",
    "sentiment_by_period": f"SELECT count(DISTINCT event_period) FROM tagged WHERE event_period IN {sql.listed(CALENDAR.labels)}",
    "player_sentiment": "SELECT count(*) FILTER (WHERE n > 0) FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM tagged WHERE {e.flag}" for e in ENTITIES) + ")",
    "topic_words": "SELECT 60", "classification_metrics": "SELECT 2", "feature_importances": f"SELECT {len(modelling.NUMERIC) + 2}", "regression_metrics": "SELECT 2",
    "forum_clusters": "SELECT count(*) FROM (SELECT subreddit FROM tagged GROUP BY subreddit HAVING count(*) >= 50)", "model_summary": "SELECT 3",
}


@query("s06_study_tables", f"{sql.TAGGED_POSTS} " + " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", CAST(({size}) AS BIGINT) AS rows" for name, size in SIZES.items()))
def study_tables(spark, sf_dir):
    """All result tables are written, and their rows counted from the files."""
    fits = study.Fits(modelling._models(spark, sf_dir), modelling._forums(spark, sf_dir), texts._topics(spark, sf_dir))
    found = study.result_tables(STUDY, tagged_posts(spark, sf_dir), scored_posts(spark, sf_dir), fits, modelling._rows(spark, sf_dir))
    written = study.write_tables(found, scratch_path(spark, "study"))
    counts = [spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(path)
              .agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, path in written.items()]
    return reduce(DataFrame.unionByName, counts)
