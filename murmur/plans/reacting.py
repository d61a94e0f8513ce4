"""Volumes, mentions, engagement, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.operators import features, models, reactions
from murmur.plans import sql
from murmur.plans.base import CALENDAR, ENTITIES, query, rounded, tagged_comments, tagged_posts
from murmur.sources import fixtures

EVENT_A = CALENDAR.window("a_build", "a_after")
EVENT_B = CALENDAR.window("b_build", "b_after")
ENGAGEMENT = "count(*) AS posts, round(avg(score), 6) AS avg_score, round(avg(num_comments), 6) AS avg_comments"
LABELS = sql.listed(CALENDAR.labels)


@query("a01_row_count", f"WITH {sql.POSTS} SELECT count(*) AS rows FROM posts")
def row_count(spark, sf_dir):
    return reactions.row_count(fixtures.posts(spark, sf_dir))


@query("a02_forum_volume_posts", f"""WITH {sql.POSTS} SELECT subreddit, count(*) AS post_count FROM posts
WHERE lower(subreddit) IN {sql.listed(fixtures.TOPIC.names)} GROUP BY subreddit""")
def forum_volume_posts(spark, sf_dir):
    return reactions.forum_volume(features.filter_topic(fixtures.posts(spark, sf_dir), fixtures.TOPIC))


@query("a02_forum_volume_comments", f"""WITH {sql.COMMENTS} SELECT subreddit, count(*) AS comment_count FROM comments
WHERE lower(subreddit) IN {sql.listed(fixtures.TOPIC.names)} GROUP BY subreddit""")
def forum_volume_comments(spark, sf_dir):
    topical = features.filter_topic(fixtures.comments(spark, sf_dir), fixtures.TOPIC)
    return reactions.forum_volume(topical, output="comment_count")


@query("a03_mention_totals_posts", f"{sql.TAGGED_POSTS} SELECT {sql.SUMS} FROM tagged")
def mention_totals_posts(spark, sf_dir):
    return reactions.mention_totals(tagged_posts(spark, sf_dir), ENTITIES)


@query("a03_mention_totals_comments", f"{sql.TAGGED_COMMENTS} SELECT {sql.SUMS} FROM tagged")
def mention_totals_comments(spark, sf_dir):
    return reactions.mention_totals(tagged_comments(spark, sf_dir), ENTITIES)


@query("a04_mentions_by_period", f"""{sql.TAGGED_POSTS} SELECT event_period, {sql.SUMS} FROM tagged
WHERE {sql.covers('created_dt', EVENT_A)} GROUP BY event_period""")
def mentions_by_period(spark, sf_dir):
    window = features.in_window(tagged_posts(spark, sf_dir), EVENT_A)
    return reactions.mentions_by_period(window, ENTITIES, CALENDAR)


@query("a05_monthly_mentions", f"""{sql.TAGGED_POSTS} SELECT year_num, month_num, {sql.SUMS},
make_date(year_num, month_num, 1) AS date FROM tagged WHERE mentions_any GROUP BY year_num, month_num""")
def monthly_mentions(spark, sf_dir):
    return reactions.monthly_mentions(tagged_posts(spark, sf_dir), ENTITIES)


@query("a06_engagement_by_entity",
       f"{sql.TAGGED_POSTS}, {sql.ENTITY_ROWS} SELECT player, {ENGAGEMENT} FROM entity_rows GROUP BY player")
def engagement_by_entity(spark, sf_dir):
    return rounded(reactions.engagement_by_entity(tagged_posts(spark, sf_dir), ENTITIES))


@query("a07_engagement_by_period", f"{sql.TAGGED_POSTS} SELECT event_period, {ENGAGEMENT} FROM tagged GROUP BY event_period")
def engagement_by_period(spark, sf_dir):
    return rounded(reactions.engagement_by_period(tagged_posts(spark, sf_dir), CALENDAR))


@query("a08_head_to_head", f"""{sql.TAGGED_POSTS}, sides AS (
  SELECT event_period, {sql.ENGAGEMENT} FROM tagged WHERE event_period IN ('a_after', 'b_after') GROUP BY event_period),
base AS (SELECT * FROM sides WHERE event_period = 'a_after')
SELECT s.posts, round(s.avg_score, 6) AS avg_score, round(s.avg_comments, 6) AS avg_comments,
  {sql.event_name(fixtures.HEAD_TO_HEAD, 's.event_period')} AS event,
  round(s.posts / b.posts, 6) AS posts_ratio, round(s.avg_score / b.avg_score, 6) AS avg_score_ratio,
  round(s.avg_comments / b.avg_comments, 6) AS avg_comments_ratio
FROM sides s, base b""")
def head_to_head(spark, sf_dir):
    return rounded(reactions.head_to_head(tagged_posts(spark, sf_dir), fixtures.HEAD_TO_HEAD))


@query("a09_daily_volume", f"""{sql.TAGGED_POSTS} SELECT CAST(created_dt AS DATE) AS date, count(*) AS post_count
FROM tagged WHERE {sql.covers('created_dt', EVENT_B)} GROUP BY 1""")
def daily_volume(spark, sf_dir):
    return reactions.daily_volume(features.in_window(fixtures.posts(spark, sf_dir), EVENT_B))


@query("a12_forum_profile", f"""{sql.TAGGED_POSTS}, {sql.PROFILE}
SELECT * REPLACE (round(avg_score, 6) AS avg_score, round(avg_comments, 6) AS avg_comments,
                  round(avg_post_hour, 6) AS avg_post_hour) FROM profile""")
def forum_profile(spark, sf_dir):
    return rounded(reactions.forum_profile(tagged_posts(spark, sf_dir), ENTITIES))


@query("a14_exact_quantile", f"""WITH {sql.POSTS} SELECT subreddit, count(*) AS above FROM posts
WHERE score >= (SELECT quantile_cont(score, 0.75) FROM posts) GROUP BY subreddit""")
def exact_quantile(spark, sf_dir):
    posts = fixtures.posts(spark, sf_dir)
    bound = models.quantile(posts, "score", 0.75)
    return posts.where(F.col("score") >= bound).groupBy("subreddit").agg(F.count("*").alias("above"))


@query("a14_approximate_quantile")
def approximate_quantile(spark, sf_dir):
    posts = fixtures.posts(spark, sf_dir)
    bound = models.quantile(posts, "score", 0.75, exact=False)
    return posts.where(F.col("score") >= bound).groupBy("subreddit").agg(F.count("*").alias("above"))


@query("a16_distinct", f"{sql.TAGGED_POSTS} SELECT DISTINCT subreddit, event_period FROM tagged")
def distinct(spark, sf_dir):
    return tagged_posts(spark, sf_dir).select("subreddit", "event_period").distinct()


@query("t01_top_forums", f"""WITH {sql.POSTS} SELECT subreddit, count(*) AS post_count FROM posts
GROUP BY subreddit ORDER BY post_count DESC, subreddit LIMIT 7""")
def top_forums(spark, sf_dir):
    return reactions.top_forums(fixtures.posts(spark, sf_dir), n=7)


@query("t02_top_forums_by_entity", f"""{sql.TAGGED_POSTS}, {sql.ENTITY_ROWS}, counts AS (
  SELECT player, subreddit, count(*) AS mentions FROM entity_rows GROUP BY player, subreddit)
SELECT player, subreddit, mentions, CAST(position AS INTEGER) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY player ORDER BY mentions DESC, subreddit) AS position FROM counts)
WHERE position <= 10""")
def top_forums_by_entity(spark, sf_dir):
    return reactions.top_forums_by_entity(tagged_posts(spark, sf_dir), ENTITIES)


@query("t03_top_posts", f"""{sql.TAGGED_POSTS} SELECT post_id, title, subreddit, score, num_comments, created_dt
FROM tagged WHERE event_period = 'a_after' ORDER BY score DESC, post_id LIMIT 10""")
def top_posts(spark, sf_dir):
    return reactions.top_posts(tagged_posts(spark, sf_dir), "a_after")


@query("t04_time_order", f"""{sql.TAGGED_POSTS} SELECT year_num, month_num, hour_of_day, count(*) AS posts
FROM tagged GROUP BY ALL ORDER BY ALL""")
def time_order(spark, sf_dir):
    hours = ["year_num", "month_num", "hour_of_day"]
    timed = features.add_time_features(fixtures.posts(spark, sf_dir))
    return timed.groupBy(*hours).agg(F.count("*").alias("posts")).orderBy(*hours)


@query("t05_hash_sample", f"""WITH {sql.COMMENTS} SELECT comment_id, body FROM comments
ORDER BY md5(CAST(comment_id AS VARCHAR)), comment_id LIMIT 100""")
def hash_sample(spark, sf_dir):
    return reactions.hash_sample(fixtures.comments(spark, sf_dir).select("comment_id", "body"), 100, "comment_id")


@query("u01_union_of_entities",
       f"{sql.TAGGED_POSTS}, {sql.ENTITY_ROWS} SELECT {ENGAGEMENT}, player FROM entity_rows GROUP BY player")
def union_of_entities(spark, sf_dir):
    tagged = tagged_posts(spark, sf_dir)
    return rounded(reactions.union_of([reactions.engagement_of(tagged, e) for e in ENTITIES]))


@query("u02_stacked_events", f"""{sql.TAGGED_POSTS}
SELECT {ENGAGEMENT}, {sql.event_name(fixtures.HEAD_TO_HEAD)} AS event FROM tagged
WHERE event_period IN ('a_after', 'b_after') GROUP BY event_period""")
def stacked_events(spark, sf_dir):
    tagged = tagged_posts(spark, sf_dir)
    parts = [
        tagged.where(F.col("event_period") == period).agg(*reactions.engagement_measures()).withColumn("event", F.lit(event))
        for period, event in fixtures.HEAD_TO_HEAD.items()
    ]
    return rounded(reactions.union_of(parts))


STANDING = f"""volumes AS (
  SELECT event_period, subreddit, count(*) AS posts FROM tagged WHERE event_period IN {LABELS} GROUP BY ALL),
standing AS (
  SELECT *, posts / sum(posts) OVER (PARTITION BY event_period) AS share,
         CAST(rank() OVER (PARTITION BY event_period ORDER BY posts DESC) AS BIGINT) AS position FROM volumes)"""


@query("x01_dominant_forums", f"""{sql.TAGGED_POSTS}, {STANDING}
SELECT event_period, subreddit, posts, round(share, 6) AS share, position FROM standing""")
def dominant_forums(spark, sf_dir):
    return rounded(reactions.dominant_forums(tagged_posts(spark, sf_dir), CALENDAR))


@query("x01_forum_rank_change", f"""{sql.TAGGED_POSTS}, {STANDING},
a AS (SELECT * FROM standing WHERE event_period = 'a_after'), b AS (SELECT * FROM standing WHERE event_period = 'b_after')
SELECT coalesce(a.subreddit, b.subreddit) AS subreddit, a.posts AS before_posts, round(a.share, 6) AS before_share,
  a.position AS before_position, b.posts AS after_posts, round(b.share, 6) AS after_share, b.position AS after_position,
  a.position - b.position AS places_gained, round(b.share - a.share, 6) AS share_change
FROM a FULL JOIN b ON a.subreddit = b.subreddit""")
def forum_rank_change(spark, sf_dir):
    return rounded(reactions.forum_rank_change(tagged_posts(spark, sf_dir), "a_after", "b_after"))


@query("x02_entity_against_team", f"""{sql.TAGGED_POSTS} SELECT
CASE WHEN mentions_any THEN 'entity' WHEN {sql.mention('title', fixtures.TEAM_TERMS)} THEN 'team' ELSE 'neither' END
  AS segment, {ENGAGEMENT} FROM tagged GROUP BY 1""")
def entity_against_team(spark, sf_dir):
    return rounded(reactions.entity_against_team(tagged_posts(spark, sf_dir), "title", fixtures.TEAM_TERMS))


@query("x05_engagement_at_home", f"""{sql.TAGGED_POSTS}, {sql.ENTITY_ROWS} SELECT player,
CASE WHEN {" OR ".join(f"(player = '{e.name}' AND lower(subreddit) IN {sql.listed(f.lower() for f in e.home_forums)})"
                       for e in ENTITIES)} THEN 'home' ELSE 'away' END AS ground, {ENGAGEMENT}
FROM entity_rows GROUP BY ALL""")
def engagement_at_home(spark, sf_dir):
    return rounded(reactions.engagement_at_home(tagged_posts(spark, sf_dir), ENTITIES))


@query("x07_comment_mentions_by_period", f"{sql.TAGGED_COMMENTS} SELECT event_period, {sql.SUMS} FROM tagged GROUP BY event_period")
def comment_mentions_by_period(spark, sf_dir):
    return reactions.mentions_by_period(tagged_comments(spark, sf_dir), ENTITIES, CALENDAR)
