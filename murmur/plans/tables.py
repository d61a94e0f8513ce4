"""Scans, sinks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from murmur.functions.scale import scratch_path
from murmur.operators import features, mentions, models, reactions
from murmur.plans import sql
from murmur.plans.base import CALENDAR, ENTITIES, FLAGS, query, rounded, tagged_comments, tagged_posts
from murmur.sources import fixtures, tables
from murmur.specs import POSTS_SCHEMA

POST_COLUMNS = ", ".join(POSTS_SCHEMA.fieldNames())
COMMENT_COLUMNS = "comment_id, subreddit, body, score, author_id, created_utc, yyyy, mm"
TOPIC = sql.listed(fixtures.TOPIC.names)
PARTS = "post_id, created_dt, hour_of_day, day_of_week, month_num, year_num"
FLAG_LIST = ", ".join(FLAGS)
EVENT_A = CALENDAR.window("a_build", "a_after")


def _saved_posts(spark, sf_dir, topic=False, **options):
    posts = fixtures.posts(spark, sf_dir)
    posts = features.filter_topic(posts, fixtures.TOPIC) if topic else posts
    return tables.save_partitioned(posts, scratch_path(spark, "posts"), **options)


def _saved_comments(spark, sf_dir, topic=False, **options):
    comments = fixtures.comments(spark, sf_dir)
    comments = features.filter_topic(comments, fixtures.TOPIC) if topic else comments
    return tables.save_partitioned(comments, scratch_path(spark, "comments"), **options)


@query("s01_load_posts", f"WITH {sql.POSTS} SELECT {POST_COLUMNS} FROM posts WHERE yyyy = 2024 AND mm = 1")
def load_posts(spark, sf_dir):
    path = _saved_posts(spark, sf_dir)
    return tables.load_posts(spark, path, years=[2024], months=[1]).select(*POSTS_SCHEMA.fieldNames())


@query("s02_load_comments", f"WITH {sql.COMMENTS} SELECT {COMMENT_COLUMNS} FROM comments WHERE yyyy = 2024 AND mm = 1")
def load_comments(spark, sf_dir):
    path = _saved_comments(spark, sf_dir)
    return tables.load_comments(spark, path, years=[2024], months=[1]).select(*COMMENT_COLUMNS.split(", "))


@query("s03_load_topic_posts", f"WITH {sql.POSTS} SELECT {POST_COLUMNS} FROM posts WHERE lower(subreddit) IN {TOPIC}")
def load_topic_posts(spark, sf_dir):
    return tables.load_posts(spark, _saved_posts(spark, sf_dir, topic=True)).select(*POSTS_SCHEMA.fieldNames())


@query("s03_load_topic_comments",
       f"WITH {sql.COMMENTS} SELECT {COMMENT_COLUMNS} FROM comments WHERE lower(subreddit) IN {TOPIC}")
def load_topic_comments(spark, sf_dir):
    path = _saved_comments(spark, sf_dir, topic=True)
    return tables.load_comments(spark, path).select(*COMMENT_COLUMNS.split(", "))


@query("s04_save_partitioned", f"WITH {sql.POSTS} SELECT yyyy, mm, post_id, subreddit, score FROM posts")
def save_partitioned(spark, sf_dir):
    path = _saved_posts(spark, sf_dir, rebalance=True)
    return spark.read.parquet(path).select("yyyy", "mm", "post_id", "subreddit", "score")


MONTH_COLUMNS = "yyyy, mm, post_id, subreddit, score"


def _saved_months(spark, sf_dir, **options):
    return tables.save_partitioned(fixtures.posts_by_month(spark, sf_dir), scratch_path(spark, "months"), **options)


@query("s04_rewrite_month", f"""WITH {sql.POSTS_BY_MONTH} SELECT yyyy, mm, post_id, subreddit, score FROM by_month WHERE mm <> 2
UNION ALL SELECT yyyy, mm, post_id, subreddit, score + 1000 FROM by_month WHERE mm = 2 AND score >= 50""")
def rewrite_month(spark, sf_dir):
    """Several months are saved, then one of them again with other rows."""
    path = _saved_months(spark, sf_dir, rebalance=True)
    month = fixtures.posts_by_month(spark, sf_dir).where("mm = 2 AND score >= 50").withColumn("score", F.col("score") + 1000)
    tables.save_partitioned(month, path, rebalance=True, replace="partitions")
    return spark.read.parquet(path).select(*MONTH_COLUMNS.split(", "))


@query("s04_clustered_layout", f"WITH {sql.POSTS_BY_MONTH} SELECT {MONTH_COLUMNS} FROM by_month WHERE lower(subreddit) IN {TOPIC}")
def clustered_layout(spark, sf_dir):
    """Saved by month and forum key with Bloom filters, then filtered by the key, which is pushed down."""
    posts = features.with_forum_key(fixtures.posts_by_month(spark, sf_dir))
    path = tables.save_partitioned(posts, scratch_path(spark, "clustered"), cluster_by=[features.FORUM_KEY])
    return features.filter_topic(spark.read.parquet(path), fixtures.TOPIC).select(*MONTH_COLUMNS.split(", "))


@query("s05_saved_counts", f"WITH {sql.POSTS_BY_MONTH} SELECT yyyy, mm, count(*) AS rows FROM by_month GROUP BY yyyy, mm")
def saved_counts(spark, sf_dir):
    return tables.saved_counts(spark, _saved_months(spark, sf_dir, rebalance=True))


@query("s08_saved_coverage", f"WITH {sql.POSTS_BY_MONTH} SELECT DISTINCT yyyy, mm FROM by_month")
def saved_coverage(spark, sf_dir):
    return tables.saved_coverage(spark, _saved_months(spark, sf_dir, rebalance=True)).select("yyyy", "mm")


LATER = CALENDAR.moved(60)


@query("f02_calendar_pruning", f"""WITH {sql.POSTS_BY_MONTH} SELECT post_id, yyyy, mm FROM by_month
WHERE {sql.covers("TIMESTAMP '1970-01-01' + to_seconds(created_utc)", LATER["b_after"])}""")
def calendar_pruning(spark, sf_dir):
    """The months to read come from a saved calendar, filtered by label, while the query runs."""
    calendar = scratch_path(spark, "calendar")
    tables.calendar_table(spark, LATER).write.parquet(calendar)
    chosen = spark.read.parquet(calendar).where(F.col("label") == "b_after")
    saved = tables.load_posts(spark, _saved_months(spark, sf_dir))
    return tables.in_calendar(saved, chosen).select("post_id", "yyyy", "mm")


@query("s05_verify_saved", f"""WITH {sql.POSTS}, {sql.COMMENTS.removeprefix(sql.RATIOS + ", ")}
SELECT 'posts' AS "table", count(*) AS rows FROM posts WHERE lower(subreddit) IN {TOPIC}
UNION ALL SELECT 'comments', count(*) FROM comments WHERE lower(subreddit) IN {TOPIC}""")
def verify_saved(spark, sf_dir):
    return tables.verify_saved(spark, {
        "posts": _saved_posts(spark, sf_dir, topic=True), "comments": _saved_comments(spark, sf_dir, topic=True)})


@query("s06_result_csv", f"WITH {sql.POSTS} SELECT subreddit, count(*) AS post_count FROM posts GROUP BY subreddit")
def result_csv(spark, sf_dir):
    volume = reactions.forum_volume(fixtures.posts(spark, sf_dir))
    path = tables.save_result_csv(volume, scratch_path(spark, "volume"), [F.desc("post_count"), "subreddit"])
    return spark.read.schema("subreddit string, post_count long").option("header", True).csv(path)


NULLABLE = "CAST(true AS BOOLEAN)"  # columns read from files may lack values


@query("s07_schema_report", f"WITH {sql.POSTS} " + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS data_type, "
    f"{NULLABLE} AS nullable" for i, f in enumerate(POSTS_SCHEMA.fields)))
def schema_report(spark, sf_dir):
    return tables.schema_report(fixtures.posts(spark, sf_dir))


@query("s07_null_counts", f"WITH {sql.POSTS} " + " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS position, '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS data_type, "
    f"{NULLABLE} AS nullable, count(*) FILTER (WHERE {f.name} IS NULL) AS null_rows FROM posts"
    for i, f in enumerate(POSTS_SCHEMA.fields)))
def null_counts(spark, sf_dir):
    return tables.schema_report(fixtures.posts(spark, sf_dir), count_nulls=True)


@query("s08_partition_coverage_posts", f"WITH {sql.POSTS} SELECT DISTINCT yyyy, mm FROM posts")
def coverage_posts(spark, sf_dir):
    return tables.partition_coverage(fixtures.posts(spark, sf_dir))


@query("s08_partition_coverage_comments", f"WITH {sql.COMMENTS} SELECT DISTINCT yyyy, mm FROM comments")
def coverage_comments(spark, sf_dir):
    return tables.partition_coverage(fixtures.comments(spark, sf_dir))


@query("s09_preview", f"""WITH {sql.POSTS} SELECT post_id, subreddit, title, score, num_comments, author_id, yyyy, mm
FROM posts ORDER BY post_id LIMIT 5""")
def preview(spark, sf_dir):
    columns = ["subreddit", "title", "score", "num_comments", "author_id", "yyyy", "mm"]
    return tables.preview(fixtures.posts(spark, sf_dir), columns, "post_id")


@query("p01_projection", f"WITH {sql.POSTS} SELECT title, subreddit, score, num_comments FROM posts")
def projection(spark, sf_dir):
    return fixtures.posts(spark, sf_dir).select("title", "subreddit", "score", "num_comments")


@query("p02_constant_tag", f"{sql.TAGGED_POSTS} SELECT {sql.ENGAGEMENT}, 'alpha' AS player FROM tagged WHERE mentions_alpha")
def constant_tag(spark, sf_dir):
    return reactions.engagement_of(tagged_posts(spark, sf_dir), ENTITIES[0])


@query("p03_flags_to_int", f"{sql.TAGGED_POSTS} SELECT post_id, "
       + ", ".join(f"CAST({f} AS INTEGER) AS {f}" for f in FLAGS) + " FROM tagged")
def flags_to_int(spark, sf_dir):
    return features.flags_to_int(tagged_posts(spark, sf_dir).select("post_id", *FLAGS), ENTITIES)


@query("p04_time_features", f"{sql.TAGGED_POSTS} SELECT {PARTS} FROM tagged")
def time_features(spark, sf_dir):
    return features.add_time_features(fixtures.posts(spark, sf_dir)).select(*PARTS.split(", "))


@query("p05_event_period", f"{sql.TAGGED_POSTS} SELECT post_id, event_period FROM tagged")
def event_period(spark, sf_dir):
    return features.label_event_period(fixtures.posts(spark, sf_dir), CALENDAR).select("post_id", "event_period")


@query("p06_entity_flags_posts", f"{sql.TAGGED_POSTS} SELECT post_id, {FLAG_LIST}, mentions_any FROM tagged")
def entity_flags_posts(spark, sf_dir):
    return features.add_mentions(fixtures.posts(spark, sf_dir), "title", ENTITIES).select(
        "post_id", *FLAGS, features.ANY_FLAG)


@query("p06_entity_flags_comments", f"{sql.TAGGED_COMMENTS} SELECT comment_id, {FLAG_LIST}, mentions_any FROM tagged")
def entity_flags_comments(spark, sf_dir):
    return features.add_mentions(fixtures.comments(spark, sf_dir), "body", ENTITIES).select(
        "comment_id", *FLAGS, features.ANY_FLAG)


def _dictionary_mentions(spark, sf_dir):
    return mentions.mention_rows(fixtures.posts(spark, sf_dir), "post_id", "title", fixtures.entity_terms(spark, sf_dir))


@query("p06_dictionary_mentions", f"WITH {sql.POSTS}, {sql.DICTIONARY_MENTIONS} SELECT post_id, entity FROM mentioned")
def dictionary_mentions(spark, sf_dir):
    return _dictionary_mentions(spark, sf_dir)


@query("a03_dictionary_totals", f"WITH {sql.POSTS}, {sql.DICTIONARY_MENTIONS} SELECT entity, count(*) AS mentions FROM mentioned GROUP BY entity")
def dictionary_totals(spark, sf_dir):
    return mentions.mention_totals(_dictionary_mentions(spark, sf_dir))


@query("p06_dictionary_flags", f"{sql.TAGGED_POSTS} SELECT post_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {e.flag} THEN '{e.name}' END" for e in ENTITIES) + "], lambda x: x IS NOT NULL), ',') AS entities FROM tagged")
def dictionary_flags(spark, sf_dir):
    """The flags of a short list of entities, found by the dictionary."""
    posts = fixtures.posts(spark, sf_dir)
    rows = mentions.mention_rows(posts, "post_id", "title", mentions.term_table(spark, ENTITIES))
    return mentions.with_entities(posts.select("post_id"), "post_id", rows).select(
        "post_id", F.array_join("entities", ",").alias("entities"))


@query("p07_threshold_label", f"""WITH {sql.POSTS}
SELECT post_id, CAST(score >= 50 AS INTEGER) AS high_engagement FROM posts""")
def threshold_label(spark, sf_dir):
    return features.threshold_label(fixtures.posts(spark, sf_dir), "score", 50, models.LABEL).select(
        "post_id", models.LABEL)


@query("p08_month_start", f"{sql.TAGGED_POSTS} SELECT post_id, make_date(year_num, month_num, 1) AS date FROM tagged")
def month_start(spark, sf_dir):
    timed = features.add_time_features(fixtures.posts(spark, sf_dir))
    return timed.select("post_id", features.month_start().alias("date"))


@query("p09_period_order", f"""{sql.TAGGED_POSTS} SELECT DISTINCT event_period, {sql.period_order()} AS "order" FROM tagged""")
def period_order(spark, sf_dir):
    labelled = features.label_event_period(fixtures.posts(spark, sf_dir), CALENDAR)
    return labelled.select("event_period", features.period_position(CALENDAR).alias("order")).distinct().orderBy("order")


@query("f01_topic_filter", f"WITH {sql.POSTS} SELECT post_id, subreddit FROM posts WHERE lower(subreddit) IN {TOPIC}")
def topic_filter(spark, sf_dir):
    return features.filter_topic(fixtures.posts(spark, sf_dir), fixtures.TOPIC).select("post_id", "subreddit")


@query("f01_topic_filter_table", f"""WITH {sql.POSTS} SELECT post_id, subreddit FROM posts WHERE subreddit IN (
  SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def topic_filter_table(spark, sf_dir):
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1")
    forums = spark.read.parquet(f"{sf_dir}/documents.parquet").join(toxic, "doc_id").select(
        F.upper("source").alias("forum"))
    return features.filter_topic_by_table(fixtures.posts(spark, sf_dir), forums).select("post_id", "subreddit")


@query("f02_partition_predicate", f"WITH {sql.POSTS} SELECT post_id, yyyy, mm FROM posts WHERE yyyy = 2024 AND mm = 1")
def partition_predicate(spark, sf_dir):
    path = _saved_posts(spark, sf_dir)
    return tables.load_posts(spark, path, periods=CALENDAR).select("post_id", "yyyy", "mm")


@query("f03_discover_forums", f"""WITH {sql.POSTS} SELECT subreddit, count(*) AS post_count FROM posts
WHERE regexp_matches(subreddit, '(?i)({"|".join(fixtures.KEYWORDS)})') GROUP BY subreddit""")
def discover_forums(spark, sf_dir):
    return features.discover_forums(fixtures.posts(spark, sf_dir), fixtures.KEYWORDS)


@query("f04_flag_filter", f"{sql.TAGGED_POSTS} SELECT post_id, subreddit, score FROM tagged WHERE mentions_any")
def flag_filter(spark, sf_dir):
    return tagged_posts(spark, sf_dir).where(features.ANY_FLAG).select("post_id", "subreddit", "score")


@query("f05_event_window_posts", f"""{sql.TAGGED_POSTS} SELECT post_id, created_dt, event_period FROM tagged
WHERE {sql.covers('created_dt', EVENT_A)}""")
def event_window_posts(spark, sf_dir):
    return features.in_window(tagged_posts(spark, sf_dir), EVENT_A).select("post_id", "created_dt", "event_period")


@query("f05_event_window_comments", f"""{sql.TAGGED_COMMENTS} SELECT comment_id, created_dt, event_period FROM tagged
WHERE {sql.covers('created_dt', EVENT_A)}""")
def event_window_comments(spark, sf_dir):
    return features.in_window(tagged_comments(spark, sf_dir), EVENT_A).select("comment_id", "created_dt", "event_period")


@query("f06_label_equals", f"{sql.TAGGED_POSTS} SELECT post_id, title, score FROM tagged WHERE event_period = 'b_after'")
def label_equals(spark, sf_dir):
    return tagged_posts(spark, sf_dir).where(F.col("event_period") == "b_after").select("post_id", "title", "score")


@query("f07_label_in", f"""{sql.TAGGED_POSTS} SELECT post_id, event_period FROM tagged
WHERE event_period IN ('a_after', 'season', 'b_after')""")
def label_in(spark, sf_dir):
    return tagged_posts(spark, sf_dir).where(F.col("event_period").isin("a_after", "season", "b_after")).select(
        "post_id", "event_period")


@query("f08_text_present", f"WITH {sql.COMMENTS} SELECT comment_id, body FROM comments WHERE body IS NOT NULL")
def text_present(spark, sf_dir):
    return fixtures.comments(spark, sf_dir).select("comment_id", "body").where(F.col("body").isNotNull())


@query("f09_complete_rows", """SELECT doc_id, quality, toxic, source FROM documents LEFT JOIN labels USING (doc_id)
WHERE quality IS NOT NULL AND toxic IS NOT NULL AND source IS NOT NULL""")
def complete_rows(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return documents.join(labels, "doc_id", "left").dropna().select("doc_id", "quality", "toxic", "source")


@query("f10_having", f"""{sql.TAGGED_POSTS} SELECT subreddit, count(*) AS posts, round(avg(score), 6) AS avg_score,
round(avg(num_comments), 6) AS avg_comments FROM tagged WHERE mentions_any GROUP BY subreddit HAVING count(*) >= 20""")
def having(spark, sf_dir):
    mentioned = tagged_posts(spark, sf_dir).where(features.ANY_FLAG)
    return rounded(mentioned.groupBy("subreddit").agg(*reactions.engagement_measures()).where(F.col("posts") >= 20))
