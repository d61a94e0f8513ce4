"""Sentiment, keywords and topics."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from murmur.functions.words import ENGLISH_STOP_WORDS
from murmur.operators import keywords, sentiment, topics
from murmur.operators.features import period_position
from murmur.plans import sql
from murmur.plans.base import (
    CALENDAR,
    ENTITIES,
    query,
    rounded,
    scored_comments,
    scored_posts,
    tagged_comments,
    tagged_posts,
)
from murmur.sources import fixtures

STOP_WORDS = [*ENGLISH_STOP_WORDS, *fixtures.STOP_WORDS]
LABELS = sql.listed(CALENDAR.labels)
EVENTS = sql.listed(fixtures.HEAD_TO_HEAD)
EVENT = sql.event_name(fixtures.HEAD_TO_HEAD)
AVERAGE = "count(*) AS posts, round(avg(sentiment), 6) AS avg_sentiment"


@query("n01_sentiment_posts", f"{sql.SCORED_POSTS} SELECT post_id, sentiment FROM scored")
def sentiment_posts(spark, sf_dir):
    return scored_posts(spark, sf_dir).select("post_id", "sentiment")


@query("n01_sentiment_comments", f"{sql.SCORED_COMMENTS} SELECT comment_id, sentiment FROM scored")
def sentiment_comments(spark, sf_dir):
    return scored_comments(spark, sf_dir).select("comment_id", "sentiment")


BY_PERIOD = f"""SELECT event_period, {AVERAGE}, {sql.period_order()} AS "order" FROM scored
WHERE event_period IN {LABELS} GROUP BY event_period"""


@query("a10_sentiment_by_period", f"{sql.SCORED_POSTS} {BY_PERIOD}")
def sentiment_by_period(spark, sf_dir):
    return rounded(sentiment.sentiment_by_period(scored_posts(spark, sf_dir), CALENDAR))


@query("x07_comment_sentiment_by_period", f"{sql.SCORED_COMMENTS} {BY_PERIOD}")
def comment_sentiment_by_period(spark, sf_dir):
    return rounded(sentiment.sentiment_by_period(scored_comments(spark, sf_dir), CALENDAR))


SCORED_ENTITIES = sql.ENTITY_ROWS.replace("FROM tagged", "FROM scored")


@query("a11_sentiment_by_entity",
       f"{sql.SCORED_POSTS}, {SCORED_ENTITIES} SELECT player, {AVERAGE} FROM entity_rows GROUP BY player")
def sentiment_by_entity(spark, sf_dir):
    return rounded(sentiment.sentiment_by_entity(scored_posts(spark, sf_dir), ENTITIES))


@query("x06_sentiment_shift", f"""{sql.SCORED_POSTS}, {SCORED_ENTITIES}, averages AS (
  SELECT player, event_period, count(*) AS posts, avg(sentiment) AS a, {sql.period_order()} AS "order" FROM entity_rows
  WHERE event_period IN {LABELS} GROUP BY player, event_period)
SELECT player, event_period, posts, round(a, 6) AS avg_sentiment, "order",
       round(a - lag(a) OVER (PARTITION BY player ORDER BY "order"), 6) AS shift FROM averages""")
def sentiment_shift(spark, sf_dir):
    return rounded(sentiment.sentiment_shift(scored_posts(spark, sf_dir), ENTITIES, CALENDAR))


@query("n02_sentiment_histogram", f"""{sql.SCORED_POSTS}, counts AS (
  SELECT {EVENT} AS event, CAST(floor((sentiment + 1) / CAST(0.1 AS DOUBLE)) AS BIGINT) AS bucket, count(*) AS posts
  FROM scored WHERE event_period IN {EVENTS} GROUP BY ALL)
SELECT event, bucket, posts, round(bucket * CAST(0.1 AS DOUBLE) - 1, 6) AS bucket_start,
       round(posts / (sum(posts) OVER (PARTITION BY event) * CAST(0.1 AS DOUBLE)), 6) AS density FROM counts""")
def sentiment_histogram(spark, sf_dir):
    return rounded(sentiment.sentiment_histogram(scored_posts(spark, sf_dir), fixtures.HEAD_TO_HEAD))


@query("n02_sentiment_density", f"""{sql.SCORED_POSTS}, rows AS (
  SELECT {EVENT} AS event, sentiment AS s FROM scored WHERE event_period IN {EVENTS}),
bands AS (SELECT event, count(*) AS n, stddev_samp(s) * pow(count(*), -0.2) AS h FROM rows GROUP BY event),
grid AS (SELECT CAST(i AS INTEGER) AS point, CAST(i AS DOUBLE) * CAST(2.0 AS DOUBLE) / 80 - 1 AS x FROM range(81) t(i))
SELECT event, point, round(x, 6) AS x, round(sum(k) / n, 6) AS density,
       round(sum(k) / (SELECT sum(n) FROM bands), 6) AS joint_density
FROM (SELECT event, point, x, n, CASE WHEN h > 0 THEN exp(-0.5 * pow((x - s) / h, 2)) / (h * sqrt(2 * pi())) END AS k
      FROM rows JOIN bands USING (event) CROSS JOIN grid)
GROUP BY event, point, x, n""")
def sentiment_density(spark, sf_dir):
    return rounded(sentiment.sentiment_density(scored_posts(spark, sf_dir), fixtures.HEAD_TO_HEAD))


def _period_terms(spark: SparkSession, sf_dir: str):
    return keywords.term_counts(tagged_posts(spark, sf_dir), "title", keywords.period_groups(CALENDAR))


def _leading_period_terms(spark: SparkSession, sf_dir: str):
    return keywords.leading_term_counts(tagged_posts(spark, sf_dir), "title", keywords.period_groups(CALENDAR))


def _entity_terms(spark: SparkSession, sf_dir: str):
    return keywords.leading_term_counts(tagged_posts(spark, sf_dir), "title", keywords.entity_groups(ENTITIES))


@query("n03_period_terms", f"""{sql.TAGGED_POSTS}, {sql.terms(sql.PERIOD_GROUPS)} SELECT term, {", ".join(
    f"CAST(coalesce(sum(tf) FILTER (WHERE grp = '{g}'), 0) AS BIGINT) AS {g}" for g in CALENDAR.labels)}
FROM counts GROUP BY term""")
def period_terms(spark, sf_dir):
    return _period_terms(spark, sf_dir)


@query("n04_tfidf_by_period", f"""{sql.TAGGED_POSTS}, {sql.terms(sql.PERIOD_GROUPS)}
SELECT "group", term, tf, CAST(df AS INTEGER) AS df, round(tfidf, 6) AS tfidf FROM tfidf""")
def tfidf_by_period(spark, sf_dir):
    return rounded(keywords.tfidf(_leading_period_terms(spark, sf_dir)))


@query("n05_top_keywords", f"{sql.TAGGED_POSTS}, {sql.terms(sql.PERIOD_GROUPS)} {sql.TOP_KEYWORDS}")
def top_keywords(spark, sf_dir):
    return keywords.top_keywords(keywords.tfidf(_leading_period_terms(spark, sf_dir)))


@query("x03_top_keywords_by_entity", f"{sql.TAGGED_POSTS}, {sql.terms(sql.ENTITY_GROUPS)} {sql.TOP_KEYWORDS}")
def top_keywords_by_entity(spark, sf_dir):
    return keywords.top_keywords(keywords.tfidf(_entity_terms(spark, sf_dir)))


def _tokens(spark: SparkSession, sf_dir: str):
    return topics.tokenise(fixtures.comments(spark, sf_dir), "body", "comment_id", stop_words=STOP_WORDS)


@query("n06_tokens", f"""WITH {sql.COMMENTS}, {sql.TOKENS}
SELECT comment_id, array_to_string(tokens, ' ') AS tokens FROM tokens""")
def tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("comment_id", F.array_join("tokens", " ").alias("tokens"))


@query("n06_token_counts", f"WITH {sql.COMMENTS}, {sql.TOKENS} SELECT comment_id, len(tokens) AS tokens FROM tokens")
def token_counts(spark, sf_dir):
    return _tokens(spark, sf_dir).select("comment_id", F.size("tokens").cast("long").alias("tokens"))


@query("n07_vocabulary", f"""WITH {sql.COMMENTS}, {sql.TOKENS} SELECT term, tf, df FROM token_counts
WHERE df >= 5 ORDER BY tf DESC, term LIMIT 3000""")
def vocabulary(spark, sf_dir):
    return topics.vocabulary_table(_tokens(spark, sf_dir))


_fitted: dict[tuple[str, str], topics.TopicModel] = {}


def forget() -> None:
    """Drop fitted topics."""
    _fitted.clear()


def _topics(spark: SparkSession, sf_dir: str) -> topics.TopicModel:
    """One fit per session and data set, shared by the queries that read the model until ``forget``."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _fitted:
        _fitted[at] = topics.fit_topics(
            tagged_comments(spark, sf_dir), "body", "comment_id", keep=["event_period"], stop_words=STOP_WORDS)
    return _fitted[at]


@query("n07_count_vectors")
def count_vectors(spark, sf_dir):
    return _topics(spark, sf_dir).texts.select("comment_id", F.col("features").cast("string").alias("features"))


CELLS = f"""{sql.TOKENS}, vocabulary AS (
  SELECT term, CAST(row_number() OVER (ORDER BY tf DESC, term) - 1 AS INTEGER) AS slot FROM token_counts WHERE df >= 5
  QUALIFY row_number() OVER (ORDER BY tf DESC, term) <= 3000),
cells AS (SELECT comment_id, slot, CAST(count(*) AS DOUBLE) AS n
  FROM (SELECT comment_id, unnest(tokens) AS term FROM tokens) JOIN vocabulary USING (term) GROUP BY comment_id, slot)"""
VOCABULARY = f"WITH {sql.COMMENTS}, {CELLS}"


@query("n07_vector_cells", f"{VOCABULARY} SELECT comment_id, slot, n FROM cells")
def vector_cells(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    cells = _topics(spark, sf_dir).texts.select("comment_id", F.posexplode(vector_to_array("features")).alias("slot", "n"))
    return cells.where("n > 0")


@query("n08_fit_beats_chance", f"{VOCABULARY} SELECT count(DISTINCT comment_id) AS texts, true AS better FROM cells")
def fit_beats_chance(spark, sf_dir):
    """Whether the fitted topics explain the words better than a vocabulary of equal words."""
    from pyspark.ml.functions import vector_to_array
    fitted = _topics(spark, sf_dir)
    words = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, b: a + b)
    sizes = fitted.texts.agg(F.count_if(words > 0).alias("texts"), F.sum(words).alias("words"))
    chance = F.col("words") * F.lit(-math.log(len(fitted.vocabulary)))
    return sizes.select("texts", (F.lit(float(fitted.model.logLikelihood(fitted.texts))) > chance).alias("better"))


@query("n09_perplexity_of_likelihood", f"{VOCABULARY} SELECT CAST(sum(n) AS BIGINT) AS words, true AS agrees FROM cells")
def perplexity_of_likelihood(spark, sf_dir):
    """The number of words that the likelihood and the perplexity reported imply, and whether that perplexity is the one
    that Spark's own evaluation gives."""
    fitted = _topics(spark, sf_dir)
    value = {r.metric: r.value for r in fitted.quality().collect()}
    own = fitted.model.logPerplexity(fitted.texts)
    return fitted.texts.groupBy().agg(
        F.lit(round(-value["log_likelihood"] / value["log_perplexity"])).cast("long").alias("words"),
        F.lit(abs(own - value["log_perplexity"]) < 1e-6 * abs(own)).alias("agrees"))


#: Two topics of five words each; a comment speaks of one, by its id, and how often each word comes depends on the id too.
PLANTED_WORDS = (("anchor", "bridge", "castle", "desert", "engine"), ("violin", "window", "yellow", "zephyr", "walnut"))


def _planted_topics(spark: SparkSession, sf_dir: str) -> topics.TopicModel:
    at = (spark.sparkContext.applicationId, f"planted {sf_dir}")
    if at not in _fitted:
        side = lambda words: F.array_join(F.flatten(F.array(*(
            F.array_repeat(F.lit(w), (1 + F.pmod(F.col("comment_id") * (i + 3), F.lit(4))).cast("int")) for i, w in enumerate(words)))), " ")
        planted = fixtures.comments(spark, sf_dir).select(
            "comment_id", F.when(F.col("comment_id") % 2 == 0, side(PLANTED_WORDS[0])).otherwise(side(PLANTED_WORDS[1])).alias("body"))
        _fitted[at] = topics.fit_topics(planted, "body", "comment_id", k=2, stop_words=[])
    return _fitted[at]


@query("n08_planted_topics", f"""WITH {sql.COMMENTS} SELECT comment_id, true AS own_side,
  count(*) OVER (PARTITION BY comment_id % 2) AS alike FROM comments""")
def planted_topics(spark, sf_dir):
    """Topics fitted on comments of two known kinds: how many share each one's leading topic, and whether it is that of its kind."""
    from pyspark.ml.functions import vector_to_array
    weights = vector_to_array("topic_dist")
    found = _planted_topics(spark, sf_dir).mixtures().select(
        "comment_id", (F.array_position(weights, F.array_max(weights)) - 1).alias("topic"))
    kinds = found.groupBy("topic").agg(F.count("*").alias("alike"), F.min(F.col("comment_id") % 2).alias("low"), F.max(F.col("comment_id") % 2).alias("high"))
    return found.join(F.broadcast(kinds), "topic").select("comment_id", (F.col("low") == F.col("high")).alias("own_side"), "alike")


@query("n10_planted_words", f"""WITH {sql.COMMENTS}, words(side, word) AS (VALUES {", ".join(f"({i}, '{w}')" for i, ws in enumerate(PLANTED_WORDS) for w in ws)})
SELECT string_agg(word, ' ' ORDER BY word) AS words FROM words WHERE side IN (SELECT comment_id % 2 FROM comments) GROUP BY side""")
def planted_words(spark, sf_dir):
    """The five leading words of each topic fitted on the planted comments, in alphabetical order."""
    leading = _planted_topics(spark, sf_dir).topic_words(5)
    return leading.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list("word")), " ").alias("words")).select("words")


@query("n10_weights_ordered", f"""{VOCABULARY}, slots AS (SELECT least(count(*), 10) AS n FROM vocabulary)
SELECT CAST(t AS INTEGER) AS topic, n AS words, true AS ordered, true AS known FROM slots, range(6) r(t)""")
def weights_ordered(spark, sf_dir):
    fitted = _topics(spark, sf_dir)
    words = fitted.topic_words().withColumn("later", F.lead("weight").over(Window.partitionBy("topic").orderBy("position")))
    return words.groupBy("topic").agg(
        F.count("*").alias("words"), F.min(F.coalesce(F.col("weight") >= F.col("later"), F.lit(True))).alias("ordered"),
        F.min(F.array_contains(F.lit(fitted.vocabulary), F.col("word"))).alias("known"))


@query("n11_mixtures_sum_to_one", f"""{VOCABULARY} SELECT comment_id, comment_id IN (SELECT comment_id FROM cells) AS whole
FROM tokens""")
def mixtures_sum_to_one(spark, sf_dir):
    """A text's weights sum to one if it has a vocabulary word, else to nothing."""
    from pyspark.ml.functions import vector_to_array
    total = F.aggregate(vector_to_array("topic_dist"), F.lit(0.0), lambda a, b: a + b)
    return _topics(spark, sf_dir).mixtures().select("comment_id", (F.abs(total - 1) < 1e-9).alias("whole"))


@query("x04_texts_by_period", f"""{sql.TAGGED_COMMENTS}, {CELLS}
SELECT event_period, CAST(t AS INTEGER) AS topic, count(*) AS texts FROM tagged, range(6) r(t)
WHERE comment_id IN (SELECT comment_id FROM cells) GROUP BY event_period, t""")
def texts_by_period(spark, sf_dir):
    return topics.topic_mix(_topics(spark, sf_dir).mixtures()).select("event_period", "topic", "texts")


@query("n08_topic_fit")
def topic_fit(spark, sf_dir):
    fitted = _topics(spark, sf_dir)
    sizes = fitted.texts.agg(F.count("*").alias("texts"))
    return sizes.select("texts", F.lit(fitted.model.vocabSize()).alias("vocabulary"))


@query("n09_topic_quality")
def topic_quality(spark, sf_dir):
    return _topics(spark, sf_dir).quality()


@query("n10_topic_words")
def topic_words(spark, sf_dir):
    return _topics(spark, sf_dir).topic_words()


@query("n11_topic_mixtures")
def topic_mixtures(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array
    return _topics(spark, sf_dir).mixtures().select("comment_id", vector_to_array("topic_dist").alias("topic_dist"))


@query("x04_topic_mix_by_period")
def topic_mix_by_period(spark, sf_dir):
    mix = topics.topic_mix(_topics(spark, sf_dir).mixtures())
    return rounded(mix.withColumn("order", period_position(CALENDAR)).orderBy("order", "topic"))
