"""Posts and comments derived from the generated test tables.

Every document becomes a post and every conversation turn a comment, with its
whole text. Score, author and time come from one event each; the events are
spread by a ratio so that the posts cover the whole month.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.clock import from_unix_seconds, to_unix_seconds
from murmur.functions.scale import spread
from murmur.functions.words import explode_terms, with_bigrams
from murmur.operators.sentiment import SentimentRules
from murmur.specs import COMMENTS_SCHEMA, POSTS_SCHEMA, WORD_CLASS, Calendar, EntityPattern, Period, TopicFilter

TURNS = 8
MONTH_SECONDS = 30 * 86_400

ENTITIES = [
    EntityPattern("alpha", ["from", "rewh"], home_forums=["SRC1", "src2"]),
    EntityPattern("beta", ["with", "this"], home_forums=["src3"]),
    EntityPattern("gamma", ["was", "are"], home_forums=["src5", "src7", "SRC9"]),
]
TEAM_TERMS = EntityPattern("team", ["und", "les", "los", "by"])

CALENDAR = Calendar([
    Period("a_build", datetime(2024, 1, 3), datetime(2024, 1, 10)),
    Period("a_after", datetime(2024, 1, 10), datetime(2024, 1, 13), end_inclusive=True),
    Period("season", datetime(2024, 1, 14), datetime(2024, 1, 20), end_inclusive=True),
    Period("b_build", datetime(2024, 1, 21), datetime(2024, 1, 25)),
    Period("b_after", datetime(2024, 1, 25), datetime(2024, 1, 28), end_inclusive=True),
])
HEAD_TO_HEAD = {"a_after": "Event A", "b_after": "Event B"}

TOPIC = TopicFilter(["SRC0", "src1", "Src2", "SRC3", "src4", "Src5", "SRC6", "src7", "Src8", "SRC9"])
KEYWORDS = ["rc1", "C7"]
STOP_WORDS = ["thth", "ther", "thre", "thha", "than", "thon"]

#: Valences for tokens that occur in the generated prose, plus a few English words.
LEXICON = {
    "rewh": 2.1, "orre": -1.7, "thatin": 1.3, "ononst": -2.4, "inoran": 0.9, "orantion": -0.8,
    "hehely": 3.1, "thanedble": 1.9, "eriner": -2.9, "no": -1.2, "elle": 1.1, "nicht": -1.5,
    "ción": 0.7, "avec": 1.6, "hash": -0.6, "hast": 0.4, "rest": 1.0, "ones": -0.3,
    "only": 0.5, "ontion": -1.1, "good": 1.9, "bad": -2.5, "great": 3.1, "sad": -2.1,
}

#: The standard rules, with a few frequent tokens standing in as modifiers so that
#: every rule has something to act on in the generated prose.
RULES = SentimentRules().extended(
    boosters=["the", "la", "der"],
    dampeners=["of", "de"],
    negations=["and", "und", "to"],
    contrast="but",
    idioms={"in rewh": 1.4, "that is": -0.9},
)


def _event_key(position: Column, ratio: DataFrame) -> Column:
    return position * ratio.scalar()


def _with_event(rows: DataFrame, events: DataFrame) -> DataFrame:
    joined = rows.join(events, "event_id")
    return joined.select(
        *rows.drop("event_id").columns,
        F.floor("value").cast("long").alias("score"),
        F.col("user_id").alias("author_id"),
        to_unix_seconds(F.col("ts")).alias("created_utc"),
        F.year("ts").alias("yyyy"),
        F.month("ts").alias("mm"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    total = documents.agg(F.count("*").alias("n"))
    ratio = events.agg(F.floor(F.count("*") / total.scalar()))
    rows = spread(documents, "doc_id").select(
        _event_key(F.col("doc_id"), ratio).alias("event_id"),
        F.col("doc_id").alias("post_id"),
        F.col("source").alias("subreddit"),
        F.col("text").alias("title"),
        (F.col("n_chars") % 200).alias("num_comments"),
    )
    return _with_event(rows, events).select(*POSTS_SCHEMA.fieldNames())


def posts_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts, each put off by up to five times thirty days by its id, so that they fall in several months."""
    moved = posts(spark, sf_dir).withColumn("created_utc", F.col("created_utc") + F.pmod("post_id", F.lit(6)) * MONTH_SECONDS)
    moment = from_unix_seconds(F.col("created_utc"))
    return moved.withColumns({"yyyy": F.year(moment), "mm": F.month(moment)}).select(*POSTS_SCHEMA.fieldNames())


def entity_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of entities as long as the texts make it: ``(entity, term)``.

    Terms are the documents' own words whose md5 begins with 0 or 1, each an entity of its own, and pairs of words in sequence
    whose md5 begins with 00 or 01, which name the entity of their first word.
    """
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = F.regexp_extract_all(F.lower("text"), F.lit(f"[{WORD_CLASS}]+"), F.lit(0))
    terms = explode_terms(texts.select(runs.alias("w")).select(with_bigrams("w").alias("terms")), "terms")
    digest = F.md5("term")
    bound = F.when(F.contains("term", F.lit(" ")), F.lit("02")).otherwise(F.lit("2"))
    kept = terms.where(digest < bound).distinct()
    return kept.select(F.substring_index("term", " ", 1).alias("entity"), "term")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    slots = turns.agg((TURNS * (F.max("conv_id") + 1)).alias("n"))
    ratio = events.agg(F.floor(F.count("*") / slots.scalar()))
    position = F.col("conv_id") * TURNS + F.col("turn")
    rows = spread(turns, "conv_id", "turn").select(
        _event_key(position, ratio).alias("event_id"),
        position.alias("comment_id"),
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("subreddit"),
        F.col("text").alias("body"),
    )
    return _with_event(rows, events).select(*COMMENTS_SCHEMA.fieldNames())
