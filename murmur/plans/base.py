"""The catalogue of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.operators import features, sentiment
from murmur.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ENTITIES = fixtures.ENTITIES
CALENDAR = fixtures.CALENDAR
FLAGS = [e.flag for e in ENTITIES]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its twin where SQL can express it."""
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of places: sums in another order differ in the last digits."""
    def shown(field: T.StructField) -> Column:
        column = F.col(f"`{field.name}`")
        return F.round(column, digits).alias(field.name) if isinstance(field.dataType, T.DoubleType) else column
    return df.select(*(shown(f) for f in df.schema.fields))


def tagged_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.tag(fixtures.posts(spark, sf_dir), "title", ENTITIES, CALENDAR)


def tagged_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.tag(fixtures.comments(spark, sf_dir), "body", ENTITIES, CALENDAR)


def _scored(tagged: DataFrame, text_col: str, key: str) -> DataFrame:
    lexicon = sentiment.lexicon_table(tagged.sparkSession, fixtures.LEXICON)
    keep = ["event_period", *FLAGS, features.ANY_FLAG]
    return sentiment.score_sentiment(tagged, text_col, lexicon, fixtures.RULES, key, keep)


def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(tagged_posts(spark, sf_dir), "title", "post_id")


def scored_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(tagged_comments(spark, sf_dir), "body", "comment_id")
