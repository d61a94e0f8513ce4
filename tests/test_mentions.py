"""Mentions from a dictionary against the regex of each entity."""

import re

import pytest
from murmur.functions import scale
from murmur.operators import features, mentions
from murmur.specs import EntityPattern
from pyspark.sql import functions as F

ENTITIES = [
    EntityPattern("king", ["King Kohli", "virat"]), EntityPattern("captain", ["captain cool", "captain"]),
    EntityPattern("plus", ["c++", "++"]), EntityPattern("dot", [".net", "'quoted word'"]), EntityPattern("accent", ["élan", "über-x"]),
    EntityPattern("long", ["the quick brown fox jumps"]), EntityPattern("same", ["captain cool"]), EntityPattern("none", ["zzz"]),
    EntityPattern("space", [" lead", "trail "]), EntityPattern("lines", ["a\nb"]),
]
TEXTS = [
    None, "", " ", "king kohli", "KING KOHLI!", "king  kohli", "viking kohli", "king kohlis", "xvirat", "virat", "(virat)", "virat_2",
    "captain cool", "captain, cool", "the captain", "captains cool", "c++", "c++11", "objc++", "a c++ b", "x++", "++", "+++", "++ y", "asp.net", ".net", " .net core",
    "say 'quoted word' now", "'quoted word's", "ELAN élan", "élan vital", "mélan", "über-x", "über-xy", "the quick brown fox jumps",
    "the quick brown fox", "the the quick brown fox jumps over", " lead", "x lead", "x leads", "trail ", "trail", "trail  x", "trail x", "a\nb", "a b",
    "captain " * 3000 + "cool virat", "𝄞virat𝄞", "kıng kohli",
]


def expected(entities, texts):
    out = set()
    for i, t in enumerate(texts):
        for e in entities:
            for term in e.terms:
                w = r"[^\W]"
                if t is not None and re.search(f"(?<!{w}){re.escape(term.lower())}(?!{w})", t.lower()):
                    out.add((i, e.name))
    return out


@pytest.mark.parametrize("bound", [scale.BROADCAST_ROWS, 0])
def test_rows_equal_the_regex(spark, monkeypatch, bound):
    monkeypatch.setattr(mentions, "broadcast_if_small", lambda df: scale.broadcast_if_small(df, max_rows=bound))
    df = spark.createDataFrame(list(enumerate(TEXTS)), "post_id long, title string")
    got = mentions.mention_rows(df, "post_id", "title", mentions.term_table(spark, ENTITIES)).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == expected(ENTITIES, TEXTS)


def test_rows_equal_the_flags(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "post_id long, title string")
    flags = features.add_mentions(df, "title", ENTITIES)
    want = {(r["post_id"], e.name) for r in flags.collect() for e in ENTITIES if r[e.flag]}
    rows = mentions.mention_rows(df, "post_id", "title", mentions.term_table(spark, ENTITIES))
    assert {tuple(r) for r in rows.collect()} == want
    totals = {r["entity"]: r["mentions"] for r in mentions.mention_totals(rows).collect()}
    assert totals == {n: sum(1 for _, e in want if e == n) for n in {e for _, e in want}}
    listed = mentions.with_entities(df.withColumn("entity", F.lit("clash")), "post_id", rows).collect()
    assert {r["post_id"]: r["entities"] for r in listed} == {i: sorted(e for k, e in want if k == i) for i in range(len(TEXTS))}


def test_odd_dictionaries(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "post_id long, title string")
    odd = spark.createDataFrame([("x", None), ("y", ""), (None, "a"), ("z", "A"), ("z", "a"), ("z", "b")], "entity string, term string")
    assert [tuple(r) for r in mentions.mention_rows(df, "post_id", "title", odd).collect()] == [(1, "z")]
    assert mentions.mention_rows(df, "post_id", "title", odd.limit(0)).collect() == []
    assert mentions.mention_rows(df.limit(0), "post_id", "title", odd).collect() == []
    renamed = odd.select(F.col("entity").alias("who"), F.col("term").alias("what"))
    assert mentions.mention_rows(df, "post_id", "title", renamed, "who", "what").count() == 1


def test_a_word_that_begins_many_terms_is_tried_once_for_each_length(spark):
    terms = spark.range(3000).select(F.col("id").cast("string").alias("entity"), F.concat(F.lit("the w"), F.col("id")).alias("term"))
    df = spark.range(50).select(F.col("id").alias("post_id"), F.concat(F.lit("the the w"), F.col("id"), F.lit(" " + "the " * 200)).alias("title"))
    rows = mentions.mention_rows(df, "post_id", "title", terms)
    assert sorted(tuple(r) for r in rows.collect()) == [(i, str(i)) for i in range(50)]


def test_words_are_not_shuffled_to_a_dictionary_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(mentions, "broadcast_if_small", lambda df: df)
    df = spark.range(300).select(F.col("id").alias("post_id"), F.concat(F.lit("the w"), F.col("id"), F.lit(" the" * 50 + " x")).alias("title"))
    terms = spark.range(100).select(F.concat(F.lit("e"), "id").alias("entity"), F.concat(F.lit("the w"), F.col("id")).alias("term"))
    rows = mentions.mention_rows(df, "post_id", "title", terms)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_anchor" not in plan
    assert sorted(tuple(r) for r in rows.collect()) == sorted((i, f"e{i}") for i in range(100))
    assert mentions.mention_rows(df, "post_id", "title", terms.limit(0)).collect() == []


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(mentions, "SIEVE_BITS", 64)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "post_id long, title string")
    got = mentions.mention_rows(df, "post_id", "title", mentions.term_table(spark, ENTITIES)).collect()
    assert {tuple(r) for r in got} == expected(ENTITIES, TEXTS)
