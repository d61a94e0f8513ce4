"""The study's two jobs, word lists and lexicon files."""

import csv
import glob

import pytest
from murmur import presets, study
from murmur.functions.words import read_word_list
from murmur.operators import features, models, sentiment
from murmur.sources import tables
from murmur.specs import COMMENTS_SCHEMA, POSTS_SCHEMA
from pyspark.sql import functions as F


def raw(spark, folder):
    """A raw dump as it comes: ids in base 36, other columns besides, forums in any case."""
    posts = spark.createDataFrame(
        [(f"a{i}", f, f"Dhoni, {i}\nsays \"hi\"", i, i, f"u{i}", 1_700_400_000 + 86_400 * i, 2023 + i % 2, 11, "x")
         for i, f in enumerate(["CRICKET", "ipl", "movies", "Cricket", None, "csk"])],
        "id string, subreddit string, title string, score int, num_comments int, author string, created_utc int, yyyy int, mm int, more string")
    comments = posts.select("id", "subreddit", F.col("title").alias("body"), "score", "author", "created_utc", "yyyy", "mm")
    for name, df in (("posts", posts), ("comments", comments)):
        df.write.partitionBy("yyyy", "mm").parquet(f"{folder}/{name}")
    return f"{folder}/posts", f"{folder}/comments"


@pytest.mark.parametrize("cluster", [False, True])
def test_filter_job_on_presets(spark, tmp_path, cluster):
    posts, comments = raw(spark, str(tmp_path))
    ids = {"author_id": F.xxhash64("author")}
    base36 = F.conv("id", 36, 10)
    done = study.filter_to_topic(
        spark, posts, comments, str(tmp_path / "out"), presets.CRICKET_STUDY.topic, post_columns={**ids, "post_id": base36},
        comment_columns={**ids, "comment_id": base36}, cluster=cluster)
    assert {tuple(r) for r in done.counts.collect()} == {("posts", 4), ("comments", 4)}
    assert [tuple(r) for r in done.volumes.where("table = 'posts'").orderBy(F.desc("rows"), "subreddit").collect()] == [
        ("posts", "CRICKET", 1), ("posts", "Cricket", 1), ("posts", "csk", 1), ("posts", "ipl", 1)]
    saved = spark.read.parquet(done.posts)
    tables.require_schema(saved, POSTS_SCHEMA)
    tables.require_schema(spark.read.parquet(done.comments), COMMENTS_SCHEMA)
    assert {r[0] for r in saved.select(features.FORUM_KEY).distinct().collect()} == {"cricket", "ipl", "csk"}
    only = study.filter_to_topic(
        spark, posts, comments, str(tmp_path / "year"), presets.CRICKET_STUDY.topic, years=[2024], months=[11],
        post_columns={**ids, "post_id": base36}, comment_columns={**ids, "comment_id": base36})
    assert {r.rows for r in only.counts.collect()} == {3}


def test_tables_are_written_in_order_with_quotes_and_line_breaks(spark, tmp_path):
    s = presets.CRICKET_STUDY
    at = int(s.calendar["wc2023_final_aftermath"].seconds()[0]) + 10
    posts = spark.createDataFrame(
        [(i, "Cricket", f'"{e.terms[0]}"\nline {i}', 10 * i, i, i, at, 2023, 11) for i, e in enumerate(list(s.entities) * 4)], POSTS_SCHEMA)
    tagged = features.tag(posts, "title", s.entities, s.calendar)
    lexicon = spark.createDataFrame([("line", 1.0)], "token string, valence double")
    scored = sentiment.score_sentiment(tagged, "title", lexicon, keep=["event_period", *(e.flag for e in s.entities), features.ANY_FLAG])
    found = study.result_tables(s, tagged, scored)
    assert len(found) == 10 and not any("model" in n for n in found)
    written = study.write_tables(found, str(tmp_path / "tables"))
    files = {name: glob.glob(f"{path}/*.csv") for name, path in written.items()}
    assert all(len(f) == 1 for f in files.values())
    with open(files["wc2023_top_aftermath_posts"][0], newline="") as file:
        rows = list(csv.DictReader(file, escapechar="\\"))
    assert [int(r["score"]) for r in rows] == [10 * i for i in range(11, 1, -1)]
    assert all("\n" in r["title"] for r in rows)


def test_word_lists(spark, tmp_path):
    file = tmp_path / "stop.txt"
    file.write_text("# a comment\nThe\n\n  of \nthe\nd'accord\n")
    assert read_word_list(spark, str(file)) == ["d'accord", "of", "the"]
    with pytest.raises(ValueError):
        read_word_list(spark, str(file), most=2)


def test_lexicon_files(spark, tmp_path):
    file = tmp_path / "lexicon.txt"
    file.write_text("$:\t-1.5\t0.80623\t[-1, -1]\n\"quoted\t2\n(-:\t1.6\t0.8\t[2, 1]\n\ngood\t1.9\n")
    assert sorted(tuple(r) for r in sentiment.read_lexicon(spark, str(file)).collect()) == [
        ('"quoted', 2.0), ("$:", -1.5), ("(-:", 1.6), ("good", 1.9)]
    scored = sentiment.score_sentiment(spark.createDataFrame([(1, "so good")], "post_id long, title string"), "title",
                                       sentiment.read_lexicon(spark, str(file)))
    assert scored.first()["sentiment"] > 0.4
    file.write_text("bad\tnumber\n")
    with pytest.raises(Exception, match="no valence in"):
        sentiment.read_lexicon(spark, str(file)).collect()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tagged_texts(spark):
    s = presets.CRICKET_STUDY
    at = int(s.calendar["wc2023_final_aftermath"].seconds()[0]) + 10
    texts = [None, "nothing", *(e.terms[0].upper() for e in s.entities)]
    posts = spark.createDataFrame([(i, "Cricket", t, i, i, i, at, 2023, 11) for i, t in enumerate(texts)], POSTS_SCHEMA)
    return s, features.tag(posts.repartition(2), "title", s.entities, s.calendar)


def test_result_tables_search_and_score_the_texts_once(spark):
    s, tagged = tagged_texts(spark)
    scored = sentiment.score_sentiment(tagged, "title", spark.createDataFrame([("nothing", 1.0)], "token string, valence double"),
                                       keep=["event_period", *(e.flag for e in s.entities), features.ANY_FLAG])
    found = study.result_tables(s, tagged, scored)
    assert not [name for name, df in found.items() if "RLIKE" in plan(df)]
    assert {r.player: r.posts for r in found["player_engagement"].collect()} == {e.name: 1 for e in s.entities}
    assert found["wc2023_mentions_by_period"].first()[1:] == (1,) * len(s.entities)
    assert found["wc2023_top_aftermath_posts"].count() == min(10, 2 + len(s.entities))
    assert found["sentiment_by_period"].first()["posts"] == 2 + len(s.entities)


def test_features_search_each_text_once(spark):
    s, tagged = tagged_texts(spark)
    table = models.feature_table(tagged, s.entities)
    assert plan(table).count("RLIKE") == len(s.entities)
    rows = {r.post_id: [r[e.flag] for e in s.entities] for r in table.collect()}
    assert rows == {1: [0] * len(s.entities), **{i + 2: [int(i == j) for j in range(len(s.entities))] for i in range(len(s.entities))}}
