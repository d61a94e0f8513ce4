"""Aggregates, keywords, models and plans beyond what the SQL twins cover."""

import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.functions import variational
from murmur.functions.scale import scratch_path
from murmur.functions.words import ENGLISH_STOP_WORDS, blank_separated, explode_terms, with_bigrams, word_runs
from murmur.operators import features, keywords, models, reactions, sentiment, topics
from murmur.plans.base import CALENDAR, ENTITIES, scored_posts, tagged_comments, tagged_posts
from murmur.sources import fixtures, tables
from murmur.specs import POSTS_SCHEMA

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Invariants

def test_union_form_equals_single_pass(spark):
    tagged = tagged_posts(spark, SF)
    union = reactions.union_of([reactions.engagement_of(tagged, e) for e in ENTITIES])
    single = reactions.engagement_by_entity(tagged, ENTITIES).select(*union.columns)
    assert sorted(rows(union)) == sorted(rows(single))


def test_periods_add_up_to_the_whole(spark):
    tagged = tagged_posts(spark, SF)
    by_period = reactions.mentions_by_period(tagged, ENTITIES, CALENDAR).collect()
    whole = reactions.mention_totals(tagged, ENTITIES).first()
    for entity in ENTITIES:
        assert sum(r[entity.name] or 0 for r in by_period) == whole[entity.name]
    assert [r.event_period for r in by_period] == [*CALENDAR.labels, "other"]


def test_entity_counts_agree_between_engagement_and_sentiment(spark):
    engagement = reactions.engagement_by_entity(tagged_posts(spark, SF), ENTITIES).select("player", "posts")
    feeling = sentiment.sentiment_by_entity(scored_posts(spark, SF), ENTITIES).select("player", "posts")
    assert rows(engagement) == rows(feeling)


def test_period_counts_agree_in_three_tables(spark):
    tagged = tagged_posts(spark, SF)
    engagement = {r.event_period: r.posts for r in reactions.engagement_by_period(tagged, CALENDAR).collect()}
    feeling = {r.event_period: r.posts for r in sentiment.sentiment_by_period(scored_posts(spark, SF), CALENDAR).collect()}
    sides = {r.event: r.posts for r in reactions.head_to_head(tagged, fixtures.HEAD_TO_HEAD).collect()}
    assert feeling == {k: v for k, v in engagement.items() if k != "other"}
    assert sides == {"Event A": engagement["a_after"], "Event B": engagement["b_after"]}
    assert engagement == {"a_build": 47, "a_after": 25, "season": 40, "b_build": 25, "b_after": 16, "other": 47}


def test_density_integrates_to_one(spark):
    scored = scored_posts(spark, "/root/testdata/sf0.01")
    histogram = sentiment.sentiment_histogram(scored, fixtures.HEAD_TO_HEAD, 0.1)
    for row in histogram.groupBy("event").agg(F.sum(F.col("density") * 0.1).alias("area")).collect():
        assert row.area == pytest.approx(1.0)
    curve = sentiment.sentiment_density(scored, fixtures.HEAD_TO_HEAD)
    assert curve.count() == 162
    for row in curve.groupBy("event").agg((F.sum("density") * 2 / 80).alias("area")).collect():
        assert 0.5 < row.area <= 1.01


def test_ties_rank_by_name_and_ranks_match_a_plain_rank(spark):
    data = [("p", f) for f, n in (("b", 3), ("a", 3), ("c", 5), ("d", 1)) for _ in range(n)] + [("q", "a")]
    df = spark.createDataFrame(data, "event_period string, subreddit string")
    assert [r.subreddit for r in reactions.forum_volume(df).collect()] == ["c", "a", "b", "d"]
    moved = {r.subreddit: (r.before_position, r.after_position) for r in reactions.forum_rank_change(df, "p", "q").collect()}
    assert moved == {"c": (1, None), "a": (2, 1), "b": (2, None), "d": (4, None)}


def test_hash_sample_ignores_partitioning(spark):
    df = spark.range(1000).withColumnRenamed("id", "post_id")
    first = rows(reactions.hash_sample(df.repartition(3), 20, "post_id"))
    assert first == rows(reactions.hash_sample(df.repartition(7), 20, "post_id"))


# Sources and sinks

def test_saved_table_prunes_partitions_and_pushes_the_window(spark):
    path = tables.save_partitioned(fixtures.posts(spark, SF), scratch_path(spark, "posts"), rebalance=True)
    window = CALENDAR.window("a_build", "a_after")
    loaded = features.in_window(tables.load_posts(spark, path, periods=[window]), window)
    text = plan(loaded.select("post_id"))
    assert re.search(r"PartitionFilters: \[[^\]]*yyyy[^\]]*= 2024", text)
    assert "GreaterThanOrEqual(created_utc,1704240000)" in text
    assert "title" not in text.split("ReadSchema")[1]
    assert loaded.count() == 47 + 25


def test_saved_forum_key_is_pushed_to_the_reader(spark):
    posts = features.with_forum_key(fixtures.posts(spark, SF))
    path = tables.save_partitioned(posts, scratch_path(spark, "keyed"))
    topical = features.filter_topic(tables.load_posts(spark, path), fixtures.TOPIC)
    assert re.search(r"PushedFilters: \[[^\]]*In\(forum_lc", plan(topical))
    assert topical.count() == features.filter_topic(fixtures.posts(spark, SF), fixtures.TOPIC).count() == 100


def test_a_raw_dump_conforms(spark):
    path = scratch_path(spark, "raw")
    raw = spark.createDataFrame(
        [("z1", "RCB", "hello", 5, 2, "someone", 1704240000, 2024, 1), ("10", "RCB", None, 5, 2, "x", 1704240000, 2024, 2)],
        "id string, subreddit string, title string, score int, num_comments int, author string, created_utc int, yyyy int, mm int")
    tables.save_partitioned(raw, path)
    posts = tables.load_posts(spark, path, months=[1], columns={
        "post_id": F.conv("id", 36, 10), "author_id": F.xxhash64("author")})
    assert posts.schema.simpleString() == POSTS_SCHEMA.simpleString()
    assert [(r.post_id, r.title, r.score) for r in posts.collect()] == [(35 * 36 + 1, "hello", 5)]


def test_loading_another_schema_fails(spark):
    path = scratch_path(spark, "wrong")
    spark.range(3).write.parquet(path)
    with pytest.raises(tables.SchemaMismatch, match="created_utc"):
        tables.load_posts(spark, path)


def test_one_hot_partition_is_split_when_rebalanced(spark):
    df = spark.range(400_000).select(
        F.when(F.col("id") < 390_000, 1).otherwise(2).alias("mm"), F.lit(2024).alias("yyyy"), F.md5(F.col("id").cast("string")).alias("x"))
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB", "spark.sql.shuffle.partitions": "4"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        path = tables.save_partitioned(df, scratch_path(spark, "hot"), rebalance=True)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    saved = spark.read.parquet(path)
    assert saved.count() == 400_000
    assert saved.where("mm = 1").select(F.input_file_name()).distinct().count() > 1


def test_result_csv_is_one_ordered_file(spark):
    path = scratch_path(spark, "csv")
    tables.save_result_csv(spark.createDataFrame([(2, "b"), (1, "a")], "n long, s string"), path, ["n"])
    files = spark.read.text(path)
    assert [r.value for r in files.collect()] == ["n,s", "1,a", "2,b"]
    assert files.select(F.input_file_name()).distinct().count() == 1


def test_schema_report_reads_no_rows_unless_asked(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a long not null, b string")
    assert rows(tables.schema_report(df)) == [(0, "a", "bigint", False), (1, "b", "string", True)]
    assert rows(tables.schema_report(df, count_nulls=True)) == [(0, "a", "bigint", False, 0), (1, "b", "string", True, 1)]
    assert "FileScan" not in plan(tables.schema_report(fixtures.posts(spark, SF)))


def test_unfit_and_missing_keys_fail(spark):
    raw = spark.createDataFrame([("x1", "a"), ("2", None)], "post_id string, title string")
    schema = POSTS_SCHEMA.fields[0]
    from pyspark.sql import types as T
    narrow = T.StructType([schema, T.StructField("title", T.StringType())])
    with pytest.raises(Exception, match="does not fit: x1"):
        tables.conform(raw, narrow).collect()
    assert rows(tables.conform(raw, narrow, keys=())) == [(None, "a"), (2, None)]
    with pytest.raises(Exception, match="title is missing"):
        tables.require_keys(raw, "post_id", "title").collect()
    assert rows(tables.require_keys(raw, "post_id")) == [("x1", "a"), ("2", None)]


def test_nothing_asked_for_gives_nothing(spark):
    posts = fixtures.posts(spark, SF)
    assert tables.only_partitions(posts, periods=[]).count() == 0
    none = features.add_mentions(posts, "title", [])
    assert none.where("mentions_any").count() == 0 and features.explode_entities(none, []).count() == 0
    assert keywords.term_counts(posts, "title", {}).count() == 0
    assert features.discover_forums(posts, []).count() == 0
    odd = spark.createDataFrame([("c++",), ("cc",)], "subreddit string")
    assert [r.subreddit for r in features.discover_forums(odd, ["c++"]).collect()] == ["c++"]


def test_presets_run_over_a_literal_frame(spark):
    from murmur import presets
    at = int(presets.CRICKET_CALENDAR.periods[0].start.timestamp()) + 86_400
    df = spark.createDataFrame(
        [(i, forum, f"{entity.terms[0]} great innings great", 10 * i, i, i, at, 2023, 11)
         for i, (forum, entity) in enumerate(zip(presets.CRICKET_TOPIC.forums, presets.CRICKET_ENTITIES * 9))],
        POSTS_SCHEMA)
    topical = features.filter_topic(df, presets.CRICKET_TOPIC)
    tagged = features.tag(topical, "title", presets.CRICKET_ENTITIES, presets.CRICKET_CALENDAR)
    n = topical.count()
    assert n == df.count() > 0
    engaged = reactions.engagement_by_entity(tagged, presets.CRICKET_ENTITIES).collect()
    assert {r.player for r in engaged} == {e.name for e in presets.CRICKET_ENTITIES[:n]}
    assert sum(r.posts for r in reactions.engagement_by_period(tagged, presets.CRICKET_CALENDAR).collect()) == n
    reactions.head_to_head(tagged, presets.CRICKET_HEAD_TO_HEAD).collect()
    assert features.discover_forums(df, presets.CRICKET_KEYWORDS).count() > 0
    words = topics.tokenise(df, "title", "post_id", stop_words=[*ENGLISH_STOP_WORDS, *presets.CRICKET_STOP_WORDS])
    assert words.count() == n


def test_fixtures_follow_the_canonical_schemas(spark):
    posts, comments = fixtures.posts(spark, SF), fixtures.comments(spark, SF)
    tables.require_schema(posts, POSTS_SCHEMA)
    assert (posts.count(), comments.count()) == (200, 87)


# Words

def test_tokens(spark):
    df = spark.createDataFrame([("  a  b\n\nc ",), ("",)], "t string")
    assert [r[0] for r in df.select(blank_separated(F.col("t"))).collect()] == [["a", "b", "c"], []]
    assert spark.range(1).select(word_runs(F.lit("Don't über-x y2 _a"))).first()[0] == ["don", "über", "y2", "_a"]
    words = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    terms = explode_terms(words.select(with_bigrams("w").alias("t")), "t").collect()
    assert sorted(r.term for r in terms) == ["a", "a", "a b", "b", "b c", "c"]


def test_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover
    assert sorted(ENGLISH_STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([("cat dog", True, False), ("cat", True, True), (None, True, True)],
                               "title string, one boolean, two boolean")
    counts = keywords.term_counts(df, "title", {"one": F.col("one"), "two": F.col("two")})
    weights = {(r.group, r.term): r.tfidf for r in keywords.tfidf(counts).collect()}
    common, rare = 1.0, math.log(3 / 2) + 1
    norm = math.sqrt((2 * common) ** 2 + 2 * rare ** 2)
    assert weights == {
        ("one", "cat"): pytest.approx(2 * common / norm), ("one", "dog"): pytest.approx(rare / norm),
        ("one", "cat dog"): pytest.approx(rare / norm), ("two", "cat"): pytest.approx(1.0)}


# Topics

def test_topics_repeat_and_have_ordered_weights(spark):
    texts = tagged_comments(spark, SF)
    fits = [topics.fit_topics(texts.repartition(n), "body", "comment_id", keep=["event_period"], max_iter=5, min_df=2,
                              partitions=4) for n in (3, 5)]
    words = [rows(f.topic_words()) for f in fits]
    assert words[0] == words[1]
    assert len(words[0]) == 60
    for topic in range(6):
        weights = [w[3] for w in words[0] if w[0] == topic]
        assert len(weights) == 10 and weights == sorted(weights, reverse=True)
    assert "" not in fits[0].vocabulary
    quality = {r.metric: r.value for r in fits[0].quality().collect()}
    assert quality["log_likelihood"] < 0 < quality["log_perplexity"]
    mix = topics.topic_mix(fits[0].mixtures())
    for row in mix.groupBy("event_period").agg(F.sum("weight").alias("w")).collect():
        assert row.w == pytest.approx(1.0)


def test_fitted_topics_are_those_of_sparks_own_fit(spark):
    """Also where a text is empty, has words the model doesn't know, or comes twice."""
    random.seed(5)
    kinds = [["ant", "bee", "cow", "dog", "elk"], ["fir", "ivy", "oak", "elm", "yew"]]
    bodies = [" ".join(random.choices(kinds[i % 2], k=random.randint(1, 30)) + random.choices(kinds[1 - i % 2], k=i % 3)) for i in range(90)]
    df = spark.createDataFrame([*enumerate([*bodies, "", None, "unheard", bodies[0]])], "id long, body string")
    fitted = topics.fit_topics(df, "body", "id", k=3, max_iter=4, partitions=3, stop_words=[])
    own = topics.LDA(k=3, maxIter=4, seed=42, subsamplingRate=1.0, topicDistributionCol="topic_dist").fit(
        topics.steady(fitted.texts, "id", 3).persist())
    assert np.allclose(fitted.model.topicsMatrix().toArray(), own.topicsMatrix().toArray(), rtol=1e-5)
    assert np.allclose(fitted.model.estimatedDocConcentration(), own.estimatedDocConcentration(), rtol=1e-5)
    mixtures = [{r.id: r.topic_dist.toArray() for r in m.transform(fitted.texts).collect()} for m in (fitted.model, own)]
    assert mixtures[0].keys() == mixtures[1].keys() and all(np.allclose(mixtures[0][i], mixtures[1][i], atol=1e-5) for i in mixtures[0])
    assert fitted.model.getMaxIter() == 4


def test_texts_drawn_twice_are_worked_on_once():
    """A pass takes a text's copies together, in any grouping, and gives what one text at a time does."""
    random.seed(6)
    weights = np.exp(variational.log_expectation(np.array([[random.gammavariate(2, 1) for _ in range(50)] for _ in range(4)])))
    texts = [sorted(random.sample(range(50), random.randint(0, 40))) for _ in range(60)]
    alpha, start = np.full(4, 0.25), np.array([0.9, 1.1, 1.0, 1.05])

    def told(some, times):
        ends = np.cumsum([len(texts[i]) for i in some])
        slots = np.array([s for i in some for s in texts[i]], int)
        found = variational.Statistics(weights, alpha, start)
        found.add(slots, 1.0 + slots % 3, ends - [len(texts[i]) for i in some], ends, np.array(times, float))
        return found

    whole = told(range(60), [2] * 60)
    single = [told([i], [1]) for i in range(60)]
    assert whole.texts == 2 * sum(s.texts for s in single) == 2 * sum(bool(t) for t in texts)
    assert np.allclose(whole.words, 2 * sum(s.words for s in single)) and np.allclose(whole.mixtures, 2 * sum(s.mixtures for s in single))


def test_digamma():
    x = np.array([0.01, 0.2, 1.0, 3.5, 40.0, 1e6])
    step = 1e-5 * x
    assert np.allclose(variational.digamma(x), [(math.lgamma(a + h) - math.lgamma(a - h)) / (2 * h) for a, h in zip(x, step, strict=True)], rtol=1e-6)
    assert np.allclose(variational.exp_digamma(x), np.exp(variational.digamma(x)), rtol=1e-9)
    assert np.allclose(variational.trigamma(x), (variational.digamma(x + step) - variational.digamma(x - step)) / (2 * step), rtol=1e-4)


# Models

@pytest.mark.parametrize("values", [
    [1], [1, 2], [5, 5, 5, 5], [0, 0, 0, 10], list(range(1000)), [0.1, -3.5, 1e12, 7, 7, 7, -1e-9], [None, 4, None, 8]])
@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_exact_quantile(spark, values, p):
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "score double")
    known = sorted(v for v in values if v is not None)
    rank = p * (len(known) - 1)
    low, high = known[math.floor(rank)], known[math.ceil(rank)]
    assert models.exact_quantile(df, "score", p) == pytest.approx(low + (high - low) * (rank - math.floor(rank)))


def test_exact_quantile_with_more_values_than_buckets(spark):
    random.seed(1)
    values = [random.lognormvariate(3, 2) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    assert models.exact_quantile(df, "score", 0.75) == pytest.approx(statistics.quantiles(values, n=4, method="inclusive")[2])


@pytest.mark.parametrize("values", [
    [1, 2, 3, 4, math.inf], [1, 2, 3, 4, math.nan], [-1.7e308, 1, 2, 3, 1.7e308], [-math.inf, -math.inf, 0, 1, math.inf],
    [math.nan] * 3, [-math.inf], [5e-324, 1e-323, 0.0, 2e-323], [1.7e308, 1.6e308, -1.7e308]])
@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.6, 1.0])
def test_exact_quantile_of_odd_doubles(spark, values, p):
    df = spark.createDataFrame([(float(v),) for v in values], "score double")
    known = sorted(map(float, values), key=lambda v: (math.isnan(v), v))
    rank = p * (len(known) - 1)
    low, high = known[math.floor(rank)], known[math.ceil(rank)]
    share = rank - math.floor(rank)
    want = low if low == high or not share else low * (1 - share) + high * share
    assert models.exact_quantile(df, "score", p) == pytest.approx(want, nan_ok=True)


def test_exact_quantile_of_large_whole_numbers(spark):
    df = spark.createDataFrame([(9007199254740993,), (9007199254740993,), (-2**63,), (2**63 - 1,)], "score long")
    assert models.exact_quantile(df, "score", 1 / 3) == 9007199254740993
    assert [models.exact_quantile(df, "score", p) for p in (0.0, 1.0)] == [-2**63, 2**63 - 1]
    many = spark.range(5000).selectExpr("9007199254740993 + id AS score")
    assert models.exact_quantile(many, "score", 1.0) == 9007199254740993 + 4999


def test_leading_terms_equal_the_unpruned_form(spark):
    random.seed(5)
    texts = [(" ".join(f"w{int(random.paretovariate(0.7)) % 60:02d}" for _ in range(random.randint(0, 30))), i % 2 == 0, i % 3 == 0)
             for i in range(300)]
    df = spark.createDataFrame([*texts, (None, True, True)], "title string, one boolean, two boolean")
    groups = {"one": F.col("one"), "two": F.col("two")}
    for top, min_df in ((5, 1), (40, 2), (10_000, 1)):
        full = keywords.tfidf(keywords.term_counts(df, "title", groups), top, min_df)
        lean = keywords.leading_term_counts(df, "title", groups, max_features=top, min_df=min_df)
        assert sorted(rows(keywords.tfidf(lean, top, min_df))) == sorted(rows(full))
    assert keywords.leading_term_counts(df, "title", groups, max_features=5).count() < keywords.term_counts(df, "title", groups).count()


def test_no_forum_gives_an_empty_typed_result(spark):
    profile = reactions.forum_profile(tagged_posts(spark, SF), ENTITIES, min_posts=10_000)
    clusters = models.cluster_forums(profile, ENTITIES)
    assert clusters.silhouette() is None
    assert clusters.table().count() == clusters.summary().count() == 0
    some = models.cluster_forums(reactions.forum_profile(tagged_posts(spark, SF), ENTITIES, min_posts=5), ENTITIES)
    assert dict(clusters.assigned.dtypes) == dict(some.assigned.dtypes)


def test_quantile_of_nothing(spark):
    empty = spark.createDataFrame([], "score double")
    assert models.exact_quantile(empty, "score", 0.75) is None
    assert models.quantile(empty, "score", 0.75, exact=False) is None


def test_planted_forum_signal_is_found(spark):
    data = [(i, i % 24, i % 7 + 1, 1 + i % 3, i % 2 == 0, i % 5 == 0, i % 11 == 0, f"f{i % 4}", f"p{i % 3}", (i % 4) * 100,
             (i % 4) * 10) for i in range(800)]
    tagged = spark.createDataFrame(data, "post_id long, hour_of_day int, day_of_week int, month_num int, mentions_alpha boolean,"
                                   "mentions_beta boolean, mentions_gamma boolean, subreddit string, event_period string,"
                                   "score long, num_comments long")
    fitted = models.fit_engagement_models(models.feature_table(tagged, ENTITIES), ENTITIES, trees=20, partitions=4)
    metrics = {r.metric: r.value for r in models.classification_metrics(fitted.classified()).collect()}
    assert metrics["AUC-ROC"] > 0.9
    errors = {r.metric: r.value for r in models.regression_metrics(fitted.regressed()).collect()}
    assert errors["R2"] > 0.5 and errors["RMSE"] >= 0
    weights = {r.feature: r.importance for r in models.feature_importances(fitted, ENTITIES).collect()}
    assert sum(weights.values()) == pytest.approx(1.0)
    assert min(weights.values()) >= 0
    assert max(weights, key=weights.get) == "subreddit (OHE)"


def test_regression_metrics_equal_the_evaluator(spark):
    from pyspark.ml.evaluation import RegressionEvaluator
    df = spark.createDataFrame([(1.0, 2), (3.5, 3), (8.0, 9)], "prediction double, num_comments long")
    mine = {r.metric: r.value for r in models.regression_metrics(df).collect()}
    for metric, name in (("rmse", "RMSE"), ("r2", "R2")):
        assert mine[name] == pytest.approx(RegressionEvaluator(labelCol="num_comments", metricName=metric).evaluate(df))


def test_clusters_cover_the_forums(spark):
    profile = reactions.forum_profile(tagged_posts(spark, SF), ENTITIES, min_posts=10)
    clusters = models.cluster_forums(profile, ENTITIES, partitions=4)
    table = clusters.table().collect()
    assert len(table) == 20 and {r.cluster for r in table} <= {0, 1, 2, 3}
    assert -1 <= clusters.silhouette() <= 1
    by_ml = {r.subreddit: r.km_features for r in clusters.assigned.collect()}
    columns = models.profile_features(ENTITIES)
    for row in models.standardised(profile, columns).collect():
        assert [row[c] for c in columns] == pytest.approx(list(by_ml[row.subreddit]), abs=1e-9)


# Plans

def test_single_scan_and_no_python_in_plans(spark):
    tagged = tagged_posts(spark, SF)
    for df in (reactions.engagement_by_entity(tagged, ENTITIES), reactions.top_forums_by_entity(tagged, ENTITIES),
               sentiment.sentiment_by_entity(scored_posts(spark, SF), ENTITIES)):
        text = plan(df)
        assert len(re.findall(r"FileScan parquet \[doc_id#\d+L,[^\]]*text", text)) == 1
        assert "EvalPython" not in text


def test_sentiment_tokens_are_combined_before_the_shuffle(spark):
    text = plan(scored_posts(spark, SF))
    assert "partial_sum(_v" in text
    generate = next(line for line in text.splitlines() if "Generate posexplode(_near" in line)
    assert "_tokens" not in generate
    assert text.count("BroadcastHashJoin [_") == 4


def test_filters_reach_the_texts_before_they_are_split(spark):
    text = plan(sentiment.sentiment_by_entity(scored_posts(spark, SF), ENTITIES))
    below = text[text.index("Generate posexplode(_near"):]
    assert re.search(r"Filter \(.*Contains\(lower\(text", below)


def test_top_forums_are_limited_before_the_shuffle(spark):
    text = plan(reactions.top_forums_by_entity(tagged_posts(spark, SF), ENTITIES))
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_top_k_needs_no_full_sort(spark):
    text = plan(reactions.top_posts(tagged_posts(spark, SF), "a_after"))
    assert "TakeOrderedAndProject" in text
