"""Engagement models and forum clusters."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur import study
from murmur.functions.scale import stage
from murmur.operators import models, reactions
from murmur.plans import sql
from murmur.plans.base import ENTITIES, FLAGS, query, rounded, tagged_posts
from murmur.sources import fixtures

FEATURES = f"post_id, hour_of_day, day_of_week, month_num, {', '.join(FLAGS)}, subreddit, event_period, score, num_comments"
WITH_FEATURES = f"{sql.TAGGED_POSTS}, {sql.FEATURES}"
ONE_HOT = f"""one_hot AS (
  SELECT 'subreddit' AS category, subreddit AS name, i FROM forum_index
  UNION ALL SELECT 'event_period', event_period, i FROM period_index)"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.feature_table(tagged_posts(spark, sf_dir), ENTITIES)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.with_engagement_label(_features(spark, sf_dir))


@query("m01_feature_table", f"{WITH_FEATURES} SELECT {FEATURES} FROM features")
def feature_table(spark, sf_dir):
    return _features(spark, sf_dir).select(*FEATURES.split(", "))


@query("a13_class_balance", f'{WITH_FEATURES} SELECT high_engagement, count(*) AS "count" FROM labelled GROUP BY 1')
def class_balance(spark, sf_dir):
    return models.class_balance(_labelled(spark, sf_dir))


@query("m05_split", f"{WITH_FEATURES} SELECT post_id, in_training FROM labelled")
def split(spark, sf_dir):
    return _features(spark, sf_dir).select("post_id", models.in_training("post_id").alias("in_training"))


_flagged: dict[tuple[str, str], DataFrame] = {}
_engagement: dict[tuple[str, str], models.EngagementModels] = {}
_clusters: dict[tuple[str, str], models.ForumClusters] = {}


def forget() -> None:
    """Drop fitted models, for a table that has changed or a timing that must include the fit."""
    _flagged.clear()
    _engagement.clear()
    _clusters.clear()


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged posts without their texts, staged: all fits read them, and the texts are searched once."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _flagged:
        _flagged[at] = study.without_texts(tagged_posts(spark, sf_dir))
    return _flagged[at]


def _models(spark: SparkSession, sf_dir: str) -> models.EngagementModels:
    """One fit per session and data set, shared by the queries that read the models until ``forget``."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _engagement:
        _engagement[at] = models.fit_engagement_models(models.feature_table(_rows(spark, sf_dir), ENTITIES), ENTITIES)
    return _engagement[at]


def _forums(spark: SparkSession, sf_dir: str) -> models.ForumClusters:
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _clusters:
        profile = reactions.forum_profile(_rows(spark, sf_dir), ENTITIES)
        _clusters[at] = models.cluster_forums(profile, ENTITIES)
    return _clusters[at]


@query("m02_category_index", f"{WITH_FEATURES}, {ONE_HOT} SELECT category, name, CAST(i AS DOUBLE) AS i FROM one_hot")
def category_index(spark, sf_dir):
    encoded = _models(spark, sf_dir).train
    pairs = F.array(*(F.struct(
        F.lit(c).alias("category"), F.col(c).alias("name"), F.col(f"{c}_idx").alias("i")) for c in models.CATEGORIES))
    return encoded.select(F.inline(pairs)).distinct()


@query("m03_one_hot", f"""{WITH_FEATURES}, {ONE_HOT}
SELECT category, name, CAST(i AS INTEGER) AS slot,
       CAST((SELECT count(*) FROM one_hot o WHERE o.category = one_hot.category) AS INTEGER) AS width FROM one_hot""")
def one_hot(spark, sf_dir):
    encoded = _models(spark, sf_dir).train
    pairs = F.array(*(F.struct(
        F.lit(c).alias("category"), F.col(c).alias("name"),
        (F.array_position(vector_to_array(f"{c}_ohe"), F.lit(1.0)) - 1).cast("int").alias("slot"),
        F.size(vector_to_array(f"{c}_ohe")).alias("width"),
    ) for c in models.CATEGORIES))
    return encoded.select(F.inline(pairs)).distinct()


NUMERIC = models.numeric_features(ENTITIES)


@query("m04_feature_vector", f"""{WITH_FEATURES}, {ONE_HOT}, train AS (SELECT * FROM labelled WHERE in_training),
cells AS ({" UNION ALL ".join(f"SELECT {i} AS slot, CAST({c} AS DOUBLE) AS v FROM train" for i, c in enumerate(NUMERIC))}
  UNION ALL SELECT {len(NUMERIC)} + f.i, 1.0 FROM train t JOIN forum_index f USING (subreddit)
  UNION ALL SELECT {len(NUMERIC)} + (SELECT count(*) FROM forum_index) + p.i, 1.0 FROM train t JOIN period_index p USING (event_period))
SELECT CAST(slot AS INTEGER) AS slot, round(sum(v), 6) AS total FROM cells GROUP BY slot""")
def feature_vector(spark, sf_dir):
    encoded = _models(spark, sf_dir).train
    cells = encoded.select(F.posexplode(vector_to_array("features")).alias("slot", "v"))
    return rounded(cells.groupBy("slot").agg(F.sum("v").alias("total")))


#: Fewer slots than categories' values need, so that some are shared.
FEW_SLOTS = 16


def _slot_sql(category: str) -> str:
    return f"CAST(('0x' || substr(md5('{category}=' || {category}), 1, 8))::BIGINT % {FEW_SLOTS} AS INTEGER)"


SLOTS_SQL = "placed AS (" + " UNION ".join(
    f"SELECT '{c}' AS category, {c} AS name, {_slot_sql(c)} AS slot FROM features" for c in models.CATEGORIES) + ")"


@query("m02_hashed_slots", f"{WITH_FEATURES}, {SLOTS_SQL} SELECT category, name, slot, count(*) OVER (PARTITION BY category, slot) AS sharing FROM placed")
def hashed_slots(spark, sf_dir):
    return models.category_slots(_features(spark, sf_dir), FEW_SLOTS)


@query("m02_slot_collisions", f"""{WITH_FEATURES}, {SLOTS_SQL}, shared AS (SELECT *, count(*) OVER (PARTITION BY category, slot) AS sharing FROM placed)
SELECT category, count(*) AS names, count(DISTINCT slot) AS used_slots, count(*) FILTER (WHERE sharing > 1) AS colliding
FROM shared GROUP BY category""")
def slot_collisions(spark, sf_dir):
    return models.slot_collisions(models.category_slots(_features(spark, sf_dir), FEW_SLOTS))


@query("m03_hashed_vector", f"""{WITH_FEATURES},
cells AS ({" UNION ALL ".join(f"SELECT {i} AS slot, CAST({c} AS DOUBLE) AS v FROM features" for i, c in enumerate(NUMERIC))}
  {" ".join(f"UNION ALL SELECT {len(NUMERIC) + i * FEW_SLOTS} + {_slot_sql(c)}, 1.0 FROM features" for i, c in enumerate(models.CATEGORIES))})
SELECT CAST(slot AS INTEGER) AS slot, round(sum(v), 6) AS total FROM cells GROUP BY slot HAVING sum(v) <> 0""")
def hashed_vector(spark, sf_dir):
    """The sum of every slot of the hashed feature vectors, without empty ones; no pass over the rows comes before."""
    rows = models.with_category_slots(_features(spark, sf_dir), FEW_SLOTS)
    encoded = Pipeline(stages=models.hashed_encoding_stages(ENTITIES)).fit(rows).transform(rows)
    cells = encoded.select(F.posexplode(vector_to_array("features")).alias("slot", "v"))
    return rounded(cells.groupBy("slot").agg(F.sum("v").alias("total")).where("total <> 0"))


SKETCH_K = 4096
SHARES = (0.0, 0.25, 0.5, 0.75, 1.0)
RANKED = f"""ranked AS (SELECT subreddit, event_period, score, rank() OVER w AS low, count(*) OVER (PARTITION BY subreddit, event_period) AS rows,
    count(*) OVER (PARTITION BY subreddit, event_period ORDER BY score) AS upto FROM tagged WHERE score IS NOT NULL
    WINDOW w AS (PARTITION BY subreddit, event_period ORDER BY score)),
shares(probability) AS (VALUES {", ".join(f"(CAST({p} AS DOUBLE))" for p in SHARES)})"""


@query("a14_sketch_quantiles", f"""{sql.TAGGED_POSTS}, {RANKED}
SELECT subreddit, event_period, rows, probability, min(score) AS value FROM ranked, shares
WHERE upto >= probability * rows GROUP BY ALL""")
def sketch_quantiles(spark, sf_dir):
    """Quantiles of every forum and period, from sketches that are exact up to ``SKETCH_K`` rows."""
    sketches = models.quantile_sketches(tagged_posts(spark, sf_dir), "score", ["subreddit", "event_period"], SKETCH_K)
    return models.sketched_quantiles(sketches, SHARES)


ROUGH_K, ROUGH_ERROR = 64, 0.15


@query("a14_merged_sketches", f"""{sql.TAGGED_POSTS}, shares(probability) AS (VALUES {", ".join(f"(CAST({p} AS DOUBLE))" for p in SHARES)}),
sizes AS (SELECT event_period, count(score) AS rows, min(score) AS least, max(score) AS most FROM tagged GROUP BY event_period)
SELECT event_period, rows, probability, true AS close, CASE probability WHEN 0.0 THEN least WHEN 1.0 THEN most END AS extreme FROM sizes, shares""")
def merged_sketches(spark, sf_dir):
    """Small sketches of each forum put together by period: the ends are exact, and how far the others' ranks are off is
    counted over all rows and held against a bound."""
    posts = tagged_posts(spark, sf_dir)
    parts = models.quantile_sketches(posts, "score", ["subreddit", "event_period"], ROUGH_K)
    quantiles = models.sketched_quantiles(models.merged_sketches(parts, ["event_period"], ROUGH_K), SHARES)
    found = models.rank_errors(posts, "score", ["event_period"], quantiles)
    return found.select("event_period", "rows", "probability", (F.col("error") <= ROUGH_ERROR).alias("close"),
                        F.when(F.col("probability").isin(0.0, 1.0), F.col("value")).alias("extreme"))


def _fixed_predictions(spark: SparkSession, sf_dir: str):
    """Labels with a prediction that no fit decides: ``toxic`` stands in for the label, ``quality`` for the prediction."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("post_id"), F.col("toxic").alias(models.LABEL), F.col("quality").cast("double").alias("prediction"),
        F.array(1 - F.col("quality").cast("double"), F.col("quality").cast("double")).alias("_raw"))


@query("f11_correct_fixed", "SELECT doc_id AS post_id, toxic AS high_engagement, CAST(quality AS DOUBLE) AS prediction "
       "FROM labels WHERE toxic = quality")
def correct_fixed(spark, sf_dir):
    return models.correct_predictions(_fixed_predictions(spark, sf_dir)).select("post_id", models.LABEL, "prediction")


@query("a15_accuracy_fixed", "SELECT round(avg(CASE WHEN toxic = quality THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM labels")
def accuracy_fixed(spark, sf_dir):
    return rounded(models.accuracy(_fixed_predictions(spark, sf_dir)))


#: With a score of two values the area is the share of right orders among pairs, ties counting half.
FIXED_METRICS = """cells AS (
  SELECT sum(toxic * quality) AS tp, sum(toxic * (1 - quality)) AS fn, sum((1 - toxic) * quality) AS fp,
         sum((1 - toxic) * (1 - quality)) AS tn FROM labels),
fixed AS (
  SELECT 'AUC-ROC' AS metric, round(((tp / (tp + fn)) + (tn / (tn + fp))) / 2, 6) AS value FROM cells
  UNION ALL SELECT 'Accuracy', round((tp + tn) / (tp + tn + fp + fn), 6) FROM cells)"""


def _fixed_metrics(spark: SparkSession, sf_dir: str):
    predicted = _fixed_predictions(spark, sf_dir).withColumn("rawPrediction", array_to_vector("_raw"))
    return models.classification_metrics(predicted)


@query("m07_metrics_fixed", f"WITH {FIXED_METRICS} SELECT metric, CAST(value AS DOUBLE) AS value FROM fixed")
def classification_fixed(spark, sf_dir):
    return rounded(_fixed_metrics(spark, sf_dir))


FIXED_REGRESSION = """pairs AS (SELECT CAST(num_comments AS DOUBLE) AS y, CAST(score AS DOUBLE) AS p FROM posts
  WHERE num_comments IS NOT NULL AND score IS NOT NULL),
sums AS (SELECT sum((y - p) ** 2) AS r, sum((y - (SELECT avg(y) FROM pairs)) ** 2) AS s, count(*) AS n FROM pairs),
regressed AS (SELECT 'RMSE' AS metric, round(sqrt(r / n), 6) AS value FROM sums UNION ALL SELECT 'R2', round(1 - r / s, 6) FROM sums)"""


def _fixed_regression(spark: SparkSession, sf_dir: str):
    posts = fixtures.posts(spark, sf_dir).dropna(subset=["num_comments", "score"])
    return models.regression_metrics(posts.select("num_comments", F.col("score").cast("double").alias("prediction")))


@query("m10_metrics_fixed", f"WITH {sql.POSTS}, {FIXED_REGRESSION} SELECT metric, value FROM regressed")
def regression_fixed(spark, sf_dir):
    return rounded(_fixed_regression(spark, sf_dir))


@query("m17_metric_tables_fixed", f"""WITH {sql.POSTS}, {FIXED_METRICS}, {FIXED_REGRESSION}
SELECT metric, CAST(value AS DOUBLE) AS value FROM fixed UNION ALL SELECT metric, value FROM regressed""")
def metric_tables_fixed(spark, sf_dir):
    return rounded(_fixed_metrics(spark, sf_dir).unionByName(_fixed_regression(spark, sf_dir)))


def _two_places(column: str, places: int, missing: str) -> str:
    return f"coalesce(printf('%.{places}f', {column}), '{missing}')"


@query("m16_summary_fixed", f"""WITH {sql.POSTS}, {FIXED_METRICS}, {FIXED_REGRESSION},
facts AS (SELECT (SELECT CAST(value AS DOUBLE) FROM fixed WHERE metric = 'AUC-ROC') AS auc, (SELECT CAST(value AS DOUBLE) FROM fixed WHERE metric = 'Accuracy') AS acc,
  (SELECT value FROM regressed WHERE metric = 'RMSE') AS rmse, (SELECT value FROM regressed WHERE metric = 'R2') AS r2,
  (SELECT CAST(count(DISTINCT subreddit) AS DOUBLE) / 100 FROM posts) AS shape)
SELECT 'Q8' AS "Question", 'RF Classifier' AS "Model", 'Predict high engagement (top 25%)' AS "Task",
  'AUC=' || {_two_places('auc', 4, 'nan')} || ', Acc=' || {_two_places('acc', 4, 'nan')} AS "Result" FROM facts
UNION ALL SELECT 'Q9', 'RF Regressor', 'Predict comment count', 'RMSE=' || {_two_places('rmse', 2, 'nan')} || ', R²=' || {_two_places('r2', 4, 'nan')} FROM facts
UNION ALL SELECT 'Q10', 'K-Means (k=4)', 'Cluster forums by behaviour', 'Silhouette=' || {_two_places('shape', 4, 'n/a')} FROM facts""")
def summary_fixed(spark, sf_dir):
    """The summary of metrics that no fit decides; a hundredth of the number of forums stands in for the silhouette."""
    forums = fixtures.posts(spark, sf_dir).agg((F.count_distinct("subreddit") / 100).alias("value"))
    fixed = rounded(_fixed_metrics(spark, sf_dir).unionByName(_fixed_regression(spark, sf_dir)))
    metrics = fixed.unionByName(forums.select(F.lit("Silhouette").alias("metric"), "value"))
    return models.summary_lines(metrics, 25, 4)


#: Where the clock decides everything: posts from noon on score high and have many comments.
PLANTED = """planted AS (SELECT * REPLACE (CASE WHEN hour_of_day >= 12 THEN 100 ELSE 0 END AS score,
  CAST(CASE WHEN hour_of_day >= 12 THEN 200 ELSE 10 END AS BIGINT) AS num_comments) FROM features)"""


def _planted_models(spark: SparkSession, sf_dir: str) -> models.EngagementModels:
    at = (spark.sparkContext.applicationId, f"planted {sf_dir}")
    if at not in _engagement:
        late = F.col("hour_of_day") >= 12
        planted = _features(spark, sf_dir).withColumns({
            "score": F.when(late, 100).otherwise(0).cast("long"), "num_comments": F.when(late, 200).otherwise(10).cast("long")})
        _engagement[at] = models.fit_engagement_models(planted, ENTITIES, encoding="hashed", slots=FEW_SLOTS)
    return _engagement[at]


@query("m06_planted_predictions", f"""{WITH_FEATURES}, {PLANTED}
SELECT post_id, CAST(hour_of_day >= 12 AS INTEGER) AS high_engagement, CAST(hour_of_day >= 12 AS DOUBLE) AS prediction FROM planted
WHERE NOT substr(md5(CAST(post_id AS VARCHAR)), 1, 2) < 'cd'""")
def planted_predictions(spark, sf_dir):
    """A classifier fitted where the label is a known function of one feature: it must find it for every test row."""
    return _planted_models(spark, sf_dir).classified().select("post_id", models.LABEL, "prediction")


@query("m08_planted_importance", f"""{WITH_FEATURES}, {PLANTED}, columns AS ({" UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, score) AS r FROM planted" for c in NUMERIC)})
SELECT feature FROM columns WHERE r IS NOT NULL AND NOT isnan(r) ORDER BY abs(r) DESC LIMIT 1""")
def planted_importance(spark, sf_dir):
    """The feature that the planted classifier leans on most is the one that goes with the label."""
    shares = models.feature_importances(_planted_models(spark, sf_dir), ENTITIES)
    return shares.orderBy(F.desc("importance"), "feature").limit(1).select("feature")


@query("m09_planted_predictions", f"""{WITH_FEATURES}, {PLANTED} SELECT post_id, num_comments, hour_of_day >= 12 AS many FROM planted
WHERE NOT substr(md5(CAST(post_id AS VARCHAR)), 1, 2) < 'cd'""")
def planted_regression(spark, sf_dir):
    """A regressor fitted on the planted comment counts puts every test row on the right side of the middle."""
    return _planted_models(spark, sf_dir).regressed().select("post_id", "num_comments", (F.col("prediction") > 105).alias("many"))


TEST_ROWS = f"{WITH_FEATURES}, test AS (SELECT * FROM labelled WHERE NOT in_training)"


@query("m06_predictions_agree", f"{TEST_ROWS} SELECT post_id, high_engagement, true AS bounded, true AS agrees FROM test")
def predictions_agree(spark, sf_dir):
    """Of every test row: its label, whether the probability lies within [0, 1], and whether it gives the prediction."""
    likely = F.col("probability")
    return classifier_predictions(spark, sf_dir).select(
        "post_id", models.LABEL, likely.between(0, 1).alias("bounded"),
        ((F.col("prediction") == (likely > 0.5).cast("double")) | (F.abs(likely - 0.5) < 1e-9)).alias("agrees"))


@query("m09_predictions_bounded", f"""{TEST_ROWS}, span AS (SELECT min(num_comments) AS low, max(num_comments) AS high FROM labelled WHERE in_training)
SELECT post_id, num_comments, true AS bounded FROM test""")
def predictions_bounded(spark, sf_dir):
    """A forest averages what it has seen, so no prediction leaves the training range."""
    fitted = _models(spark, sf_dir)
    low, high = fitted.train.agg(F.min("num_comments"), F.max("num_comments")).first()
    return fitted.regressed().select("post_id", "num_comments", F.col("prediction").between(low, high).alias("bounded"))


@query("m08_importance_shares", "SELECT unnest([{}]) AS feature, true AS share, true AS whole".format(", ".join(
    f"'{n}'" for n in [*models.numeric_features(ENTITIES), *(f"{c} (OHE)" for c in models.CATEGORIES)])))
def importance_shares(spark, sf_dir):
    """Every source column, whether its importance is a share, and whether all shares sum to one."""
    shares = feature_importances(spark, sf_dir)
    total = F.sum("importance").over(Window.partitionBy())
    return shares.select("feature", F.col("importance").between(0, 1).alias("share"), (F.abs(total - 1) < 1e-6).alias("whole"))


@query("m11_sampled_rows", f"""{TEST_ROWS} SELECT post_id, num_comments FROM test
ORDER BY md5(CAST(post_id AS VARCHAR)), post_id LIMIT 500""")
def sampled_rows(spark, sf_dir):
    return prediction_sample(spark, sf_dir).select("post_id", "num_comments")


@query("m06_classifier_predictions")
def classifier_predictions(spark, sf_dir):
    return _models(spark, sf_dir).classified().select(
        "post_id", models.LABEL, vector_to_array("probability")[1].alias("probability"), "prediction")


@query("f11_correct_predictions")
def correct_predictions(spark, sf_dir):
    return models.correct_predictions(_models(spark, sf_dir).classified()).select(
        "post_id", models.LABEL, "prediction")


@query("a15_accuracy")
def accuracy(spark, sf_dir):
    return models.accuracy(_models(spark, sf_dir).classified())


@query("m07_classification_metrics")
def classification_metrics(spark, sf_dir):
    return models.classification_metrics(_models(spark, sf_dir).classified())


@query("m08_feature_importances")
def feature_importances(spark, sf_dir):
    return models.feature_importances(_models(spark, sf_dir), ENTITIES)


@query("m09_regressor_predictions")
def regressor_predictions(spark, sf_dir):
    return _models(spark, sf_dir).regressed().select("post_id", "num_comments", "prediction")


@query("m10_regression_metrics")
def regression_metrics(spark, sf_dir):
    return models.regression_metrics(_models(spark, sf_dir).regressed())


@query("m11_prediction_sample")
def prediction_sample(spark, sf_dir):
    return models.prediction_sample(_models(spark, sf_dir).regressed())


Z = ", ".join(f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 0.0), 6) AS {c}"
              for c in models.profile_features(ENTITIES))


@query("m12_standardised_profiles", f"{sql.TAGGED_POSTS}, {sql.PROFILE} SELECT subreddit, {Z} FROM profile")
def standardised_profiles(spark, sf_dir):
    profile = reactions.forum_profile(tagged_posts(spark, sf_dir), ENTITIES)
    return rounded(models.standardised(profile, models.profile_features(ENTITIES)))


@query("m13_scaled_features", f"{sql.TAGGED_POSTS}, {sql.PROFILE} SELECT subreddit, {Z} FROM profile")
def scaled_features(spark, sf_dir):
    """The vector that the clusters are fitted on, as columns."""
    scaled = _forums(spark, sf_dir).assigned.select("subreddit", vector_to_array("km_features").alias("z"))
    return rounded(scaled.select("subreddit", *(
        F.get("z", F.lit(i)).alias(c) for i, c in enumerate(models.profile_features(ENTITIES)))))


@query("m15_clustered_forums", f"{sql.TAGGED_POSTS}, {sql.PROFILE} SELECT subreddit, post_count, true AS numbered FROM profile")
def clustered_forums(spark, sf_dir):
    forums = _forums(spark, sf_dir)
    return forums.table().select("subreddit", "post_count", F.col("cluster").between(0, forums.k - 1).alias("numbered"))


#: A labelling that no fit decides: by the number in the forum's name.
FIXED_CLUSTER = "CAST(substr(subreddit, 4) AS INTEGER) % 2"


@query("t06_fixed_summary", f"""{sql.TAGGED_POSTS}, {sql.PROFILE}
SELECT {FIXED_CLUSTER} AS cluster, count(*) AS forums, CAST(sum(post_count) AS BIGINT) AS posts, round(avg(avg_score), 6) AS avg_score,
       round(avg(avg_comments), 6) AS avg_comments FROM profile GROUP BY 1""")
def fixed_summary(spark, sf_dir):
    profile = reactions.forum_profile(tagged_posts(spark, sf_dir), ENTITIES)
    labelled = profile.withColumn("cluster", F.expr(FIXED_CLUSTER))
    return rounded(models.ForumClusters(labelled).summary())


@query("t06_two_key_order", f"""{sql.TAGGED_POSTS}, {sql.PROFILE}
SELECT subreddit, {FIXED_CLUSTER} AS cluster, post_count,
       CAST(row_number() OVER (ORDER BY {FIXED_CLUSTER}, post_count DESC, subreddit) AS INTEGER) AS place FROM profile""")
def two_key_order(spark, sf_dir):
    """The cluster table's order on a fixed labelling: cluster up, size down, ties by name."""
    profile = reactions.forum_profile(tagged_posts(spark, sf_dir), ENTITIES)
    table = models.ForumClusters(profile.withColumn("cluster", F.expr(FIXED_CLUSTER))).table()
    place = F.row_number().over(Window.orderBy("cluster", F.desc("post_count"), "subreddit"))
    return table.select("subreddit", "cluster", "post_count", place.cast("int").alias("place"))


@query("m15_planted_clusters", f"""{sql.TAGGED_POSTS}, {sql.PROFILE}
SELECT subreddit, count(*) OVER (PARTITION BY {FIXED_CLUSTER}) AS alike, true AS own_kind FROM profile""")
def planted_clusters(spark, sf_dir):
    """Forums of two known kinds, far apart in every feature: how many share each one's cluster, and whether all are of its kind."""
    at = (spark.sparkContext.applicationId, f"planted {sf_dir}")
    if at not in _clusters:
        profile = reactions.forum_profile(tagged_posts(spark, sf_dir), ENTITIES)
        number = F.expr("CAST(substr(subreddit, 4) AS INTEGER)")
        far = F.when(F.expr(FIXED_CLUSTER) == 0, 1000).otherwise(0) + number
        planted = profile.select("subreddit", *(far.cast(profile.schema[c].dataType).alias(c) for c in models.profile_features(ENTITIES)))
        _clusters[at] = models.cluster_forums(planted, ENTITIES, k=2)
    found = _clusters[at].table().select("subreddit", "cluster", F.expr(FIXED_CLUSTER).alias("kind"))
    kinds = found.groupBy("cluster").agg(F.count("*").alias("alike"), F.min("kind").alias("low"), F.max("kind").alias("high"))
    return found.join(F.broadcast(kinds), "cluster").select("subreddit", "alike", (F.col("low") == F.col("high")).alias("own_kind"))


DISTANCES = " + ".join(f"(a.{c} - b.{c}) ** 2" for c in models.profile_features(ENTITIES))


@query("m14_silhouette_fixed", f"""{sql.TAGGED_POSTS}, {sql.PROFILE}, scaled AS (SELECT subreddit, {FIXED_CLUSTER} AS side, {Z} FROM profile),
gaps AS (SELECT a.subreddit, a.side AS own, b.side AS other, sum({DISTANCES}) AS total, count(*) AS n
  FROM scaled a JOIN scaled b ON true GROUP BY ALL),
widths AS (SELECT subreddit,
    max(CASE WHEN own = other THEN total / nullif(n - 1, 0) END) AS a, min(CASE WHEN own <> other THEN total / n END) AS b FROM gaps GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM widths
HAVING count(b) > 0""")
def silhouette_fixed(spark, sf_dir):
    """The silhouette of the scaled profiles under a labelling that no fit decides."""
    columns = models.profile_features(ENTITIES)
    profile = stage(reactions.forum_profile(tagged_posts(spark, sf_dir), ENTITIES), "fixed-profiles")
    scaled = models.standardised(profile, columns)
    sides = profile.select("subreddit", F.expr(FIXED_CLUSTER).alias("cluster"))
    vectors = rounded(scaled).withColumn("km_features", array_to_vector(F.array(*columns))).select("subreddit", "km_features")
    value = models.ForumClusters(vectors.join(sides, "subreddit")).silhouette()
    rows = vectors.groupBy().agg(F.lit(value).cast("double").alias("silhouette"))
    return rounded(rows.where("silhouette is not null"), 4)


@query("m13_cluster_features")
def cluster_features(spark, sf_dir):
    return _forums(spark, sf_dir).assigned.select(
        "subreddit", vector_to_array("km_features").alias("km_features"), "cluster")


@query("m14_silhouette")
def silhouette(spark, sf_dir):
    clusters = _forums(spark, sf_dir)
    return clusters.summary().agg(F.count("*").alias("clusters"), F.sum("forums").alias("forums")).withColumn(
        "silhouette", F.lit(clusters.silhouette()).cast("double"))


@query("m15_cluster_table")
def cluster_table(spark, sf_dir):
    return _forums(spark, sf_dir).table()


@query("t06_cluster_summary")
def cluster_summary(spark, sf_dir):
    return _forums(spark, sf_dir).summary()


@query("m16_model_summary")
def model_summary(spark, sf_dir):
    return models.model_summary(_models(spark, sf_dir), _forums(spark, sf_dir))


@query("m17_metric_tables")
def metric_tables(spark, sf_dir):
    fitted = _models(spark, sf_dir)
    return models.classification_metrics(fitted.classified()).unionByName(
        models.regression_metrics(fitted.regressed()))
