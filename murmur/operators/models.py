"""Engagement models and forum clusters with Spark ML."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.scale import broadcast_if_small, stage, steady
from murmur.operators.features import flags_to_int, threshold_label
from murmur.operators.reactions import hash_sample
from murmur.specs import EntityPattern

TIME_FEATURES = ["hour_of_day", "day_of_week", "month_num"]
CATEGORIES = ["subreddit", "event_period"]
LABEL = "high_engagement"
BUCKETS = 1024
SLOTS = 1024


# Features, labels and split

def numeric_features(entities: Sequence[EntityPattern]) -> list[str]:
    return [*TIME_FEATURES, *(e.flag for e in entities)]


def feature_table(tagged: DataFrame, entities: Sequence[EntityPattern], key: str = "post_id") -> DataFrame:
    """Model inputs and targets of each complete row; mention flags become 0/1.

    Rows are put in an array of one and taken out again before gaps are looked for: a filter on the flags would be
    pushed below them, and search every text a second time.
    """
    columns = [*numeric_features(entities), *CATEGORIES, "score", "num_comments"]
    rows = tagged.select(F.inline_outer(F.array(F.struct(key, *columns))))
    return flags_to_int(rows.dropna(subset=columns), entities)


def _narrowed(counts: DataFrame, rank: int, low, high, whole: bool) -> tuple[DataFrame, int]:
    """The rows of at most BUCKETS distinct values that hold ``rank``, and the rank among them.

    Each pass counts BUCKETS buckets between the least and the largest value left and keeps the one with the rank. Both
    ends fall into different buckets, so every pass narrows. Whole numbers are cut exactly; the width of
    doubles is taken of both ends apart, as their difference may overflow.
    """
    while low < high:
        inside = counts.where(F.col("v").between(F.lit(low), F.lit(high)))
        if whole:
            width = (high - low) // BUCKETS + 1
            if width == 1:
                return inside, rank
            bucket = F.floor((F.col("v").cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)"))
        else:
            width = high / BUCKETS - low / BUCKETS
            if not width:  # fewer doubles than buckets lie between
                return inside, rank
            bucket = F.floor(F.col("v") / width - low / width)
        # both ends are set apart by hand: rounding must not bring them together
        bucket = F.when(F.col("v") == F.lit(low), -1).when(F.col("v") == F.lit(high), BUCKETS + 1).otherwise(
            F.greatest(F.lit(0), F.least(bucket, F.lit(BUCKETS))))
        rows = (
            inside.groupBy(bucket.cast("long").alias("b"))
            .agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            .orderBy("b").collect()
        )
        for row in rows:
            if rank < row.n:
                low, high = row.low, row.high
                break
            rank -= row.n
    return counts.where(F.col("v") == F.lit(low)), rank


def _value_at(counts: DataFrame, rank: int, low, high, whole: bool) -> tuple[float, int]:
    """The value with ``rank`` rows before it, and how many rows of it come after that rank."""
    few, rank = _narrowed(counts, rank, low, high, whole)
    for row in few.orderBy("v").collect():
        if rank < row.n:
            return row.v, row.n - rank - 1
        rank -= row.n
    raise ValueError("rank beyond the values")


def exact_quantile(df: DataFrame, column: str, probability: float) -> float | None:
    """The exact quantile with linear interpolation; NULLs do not count.

    Values are counted once, spread over the cluster, and located by rank, so
    no task and no driver ever holds all distinct values. Infinities take their places at the ends and NaN
    comes after all, as in Spark's order. Whole numbers are compared as such, not as doubles.
    """
    if not 0 <= probability <= 1:
        raise ValueError("a probability lies between 0 and 1")
    whole = isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    value = F.col(column).cast("long" if whole else "double")
    counts = (
        df.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        ends = [float("-inf"), float("inf"), float("nan")]
        finite = F.lit(True) if whole else ~F.col("v").isin(ends)
        total, inner, low, high, *outer = counts.agg(
            F.sum("n"), F.coalesce(F.sum(F.when(finite, F.col("n"))), F.lit(0)), F.min(F.when(finite, F.col("v"))),
            F.max(F.when(finite, F.col("v"))),
            *(F.coalesce(F.sum(F.when(F.col("v") == F.lit(e), F.col("n"))), F.lit(0)) for e in ends)).first()
        if not total:
            return None
        inside = counts.where(finite)
        rank = probability * (total - 1)
        first = math.floor(rank)

        def at(position: int) -> tuple[float, int]:
            if not whole:
                for end, start, size in ((ends[0], 0, outer[0]), (ends[1], outer[0] + inner, outer[1]),
                                         (ends[2], outer[0] + inner + outer[1], outer[2])):
                    if start <= position < start + size:
                        return end, start + size - position - 1
                position -= outer[0]
            return _value_at(inside, position, low, high, whole)

        below, more = at(first)
        if rank == first or more:
            return below
        if whole or first + 1 < outer[0] + inner:
            above = inside.where(F.col("v") > F.lit(below)).agg(F.min("v")).first()[0] if below != ends[0] else low
        else:
            above = at(first + 1)[0]
        share = rank - first
        if math.isinf(below) or math.isinf(above) or math.isnan(above):
            return below * (1 - share) + above * share
        return below + share * (above - below) if math.isfinite(above - below) else below * (1 - share) + above * share
    finally:
        counts.unpersist()


def quantile(df: DataFrame, column: str, probability: float, exact: bool = True,
             relative_error: float = 0.01) -> float | None:
    """A quantile of a column, exact or within ``relative_error`` ranks."""
    if exact:
        return exact_quantile(df, column, probability)
    found = df.approxQuantile(column, [probability], relative_error)
    return found[0] if found else None


def _sketch_kind(df: DataFrame, column: str) -> str:
    whole = isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return "bigint" if whole else "double"


def quantile_sketches(df: DataFrame, column: str, by: Sequence[str], k: int = 200) -> DataFrame:
    """A mergeable quantile sketch of a column for each group: ``by``, ``rows``, ``sketch``.

    The sketches are Spark's KLL aggregates, a few hundred times ``k`` bytes each whatever the group's size, so they can be
    saved for each partition and put together later by ``merged_sketches``. Every task sends one for
    each group it has seen. NULLs do not count, nor does NaN; groups without a value have no row.
    A sketch of no more than ``k`` rows is exact; of more, ranks are off by about ``2.3 / k`` of the rows.
    """
    kind = _sketch_kind(df, column)
    value = F.col(column).cast("long") if kind == "bigint" else F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    aggregate = F.kll_sketch_agg_bigint if kind == "bigint" else F.kll_sketch_agg_double
    known = df.select(*by, value.alias("_value")).where(F.col("_value").isNotNull())
    return known.groupBy(*by).agg(F.count("*").alias("rows"), aggregate("_value", k).alias("sketch"))


def merged_sketches(sketches: DataFrame, by: Sequence[str], k: int = 200, kind: str = "bigint") -> DataFrame:
    """Sketches of larger groups from those of their parts; ``kind`` is bigint for whole numbers, else double."""
    merge = F.kll_merge_agg_bigint if kind == "bigint" else F.kll_merge_agg_double
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), merge("sketch", k).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, probabilities: Sequence[float], kind: str = "bigint") -> DataFrame:
    """One row for each group and probability: the least value that at least that share of the rows does not exceed,
    as far as the sketch knows."""
    read = F.kll_sketch_get_quantile_bigint if kind == "bigint" else F.kll_sketch_get_quantile_double
    others = [c for c in sketches.columns if c != "sketch"]
    cells = F.array(*(F.struct(F.lit(p).alias("probability"), read("sketch", F.lit(float(p))).alias("value")) for p in probabilities))
    return sketches.select(*others, F.inline(cells))


def rank_errors(df: DataFrame, column: str, by: Sequence[str], quantiles: DataFrame) -> DataFrame:
    """How far each quantile lies from its exact rank, as a share of the group's rows: ``quantiles`` with ``error``.

    A value stands for all ranks from the share of rows below it to the share of rows up to it; the error is the distance
    from the probability to that span. One pass over the rows, whose counts are summed in each task first.
    """
    wanted = quantiles.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("probability", "value"))).alias("_wanted"))
    value = F.col(column).cast(quantiles.schema["value"].dataType)
    known = df.select(*by, value.alias("_value")).where(F.col("_value").isNotNull())
    pairs = known.join(broadcast_if_small(wanted), list(by)).select(*by, "_value", F.inline("_wanted"))
    counted = pairs.groupBy(*by, "probability", "value").agg(
        F.count_if(F.col("_value") < F.col("value")).alias("_below"), F.count_if(F.col("_value") <= F.col("value")).alias("_upto"),
        F.count("*").alias("_all"))
    p, low, high = F.col("probability"), F.col("_below") / F.col("_all"), F.col("_upto") / F.col("_all")
    errors = counted.select(*by, "probability", F.greatest(F.lit(0.0), low - p, p - high).alias("error"))
    return quantiles.join(errors, [*by, "probability"])


def with_engagement_label(features: DataFrame, probability: float = 0.75, exact: bool = True) -> DataFrame:
    """Label rows whose score reaches the quantile."""
    bound = quantile(features, "score", probability, exact)
    return threshold_label(features, "score", math.inf if bound is None else bound, LABEL)


def class_balance(labelled: DataFrame, label: str = LABEL) -> DataFrame:
    return labelled.groupBy(label).agg(F.count("*").alias("count")).orderBy(label)


def in_training(key: str, share: float = 0.8) -> Column:
    """A split by the hash of the key: the same for any partitioning, and for any engine with md5."""
    bound = min(256, math.ceil(share * 256))
    return F.substring(F.md5(F.col(key).cast("string")), 1, 2) < F.lit(f"{bound:02x}" if bound < 256 else "g")


def split(df: DataFrame, key: str = "post_id", share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    return df.where(in_training(key, share)), df.where(~in_training(key, share))


# Encoding

def encoding_stages(entities: Sequence[EntityPattern]) -> list:
    """Index and one-hot encode the categories, then assemble one feature vector."""
    indexers = [
        StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep",
                      stringOrderType="frequencyDesc") for c in CATEGORIES
    ]
    encoders = [OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_ohe") for c in CATEGORIES]
    assembler = VectorAssembler(
        inputCols=[*numeric_features(entities), *(f"{c}_ohe" for c in CATEGORIES)], outputCol="features")
    return [*indexers, *encoders, assembler]


def fit_encoding(train: DataFrame, entities: Sequence[EntityPattern]) -> PipelineModel:
    return Pipeline(stages=encoding_stages(entities)).fit(train)


def category_slot(name: Column, category: str, slots: int) -> Column:
    """The slot of a category's value, from 0: the same in every run, and for any engine with md5."""
    digest = F.md5(F.concat(F.lit(f"{category}="), name).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def with_category_slots(df: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Add ``<category>_idx``, the slot of each category, and how many there are as the column's metadata.

    The encoder reads the number from there, so it neither scans the rows nor sends an index to the driver, and
    values that were not there when a model was fitted have a slot like any other.
    """
    nominal = {"ml_attr": {"type": "nominal", "num_vals": slots}}
    return df.withColumns({
        f"{c}_idx": category_slot(F.col(c), c, slots).cast("double").alias(f"{c}_idx", metadata=nominal) for c in CATEGORIES})


def category_slots(df: DataFrame, slots: int = SLOTS, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Every value of every category with its slot, and how many values share that: ``(category, name, slot, sharing)``."""
    pairs = F.array(*(F.struct(
        F.lit(c).alias("category"), F.col(c).alias("name"), category_slot(F.col(c), c, slots).alias("slot")) for c in categories))
    names = df.select(F.inline(pairs)).where(F.col("name").isNotNull()).distinct()
    sharing = names.groupBy("category", "slot").agg(F.count("*").alias("sharing"))
    return names.join(sharing, ["category", "slot"]).select("category", "name", "slot", "sharing")


def slot_collisions(placed: DataFrame) -> DataFrame:
    """How many values, used slots, and values that share a slot each category has, from ``category_slots``."""
    return placed.groupBy("category").agg(
        F.count("*").alias("names"), F.sum(1 / F.col("sharing")).alias("_used"), F.count_if(F.col("sharing") > 1).alias("colliding"),
    ).select("category", "names", F.round("_used").cast("long").alias("used_slots"), "colliding").orderBy("category")


def hashed_encoding_stages(entities: Sequence[EntityPattern]) -> list:
    """One-hot encode slots and assemble the feature vector; the input is that of ``with_category_slots``."""
    encoders = [OneHotEncoder(inputCol=f"{c}_idx", outputCol=f"{c}_ohe", dropLast=False) for c in CATEGORIES]
    assembler = VectorAssembler(
        inputCols=[*numeric_features(entities), *(f"{c}_ohe" for c in CATEGORIES)], outputCol="features")
    return [*encoders, assembler]


def metric_table(spark: SparkSession, metrics: Mapping[str, float | None]) -> DataFrame:
    return spark.createDataFrame([(m, None if v is None else float(v)) for m, v in metrics.items()], "metric string, value double")


# Engagement models

@dataclass
class EngagementModels:
    """Encoded rows, a classifier of high engagement and a regressor of comment counts."""

    encoding: PipelineModel
    train: DataFrame
    test: DataFrame
    classifier: object
    regressor: object
    probability: float = 0.75

    def classified(self) -> DataFrame:
        return self.classifier.transform(self.test)

    def regressed(self) -> DataFrame:
        return self.regressor.transform(self.test)


def fit_engagement_models(
    features: DataFrame,
    entities: Sequence[EntityPattern],
    key: str = "post_id",
    probability: float = 0.75,
    trees: int = 50,
    depth: int = 6,
    seed: int = 42,
    partitions: int | None = None,
    encoding: str = "index",
    slots: int = SLOTS,
) -> EngagementModels:
    """Fit both random forests on one shared encoding of the training rows.

    The narrow feature table is staged once, so the texts are scanned a single
    time: the label's quantile, the encoding, both fits and every evaluation read
    the staged rows.

    With ``encoding="index"`` each category is indexed by frequency: the forum index is as long as the list of
    forums, and so is the vector, so filter to a topic first. With ``encoding="hashed"`` categories fall into
    ``slots`` slots each, whatever their number; ``slot_collisions`` tells how many share one.
    """
    if encoding not in ("index", "hashed"):
        raise ValueError("encoding is 'index' or 'hashed'")
    rows = with_engagement_label(stage(features, "engagement-rows"), probability)
    rows = with_category_slots(rows, slots) if encoding == "hashed" else rows
    train, test = split(rows, key)
    stages = hashed_encoding_stages(entities) if encoding == "hashed" else encoding_stages(entities)
    fitted = Pipeline(stages=stages).fit(train)
    encoded = fitted.transform(steady(train, key, partitions)).persist(StorageLevel.MEMORY_AND_DISK)
    forest = {"featuresCol": "features", "numTrees": trees, "maxDepth": depth, "seed": seed}
    try:
        classifier = RandomForestClassifier(labelCol=LABEL, **forest).fit(encoded)
        regressor = RandomForestRegressor(labelCol="num_comments", **forest).fit(encoded)
    finally:
        encoded.unpersist()
    return EngagementModels(fitted, fitted.transform(train), fitted.transform(test), classifier, regressor, probability)


def correct_predictions(predicted: DataFrame, label: str = LABEL) -> DataFrame:
    return predicted.where(F.col("prediction") == F.col(label))


def accuracy(predicted: DataFrame, label: str = LABEL) -> DataFrame:
    """Share of correct predictions, in one pass."""
    return predicted.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))


def classification_metrics(predicted: DataFrame, label: str = LABEL) -> DataFrame:
    """AUC-ROC and accuracy: ``(metric, value)``."""
    auc = BinaryClassificationEvaluator(
        labelCol=label, rawPredictionCol="rawPrediction", metricName="areaUnderROC").evaluate(predicted)
    return metric_table(predicted.sparkSession, {"AUC-ROC": auc, "Accuracy": accuracy(predicted, label).first()[0]})


def regression_metrics(predicted: DataFrame, label: str = "num_comments") -> DataFrame:
    """RMSE and R2 from two rounds of plain aggregates, both lazy."""
    actual = F.col(label).cast("double")
    mean = predicted.agg(F.avg(actual)).scalar()
    pairs = predicted.select(actual.alias("y"), F.col("prediction").alias("p"), mean.alias("m"))
    residual = F.sum((F.col("y") - F.col("p")) ** 2)
    spread = F.sum((F.col("y") - F.col("m")) ** 2)
    sums = pairs.agg(
        F.sqrt(F.try_divide(residual, F.count("*"))).alias("RMSE"), (1 - F.try_divide(residual, spread)).alias("R2"))
    return sums.select(F.inline(F.array(*(
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("RMSE", "R2")))))


def _slots(metadata: dict) -> Iterator[tuple[int, str]]:
    for group in metadata["ml_attr"]["attrs"].values():
        for attribute in group:
            yield attribute["idx"], attribute["name"]


def _source(slot: str, numeric: Sequence[str]) -> str:
    if slot in numeric:
        return slot
    return next(f"{c} (OHE)" for c in CATEGORIES if slot.startswith(f"{c}_ohe_"))


def feature_importances(models: EngagementModels, entities: Sequence[EntityPattern]) -> DataFrame:
    """Importance per source column, smallest first.

    Slots are attributed by the vector's own metadata, so the one-hot widths
    need not be known.
    """
    numeric = numeric_features(entities)
    weights = models.classifier.featureImportances
    totals = {name: 0.0 for name in [*numeric, *(f"{c} (OHE)" for c in CATEGORIES)]}
    for index, slot in _slots(models.train.schema["features"].metadata):
        totals[_source(slot, numeric)] += float(weights[index])
    spark = models.train.sparkSession
    return spark.createDataFrame(list(totals.items()), "feature string, importance double").orderBy(
        "importance", "feature")


def prediction_sample(predicted: DataFrame, n: int = 500, key: str = "post_id") -> DataFrame:
    return hash_sample(predicted.select(key, "num_comments", "prediction"), n, key)


# Forum clusters

def profile_features(entities: Sequence[EntityPattern]) -> list[str]:
    return ["post_count", "avg_score", "avg_comments",
            *(f"{e.name.lower()}_mentions" for e in entities), "avg_post_hour"]


def standardised(profile: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column minus its mean, over its sample standard deviation; 0 where it does not vary."""
    moments = profile.agg(F.struct(*(
        measure(c).alias(f"{c}_{name}") for c in columns
        for name, measure in (("mean", F.avg), ("std", F.stddev_samp))))).scalar()

    def z(column: str) -> Column:
        centred = F.col(column) - moments[f"{column}_mean"]
        return F.coalesce(F.try_divide(centred, moments[f"{column}_std"]), F.lit(0.0))

    return profile.select("subreddit", *(z(c).alias(c) for c in columns))


@dataclass
class ForumClusters:
    """Forums with their scaled features and cluster, and how many clusters were asked for."""

    assigned: DataFrame
    k: int = 4

    def silhouette(self) -> float | None:
        """Squared-Euclidean silhouette; None where all forums share one cluster."""
        if self.assigned.select("cluster").distinct().count() < 2:
            return None
        return ClusteringEvaluator(featuresCol="km_features", predictionCol="cluster").evaluate(self.assigned)

    def table(self) -> DataFrame:
        return self.assigned.select("subreddit", "post_count", "avg_score", "avg_comments", "cluster").orderBy(
            "cluster", F.desc("post_count"), "subreddit")

    def summary(self) -> DataFrame:
        return self.assigned.groupBy("cluster").agg(
            F.count("*").alias("forums"), F.sum("post_count").alias("posts"),
            F.avg("avg_score").alias("avg_score"), F.avg("avg_comments").alias("avg_comments"),
        ).orderBy("cluster")


def cluster_forums(profile: DataFrame, entities: Sequence[EntityPattern], k: int = 4, seed: int = 42,
                   partitions: int | None = None) -> ForumClusters:
    """Group forums by behaviour with k-means on scaled profiles.

    Without a forum nothing can be fitted: the result has the same columns and no rows.
    """
    forums = stage(profile, "forum-profiles")
    assembler = VectorAssembler(inputCols=profile_features(entities), outputCol="km_features_raw")
    if forums.isEmpty():
        raw = assembler.transform(forums)
        return ForumClusters(raw.withColumn("km_features", F.col("km_features_raw")).withColumn("cluster", F.lit(0)), k)
    scaler = StandardScaler(inputCol="km_features_raw", outputCol="km_features", withStd=True, withMean=True)
    kmeans = KMeans(featuresCol="km_features", predictionCol="cluster", k=k, seed=seed)
    model = Pipeline(stages=[assembler, scaler, kmeans]).fit(steady(forums, "subreddit", partitions))
    return ForumClusters(model.transform(forums), k)


METRICS = ("AUC-ROC", "Accuracy", "RMSE", "R2", "Silhouette")

# The wording of the result table.
SUMMARY = {
    "classifier": ("Q8", "RF Classifier", "Predict high engagement (top {top}%)", "AUC={AUC-ROC}, Acc={Accuracy}"),
    "regressor": ("Q9", "RF Regressor", "Predict comment count", "RMSE={RMSE}, R²={R2}"),
    "clusters": ("Q10", "K-Means (k={k})", "Cluster forums by behaviour", "Silhouette={Silhouette}"),
}


def summary_lines(metrics: DataFrame, top: float, k: int) -> DataFrame:
    """One line per model: Question, Model, Task, Result.

    ``metrics`` has rows ``(metric, value)`` named AUC-ROC, Accuracy, RMSE, R2 and Silhouette. A metric that is missing or NULL reads
    "nan", a silhouette "n/a": there is none for want of forums or of a second cluster.
    """
    value = {m: F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in METRICS}
    row = metrics.agg(*value.values())

    def text(name: str) -> Column:
        missing = "n/a" if name == "Silhouette" else "nan"
        places = 2 if name == "RMSE" else 4
        return F.coalesce(F.format_string(f"%.{places}f", F.col(f"`{name}`")), F.lit(missing))

    def filled(template: str) -> Column:
        known = template.replace("{top}", f"{top:g}").replace("{k}", str(k))
        parts = re.split(r"\{(.+?)\}", known)
        return F.concat(*(text(p) if i % 2 else F.lit(p) for i, p in enumerate(parts)))

    lines = F.array(*(F.struct(*(
        filled(part).alias(c) for c, part in zip(("Question", "Model", "Task", "Result"), line))) for line in SUMMARY.values()))
    return row.select(F.inline(lines))


def model_summary(models: EngagementModels, clusters: ForumClusters) -> DataFrame:
    """The lines of ``summary_lines``, all taken from what was fitted."""
    metrics = classification_metrics(models.classified()).unionByName(regression_metrics(models.regressed())).unionByName(
        metric_table(models.train.sparkSession, {"Silhouette": clusters.silhouette()}))
    return summary_lines(metrics, 100 * (1 - models.probability), clusters.k)
