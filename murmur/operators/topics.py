"""Topic modelling of texts: the online LDA of Spark ML, fitted in blocks of texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import LDA, LDAModel, LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.package import ship
from murmur.functions.scale import nth_largest, scratch_path, stage, steady
from murmur.functions.variational import Statistics, log_expectation, trigamma
from murmur.functions.words import ENGLISH_STOP_WORDS, blank_separated, explode_terms, without


def tokenise(df: DataFrame, text_col: str, key: str, keep: Sequence[str] = (),
             stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """Lower-cased tokens of each non-NULL text without stop words: ``key``, kept columns, ``tokens``."""
    words = df.where(F.col(text_col).isNotNull()).select(key, *keep, blank_separated(F.col(text_col)).alias("_words"))
    return words.select(key, *keep, without("_words", stop_words).alias("tokens"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """Corpus frequency (``tf``) and number of texts (``df``) of every term.

    Each text's tokens are sorted in place, so the first of each run of equals
    marks the text once; both counts then need a single shuffle.
    """
    in_order = tokens.select(F.array_sort("tokens").alias("_sorted"))
    marked = F.transform("_sorted", lambda t, i: F.struct(
        t.alias("term"), (~F.equal_null(t, F.get("_sorted", i - 1))).alias("first")))
    return (
        explode_terms(in_order.select(marked.alias("_marked")), "_marked", "_t")
        .groupBy(F.col("_t.term").alias("term"))
        .agg(F.count("*").alias("tf"), F.count_if("_t.first").alias("df"))
    )


def vocabulary_table(tokens: DataFrame, size: int = 3000, min_df: int = 5) -> DataFrame:
    """The ``size`` most frequent terms found in at least ``min_df`` texts, ties in term order.

    The terms are counted once and staged. The frequency that the last of them has is found from counts of counts, so what is put in
    order is the vocabulary and the terms tied with its last.
    """
    counted = stage(token_counts(tokens).where(F.col("df") >= min_df), "token-counts")
    bound = nth_largest(counted, "tf", size)
    reaching = counted if bound is None else counted.where(F.col("tf") >= bound)
    return reaching.orderBy(F.desc("tf"), "term").limit(size)


@dataclass
class TopicModel:
    """A fitted LDA model with its vocabulary and the texts it was fitted on."""

    model: LDAModel
    vocabulary: list[str]
    texts: DataFrame

    def quality(self) -> DataFrame:
        """Log likelihood and log perplexity: ``(metric, value)``; texts without a vocabulary word have neither.

        The perplexity is minus the likelihood over the number of words, so the bound is computed once.
        """
        likelihood = self.model.logLikelihood(self.texts)
        words = self.texts.agg(F.sum(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, b: a + b))).first()[0]
        return self.texts.sparkSession.createDataFrame(
            [("log_likelihood", likelihood), ("log_perplexity", -likelihood / words if words else None)],
            "metric string, value double")

    def topic_words(self, n: int = 10) -> DataFrame:
        """The ``n`` heaviest words of each topic: ``(topic, position, word, weight)``."""
        words = F.lit(self.vocabulary)
        pairs = F.arrays_zip("termIndices", "termWeights")
        return (
            self.model.describeTopics(maxTermsPerTopic=n)
            .select("topic", F.posexplode(pairs).alias("position", "_p"))
            .select("topic", "position", F.get(words, F.col("_p.termIndices")).alias("word"),
                    F.round("_p.termWeights", 4).alias("weight"))
            .orderBy("topic", "position")
        )

    def mixtures(self) -> DataFrame:
        """The fitted texts with their topic distribution."""
        return self.model.transform(self.texts)


def fit_topics(
    df: DataFrame,
    text_col: str,
    key: str,
    keep: Sequence[str] = (),
    k: int = 6,
    max_iter: int = 20,
    seed: int = 42,
    vocab_size: int = 3000,
    min_df: int = 5,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    partitions: int | None = None,
    subsampling: float = 1.0,
) -> TopicModel:
    """Fit LDA on all texts: the model of Spark's own fit, see ``fit_online``.

    Each iteration of the online optimiser draws ``subsampling`` times as many texts as there are,
    with replacement. With the default of 1 an iteration costs a pass over the counts, and one text in e to the power
    ``max_iter`` is never drawn; a lower share costs less and leaves more texts out.

    The result repeats for the same ``partitions``: the vocabulary has a total
    order and every partition holds the same texts in the same order.
    """
    tokens = tokenise(df, text_col, key, keep, stop_words)
    # At most vocab_size terms come to the driver, as in any CountVectorizer fit.
    terms = [row.term for row in vocabulary_table(tokens, vocab_size, min_df).select("term").collect()]
    if not terms:
        raise ValueError(f"no term occurs in {min_df} texts")
    counter = CountVectorizerModel.from_vocabulary(terms, inputCol="tokens", outputCol="features")
    texts = stage(counter.transform(tokens).drop("tokens"), "lda-texts")
    lda = LDA(k=k, maxIter=max_iter, seed=seed, featuresCol="features", subsamplingRate=subsampling,
              topicDistributionCol="topic_dist")
    return TopicModel(fit_online(lda, steady(texts, key, partitions)), terms, texts)


def fit_online(lda: LDA, texts: DataFrame) -> LocalLDAModel:
    """The model that ``lda`` with its online optimiser fits on ``texts``, whose ``featuresCol`` holds sparse counts.

    A pass draws texts as Spark's own fit does, with the same seeds, and takes the same steps; but the partitions' texts are worked
    on in blocks, a text drawn several times in a pass once, and what they tell of each word is summed by a shuffle. The driver
    holds the topics' words. The result is that of ``lda.fit`` but for rounding (for a ``subsamplingRate`` up to 0.4, other texts are drawn).
    """
    spark, passes, k = texts.sparkSession, lda.getMaxIter(), lda.getK()
    share, decay, offset = lda.getSubsamplingRate(), lda.getLearningDecay(), lda.getLearningOffset()
    random = spark._jvm.java.util.Random(lda.getSeed())
    seeds = [random.nextLong() for _ in range(2 * passes + 2)]  # topics; texts and mixtures of each pass; transform
    features = F.unwrap_udt(lda.getFeaturesCol())
    numbered = texts.select(
        F.monotonically_increasing_id().alias("id"), features["indices"].alias("slots"), features["values"].alias("counts"),
        features["size"].alias("vocabulary")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        size, partitions, vocabulary = numbered.agg(
            F.count("*"), F.max(F.shiftright("id", 33)) + 1, F.max("vocabulary")).first()
        empty = spark.createDataFrame([(Vectors.sparse(vocabulary, {}),)], [lda.getFeaturesCol()])
        model = lda.fit(empty, {lda.maxIter: 0})  # the topics to begin with depend on the seed alone
        topics, alpha = model.topicsMatrix().toArray().T, model.estimatedDocConcentration().toArray()
        eta = lda.getTopicConcentration() if lda.isDefined(lda.topicConcentration) else 1 / k
        used = 1
        for step in range(1, passes + 1):
            weights = np.exp(log_expectation(topics))
            starts = np.array([_start(spark, seeds[used + 1] + p, k) for p in range(partitions)])
            found, mixtures, drawn, counted = _pass(numbered.sample(True, share, seeds[used]), weights, alpha, starts)
            if not drawn:
                used += 1
                continue
            used += 2
            if not counted:
                continue
            rate = (offset + step) ** -decay
            topics = (1 - rate) * topics + rate * (found * weights * (size / np.ceil(share * size)) + eta)
            if lda.getOptimizeDocConcentration():
                alpha = _next_alpha(alpha, mixtures / counted, counted, rate)
    finally:
        numbered.unpersist()
    return _with_topics(spark, model, topics, alpha, passes).setSeed(seeds[used])


def _start(spark: SparkSession, seed: int, k: int) -> list[float]:
    """What the mixtures of a partition's texts begin with: numbers around one, from the generator that Spark's fit uses."""
    math3 = spark._jvm.org.apache.commons.math3
    seed = (seed + (1 << 63)) % (1 << 64) - (1 << 63)
    shape = 100.0
    return list(math3.distribution.GammaDistribution(math3.random.MersenneTwister(seed), shape, 1 / shape, 1e-9).sample(k))


#: Words of drawn texts that a task holds at once, give or take a batch: 12 bytes each.
GROUP_WORDS = 1 << 21


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """The first three columns of some batches at a time, the second a list of words: the more texts, the fewer half-empty blocks."""
    held, words = [], 0
    for batch in batches:
        held.append(batch)
        words += len(batch.column(1).flatten())
        if words >= GROUP_WORDS:
            yield [pa.concat_arrays([b.column(i) for b in held]) for i in range(3)]
            held, words = [], 0
    if sum(map(len, held)):
        yield [pa.concat_arrays([b.column(i) for b in held]) for i in range(3)]


def _pass(drawn: DataFrame, weights: np.ndarray, alpha: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """What the drawn texts tell: of each topic's words, of the mixtures, how many there are, and how many with words.

    A partition's rows are one for each of its words and one, with slot -1, for all its texts.
    """
    spark, k = drawn.sparkSession, len(alpha)
    ship(spark)
    sent = spark.sparkContext.broadcast((weights, alpha, starts))
    sums = [f"s{j}" for j in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, alpha, starts = sent.value
        told, drawn = None, 0
        for ids, slots, counts in _groups(batches):
            ids = ids.to_numpy()
            told = told or Statistics(weights, alpha, starts[ids[0] >> 33])
            first = np.flatnonzero(np.diff(ids, prepend=-1))  # copies of a text come one after the other
            times = np.diff(first, append=len(ids)).astype(float)
            ends = slots.offsets.to_numpy().astype(np.int64)
            base = ends[0]
            told.add(slots.flatten().to_numpy(), counts.flatten().to_numpy(), ends[first] - base, ends[first + 1] - base, times)
            drawn += len(ids)
        if told:
            seen = np.flatnonzero(told.words.any(axis=0))
            columns = np.column_stack((told.mixtures, told.words[:, seen]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(-1, seen), pa.int32()), *(pa.array(a) for a in columns),
                 *(pa.array(np.append(n, 0 * seen), pa.int64()) for n in (drawn, told.texts))],
                names=["slot", *sums, "drawn", "texts"])

    schema = f"slot int, {', '.join(f'{s} double' for s in sums)}, drawn long, texts long"
    rows = drawn.mapInArrow(run, schema).groupBy("slot").agg(*(F.sum(c).alias(c) for c in (*sums, "drawn", "texts"))).collect()
    sent.destroy()
    found, mixtures, number, counted = np.zeros_like(weights), np.zeros(k), 0, 0
    for slot, *values, n, texts in rows:
        if slot < 0:
            mixtures, number, counted = np.array(values), n, texts
        else:
            found[:, slot] = values
    return found, mixtures, number, counted


def _next_alpha(alpha: np.ndarray, log_mixture: np.ndarray, texts: int, rate: float) -> np.ndarray:
    """One Newton step, at this rate, towards the concentration that makes the texts' mixtures likely; none out of the positive range."""
    gradient = texts * (log_mixture - log_expectation(alpha))
    c, q = texts * trigamma(alpha.sum()), -texts * trigamma(alpha)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    moved = alpha - rate * (gradient - b) / q
    return moved if (moved > 0).all() else alpha


def _with_topics(spark: SparkSession, model: LocalLDAModel, topics: np.ndarray, alpha: np.ndarray, passes: int) -> LocalLDAModel:
    """A model like this with other topics, by way of its saved form."""
    old, new = scratch_path(spark, "lda-start"), scratch_path(spark, "lda-fitted")
    model.set(model.maxIter, passes)
    model.save(old)
    spark.read.text(f"{old}/metadata").coalesce(1).write.text(f"{new}/metadata")
    data = spark.read.parquet(f"{old}/data")
    values = data.first().asDict() | {
        "topicsMatrix": DenseMatrix(topics.shape[1], len(topics), topics.ravel()), "docConcentration": Vectors.dense(alpha)}
    spark.createDataFrame([tuple(values[c] for c in data.columns)], data.schema).coalesce(1).write.parquet(f"{new}/data")
    return LocalLDAModel.load(new)


def topic_mix(mixtures: DataFrame, group_col: str = "event_period") -> DataFrame:
    """Average weight of each topic per group: ``(group, topic, texts, weight)``.

    Texts without any vocabulary word have no mixture and do not count.
    """
    weights = mixtures.select(group_col, vector_to_array("topic_dist").alias("_weights"))
    return (
        weights.where(F.array_max("_weights") > 0)
        .select(group_col, F.posexplode_outer("_weights").alias("topic", "_weight"))
        .groupBy(group_col, "topic")
        .agg(F.count("*").alias("texts"), F.avg("_weight").alias("weight"))
        .orderBy(group_col, "topic")
    )
