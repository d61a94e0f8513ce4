"""Distinctive words of groups of texts: TF-IDF over unigrams and bigrams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from murmur.functions.scale import broadcast_if_small, nth_largest, stage
from murmur.functions.words import ENGLISH_STOP_WORDS, explode_terms, with_bigrams, without, word_runs
from murmur.specs import Calendar, EntityPattern

#: Bigrams are first counted by so many hash buckets.
BUCKETS = 1 << 18


def period_groups(calendar: Calendar) -> dict[str, Column]:
    return {label: F.col("event_period") == label for label in calendar.labels}


def entity_groups(entities: Sequence[EntityPattern]) -> dict[str, Column]:
    return {e.name: F.col(e.flag) for e in entities}


def _group_words(df: DataFrame, text_col: str, groups: Mapping[str, Column], stop_words: Sequence[str]) -> DataFrame:
    """Words of each text of a group: a 0/1 flag per group and ``_words``."""
    flags = [f"_g{i}" for i in range(len(groups))]
    texts = df.where(F.col(text_col).isNotNull()).select(
        *(F.coalesce(test, F.lit(False)).cast("long").alias(flag) for flag, test in zip(flags, groups.values())),
        text_col,
    )
    in_any = reduce(lambda a, b: a | b, (F.col(flag) > 0 for flag in flags), F.lit(False))
    return (
        texts.where(in_any)
        .select(*flags, word_runs(F.col(text_col)).alias("_runs"))
        .select(*flags, without("_runs", stop_words).alias("_words"))
    )


def _summed(terms: DataFrame, groups: Mapping[str, Column]) -> DataFrame:
    sums = [F.sum(f"_g{i}").alias(name) for i, name in enumerate(groups)]
    return terms.groupBy("term").agg(*sums) if sums else terms.select("term").distinct()


def term_counts(
    df: DataFrame,
    text_col: str,
    groups: Mapping[str, Column],
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """How often each term occurs in each group: ``term`` and one count column per group.

    ``groups`` maps a name to a membership test, so a text may belong to several
    groups without being copied. Counting all groups side by side takes one
    shuffle, of per-task totals. Bigrams do not run from one text into the next. Without a group there is no term.
    """
    words = _group_words(df, text_col, groups, stop_words)
    flags = [c for c in words.columns if c != "_words"]
    return _summed(explode_terms(words.select(*flags, with_bigrams("_words").alias("_terms")), "_terms"), groups)


def leading_term_counts(
    df: DataFrame,
    text_col: str,
    groups: Mapping[str, Column],
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    max_features: int = 500,
    min_df: int = 1,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``term_counts`` of all terms that may be among the ``max_features`` most frequent; no other is counted in full.

    Texts are split into words once, and the words staged. A first pass counts single words, and bigrams by the bucket that
    their hash falls into, so that its shuffle does not grow with the number of different bigrams. Let T be the total of the
    word in place ``max_features``. A bigram is no more frequent than its bucket, so where that totals less than T the
    bigram does too, and that many words come before it. A second pass counts the bigrams of the other buckets
    exactly. With fewer words than ``max_features``, every term is counted.
    """
    words = stage(_group_words(df, text_col, groups, stop_words), "keyword-words")
    flags = [c for c in words.columns if c != "_words"]
    if not flags:
        return term_counts(df, text_col, groups, stop_words)
    bucket = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")
    ahead = F.slice("_words", F.lit(2), F.greatest(F.size("_words"), F.lit(1)))
    singles = F.transform("_words", lambda w: F.struct(w.alias("term"), F.lit(None).cast("int").alias("bucket")))
    pairs = F.filter(F.zip_with("_words", ahead, lambda a, b: F.struct(
        a.alias("a"), b.alias("b"), F.when(b.isNotNull(), bucket(a, b)).alias("bucket"))), lambda p: p["b"].isNotNull())
    paired = F.transform(pairs, lambda p: F.struct(F.lit(None).cast("string").alias("term"), p["bucket"].alias("bucket")))
    first = stage(
        explode_terms(words.select(*flags, F.concat(singles, paired).alias("_terms")), "_terms", "_t")
        .groupBy("_t.term", "_t.bucket").agg(*(F.sum(f).alias(g) for f, g in zip(flags, groups))), "keyword-totals")
    counted = [F.col(g) for g in groups]
    total = reduce(lambda a, b: a + b, counted)
    present = reduce(lambda a, b: a + b, ((c > 0).cast("int") for c in counted))
    known = first.where(F.col("term").isNotNull()).select("term", *groups)
    bound = nth_largest(known.where(present >= min_df).select(total.alias("_total")), "_total", max_features) or 0
    reaching = broadcast_if_small(first.where(F.col("bucket").isNotNull() & (total >= bound)).select("bucket"))
    kept = explode_terms(words.select(*flags, pairs.alias("_pairs")), "_pairs", "_p").join(
        reaching, F.col("_p.bucket") == F.col("bucket"), "left_semi")
    exact = _summed(kept.select(*flags, F.concat("_p.a", F.lit(" "), "_p.b").alias("term")), groups)
    return known.unionByName(exact).where(total >= bound)


def tfidf(counts: DataFrame, max_features: int = 500, min_df: int = 1) -> DataFrame:
    """TF-IDF of the most frequent terms: ``(group, term, tf, df, tfidf)``.

    ``counts`` is the output of ``term_counts``; each of its count columns is one
    document. The vocabulary is the ``max_features`` terms with the highest
    overall counts. Inverse document frequency is smoothed,
    ``ln((1 + n) / (1 + df)) + 1``, and each document has unit L2 norm.
    """
    groups = [c for c in counts.columns if c != "term"]
    counted = [F.col(g) for g in groups]
    total = reduce(lambda a, b: a + b, counted)
    present = reduce(lambda a, b: a + b, ((c > 0).cast("int") for c in counted))
    vocabulary = (
        counts.withColumns({"_total": total, "_df": present})
        .where(F.col("_df") >= min_df)
        .orderBy(F.desc("_total"), "term")
        .limit(max_features)
    )
    cells = F.array(*(F.struct(F.lit(g).alias("group"), c.alias("tf")) for g, c in zip(groups, counted)))
    idf = F.log(F.lit(1.0 + len(groups)) / (1 + F.col("_df"))) + 1
    weighted = (
        vocabulary.select("term", "_df", idf.alias("_idf"), F.explode(cells).alias("_cell"))
        .select("term", "_df", F.col("_cell.group").alias("group"), F.col("_cell.tf").alias("tf"),
                (F.col("_cell.tf") * F.col("_idf")).alias("_weight"))
        .where(F.col("tf") > 0)
    )
    norm = F.sqrt(F.sum(F.col("_weight") * F.col("_weight")).over(Window.partitionBy("group")))
    return weighted.select(
        "group", "term", "tf", F.col("_df").alias("df"), (F.col("_weight") / norm).alias("tfidf"))


def top_keywords(scored: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` heaviest terms of each group, weights rounded to four places."""
    leading = Window.partitionBy("group").orderBy(F.desc(F.round("tfidf", 9)), "term")
    return (
        scored.withColumn("position", F.row_number().over(leading))
        .where(F.col("position") <= n)
        .select("group", "position", "term", F.round("tfidf", 4).alias("tfidf"))
        .orderBy("group", "position")
    )
