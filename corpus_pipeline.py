"""From raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives a frame that is written as Parquet and reread as the
next stage's ``docs``. All but the last give the columns of ``docs``, whatever they are: a document is
``doc_id``, ``text`` and what else its row has. Empty tables pass through every stage.

SQL can't express the stages (compression, sketches, merges), so there is no ``ORACLE_SQL``; the tests
hold each stage against a plain-Python version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.scale import broadcast_if_small, stage
from murmur.llm import bpe, decontaminate, langid, neardup, quality
from murmur.llm.queries import table, tokenizer_text

ROW, IDENTITY = "row", "identity"


def _packed(docs: DataFrame) -> DataFrame:
    """All columns as one, so that none clashes with what an operator adds."""
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias(ROW), docs["text"].alias("text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: NULL texts, texts without a letter, narrow margins."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(_packed(docs), model, keep=[ROW]).where("accepted").select(f"{ROW}.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail a rule of the strict policy. NULL texts and those without a word have too few words, and go."""
    return quality.ledger(_packed(docs), keep=[ROW]).where(~quality.fails(quality.STRICT)).select(f"{ROW}.*")


def _identity(docs: DataFrame) -> Column:
    """A row's own name: a digest of all its columns. A ``doc_id`` may be missing or stand on several texts."""
    packed = F.to_json(F.struct(*(docs[c] for c in docs.columns)), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(packed.cast("binary"), 256)).alias(IDENTITY)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*(docs[c] for c in docs.columns)).alias(ROW), _identity(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The one with the least ``doc_id`` stays; a NULL comes after all others, and rows of one ``doc_id`` in the order of their
    digests. Rows that are equal in every column are one document. Documents without a word are in no group and all stay.
    """
    order = F.struct(docs["doc_id"].isNull().alias("missing"), docs["doc_id"].alias("doc_id"), _identity(docs))
    grouped = neardup.groups(docs.select(order.alias("key"), docs["text"].alias("text")), neardup.Settings(width=5, percent=80), "key")
    judged = stage(grouped.select(f"key.{IDENTITY}", "n_shingles", "kept"), "near_dedup-judged")
    dropped = judged.where("not kept").select(IDENTITY).distinct()
    rest = _named(docs).join(broadcast_if_small(dropped), IDENTITY, "left_anti")
    repeated = stage(judged.where("kept and n_shingles > 0").groupBy(IDENTITY).agg(F.count("*").alias("n")).where("n > 1").select(IDENTITY),
                     "near_dedup-repeated")
    if not repeated.isEmpty():
        again = broadcast_if_small(repeated)
        rest = rest.join(again, IDENTITY, "left_anti").unionByName(rest.join(again, IDENTITY, "left_semi").distinct())
    return rest.select(f"{ROW}.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark, or one with other numbers, names or units.

    Rows are dropped, not ``doc_id``s: another text of the same ``doc_id`` stays, and a NULL one saves no row.
    """
    keyed = docs.select(_identity(docs), docs["text"].alias("text"))
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), key_col=IDENTITY)
    dropped = stage(found.select(IDENTITY).distinct(), "decontamination-found")
    return _named(docs).join(broadcast_if_small(dropped), IDENTITY, "left_anti").select(f"{ROW}.*")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: ``doc_id``, ``n_tokens``, ``ids`` (unsigned 32-bit, little-endian). NULL and empty texts have none."""
    vocabulary = tokenizer_text()
    return bpe.encode(docs, vocabulary, bpe.build_lexicon(docs, vocabulary)).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_encoding", bpe_encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
