"""Entity mentions from a dictionary of any size.

``features.add_mentions`` tests every text once for each entity, which suits a handful. Here the entities'
terms are a table: texts are split once, a term is found by its first word, and what follows is compared
with whole terms. The result is that of ``EntityPattern.regex``: a term counts in any case, where no
part of a word touches its ends.

Texts and terms are split alike, into words and single other characters ("pieces"). Wherever a term occurs
between word edges, its pieces are a run of the text's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions.scale import broadcast_if_small, stage
from murmur.functions.words import explode_terms
from murmur.specs import WORD_CLASS, EntityPattern

PIECE = rf"[{WORD_CLASS}]+|[^{WORD_CLASS}]"
_WORD = rf"^[{WORD_CLASS}]"

#: The most bits of the bitmap that texts are compared with.
SIEVE_BITS = 1 << 25


def term_table(spark: SparkSession, entities: Sequence[EntityPattern]) -> DataFrame:
    """The terms of a list of entities: ``(entity, term)``."""
    return spark.createDataFrame([(e.name, t) for e in entities for t in e.terms], "entity string, term string")


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(PIECE), F.lit(0))


def _is_word(piece: Column) -> Column:
    return F.coalesce(F.rlike(piece, F.lit(_WORD)), F.lit(False))


def _dictionary(terms: DataFrame, entity_col: str, term_col: str) -> DataFrame:
    """Each term once for each entity: its text, its anchor piece, the pieces before that, and the number of all.

    The anchor is the first word, or the first piece of a term without one.
    """
    split = terms.select(F.col(entity_col).alias("entity"), _pieces(F.col(term_col)).alias("_term")).where(F.size("_term") > 0)
    at = F.array_position(F.transform("_term", _is_word), F.lit(True)).cast("int")
    placed = split.withColumn("_before", F.greatest(at - 1, F.lit(0)))
    return placed.select(
        "entity", F.array_join("_term", "").alias("_phrase"), F.get("_term", F.col("_before")).alias("_anchor"), "_before",
        F.size("_term").alias("_size")).distinct()


def _sieve(dictionary: DataFrame, terms: int) -> tuple[Column, int]:
    """A bitmap of the hashes of all phrases and of all anchors with their shapes, as one array of longs, and its number of bits.

    It has room for the dictionary up to ``SIEVE_BITS``. A larger one fills it further, so that more goes on to the join, which decides.
    """
    bits = min(SIEVE_BITS, 1 << max(10, (16 * terms).bit_length()))
    hashes = F.array(_phrase_hash(F.col("_phrase")), _shape_hash(F.col("_anchor"), F.col("_before"), F.col("_size")))
    slots = dictionary.select(F.explode(hashes).alias("_hash")).select(F.pmod("_hash", F.lit(bits)).alias("_slot"))
    marked = slots.groupBy(F.expr("_slot div 64").alias("_at")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_slot % 64 AS INT))")).alias("_word"))
    empty = dictionary.sparkSession.range(bits // 64).select(F.col("id").alias("_at"), F.lit(0).cast("long").alias("_word"))
    words = marked.unionByName(empty).groupBy("_at").agg(F.bit_or("_word").alias("_word"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_word"))), lambda w: w["_word"])
    return stage(words.agg(listed.alias("_words")), "mention-sieve").scalar(), bits


def _phrase_hash(phrase: Column) -> Column:
    return F.xxhash64(phrase)


def _shape_hash(anchor: Column, before: Column, size: Column) -> Column:
    return F.xxhash64(anchor, before.cast("int"), size.cast("int"))


def mention_rows(df: DataFrame, key: str, text_col: str, terms: DataFrame,
                 entity_col: str = "entity", term_col: str = "term") -> DataFrame:
    """Which entities each text mentions: ``(key, entity)``, each pair once.

    ``key`` is unique. Texts without a mention, NULL texts, NULL or empty terms and NULL entities give no row.

    A word that begins a great many terms costs a text no more than one that begins a few: a bitmap of the dictionary says
    of each anchor which shapes of terms (pieces before it, pieces in all) to try there, then of what stands there whether
    it may be a term. Only what passes leaves the row, so what is shuffled follows the mentions, not the words. It is joined
    with the terms themselves, which are broadcast where they are measured to be small.
    """
    dictionary = stage(_dictionary(terms.where(F.col(entity_col).isNotNull()), entity_col, term_col), "mention-terms")
    shapes = dictionary.groupBy("_before", "_size").agg(
        F.count("*").alias("n"), F.max(~_is_word(F.col("_anchor"))).alias("wordless")).orderBy("_before", "_size").collect()
    if not shapes:
        return df.select(key, F.lit(None).cast("string").alias("entity")).limit(0)
    before, behind = max(s["_before"] for s in shapes), max(s["_size"] - s["_before"] for s in shapes)
    sieve, bits = _sieve(dictionary, sum(s["n"] for s in shapes))
    phrases = broadcast_if_small(dictionary.select("_phrase", "entity"))

    def marked(hashed: Column) -> Column:
        slot = F.pmod(hashed, F.lit(bits))
        return F.getbit(F.get(sieve, F.shiftright(slot, 6).cast("int")), F.pmod(slot, F.lit(64)).cast("int")) == 1

    # one NULL piece on each side more than a term can reach
    pad = lambda n: F.array_repeat(F.lit(None).cast("string"), n)
    texts = df.where(F.col(text_col).isNotNull()).select(F.col(key).alias("_key"), _pieces(F.col(text_col)).alias("_pieces"))
    texts = texts.select("_key", F.concat(pad(before + 1), F.col("_pieces"), pad(behind)).alias("_pieces"))
    anchors = F.sequence(F.lit(before + 1), F.greatest(F.lit(before + 1), F.size("_pieces") - behind - 1))
    if not any(s["wordless"] for s in shapes):
        anchors = F.filter(anchors, lambda i: _is_word(F.get("_pieces", i)))
    windows = F.transform(anchors, lambda i: F.slice("_pieces", i - before, before + behind + 2))
    tokens = explode_terms(texts.select("_key", windows.alias("_windows")), "_windows", "_window")
    tokens = tokens.select("_key", "_window", F.get("_window", F.lit(before + 1)).alias("_anchor"))

    def run(at: int, size: int) -> Column:
        """What stands at the anchor in one shape, if it may be a term."""
        first = before + 1 - at
        whole = ~_is_word(F.get("_window", F.lit(first - 1))) & ~_is_word(F.get("_window", F.lit(first + size)))
        phrase = F.array_join(F.slice("_window", first + 1, size), "") if size > 1 else F.get("_window", F.lit(first))
        return F.when(marked(_shape_hash(F.col("_anchor"), F.lit(at), F.lit(size))) & whole, phrase)

    tried = tokens.select("_key", F.explode(F.array(*(run(s["_before"], s["_size"]) for s in shapes))).alias("_phrase"))
    candidates = tried.where(F.col("_phrase").isNotNull() & marked(_phrase_hash(F.col("_phrase"))))
    return candidates.join(phrases, "_phrase").select(F.col("_key").alias(key), "entity").distinct()


def mention_totals(mentions: DataFrame) -> DataFrame:
    """How many texts mention each entity: ``(entity, mentions)``, most first."""
    return mentions.groupBy("entity").agg(F.count("*").alias("mentions")).orderBy(F.desc("mentions"), "entity")


def with_entities(df: DataFrame, key: str, mentions: DataFrame, output: str = "entities") -> DataFrame:
    """The rows of ``df`` with the sorted names of the entities that each mentions, an empty array where none is."""
    lists = mentions.groupBy(F.col(key).alias("_key")).agg(F.array_sort(F.collect_list("entity")).alias("_entities"))
    joined = df.join(lists, df[key] == lists["_key"], "left")
    return joined.select(*(df[c] for c in df.columns), F.coalesce("_entities", F.array().cast("array<string>")).alias(output))
