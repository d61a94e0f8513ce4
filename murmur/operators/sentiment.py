"""Sentiment of short texts, following the published VADER rules
(Hutto & Gilbert, ICWSM 2014), as DataFrame expressions.

Each text becomes one row per lexicon word in it, with the five neighbours the
rules look at. Joining the lexicon gives the word's valence, the rules adjust it,
and one sum per text gives the score. The sum is combined before it is
shuffled, so a single small row per text crosses the network however long the text is.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.functions.scale import broadcast_if_small, fits_broadcast
from murmur.functions.words import bare_words, one_of, positions_of
from murmur.operators.features import event_label, explode_entities, period_position
from murmur.specs import Calendar, EntityPattern

# The method's published constants.
BOOST = 0.293
CAPS = 0.733
NEGATION = -0.74
DAMPING = (1.0, 0.95, 0.9)
NEVER_SO = (None, 1.5, 1.25)
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, QUESTION_MANY = 0.18, 0.96
NORMALISER = 15.0

#: A lexicon of at most so many words is written into the plan.
INLINE_WORDS = 20_000

# Words that strengthen the word after them.
BOOSTERS = (
    "absolutely amazingly awfully completely considerably decidedly deeply effing enormously "
    "entirely especially exceptionally extremely fabulously flipping flippin fricking frickin "
    "frigging friggin fully fucking greatly hella highly hugely incredibly intensely majorly more "
    "most particularly purely quite really remarkably so substantially thoroughly totally "
    "tremendously uber unbelievably unusually utterly very"
).split()

# Words that weaken the word after them, and two-word forms of the same.
DAMPENERS = (
    "almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely "
    "slightly somewhat sorta sortof sort-of"
).split()
DAMPENER_PAIRS = ["just enough", "kind of", "sort of"]

# Negations, besides every word containing "n't".
NEGATIONS = (
    "aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt "
    "neither neednt never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent "
    "uh-uh without wont wouldnt rarely seldom despite"
).split()

# Expressions whose valence differs from that of their words.
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0,
    "cut the mustard": 2.0, "kiss of death": -1.5, "hand to mouth": -2.0,
}


@dataclass(frozen=True)
class SentimentRules:
    """The word lists the rules consult."""

    boosters: Sequence[str] = tuple(BOOSTERS)
    dampeners: Sequence[str] = tuple(DAMPENERS)
    negations: Sequence[str] = tuple(NEGATIONS)
    idioms: Mapping[str, float] = field(default_factory=lambda: dict(IDIOMS))
    contrast: str = "but"

    def extended(self, boosters=(), dampeners=(), negations=(), idioms=None, contrast=None) -> SentimentRules:
        return replace(
            self,
            boosters=(*self.boosters, *boosters),
            dampeners=(*self.dampeners, *dampeners),
            negations=(*self.negations, *negations),
            idioms={**self.idioms, **(idioms or {})},
            contrast=contrast or self.contrast,
        )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A valence lexicon in the usual text form as ``(token, valence)``.

    Each line is a token, a tab and its mean valence; what follows a second tab (deviation, single ratings) isn't read. Tokens are
    taken as they stand, quotes, blanks and emoticons included. Empty lines are skipped, any other line without a number fails when it is read.
    """
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.get(parts, F.lit(0)).alias("token"), F.get(parts, F.lit(1)).try_cast("double").alias("valence"), "value")
    fault = F.raise_error(F.concat(F.lit("no valence in: "), F.col("value"))).cast("double")
    return lines.select("token", F.coalesce("valence", fault).alias("valence"))


def lexicon_table(spark: SparkSession, valences: Mapping[str, float]) -> DataFrame:
    """A lexicon held in memory as ``(token, valence)`` rows."""
    return spark.createDataFrame(pa.table({
        "token": pa.array([t for t in valences], pa.string()),
        "valence": pa.array([float(v) for v in valences.values()], pa.float64()),
    }))


def _is_caps(token: Column) -> Column:
    return (token == F.upper(token)) & (token != F.lower(token))


def _one_per_token(lexicon: DataFrame) -> DataFrame:
    """Lower-cased tokens, each once; a token listed with several valences gets their average."""
    return lexicon.groupBy(F.lower("token").alias("token")).agg(F.avg("valence").alias("valence"))


def _punctuation_emphasis(text: Column) -> Column:
    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    asks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    asking = F.when(asks <= 1, 0.0).when(asks <= 3, asks * QUESTION).otherwise(QUESTION_MANY)
    return F.least(marks, F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION + asking


def _token_rows(df: DataFrame, text_col: str, rules: SentimentRules, keep: Sequence[str],
                hits: Sequence[str] | None) -> DataFrame:
    """One row per word with its neighbours, for the words in ``hits`` or all; a text without one keeps an empty row.

    ``_first`` marks the row that stands for its text.
    """
    words = df.select(
        *keep,
        bare_words(F.col(text_col)).alias("_tokens"),
        F.coalesce(_punctuation_emphasis(F.col(text_col)), F.lit(0.0)).alias("_emphasis"),
    ).withColumn("_lower", F.transform("_tokens", F.lower))
    shouting = F.size(F.filter("_tokens", _is_caps))
    contrast = F.array_position("_lower", rules.contrast) - 1
    neighbours = F.transform(
        positions_of("_lower", hits),
        lambda i: F.struct(
            i.alias("_at"),
            F.get("_tokens", i).alias("_hit"),
            F.get("_tokens", i - 1).alias("_b1"),
            F.get("_tokens", i - 2).alias("_b2"),
            F.get("_tokens", i - 3).alias("_b3"),
            F.get("_tokens", i + 1).alias("_n1"),
            F.get("_tokens", i + 2).alias("_n2"),
        ),
    )
    # All per-text facts are settled before the explode: a sibling of explode is
    # evaluated once per token, on a copy of the whole token array.
    per_text = words.select(
        *keep,
        "_emphasis",
        ((shouting > 0) & (shouting < F.size("_tokens"))).alias("_mixed_case"),
        contrast.alias("_contrast"),
        neighbours.alias("_near"),
    )
    carried = [*keep, "_emphasis", "_mixed_case", "_contrast"]
    exploded = per_text.select(*carried, F.posexplode_outer("_near").alias("_position", "_t"))
    return exploded.select(*carried, (F.coalesce("_position", F.lit(0)) == 0).alias("_first"), "_t.*")


def _with_valences(tokens: DataFrame, lexicon: DataFrame, rules: SentimentRules) -> DataFrame:
    """Look up the word itself and, for hits only, whether its predecessors are in the lexicon.

    Modifier words never carry a valence. For a text's first word without one the
    predecessor keys are NULL, which the joins skip.
    """
    lexicon = broadcast_if_small(lexicon.select("token", "valence"))
    tokens = tokens.withColumn("_word", F.lower("_hit"))
    is_modifier = one_of("_word", [*rules.boosters, *rules.dampeners]) | (
        (F.col("_word") == "kind") & F.coalesce(F.lower("_n1") == "of", F.lit(False)))
    scored = tokens.withColumn("_key", F.when(~is_modifier, F.col("_word"))).join(
        lexicon.select(F.col("token").alias("_key"), F.col("valence").alias("_base")), "_key", "left")
    # From here on only hits matter, and the row that stands for its text.
    scored = scored.where(F.col("_base").isNotNull() | F.col("_first"))
    for distance in (1, 2, 3):
        key, back = f"_back{distance}", f"_b{distance}"
        scored = (
            scored.withColumn(key, F.when(F.col("_base").isNotNull(), F.lower(back)))
            .join(lexicon.select(F.col("token").alias(key), F.lit(True).alias(f"{key}_listed")), key, "left")
            # A predecessor takes part only if it exists and has no valence of its own.
            .withColumn(key, F.when(F.col(f"{key}_listed").isNull(), F.col(key)))
        )
    return scored


def _boost(word: str, raw: str, valence: Column, rules: SentimentRules, damping: float) -> Column:
    """What a degree word before the hit adds, away from zero or towards it."""
    direction = F.when(valence < 0, -1.0).otherwise(1.0)
    step = F.when(one_of(word, rules.boosters), BOOST).when(one_of(word, rules.dampeners), -BOOST)
    shout = F.when(_is_caps(F.col(raw)) & F.col("_mixed_case"), F.when(valence > 0, CAPS).otherwise(-CAPS)).otherwise(0.0)
    return F.coalesce((step * direction + shout) * damping, F.lit(0.0))


def _is_negation(word: str, rules: SentimentRules) -> Column:
    return one_of(word, rules.negations) | F.contains(F.col(word), F.lit("n't"))


def _adjust(scored: DataFrame, rules: SentimentRules) -> DataFrame:
    """Apply the rules in order. Each step is its own projection so that no expression is repeated."""
    v = F.col("_v")
    base = F.col("_base")
    emphatic = _is_caps(F.col("_hit")) & F.col("_mixed_case")
    scored = scored.withColumn("_v", base + F.when(emphatic, F.when(base > 0, CAPS).otherwise(-CAPS)).otherwise(0.0))

    so = {b: F.coalesce(F.col(b).isin("so", "this"), F.lit(False)) for b in ("_b1", "_b2")}
    never_so = {
        2: F.coalesce(F.col("_b2") == "never", F.lit(False)) & so["_b1"],
        3: (F.coalesce(F.col("_b3") == "never", F.lit(False)) & so["_b2"]) | so["_b1"],
    }
    for distance in (1, 2, 3):
        word, raw = f"_back{distance}", f"_b{distance}"
        present = F.col(word).isNotNull()
        scored = scored.withColumn("_v", v + _boost(word, raw, v, rules, DAMPING[distance - 1]))
        flipped = F.when(present & _is_negation(word, rules), v * NEGATION).otherwise(v)
        if distance in never_so:
            flipped = F.when(present & never_so[distance], v * NEVER_SO[distance - 1]).otherwise(flipped)
        scored = scored.withColumn("_v", flipped)
    scored = scored.withColumn("_v", F.when(F.col("_back3").isNotNull(), _idioms(v, rules)).otherwise(v))

    lone_least = (F.col("_back1") == "least") & (
        F.col("_b2").isNull() | ~F.lower("_b2").isin("at", "very"))
    scored = scored.withColumn("_v", F.when(lone_least, v * NEGATION).otherwise(v))
    weight = F.when(F.col("_at") < F.col("_contrast"), BEFORE_CONTRAST).when(
        F.col("_at") > F.col("_contrast"), AFTER_CONTRAST).otherwise(1.0)
    return scored.withColumn("_v", v * F.when(F.col("_contrast") >= 0, weight).otherwise(1.0))


def _idioms(valence: Column, rules: SentimentRules) -> Column:
    """Replace the valence where the hit is part of an idiom, then weaken after 'sort of' and the like."""
    def phrase(*parts: str) -> Column:
        return F.concat_ws(" ", *parts)

    ahead = [phrase("_hit", "_n1", "_n2"), phrase("_hit", "_n1")]
    behind = [
        phrase("_b1", "_hit"),
        phrase("_b2", "_b1", "_hit"),
        phrase("_b2", "_b1"),
        phrase("_b3", "_b2", "_b1"),
        phrase("_b3", "_b2"),
    ]
    if rules.idioms:
        known = F.create_map(*(F.lit(p) for item in rules.idioms.items() for p in (item[0], float(item[1]))))
        valence = F.coalesce(*(F.try_element_at(known, p) for p in ahead + behind), valence)
    pairs = [w for w in (*DAMPENER_PAIRS, *rules.dampeners, *rules.boosters) if " " in w]
    softened = phrase("_b3", "_b2").isin(pairs) | phrase("_b2", "_b1").isin(pairs)
    return valence - F.when(softened, BOOST).otherwise(0.0)


def score_sentiment(
    df: DataFrame,
    text_col: str,
    lexicon: DataFrame,
    rules: SentimentRules | None = None,
    key: str = "post_id",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Compound sentiment in [-1, 1] per text: ``key``, the ``keep`` columns and ``sentiment``.

    One row comes back per row, whatever the keys: rows of equal or NULL key, and repeated rows, are scored on
    their own. Texts that are NULL, empty or without a lexicon word score 0.0 and stay in the result. ``lexicon`` is
    compared in lower case; a token listed more than once gets the average of its valences.

    The words of a lexicon measured to have at most ``INLINE_WORDS`` are looked for inside each row, and only what is
    found is exploded; a larger lexicon is joined to all words.
    """
    rules = rules or SentimentRules()
    columns = [key, *(c for c in keep if c != key)]
    once = _one_per_token(lexicon)
    hits = [r.token for r in once.collect()] if fits_broadcast(once, INLINE_WORDS) else None
    # Rows of equal key, kept columns and text are scored together and given back one by one. Numbering the rows
    # instead would keep filters on the result from reaching the input.
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_digest")
    marked = df.select(digest, *(c for c in columns if c != text_col), text_col)
    tokens = _token_rows(marked, text_col, rules, ["_digest", *columns], hits)
    adjusted = _adjust(_with_valences(tokens, once, rules), rules)
    totals = adjusted.groupBy("_digest", *columns).agg(
        F.count_if("_first").alias("_rows"), F.max("_emphasis").alias("_emphasis"),
        F.coalesce(F.sum("_v") / F.count_if("_first"), F.lit(0.0)).alias("_sum"))
    emphasised = totals.withColumn("_sum", F.col("_sum") + F.signum("_sum") * F.col("_emphasis"))
    compound = F.col("_sum") / F.sqrt(F.col("_sum") * F.col("_sum") + NORMALISER)
    scored = emphasised.select(*columns, "_rows", F.round(compound, 4).alias("sentiment"))
    return _repeated(scored, "_rows").select(*columns, "sentiment")


def _repeated(df: DataFrame, times: str, most: int = 1 << 16) -> DataFrame:
    """Each row as often as it says, ``most`` at a time: no array holds all of a row's copies."""
    lots = df.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / most))))
    size = F.least(F.lit(most), F.col(times) - F.col("_lot") * most)
    return lots.withColumn("_copy", F.explode(F.sequence(F.lit(1), size.cast("int"))))


# Aggregates over scored rows

def sentiment_by_period(scored: DataFrame, calendar: Calendar) -> DataFrame:
    """Rows and average sentiment per calendar period, in calendar order."""
    return (
        scored.where(F.col("event_period").isin(calendar.labels))
        .groupBy("event_period")
        .agg(F.count("*").alias("posts"), F.avg("sentiment").alias("avg_sentiment"))
        .withColumn("order", period_position(calendar))
        .orderBy("order")
    )


def sentiment_by_entity(scored: DataFrame, entities: Sequence[EntityPattern]) -> DataFrame:
    """Rows and average sentiment per entity, in one pass over the scored rows."""
    return (
        explode_entities(scored, entities)
        .groupBy("player")
        .agg(F.count("*").alias("posts"), F.avg("sentiment").alias("avg_sentiment"))
        .orderBy("player")
    )


def sentiment_histogram(scored: DataFrame, labels: Mapping[str, str], width: float = 0.1) -> DataFrame:
    """Share of rows per sentiment bucket for chosen periods, over every row of theirs.

    ``labels`` maps a period to its display name. ``density`` integrates to 1 per event.
    """
    bucket = F.floor((F.col("sentiment") + 1) / F.lit(width))
    counts = (
        scored.where(F.col("event_period").isin(list(labels)))
        .groupBy(event_label(labels).alias("event"), bucket.alias("bucket"))
        .agg(F.count("*").alias("posts"))
    )
    total = F.sum("posts").over(Window.partitionBy("event"))
    return counts.select(
        "event", "bucket", "posts",
        (F.col("bucket") * F.lit(width) - 1).alias("bucket_start"),
        (F.col("posts") / (total * F.lit(width))).alias("density"),
    ).orderBy("event", "bucket")


def sentiment_density(scored: DataFrame, labels: Mapping[str, str], points: int = 81) -> DataFrame:
    """Gaussian kernel density of sentiment on a grid over [-1, 1], one curve per event.

    Bandwidth is Scott's rule. Scores have four decimals, so rows are first
    counted per distinct score: at most 20,001 per event meet the grid, whatever
    the number of rows. ``density`` integrates to 1 per event; ``joint_density``
    is scaled by the event's share of all rows. An event whose scores don't vary, or with
    one row, has no bandwidth: its densities are NULL, and its rows count in every share.
    """
    values = (
        scored.where(F.col("event_period").isin(list(labels)))
        .groupBy(event_label(labels).alias("event"), "sentiment")
        .agg(F.count("*").alias("n"))
    )
    event = Window.partitionBy("event")
    n, s = F.col("n"), F.col("sentiment")
    moments = values.select(
        "event", "sentiment", "n",
        F.sum(n).over(event).alias("rows"),
        (F.sum(n * s).over(event) / F.sum(n).over(event)).alias("mean"),
    ).withColumn("squares", F.sum(n * (s - F.col("mean")) ** 2).over(event))
    bandwidth = F.sqrt(F.try_divide(F.col("squares"), F.col("rows") - 1)) * F.pow(F.col("rows"), F.lit(-0.2))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * F.lit(2.0 / (points - 1)) - 1)
    spread = moments.select("event", "sentiment", "n", "rows", F.when(bandwidth > 0, bandwidth).alias("h")).select(
        "*", F.posexplode(grid).alias("point", "x"))
    z = (F.col("x") - s) / F.col("h")
    kernel = F.exp(-0.5 * z * z) / (F.col("h") * F.lit(math.sqrt(2 * math.pi)))
    curve = spread.groupBy("event", "point", "x", "rows").agg(F.sum(n * kernel).alias("mass"))
    share = F.sum("rows").over(Window.partitionBy("point"))
    return curve.select(
        "event", "point", "x",
        (F.col("mass") / F.col("rows")).alias("density"),
        (F.col("mass") / share).alias("joint_density"),
    ).orderBy("event", "point")


def sentiment_shift(scored: DataFrame, entities: Sequence[EntityPattern], calendar: Calendar) -> DataFrame:
    """Average sentiment per entity and period, and its change since the entity's previous period."""
    averages = (
        explode_entities(scored.where(F.col("event_period").isin(calendar.labels)), entities)
        .groupBy("player", "event_period")
        .agg(F.count("*").alias("posts"), F.avg("sentiment").alias("avg_sentiment"))
        .withColumn("order", period_position(calendar))
    )
    earlier = F.lag("avg_sentiment").over(Window.partitionBy("player").orderBy("order"))
    return averages.withColumn("shift", F.col("avg_sentiment") - earlier).orderBy("player", "order")
