"""Splitting text into words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.specs import WORD_CLASS

#: ASCII punctuation as a character-class body.
PUNCTUATION = r"!-/:-@\[-`{-~"

#: White space in any script.
SPACE = r"[\s\x0B\p{Z}]"

# The punctuation runs that may be stripped from one end of a word.
EDGE_RUNS = r"!!!|!!|!\?!\?|!\?!|\?!\?!|\?!\?|\?\?\?|\?\?|[.!?,;:'\"-]"

# The English stop words that ship with Spark ML.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll "
    "i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've "
    "they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't "
    "shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's "
    "what's when's where's who's why's would"
).split()


def read_word_list(spark: SparkSession, path: str, most: int = 20_000) -> list[str]:
    """The words of a text file with one in each line, such as another library's stop words: lower-cased, each once, in order.

    Blank lines, and what follows a ``#`` at a line's start, are left out. A list goes into a query's plan, so a file of more
    than ``most`` words is refused.
    """
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> '' AND NOT startswith(word, '#')")
    found = [r.word for r in lines.distinct().orderBy("word").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{path} has more than {most} words")
    return found


def bare_words(text: Column) -> Column:
    """Words of two or more characters, with one punctuation run stripped from one end.

    Only a core of two or more letters is stripped; words that keep punctuation elsewhere ("don't!",
    emoticons) stay as they are. The pattern runs on words that have punctuation at an end, few of any text.
    """
    core = rf"[^\s\x0B\p{{Z}}{PUNCTUATION}]{{2,}}"
    pattern = rf"\A(?:(?:{EDGE_RUNS})({core})|({core})(?:{EDGE_RUNS}))\z"
    marks = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

    def bare(word: Column) -> Column:
        marked = F.substring(word, 1, 1).isin(marks) | F.substring(word, -1, 1).isin(marks)
        return F.when(marked, F.regexp_replace(word, F.lit(pattern), F.lit("$1$2"))).otherwise(word)

    return F.transform(F.filter(F.split(text, f"{SPACE}+"), lambda t: F.length(t) > 1), bare)


def positions_of(words: str, wanted: Sequence[str] | None) -> Column:
    """Positions in an array column that hold one of the wanted words, or all positions."""
    known = "true" if wanted is None else f"get(`{words}`, i) IN ({_quoted(wanted)})" if wanted else "false"
    return F.expr(f"filter(sequence(0, size(`{words}`) - 1), i -> i >= 0 AND i < size(`{words}`) AND {known})")


def blank_separated(text: Column) -> Column:
    """Lower-cased tokens between white space; never an empty one."""
    return F.filter(F.split(F.lower(text), f"{SPACE}+"), lambda t: t != "")


def word_runs(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD_CLASS}]{{2,}}"), F.lit(0))


def _quoted(words: Sequence[str]) -> str:
    escaped = (w.replace("\\", "\\\\").replace("'", "\\'") for w in words)
    return ", ".join(f"'{w}'" for w in escaped)


def one_of(column: str, words: Sequence[str]) -> Column:
    """Membership in a word list, which the plan turns into a hash set.

    Handed over as one expression: a list of literal columns takes one call into
    the JVM per word.
    """
    return F.expr(f"`{column}` IN ({_quoted(words)})") if words else F.lit(False)


def without(tokens: str, stop_words: Sequence[str]) -> Column:
    """An array column without the stop words."""
    if not stop_words:
        return F.col(tokens)
    return F.expr(f"filter(`{tokens}`, word -> word NOT IN ({_quoted(stop_words)}))")


def with_bigrams(tokens: str) -> Column:
    """The tokens of an array column, then each joined to its successor; one NULL marks the end.

    Takes a column name, not an expression: it is used several times, and an
    expression would be computed as often.
    """
    shifted = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens), F.lit(1)))
    pairs = F.zip_with(tokens, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(F.col(tokens), pairs)


def explode_terms(df: DataFrame, terms: str, output: str = "term") -> DataFrame:
    """One row per non-NULL element of an array column, beside the other columns.

    The outer form keeps the optimiser from testing the array's size in a filter
    below, for which it would build the whole array a second time.
    """
    others = [c for c in df.columns if c != terms]
    return df.select(*others, F.explode_outer(terms).alias(output)).where(F.col(output).isNotNull())
