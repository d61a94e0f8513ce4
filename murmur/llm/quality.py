"""Quality rules: a ledger of failure bits, read by versioned policies.

Every rule is evaluated once for each document. Its verdict is one bit of
``failed_bits``; the measurements stand beside it. A policy is a named set of rules,
so another policy, or the loss of a rule, is a mask over the ledger and needs no
second look at the texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm import textops

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_SPACE_BYTES = b" \t\n\x0b\x0c\r"

MEASURES = T.StructType([
    T.StructField(n, T.LongType())
    for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
])


@dataclass(frozen=True)
class Rule:
    """A named condition over the measurements; true means that the document fails."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version's rules, by name."""

    version: str
    rules: tuple[str, ...]


#: The order is the order of the bits: append, never reorder.
RULES: tuple[Rule, ...] = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
)
BASE = Policy("base", ("few_words", "repeated_windows"))
FIRST = Policy("1", ("few_words", "repeated_windows", "many_symbols", "long_words"))
STRICT = Policy("2", tuple(r.name for r in RULES))


#: Windows are compared inside a text only, so each process may hash by a key of its own.
_KEY = textops.fresh_key()


def _measure(texts: list[bytes | None]) -> list:
    words = textops.split_words(texts, key=_KEY)
    n_words = words.counts
    repeated = np.zeros(len(words.hashes) + WINDOW + 1, np.int64)
    hashes, at = textops.windows(words.hashes, words.bounds, WINDOW)
    if len(at):
        owner = np.searchsorted(words.bounds, at, "right").astype(np.uint64)
        keys = hashes + owner * np.uint64(0xD1B54A32D192ED03)
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = at[order[twice]]
        np.add.at(repeated, found, 1)
        np.add.at(repeated, found + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(repeated)[:len(words.hashes)] > 0)])
    n_repeat = covered[words.bounds[1:]] - covered[words.bounds[:-1]]
    chars, symbols, lines, dup_lines = [], [], [], []
    for text in texts:
        text = text or b""
        solid = text.translate(None, _SPACE_BYTES)
        chars.append(len(solid.decode("utf-8", "replace")))
        symbols.append(len(solid) - len(solid.translate(None, SYMBOLS)))
        with_words = [x for x in text.split(b"\n") if x.strip(_SPACE_BYTES)]
        lines.append(len(with_words))
        dup_lines.append(len(with_words) - len(set(with_words)))
    return [n_words, chars, symbols, lines, dup_lines, n_repeat]


def ledger(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",),
           rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measurements and failure bits of every document.

    Columns: ``keep``, then ``n_words``, ``word_chars`` (code points in words),
    ``n_symbols``, ``n_lines`` and ``n_dup_lines`` (lines that hold a word; those equal
    to an earlier one), ``n_repeat_words`` (words in 8-word windows found twice or more),
    ``failed_bits`` (bit i: rule i fails).

    One row comes back per row, repeated rows and NULL keys included. NULL and
    empty texts measure zero and so fail ``few_words``. Whole texts are read, and no
    row meets another, so nothing is shuffled.
    """
    if len(rules) > 63:
        raise ValueError("failed_bits holds 63 rules")
    measured = textops.map_texts(df, text_col, keep, MEASURES, lambda: _measure)
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failed_bits", bits)


def mask(policy: Policy, rules: Sequence[Rule] = RULES) -> int:
    names = [r.name for r in rules]
    return sum(1 << names.index(n) for n in policy.rules)


def fails(policy: Policy, rules: Sequence[Rule] = RULES) -> Column:
    """Whether a ledger row fails a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(policy, rules))) != 0


def store(entries: DataFrame, path: str, rules: Sequence[Rule] = RULES) -> str:
    """Write a ledger, and beside it which rule each bit stands for. Policies of any later version read it there."""
    entries.write.parquet(f"{path.rstrip('/')}/entries")
    bits = [(i, r.name, r.fails) for i, r in enumerate(rules)]
    entries.sparkSession.createDataFrame(bits, "bit int, rule string, fails string").write.parquet(f"{path.rstrip('/')}/rules")
    return path


def load(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[Rule, ...]]:
    """A stored ledger and its rules in the order of their bits. A policy with a rule that it lacks is refused by ``mask``."""
    rules = spark.read.parquet(f"{path.rstrip('/')}/rules").orderBy("bit").collect()  # at most 63
    return spark.read.parquet(f"{path.rstrip('/')}/entries"), tuple(Rule(r["rule"], r["fails"]) for r in rules)


def ablations(entries: DataFrame, policies: Sequence[Policy], rules: Sequence[Rule] = RULES) -> DataFrame:
    """What each rule of each policy drops, and what would return without it.

    Columns: ``version``, ``rule``, ``failing`` (documents that fail the rule),
    ``only`` (those that no other rule of the policy drops), ``kept`` (documents that
    the policy keeps). An empty ledger gives zeros.

    The bits are read once, and every task sends one row of counts.
    """
    bits = F.col("failed_bits")
    names = [r.name for r in rules]
    cells = []
    for policy in policies:
        whole = mask(policy, rules)
        hit = bits.bitwiseAND(F.lit(whole))
        for name in policy.rules:
            bit = 1 << names.index(name)
            cells.append((policy.version, name, F.count_if(bits.bitwiseAND(F.lit(bit)) != 0), F.count_if(hit == F.lit(bit)), F.count_if(hit == 0)))
    sums = [c.alias(f"c{i}_{j}") for i, cell in enumerate(cells) for j, c in enumerate(cell[2:])]
    rows = [F.struct(F.lit(version).alias("version"), F.lit(rule).alias("rule"),
                     *(F.col(f"c{i}_{j}").alias(n) for j, n in enumerate(("failing", "only", "kept"))))
            for i, (version, rule, *_) in enumerate(cells)]
    return entries.agg(*sums).select(F.inline(F.array(*rows)))
