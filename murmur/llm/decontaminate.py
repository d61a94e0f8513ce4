"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question asked again with
other values has the same template. Documents' template windows are joined to the
benchmark's by hash. What was replaced are slots: along a match, equal slots of the item must
be equal in the document, or it is another question of the same form.

What is a name hangs on letter case and on the marks before a word, and a window of placeholders alone says nothing. So each
window also has a literal hash, blind to case, punctuation and white space, which finds
copies word for word whatever their template; items shorter than a window have one at their own length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.scale import fits_broadcast, stage
from murmur.llm import textops

# Words that are units after a number.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
         "mg", "g", "kg", "ounce", "ounces", "pound", "pounds", "ton", "tons", "ml", "l", "litre", "litres",
         "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks",
         "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent",
         "mph", "kmh", "degree", "degrees", "celsius", "fahrenheit", "volt", "volts", "watt", "watts")


@dataclass(frozen=True)
class Settings:
    """``width`` words a window; a match has ``run`` words in a row, or the whole item if that is shorter.

    A template window has ``literal`` words at least that are not placeholders. Items of fewer than ``least`` words are
    not looked for: they are phrases of any text.
    """

    width: int = 8
    literal: int = 5
    run: int = 13
    least: int = 3


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_BREAKS = _PUNCTUATION | textops._SPACES
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n"]] = True
_NUMBER, _NAME, _UNIT = (np.uint64(v) for v in (0xA11CE001, 0xA11CE002, 0xA11CE003))


def _glue(raw: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """A point or comma between digits belongs to the number."""
    inner = (raw == ord(".")) | (raw == ord(","))
    inner[0] = inner[-1] = False
    inner[1:-1] &= _DIGIT[raw[:-2]] & _DIGIT[raw[2:]]
    return gap & ~inner


def _unit_hashes(key: int = 0) -> np.ndarray:
    return np.sort(textops.split_words([" ".join(UNITS).encode()], key=key).hashes)


#: Punctuation beyond ASCII, which separates words as that does.
_MARKS = re.compile("[\u00a0\u00a1\u00ab\u00b7\u00bb\u00bf\u2000-\u206f\u3000-\u3003\u3008-\u3011\uff01\uff0c\uff1a\uff1b\uff1f]+")


def _plain(text: bytes | None) -> bytes:
    if text is None or text.isascii():
        return text or b""
    return _MARKS.sub(" ", text.decode("utf-8", "replace")).encode()


def _lowered(text: bytes) -> bytes:
    return text if text.isascii() else text.decode().lower().encode()


@dataclass
class Template:
    """Canonical words of some texts: their hashes, whether each is a placeholder, and the hashes of the words themselves."""

    canonical: np.ndarray
    slot: np.ndarray
    value: np.ndarray
    bounds: np.ndarray


def canonicalise(texts: list[bytes | None], units: np.ndarray, key: int = 0) -> Template:
    """Words without punctuation, lower-cased, with typed placeholders.

    A word that begins with a digit is a number, a unit word after it a unit, and a
    capitalised word inside a sentence a name. NULL and empty texts have no words.
    """
    texts = [_plain(t) for t in texts]
    words = textops.split_words(texts, lower=True, spaces=_BREAKS, glue=_glue, key=key)
    hashes, starts = words.hashes, words.starts
    if not all(map(bytes.isascii, texts)):  # letter case beyond A-Z; the words are the same in number
        hashes = textops.split_words([_lowered(t) for t in texts], lower=True, spaces=_BREAKS, glue=_glue, key=key).hashes
    slot = np.zeros(len(hashes), bool)
    canonical = hashes.copy()
    if len(hashes):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        first = raw[starts]
        number = _DIGIT[first]
        after = np.zeros(len(hashes), bool)
        after[1:] = number[:-1]
        unit = after & (units[np.minimum(np.searchsorted(units, hashes), len(units) - 1)] == hashes)
        second = raw[np.minimum(starts + 1, len(raw) - 1)]
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        opens = np.ones(len(hashes), bool)
        opens[1:] = stops[starts[1:]] > stops[words.ends[:-1]]
        heads = words.bounds[:-1]
        opens[heads[heads < len(hashes)]] = True
        name = capital & ~opens
        canonical[number], canonical[unit], canonical[name] = _NUMBER, _UNIT, _NAME
        slot = number | unit | name
    return Template(canonical, slot, hashes, words.bounds)


def _windows(template: Template, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = textops.windows(template.canonical, template.bounds, settings.width)
    slots = np.concatenate([[0], np.cumsum(template.slot)])
    enough = settings.width - (slots[at + settings.width] - slots[at]) >= settings.literal
    return hashes[enough], at[enough]


def _literal_windows(template: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words as they are, which differ from those of templates and of other sizes."""
    hashes, at = textops.windows(template.value, template.bounds, size)
    return textops.mix(hashes ^ np.uint64(0x11E7A << 32 | size)), at


SIEVE_BITS = 27


@dataclass(frozen=True)
class Sieve:
    """The benchmark's window hashes, or beyond a bound only a bitmap of their leading ``SIEVE_BITS`` bits, of 16 MB."""

    bitmap: np.ndarray  # 64-bit words
    bits: int
    hashes: np.ndarray | None = None  # sorted

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of hashes that may be the benchmark's."""
        lead = hashes >> np.uint64(64 - self.bits)
        maybe = np.flatnonzero(self.bitmap[lead >> np.uint64(6)] >> (lead & np.uint64(63)) & np.uint64(1))
        if self.hashes is None:
            return maybe
        at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[at] == hashes[maybe]] if len(self.hashes) else maybe[:0]


_WINDOWS = T.StructType([
    T.StructField("at", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("n_words", T.LongType()),
    T.StructField("window", T.LongType()), T.StructField("literal", T.BooleanType()), T.StructField("slots", T.ArrayType(T.LongType())),
])


def text_windows(df: DataFrame, key_col: str, text_col: str, settings: Settings, key: int, lengths: Sequence[int] | None = None,
                 sieve: Sieve | None = None) -> DataFrame:
    """Windows of every whole text: ``key``, ``at`` (word number), ``size`` (words), ``n_words`` of the text, ``window`` (hash), ``literal``,
    ``slots`` (in the window's order, the hash of what a placeholder replaced, 0 for a literal word).

    Each text has template windows and literal windows of ``width`` words, and literal ones of the other ``lengths``;
    without ``lengths``, one of the whole text if that is shorter than ``width`` and not shorter than ``least``.
    ``sieve`` keeps the windows that it may hold, and drops no other's. ``key`` is that of the hashes.
    """
    schema = T.StructType([T.StructField("key", df.schema[key_col].dataType), *_WINDOWS])
    shared = None if sieve is None else df.sparkSession.sparkContext.broadcast(sieve)
    width = settings.width

    def found(template: Template) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
        yield *_windows(template, settings), width, False
        yield *_literal_windows(template, width), width, True
        for size in range(settings.least, width) if lengths is None else lengths:
            hashes, at = _literal_windows(template, size)
            if lengths is None:  # the whole of a short text
                whole = np.diff(template.bounds)[np.searchsorted(template.bounds, at, "right") - 1] == size
                hashes, at = hashes[whole], at[whole]
            yield hashes, at, size, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _unit_hashes(key)
        for batch in batches:
            for low, high, texts in textops.text_slices(batch.column(1)):
                template = canonicalise(texts, units, key)
                for hashes, at, size, literal in found(template):
                    if shared is not None:
                        kept = shared.value.passes(hashes)
                        hashes, at = hashes[kept], at[kept]
                    if not len(at):
                        continue
                    owner = np.searchsorted(template.bounds, at, "right") - 1
                    cells = at[:, None] + np.arange(size)
                    values = np.where(template.slot[cells], template.value[cells] | np.uint64(1), np.uint64(0)).view(np.int64)
                    offsets = np.arange(0, values.size + 1, size, dtype=np.int32)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(low, high - low).take(pa.array(owner)), pa.array(at - template.bounds[owner]),
                        pa.array(np.full(n, size, np.int32)), pa.array(template.bounds[owner + 1] - template.bounds[owner]),
                        pa.array(hashes.view(np.int64)), pa.array(np.full(n, literal)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))], names=schema.names)

    return textops.map_arrow(df.select(df[key_col].alias("key"), df[text_col].alias("text")), run, schema)


def _sieve(windows: DataFrame, small: bool) -> Sieve:
    """The sieve of a frame with a column ``window``. No more comes to the driver than the bound of ``small``, or the bitmap's words."""
    if small:
        hashes = np.sort(windows.distinct().toArrow().column(0).to_numpy().view(np.uint64))
        bits = 20
        lead = hashes >> np.uint64(64 - bits)
        bitmap = np.zeros(1 << bits - 6, np.uint64)
        np.bitwise_or.at(bitmap, lead >> np.uint64(6), np.uint64(1) << (lead & np.uint64(63)))
        return Sieve(bitmap, bits, hashes)
    lead = F.shiftrightunsigned("window", 64 - SIEVE_BITS)
    words = windows.select(lead.alias("lead")).select(
        F.shiftrightunsigned("lead", 6).alias("word"), F.expr("shiftleft(1L, cast(lead & 63 as int))").alias("bit"))
    held = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << SIEVE_BITS - 6, np.uint64)
    bitmap[held.column(0).to_numpy()] = held.column(1).to_numpy().view(np.uint64)
    return Sieve(bitmap, SIEVE_BITS)


#: So many of the benchmark's windows, of at most a few hundred bytes each, are broadcast.
BROADCAST_WINDOWS = 100_000


def matches(df: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), key_col: str = "doc_id",
            text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Runs of words that a document shares with a benchmark item, up to its numbers, names and units.

    Columns: the key, the item, ``doc_at`` and ``item_at`` (first word of the run), ``n_words`` (its length),
    ``n_slots`` (distinct placeholders in it), ``changed`` (some slot holds another value than in the item). A run has ``run``
    words, or the whole item if that is shorter. Words that are the item's own match whatever they are, in any letter case and
    with any punctuation or white space between them. Elsewhere slots must agree: what is equal in the item is equal in
    the document.

    NULL and empty texts match nothing, nor do items of fewer than ``least`` words; items shorter than a window match word for
    word only. Repeated rows of a key count once; so do repeated items. Rows with a NULL key can't be named and
    give nothing. An empty table on either side gives no rows.

    The benchmark's windows are measured: below the bound they go to the tasks and are joined there; beyond it a bitmap
    of fixed size sieves the documents' windows before they are shuffled.
    """
    key = textops.fresh_key()
    items = stage(text_windows(benchmark.where(benchmark[item_col].isNotNull()), item_col, item_text_col, settings, key),
                  "benchmark_windows").dropDuplicates(["key", "at", "window"])
    named = df.where(df[key_col].isNotNull())
    lengths = [r["size"] for r in items.where(F.col("size") < settings.width).select("size").distinct().orderBy("size").collect()]
    small = fits_broadcast(items.select("window"), max_rows=BROADCAST_WINDOWS)
    windows = text_windows(named, key_col, text_col, settings, key, lengths, _sieve(items.select("window"), small))
    right = items.select("window", F.col("key").alias("item"), F.col("at").alias("item_at"),
                         F.col("n_words").alias("item_words"), F.col("slots").alias("item_slots"))
    hits = windows.drop("n_words").join(F.broadcast(right) if small else right, "window")
    shift = F.col("at") - F.col("item_at")
    line = W.partitionBy("key", "item", "shift").orderBy("item_at")
    # words that are the item's own hold the item's values
    slots = F.when(F.col("literal"), F.col("item_slots")).otherwise(F.col("slots"))
    best = F.min(F.struct((~F.col("literal")).alias("templated"), "size", "item_words", "item_slots", slots.alias("slots")))
    rows = hits.groupBy("key", "item", shift.alias("shift"), "item_at").agg(best.alias("best")).select(
        "key", "item", "shift", "item_at", "best.*")
    # windows over fewer literal words have no template, so a run goes on while windows touch
    ends = F.max(F.col("item_at") + F.col("size")).over(line.rowsBetween(W.unboundedPreceding, -1))
    runs = rows.withColumn("begins", F.when(F.col("item_at") <= ends, 0).otherwise(1)).withColumn("run", F.sum("begins").over(line))
    pairs = F.filter(F.arrays_zip("item_slots", "slots"), lambda p: p["item_slots"] != 0)
    merged = runs.groupBy("key", "item", "shift", "run").agg(
        F.min("item_at").alias("item_at"), F.max("item_words").alias("item_words"),
        (F.max(F.col("item_at") + F.col("size")) - F.min("item_at")).alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))  # at most an item's slots
    slots = F.size(F.array_distinct(F.col("pairs.item_slots")))
    good = merged.where(slots == F.size("pairs")).where(
        F.col("n_words") >= F.least(F.lit(settings.run).cast("long"), F.col("item_words")))
    changed = F.exists("pairs", lambda p: p["item_slots"] != p["slots"])
    return good.select(F.col("key").alias(key_col), F.col("item").alias(item_col), (F.col("item_at") + F.col("shift")).alias("doc_at"),
                       "item_at", "n_words", slots.alias("n_slots"), changed.alias("changed"))


def contaminated(df: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), key_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Documents and the items they hold: ``n_words`` (longest run), ``n_runs``, ``changed`` (no run repeats the values)."""
    return matches(df, benchmark, settings, key_col, text_col, item_col, item_text_col).groupBy(key_col, item_col).agg(
        F.max("n_words").alias("n_words"), F.count("*").alias("n_runs"), F.min("changed").alias("changed"))
