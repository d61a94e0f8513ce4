"""Fill-in-the-middle: cut a text at two token boundaries and move the middle to the end.

A token is a word with the white space before it, or the white space that ends a text:
``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``. The boundaries of the texts of a slice of rows
form one ``BoundarySet`` over their bytes; a text's cuts are the positions at its own first rank plus
the numbers of tokens before the cuts. All draws come from the key, so they are the same on every run.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm import textops
from murmur.llm.boundaries import BoundarySet

PLAIN, PSM, SPM = "plain", "psm", "spm"
ADDED = T.StructType([
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
])
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Settings:
    """``fim_percent`` of the texts are cut, ``spm_percent`` of those in the order suffix, prefix, middle."""

    seed: str = "42"
    fim_percent: int = 50
    spm_percent: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def markers(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def draws(key: Column, seed: str) -> list[Column]:
    """Four numbers below 2^32: the first 8-digit groups of sha256 of ``seed:key``. A NULL key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"__h{i + 1}") for i in range(4)]


def token_bounds(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All boundaries of the texts, laid out with one byte between them.

    Returns the boundaries in ascending order (each text's start and the ends of its tokens), the first
    rank of each text, and the joined bytes.
    """
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes + 1) - sizes - 1
    gap = _SPACES[raw]
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1  # of words: the byte after a text is a space
    filled = starts[sizes > 0] + sizes[sizes > 0]
    tails = filled[gap[filled - 1]]  # of texts that end in white space
    bounds = np.sort(np.concatenate([starts, ends, tails]))
    return bounds, np.searchsorted(bounds, starts), raw


def _cut(texts: list[bytes], h: np.ndarray, settings: Settings) -> list[list]:
    bounds, first, raw = token_bounds(texts)
    n = np.diff(np.append(first, len(bounds))) - 1
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    boundaries = BoundarySet.of(bounds)
    starts = boundaries.select(first)
    low = boundaries.select(first + np.minimum(one, two))
    high = boundaries.select(first + np.maximum(one, two))
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    markers = [m.encode() for m in settings.markers]
    cut = (h[2] % 100 < settings.fim_percent) & (np.fromiter((len(t) for t in texts), np.int64, len(texts)) > 0)
    spm = h[3] % 100 < settings.spm_percent
    forms, prefixes, middles, outputs = [], [], [], []
    for i, text in enumerate(texts):
        if not cut[i] or any(m in text for m in markers):
            forms.append(PLAIN)
            prefixes.append(None)
            middles.append(None)
            outputs.append(text.decode("utf-8"))
            continue
        a, b = low[i] - starts[i], high[i] - starts[i]
        prefix, middle, suffix = markers[0] + text[:a], markers[2] + text[a:b], markers[1] + text[b:]
        forms.append(SPM if spm[i] else PSM)
        prefixes.append(int(chars[low[i]] - chars[starts[i]]))
        middles.append(int(chars[high[i]] - chars[low[i]]))
        outputs.append((suffix + prefix + middle if spm[i] else prefix + suffix + middle).decode("utf-8"))
    return [n, forms, prefixes, middles, outputs]


def transform(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ("doc_id",),
              settings: Settings = Settings()) -> DataFrame:
    """Every text, cut and rearranged or left plain.

    Columns: ``keep``, then ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars`` and ``middle_chars``
    (code points; NULL if plain), ``output``. A kept column may not have one of these names.

    One row comes back per row, repeated rows included, which are cut alike. A NULL text counts as empty.
    A text stays plain if it is empty or holds a marker, so that ``restored`` always finds the text again. A NULL
    key counts as the empty string in the draws. Whole texts are cut, a slice of rows at a time, without a
    shuffle; an empty table gives an empty one.
    """
    clash = sorted(set(keep) & set(ADDED.names))
    if clash:
        raise ValueError(f"kept columns named like a result: {clash}")
    schema = T.StructType([df.schema[c] for c in keep] + list(ADDED))
    kinds = [textops._arrow_type(f.dataType) for f in ADDED]
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in textops.blobs(batch.column(batch.num_columns - 1))]
            h = np.stack([batch.column(width + i).to_numpy(zero_copy_only=False) for i in range(4)]).astype(np.int64)
            for low, high in textops.row_slices(texts):
                rows = batch.slice(low, high - low)
                added = _cut(texts[low:high], h[:, low:high], settings)
                columns = [rows.column(i) for i in range(width)]
                columns += [pa.array(v, k) for v, k in zip(added, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    source = df.select(*(df[c] for c in keep), *draws(df[key_col], settings.seed), df[text_col].alias("__text"))
    return textops.map_arrow(source, run, schema)


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that an output was made of; NULL for a NULL output.

    Each marker stands once in a cut output: texts that hold one stay plain, and no marker can begin or end
    in another.
    """
    any_marker = "|".join("\\Q" + m + "\\E" for m in settings.markers)
    parts = F.split(output, any_marker, -1)
    return (F.when(form == PSM, F.concat(parts[1], parts[3], parts[2]))
            .when(form == SPM, F.concat(parts[2], parts[3], parts[1]))
            .otherwise(output))
