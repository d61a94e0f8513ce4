"""Words of whole texts as hashes, a batch at a time, and the Arrow plumbing around them.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed
and carriage return: ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import secrets
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from murmur.functions.package import ship

SLICE_BYTES = 1 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_random = np.random.Generator(np.random.PCG64(0x5EED))
_STEP = np.uint64(0x9E3779B97F4A7C13)
_SALTS = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LONG_BLOCKS = 32  # words of more blocks are hashed one by one


def fresh_key() -> int:
    """A key for ``split_words``, drawn on the driver for one job, so that no text can be made to collide."""
    return secrets.randbits(64)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts, one after another."""

    hashes: np.ndarray  # of each word, 64 bits
    bounds: np.ndarray  # text i has the words bounds[i] to bounds[i + 1]
    starts: np.ndarray  # first byte of each word in ``buffer``
    ends: np.ndarray
    buffer: np.ndarray  # all texts, with a space after each
    blocks: np.ndarray  # the words' bytes, eight by eight, the last of each word filled with zeros
    first_block: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def _blocks(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes in blocks of eight, the last one filled with zeros, and each word's first block."""
    lengths = ends - starts
    counts = (lengths + 7) >> 3
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(starts)), counts)
    place = np.arange(len(owner)) - first[owner]
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    anywhere = np.ndarray((len(buffer) + 1,), "<u8", padded, strides=(1,))  # eight bytes from every place on
    blocks = anywhere[starts[owner] + 8 * place].astype(np.uint64)
    left = lengths[owner] - 8 * place
    short = np.flatnonzero(left < 8)
    blocks[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
    return blocks, first


def _hash_words(words: Words, key: int) -> np.ndarray:
    """A keyed 64-bit hash of each word: block after block is stirred into a state that began with key and length."""
    lengths = words.ends - words.starts
    counts = (lengths + 7) >> 3
    state = mix(np.uint64(key) ^ (lengths.astype(np.uint64) * _STEP))
    live = np.flatnonzero(counts <= _LONG_BLOCKS)
    for place in range(_LONG_BLOCKS):
        live = live[counts[live] > place]
        if not len(live):
            break
        state[live] = mix((state[live] + _SALTS[place]) ^ mix(words.blocks[words.first_block[live] + place] + np.uint64(key)))
    secret = np.uint64(key).tobytes()
    for i in np.flatnonzero(counts > _LONG_BLOCKS).tolist():
        digest = hashlib.blake2b(words.buffer[words.starts[i]:words.ends[i]].tobytes(), digest_size=8, key=secret).digest()
        state[i] = np.frombuffer(digest, np.uint64)[0]
    return state


def split_words(texts: Sequence[bytes | None], lower: bool = False, spaces: np.ndarray = _SPACES,
                glue: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, key: int = 0) -> Words:
    """Split texts into words and hash them.

    ``lower`` maps A-Z to a-z first. ``spaces`` says of each byte whether it
    separates words; ``glue`` may change that by what stands around a byte. A NULL
    text has no words. Hashes of one ``key`` can be compared; two different words have equal ones with a chance of 2^-64.
    """
    blobs = [t or b"" for t in texts]
    raw = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
    gap = spaces[raw]
    if glue is not None:
        gap = glue(raw, gap)
    edge = np.empty(len(raw), bool)
    edge[0] = not gap[0]
    np.not_equal(gap[1:], gap[:-1], out=edge[1:])
    edges = np.flatnonzero(edge)
    starts, ends = edges[0::2], edges[1::2]
    buffer = _LOWER[raw] if lower else raw
    sizes = np.fromiter((len(b) + 1 for b in blobs), np.int64, len(blobs))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    words = Words(np.zeros(0, np.uint64), bounds, starts, ends, buffer, *_blocks(buffer, starts, ends))
    words.hashes = _hash_words(words, key)
    return words


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of spans, one span after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def ascii_words(text: bytes) -> list[bytes]:
    """The words of one text, in order."""
    return text.split()


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside a text, and where each begins."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mixed = np.zeros(count, np.uint64)
    for k in range(width):
        mixed += hashes[k:k + count] * _SALTS[1 + k]
    inside = np.ones(count + width, bool)
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(hashes))]
    for k in range(1, width):  # such a run would hold a later text's first word
        inside[np.maximum(inner - k, 0)] = False
    at = np.flatnonzero(inside[:count])
    return mix(mixed[at]), at


def row_slices(texts: Sequence[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have ``limit`` bytes together, or one longer text."""
    first = size = 0
    for i, text in enumerate(texts):
        grown = len(text or b"")
        if i > first and size + grown > limit:
            yield first, i
            first, size = i, 0
        size += grown
    if first < len(texts):
        yield first, len(texts)


def blobs(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """``row_slices`` of a column with the slice's texts; no more than a slice is held as Python objects."""
    raw = column.cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low, before = 0, 0
    while low < len(raw):
        high = max(low + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield low, high, raw.slice(low, high - low).to_pylist()
        low, before = high, int(ends[high - 1])


def map_texts(df: DataFrame, text_col: str, keep: Sequence[str], added: T.StructType,
              make: Callable[[], Callable[[list[bytes | None]], list]]) -> DataFrame:
    """Add columns computed from whole texts, partition by partition.

    ``make`` runs once per task and returns the function that turns the UTF-8
    bytes of some rows' texts into one list or array for each added column.
    """
    schema = T.StructType([df.schema[c] for c in keep] + list(added))
    kinds = [_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for low, high, texts in text_slices(batch.column(batch.num_columns - 1)):
                rows = batch.slice(low, high - low)
                columns = [rows.column(i) for i in range(len(keep))]
                columns += [pa.array(v, k) for v, k in zip(work(texts), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    source = df.select(*(df[c] for c in keep), df[text_col].alias("__text"))
    return map_arrow(source, run, schema)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with this package at hand, in workers that give their memory back when a task ends.

    Workers wait for the next task with what they have; an executor's memory is that of all of them.
    """
    ship(df.sparkSession)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(tidied, schema)


def release_memory() -> None:
    """Hand freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
