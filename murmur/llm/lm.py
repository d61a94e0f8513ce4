"""Stupid-backoff scores of whole texts under a model counted from all of them.

N-gram counts are partitioned by hash. Documents are packed into chunks; a chunk asks
each hash range for its distinct n-grams, with how often it has them. A range adds up
what all chunks hold and answers each in the order it asked, so answers carry no
keys. A chunk then scores its documents. Rows on the way are distinct n-grams of a
chunk, packed, never single occurrences.

A document is scored by what the others say: its own occurrences are taken off
every count, or each n-gram would vouch for itself and backing off never happen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.scale import stage
from murmur.llm import textops


#: So many of the most frequent n-grams at most are broadcast by ``joined_scores``.
HEAVY_GRAMS = 200_000


@dataclass(frozen=True)
class Settings:
    """``order`` words in the longest n-gram; ``alpha`` for each step back; sizes of chunks and hash ranges."""

    order: int = 2
    alpha: float = 0.4
    chunk_bytes: int = 12 << 20
    range_words: int = 4 << 20


def _pack(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values by byte planes, compressed: high bytes of small values cost nothing."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.zeros(1, np.uint64)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data), dtype=np.uint64)


def _chunked(df: DataFrame, key_col: str, text_col: str, settings: Settings, secret: int) -> DataFrame:
    """Chunks of documents as word numbers: ``chunk``, ``keys``, ``n_words``, ``bounds``, ``vocabulary``, ``words``."""
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("keys", T.ArrayType(df.schema[key_col].dataType)),
        T.StructField("n_words", T.LongType()), T.StructField("bounds", T.BinaryType()),
        T.StructField("vocabulary", T.BinaryType()), T.StructField("words", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number, size = TaskContext.get().partitionId(), 0, 0
        keys, counts, hashes = [], [], []

        def flush() -> pa.RecordBatch:
            vocabulary, words = np.unique(np.concatenate(hashes), return_inverse=True)
            bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.uint64)
            all_keys = pa.concat_arrays(keys)
            return pa.RecordBatch.from_arrays([
                pa.array([partition << 32 | number]),
                pa.ListArray.from_arrays(pa.array([0, len(all_keys)], pa.int32()), all_keys),
                pa.array([len(words)]), pa.array([_pack_sorted(bounds)]), pa.array([_pack_sorted(vocabulary)]),
                pa.array([_pack(words.reshape(-1))])], names=schema.names)

        for batch in batches:
            texts = textops.blobs(batch.column(1))
            for low, high in textops.row_slices(texts):
                words = textops.split_words(texts[low:high], lower=True, key=secret)
                keys.append(batch.column(0).slice(low, high - low))
                counts.append(words.counts)
                hashes.append(words.hashes)
                size += len(words.buffer)
                if size >= settings.chunk_bytes:
                    yield flush()
                    number, size = number + 1, 0
                    keys, counts, hashes = [], [], []
        if keys:
            yield flush()

    return textops.map_arrow(df.select(df[key_col], df[text_col]), run, schema)


def _grams(hashes: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram, and the number of its last word."""
    keys, at = (hashes, np.arange(len(hashes))) if order == 1 else textops.windows(hashes, bounds, order)
    return keys, at + order - 1


def _requests(chunks: DataFrame, ranges: int, settings: Settings) -> DataFrame:
    """What each chunk holds of each order and hash range: ``grams`` (sorted hashes) and ``counts``."""
    schema = "chunk long, gram_order int, hash_range int, grams binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, bounds, vocabulary, words = (c[row].as_py() for c in batch.columns)
                bounds, hashes = _unpack_sorted(bounds).astype(np.int64), _unpack_sorted(vocabulary)[_unpack(words)]
                for order in range(1, settings.order + 1):
                    grams, counts = np.unique(_grams(hashes, bounds, order)[0], return_counts=True)
                    cuts = [0, *np.searchsorted(grams, edges).tolist(), len(grams)]
                    cells = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([chunk] * len(cells), pa.int64()), pa.array([order] * len(cells), pa.int32()),
                        pa.array([i for i, _, _ in cells], pa.int32()),
                        pa.array([_pack_sorted(grams[a:b]) for _, a, b in cells], pa.binary()),
                        pa.array([_pack(counts[a:b]) for _, a, b in cells], pa.binary()),
                    ], names=["chunk", "gram_order", "hash_range", "grams", "counts"])

    return textops.map_arrow(chunks.select("chunk", "bounds", "vocabulary", "words"), run, schema)


def _answers(requests: DataFrame) -> DataFrame:
    """Corpus counts of the n-grams of each request, in its order."""
    def add(key: tuple, held: pa.Table) -> pa.Table:
        lists = [_unpack_sorted(g) for g in held.column("grams").to_pylist()]
        counts = np.concatenate([_unpack(c) for c in held.column("counts").to_pylist()])
        _, place = np.unique(np.concatenate(lists), return_inverse=True)
        place = place.reshape(-1)
        totals = np.zeros(place.max() + 1, np.uint64)
        np.add.at(totals, place, counts)
        ends = np.cumsum([len(x) for x in lists])
        packed = [_pack(totals[place[b - len(x):b]]) for x, b in zip(lists, ends, strict=True)]
        return pa.table({"chunk": held.column("chunk"), "gram_order": held.column("gram_order"),
                         "hash_range": held.column("hash_range"), "totals": pa.array(packed, pa.binary())})

    return requests.groupBy("gram_order", "hash_range").applyInArrow(
        add, "chunk long, gram_order int, hash_range int, totals binary")


def _own(place: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each occurrence's n-gram occurs in its own document."""
    size = np.int64(place.max() + 1) if len(place) else np.int64(1)
    _, again, counts = np.unique(owner * size + place, return_inverse=True, return_counts=True)
    return counts[again.reshape(-1)]


def _scored(chunks: DataFrame, answers: DataFrame, total: int, key_col: str, key_type: T.DataType,
            settings: Settings) -> DataFrame:
    schema = T.StructType([
        T.StructField(key_col, key_type), T.StructField("n_words", T.LongType()), T.StructField("n_backoffs", T.LongType()),
        T.StructField("log_score", T.DoubleType())])

    def score(key: tuple, chunk: pa.Table, held: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0] if chunk.num_rows else None
        if row is None:
            raise ValueError("answers without a chunk")
        bounds = _unpack_sorted(row["bounds"]).astype(np.int64)
        hashes = _unpack_sorted(row["vocabulary"])[_unpack(row["words"])]
        counts = np.diff(bounds)
        owner = np.repeat(np.arange(len(counts)), counts)
        parts: dict[int, list] = {}
        for order, cell, totals in zip(*(held.column(c).to_pylist() for c in ("gram_order", "hash_range", "totals")),
                                       strict=True):
            parts.setdefault(order, []).append((cell, totals))
        n = len(hashes)
        rest = np.maximum(total - counts, 1)[owner].astype(float)
        log = np.zeros(n)
        # counts of other documents, for the n-gram that ends at each word; the lower order's context ends one before
        context = rest
        for order in range(1, settings.order + 1):
            grams, ends = _grams(hashes, bounds, order)
            _, place = np.unique(grams, return_inverse=True)
            place = place.reshape(-1)
            totals = np.concatenate([np.zeros(0, np.uint64), *(_unpack(t) for _, t in sorted(parts.get(order, [])))])
            others = np.zeros(n)
            others[ends] = totals[place].astype(np.int64) - _own(place, owner[ends])
            if order == 1:
                log = np.log(np.maximum(others, 0.5) / rest)
                backoffs = np.zeros(n, np.int64)
            else:
                seen = others > 0
                step = np.zeros(n, bool)
                step[ends] = True
                log = np.where(seen, np.log(np.where(seen, others, 1) / np.where(seen, context, 1)),
                               log + np.where(step, np.log(settings.alpha), 0.0))
                backoffs += step & ~seen
                backoffs[seen] = 0
            context = np.concatenate([[0.0], others[:-1]])
        return pa.table([
            pa.array(row["keys"], chunk.schema.field("keys").type.value_type), pa.array(counts),
            pa.array(np.bincount(owner, backoffs, len(counts)).astype(np.int64)),
            pa.array(np.bincount(owner, log, len(counts)).astype(float))], names=schema.names)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)


def scores(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Stupid-backoff score of every whole text.

    Columns: the key, ``n_words``, ``n_backoffs`` (steps back over all words), ``log_score`` (sum
    of the natural logarithms), ``score`` (``log_score`` per word, NULL without words). Words are runs
    of non-space bytes with A-Z lower-cased.

    S(w | context) is count(context w) / count(context) if other documents hold the n-gram, else
    ``alpha`` times S with a context shorter by its first word; without context, count(w) / words of the
    other documents, a word that no other document holds counting as half an occurrence. A text's first
    words have shorter contexts, at no cost.

    One row comes back per row; copies under any key are documents of their own. NULL and empty
    texts have no words and log_score 0. An empty table gives no rows.
    """
    chunks = stage(_chunked(df, key_col, text_col, settings, textops.fresh_key()), "lm_chunks")
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(textops.shuffle_partitions(df.sparkSession), -(-total // settings.range_words))
    answers = _answers(_requests(chunks, ranges, settings))
    scored = _scored(chunks, answers, total, key_col, df.schema[key_col].dataType, settings)
    return scored.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


# The same by joins of plain rows

_STEPS = T.StructType([
    T.StructField("place", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("longest", T.IntegerType()),
    T.StructField("words", T.IntegerType()), T.StructField("times", T.LongType()), T.StructField("gram", T.LongType()),
    T.StructField("own", T.LongType()), T.StructField("context", T.LongType()), T.StructField("context_own", T.LongType())])


def _exploded(df: DataFrame, key_col: str, text_col: str, settings: Settings, secret: int) -> DataFrame:
    """One row for each distinct longest n-gram of a document and each of its ways to be scored, from 1 word up.

    Columns: the key, ``doc`` (a number of the row's own), ``place`` (of the longest n-gram), ``n_words`` of the document, ``longest``, ``words``
    (of this n-gram), ``times`` (that the longest occurs), ``gram`` and ``context`` (hashes; the context is NULL for one word), and
    how often the document itself has both. A document without words has one row of ``longest`` 0.
    """
    schema = T.StructType([T.StructField("key", df.schema[key_col].dataType), T.StructField("doc", T.LongType()), *_STEPS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = textops.blobs(batch.column(1))
            for low, high in textops.row_slices(texts):
                words = textops.split_words(texts[low:high], lower=True, key=secret)
                counts = words.counts
                owner = np.repeat(np.arange(len(counts)), counts)
                n = len(words.hashes)
                reach = np.minimum(np.arange(n) - words.bounds[owner] + 1, settings.order)
                hashes, own = np.zeros((settings.order + 1, n), np.uint64), np.zeros((settings.order + 1, n), np.int64)
                for order in range(1, settings.order + 1):
                    grams, ends = _grams(words.hashes, words.bounds, order)
                    _, place = np.unique(grams, return_inverse=True)
                    hashes[order, ends] = grams ^ np.uint64(order)
                    own[order, ends] = _own(place.reshape(-1), owner[ends])
                longest = hashes[reach, np.arange(n)]
                _, first, times = np.unique(np.stack([owner.astype(np.uint64), longest]), axis=1, return_index=True, return_counts=True)
                for order in range(1, settings.order + 1):
                    at, often = first[reach[first] >= order], times[reach[first] >= order]
                    before = None if order == 1 else at - 1
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(low, high - low).take(pa.array(owner[at])), pa.array(doc + low + owner[at]), pa.array(at),
                        pa.array(counts[owner[at]]), pa.array(reach[at].astype(np.int32)), pa.array(np.full(len(at), order, np.int32)), pa.array(often),
                        pa.array(hashes[order, at].view(np.int64)), pa.array(own[order, at]),
                        pa.nulls(len(at), pa.int64()) if before is None else pa.array(hashes[order - 1, before].view(np.int64)),
                        pa.nulls(len(at), pa.int64()) if before is None else pa.array(own[order - 1, before])], names=schema.names)
                bare = np.flatnonzero(counts == 0)
                zeros = np.zeros(len(bare), np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low).take(pa.array(bare)), pa.array(doc + low + bare), pa.array(zeros), pa.array(zeros),
                    pa.array(zeros.astype(np.int32)), pa.array(zeros.astype(np.int32)), pa.array(zeros),
                    *(pa.nulls(len(bare), pa.int64()) for _ in range(4))], names=schema.names)
            doc += len(texts)

    return textops.map_arrow(df.select(df[key_col], df[text_col]), run, schema)


def joined_scores(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``scores`` by a count table joined to exploded n-grams and sums per document; the same rows, columns and edge cases.

    Its rows grow in proportion to the texts whatever their size, and frequent n-grams are broadcast, so none gathers in a task.
    It writes and shuffles several times what ``scores`` does, which packs the same counts.
    """
    steps = stage(_exploded(df, key_col, text_col, settings, textops.fresh_key()), "lm_steps")
    held = steps.where(F.col("words") > 0)
    # every document says once how often it has an n-gram: a shorter one stands on the rows of several longest
    own = held.select("doc", "gram", "own").distinct()
    counts = stage(own.groupBy("gram").agg(F.sum("own").alias("n"), F.count("*").alias("docs")), "lm_counts")
    total = steps.select("doc", "n_words").distinct().agg(F.sum("n_words")).first()[0] or 0
    rows = held.count()
    heavy = F.col("docs") > max(64, rows // HEAVY_GRAMS)

    def counted(steps: DataFrame, gram: str, n: str) -> DataFrame:
        few = counts.where(heavy).select(F.col("gram").alias(gram), F.col("n").alias(n))  # fewer than HEAVY_GRAMS
        many = counts.where(~heavy).select(F.col("gram").alias(gram), F.col("n").alias(n))
        light = steps.join(F.broadcast(few.select(gram)), gram, "left_anti")
        return steps.join(F.broadcast(few), gram).unionByName(light.join(many, gram))

    grams = counted(held, "gram", "n_gram")
    longer = counted(grams.where("words > 1"), "context", "n_context")
    shorter = grams.where("words = 1").withColumn("n_context", F.lit(None).cast("long"))
    both = longer.unionByName(shorter)
    others, context = F.col("n_gram") - F.col("own"), F.col("n_context") - F.col("context_own")
    rest = F.greatest(F.lit(total) - F.col("n_words"), F.lit(1))
    value = F.when(F.col("words") == 1, F.log(F.greatest(others, F.lit(0.5)) / rest)).when(others > 0, F.log(others / context))
    best = both.withColumn("value", value).where("value is not null").groupBy("doc", "place").agg(
        F.max(F.struct("words", "value", "times", "longest")).alias("best"))
    back = F.col("best.longest") - F.col("best.words")
    summed = best.groupBy("doc").agg(
        F.sum(F.col("best.times") * back).alias("n_backoffs"),
        F.sum(F.col("best.times") * (F.col("best.value") + back * float(np.log(settings.alpha)))).alias("log_score"))
    docs = steps.groupBy("doc").agg(F.first("key").alias(key_col), F.first("n_words").alias("n_words"))
    joined = docs.join(summed, "doc", "left").select(
        key_col, "n_words", F.coalesce("n_backoffs", F.lit(0)).alias("n_backoffs"), F.coalesce("log_score", F.lit(0.0)).alias("log_score"))
    return joined.withColumn("score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
