"""Token files: ids in fixed-size blocks, transposed into planes and compressed.

A folder holds one row per chunk of whole documents, in ascending key order. The ids
of a chunk are cut into blocks of fixed size. Each block is transposed: plane p of
a block holds bit p, or byte p, of all its ids, so that like bits lie together. The
planes of equal rank of all blocks are compressed together with zstandard. The
other columns are the chunk's index: its place, its keys, and their numbers of ids, so
a reader of some keys opens only the chunks that have them.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.llm import textops
from murmur.llm.bpe import ChunkCache

BLOCK_IDS = 4096
CHUNK_IDS = 1 << 18
LEVEL = 3

CHUNKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
    T.StructField("n_ids", T.LongType()), T.StructField("width", T.IntegerType()),
    T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("planes", T.ArrayType(T.BinaryType())),
])


def shuffle_planes(ids: np.ndarray, width: int, bits: bool = False, block: int = BLOCK_IDS) -> list[bytes]:
    """Planes of an array of ids that fit ``width`` bytes: byte planes, or bit planes."""
    padded = np.zeros(-(-len(ids) // block) * block, f"<u{width}")
    padded[:len(ids)] = ids
    cells = padded.view(np.uint8).reshape(-1, block, width)
    if bits:
        cells = np.unpackbits(cells, axis=2, bitorder="little")
        planes = np.packbits(cells.transpose(2, 0, 1), axis=2, bitorder="little")
    else:
        planes = cells.transpose(2, 0, 1)
    return [np.ascontiguousarray(p).tobytes() for p in planes]


def join_planes(planes: Sequence[bytes], n_ids: int, width: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The ids again; as many planes as bytes means byte planes, else bit planes."""
    blocks = -(-n_ids // block)
    stack = np.stack([np.frombuffer(p, np.uint8).reshape(blocks, -1) for p in planes]) if blocks else None
    if stack is None:
        return np.zeros(0, np.uint32)
    if len(planes) != width:
        stack = np.unpackbits(stack, axis=2, bitorder="little")
        cells = np.packbits(stack.transpose(1, 2, 0), axis=2, bitorder="little")
    else:
        cells = stack.transpose(1, 2, 0)
    return np.ascontiguousarray(cells).view(f"<u{width}").reshape(-1)[:n_ids].astype(np.uint32)


#: A worker keeps so many chunks: asking the library again for a word costs far more than the 60 bytes that it takes.
LIBRARY_CHUNKS = 2_000_000
_workers: dict[int, ChunkCache] = {}


def _library_cache(text: str) -> ChunkCache:
    """Ids from the tokenizers library, asked once for each text between spaces."""
    key = hash(text)
    if key not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def resolve(chunks: list[bytes]) -> list[bytes]:
            out = []
            for low in range(0, len(chunks), 4096):
                texts = [c.decode("utf-8", "replace") for c in chunks[low:low + 4096]]
                out += [np.array(e.ids, "<u4").tobytes()
                        for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return out

        _workers.clear()
        _workers[key] = ChunkCache(resolve, LIBRARY_CHUNKS)
    return _workers[key]


def write(df: DataFrame, path: str, tokenizer_text: str, end_id: int, key_col: str = "doc_id", text_col: str = "text",
          bits: bool = False, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode whole texts and write them in ascending key order, each ended by ``end_id``.

    Texts are dealt out by ranges of the key once, and encoded where they are written. A
    document is never split: one of more than ``chunk_ids`` ids is a chunk of its own.
    NULL and empty texts hold the end id alone; NULL keys come first; rows of equal key
    follow one another in no set order. An empty table writes an empty folder.

    Splitting a text at ASCII spaces leaves its ids as they are when the tokenizer's
    words never span a space, which holds for files whose words drop white space.
    """
    parts = textops.shuffle_partitions(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _library_cache(shared.value)
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        part, chunk = TaskContext.get().partitionId(), 0
        end = np.uint32(end_id).tobytes()
        keys: list[int | None] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
            row = [part, chunk, len(ids), width, list(keys), [len(h) // 4 for h in held],
                   [pack(p) for p in shuffle_planes(ids, width, bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                     pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=CHUNKS.names)

        size = 0
        for batch in batches:
            texts, own = textops.blobs(batch.column(1)), batch.column(0).to_pylist()
            for low, high in textops.row_slices(texts):
                for key, ids in zip(own[low:high], cache.encode(texts[low:high]), strict=True):
                    ids += end
                    if held and size + len(ids) // 4 > chunk_ids:
                        yield flush()
                        chunk, size = chunk + 1, 0
                        keys.clear()
                        held.clear()
                    keys.append(key)
                    held.append(ids)
                    size += len(ids) // 4
        if held:
            yield flush()

    ordered = (df.select(df[key_col].cast("long").alias("key"), df[text_col].alias("text"))
               .repartitionByRange(parts, "key").sortWithinPartitions("key"))
    textops.map_arrow(ordered, run, CHUNKS).write.option("compression", "uncompressed").parquet(path)


def chunk_starts(chunks: DataFrame) -> DataFrame:
    """The number of ids before each chunk: sums over parts, then inside a part."""
    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = totals.select("part", before.alias("part_start"))  # one row per written file
    inside = W.partitionBy("part").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    places = chunks.select("part", "chunk", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("inside"))
    return places.join(parts, "part").select("part", "chunk", (F.col("part_start") + F.col("inside")).alias("chunk_start"))


READ = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
    T.StructField("offset", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
])


def read(spark, path: str, key_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Documents of token files: key, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` (of the ids as unsigned 32-bit little-endian), and with ``with_ids`` the ids as such bytes.
    """
    chunks = spark.read.schema(CHUNKS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in range(batch.num_rows):
                part, chunk, n_ids, width, keys, lengths, planes = (c[row].as_py() for c in batch.columns)
                ids = join_planes([unpack(p) for p in planes], n_ids, width)
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                own = [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int32()),
                    pa.array([chunk] * len(keys), pa.int32()), pa.array(starts[:-1], pa.int64()),
                    pa.array(lengths, pa.int64()), pa.array([zlib.crc32(o) for o in own], pa.int64()),
                    pa.array(own if with_ids else [None] * len(own), pa.binary()),
                ], names=READ.names)

    documents = textops.map_arrow(chunks, run, READ)
    starts = chunk_starts(spark.read.schema(CHUNKS).parquet(path).select("part", "chunk", "n_ids"))
    joined = documents.join(starts, ["part", "chunk"])
    columns = [F.col("key").alias(key_col), (F.col("chunk_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"]
    return joined.select(*columns, *(["ids"] if with_ids else []))
