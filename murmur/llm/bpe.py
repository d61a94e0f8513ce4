"""BPE encoding and decoding with a lexicon of frequent words.

Frequent words of the corpus, with their token ids as outputs, are compiled into a
minimal acyclic transducer: equal suffixes share states, each transition carries the
number of words it skips, and the sum along a path is the word's number, which
points at its ids. Tasks map the compiled file into memory and look words up
together. Every other word is merged exactly, so the lexicon changes the time, never
the ids.
"""

from __future__ import annotations

import heapq
import json
import os
import tempfile
import unicodedata
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from murmur.functions.scale import nth_largest, stage
from murmur.llm import textops

LEXICON_WORDS = 1 << 16
LONGEST_WORD = 48
CACHED_CHUNKS = 250_000
CACHED_WORDS = 50_000
_COUNTED_AT_ONCE = 300_000
_ID_BITS = 24
_ID_MASK = (1 << _ID_BITS) - 1
_NO_MERGE = 1 << 62

# What separates pieces, and the pieces themselves, as the tokenizer file has them.
_WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizer file with byte-level words and word ends."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token.encode()
        symbols = _byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + end] for s in symbols]
        self.size = size
        # a pair's rank above its merged id, so that the least number is the merge to make
        self.merges = {ids[a] * size + ids[b]: rank << _ID_BITS | ids[a + b] for rank, (a, b) in enumerate(model["merges"])}
        self.mark = os.path.commonprefix(list(self.special))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")"
                                   ) if self.special else None

    def pieces(self, chunk: str) -> list[str | int]:
        """Words of a text without spaces, normalised, and ids of special tokens in it."""
        if not self.special or self.mark not in chunk:
            return self._words(chunk)
        out: list[str | int] = []
        for i, part in enumerate(self.split.split(chunk)):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out += self._words(part)
        return out

    @staticmethod
    def _words(part: str) -> list[str]:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        part = part.lower()
        if part.isalpha():  # letters alone, or before one mark, are most of any text
            return [part]
        if part[-1] in ",." and part[:-1].isalpha():
            return [part[:-1], part[-1]]
        return _PIECE.findall(part)

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word: the pair of lowest rank, of those the leftmost, merges first."""
        ids = [self.inner[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        if len(ids) > LONGEST_WORD:
            return self._merge_long(ids)
        find, size = self.merges.get, self.size
        pairs = [find(a * size + b, _NO_MERGE) for a, b in zip(ids, ids[1:], strict=False)]
        while pairs:
            best = min(pairs)
            if best == _NO_MERGE:
                break
            at = pairs.index(best)
            ids[at:at + 2] = [best & _ID_MASK]
            del pairs[at]
            if at:
                pairs[at - 1] = find(ids[at - 1] * size + ids[at], _NO_MERGE)
            if at < len(pairs):
                pairs[at] = find(ids[at] * size + ids[at + 1], _NO_MERGE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        find, size, n = self.merges.get, self.size, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(m >> _ID_BITS, i, m & _ID_MASK, ids[i], ids[i + 1]) for i in range(n - 1)
                 if (m := find(ids[i] * size + ids[i + 1], -1)) >= 0]
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < n and (m := find(ids[left] * size + ids[after[left]], -1)) >= 0:
                    heapq.heappush(queue, (m >> _ID_BITS, left, m & _ID_MASK, ids[left], ids[after[left]]))
        return [i for i in ids if i >= 0]

    def decode(self, ids: Sequence[int]) -> bytes:
        """Tokens joined by one space, which is what a file without a decoder asks for."""
        return b" ".join(map(self.tokens.__getitem__, ids))


class Lexicon:
    """A minimal acyclic transducer from words to token ids, in flat arrays."""

    _MAGIC = b"MAST0001"

    def __init__(self, data: np.ndarray):
        """``data``: the bytes of a compiled lexicon, for instance a memory map."""
        if bytes(data[:8]) != self._MAGIC:
            raise ValueError("not a compiled lexicon")
        sizes = data[8:48].view(np.int64)
        arrays, at = [], 48
        for size, kind in zip(sizes, (np.int64, np.uint32, np.uint32, np.uint32, np.uint32), strict=True):
            stop = at + int(size) * np.dtype(kind).itemsize
            arrays.append(data[at:stop].view(kind))
            at = stop + -stop % 8
        self.keys, self.targets, self.skips, self.first, self.ids = arrays
        self.start = int(sizes[1]) and int(self.targets[-1])

    @classmethod
    def compile(cls, words: dict[bytes, Sequence[int]]) -> bytes:
        """The file for these words. A state is registered once its suffixes are complete."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((byte, target), ...))
        path: list[list] = [[False, []]]

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                final, edges = path.pop()
                key = (final, tuple(edges))
                found = register.get(key)
                if found is None:
                    found = register[key] = len(states)
                    states.append(key)
                path[-1][1][-1] = (path[-1][1][-1][0], found)

        ordered, before = sorted(words), b""
        for word in ordered:
            shared = 0
            while shared < min(len(word), len(before)) and word[shared] == before[shared]:
                shared += 1
            close(shared)
            for byte in word[shared:]:
                path[-1][1].append((byte, -1))
                path.append([False, []])
            path[-1][0] = True
            before = word
        close(0)
        root = len(states)
        states.append((path[0][0], tuple(path[0][1])))
        below = [0] * len(states)
        keys, targets, skips = [], [], []
        for state, (final, edges) in enumerate(states):  # targets come before their sources
            below[state] = int(final)
            for byte, target in edges:
                keys.append(state << 8 | byte)
                targets.append(target << 1 | int(states[target][0]))
                skips.append(below[state])
                below[state] += below[target]
        keys.append((root + 1) << 8)  # past every state: where the walk begins
        targets.append(root)
        skips.append(0)
        first = np.concatenate([[0], np.cumsum([len(words[w]) for w in ordered])])
        ids = [i for w in ordered for i in words[w]]
        arrays = [np.array(keys, np.int64), np.array(targets, np.uint32), np.array(skips, np.uint32),
                  np.array(first, np.uint32), np.array(ids, np.uint32)]
        out = cls._MAGIC + np.array([len(a) for a in arrays], np.int64).tobytes()
        for a in arrays:
            out += a.tobytes()
            out += b"\0" * (-len(out) % 8)
        return out

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word, or -1; all words take each step together."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.full(len(words), self.start, np.int64)
        number = np.zeros(len(words), np.int64)
        final = np.zeros(len(words), bool)
        live = np.flatnonzero((lengths > 0) & (lengths <= LONGEST_WORD))
        number[lengths > LONGEST_WORD] = -1
        for position in range(LONGEST_WORD):
            live = live[lengths[live] > position]
            if not len(live):
                break
            key = state[live] << 8 | flat[starts[live] + position]
            at = np.searchsorted(self.keys, key)
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == key
            final[live[~known]] = False
            number[live[~known]] = -1
            live, at = live[known], at[known]
            number[live] += self.skips[at]
            state[live] = self.targets[at] >> 1
            final[live] = self.targets[at] & 1
        return np.where(final, number, -1)

    def outputs(self, number: int) -> np.ndarray:
        return self.ids[self.first[number]:self.first[number + 1]]


def mapped(compiled: bytes) -> np.ndarray:
    """The lexicon's bytes as a memory map of a file that goes when the worker does."""
    with tempfile.TemporaryFile() as file:
        file.write(compiled)
        file.flush()
        return np.memmap(file, np.uint8, "r")


class ChunkCache:
    """Ids of texts between ASCII spaces, which are encoded alone: no word spans a space.

    Chunks are looked up a batch at a time by a 64-bit hash in sorted arrays, and compared byte for byte with what is found;
    ``resolve`` encodes those not seen before. A chunk takes some 60 bytes, and the cache is emptied when full, so a
    worker's memory is bounded whatever the number of texts. A slice with two chunks of one hash is encoded without
    the cache.
    """

    def __init__(self, resolve: Callable[[list[bytes]], list[bytes]], limit: int = CACHED_CHUNKS, key: int | None = None):
        self.resolve, self.limit = resolve, limit
        self.key = textops.fresh_key() if key is None else key
        self._empty()

    def _empty(self) -> None:
        self.main = self.fresh = (np.zeros(0, np.uint64), np.zeros(0, np.int64))  # sorted hashes, entry numbers
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.first_block, self.blocks = np.zeros(1, np.int64), np.zeros(0, np.uint64)  # the chunks' own bytes
        self.lengths = np.zeros(1, np.int64)
        self.n_entries = self.n_ids = self.n_blocks = 0

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
        keys, entries = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")
        return keys[order], entries[order]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, np.int64)
        for keys, entries in (self.main, self.fresh):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                found[hit] = entries[at[hit]]
        return found

    def _add(self, hashes: np.ndarray, chunks: list[bytes], blocks: np.ndarray) -> np.ndarray:
        encoded = self.resolve(chunks)
        ids = np.frombuffer(b"".join(encoded), np.uint32)
        ends = self.n_ids + np.cumsum(np.fromiter((len(e) // 4 for e in encoded), np.int64, len(encoded)))
        entries = self.n_entries + np.arange(len(encoded))
        while self.n_entries + len(encoded) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.first_block = np.concatenate([self.first_block, np.zeros_like(self.first_block)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids) // 2), np.uint32)])
        if self.n_blocks + len(blocks) > len(self.blocks):
            self.blocks = np.concatenate([self.blocks, np.zeros(max(len(blocks), len(self.blocks) // 2), np.uint64)])
        lengths = np.fromiter((len(c) for c in chunks), np.int64, len(chunks))
        self.first[entries + 1] = ends
        self.first_block[entries + 1] = self.n_blocks + np.cumsum((lengths + 7) >> 3)
        self.lengths[entries] = lengths
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        self.blocks[self.n_blocks:self.n_blocks + len(blocks)] = blocks
        self.n_entries, self.n_ids, self.n_blocks = self.n_entries + len(encoded), self.n_ids + len(ids), self.n_blocks + len(blocks)
        self.fresh = self._merged(self.fresh, (hashes, entries))
        if len(self.fresh[0]) > 50_000 + len(self.main[0]) // 8:
            self.main, self.fresh = self._merged(self.main, self.fresh), (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        return entries

    def encode(self, texts: Sequence[bytes | None]) -> list[bytes]:
        """Little-endian ids of each text; NULL is empty."""
        if self.n_entries > self.limit:
            self._empty()
        words = textops.split_words(texts, key=self.key)
        hashes, sample, again = np.unique(words.hashes, return_index=True, return_inverse=True)
        entry = self._find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw = words.buffer.tobytes()
            spans = zip(words.starts[sample[new]].tolist(), words.ends[sample[new]].tolist(), strict=True)
            lengths = words.ends[sample[new]] - words.starts[sample[new]]
            blocks = words.blocks[textops.spans(words.first_block[sample[new]], (lengths + 7) >> 3)]
            entry[new] = self._add(hashes[new], [raw[a:b] for a, b in spans], blocks)
        entry = entry[again.reshape(-1)]
        if not self._same(words, entry):
            return self._one_by_one(texts)
        start = self.first[entry]
        sizes = self.first[entry + 1] - start
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(start - ends[:-1], sizes) + np.arange(ends[-1])]
        cuts = ends[words.bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


    def _same(self, words: textops.Words, entry: np.ndarray) -> bool:
        """Whether every chunk has the bytes of the entry found for it."""
        lengths = words.ends - words.starts
        if not (self.lengths[entry] == lengths).all():
            return False
        return bool((self.blocks[textops.spans(self.first_block[entry], (lengths + 7) >> 3)] == words.blocks).all())

    def _one_by_one(self, texts: Sequence[bytes | None]) -> list[bytes]:
        split = [textops.ascii_words(t or b"") for t in texts]
        chunks = list(set().union(*split))
        known = dict(zip(chunks, self.resolve(chunks), strict=True))
        return [b"".join([known[c] for c in parts]) for parts in split]


class Encoder:
    """Encodes chunks with the lexicon, and what it lacks by merging."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.known: dict[str | int, bytes] = {}

    def chunks(self, chunks: list[bytes]) -> list[bytes]:
        pieces = self.vocabulary.pieces
        split = [pieces(c.decode("utf-8", "replace")) for c in chunks]
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        self._learn(list(set().union(*split) - self.known.keys()))
        known = self.known
        return [known[parts[0]] if len(parts) == 1 else b"".join([known[p] for p in parts]) for parts in split]

    def _learn(self, words: list[str | int]) -> None:
        known, merge, outputs = self.known, self.vocabulary.merge, self.lexicon.outputs
        known.update((w, array("I", [w]).tobytes()) for w in words if isinstance(w, int))
        words = [w for w in words if isinstance(w, str)]
        raw = [w.encode() for w in words]
        for word, text, number in zip(words, raw, self.lexicon.numbers(raw).tolist(), strict=True):
            known[word] = outputs(number).tobytes() if number >= 0 else array("I", merge(text)).tobytes()


def count_words(df: DataFrame, vocabulary_text: str, text_col: str = "text") -> DataFrame:
    """How often each word (normalised, without special tokens) occurs in all texts.

    Columns ``word`` and ``n``. Each task sums what it reads, so a frequent word is one
    row per task in the shuffle. NULL and empty texts add nothing.
    """
    schema = "word string, n long"
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for chunk, n in seen.items():
                for piece in vocabulary.pieces(chunk.decode("utf-8", "replace")):
                    if isinstance(piece, str):
                        words[piece] += n
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for _, _, texts in textops.text_slices(batch.column(0)):
                for text in texts:
                    seen.update((text or b"").split())
                if len(seen) > _COUNTED_AT_ONCE:
                    yield flush()
        yield flush()

    counted = textops.map_arrow(df.select(df[text_col]), run, schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, vocabulary_text: str, text_col: str = "text", size: int = LEXICON_WORDS) -> bytes:
    """Compile the ``size`` most frequent words of all texts, ties by word.

    Only these words, of at most ``LONGEST_WORD`` bytes each, come to the driver: the count that the last of them
    has is found first, so that partitions don't send ``size`` words each. A word
    seen once is left out: looking it up would save nothing. An empty table gives an
    empty lexicon.
    """
    counted = stage(count_words(df, vocabulary_text, text_col)
                    .where((F.octet_length("word") <= LONGEST_WORD) & (F.col("n") > 1)), "word-counts")
    bound = nth_largest(counted, "n", size)
    reaching = counted if bound is None else counted.where(F.col("n") >= bound)
    top = reaching.orderBy(F.desc("n"), "word").limit(size)
    vocabulary = Vocabulary(vocabulary_text)
    words = [r["word"].encode() for r in top.collect()]
    return Lexicon.compile({w: vocabulary.merge(w) for w in words})


def encode(df: DataFrame, vocabulary_text: str, lexicon: bytes, text_col: str = "text",
           keep: Sequence[str] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """Token ids of every whole text, and with ``decoded`` the text decoded from them.

    Columns: ``keep``, ``ids`` (binary: unsigned 32-bit, little-endian), ``n_tokens``,
    ``decoded``. One row comes back per row, repeated rows and NULL keys included; NULL
    and empty texts, and those of white space alone, have no ids. The strings of
    special tokens in a text become their ids. The vocabulary and the lexicon are
    broadcast: the first is a file of fixed size, the second at most
    ``LEXICON_WORDS`` words of ``LONGEST_WORD`` bytes. Nothing is shuffled.
    """
    added = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
                         + [T.StructField("decoded", T.StringType())] * decoded)
    shared = df.sparkSession.sparkContext.broadcast((vocabulary_text, lexicon))

    def make() -> Callable[[list[bytes | None]], list]:
        cache = _worker_cache(shared)

        def work(texts: list[bytes | None]) -> list:
            ids = cache.encode(texts)
            out = [ids, [len(i) // 4 for i in ids]]
            if decoded:
                read = cache.vocabulary.decode
                out.append([read(np.frombuffer(i, np.uint32).tolist()).decode("utf-8", "replace") for i in ids])
            return out

        return work

    return textops.map_texts(df, text_col, keep, added, make)


_workers: dict[int, ChunkCache] = {}


def _worker_cache(shared) -> ChunkCache:
    """One cache for all tasks of a worker that share a vocabulary and lexicon."""
    key = hash(shared.value)
    if key not in _workers:
        _workers.clear()
        text, compiled = shared.value
        vocabulary = Vocabulary(text)
        cache = ChunkCache(Encoder(vocabulary, Lexicon(mapped(compiled))).chunks)
        cache.vocabulary = vocabulary
        _workers[key] = cache
    return _workers[key]


def decode(df: DataFrame, vocabulary_text: str, ids_col: str = "ids", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Texts of binary ids: tokens joined by one space. NULL ids give NULL."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary_text)

    def make() -> Callable[[list[bytes | None]], list]:
        read = Vocabulary(shared.value).decode
        return lambda ids: [[None if i is None else read(np.frombuffer(i, np.uint32).tolist()).decode() for i in ids]]

    return textops.map_texts(df, ids_col, keep, T.StructType([T.StructField("decoded", T.StringType())]), make)
