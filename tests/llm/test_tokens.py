"""BPE and token files against the tokenizers library, and exact round trips."""

import random
import zlib

import numpy as np
import pytest
from murmur.llm import bpe, tokenfiles
from murmur.llm.queries import TOKENIZER_FILE, tokenizer_text

public_tokenizers = pytest.importorskip("public_tokenizers")

TEXTS = [
    None, "", " \n\t", "one", "The CAT's don't, they'RE 3.14 １２ ½ Ⅷ", "naïve Ünïcode ΑΣ ΣΑΣ İstanbul ǅ ß",
    "é Å ﬁ ñ", "a\x1cb!\x1c! a\xa0b c　d\x85e", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
    "日本語のテキスト 한국어 🙂👩‍👩‍👧 ‍", "aaaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "''s 'll 'LL", "x" * 20_000, "word " * 50_000,
    "᠎​﻿", "#$%&*_-+=|\\~`^", "abc<|endoftext|", "\x00\x01",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(TOKENIZER_FILE))


def frame(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null key", "clash"), (3, "one", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def wanted(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("size", [0, 5, 1 << 16])
def test_ids_equal_the_library_whatever_the_lexicon(spark, library, size):
    df = frame(spark)
    lexicon = bpe.build_lexicon(df, tokenizer_text(), size=size) if size else bpe.Lexicon.compile({})
    rows = bpe.encode(df, tokenizer_text(), lexicon, decoded=True).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        ids = wanted(library, "null key" if r["doc_id"] is None else TEXTS[r["doc_id"]])
        assert np.frombuffer(r["ids"], np.uint32).tolist() == ids
        assert r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def thue_morse(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_words_that_collide_keep_their_own_ids(spark, library, tmp_path):
    pairs = [w for n in (1024, 2048) for w in thue_morse(n)]
    df = spark.createDataFrame([(i, f"{w} and {w}") for i, w in enumerate(pairs)], "doc_id long, text string").coalesce(1)
    want = [wanted(library, f"{w} and {w}") for w in pairs]
    rows = sorted(bpe.encode(df, tokenizer_text(), bpe.Lexicon.compile({})).collect())
    assert [np.frombuffer(r["ids"], np.uint32).tolist() for r in rows] == want
    tokenfiles.write(df, str(tmp_path / "ids"), tokenizer_text(), 2)
    rows = sorted(tokenfiles.read(spark, str(tmp_path / "ids")).collect())
    assert [np.frombuffer(r["ids"], np.uint32).tolist() for r in rows] == [w + [2] for w in want]


@pytest.mark.parametrize("bad", [lambda lengths: lengths % 2, lambda lengths: lengths, lambda lengths: lengths * 0])
def test_a_cache_with_colliding_hashes_compares_bytes(library, monkeypatch, bad):
    monkeypatch.setattr(bpe.textops, "_hash_words", lambda words, key: bad(words.ends - words.starts).astype(np.uint64))
    cache = bpe.ChunkCache(bpe.Encoder(bpe.Vocabulary(tokenizer_text()), bpe.Lexicon(bpe.mapped(bpe.Lexicon.compile({})))).chunks)
    texts = [b"one", b"two", b"one two", None, b"", b"three one", "é two".encode(), b"x" * 300, b"y" * 300]
    for batch in ([texts[0]], [texts[1]], texts, texts[::-1], [texts[7]], [texts[8]]):
        got = [np.frombuffer(i, np.uint32).tolist() for i in cache.encode(batch)]
        assert got == [wanted(library, (t or b"").decode()) for t in batch]


def test_decode_reads_ids_back(spark, library):
    df = frame(spark)
    encoded = bpe.encode(df, tokenizer_text(), bpe.Lexicon.compile({}))
    for r in bpe.decode(encoded, tokenizer_text()).collect():
        text = "null key" if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert r["decoded"] == library.decode(wanted(library, text), skip_special_tokens=False)


def test_long_words_merge_like_short_ones():
    vocabulary = bpe.Vocabulary(tokenizer_text())
    random.seed(1)
    for _ in range(400):
        word = "".join(random.choice("aeinrst'é") for _ in range(random.randint(1, bpe.LONGEST_WORD))).encode()
        ids = [vocabulary.inner[b] for b in word[:-1]] + [vocabulary.last[word[-1]]]
        if len(word) <= bpe.LONGEST_WORD:
            assert vocabulary._merge_long(ids) == vocabulary.merge(word)


def test_lexicon_finds_its_words_and_no_others():
    random.seed(2)
    words = {"".join(random.choice("abc") for _ in range(random.randint(1, 9))).encode() for _ in range(900)}
    words = {w: [random.randrange(99) for _ in range(random.randint(1, 4))] for w in words}
    lexicon = bpe.Lexicon(bpe.mapped(bpe.Lexicon.compile(words)))
    tried = [*words, *(w + b"a" for w in words), *(w[:-1] for w in words), b"zz", b"a" * 60]
    for word, number in zip(tried, lexicon.numbers(tried), strict=True):
        assert (number >= 0) == (word in words)
        if word in words:
            assert lexicon.outputs(number).tolist() == words[word]


def test_suffixes_share_states():
    words = {f"{a}{b}ing".encode(): [1] for a in "abcdef" for b in "xyz"}
    assert len(bpe.Lexicon(np.frombuffer(bpe.Lexicon.compile(words), np.uint8)).keys) == 6 + 3 + 3 + 1


def test_word_counts(spark):
    df = spark.createDataFrame([("A a, b",), ("a<|endoftext|>b",), (None,)], "text string")
    assert {tuple(r) for r in bpe.count_words(df, tokenizer_text()).collect()} == {("a", 3), ("b", 2), (",", 1)}


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 9001])
def test_planes_round_trip(bits, size):
    for width, top in ((2, 1 << 16), (4, 1 << 32)):
        ids = np.random.default_rng(size).integers(0, top, size).astype(np.uint32)
        planes = tokenfiles.shuffle_planes(ids, width, bits)
        assert len(planes) == width * (8 if bits else 1)
        assert (tokenfiles.join_planes(planes, size, width) == ids).all()


@pytest.mark.parametrize("bits,chunk", [(False, 1 << 18), (True, 3000)])
def test_files_hold_all_documents_in_order(spark, library, tmp_path, bits, chunk):
    path = str(tmp_path / "tokens")
    df = frame(spark)
    tokenfiles.write(df, path, tokenizer_text(), 2, bits=bits, chunk_ids=chunk)
    rows = sorted(tokenfiles.read(spark, path).collect(), key=lambda r: r["start"])
    keys = [None, 0, 1, 2, 3, 3, *range(4, len(TEXTS))]
    assert [r["doc_id"] for r in rows] == keys
    start = 0
    for r in rows:
        ids = np.array([*wanted(library, "null key" if r["doc_id"] is None else TEXTS[r["doc_id"]]), 2], np.uint32)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert r["ids"] == ids.tobytes()
        start += len(ids)


def test_empty_tables(spark, tmp_path):
    df = frame(spark).limit(0)
    assert bpe.encode(df, tokenizer_text(), bpe.build_lexicon(df, tokenizer_text())).count() == 0
    tokenfiles.write(df, str(tmp_path / "none"), tokenizer_text(), 2)
    assert tokenfiles.read(spark, str(tmp_path / "none")).count() == 0


def test_token_files_ask_the_library_once_for_each_of_half_a_million_words(monkeypatch):
    monkeypatch.setattr(tokenfiles, "_workers", {})
    cache = tokenfiles._library_cache(tokenizer_text())
    asked = []
    monkeypatch.setattr(cache, "resolve", lambda chunks: asked.append(len(chunks)) or [b"\x01\0\0\0"] * len(chunks))
    words = [f"w{i}".encode() for i in range(500_000)]
    for _ in range(2):
        for low in range(0, len(words), 100_000):
            cache.encode([b" ".join(words[low:low + 100_000])])
    assert sum(asked) <= len(words) + 10
