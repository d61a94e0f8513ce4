"""Held-out accuracy, and texts without language."""

import zlib

import pytest
import zstandard
from murmur.llm import langid
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").cache()


@pytest.fixture(scope="module")
def model(documents):
    return langid.fit(documents.where(~langid.held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, documents, model):
    rows = langid.predict(documents, model, keep=["doc_id", "lang"]).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 150
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.985
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["accepted"] for r in rows) / len(rows) > 0.97


def test_texts_without_language(spark, model):
    texts = [None, "", " \n", "12345 !?", "½ ٣", "日本語" * 9, "the cat and the dog of that this with " * 9000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "1", "clash")], "doc_id long, text string, score string")
    rows = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert [rows[k]["lang_pred"] for k in (None, 0, 1, 2, 3, 4)] == ["und"] * 6
    assert not any(rows[k]["accepted"] for k in (None, 0, 1, 2, 3, 4))
    assert rows[5]["lang_pred"] in model.dictionaries
    assert rows[6]["lang_pred"] == "en" and rows[6]["accepted"]
    assert langid.predict(df.limit(0), model).count() == 0


def test_models_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(1, "abc", None), (None, "abc", "xx"), (2, None, "xx"), (3, "abcd efg", "yy")],
                               "doc_id long, text string, lang string")
    one = langid.fit(df)
    assert set(one.dictionaries) == {"yy"}
    row = langid.predict(df.where("doc_id = 3"), one).first()
    assert (row["lang_pred"], row["accepted"]) == ("yy", True)
    none = langid.fit(df.limit(0))
    assert langid.predict(df.where("doc_id = 3"), none).first()["lang_pred"] == "und"
    with pytest.raises(ValueError):
        langid.fit(df, settings=langid.Settings(languages=0))


def test_equal_sizes_go_to_the_more_frequent(spark):
    model = langid.Model({"b": b"the same text", "a": b"the same text"}, langid.Settings())
    row = langid.predict(spark.createDataFrame([(1, "the same text")], "doc_id long, text string"), model).first()
    assert (row["lang_pred"], row["score"], row["accepted"]) == ("b", 0.0, False)


def plain_sizes(text, model, level):
    """Compressed size under each language's dictionary, block by block, a compressor for each block."""
    data = text.lower().encode()
    params = zstandard.ZstdCompressionParameters.from_level(level, write_checksum=0, write_content_size=0, write_dict_id=0)
    sizes = {}
    for lang, words in model.dictionaries.items():
        held = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level)
        sizes[lang] = sum(len(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(data[i:i + 2048]))
                          for i in range(0, len(data), 2048))
    return sizes


def plain_verdict(text, model):
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, False
    for level, enough in ((6, 0.01), (12, -1)):
        sizes = plain_sizes(text, model, level)
        best, second = sorted(sizes.values())[:2]
        margin = (second - best) / second
        if margin >= enough:
            return min(sizes, key=lambda k: (sizes[k], list(sizes).index(k))), margin, margin >= 0.002
    raise AssertionError


def test_predictions_equal_a_plain_comparison_of_sizes(spark, documents, model):
    some = documents.where("doc_id % 9 = 0 or length(text) < 60").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, None), (-2, "12 34"), (-3, "Straße und Wagen"), (-4, "x")], "doc_id long, text string")
    rows = langid.predict(some.union(odd), model, keep=["doc_id", "text"]).collect()
    assert len(rows) > 100
    for r in rows:
        lang, margin, accepted = plain_verdict(r["text"], model)
        assert (r["lang_pred"], r["accepted"]) == (lang, accepted) and r["score"] == pytest.approx(margin)
