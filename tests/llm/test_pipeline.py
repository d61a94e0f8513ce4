"""Each stage of the pipeline against a plain version, and all of them on odd tables."""

import re

import corpus_pipeline as pipeline
import numpy as np
import pytest
from murmur.functions.scale import stage
from murmur.llm.queries import TOKENIZER_FILE
from murmur.llm import quality
from test_neardup import plain as plain_groups
from murmur.llm import neardup

SF_DIR = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, apply in pipeline.STAGES:
        out.append(stage(apply(spark, out[-1], SF_DIR), name))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_whole_rows(steps):
    for before, after in zip(steps[:-2], steps[1:-1], strict=True):
        assert after.columns == before.columns
        have, kept = rows(before), rows(after)
        assert len(kept) == after.count() and 0 < len(kept) <= len(have)
        assert all(have[k] == r for k, r in kept.items())


def test_language_id_drops_few(steps):
    dropped = rows(steps[0]).keys() - rows(steps[1]).keys()
    assert len(dropped) < 20


def test_quality_rules(steps):
    from test_quality import plain

    kept = rows(steps[2])
    for key, r in rows(steps[1]).items():
        n, chars, symbols, lines, dup, repeat = plain(r["text"])
        fails = (n < 20 or 100 * repeat > 30 * n or 10 * symbols > n or (dup >= 3 and 10 * dup > 3 * lines)
                 or chars > 20 * n or chars < 2 * n)
        assert fails == (key not in kept), key


def test_near_dedup(steps):
    before = rows(steps[2])
    settings = neardup.Settings(width=5, percent=80)
    want = plain_groups([(k, r["text"]) for k, r in before.items()], settings)
    assert rows(steps[3]).keys() == {k for k, (_, component) in want.items() if k == component}


def test_decontamination(spark, steps):
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [split(r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    grams = {tuple(w[i:i + 13]) for w in items for i in range(len(w) - 12)}
    dirty = {k for k, r in rows(steps[3]).items()
             if any(tuple(w[i:i + 13]) in grams for w in [split(r["text"])] for i in range(len(w) - 12))}
    assert rows(steps[3]).keys() - rows(steps[4]).keys() == dirty


def test_ids(steps):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(TOKENIZER_FILE))
    texts, got = rows(steps[4]), rows(steps[5])
    assert got.keys() == texts.keys()
    for key, r in got.items():
        assert np.frombuffer(r["ids"], np.uint32).tolist() == library.encode(texts[key]["text"], add_special_tokens=False).ids


def test_odd_tables(spark):
    long = "Les mots de la phrase sont dans un ordre qui ne dit rien du tout pour le moment et " + " ".join(f"mot{i}" for i in range(20_000))
    english = "The words of this sentence are in an order that says nothing at all for the moment and that is it then for all of us."
    data = [(1, None, "en", "a"), (2, "", None, None), (3, english, "en", "a"), (3, english, "en", "a"), (4, english, "en", "b"),
            (None, english, None, "c"), (5, long, "fr", "c"), (6, "1 2 3", None, None)]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in data],
                                 "doc_id long, text string, lang string, source string, score string, row string, accepted int")
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, apply in pipeline.STAGES:
            columns = now.columns
            now = stage(apply(spark, now, SF_DIR), name)
            if name != "bpe_encoding":
                assert now.columns == columns
        found = {r["doc_id"] for r in now.collect()}
        assert found == (set() if empty else {3, 5})


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_near_dedup_drops_rows_not_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (None, c), (None, c + " end"), (8, c), (None, b), (6, None), (6, None), (7, ""), (9, a + " x"), (4, "solo text"), (4, "solo text")]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string").repartition(4)
    got = texts(pipeline.near_dedup(spark, docs, SF_DIR))
    assert got == sorted([(1, a), (5, b), (8, c), (6, None), (6, None), (7, ""), (4, "solo text")], key=repr)


def test_decontamination_drops_rows_not_ids(spark):
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").first()["text"]
    rows = [(1, f"so: {item}"), (1, "a clean text"), (None, item.upper()), (None, "another clean text"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert texts(pipeline.decontamination(spark, docs, SF_DIR)) == sorted(
        [(1, "a clean text"), (None, "another clean text"), (2, None)], key=repr)
