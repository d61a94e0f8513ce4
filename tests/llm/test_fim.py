"""Cuts and outputs against a plain version, and the boundary set against sorted arrays."""

import hashlib
import re

import numpy as np
import pytest
from murmur.llm import boundaries, fim
from pyspark.sql import functions as F

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [
    None, "", " ", "\n\t ", "one", " one", "one ", "one  two", "  one\x0b\x0ctwo\r\n", "é ü x  y", "a\x1cb c\x00d",
    "has <P> inside", "has <S>", "<M>", "tail <", "<P", "P> S> <", "two\n\nlines of words\n", "𝄞 clef 𝄞", "word " * 70_000, "x" * 200_000,
    " " * 70_000 + "end", "\\Q regex $1 \\E [a-z]", "a b c d e f g",
]


def test_every_row_equals_the_plain_version(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no key here at all"), (None, None), (-7, "a b c"), (3, "same id"), (3, "same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cut = fim.transform(df.withColumn("source", F.lit("x")), keep=["doc_id", "source", "text"])
    cut = cut.withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted((repr(r["doc_id"]), r["text"] or "", r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in cut.collect())
    want = sorted((repr(i), t or "", *plain(i, t)) for i, t in rows)
    assert [repr(r) for r in got] == [repr(r) for r in want]
    assert cut.where("back <> coalesce(text, '') or back is null").count() == 0
    assert {r["form"] for r in cut.select("form").distinct().collect()} == {"plain", "spm", "psm"}


def test_other_markers_and_shares(spark):
    settings = fim.Settings(seed="7", fim_percent=100, spm_percent=0, prefix="[P$]", suffix="[S\\]", middle="[M.]")
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a [P b"), F.col("id")).alias("text"))
    cut = fim.transform(df, settings=settings, keep=["text"])
    assert cut.where("form <> 'psm'").count() == 0
    assert cut.where(fim.restored(F.col("output"), F.col("form"), settings) != F.col("text")).count() == 0


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "doc_id long, text string, form string, output string")
    assert fim.transform(df).collect() == []
    with pytest.raises(ValueError):
        fim.transform(df, keep=["doc_id", "form"])
    one = spark.createDataFrame([(1, "a b", "f", "o")], df.schema)
    assert fim.transform(one).columns == ["doc_id", *fim.ADDED.names]


@pytest.mark.parametrize("kinds, positions", [
    ({boundaries.ARRAY}, np.array([0, 5, 65_535])),
    ({boundaries.BITMAP}, np.arange(0, 65_536, 2)),
    ({boundaries.RUN}, np.concatenate([np.arange(100, 30_000), np.arange(40_000, 65_536)])),
    ({boundaries.ARRAY, boundaries.BITMAP, boundaries.RUN}, np.concatenate([
        [3, 70], 65_536 + np.arange(0, 65_536, 3), 5 * 65_536 + np.arange(65_536), [9 * 65_536, 9 * 65_536 + 65_535]])),
])
def test_select_gives_each_rank(kinds, positions):
    made = boundaries.BoundarySet.of(positions)
    assert {c.kind for c in made.containers} == kinds
    assert made.cardinality == len(positions)
    order = np.random.default_rng(0).permutation(len(positions))
    assert (made.select(order) == positions[order]).all()


def test_random_sets_and_bad_ranks():
    random = np.random.default_rng(1)
    for density in (0.0001, 0.05, 0.5, 0.97, 1.0):
        positions = np.flatnonzero(random.random(200_000) < density)
        made = boundaries.BoundarySet.of(positions)
        assert (made.select(np.arange(len(positions))) == positions).all()
    empty = boundaries.BoundarySet.of(np.zeros(0, np.int64))
    assert empty.cardinality == 0 and len(empty.select(np.zeros(0, np.int64))) == 0
    with pytest.raises(IndexError):
        made.select(np.array([made.cardinality]))
    with pytest.raises(ValueError):
        boundaries.BoundarySet.of(np.array([3, 3]))
