"""Copies, re-parameterised questions and clean texts."""

import re

import pytest
from murmur.llm import decontaminate as d

SF_DIR = "/root/testdata/sf0.01"
ITEM = "A train leaves Boston at 9 with 120 passengers and travels 300 km to Albany while another train with 120 seats waits there"
OTHER = "the quick brown fox jumps over the lazy dog near the river bank today"
FILLER = " ".join(f"filler{i}" for i in range(50))

DOCS = {
    1: f"{FILLER}. {ITEM}. {FILLER}",
    2: f"{FILLER}. " + ITEM.replace("120", "85").replace("Boston", "Denver").replace("Albany", "Dallas").replace("300 km", "1,250.5 miles"),
    3: f"{FILLER}. " + ITEM.replace("with 120 passengers", "with 85 passengers"),  # one slot value became two
    4: FILLER, 5: None, 6: "", 7: "A train leaves", 8: ITEM.upper(), 9: f"{OTHER}, {ITEM}; {OTHER}!",
    10: " ".join(ITEM.split()[:15]) + " " + FILLER, 11: " ".join(ITEM.split()[3:13]) + " " + FILLER,
    12: (FILLER + " ") * 5000 + ITEM, 13: "12 34 56 78 90 12 34 56 78 90 12 34 56 78 90 12 34",
}


def frames(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in DOCS.items()] + [(None, ITEM, "clash"), (1, DOCS[1], "clash")],
                                 "doc_id long, text string, item string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "too short"), (2, OTHER), (None, ITEM)],
                                  "item_id long, text string")
    return docs, items


@pytest.mark.parametrize("bound", [200_000, 0])
def test_items_are_found_up_to_their_slots(spark, monkeypatch, bound):
    docs, items = frames(spark)
    monkeypatch.setattr(d, "fits_broadcast", lambda df, **_: bound > 0)
    got = {(r["doc_id"], r["item_id"]): r for r in d.contaminated(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (8, 1), (9, 1), (9, 2), (10, 1), (12, 1)}
    assert {k[0] for k, r in got.items() if r["changed"]} == {2}
    assert got[1, 1]["n_runs"] == 1


def test_slots_must_agree(spark):
    docs, items = frames(spark)
    runs = d.matches(docs.where("doc_id = 3"), items).collect()
    assert runs == []


def test_clean_numbers_and_empty_tables(spark):
    docs, items = frames(spark)
    assert d.matches(docs.where("doc_id in (4, 13)"), items).count() == 0
    assert d.matches(docs.limit(0), items).count() == 0
    assert d.matches(docs, items.limit(0)).count() == 0


def test_canonical_words():
    t = d.canonicalise([b"In Paris it was 3,5 km. Then 12 Cats.", None, "Über Ärger".encode()], d._unit_hashes())
    kinds = {int(d._NUMBER): "num", int(d._NAME): "name", int(d._UNIT): "unit"}
    assert [kinds.get(int(h), "") for h in t.canonical] == ["", "name", "", "", "num", "unit", "", "num", "name", "", "name"]
    assert t.bounds.tolist() == [0, 9, 9, 11]


def split(text):
    """Lower-cased words between white space and punctuation, numbers whole."""
    text = re.sub("[\u00a0\u00a1\u00ab\u00b7\u00bb\u00bf\u2000-\u206f]", " ", (text or "").lower())
    text = re.sub(r"(?<=[0-9])[.,](?=[0-9])", "\x01", text)
    return [w.replace("\x01", "") for w in re.split(r"[\x20\x09-\x0D!-/:-@\[-`{-~]+", text) if w]


def copied(text, item):
    """Whether the texts share a run of 13 words, or all of an item of 3 to 12."""
    a, b = split(text), split(item)
    n = min(13, len(b))
    grams = {tuple(b[i:i + n]) for i in range(len(b) - n + 1)} if len(b) >= 3 else set()
    return any(tuple(a[i:i + n]) in grams for i in range(len(a) - n + 1))


ITEMS = {
    1: "The boy gave Anna 5 apples, 3 pears and 12.5 kg of figs; how many kg of fruit did Anna get from the boy?",
    2: "2 4 8 16 32 64 128 256 what is the next number here", 3: "What is the capital of France?", 4: "Who wrote Hamlet?", 5: "Paris", 6: "To be",
    7: "1914 Sarajevo 1918 Compi\u00e8gne 1919 Versailles 1939 Danzig 1945 Berlin 1949 Bonn 1990", 8: "1 1 2 3 5 8 13 21 34 55 89 144 233 377 610 987 1597 2584 4181 6765 10946 17711 28657",
    9: "\u00dcber \u00c4rger spricht man nicht gern, sagte Frau \u00d6sterreich am Abend zu ihrem Mann in K\u00f6ln", 10: "one two three four five six seven eight nine ten eleven twelve",
    11: None, 12: "",
}


def wrapped(text):
    words = text.split(" ")
    return "\n".join(" ".join(words[i:i + 4]) for i in range(0, len(words), 4))


SHAPES = {
    "plain": lambda t: t, "upper": str.upper, "lower": str.lower, "title": str.title, "wrapped": wrapped, "quoted": lambda t: f'He said: "{t}"',
    "curly": lambda t: f"\u201c{t}\u201d", "inside": lambda t: f"Now read {t} and answer", "commas": lambda t: ", ".join(t.replace(",", "").split(" ")),
    "dashes": lambda t: t.replace(" ", " \u2014 "), "less": lambda t: " ".join(t.split(" ")[1:]), "split": lambda t: " ".join(w + " uh" for w in t.split(" ")),
    "other": lambda t: t.replace("5", "7").replace("Anna", "Berta"),
}


@pytest.mark.parametrize("small", [True, False])
def test_copies_are_found_in_any_dress(spark, monkeypatch, small):
    monkeypatch.setattr(d, "fits_broadcast", lambda df, **_: small)
    docs = {f"{name} {i}": shape(t) for name, shape in SHAPES.items() for i, t in ITEMS.items() if t}
    docs |= {"filler": FILLER, "mixed": " ".join(t for t in ITEMS.values() if t), "none": None}
    frame = spark.createDataFrame(list(docs.items()), "doc_id string, text string").repartition(3)
    items = spark.createDataFrame(list(ITEMS.items()), "item_id long, text string")
    want = {(k, i) for k, t in docs.items() for i, item in ITEMS.items() if copied(t, item)}
    assert {("upper 1", 1), ("inside 2", 2), ("wrapped 3", 3), ("lower 4", 4), ("upper 7", 7), ("curly 8", 8), ("upper 9", 9), ("dashes 10", 10)} <= want
    got = {(r["doc_id"], r["item_id"]): r["changed"] for r in d.contaminated(frame, items).collect()}
    assert {k for k, changed in got.items() if not changed} == want
    assert {k for k, changed in got.items() if changed} == {("other 1", 1)}


def test_benchmark_of_the_test_data(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    texts, questions = docs.collect(), items.collect()
    grams = {}
    for q in questions:
        words = split(q["text"])
        for i in range(len(words) - 12):
            grams.setdefault(tuple(words[i:i + 13]), set()).add(q["item_id"])
    want = set()
    for r in texts:
        words = split(r["text"])
        for i in range(len(words) - 12):
            want |= {(r["doc_id"], item) for item in grams.get(tuple(words[i:i + 13]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, items).where("not changed").collect()}
    assert got == want and want
