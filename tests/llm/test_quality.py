"""The ledger against a plain count, its policies and ablations."""

import re

import pytest
from murmur.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    twice = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines),
            len(lines) - len(set(lines)), len(twice))


TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "one", "a b c", "# * é ß|<>" * 3, "x y z\nx y z\n\nx y z \n",
    "a b c d e f g h " * 3, " ".join(f"w{i}" for i in range(40)), "loop " * 30, "long" * 50_000,
    " ".join(f"w{i % 90}" for i in range(200_000)),
]


def frame(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "a null key", "clash"), (3, "one", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


def test_measures_equal_a_plain_count(spark):
    got = {(r["doc_id"], i): r for i, r in enumerate(quality.ledger(frame(spark)).collect())}
    assert len(got) == len(TEXTS) + 2
    for (key, _), row in got.items():
        text = "a null key" if key is None else TEXTS[key]
        if text is not None and len(text) > 100_000 and " " in text:
            continue  # the plain count is quadratic
        assert tuple(row)[1:7] == plain(text), text


def test_long_periodic_text_repeats_all_words(spark):
    row = quality.ledger(frame(spark).where("doc_id = 11")).first()
    assert row["n_words"] == row["n_repeat_words"] == 200_000


def test_policies_and_ablations(spark):
    entries = quality.ledger(frame(spark))
    kept = entries.where(~quality.fails(quality.STRICT)).select("doc_id").collect()
    assert [r["doc_id"] for r in kept] == [8]
    table = {(r["version"], r["rule"]): r for r in quality.ablations(entries, [quality.BASE, quality.STRICT]).collect()}
    assert len(table) == 2 + len(quality.RULES)
    for (version, rule), row in table.items():
        policy = quality.BASE if version == "base" else quality.STRICT
        number = [r.name for r in quality.RULES].index(rule)
        bits = [r["failed_bits"] & quality.mask(policy) for r in entries.collect()]
        assert row["failing"] == sum(b >> number & 1 for b in bits)
        assert row["only"] == sum(b == 1 << number for b in bits)
        assert row["kept"] == sum(b == 0 for b in bits)


def test_empty_table(spark):
    empty = frame(spark).limit(0)
    assert quality.ledger(empty).count() == 0
    assert {tuple(r)[2:] for r in quality.ablations(quality.ledger(empty), [quality.BASE]).collect()} == {(0, 0, 0)}


def test_a_stored_ledger_serves_later_policies(spark, tmp_path):
    path = quality.store(quality.ledger(frame(spark)), str(tmp_path / "ledger"))
    entries, rules = quality.load(spark, path)
    assert rules == quality.RULES
    for policy in (quality.BASE, quality.FIRST, quality.STRICT, quality.Policy("odd", ("short_words",)), quality.Policy("none", ())):
        want = quality.ledger(frame(spark)).where(quality.fails(policy)).count()
        assert entries.where(quality.fails(policy, rules)).count() == want
    fewer = quality.store(quality.ledger(frame(spark), rules=quality.RULES[:2]), str(tmp_path / "old"), quality.RULES[:2])
    entries, rules = quality.load(spark, fewer)
    assert entries.where(quality.fails(quality.BASE, rules)).count() > 0
    with pytest.raises(ValueError):
        quality.fails(quality.STRICT, rules)


def test_windows_of_words_that_collide_by_construction_do_not_repeat(spark):
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rest = "c d e f g h i"
    df = spark.createDataFrame([(1, f"{one} {rest} {two} {rest}")], "doc_id long, text string")
    assert quality.ledger(df).first()["n_repeat_words"] == plain(f"{one} {rest} {two} {rest}")[-1] == 0
