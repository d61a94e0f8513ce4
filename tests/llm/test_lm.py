"""Scores against the definition, word by word."""

import math
import re
from collections import Counter

import pytest
from murmur.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["The cat sat on the mat", "the cat sat on the hat", "the dog sat", None, "", "unique words only here", "the cat sat on the mat",
         "the the the the", "x", "é É the cat", "a b " * 3000]


def plain(texts, order, alpha):
    split = [WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    grams = [[Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) for k in range(1, order + 1)] for w in split]
    total = [sum((g[k] for g in grams), Counter()) for k in range(order)]
    size, out = sum(map(len, split)), []
    for words, own in zip(split, grams, strict=True):
        rest = max(size - len(words), 1)
        count = lambda g: total[len(g) - 1][g] - own[len(g) - 1][g]  # noqa: E731, B023
        log = back = 0
        for i in range(len(words)):
            steps = 0
            for k in range(min(order, i + 1), 0, -1):
                gram = tuple(words[i - k + 1:i + 1])
                if k == 1:
                    value = max(count(gram), 0.5) / rest
                elif count(gram) > 0:
                    value = count(gram) / count(gram[:-1])
                else:
                    steps += 1
                    continue
                break
            log += steps * math.log(alpha) + math.log(value)
            back += steps
        out.append((len(words), back, log))
    return out


@pytest.mark.parametrize("settings", [
    lm.Settings(), lm.Settings(order=1), lm.Settings(order=3), lm.Settings(order=3, chunk_bytes=40, range_words=3)])
@pytest.mark.parametrize("scores", [lm.scores, lm.joined_scores])
def test_scores_follow_the_definition(spark, settings, scores):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, chunk int").repartition(3)
    got = {r["doc_id"]: r for r in scores(df, settings=settings).collect()}
    for key, (n, back, log) in enumerate(plain(TEXTS, settings.order, settings.alpha)):
        assert (got[key]["n_words"], got[key]["n_backoffs"]) == (n, back)
        assert got[key]["log_score"] == pytest.approx(log, rel=1e-9)
        assert (got[key]["score"] is None) == (n == 0)


@pytest.mark.parametrize("scores", [lm.scores, lm.joined_scores])
def test_null_and_repeated_keys_and_empty_tables(spark, scores):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    rows = scores(df).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None", "None"]
    assert len({r["score"] for r in rows if r["n_words"]}) == 1
    assert scores(df.limit(0)).count() == 0
    assert scores(spark.createDataFrame([("k", "alone here")], "doc_id string, text string")).first()["n_words"] == 2


def test_heavy_grams_are_broadcast_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"the cat {i % 7} sat {i}") for i in range(300)], "doc_id long, text string")
    want = {r["doc_id"]: r for r in lm.scores(df, settings=lm.Settings(order=3)).collect()}
    monkeypatch.setattr(lm, "HEAVY_GRAMS", 10)
    got = {r["doc_id"]: r for r in lm.joined_scores(df, settings=lm.Settings(order=3)).collect()}
    assert got.keys() == want.keys()
    assert all(got[k]["n_backoffs"] == want[k]["n_backoffs"] and got[k]["log_score"] == pytest.approx(want[k]["log_score"]) for k in want)
