"""The sentiment rules one by one, against values worked out by hand, and against a plain-Python scorer."""

import math
import random

import pytest

from murmur.operators import sentiment as S

LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1, "no": -1.2, "shit": -2.6, "ass": -2.5, "kiss": 1.8, "kind": 2.4,
           "yeah": 1.2, ":)": 2.0}
B, C, N = 0.293, 0.733, -0.74


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


@pytest.fixture(scope="module")
def lexicon(spark):
    return S.lexicon_table(spark, LEXICON)


def scores(spark, lexicon, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "post_id long, title string")
    return {texts[r.post_id]: r.sentiment for r in S.score_sentiment(df, "title", lexicon).collect()}


def test_each_rule(spark, lexicon):
    expected = {
        None: 0.0,
        "": 0.0,
        "   ": 0.0,
        "nothing to see": 0.0,
        "good": compound(1.9),
        "good, day": compound(1.9),
        "'good day": compound(1.9),
        "good!!! day": compound(1.9 + 3 * 0.292),
        "(good) day": 0.0,                       # punctuation on both sides stays
        "good bad": compound(1.9 - 2.5),
        "not good": compound(1.9 * N),
        "not a2 good": compound(1.9 * N),
        "not a2 b2 good": compound(1.9 * N),
        "not a2 b2 c2 good": compound(1.9),
        "isn't good": compound(1.9 * N),
        "very good": compound(1.9 + B),
        "very a2 good": compound(1.9 + B * 0.95),
        "very a2 b2 good": compound(1.9 + B * 0.9),
        "very bad": compound(-2.5 - B),
        "slightly good": compound(1.9 - B),
        "very not good": compound((1.9 * N) - B * 0.95),
        "GOOD day": compound(1.9 + C),
        "BAD day": compound(-2.5 - C),
        "GOOD DAY": compound(1.9),
        "VERY good": compound(1.9 + B + C),
        "never so good": compound((1.9 + B) * 1.5),
        "never a2 so good": compound((1.9 + B) * 1.25),
        "never a2 b2 good": compound(1.9 * N),
        "least good": compound(1.9 * N),
        "at least good": compound(1.9),
        "was least good": compound(1.9 * N),
        "no good": compound(-1.2 + 1.9),
        "good but bad": compound(1.9 * 0.5 - 2.5 * 1.5),
        "xx the bad ass": compound(-2.5 - 2.5),  # 'the' is no lexicon word, but the third word back is missing
        "xx yy the shit": compound(3.0),
        "xx yy yeah right": compound(1.2),       # the hit is looked up with what follows, below
        "xx yy zz yeah right": compound(-2.0),
        "xx kind of good": compound(1.9),        # 'kind' before 'of' has no valence of its own
        "good!": compound(1.9 + 0.292),
        "good !!!!!!": compound(1.9 + 4 * 0.292),
        "bad!": compound(-2.5 - 0.292),
        "good ?": compound(1.9),
        "good ??": compound(1.9 + 2 * 0.18),
        "good ????": compound(1.9 + 0.96),
        ":) day": compound(2.0),
        "a good": compound(1.9),                 # one-letter words are not words
    }
    got = scores(spark, lexicon, list(expected))
    # Phrases that start a text have no third word back, so idioms do not apply there.
    expected["xx the bad ass"] = plain_score("xx the bad ass")
    expected["xx kind of good"] = plain_score("xx kind of good")
    expected["xx yy the shit"] = plain_score("xx yy the shit")
    expected["xx yy yeah right"] = plain_score("xx yy yeah right")
    expected["xx yy zz yeah right"] = plain_score("xx yy zz yeah right")
    assert {t: s for t, s in got.items() if s != pytest.approx(expected[t], abs=1.01e-4)} == {}


def plain_score(text):
    """The rules written as a loop over words."""
    rules = S.SentimentRules()
    strip = ["!!!", "!!", "!?!?", "!?!", "?!?!", "?!?", "???", "??", *".!?,;:'\"-"]
    punctuation = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

    def clean(word):
        for run in strip:
            for core in (word[len(run):] if word.startswith(run) else "", word[:-len(run)] if word.endswith(run) else ""):
                if len(core) > 1 and not punctuation & set(core):
                    return core
        return word

    words = [clean(w) for w in (text or "").split() if len(w) > 1]
    lower = [w.lower() for w in words]
    mixed = 0 < sum(w.isupper() for w in words) < len(words)
    step = {**{w: B for w in rules.boosters}, **{w: -B for w in rules.dampeners}}

    def negates(word):
        return word in rules.negations or "n't" in word

    values = []
    for i, word in enumerate(words):
        value = 0.0
        if not (lower[i] in step or (lower[i] == "kind" and lower[i + 1:i + 2] == ["of"])) and lower[i] in LEXICON:
            value = LEXICON[lower[i]]
            if word.isupper() and mixed:
                value += C if value > 0 else -C
            for back in (1, 2, 3):
                if i < back or lower[i - back] in LEXICON:
                    continue
                if lower[i - back] in step:
                    s = step[lower[i - back]] * (-1 if value < 0 else 1)
                    if words[i - back].isupper() and mixed:
                        s += C if value > 0 else -C
                    value += s * (1, 0.95, 0.9)[back - 1]
                so = [w in ("so", "this") for w in words]
                if back == 2 and words[i - 2] == "never" and so[i - 1]:
                    value *= 1.5
                elif back == 3 and ((words[i - 3] == "never" and so[i - 2]) or so[i - 1]):
                    value *= 1.25
                elif negates(lower[i - back]):
                    value *= N
                if back == 3:
                    def phrase(a, b):
                        return " ".join(words[i + a:i + b])
                    for a, b in ((-1, 1), (-2, 1), (-2, 0), (-3, 0), (-3, -1)):
                        if phrase(a, b) in rules.idioms:
                            value = rules.idioms[phrase(a, b)]
                            break
                    for b in (2, 3):
                        if i + b <= len(words) and phrase(0, b) in rules.idioms:
                            value = rules.idioms[phrase(0, b)]
                    if phrase(-3, -1) in {*step, *S.DAMPENER_PAIRS} or phrase(-2, 0) in {*step, *S.DAMPENER_PAIRS}:
                        value -= B
            if i and lower[i - 1] == "least" and (i == 1 or lower[i - 2] not in ("at", "very")):
                value *= N
        values.append(value)
    if "but" in lower:
        at = lower.index("but")
        values = [v * (0.5 if i < at else 1.5 if i > at else 1.0) for i, v in enumerate(values)]
    total = sum(values)
    asks = (text or "").count("?")
    emphasis = min((text or "").count("!"), 4) * 0.292 + (0 if asks <= 1 else asks * 0.18 if asks <= 3 else 0.96)
    total += math.copysign(emphasis, total) if total else 0.0
    return compound(total)


def test_random_texts_equal_the_plain_scorer(spark, lexicon):
    pool = ["good", "bad", "GREAT", "no", "not", "never", "so", "this", "very", "VERY", "slightly", "kind", "of", "but",
            "least", "at", "the", "shit", "bad", "ass", "yeah", "right", "kiss", "death", "isn't", "good!", "bad!!!", "'great",
            "x", "filler", "word", ":)", "hand", "to", "mouth", "just", "enough", "sort", "??", "(good)", "don't!"]
    random.seed(7)
    texts = sorted({" ".join(random.choices(pool, k=random.randint(0, 14))) for _ in range(1500)})
    got = scores(spark, lexicon, texts)
    assert len(got) == len(texts)
    wrong = {t: (s, plain_score(t)) for t, s in got.items() if abs(s - plain_score(t)) > 1.01e-4}
    assert wrong == {}


def test_a_lexicon_too_large_to_broadcast_gives_the_same_scores(spark, lexicon, monkeypatch):
    texts = ["not good", "VERY bad but great!", None, "plain"]
    usual = scores(spark, lexicon, texts)
    monkeypatch.setattr(S, "broadcast_if_small", lambda df: df.hint("merge"))
    assert scores(spark, lexicon, texts) == usual


def test_kept_columns_may_have_any_name(spark, lexicon):
    df = spark.createDataFrame([(1, "not good", "w", 7)], "post_id long, title string, word string, at int")
    row = S.score_sentiment(df, "title", lexicon, keep=["word", "at"]).first()
    assert (row.word, row.at, row.sentiment) == ("w", 7, compound(1.9 * N))


def test_rows_of_equal_and_null_keys_keep_their_own_scores(spark, lexicon):
    rows = [(None, "good", "a"), (None, "bad", "a"), (None, "good", "a"), (7, "great", "a"), (7, "bad", "a"),
            (7, "great", "a"), (7, None, "a"), (8, "plain", "b")]
    df = spark.createDataFrame(rows, "post_id long, title string, side string").repartition(3)
    got = sorted((r.post_id or 0, r.sentiment) for r in S.score_sentiment(df, "title", lexicon, keep=["side"]).collect())
    value = {"good": 1.9, "bad": -2.5, "great": 3.1}
    assert got == sorted((k or 0, compound(value.get(t, 0.0))) for k, t, _ in rows)


def test_a_repeated_lexicon_token_counts_once(spark):
    twice = spark.createDataFrame([("good", 1.9), ("good", 1.9), ("Mixed", 1.0), ("mixed", 3.0)], "token string, valence double")
    assert scores(spark, twice, ["good", "mixed"]) == {"good": compound(1.9), "mixed": compound(2.0)}


def test_a_large_lexicon_is_joined_and_an_empty_one_scores_nothing(spark, lexicon, monkeypatch):
    texts = ["not good", "VERY bad but great!", None, "", "plain", "kind of good!"]
    usual = scores(spark, lexicon, texts)
    assert scores(spark, lexicon.limit(0), texts) == dict.fromkeys(texts, 0.0)
    monkeypatch.setattr(S, "INLINE_WORDS", 2)
    assert scores(spark, lexicon, texts) == usual


def test_only_hits_are_exploded(spark, lexicon):
    df = spark.createDataFrame([(1, "good " + "plain " * 5000), (2, "plain " * 5000)], "post_id long, title string")
    hits = S._token_rows(df, "title", S.SentimentRules(), ["post_id"], ["good"])
    assert hits.count() == 2


def test_flat_events_keep_their_rows(spark):
    scored = spark.createDataFrame([("p", 0.5), ("p", 0.5), ("q", 0.1), ("q", 0.3), ("r", 0.2)], "event_period string, sentiment double")
    curve = S.sentiment_density(scored, {"p": "P", "q": "Q", "r": "R"}, points=5).collect()
    assert len(curve) == 15
    assert {r.event for r in curve if r.density is None} == {"P", "R"}
    q = [r for r in curve if r.event == "Q"]
    assert all(r.joint_density == pytest.approx(r.density * 2 / 5) for r in q)
