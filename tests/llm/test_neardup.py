"""Near-duplicate groups against all pairs compared in plain Python."""

import random
import re

import numpy as np
import pytest
from murmur.llm import components, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words)} if len(words) < width else {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def plain(rows, settings):
    sets = {}
    for key, text in rows:
        sets.setdefault(key, shingles(text, settings.width))
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= settings.percent * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in keys}


def words(random, n, vocabulary=5000):
    return [f"w{random.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    r = random.Random(seed)
    texts = [None, "", " \n ", "one", "One", "one two", "x " * 5000, "x x x x"]
    for _ in range(40):
        base = words(r, r.choice([3, 6, 12, 60, 300]))
        texts.append(" ".join(base))
        for _ in range(r.randrange(4)):
            copy = list(base)
            for _ in range(r.randrange(1 + len(base) // 25)):
                copy[r.randrange(len(copy))] = "edited"
            texts.append(" ".join(copy))
    passage = words(r, 120)  # many quote it, each with words of its own
    texts += [" ".join(words(r, 40) + passage) for _ in range(60)]
    base = words(r, 200)  # a large group of near copies, some linked only to their like
    for i in range(150):
        copy = list(base)
        for _ in range(r.randrange(9)):
            copy[r.randrange(len(copy))] = f"e{i}"
        if i % 5 == 0:
            copy[20:38] = [f"common{k}" for k in range(18)]
        texts.append(" ".join(copy))
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(i, texts[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("settings", [
    neardup.Settings(width=3, percent=85), neardup.Settings(), neardup.Settings(width=3, percent=85, short_list=2),
    neardup.Settings(width=5, percent=80, short_list=2, leaders=1),
])
def test_groups_equal_all_pairs(spark, settings):
    rows = corpus()
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, doc string").repartition(5)
    want = plain(rows, settings)
    got = neardup.groups(df, settings).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)


def labels(rows, settings):
    """Component and size of every row, where a key may stand on several texts: rows are linked, then named by their least key."""
    numbered = dict(enumerate(rows))
    found = plain([(i, t) for i, (_, t) in numbered.items()], settings)
    least = {}
    for i, (size, root) in found.items():
        least[root] = min(least.get(root, numbered[i][0]), numbered[i][0])
    return sorted((numbered[i][0], size, least[root] if size else numbered[i][0]) for i, (size, root) in found.items())


def test_a_key_on_several_texts(spark):
    r = random.Random(9)
    a, b, c = (" ".join(words(r, 80)) for _ in range(3))
    rows = [(5, a), (5, b), (9, b + " more"), (2, c), (9, c), (7, "x y z"), (7, "x y z"), (7, None), (3, b)]
    df = spark.createDataFrame([(k, t) for k, t in rows], "doc_id long, text string").repartition(4)
    got = neardup.groups(df).collect()
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == labels(rows, neardup.Settings())
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    assert {(x["doc_id"], x["component_id"]) for x in got if x["doc_id"] == 9} == {(9, 3), (9, 2)}


def test_keys_of_several_columns(spark):
    rows = [(1, "b", "one two three four five six"), (1, "a", "one two three four five six"), (None, "c", "one two three four five six")]
    df = spark.createDataFrame(rows, "x long, y string, text string").selectExpr("struct(x is null as n, x, y) as key", "text")
    got = {r["key"]["y"]: r["kept"] for r in neardup.groups(df, key_col="key").collect()}
    assert got == {"a": True, "b": False, "c": False}


def thue_morse(n):
    """Words over two letters that hashes by powers of an odd base can't tell from their complements."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_that_collide_by_construction_are_told_apart(spark, n):
    one, two = thue_morse(n)
    df = spark.createDataFrame([(1, f"{one} x y z w"), (2, f"{two} x y z w"), (3, one), (4, two)], "doc_id long, text string").coalesce(1)
    assert all(r["kept"] for r in neardup.groups(df, neardup.Settings(width=3, percent=85)).collect())


def test_overlap_is_the_binomial_tail():
    import math
    for percent in (80, 85, 95):
        s = neardup.Settings(percent=percent)
        tail = lambda m: sum(math.comb(64, i) * (percent / 100) ** i * (1 - percent / 100) ** (64 - i) for i in range(m))
        assert tail(s.overlap) <= s.missed < tail(s.overlap + 1)


def test_heavy_keys_join_like_others(spark):
    rows = spark.range(5000).selectExpr("if(id % 2 = 0, 7, id) as k", "id")
    counted = rows.groupBy("k").count().withColumnRenamed("count", "_rows").selectExpr("k", "k * 10 as v", "_rows")
    got = neardup._join_counted(rows, counted.where("k <> 9"), "k", 5000).collect()
    assert sorted((r["k"], r["id"], r["v"]) for r in got) == sorted((7 if i % 2 == 0 else i, i, (7 if i % 2 == 0 else i) * 10) for i in range(5000) if i != 9)


def test_null_and_repeated_keys_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (4, None), (9, "q"), (2, "Q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.groups(df).collect()), key=str)
    assert [g for g in got if g[0] is not None] == [(2, 2, True), (4, 4, True), (5, 5, True), (5, 5, True), (9, 2, False)]
    assert len(got) == 7
    assert neardup.groups(df.limit(0)).count() == 0


def test_parity_bits_differ_in_no_more_places_than_the_sets(spark):
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 40, 40, 3000)]
    sets += [np.unique(np.concatenate([sets[2][5:], sets[3][:k]])) for k in (0, 3)]
    frame = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "doc long, items binary")
    bits = {b[0]: [x & (1 << 64) - 1 for x in b[1:]] for b in neardup._parity(frame).collect()}
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            places = sum((a ^ b).bit_count() for a, b in zip(bits[i], bits[j], strict=True))
            differ = len(np.setxor1d(x, y))
            assert places <= differ and places % 2 == differ % 2
            if differ <= 80:  # collisions hide few of so few
                assert places >= differ - 24


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(3, 3), (50, 51), (51, 50)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 30)} | {50: 50, 51: 50}
    assert got == want
    assert components.components(df.limit(0)).count() == 0


def rooted(edges):
    """The least node that each node reaches, found one edge after another."""
    root = {}
    for a, b in edges:
        x, y = (root.setdefault(n, n) for n in (a, b))
        for n in [n for n in root if root[n] == max(x, y)]:
            root[n] = min(x, y)
    return root


def tangle(seed=4):
    r = random.Random(seed)
    ids = r.sample(range(10_000), 600)
    path = list(zip(ids[:150], ids[1:150], strict=False))
    clique = [(a, b) for a in ids[150:190] for b in ids[150:190] if a < b]
    return path + clique + [(r.choice(ids[190:]), r.choice(ids[190:])) for _ in range(350)]


def test_components_take_few_rounds_and_no_edges_that_close_cycles(spark, monkeypatch):
    staged = []

    def counted(df, name):
        staged.append(components_stage(df, name))
        return staged[-1]

    components_stage = components.stage
    monkeypatch.setattr(components, "stage", counted)
    edges = [(a, b) for a in range(60) for b in range(a)] + [(i, i + 1) for i in range(100, 300)]
    df = spark.createDataFrame(edges, "a long, b long").coalesce(1)
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(60)} | {i: 100 for i in range(100, 301)}
    assert staged[0].count() == 59 + 200 and len(staged) == 2


@pytest.mark.parametrize(("kind", "most"), [("long", 0), ("string", 200_000), ("binary", 0), ("struct", 200_000)])
def test_components_shuffled_and_broadcast(spark, monkeypatch, kind, most):
    monkeypatch.setattr(components, "BROADCAST_ROWS", most)
    edges = tangle()
    to = "named_struct('x', {})" if kind == "struct" else f"cast(lpad(cast({{}} as string), 5, '0') as {kind})"
    back = "{}.x" if kind == "struct" else "cast(cast({} as string) as long)"
    df = spark.createDataFrame(edges + [(None, 3), (3, None)], "a long, b long").repartition(6).selectExpr(
        f"{to.format('a')} as a", f"{to.format('b')} as b")
    if kind == "struct":
        df = df.where("a.x is not null and b.x is not null")
    found = components.components(df).selectExpr(f"{back.format('node')} as node", f"{back.format('component')} as component")
    loops = {a for a, b in edges if a == b}
    want = rooted(edges)
    got = [(r["node"], r["component"]) for r in found.collect()]
    assert len(got) == len(set(got)) and dict(got) == {n: c for n, c in want.items() if n not in loops or n in dict(got)}


def test_stars_connect_what_their_edges_do(monkeypatch):
    import pyarrow as pa
    edges = tangle(7)
    batches = [pa.RecordBatch.from_pydict({"a": [a for a, _ in edges[i:i + 100]], "b": [b for _, b in edges[i:i + 100]]})
               for i in range(0, len(edges), 100)]
    for block in (8, 100_000):
        monkeypatch.setattr(components, "_BLOCK", block)
        out = [p for b in components._stars(iter(batches)) for p in zip(*b.to_pydict().values(), strict=True)]
        assert rooted(out) == {n: c for n, c in rooted(edges).items() if n in {n for e in out for n in e}}
        assert {n for e in edges if e[0] != e[1] for n in e} == {n for e in out for n in e}
    assert len(out) == len(rooted(out)) - len(set(rooted(out).values()))
    assert list(components._stars(iter([batches[0].slice(0, 0)]))) == []
