"""The automaton against fnmatch, and rules on odd URLs."""

import fnmatch
import random

import numpy as np
from murmur.llm import urls
from murmur.llm.queries import GLOB_RULES, SITE_RULES


def test_automaton_equals_fnmatch_on_random_globs():
    random.seed(3)
    globs = ["".join(random.choice("ab/*?") for _ in range(random.randint(0, 9))) for _ in range(90)]
    texts = ["".join(random.choice("ab/") for _ in range(random.randint(0, 12))) for _ in range(300)]
    found = urls.Automaton(globs).matches([t.encode() for t in texts])
    want = np.array([[fnmatch.fnmatchcase(t, g) for g in globs] for t in texts])
    assert (found == want).all()


def test_subdomains_do_not_reach_into_the_path():
    found = urls.Automaton(["{sub}b.org/*"]).matches([b"b.org/", b"a.b.org/x", b"ab.org/", b"c.com/x.b.org/", b""])
    assert found[:, 0].tolist() == [True, True, False, False, False]


def test_rules_on_odd_urls(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "example.org/en/1": ("", "", None, "allow"),
        "http://EXAMPLE.org/en/12?q": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://x.example.org/es/#a": ("x.example.org", "/es/", "example.org/es/", "block"),
        "http://example.org": ("example.org", "", None, "allow"),
        "http://ads-track.example.com/en/": ("ads-track.example.com", "/en/", None, "block"),
        "http://ads-track.example.com/fr/": ("ads-track.example.com", "/fr/", "com/fr/", "allow"),
        "http://a.com/DE/": ("a.com", "/DE/", None, "allow"), "http://a.com/de/?": ("a.com", "/de/", "com/de/", "block"),
        "http://" + "é" * 100_000 + ".org/": ("é" * 100_000 + ".org", "/", "org/", "allow"),
        "http://?://b.org/": ("", "", None, "allow"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(cases)] + [(None, "http://b.org/", "clash")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = urls.judge(df, SITE_RULES, GLOB_RULES).collect()
    assert len(got) == len(rows)
    wanted = list(cases.values())
    for r in got:
        want = ("b.org", "/", "org/", "allow") if r["page_id"] is None else wanted[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want
    assert urls.judge(df.limit(0), SITE_RULES, GLOB_RULES).count() == 0


def test_thousands_of_rules_from_a_table(spark):
    random.seed(8)
    names = ["".join(random.choice("abcd") for _ in range(random.randint(2, 6))) for _ in range(3000)]
    shapes = ("*/{}/*", "{{sub}}{}.*", "*.{}", "*{}?/*")
    globs = [random.choice(shapes).format(n) for n in names]
    table = spark.createDataFrame([(i, "block", g) for i, g in enumerate(globs)], "position int, verdict string, glob string").repartition(4)
    rules = urls.glob_rules(table)
    assert [r.glob for r in rules] == globs
    sites = urls.site_rules(spark.createDataFrame([("allow", "dd.cc", "/ab"), ("block", "cc", "/")], "verdict string, host string, path string"))
    assert sites == [urls.SiteRule("allow", "dd.cc", "/ab"), urls.SiteRule("block", "cc", "/")]
    pages = ["http://" + ".".join(random.choice(names) for _ in range(random.randint(1, 3))) + "/" + "/".join(random.choice(names) for _ in range(random.randint(0, 3)))
             for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    fits = lambda t, g: fnmatch.fnmatchcase(t, g) if not g.startswith("{sub}") else any(
        fnmatch.fnmatchcase(t[i:], g[5:]) for i in [0, *(j + 1 for j, c in enumerate(t.split("/", 1)[0]) if c == ".")])
    for r in urls.judge(df, [], rules).collect():
        text = r["host"] + r["path"]
        assert r["glob_rule"] == next((g for g in globs if fits(text, g)), None)


def test_rule_tables_that_are_refused(spark, monkeypatch):
    import pytest

    with pytest.raises(ValueError):
        urls.glob_rules(spark.createDataFrame([("block", None)], "verdict string, glob string"))
    monkeypatch.setattr(urls, "MOST_RULES", 1)
    with pytest.raises(ValueError):
        urls.glob_rules(spark.createDataFrame([("block", "a"), ("block", "b")], "verdict string, glob string"))


def test_the_query_and_its_sql_have_the_contracts_rules(spark, tmp_path):
    import duckdb
    from murmur.llm.queries import OP2_SQL, op2_url_filters

    wanted = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    assert sorted((r.verdict, r.host, r.path) for r in SITE_RULES) == sorted(wanted)
    pages = [(i, f"https://{sub}{host}{path}x") for i, (sub, (_, host, path)) in enumerate((s, w) for s in ("", "a.") for w in wanted)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    verdicts = {i: wanted[i % len(wanted)][0] for i, _ in pages}
    assert {r["page_id"]: r["verdict"] for r in op2_url_filters(spark, str(tmp_path)).collect()} == verdicts
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert {r[0]: r[-1] for r in con.execute(OP2_SQL).fetchall()} == verdicts
