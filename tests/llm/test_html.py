"""Blocks of odd pages, gradients, and the articles of the test pages."""

import html as entities
import re

import numpy as np
import pytest
from murmur.llm import html
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.01"


def texts(page):
    return [b.text for b in html.blocks(page)]


@pytest.mark.parametrize("page,want", [
    (None, []), ("", []), ("<p> \n </p>", []), ("plain & simple", ["plain & simple"]),
    ("<p>a<b>b</b>c<br>d<p>e&nbsp;&amp;&copy x &unknown;</p>", ["abc", "d", "e &© x &unknown;"]),
    ("<title>t</title><script>if (a < b) '</p>'</script><style>p{}</style>x<!-- y <p> -->z", ["xz"]),
    ("<p>open <i>never closed<div>next</span></div>", ["open never closed", "next"]),
    ("<textarea>t</textarea><select><option>o</select>after", ["after"]),
    ("a < b and c > d", ["a < b and c > d"]), ("cut<p", ["cut"]), ("<!-- no end", []), ("x<script>no end", ["x"]),
    ('<article><p>One</p><svg class="i"/><p>Two lost</p></article>', ["One", "Two lost"]),
    ("<article><p>One</p><select><option>x<option>y<p>Two</p></article><p>Three", ["One", "Two", "Three"]),
    ("<article>One <object data=q>fallback</article>Two", ["One", "Two"]), ("<p>a<svg><text>t</text></p>b", ["a", "b"]),
    ("<p>a<svg><text>t</text></svg>b</p>", ["ab"]), ("<noscript><p>x</p></noscript>y<NOSCRIPT>z</NoScript >w", ["yw"]),
    ("<p>a<template><p>b<template>c<div>d</div>e", ["a", "b", "d", "e"]), ("<select/>a<object/>b<iframe src=q></iframe>c", ["abc"]),
    ("<textarea>never closed<p>gone", []), ("a<svg>" * 3000 + "<p>end", ["a", "end"]),
    ("<div " + "x" * 10_000 + ">deep" + "<div>" * 3000 + "er", ["deep", "er"]),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    found = html.blocks('<body><div class="Side-Bar x" id=main><a href="q">link</a> no</div></body>')
    assert found == [html.Block(("body", "div", ".side", ".bar", ".x", ".main"), "link no", 4)]


def test_gradients_equal_differences():
    settings = html.Settings(path_buckets=16, word_buckets=16, path_size=3, word_size=3, hidden=4)
    network = html.Network.fresh(settings)
    pages = [html.blocks("<p>a b<p>c<ul><li>d e f</ul>"), html.blocks("<div>x<p>a</div>")]
    data = [(html.features(p, settings), np.arange(len(p)) % 2.0) for p in pages]

    def loss():
        total = count = 0
        for f, y in data:
            z = network.logits(network.inputs(f), np.array([0, len(y)]))
            total += np.sum(np.logaddexp(0, z) - y * z)
            count += len(y)
        return total / count

    grads = network._gradients(data)
    random = np.random.default_rng(1)
    for name, grad in grads.items():
        for _ in range(12):
            at = tuple(random.integers(n) for n in grad.shape)
            old = network.weights[name][at]
            network.weights[name][at] = old + 1e-5
            up = loss()
            network.weights[name][at] = old - 1e-5
            down = loss()
            network.weights[name][at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-6), (name, at)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF_DIR}/pages.parquet")


@pytest.fixture(scope="module")
def network(pages):
    return html.train(pages)


def article(page):
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>|$)", page, re.S)[1]
    return " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


def test_articles_of_the_test_pages(spark, pages, network):
    want = {r["page_id"]: article(r["html"]) for r in pages.collect()}
    got = html.extract(pages, network).collect()
    assert len(got) == len(want)
    assert [r["page_id"] for r in got if r["text"] != want[r["page_id"]]] == []
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_other_layouts(spark, network):
    story = "<h1>Of the and the with</h1>" + "".join(f"<p>And that was the {i} thing on the table, as for the rest of it.</p>" for i in range(8))
    around = ('<header><a href="/">Home</a></header><nav><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul></nav>'
              '<div class="cookie-notice">We use them</div>', '<aside class="sidebar"><p>Other things</p></aside>'
              '<form><label>Mail</label><button>Go</button></form><div id="comments"><h2>Said</h2><div class="comment"><p>No, I disagree.</p></div>'
              '</div><footer>&copy; us</footer>')
    rows = [(i, f"<html><body>{around[0]}<{tag}>{story}</{tag.split()[0]}>{around[1]}</body></html>")
            for i, tag in enumerate(["article", "main", 'div class="post-content"'])]
    want = " ".join(re.sub(r"<[^>]*>", " ", story).split())
    df = spark.createDataFrame(rows, "page_id long, html string")
    assert [r["text"] for r in html.extract(df, network, keep=["page_id"]).collect()] == [want] * 3


def test_null_empty_and_clashing(spark, network):
    df = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (None, "<script>x</script>", "u"), (None, "<script>x</script>", "u")],
                               "page_id long, html string, n_chars string")
    rows = html.extract(df, network, keep=["page_id"]).collect()
    assert [(r["text"], r["n_chars"], r["n_blocks"]) for r in rows] == [("", 0, 0)] * 4
    assert html.extract(df.limit(0), network, keep=["page_id"]).count() == 0
    assert html.extract(df, html.train(df.limit(0)), keep=["page_id"]).count() == 4


def test_tables_without_articles_fall_back(spark):
    prose = "A sentence of the story that goes on for some time, as stories do. "
    page = lambda i: (f'<body><div class="nav"><a href="q">Home</a> <a href="r">News {i}</a></div><div><h1>Title {i}</h1><p>{prose * 3}{i}</p>'  # noqa: E731
                      f'<p>{prose * 2}{i}</p></div><div class="footer">All rights reserved {i}</div></body>')
    df = spark.createDataFrame([(i, "u", page(i)) for i in range(60)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df, html.train(df)).collect()}
    assert all(prose.strip() in t and "Home" not in t and "rights" not in t for t in got.values())


def test_the_sample_is_that_of_a_full_sort(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("h"), F.col("id").alias("key"), F.lit("x").alias("html"))
    for n in (1, 50, 2999, 4000):
        want = df.orderBy("h", "key").limit(n).collect()
        assert html._least_hashed(df, n) == want
    hot = df.withColumn("h", F.lit(1 << 62))
    assert len(html._least_hashed(hot, 5)) == 5 and html._least_hashed(df.limit(0), 5) == []
