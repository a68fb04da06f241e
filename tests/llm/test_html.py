import time
import tracemalloc

import numpy as np
import pytest

from rankloom.llm import html, html_train


@pytest.fixture(scope="module")
def net():
    return html.Labeller.load()


def texts(page):
    return [b.text for b in html.blocks(page)]


def test_blocks():
    page = """<!DOCTYPE html><head><title>T &amp; t</title><style>p{}</style><script>var a = "<p>no</p>";</script></head>
    <body><!-- <p>no</p> --><ul><li>one<li>two <b>bold</b></ul><p>a <i>b</i><br>c&nbsp;d<p>e<td>f</p><table><tr><td>x<td>y</table>
    <p title="a > b">g &copy h &lt;i&gt; 1 < 2</p><P>tail"""
    assert texts(page) == ["T & t", "one", "two bold", "a b c d", "e", "f", "x", "y", "g © h <i> 1 < 2", "tail"]
    assert texts("") == [] and texts("plain") == ["plain"] and texts("<p>cut <a href='x") == ["cut"]
    assert [b.linked for b in html.blocks("<p><a href=x>abc</a> d</p>")] == [3]


def test_unseen_elements_lose_no_text():
    assert texts("<p>a <svg width=1 /> b</p><p>c <svg/> d</p><p>e <math/> f") == ["a b", "c d", "e f"]
    assert texts("<svg-icon name=x></svg-icon><p>a</p><video-player src=y><p>b</p><object-card/><p>c<template-x>d") == ["a", "b", "cd"]
    assert texts("<p>a <video src=x> b</p><p>c</p><object data=y><p>d") == ["a b", "c", "d"]
    assert texts("<p>a <video src=x> b</p><p>c <video>no</video> d</p>") == ["a b", "c d"]
    assert texts("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p>") == ["a x=1 b"]
    assert texts("<p>a <svg><text>no</text><svg>no</svg>no</svg> b <object>no<object title='>'>no</object>no</object> c</p>") == ["a b c"]
    assert texts("<p>a <svg><!-- <svg> --><style>no</style>no</SVG > b<template><p>no</p></template><p>c<script>no") == ["a b", "c"]


def test_cut_off_and_deep_markup_takes_linear_time(net):
    began = time.time()
    assert texts("<p>one</p><a " + '"x" ' * 10_000) == ["one"]
    assert texts("<p>one</p><a " + "\"x' " * 10_001 + "<p>two")[0] == "one"
    assert texts('<a ">" ' * 20_000 + "<p>two</p>")[-1].endswith("two")
    assert texts("<" * 50_000 + "p>x</p>") == ["<" * 49_999, "x"]
    assert texts("<a" * 50_000 + "<p>") == [] and texts("<!-- " * 50_000) == []
    assert len(texts("<div>a" * 20_000)) == 20_000
    assert time.time() - began < 10
    tracemalloc.start()
    long = [html.blocks("<p>a" * 50_000)] + [html.blocks("<p>b</p>")] * 63
    assert sum(map(len, net.label(long))) == 50_063
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


def test_gradient(monkeypatch):
    r = np.random.default_rng(0)
    net = html.Labeller({k: r.normal(0, 0.3, s) for k, s in html.Labeller.SHAPES.items()})
    made = html_train.examples(3, 3)
    x, y = html.Inputs([f for f, _ in made]), np.concatenate([m for _, m in made])
    loss, grads = html_train.gradient(net, x, y)
    for name in net.w:
        flat, g = net.w[name].reshape(-1), grads[name].reshape(-1)
        for i in np.argsort(-np.abs(g))[:4]:
            old, step = flat[i], 1e-5
            flat[i] = old + step
            up = html_train.gradient(net, x, y)[0]
            flat[i] = old - step
            down = html_train.gradient(net, x, y)[0]
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(g[i], rel=1e-3, abs=1e-7)


def test_batching_changes_nothing(net):
    pages = [f for f, _ in html_train.examples(11, 70)] + [[]]
    together = net.label(pages)
    for page, p in zip(pages, together):
        np.testing.assert_allclose(net.label([page])[0], p, atol=1e-9)


def test_held_out_accuracy(net):
    blocks, pages = html_train.accuracy(net, html_train.examples(12345, 400))
    assert blocks > 0.995 and pages > 0.93


def test_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = html.extract(df).collect()
    for x, page in zip(rows, (r.html for r in rows)):
        want = [b.text for b in html.blocks(page) if "article" in b.path]
        assert x.text == "\n".join(want) and x.n_chars == len(x.text)


def test_edges(spark):
    rows = [(0, None, "t"), (1, "", "t"), (2, "<nav><a href=x>Home</a></nav>", "t"), (3, "<article>" + "<p>word word word, word.</p>" * 3000 + "</article>", "t"), (3, "<article><p>Some words here, and more.</p></article>", "t")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = {(x.page_id, x.html): x for x in html.extract(df).collect()}
    assert got[(0, None)].text == "" and got[(1, "")].n_chars == 0 and got[(2, rows[2][1])].text == ""
    assert got[(3, rows[3][1])].text.count("\n") == 2999
    assert html.extract(df.limit(0)).count() == 0
