import itertools

import numpy as np
import pytest

from basketry.llm import html_extract as H
from basketry.llm.dom import parse


@pytest.fixture(scope="module")
def model():
    return H.train()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    parent = np.array([-1, 0, 0, 1, 1, 2, -1, 6])
    depth = np.array([0, 1, 1, 2, 2, 2, 0, 1])
    score, edge = rng.standard_normal(8), rng.standard_normal((2, 2))
    weight = np.zeros((8, 2))
    for x in itertools.product((0, 1), repeat=8):
        e = sum(score[i] * x[i] for i in range(8)) + sum(edge[x[p], x[i]] for i, p in enumerate(parent) if p >= 0)
        for i in range(8):
            weight[i, x[i]] += np.exp(e)
    assert H.marginals(score, parent, depth, edge) == pytest.approx(weight[:, 1] / weight.sum(1))


def test_held_out_layouts(model):
    rng = np.random.default_rng(1234)
    both = either = 0
    for _ in range(150):
        page = H.labelled_page(rng)
        nodes, blocks = parse(page)
        y = H.node_labels(nodes)
        want = {t for at, t in blocks if y[at] == 1}
        got = set(H.main_texts([page], model)[0].split("\n"))
        both += len(want & got)
        either += len(want | got)
    assert both / either > 0.9


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad 1 --><div class="ad">Buy our soap now.</div>
<article><h1>Great   title &lt;1&gt;</h1><p><b>First text goes here.<br><p>Second &eacute;&#233; &amp;amp; text, with <a href="/x">a link</a> in it.</p>
<p>Short.</p><p></p><div class="share">Share this page</div></article><section class="comments"><p>I liked this article very much.</p></section>
<form><p>Join our list</p><input name=q></form><footer>&copy; example.com &middot; All rights reserved.</footer>"""


def test_article_without_the_rest(model):
    assert H.main_texts([PAGE], model) == ["Great title <1>\nFirst text goes here.\nSecond éé &amp; text, with a link in it.\nShort."]


def test_parser_copes():
    for page in ("", "text", "<", "<p", "a < b", "<p>x</div></p></p>", "<script>", "<!-- open", "<table><tr><td>1<td>2<tr><td>3</table>",
                 '<p class="a>b</p>', "<a><a><b></i></p>", "</html>", "<head><p>seen", "\x00<p>\ud800"):
        nodes, blocks = parse(page)
        assert all(0 <= at < len(nodes) and t for at, t in blocks)
        assert all(x.parent < i for i, x in enumerate(nodes))
    assert [t for _, t in parse("<table><tr><td>1<td>2<tr><td>3</table>")[1]] == ["1", "2", "3"]
    assert [t for _, t in parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>")[1]] == ["a", "b", "c", "d"]
    assert [t for _, t in parse("<p>a<b>b</b>c <i>d<p>e")[1]] == ["abc d", "e"]
    assert [t for _, t in parse("<head><p>seen")[1]] == ["seen"]
    assert [t for _, t in parse("a < b")[1]] == ["a < b"]
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert [t for _, t in parse(deep)[1]] == ["x"]


def test_rows(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (None, "v", "<p>" + "Long text here. " * 20_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = H.extract(df, model).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.text.count("\n") for r in got if r.page_id == 1) == [3, 3]
    assert {r.text for r in got if r.page_id in (2, 3)} == {""}
    assert H.extract(df.limit(0), model).count() == 0


def test_pages_table(spark, model):
    """Against a plain reading of the article element of each page."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(pages, model).collect()}
    for r in pages.collect():
        a = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", a)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)
