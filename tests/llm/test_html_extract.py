"""Main text of pages: parser, messages against enumeration, accuracy on held-out labelled pages."""

import html
import itertools
import re

import numpy as np
import pytest

from turnmill.llm import html_extract as x
from turnmill.llm.html_tree import parse

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, text string, n_chars string"


@pytest.fixture(scope="module")
def model():
    return x.trained()


def texts(page):
    return [t for t in parse(page).text if t is not None]


def test_parser():
    assert texts("a<p>b <b>c</b>d<br>e<p>f\n\t g") == ["a", "b cd e", "f g"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>z") == ["a", "b", "1", "2", "3", "z"]
    assert texts("<title>t</title><script>'<p>x'</script><style>p{}</style><!-- c --><p>y &lt;&amp &copy;") == ["y <& ©"]
    assert texts("1 < 2 <3 a<a href='>'>link</a></nope>.") == ["1 < 2 <3 alink."]
    assert texts("<p>x</div></p><SCRIPT>no</Script>y") == ["x", "y"]
    assert texts("<svg><text>s</text></svg>a<svg>b") == ["ab"]
    assert texts("") == texts("<div") == texts("<!-- x") == []
    tree = parse('<p>ab<a href=x>cd</a></p><div class="topMenu comments-List2">ef</div>')
    assert tree.names[3] == {"top", "menu", "comment", "list"}
    assert [n for n, t in zip(tree.linked, tree.text) if t] == [2, 0]


@pytest.mark.parametrize(
    "page", ['<a "' * 30000, "<div>" * 30000 + "<li></li>" * 30000, "<" * 60000, "<svg>" * 30000, "</p>" * 30000, "<li><div>" * 20000]
)
def test_parser_takes_long_odd_pages(page):
    parse(page)


def test_messages_equal_enumeration():
    rnd = np.random.default_rng(5)
    trees = [parse("<div>a<ul><li>b<li>c</ul></div>d"), parse("x<p>y")]
    f = x.forest(trees, {})
    unary, pair = rnd.normal(size=len(f.parent)), rnd.normal(size=(x.EDGES, 2, 2))
    got, joint = x.marginals(f, unary, pair)
    base = 0
    for tree in trees:
        n = len(tree.parent)
        kinds = x.edges(tree)
        weight, single, double = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for labels in itertools.product((0, 1), repeat=n):
            w = sum(unary[base + i] * y for i, y in enumerate(labels))
            w = np.exp(w + sum(pair[kinds[i], labels[tree.parent[i]], labels[i]] for i in range(1, n)))
            weight += w
            single += w * np.array(labels)
            for i in range(1, n):
                double[i, labels[tree.parent[i]], labels[i]] += w
        assert np.allclose(got[base : base + n], single / weight)
        assert np.allclose(joint[base : base + n], double / weight)
        base += n


def test_held_out_pages(model):
    pages = x.written_pages(150, seed=99)
    content = model.content([t for t, _ in pages]) > 0.5
    leaf = np.array([text is not None for t, _ in pages for text in t.text])
    truth = np.concatenate([y for _, y in pages]).astype(bool)
    assert (content == truth)[leaf].mean() > 0.99


HAND = {
    "<body><header><h1>Site</h1><p>The best news.</p></header><nav><a href=/>Home</a></nav><main><h1>Title</h1><p>First words &amp;\n more.</p>"
    "<aside><p>Related: read this other story about things, with many words.</p></aside><p>Second one.</p><form><p>Subscribe to our newsletter."
    "</p></form></main><section id=comments><h2>2 comments</h2><div class=comment><p>I think that this is great. I loved every word.</p></div>"
    "<div class=comment><p>Me too.</p></div></section><footer><p>All rights reserved by them.</p></footer></body>": "Title\nFirst words & more.\nSecond one.",
    '<div id=page><div class="cookie-banner">We use cookies to make it better.</div><div class=post><h1>Head</h1><div class=entry><p>Para one, '
    'says they. It goes on.</p><div class=advertisement>Buy now! The best ever made.</div><p>Para two.</p><ul><li>point</ul></div></div><div '
    'class=sidebar><p>This site is made by us. Long text follows here.</p></div><div id=footer>Legal text is here.</div></div>': (
        "Head\nPara one, says they. It goes on.\nPara two.\npoint"
    ),
    "<nav><p>only menus</p></nav><footer>foot</footer>": "",
    "<article><p>Short.<p>Other.</article>": "Short.\nOther.",
}


def test_hand_written_pages(model):
    assert x.main_texts(list(HAND), model) == list(HAND.values())


def test_rows(spark, model):
    long = "<article>" + "".join(f"<p>Line {i} of it.</p>" for i in range(40000)) + "</article>"
    rows = [(1, "u", page, "t", "n") for page in HAND] + [(None, None, None, None, None), (2, "u", "", "t", "n"), (3, "u", long, "t", "n")]
    got = x.extract(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert sorted(r.text for r in got if r.page_id == 1) == sorted(HAND.values())
    assert [tuple(r) for r in got if r.page_id in (None, 2)] == [(None, None, "", 0), (2, "u", "", 0)]
    assert [r.text for r in got if r.page_id == 3] == ["\n".join(f"Line {i} of it." for i in range(40000))]
    assert all(r.n_chars == len(r.text) for r in got)
    assert x.extract(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_query(spark):
    """On these pages, the blocks of the article element are the main text."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = x.op12(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(" ".join(b.split()) for b in blocks if b.split())
