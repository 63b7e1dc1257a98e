import itertools

import numpy as np
import pytest

from tidemark.llm.html_content import Forest, Model, extract, labelled_pages, labelled_trees, marginals, train
from tidemark.llm.html_tree import _Tags, FEATURES, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav><!-- ad --><div class="ad">Buy this now.</div>
<article><h1>A headline &amp; more</h1><p><b>First  line of\n the text, with <a href=x>a link</a> in it.<br><p>Second &eacute; paragraph &lt;here&gt;, which is
quite long and ends with a stop.</p></article><div id="comments"><p>Nice article, thanks!</p></div><footer>&copy; 2024 us.</footer></body></html>"""
TEXT = "A headline & more\nFirst line of the text, with a link in it.\nSecond é paragraph <here>, which is quite long and ends with a stop."


@pytest.fixture(scope="module")
def model():
    return train()


def test_messages_equal_enumeration():
    rng = np.random.default_rng(3)
    tree = parse("<div><p>a</p><ul><li>b<li>c</ul></div><p>d")
    forest = Forest([tree])
    own, edge = rng.normal(0, 1, len(tree.parent)), rng.normal(0, 1, (2, 2, 2))
    p, pairs = marginals(forest, own, edge)
    total, ones, both = 0.0, np.zeros(len(own)), np.zeros((len(own), 2, 2))
    for y in itertools.product((0, 1), repeat=len(own)):
        w = np.exp(sum(o * v for o, v in zip(own, y)) + sum(edge[forest.kind[k], y[q], y[k]] for k, q in enumerate(tree.parent) if q >= 0))
        total += w
        ones += w * np.array(y)
        for k, q in enumerate(tree.parent):
            if q >= 0:
                both[k, y[q], y[k]] += w
    assert np.allclose(p, ones / total) and np.allclose(pairs[1:], both[1:] / total)


def test_learns_labelled_pages(model):
    trees, labels = labelled_trees(labelled_pages(100, 77))
    forest = Forest(trees)
    p, _ = marginals(forest, model.own(forest), model.edge)
    assert ((p > 0.5) == np.concatenate(labels))[forest.leaf].mean() > 0.97
    assert model.weight.shape == (FEATURES,)


def test_page(model):
    assert model.contents([PAGE]) == [TEXT]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><h1>Title here</h1><p>Short para one.</p><p>Second short para.</p><form><p>Send us your name please.</p></form></article>", "Title here\nShort para one.\nSecond short para."),
        ("<h1>A title</h1><p>This is a short article, with few words.</p><div class=comments><p>nice post, I agree with it all.</p></div>", "A title\nThis is a short article, with few words."),
        ("<p>First short one.</p><p>Second short one.<br>more</p><p>Third short one.</p><form><input><button>Go</button></form>", "First short one.\nSecond short one. more\nThird short one."),
        ("<form runat=server><nav><a href=x>Home</a></nav><h1>Head line</h1><p>Body text of the thing, it is long enough to be read.</p><footer>Copyright us.</footer></form>", "Head line\nBody text of the thing, it is long enough to be read."),
        (
            "<header><a href=/>Site</a></header><div id=content><h2>News today</h2><p>The council met on Monday. It decided to build a bridge.</p><ul><li>Cost: 3 million</li>"
            "<li>Start: May</li></ul><p>More to come.</p></div><aside class=sidebar><h3>Most read</h3><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></aside><div id=footer>About us</div>",
            "News today\nThe council met on Monday. It decided to build a bridge.\nCost: 3 million\nStart: May\nMore to come.",
        ),
    ],
)
def test_pages_written_by_hand(model, page, text):
    assert model.contents([f"<html><head><title>x</title></head><body>{page}</body></html>"]) == [text]


def test_deep_pages_take_linear_time(model):
    model.contents(["<div>" * 4000 + "x", "<div>" * 20000 + "</x>" * 20000])


def test_hostile_pages_take_linear_time():
    for page in ("<a " * 500_000, "<a x=' \"" * 200_000, "<a \"'>" * 200_000, "<!" * 500_000, "<aa" * 500_000, "<form><h1>" * 20_000, "<script>" + "</script" * 200_000, "<p>x<table>" + "<center>" * 50_000):
        parse(page)


def test_tags_by_table_are_those_by_expression():
    """One broken tag in front changes nothing of what follows it."""
    body = PAGE + "<p class='a > b' id=\"x\">one</p><!-- > --><?x > y><br/><p title='open>two</p>"
    plain, broken = parse(body), parse(body + "<p x='")
    assert plain.text == [t for t in broken.text if t != "<p x='"]
    table = _Tags(body)
    table._table()
    for start in (k for k, c in enumerate(body) if c == "<"):
        assert table.at(start) == _Tags(body).at(start)


def test_broken_pages(model):
    for page in ("", " ", "plain", "<", "<p", "<!--", "<!-- x", "<script>", "<p>a</div></p></p>", "<a href='x", "<b><i></b>", "</html>", "<" * 3000, '<p "' * 500, "<div>" * 3000 + "x"):
        parse(page)
    full = model.contents([PAGE[:k] for k in range(0, len(PAGE), 40)])
    assert full[0] == "" and all(TEXT.startswith(t[:-20]) for t in full if t)


def test_tables(spark, model):
    rows = [(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (2, None, None, None), (3, "v", "", "x"), (None, "w", "<p></p>", "x"), (4, "z", PAGE.replace("First", "word " * 30000), "x")]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), model).collect()
    by = {(r["page_id"], r["text"]) for r in out}
    assert len(out) == 6 and (1, TEXT) in by and {(2, ""), (3, ""), (None, "")} <= by
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string"), Model()).count() == 0
