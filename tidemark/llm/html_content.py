"""Main text of web pages by a tree-structured graphical model.

Every block element and every run of text of a page is a variable: content or
not. Features of the node (html_tree.py) give its own potential, and each edge
between parent and child one that depends on both. Sum-product messages go up
from the leaves and down from the root, for all pages of a batch at once, level
by level, and give exact marginals; a run of text is kept if its marginal says
content. Weights are those that make labelled pages most likely; with all nodes
labelled the likelihood is concave, and its slope is the labels less marginals.

The labelled pages are written here: articles in many layouts, with and without
telling element names and classes, among menus, headers, footers, sidebars,
notices, adverts, forms, scripts and reader comments.

Defined results: a null or empty page, or one without content, gives an empty
text; markup may be cut off anywhere; repeated rows repeat; columns named like
the results are replaced and all others pass through.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import read
from tidemark.llm.html_tree import FEATURES, TAG, Tree, parse

#: Labelled pages that are written, and steps of the ascent.
PAGES, STEPS = 500, 160
#: Nodes whose messages are held at a time.
NODES = 50_000


class Forest:
    """The trees of several pages as arrays."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.parent) for t in trees]
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.parent = np.concatenate([t.parent for t in trees]) + base
        self.parent[np.cumsum(sizes) - sizes] = -1
        self.leaf = np.array([x is not None for t in trees for x in t.text])
        flat = [f for t in trees for f in t.features]
        self.owner = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
        self.feature = np.array([k for f in flat for k in f])
        depth = [0] * len(self.parent)
        for k, p in enumerate(self.parent.tolist()):
            depth[k] = depth[p] + 1 if p >= 0 else 0
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        self.kind = self.leaf.astype(int)


def log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(forest: Forest, own: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each node, and [parent, child] beliefs of each node's edge to its parent.

    own: log-odds of each node. edge: [inner or leaf child, parent's state, child's state].
    """
    n = len(own)
    node = np.stack([np.zeros(n), own])
    up = np.zeros((2, n))
    gathered = node.copy()
    for level in reversed(forest.levels[1:]):
        e = edge[forest.kind[level]]
        for p in (0, 1):
            up[p, level] = log_add(e[:, p, 0] + gathered[0, level], e[:, p, 1] + gathered[1, level])
            np.add.at(gathered[p], forest.parent[level], up[p, level])
    down = np.zeros((2, n))
    pairs = np.zeros((n, 2, 2))
    for level in forest.levels[1:]:
        e, parent = edge[forest.kind[level]], forest.parent[level]
        rest = gathered[:, parent] + down[:, parent] - up[:, level]
        for c in (0, 1):
            down[c, level] = log_add(e[:, 0, c] + rest[0], e[:, 1, c] + rest[1])
            for p in (0, 1):
                pairs[level, p, c] = e[:, p, c] + rest[p] + gathered[c, level]
        down[:, level] -= down[:, level].max(axis=0)
        pairs[level] = np.exp(pairs[level] - pairs[level].max(axis=(1, 2), keepdims=True))
        pairs[level] /= pairs[level].sum(axis=(1, 2), keepdims=True)
    odds = gathered[1] + down[1] - gathered[0] - down[0]
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50))), pairs


class Model:
    """Weights of features and edges."""

    def __init__(self) -> None:
        self.weight, self.edge = np.zeros(FEATURES), np.zeros((2, 2, 2))

    def own(self, forest: Forest) -> np.ndarray:
        return np.bincount(forest.owner, self.weight[forest.feature], len(forest.parent))

    def fit(self, trees: list[Tree], labels: list[list[int]], steps: int = STEPS, rate: float = 0.1, ridge: float = 1e-4) -> list[float]:
        """Gradient ascent with Adam on the mean log-likelihood a node; returns the shares of right leaves."""
        forest, y = Forest(trees), np.concatenate(labels)
        child = np.flatnonzero(forest.parent >= 0)
        seen = np.zeros((2, 2, 2))
        np.add.at(seen, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
        m, s, right = [0.0, 0.0], [0.0, 0.0], []
        for t in range(1, steps + 1):
            p, pairs = marginals(forest, self.own(forest), self.edge)
            right.append(float(((p > 0.5) == y)[forest.leaf].mean()))
            hoped = np.stack([pairs[child[forest.kind[child] == k]].sum(axis=0) for k in (0, 1)])
            slopes = [np.bincount(forest.feature, (y - p)[forest.owner], FEATURES), seen - hoped]
            for k, (value, g) in enumerate(zip((self.weight, self.edge), slopes)):
                g = g / len(y) - ridge * value
                m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.99 * s[k] + 0.01 * g * g
                value += rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)
        return right

    def contents(self, pages: list[str]) -> list[str]:
        """Main text of each page: its kept runs of text in order, one a line."""
        out, trees, size = [], [], 0
        for k, page in enumerate(pages):
            trees.append(parse(page))
            size += len(trees[-1].parent)
            if size >= NODES or k == len(pages) - 1:
                forest = Forest(trees)
                p, _ = marginals(forest, self.own(forest), self.edge)
                at = 0
                for t in trees:
                    out.append("\n".join(x for x, q in zip(t.text, p[at : at + len(t.text)]) if x is not None and q > 0.5))
                    at += len(t.text)
                trees, size = [], 0
        return out


def labelled_pages(count: int = PAGES, seed: int = 4) -> list[tuple[str, list[str]]]:
    """Written pages with the runs of text that are content; these are marked by a leading sign in no other text."""
    rng = random.Random(seed)
    some = lambda *x: rng.choice(x)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvwé", k=rng.randrange(1, 11)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b + 1))).capitalize()
    prose = lambda a, b: " ".join(words(1, 16) + some(".", ".", ".", ", ", "!") for _ in range(rng.randrange(a, b + 1)))
    link = lambda: f'<a href="/{word()}">{words(1, 3)}</a>'
    links = lambda: f"<ul{some('', ' class=menu', '')}>" + "".join(f"<li>{link()}{some('</li>', '</li>', '')}" for _ in range(rng.randrange(2, 9))) + "</ul>"

    def box(tags: list[str], names: list[str], body: str) -> str:
        tag = some(*tags)
        name = some(*names)
        mark = some("class", "class", "id")
        return f'<{tag} {mark}="{name}">{body}</{tag}>' if name and rng.random() < 0.85 else f"<{tag}>{body}</{tag}>"

    def noise() -> str:
        kind = rng.choice([0, 1, 1, 1, 2, 2, 3, 4, 4, 5, 5, 6, 7, 8])
        if kind == 0:
            return box(["nav", "div"], ["nav", "menu", "breadcrumbs", "main-nav", "site-menu"], links())
        if kind == 1:
            return box(["div", "div", "aside"], ["ad", "ads", "advert", "sponsor", "promo-banner"], some(prose(1, 2), f"<p>{prose(1, 2)}</p>"))
        if kind == 2:
            return box(["div", "section"], ["cookie", "consent", "notice", "alert-banner", "cookie-notice"], f"<p>{prose(1, 3)}</p><button>{words(1, 2)}</button>")
        if kind == 3:
            return box(["aside", "div"], ["sidebar", "side", "related", "widget", "recommend"], f"<h3>{words(1, 3)}</h3>" + some(links(), f"<p>{prose(1, 2)}</p>" + links()))
        if kind == 4:
            post = lambda: some(f"<p>{prose(1, 4)}</p>", f"<p>{words(2, 12)}</p>", f"<b>{words(1, 2)}</b> {prose(1, 2)}")
            posts = "".join(some(box(["div", "li", "article"], ["comment", "comment", "comment-body", "reply"], post()), post()) for _ in range(rng.randrange(1, 6)))
            if rng.random() < 0.3:
                return box(["div", "section", "ol"], ["comments", "comment-list", "comments-area"], posts)
            return box(["section", "div"], ["comments", "comments", "respond"], f"<h2>{words(1, 2)}</h2>{posts}")
        if kind == 5:
            return f"<form action='/{word()}'>{some('', f'<h3>{words(1, 3)}</h3>')}{some(f'<label>{words(1, 3)}</label>', '')}<input name=q>{some('', '<br>')}<p>{prose(1, 3)}</p>{some('', prose(1, 2))}</form>"
        if kind == 6:
            return box(["div", "section"], ["share", "social", "newsletter", "subscribe", "tags"], f"<p>{words(2, 9)}</p>" + links())
        if kind == 7:
            return f"<script>var a = '<p>{word()}</p>';</script><style>p{{margin:0}}</style><!-- {word()} -->"
        return box(["div"], ["pagination", "pager", "login", "search"], link() + " " + link())

    def content() -> str:
        mark = "\x02"
        blocks = [f"<h1>{mark}{words(2, 10)}{some('', '', '.')}</h1>"] * int(rng.random() < 0.85)
        if rng.random() < 0.15:  # hardly any text
            return f"<h1>{mark}{words(1, 6)}.</h1>" + some(f"<p><b>{mark}{words(1, 5)}.<br>", f"<p>{mark}{words(1, 5)}.</p>")
        brief = rng.random() < 0.25
        for _ in range(rng.randrange(1, 4 if brief else 10)):
            kind = rng.randrange(0, 14)
            text = prose(1, 2) if brief else prose(1, some(2, 5, 12, 40))
            if rng.random() < 0.35:  # lists of words, and lines that break off
                text = some(f"{word()} " * rng.randrange(2, 200), text.rstrip(".!"), words(1, 40), some("* ", "$$$ ", "| ").join(text.split(" ")), text + " |")
            if kind < 8:
                blocks.append(f"<p>{mark}{text}{some('</p>', '</p>', '')}")
            elif kind == 8:
                blocks.append(f"<p><b>{mark}{text}<br>")
            elif kind == 9:
                blocks.append(f"<h2>{mark}{words(1, 6)}</h2><p>{mark}{text}</p>")
            elif kind == 10:
                blocks.append(f"<{some('ul', 'ol')}>" + "".join(f"<li>{mark}{some(words(1, 9), prose(1, 2))}</li>" for _ in range(rng.randrange(2, 6))) + some("</ul>", "</ol>"))
            elif kind == 11:
                blocks.append(f"<blockquote><p>{mark}{text}</p></blockquote>")
            elif kind == 12:
                blocks.append(f"<p>{mark}{prose(1, 2)} {link()} {prose(1, 2)}</p>")
            else:
                blocks.append(f"<table><tr><td>{mark}{words(1, 4)}</td><td>{mark}{words(1, 4)}</td></tr></table>" if rng.random() < 0.5 else f"<p>{mark}{words(1, 3)}.</p>")
            if rng.random() < 0.12:
                blocks.append(noise())
        return "".join(blocks)

    out = []
    for _ in range(count):
        body = box(["article", "article", "main", "div", "div"], ["", "content", "post", "entry-content", "article-body", "story", "main-content"], content())
        if rng.random() < 0.3:  # no element of its own
            body = content()
        if rng.random() < 0.4:
            body = box(["main", "div", "div"], ["wrapper", "main", "container", "page"], some(body, noise() + body, body + noise()))
        top = f"<header><h2>{words(1, 3)}</h2>{links()}</header>" if rng.random() < 0.4 else ""
        foot = f"<footer>&copy; {word()}.example.com &middot; {prose(1, 2)}{some('', links())}</footer>" if rng.random() < 0.7 else box(["div"], ["footer", "copyright", "legal"], f"<p>&copy; {prose(1, 2)}</p>")
        before, after = "".join(noise() for _ in range(rng.randrange(0, 4))), "".join(noise() for _ in range(rng.randrange(0, 4)))
        ends = some("</body></html>", "</body></html>", "")
        if rng.random() < 0.1 and "<h1" in body:  # a server's form around the whole page
            before, after = f'<form method=post action="/{word()}">{before}', f"{after}</form>"
        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{top}{before}{body}{after}{foot}{ends}")
    return out


def labelled_trees(pages: list[str]) -> tuple[list[Tree], list[list[int]]]:
    """Trees of written pages without their marks, and labels: an element below the body is content if
    most of its text is, and without text as its parent."""
    trees, labels = [], []
    for page in pages:
        marked = [x is not None and x.startswith("\x02") for x in parse(page).text]
        tree = parse(page.replace("\x02", ""))
        good = [len(x) if m and x else 0 for m, x in zip(marked, tree.text)]
        size = [len(x or "") for x in tree.text]
        for k in range(len(size) - 1, 0, -1):
            good[tree.parent[k]] += good[k]
            size[tree.parent[k]] += size[k]
        y: list[int] = []
        for k, p in enumerate(tree.parent):
            above = p < 0 or tree.features[k][0] == TAG["body"]
            y.append(0 if above else y[p] if not size[k] else int(2 * good[k] > size[k]))
        trees.append(tree)
        labels.append(y)
    return trees, labels


def train(pages: int = PAGES, steps: int = STEPS) -> Model:
    model = Model()
    model.fit(*labelled_trees(labelled_pages(pages)), steps)
    return model


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """pages with text, their main text, and n_chars, its code points."""

    def contents(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            found = model.contents([x or "" for x in series])
            yield pd.DataFrame({"text": found, "n_chars": [len(x) for x in found]})

    found = F.pandas_udf(contents, "text string, n_chars long")(F.col(html))
    kept = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    return pages.select(*kept, found.alias("__found")).select(*kept, "__found.*")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"), train()).select("page_id", "url", "text", "n_chars")
