import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lexical, terms
from tidemark.llm.lexical import build_index, counted, search, statistics

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return [w.translate(FOLD) for w in TERM.findall(text or "")]


def brute(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    texts: dict = {}
    for i, t in items:
        if i is not None and t is not None:
            texts[i] = min(texts.get(i, t), t)
    out = []
    for item, text in texts.items():
        scored = []
        for i, c in held:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if t in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def tables():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(120)] + ["Größe", "ÉTÉ", "X", "the"]
    share = np.append(1 / np.arange(1, 121), [0.3, 0.1, 0.2, 3])
    text = lambda n: " ".join(rng.choice(words, n, p=share / share.sum()))
    docs = [(i, text(int(rng.integers(1, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[0][1]) for i in range(30)]  # ties
    docs += [(7, docs[7][1]), (None, "w3 w3 w3"), (400, None), (401, ""), (402, "... !"), (403, "long " * 5000 + "w5")]
    items = [(i, text(int(rng.integers(1, 12)))) for i in range(25)]
    items += [(50, docs[0][1]), (51, "THE the The"), (52, None), (53, ""), (54, "unknown"), (None, "w1"), (55, "w2"), (55, "w1"), (56, "long")]
    return docs, items


@pytest.mark.parametrize("block,seeds,group", [(16, 2, 1 << 18), (3, 1, 40), (256, 4, 1 << 18)])
def test_equals_brute_force(spark, monkeypatch, block, seeds, group):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "SEEDS", seeds)
    monkeypatch.setattr(lexical, "TERMS", group)
    docs, items = tables()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, block string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    out = sorted(tuple(r) for r in search(df, asked, 20).collect())
    assert out == brute(docs, items, 20)


def test_text_ids(spark):
    docs = [("b", "red apple"), ("a", "red apple"), ("c", "green")]
    out = search(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([("q", "apple")], "item_id string, text string"), 1).collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in out] == [("q", 1, "a")]


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one, item = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs, items), (docs, item), (one, items), (spark.createDataFrame([(1, None)], "doc_id long, text string"), item)):
        assert search(d, i).collect() == []


def test_cut_texts_count_alike(monkeypatch):
    texts = ["a b a", None, " ".join(f"t{i % 9}" for i in range(300)), "", "x", "é" * 200]
    whole = [(row, t.tolist(), n.tolist()) for row, t, n in counted(pa.array(texts)) if len(t)]
    assert [(r, sorted(n)) for r, _, n in whole] == [(i, sorted(Counter(terms_of(t)).values())) for i, t in enumerate(texts) if terms_of(t)]
    monkeypatch.setattr(terms, "PIECE", 32)
    assert [(row, t.tolist(), n.tolist()) for row, t, n in counted(pa.array(texts)) if len(t)] == whole


def test_blocks_that_cannot_win_are_skipped(spark, monkeypatch):
    """Bounds hold for every document, and a query of rare words leaves most blocks unread."""
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 10)
    docs = spark.createDataFrame([(i, f"common words here {'rare' if i < 25 else ''} w{i}") for i in range(400)], "doc_id long, text string").coalesce(1)
    n, length = statistics(docs)
    index = build_index(docs, n, length)
    rows = lexical.query_terms(spark.createDataFrame([(1, "rare")], "item_id long, text string"), "item_id", "text").collect()
    asked = lexical.weigh(rows, index, n)
    assert index.count() == 40
    assert lexical.reaching(index, asked, np.array([1])).count() == 3
    best = lexical.scores_of(index, asked, np.array([0]), n, length, 5, index.sparkSession.range(1).schema["id"].dataType).collect()
    highest = max(r["score"] for r in best)
    assert lexical.reaching(index, asked, np.array([highest])).count() >= 1
    assert lexical.reaching(index, asked, np.array([2 * highest])).count() == 0
