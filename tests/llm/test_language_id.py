import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id
from tidemark.llm.bigru import STEPS, BiGRU, cut
from tidemark.llm.language_id import held_out, identify, train

WORDS = {"aa": ["the", "thing", "with"], "bb": ["der", "ßch", "über"], "cc": ["que", "ción", "los"]}


def make(n=300):
    rng = random.Random(1)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(2, 60))), lang) for i in range(n) for lang in [rng.choice("aa bb bb cc".split())]]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [*make(), (900, None, "aa"), (901, "", "aa"), (902, "12 %%", "bb"), (903, "the thing", None), (5, *make()[5][1:]), (None, "der über", "bb"), (904, "que " * 60000, "cc")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return model, {(r["doc_id"], r["text"]): r for r in identify(docs, model).collect()}, rows


def test_slopes():
    net = BiGRU(3, 4)
    rng = np.random.default_rng(0)
    x, label, lengths = rng.integers(0, 256, (STEPS, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0]), np.array([64, 3, 40, 1, 64])
    _, slopes = net.loss_and_slopes(x, label, lengths)
    for name, slope in slopes.items():
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        held = net.w[name][at]
        net.w[name][at] = held + 3e-3
        up = net.loss_and_slopes(x, label, lengths)[0]
        net.w[name][at] = held - 3e-3
        assert (up - net.loss_and_slopes(x, label, lengths)[0]) / 6e-3 == pytest.approx(slope[at], rel=0.1)
        net.w[name][at] = held


def test_pooling_equals_the_trained_function():
    net = BiGRU(3, 4)
    data = np.random.default_rng(1).integers(0, 256, 150).astype(np.uint8)
    starts, lengths = np.array([0, 64, 128]), np.array([64, 64, 22])
    x = cut(data, starts, lengths)
    mass, votes = net.pooled(x, lengths)
    fore, back = list(net._run(x, "f")), list(net._run(x[::-1], "b"))[::-1]
    logits = net.w["out"] @ np.stack([np.concatenate(p) for p in zip(fore, back)]) + net.w["bias"]
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    real = (np.arange(STEPS)[:, None] < lengths)[:, None]
    assert np.allclose(mass, (p * real).sum(axis=0), atol=1e-3) and np.allclose(votes.sum(axis=0), lengths)


def test_held_out_rows(spark):
    rows = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)


def test_held_out_accuracy(judged):
    _, out, rows = judged
    test = [r for r in rows if r[0] is not None and r[0] < 300 and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert sum(out[r[0], r[1]]["lang_pred"] == r[2] for r in test) >= 0.95 * len(test)


def test_defined_results(judged):
    _, out, rows = judged
    for key in ((900, None), (901, ""), (902, "12 %%")):
        assert (out[key]["lang_pred"], out[key]["score"]) == ("und", 0)
    assert out[903, "the thing"]["lang_pred"] == "aa" and out[None, "der über"]["lang_pred"] == "bb"
    assert out[904, "que " * 60000]["lang_pred"] == "cc"
    assert all(0 <= r["score"] <= 1 and 0 <= r["label_share"] <= 1 for r in out.values())


def test_equal_texts_agree_whatever_stands_beside_them(spark, judged, monkeypatch):
    model, out, rows = judged
    monkeypatch.setattr(language_id, "SLICE", 1000)
    docs = spark.createDataFrame([r[:2] for r in rows[::-1]], "doc_id long, text string").repartition(5)
    assert all(r["lang_pred"] == out[r["doc_id"], r["text"]]["lang_pred"] and abs(r["score"] - out[r["doc_id"], r["text"]]["score"]) < 2e-4 for r in identify(docs, model).collect())


def test_nothing_to_learn_and_empty(spark):
    docs = spark.createDataFrame([(1, "a text", None)], "doc_id long, text string, lang string")
    assert identify(docs, train(docs)).first()["lang_pred"] == "und"
    assert identify(docs.limit(0), train(docs.limit(0))).count() == 0
