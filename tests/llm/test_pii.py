import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import pii
from tidemark.llm.bilstm_crf import BiLSTMCRF


def brute(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))


def test_rules_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(6000):
        text = "".join(rng.choice("ab@@..0123456789+-( )é") for _ in range(rng.randint(0, 60)))
        assert pii.rule_spans(text) == brute(text), text
    for text in ("4111 1111 1111 1111", "x 1.2.3.4.5.6.7.8.9", "a@b.c@d.e", "300.1.1.1.5.6.7.8", "+1 (254) 555-7532 4025839355974266", "0001.2.3.00255"):
        assert pii.rule_spans(text) == brute(text)


def test_long_texts_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "@" * 100_000, "+1" * 50_000, "a@" * 50_000):
        pii.rule_spans(text)


def test_slopes():
    texts, spans = pii.written_examples(6)
    x = np.stack([pii.symbols(t) for t in texts], axis=1)
    y = np.stack([pii.labels(pii.WINDOW, s) for s in spans], axis=1)
    net = BiLSTMCRF(pii.SYMBOLS, 1 + 2 * len(pii.KINDS), 4)
    _, slopes = net.loss_and_slopes(x, y)
    for name, slope in slopes.items():
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        held = net.w[name][at]
        net.w[name][at] = held + 1e-2
        up = net.loss_and_slopes(x, y)[0]
        net.w[name][at] = held - 1e-2
        assert (up - net.loss_and_slopes(x, y)[0]) / 2e-2 == pytest.approx(slope[at], rel=0.1)
        net.w[name][at] = held


def test_decoding_is_the_best_path():
    net = BiLSTMCRF(pii.SYMBOLS, 3, 2)
    net.w["move"] = np.random.default_rng(1).normal(0, 1, (3, 3)).astype(np.float32)
    x = np.array([[3], [50], [7], [12]])
    score = net.emissions(x)[0][:, :, 0]
    paths = {p: sum(score[t, c] for t, c in enumerate(p)) + sum(net.w["move"][a, b] for a, b in zip(p, p[1:])) for p in np.ndindex(3, 3, 3, 3)}
    assert tuple(net.decode(x)[:, 0]) == max(paths, key=paths.get)


def test_windows_agree_on_one_label():
    for length in (0, 5, 64, 65, 96, 97, 200, 1000):
        last = max(0, -(-(length - pii.WINDOW) // pii.STRIDE))
        numbers = list(range(last + 1))
        paths = np.stack([np.arange(k * pii.STRIDE, k * pii.STRIDE + pii.WINDOW) for k in numbers], axis=1)
        assert pii.reconcile(length, numbers, paths).tolist() == list(range(length))


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    item = lambda: rng.choice(["bo.x@mail.example.com", "10.2.33.4", "4111111111111111", "+1 (254) 555-7532", "(254) 555-7532", "version 3.1", "the"])
    rows = [(i, " ".join([*[word() for _ in range(20)], item(), *[word() for _ in range(30)], item()])) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "é" * 40 + " a@b.co"), (902, "é" * 40 + " a@b.co"), (None, "call 10.0.0.1"), (903, "word " * 4000 + "10.0.0.1")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    return rows, pii.find_personal(docs, pii.train(docs)).collect()


def test_base_spans_stay(found):
    rows, out = found
    want = sorted(((i, *[sum(s[2] == k for s in brute(t or "")) for k in pii.BASE], hashlib.sha256(pii.joined(brute(t or "")).encode()).hexdigest()) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], *[r[f"n_{k}"] for k in pii.BASE], r["base_sha256"]) for r in out), key=repr) == want
    for r in out:
        spans = set(r["spans"].split(",")) - {""}
        assert {pii.joined([s]) for s in brute(r["text"] or "")} <= spans
        assert len(spans) == r["n_added"] + sum(r[f"n_{k}"] for k in pii.BASE)
        assert (r["clean"] is None) == (not spans)


def test_tagger_adds_national_numbers_and_leaves_the_rest(found):
    _, out = found
    national = [r for r in out if r["text"] and re.search(r"(?<![0-9] )\(254\) 555-7532", r["text"])]
    assert sum(r["n_added"] > 0 for r in national) > 0.7 * len(national)
    assert all(r["n_added"] == 0 for r in out if "254" not in (r["text"] or ""))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_personal(docs, pii.train(docs)).count() == 0


def test_tagger_adds_secrets(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    key = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows = [(i, " ".join([*[word() for _ in range(20)], f'token = "{key()}"' if i % 2 else word(), *[word() for _ in range(30)]])) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.find_personal(docs, pii.train(docs)).collect()
    right = [r for r in out if r["doc_id"] % 2 and r["spans"] == f"secret:{r['text'].index(chr(34)) + 1}:{r['text'].rindex(chr(34))}"]
    assert len(right) > 0.8 * len(out) / 2
    assert all(r["n_added"] == 0 for r in out if not r["doc_id"] % 2)
