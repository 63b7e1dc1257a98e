import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import importance, terms
from tidemark.llm.importance import bucket_counts, features, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, longest=1):
    words = WORD.findall((text or "").translate(FOLD))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, least=20, longest=1, size=10_000):
    s, t = [0] * size, [0] * size
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for g in grams(text, longest)[1]:
                side[g % size] += 1
    up, down = float(sum(s) + size), float(sum(t) + size)
    gain = [math.floor(1000 * math.log((b + 1.0) * up / ((a + 1.0) * down))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        words, found = grams(text, longest)
        weight = sum(gain[g % size] for g in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{importance.SEED}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None, len(words)])
    may = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(may[: percent * len(may) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows():
    rng = np.random.default_rng(3)
    words = ["Alpha", "beta", "größe", "x1", "ÉTÉ", "the", "of", "zug", "naïve", "K"]
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 60))) + rng.choice([".", "\n", "--", ""])) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "..."), (None, "alpha " * 30), (503, "w" * 3000 + " beta" * 40), (503, "beta " * 30), (503, "beta " * 30)]
    return docs, ["alpha beta beta of", None, "Größe größe"]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_equals_brute_force(spark, longest):
    docs, target = rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rank string, weight int").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    out = sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in resample(df, aim, longest=longest).collect()), key=repr)
    want = brute(docs, target, longest=longest)
    # equal ids and scores are interchangeable
    assert [r[:4] for r in out] == [r[:4] for r in want]
    assert sorted((r[4] or 0, r[3]) for r in out if r[3] is not None) == sorted((r[4] or 0, r[3]) for r in want if r[3] is not None)


def test_everything_can_be_drawn(spark):
    docs, target = rows()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    drawn = [r["rank"] for r in resample(df, aim, percent=100, least_words=0).collect() if r["rank"] is not None]
    assert sorted(drawn) == list(range(1, sum(i is not None for i, _ in docs) + 1))


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r) for r in resample(one, none).select("doc_id", "n_features", "rank").collect()] == [(1, 3, None)]
    assert bucket_counts(none).sum() == 0


def test_cut_texts_count_alike(monkeypatch):
    """Small pieces give the same features as one piece, runs across the cuts too."""
    text = " ".join(f"w{i % 7}{'x' * (i % 60)}" for i in range(400))
    column = pa.array(["a b c", None, text, "", "d é f", text[:500]])

    def all_of(longest):
        got = [f for f in features(column, longest, 10_000)]
        return sorted(zip(np.concatenate([r for _, r, _ in got]).tolist(), np.concatenate([b for _, _, b in got]).tolist()))

    for longest in (1, 2, 4):
        whole = [(i, g % 10_000) for i, t in enumerate(column.to_pylist()) for g in grams(t, longest)[1]]
        assert all_of(longest) == sorted(whole)
        with monkeypatch.context() as m:
            m.setattr(terms, "PIECE", 64)
            assert all_of(longest) == sorted(whole)


def test_checksums_and_hashes():
    words = ["a", "größe", "x" * 47, "x" * 48, "x" * 49, "y" * 5000, "0"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = terms.runs(terms.Piece(data, np.array([0]), np.array([0]), False))
    assert terms.crc32s(data, starts, ends).tolist() == [zlib.crc32(w.encode()) for w in words]
    assert len(set(terms.hashes(data, starts, ends).tolist())) == len(words)
    twice = np.concatenate([data, [32], data]).astype(np.uint8)
    a, b, _ = terms.runs(terms.Piece(twice, np.array([0]), np.array([0]), False))
    got = terms.hashes(twice, a, b)
    assert got[: len(words)].tolist() == got[len(words) :].tolist()


def test_draw_follows_the_weights(spark):
    """Texts like the target are drawn far more often than their share."""
    docs = [(i, "common words of the corpus again and again " * 4 + ("target words here " * 6 if i % 10 == 0 else "")) for i in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = resample(df, spark.createDataFrame([("target words here target",)] * 5, "text string")).where("rank IS NOT NULL").collect()
    assert len(out) == 100 and sum(r["doc_id"] % 10 == 0 for r in out) > 20
