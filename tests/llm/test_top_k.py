import math

import numpy as np

from tidemark.llm import top_k as module
from tidemark.llm.top_k import top_k


def brute(rows, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for query in sorted({i for i, _ in good if i % 50 == 0}):
        q = min(v for i, v in good if i == query)
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in good if i != query and len(v) == len(q))
        out += [(query, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    out = top_k(df, df.where("vec_id % 50 = 0"), k).collect()
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(module, "VECTOR_BLOCK", 37)
    monkeypatch.setattr(module, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 7).astype(np.float32)]) for i in range(230)]
    rows += [(300 + i, rows[0][1]) for i in range(9)]  # ties
    rows += [(50, rows[50][1]), (100, rows[3][1]), (7, rows[7][1])]  # repeated ids
    rows += [(400, None), (401, []), (450, [1.0, None] + [0.0] * 5), (500, [float("nan")] * 7), (501, [float("inf")] * 7), (None, rows[1][1])]
    rows += [(550, [0.5, 0.25]), (551, [1.0, -1.0]), (600, [3.0])]  # other dimensions
    assert run(spark, rows) == brute(rows, 5)


def test_large_components(spark):
    rows = [(i, [float(2**20 + i), -3.0, 1.5]) for i in range(60)]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []
