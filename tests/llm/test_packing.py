import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.packing import Limits, fill, pack_documents, token_ids

PATH = public_tokenizers.path("word_bpe_49k.json")


def rows_of(n=160):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé'ß019.,Ü") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([1, 20, 200, 900])))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, " \n "), (5, rows[5][1]), (None, "x y"), (903, "It's <|endoftext|> don’t áb\x1cc  d\r\n" * 30), (904, "z" * 3000)]


def test_words_give_the_ids_of_the_text():
    whole = Tokenizer.from_file(PATH)
    texts = [t or "" for _, t in rows_of()]
    texts += ["e\u0301A\u030a \u0301x Ǆ ΑΣ ΑΣ. İi \u00a0y\u2003z", "a b " * 400_000]
    for text, found in zip(texts, token_ids(texts, PATH)):
        assert found.tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 64)
    rows = rows_of()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, sequence_id string")
    out = pack_documents(df.repartition(4), PATH, Limits(2048, 40, 2048)).toPandas()
    whole = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    got = [(None if np.isnan(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out.itertuples()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    used = 0
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert seq["offset"].tolist() == [0, *seq["length"].cumsum()[:-1]]
        assert seq["length"].sum() <= 2048 and len(seq) <= 40
        used += 1
    assert used <= 1.15 * out["length"].sum() / 2048 + 2


def test_limits_hold_at_once():
    rng = np.random.default_rng(1)
    demand = np.stack([rng.integers(1, 60, 300), np.ones(300), rng.integers(0, 30, 300)], axis=1)
    bins = fill(demand, np.array([100.0, 4.0, 40.0]))
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert all((demand[b].sum(axis=0) <= [100, 4, 40]).all() for b in bins)
    assert fill(np.array([[200.0, 1, 1]]), np.array([100.0, 4, 40])) == [[0]]


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
    assert pytest.approx(1) == pack_documents(spark.createDataFrame([(1, None)], "doc_id long, text string"), PATH).count()
