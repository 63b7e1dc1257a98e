import random
import re

import pytest

import corpus_pipeline as pipeline
from tidemark.llm import language_id, mixing, near_dedup


def make(n=120):
    rng = random.Random(2)
    vocabulary = {"en": ["the", "and", "thing", "with", "here", "was"], "de": ["der", "und", "ßch", "einü", "von", "keit"]}

    def prose(lang, k):
        return " ".join("".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(1, 2))) for _ in range(k)) + "."

    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de"])
        rows.append((i, prose(lang, rng.randint(30, 120)), lang, f"src{rng.randint(0, 3)}"))
    rows += [(n + i, rows[i][1].replace("the ", "THE "), *rows[i][2:]) for i in range(10)]
    rows += [(200, "123 456 !!", "en", "src0"), (201, None, None, None), (202, "", "en", "src1"), (3, *rows[3][1:])]
    rows += [(203, prose("en", 40) + " mail bo.x@mail.example.com or 10.1.2.3 now.", "en", "src2")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.createDataFrame(make(), "doc_id long, text string, lang string, source string, n_chars long")
    found = [docs]
    for _, stage in pipeline.STAGES:
        found.append(pipeline.written(stage(spark, found[-1], "")))
    return found


def test_columns(steps):
    assert all(s.schema.fieldNames() == steps[0].schema.fieldNames() for s in steps[1:-1])


def test_language_stage(steps):
    left = {r["doc_id"] for r in steps[0].collect()} - {r["doc_id"] for r in steps[1].collect()}
    assert left == {200, 201, 202}


def test_dedup_stage_keeps_one_of_each_group(steps):
    groups = near_dedup.near_duplicates(steps[1]).collect()
    assert sorted(r["doc_id"] for r in steps[2].collect()) == sorted({r["component_id"] for r in groups})


def test_privacy_stage(steps):
    before = {r["doc_id"]: r for r in steps[2].collect()}
    for r in steps[3].collect():
        if r["doc_id"] == 203:
            assert "<email>" in r["text"] and "<ip>" in r["text"] and "@" not in r["text"] and r["n_chars"] == len(r["text"])
        else:
            assert r == before[r["doc_id"]]


def test_mixing_stage(steps):
    count = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0d]+", r["text"])) for r in rows)
    assert count(steps[4].collect()) <= mixing.PRODUCTION.share * count(steps[3].collect())
    assert count(steps[4].collect()) >= 0.6 * count(steps[3].collect())


def test_packing_stage(steps):
    pieces = steps[5].toPandas()
    docs = steps[4].toPandas()
    assert sorted(pieces[pieces["start"] == 0]["doc_id"]) == sorted(docs["doc_id"])
    assert (pieces.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, ""))
    assert docs.count() == 0
    assert language_id.train(docs.selectExpr("doc_id", "'' AS text", "'' AS lang")).net is None
