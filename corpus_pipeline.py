"""A training corpus from raw documents, in stages over the documents table.

Each stage takes what its predecessor kept and all but the last return the
columns of documents. Rows without an id or text pass where a stage doesn't say
otherwise; an empty table stays one. Further columns pass through all stages but
the last, whatever their names; ties and very long texts are the operators' own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tidemark.llm import language_id, mixing, near_dedup, packing, pii
from tidemark.llm.common import fresh, read, written

#: Documents whose best language has less of the probability go: chance is a quarter
#: with four languages, and of 10,000 labelled ones 13 score less, most of a word or two.
LEAST_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go."""
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    judged = language_id.identify(docs, model)
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays, once if its row is repeated;
    an id with several texts keeps or loses all of them."""
    kept = near_dedup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    nth = F.row_number().over(W.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))
    column = fresh(docs, "nth")
    once = docs.join(kept, "doc_id", "left_semi").withColumn(column, nth).where(F.col(column) == 1)
    return once.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind; other texts stay as they are."""
    found = pii.find_personal(docs, pii.train(docs))
    text = F.coalesce("clean", "text")
    return found.withColumns({"text": text, "n_chars": F.when(F.col("clean").isNull(), F.col("n_chars")).otherwise(F.length("clean"))}).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights; one that is drawn for two epochs is there twice."""
    return mixing.select_mix(docs, mixing.tree_levels(), mixing.PRODUCTION).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("segments")


STAGES = [
    ("language id", language_stage),
    ("near duplicates", dedup_stage),
    ("personal data", privacy_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained stages; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
