"""Exact top-k inner products by a three-phase uniform threshold.

A vector's dimensions are dealt to PARTS score lists, as if each part lived on
a node of its own; a score is the sum of its partial scores.

1. For every block of vectors, each part's list gives the k entries with the
   highest partial scores, and these entries' whole scores. The k-th best whole
   score over all lists is a cutoff that the true k-th score can't fall below.
2. An entry that reaches the cutoff has at least cutoff / PARTS in one of its
   lists, whatever the signs, so each list gives all entries from there on.
3. The entries gathered are scored exactly and the best k of each block go on
   to the ranking.

Vectors are packed into blocks of bounded size, queries into blocks of about
QUERY_BLOCK by the hash of their ids. Query blocks are dealt to all vector
blocks by their number, and each task sees one block of either at a time. What
is passed between phases is k entries a query and block. Whole scores are summed
only for the entries that lead a list, and then for those that reach the cutoff.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part; vectors of another dimension than a query's are none of
its candidates; a repeated row is a candidate of its own, while rows that share
the query's id are its own row; equal queries count once; ties go to the
smaller id, then to nothing else as the rows are equal. A row without an id
takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.llm.common import read, written

PARTS = 4
QUERY_BLOCK = 1024
VECTOR_BLOCK = 2048
SCALE = 256
BLOCK = "dim int, ids array<long>, data binary"
LOWEST = -(2**63)


def quantised(vector: Column) -> Column:
    """floor(256 x) of every component; null for a vector that takes no part."""
    good = (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)))


def _closed(dim: int, rows: list) -> dict[str, list]:
    """A block of (vec_id, components) of one dimension."""
    ids, data = zip(*rows)
    held = np.array(data, np.int64)
    narrow = np.abs(held).max(initial=0) < 2**31
    return {"dim": [dim], "ids": [list(ids)], "data": [held.astype(np.int32 if narrow else np.int64).tobytes()]}


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (vec_id, q) packed within their partitions into blocks of at most size rows of one dimension."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = {}

        def close(dim: int) -> pd.DataFrame:
            return pd.DataFrame(_closed(dim, waiting.pop(dim)))

        for batch in batches:
            for vec_id, q in zip(batch["vec_id"], batch["q"]):
                waiting.setdefault(len(q), []).append((vec_id, q))
                if len(waiting[len(q)]) == size:
                    yield close(len(q))
        for dim in list(waiting):
            yield close(dim)

    return rows.mapInPandas(pack, BLOCK)


def dealt_blocks(rows: DataFrame, count: int) -> DataFrame:
    """Rows (vec_id, q) of distinct ids in blocks 0 to count - 1 of each dimension, by the hash of their ids."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        for batch in batches:
            for dim, block, vec_id, q in zip(batch["dim"], batch["block"], batch["vec_id"], batch["q"]):
                if held and now != (dim, block):
                    yield pd.DataFrame({"block": [now[1]], **_closed(now[0], held)})
                    held = []
                now = (dim, block)
                held.append((vec_id, q))
        if held:
            yield pd.DataFrame({"block": [now[1]], **_closed(now[0], held)})

    rows = rows.select(F.size("q").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(count)).alias("block"), "vec_id", "q")
    return rows.repartition("dim", "block").sortWithinPartitions("dim", "block", "vec_id").mapInPandas(pack, f"block long, {BLOCK}")


def _matrix(dim: int, ids: np.ndarray, data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // (dim * len(ids))}").reshape(len(ids), dim)


def _partial(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """[PARTS, queries, vectors] exact partial scores: floats where they hold the integers, else integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(q.shape[1], 1)
    kind = np.float64 if most < 2**52 else np.int64
    cuts = np.array_split(np.arange(q.shape[1]), min(PARTS, q.shape[1]))
    return np.stack([q[:, c].astype(kind) @ v[:, c].astype(kind).T for c in cuts])


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def first_lists(q, q_ids, v, v_ids, k) -> Iterator[tuple[int, list[int]]]:
    """Phase 1: (query, whole scores of the entries that lead its lists)."""
    parts = _partial(q, v)
    for i, query in enumerate(q_ids):
        other = np.flatnonzero(v_ids != query)
        lead = sorted({int(other[j]) for p in parts for j in _best(p[i, other], v_ids[other], k)})
        yield int(query), sorted((int(x) for x in parts[:, i, lead].sum(axis=0)), reverse=True)[:k]


def sufficient(q, q_ids, v, v_ids, cutoff, k) -> Iterator[tuple[int, int, int]]:
    """Phases 2 and 3: (query, vector, score) of a block's best k at or above the cutoff."""
    parts = _partial(q, v)
    for i, query in enumerate(q_ids):
        reach = parts[:, i] >= -(-cutoff[i] // len(parts))
        at = np.flatnonzero(reach.any(axis=0) & (v_ids != query))
        score = parts[:, i, at].sum(axis=0)
        at, score = at[score >= cutoff[i]], score[score >= cutoff[i]]
        for j in _best(score, v_ids[at], k):
            yield int(query), int(v_ids[at[j]]), int(score[j])


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(row, query matrix, query ids, vector matrix, vector ids) of every dealt pair of blocks."""
    for batch in batches:
        for row in batch.itertuples():
            q_ids, ids = np.asarray(row.q_ids, np.int64), np.asarray(row.ids, np.int64)
            yield row, _matrix(row.dim, q_ids, row.q), q_ids, _matrix(row.dim, ids, row.data), ids


def top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of every query's k highest inner products."""

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(F.col(vector)).alias("q"))
        return rows.where(F.col("vec_id").isNotNull() & F.col("q").isNotNull())

    held = written(blocks(usable(vectors), VECTOR_BLOCK))
    asked = written(usable(queries).groupBy("vec_id").agg(F.min("q").alias("q")))
    count = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = written(dealt_blocks(asked, count).select("dim", "block", F.col("ids").alias("q_ids"), F.col("data").alias("q")))
    dealt = held.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    pairs = dealt.join(asked, ["dim", "block"])

    def lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, q, q_ids, v, ids in _each(batches):
            yield pd.DataFrame(first_lists(q, q_ids, v, ids, k), columns=["query_id", "lead"])

    lead = pairs.mapInPandas(lists, "query_id long, lead array<long>").select("query_id", F.explode("lead").alias("score"))
    nth = lead.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("n") == k)
    cutoffs = asked.select("block", F.explode("q_ids").alias("query_id")).join(nth.select("query_id", "score"), "query_id")
    cutoffs = cutoffs.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("cutoffs"))
    cutoffs = written(asked.join(cutoffs, "block", "left"))

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row, q, q_ids, v, ids in _each(batches):
            known = dict(row.cutoffs or {})
            yield pd.DataFrame(sufficient(q, q_ids, v, ids, [known.get(int(x), LOWEST) for x in q_ids], k), columns=["query_id", "vec_id", "score"])

    found = dealt.join(cutoffs, ["dim", "block"]).mapInPandas(resolve, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector with all others."""
    vectors = read(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id) a
  JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""
