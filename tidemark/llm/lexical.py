"""Ranked lexical search over a forward index in blocks, with block-max pruning.

A term is a maximal run of ASCII letters and digits and bytes of other
characters, in lower case as far as A-Z goes. The index has one row for each
range of documents: per document its id, length and terms with their counts,
and per term of the block the number of its documents and the highest impact
that it has in any of them. A search

1. sums the documents of each query term over the blocks, for its weight;
2. bounds each query's scores in each block by the block's maxima, and scores
   the SEEDS blocks with the highest bounds: the k-th best score is a threshold
   that the result can't fall short of;
3. takes all blocks whose bound reaches a query's threshold, in the order of
   their bounds, and scores each until the bound is below what k documents have
   by then. A block that only ties is scored, as ties go to the smaller id.

Scores are integers, so results don't depend on the order. Blocks hold at most
BLOCK_DOCS documents and end when they have BLOCK_TERMS terms. Queries are
searched together until they have about TERMS terms, which is what is sent to
the executors at once; thresholds and best lists are bounded by that and k.

Defined results: a null or empty text has no terms and is no result; a document
without an id counts in all statistics but is no result; repeated rows are
results of their own; a query whose id repeats has the smallest of its texts,
and one without an id or terms has no result; terms beyond the documents'
vocabulary weigh in no score. Terms are told apart by 64-bit hashes. Only the
id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from tidemark.llm.common import drop_table, give_back, read, written
from tidemark.llm.terms import hashes, lowered, pieces, runs

BEST = 20
BLOCK_DOCS, BLOCK_TERMS = 256, 1 << 18
SEEDS = 4
TERMS = 1 << 18
SATURATION, LENGTH_SHARE, UNIT = 12, 25, 1_000_000_000


def counted(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, terms, counts) of every text in order; a text that is cut comes as a whole."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    row = -1
    for piece in pieces(column):
        starts, ends, segment = runs(piece)
        found = hashes(lowered(piece), starts, ends)
        order = np.lexsort((found, segment))
        found, owner = found[order], segment[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        often = np.diff(np.append(first, len(found)))
        cut = np.searchsorted(owner[first], np.arange(len(piece.rows) + 1))
        for i, r in enumerate(piece.rows):
            part = (found[first[cut[i] : cut[i + 1]]], often[cut[i] : cut[i + 1]])
            if r == row:
                held.append(part)
                continue
            if held:
                yield row, *_together(held)
            row, held = int(r), [part]
    if held:
        yield row, *_together(held)


def _together(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    terms, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    often = np.zeros(len(terms), np.int64)
    np.add.at(often, at, np.concatenate([n for _, n in parts]))
    return terms, often


def statistics(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms all have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = length = 0
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for piece in pieces(batch.column(0)):
                n += np.bincount(piece.rows[runs(piece)[2]], minlength=len(n))
            filled, length = filled + int((n > 0).sum()), length + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([filled]), pa.array([length])], ["filled", "length"])

    found = docs.select(text).mapInArrow(run, "filled long, length long").agg(F.sum("filled"), F.sum("length")).first()
    return found[0] or 0, found[1] or 0


def impact(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term's weight is multiplied by, for its count tf in a document of n terms."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // length
    return (UNIT * tf) // (1000 * tf + SATURATION * m)


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned integers in as many bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max())) if len(x) else np.uint8).tobytes()


def _wide(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // count}").astype(np.int64) if count else np.zeros(0, np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """A batch's rows one by one; packed numbers stay where they are."""
    packed = [pa.types.is_binary(c.type) or pa.types.is_large_binary(c.type) for c in batch.columns]
    for i in range(batch.num_rows):
        yield {n: c[i].as_buffer() if raw else c[i].as_py() for n, c, raw in zip(batch.schema.names, batch.columns, packed)}


_KINDS = ("vocabulary", "held_by", "maxima", "lengths", "sizes", "codes", "often")


def build_index(docs: DataFrame, documents: int, length: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each block: n_docs, n_terms, n_postings, ids, and as packed numbers the vocabulary with its
    documents and maxima, and the documents' lengths, numbers of terms, terms and counts."""
    kind = docs.schema[doc_id].dataType
    id_type = to_arrow_type(kind)
    shape = StructType([*[StructField(c, IntegerType()) for c in ("n_docs", "n_terms", "n_postings")], StructField("ids", ArrayType(kind)), *[StructField(c, BinaryType()) for c in _KINDS]])

    def block(ids: list, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
        parts = [parts[i] for i in order]
        sizes = np.array([len(t) for t, _ in parts])
        often = np.concatenate([n for _, n in parts]).astype(np.int64)
        vocabulary, codes = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
        lengths = np.array([n.sum() for _, n in parts], np.int64)
        high = np.zeros(len(vocabulary), np.int64)
        np.maximum.at(high, codes, impact(often, np.repeat(lengths, sizes), documents, length))
        held_by = np.bincount(codes, minlength=len(vocabulary))
        packed = [vocabulary.astype("<u8").tobytes(), *map(_narrow, (held_by, high, lengths, sizes, codes, often))]
        arrays = [pa.array([n], pa.int32()) for n in (len(ids), len(vocabulary), len(codes))]
        arrays += [pa.array([[ids[i] for i in order]], pa.list_(id_type)), *[pa.array([x], pa.binary()) for x in packed]]
        return pa.RecordBatch.from_arrays(arrays, shape.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, many = [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, terms, often in counted(batch.column(1)):
                if len(terms):
                    ids.append(names[row])
                    parts.append((terms, often))
                    many += len(terms)
                if len(ids) == BLOCK_DOCS or many >= BLOCK_TERMS:
                    yield block(ids, parts)
                    ids, parts, many = [], [], 0
        if ids:
            yield block(ids, parts)
        give_back()

    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, shape)
    return written(found.withColumn("block", F.monotonically_increasing_id()))


@dataclass
class Queries:
    """Some queries: their ids, and the terms of all in one sorted vocabulary; query q has the entries from first[q] on."""

    ids: list
    vocabulary: np.ndarray
    first: np.ndarray
    terms: np.ndarray
    weights: np.ndarray

    def bounds(self, vocabulary: np.ndarray, maxima: np.ndarray) -> np.ndarray:
        """No document of a block has a higher score for a query."""
        high = np.zeros(len(self.vocabulary), np.int64)
        mine, theirs = self.places(vocabulary)
        high[mine] = maxima[theirs]
        return np.add.reduceat(self.weights * high[self.terms], self.first)

    def places(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where terms that both have stand in this vocabulary and in that one."""
        at = np.minimum(np.searchsorted(vocabulary, self.vocabulary), len(vocabulary) - 1)
        mine = np.flatnonzero(vocabulary[at] == self.vocabulary)
        return mine, at[mine]


def query_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, terms and counts, packed, and n, the number of different terms, of every query that has terms."""
    one = items.where(F.col(item_id).isNotNull()).groupBy(F.col(item_id).alias("item_id")).agg(F.min(text).alias("text"))
    shape = StructType([StructField("item_id", one.schema["item_id"].dataType), StructField("n", LongType()), StructField("terms", BinaryType()), StructField("counts", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, t.astype("<u8"), n.astype("<i8")) for row, t, n in counted(batch.column(1)) if len(t)]
            arrays = [batch.column(0).take(pa.array([r for r, _, _ in found], pa.int64())), pa.array([len(t) for _, t, _ in found], pa.int64())]
            arrays += [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(arrays, shape.names)

    return written(one.mapInArrow(run, shape))


def weigh(rows: list, index: DataFrame, documents: int) -> Queries:
    """Queries with the weights of their terms, from the blocks' numbers of documents."""
    spark = index.sparkSession
    terms = np.concatenate([np.frombuffer(r["terms"], "<u8") for r in rows])
    counts = np.concatenate([np.frombuffer(r["counts"], "<i8") for r in rows])
    vocabulary, at = np.unique(terms, return_inverse=True)
    first = np.cumsum([0, *[r["n"] for r in rows[:-1]]])
    asked = Queries([r["item_id"] for r in rows], vocabulary, first, at, counts)
    held = spark.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value.vocabulary), np.int64)
        for batch in batches:
            for r in _rows(batch):
                mine, theirs = held.value.places(np.frombuffer(r["vocabulary"], "<u8"))
                total[mine] += _wide(r["held_by"], r["n_terms"])[theirs]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "documents"])

    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select("n_terms", "vocabulary", "held_by").mapInArrow(run, "term long, documents long").groupBy("term").agg(F.sum("documents").alias("documents")).collect():
        df[r["term"]] = r["documents"]
    weight = np.array([math.floor(1000 * math.log((2.0 * documents + 2) / (2.0 * d + 1))) for d in df.tolist()], np.int64)
    asked.weights = counts * weight[at]
    return asked


class Best:
    """A query's k best documents so far, as (-score, id), and the score that one more has to reach."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.rows = k, max(1, least), []

    def add(self, ids: list, scores: list[int]) -> None:
        self.rows = sorted(self.rows + [(-s, i) for s, i in zip(scores, ids)])[: self.k]
        if len(self.rows) == self.k:
            self.least = max(self.least, -self.rows[-1][0])


def scores_of(blocks: DataFrame, asked: Queries, least: np.ndarray, documents: int, length: int, k: int, item_type, only: dict | None = None) -> DataFrame:
    """(item_id, doc_id, score): each task's k best documents of every query, of those that reach its least score.

    A block is scored for the queries whose bound there reaches what their k-th
    best document has by then; only: for these alone, by block.
    """
    held = blocks.sparkSession.sparkContext.broadcast((asked, least, only))
    shape = StructType([StructField("item_id", item_type), StructField("doc_id", blocks.schema["ids"].dataType.elementType), StructField("score", LongType())])
    types = [to_arrow_type(f.dataType) for f in shape]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least, only = held.value
        best = [Best(k, x) for x in least.tolist()]
        ends = np.append(asked.first[1:], len(asked.terms))
        for batch in batches:
            for r in _rows(batch):
                vocabulary = np.frombuffer(r["vocabulary"], "<u8")
                bounds = asked.bounds(vocabulary, _wide(r["maxima"], r["n_terms"]))
                todo = [q for q in (range(len(best)) if only is None else only[r["block"]]) if bounds[q] >= best[q].least]
                if not todo:
                    continue
                sizes = _wide(r["sizes"], r["n_docs"])
                owner = np.repeat(np.arange(r["n_docs"]), sizes)
                codes = _wide(r["codes"], r["n_postings"])
                gain = impact(_wide(r["often"], r["n_postings"]), np.repeat(_wide(r["lengths"], r["n_docs"]), sizes), documents, length)
                order = np.argsort(codes.astype(np.uint16) if r["n_terms"] <= 1 << 16 else codes, kind="stable")
                owner, gain = owner[order], gain[order]
                last = np.cumsum(np.bincount(codes, minlength=r["n_terms"]))
                place = np.full(len(asked.vocabulary), -1)
                mine, theirs = asked.places(vocabulary)
                place[mine] = theirs
                named = sum(x is not None for x in r["ids"])
                for q in todo:
                    if bounds[q] < best[q].least:
                        continue
                    t = np.arange(asked.first[q], ends[q])
                    at = place[asked.terms[t]]
                    t, at = t[at >= 0], at[at >= 0]
                    often = last[at] - np.where(at > 0, last[at - 1], 0)
                    take = np.repeat(last[at] - np.cumsum(often), often) + np.arange(often.sum())
                    score = np.zeros(r["n_docs"], np.int64)
                    np.add.at(score, owner[take], np.repeat(asked.weights[t], often) * gain[take])
                    good = np.flatnonzero(score[:named] >= best[q].least)
                    if len(good) > k:  # documents of a block are in the order of their ids
                        good = good[np.argsort(-score[good], kind="stable")[:k]]
                    if len(good):
                        best[q].add([r["ids"][d] for d in good], score[good].tolist())
        rows = [(asked.ids[q], i, -s) for q, b in enumerate(best) for s, i in b.rows if -s >= b.least]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else ([], [], []), types)], shape.names)
        give_back()

    return blocks.mapInArrow(run, shape)


def top(scored: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id and score of each query's k best."""
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def highest_bounds(index: DataFrame, asked: Queries) -> dict[int, list[int]]:
    """The queries by block, of each query's SEEDS blocks with the highest bounds."""
    held = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(held.value.ids)
        high, at = np.zeros((SEEDS, n), np.int64), np.full((SEEDS, n), -1)
        for batch in batches:
            for r in _rows(batch):
                low = high.argmin(axis=0)
                bounds = held.value.bounds(np.frombuffer(r["vocabulary"], "<u8"), _wide(r["maxima"], r["n_terms"]))
                q = np.flatnonzero(bounds > high[low, np.arange(n)])
                high[low[q], q], at[low[q], q] = bounds[q], r["block"]
        s, q = np.nonzero(at >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(high[s, q]), pa.array(at[s, q])], ["query", "bound", "block"])

    found = index.select("block", "n_terms", "vocabulary", "maxima").mapInArrow(run, "query long, bound long, block long")
    nth = F.row_number().over(W.partitionBy("query").orderBy(F.col("bound").desc(), "block"))
    out: dict[int, list[int]] = {}
    for r in found.withColumn("nth", nth).where(F.col("nth") <= SEEDS).select("query", "block").collect():  # SEEDS rows a query
        out.setdefault(r["block"], []).append(r["query"])
    return out


def reaching(index: DataFrame, asked: Queries, least: np.ndarray) -> DataFrame:
    """(block, reach) of the blocks where a query's bound reaches its least score; reach: how far beyond it the bound is."""
    held = index.sparkSession.sparkContext.broadcast((asked, np.maximum(least, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, least = held.value
        for batch in batches:
            blocks, reach = [], []
            for r in _rows(batch):
                over = (asked.bounds(np.frombuffer(r["vocabulary"], "<u8"), _wide(r["maxima"], r["n_terms"])) / least).max()
                if over >= 1:
                    blocks.append(r["block"])
                    reach.append(float(over))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(reach, pa.float64())], ["block", "reach"])

    return index.select("block", "n_terms", "vocabulary", "maxima").mapInArrow(run, "block long, reach double")


def search(docs: DataFrame, items: DataFrame, k: int = BEST, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: each item's k documents with the highest scores above 0, ties to the smaller id."""
    documents, length = statistics(docs, text)
    queries = query_terms(items, item_id, item_text)
    total = queries.agg(F.sum("n")).first()[0] or 0
    item_type = queries.schema["item_id"].dataType
    empty = docs.sparkSession.createDataFrame([], StructType([StructField("item_id", item_type), StructField("doc_id", docs.schema[doc_id].dataType), StructField("score", LongType())]))
    if not documents or not total:
        return top(empty, k)
    index = build_index(docs, documents, length, doc_id, text)
    groups = -(-total // TERMS)
    found = []
    for g in range(groups):
        rows = queries.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()  # about TERMS terms
        if not rows:
            continue
        asked = weigh(rows, index, documents)
        seeds = highest_bounds(index, asked)
        place = {i: q for q, i in enumerate(asked.ids)}
        least = np.zeros(len(rows), np.int64)
        first = index.where(F.col("block").isin(list(seeds)))
        for r in top(scores_of(first, asked, least, documents, length, k, item_type, seeds), k).where(F.col("rank") == k).collect():  # a row a query
            least[place[r["item_id"]]] = r["score"]
        alive = index.join(written(reaching(index, asked, least)), "block").sortWithinPartitions(F.col("reach").desc())
        found.append(written(scores_of(alive, asked, least, documents, length, k, item_type)))
    drop_table(index)
    drop_table(queries)
    return top(reduce(DataFrame.union, found, empty), k)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents that match each benchmark item best."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM lengths),
weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w
  FROM tfs, totals GROUP BY term, docs
),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
),
scores AS (
  SELECT item_id, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // length))))::BIGINT AS score
  FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY item_id, doc_id
),
placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM placed WHERE rank <= 20
"""
