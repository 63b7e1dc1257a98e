"""Resampling documents by importance towards a target distribution of hashed features.

Features are all runs of 1 to `longest` consecutive words, joined by one space,
repeats counted, in BUCKETS buckets. Two passes over Arrow batches:

1. Each partition counts its features with np.bincount into one vector of
   BUCKETS numbers; treeReduce merges the vectors of the documents, and those of
   the target texts.
2. The gains of the buckets, BUCKETS numbers at any size of the corpus, are
   broadcast; each document gathers the gains of its features and sums them with
   np.bincount's weights.

A document's score is its weight plus Gumbel noise from its id's hash, so the
highest scores are a draw without replacement in proportion to exp(weight/1000).
Only rows that can be drawn are sorted: counts of scores by thousands, of which
there are a few dozen, tell the lowest thousand that the draw can reach. The
ranks come from ranges of the sorted order and the ranges' counts.

Defined results: a null or empty text has no features, weight 0 and is never
drawn unless the least number of words is 0; rows with equal ids and scores are
interchangeable and each has a rank of its own; a row without an id has no score
and takes no part in the draw; an empty table gives an empty one, and an empty
target is a uniform one. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import read, written
from tidemark.llm.terms import crc32s, lowered, pieces, runs

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Scores are counted by this many at a time.
STEP = 1000


def _spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after another with a space behind each, and where they are there."""
    size = ends - starts + 1
    last = np.cumsum(size)
    first = last - size
    take = np.repeat(starts - first, size) + np.arange(last[-1] if len(last) else 0)
    out = data[np.minimum(take, len(data) - 1)] if len(take) else np.zeros(0, np.uint8)
    out[last - 1] = 0x20
    return out, first, last - 1


def features(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of the column: the rows of its words, and the rows and buckets of its features.

    A text that is cut hands its last words on, so that runs across the cut count once.
    """
    kept: list[bytes] = []
    for piece in pieces(column):
        data, (starts, ends, segment) = lowered(piece), runs(piece)
        words = piece.rows[segment]
        if longest == 1:
            yield words, words, (crc32s(data, starts, ends) % np.uint32(buckets)).astype(np.int64)
            continue
        old = kept if piece.continues else []
        if old:
            head = b" ".join(old) + b" "
            size = np.array([len(w) for w in old])
            data = np.concatenate([np.frombuffer(head, np.uint8), data])
            before = np.cumsum(size + 1) - size - 1
            starts, ends = np.concatenate([before, starts + len(head)]), np.concatenate([before + size, ends + len(head)])
        rows = np.concatenate([np.full(len(old), piece.rows[0]), words]).astype(np.int64)
        data, starts, ends = _spaced(data, starts, ends)
        owner, found = [], []
        for n in range(1, longest + 1):
            a = np.arange(max(0, len(old) - n + 1), max(0, len(rows) - n + 1))
            a = a[rows[a] == rows[a + n - 1]]
            owner.append(rows[a])
            found.append(crc32s(data, starts[a], ends[a + n - 1]) % np.uint32(buckets))
        last = np.flatnonzero(rows == piece.rows[-1])[-(longest - 1) :]
        kept = [data[starts[i] : ends[i]].tobytes() for i in last]
        yield words, np.concatenate(owner), np.concatenate(found).astype(np.int64)


def bucket_counts(texts: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in features(batch.column(0), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select(text).mapInArrow(run, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket."""
    up, down = float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * up / ((s + 1.0) * down))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of a document's features."""
    held = docs.sparkSession.sparkContext.broadcast(gain)
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            n_words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for words, rows, found in features(batch.column(1), longest, len(gain)):
                n_words += np.bincount(words, minlength=len(n))
                n += np.bincount(rows, minlength=len(n))
                total += np.bincount(rows, weights=gain[found], minlength=len(n)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n_words, n, total // np.maximum(n, 1)))], ["doc_id", "n_words", "n_features", "weight"])

    shape = [StructField("doc_id", kind), *[StructField(c, LongType()) for c in ("n_words", "n_features", "weight")]]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, StructType(shape))


def ranked(df: DataFrame, *order) -> DataFrame:
    """df with rank, from 1, in a total order: ranges of it are sorted apart, and only their counts meet."""
    spark = df.sparkSession
    place = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    placed = written(place)
    part, nth = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row for each range
    before, rows = 0, []
    for r in counts:
        rows.append({"part": r["part"], "before": before})
        before += r["count"]
    ranges = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<part:long,before:long>>")))
    return placed.withColumn("part", part).join(F.broadcast(ranges), "part").withColumn("rank", F.col("before") + nth + 1).drop("part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null for those not drawn.

    Of the documents with at least least_words words, percent in a hundred are
    drawn: those with the highest scores, ties to the smaller id.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    digest = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8)
    h = F.conv(digest, 16, 10).cast("long")
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed(docs, gain, doc_id, text, longest).withColumn("score", score.cast("long")))
    may = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    step = F.floor(F.col("score") / STEP)
    counts = scored.where(may).groupBy(step.alias("step")).count().collect()
    drawn, low = percent * sum(r["count"] for r in counts) // 100, None
    above = 0
    for r in sorted(counts, key=lambda r: -r["step"]):
        if above < drawn:
            above, low = above + r["count"], r["step"]
    shown = ["doc_id", "n_features", "weight", "score"]
    no_rank = F.lit(None).cast("long").alias("rank")
    if low is None:
        return scored.select(*shown, no_rank)
    near = may & (F.col("score") >= low * STEP)
    order = ranked(scored.where(near).select(*shown), F.col("score").desc(), F.col("doc_id"))
    order = order.select(*shown, F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return order.union(scored.where(~F.coalesce(near, F.lit(False))).select(*shown, no_rank))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark texts, its score, and its rank if drawn."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH RECURSIVE crc_of(n, round, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT n, round + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_of WHERE round < 8
),
crc_table AS (SELECT list(c ORDER BY n) AS entry FROM crc_of WHERE round = 8),
words AS (
  SELECT 'raw' AS side, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM documents
  UNION ALL
  SELECT 'target', item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
  FROM benchmark
),
bytes AS (
  SELECT word, list_transform(range(0, length(hex(encode(word))) // 2),
    lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS INT), 2) AS BIGINT)) AS b
  FROM (SELECT DISTINCT word FROM words)
),
bucketed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
    lambda c, x: xor(entry[CAST(xor(c, x) & 255 AS INT) + 1], c >> 8))) % 10000 AS bucket
  FROM bytes, crc_table
),
counts AS (
  SELECT bucket, count(*) FILTER (side = 'raw') AS s, count(*) FILTER (side = 'target') AS t
  FROM words JOIN bucketed USING (word) GROUP BY bucket
),
totals AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM counts),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000))))::BIGINT AS gain
  FROM counts, totals
),
weights AS (
  SELECT doc_id, count(gain) AS n, coalesce(floor(sum(gain)::DOUBLE / nullif(count(gain), 0))::BIGINT, 0) AS weight
  FROM (SELECT doc_id FROM documents) LEFT JOIN (
    SELECT doc_id, gain FROM words JOIN bucketed USING (word) JOIN gain USING (bucket) WHERE side = 'raw') USING (doc_id)
  GROUP BY doc_id
),
scored AS (
  SELECT doc_id, n, weight, weight + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5)::DOUBLE
    / 4294967296)))::BIGINT AS score
  FROM weights
),
places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS eligible FROM scored WHERE n >= 20
)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN place <= 10 * eligible // 100 THEN place END AS rank
FROM scored LEFT JOIN places USING (doc_id)
"""
