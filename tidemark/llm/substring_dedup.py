"""Substring deduplication by sliding spans of sentences.

A text is a row of sentences: they end behind a word with a full stop, question
or exclamation mark, at a line's end, and after UNIT words, so that a passage of
one long sentence is several too. From every sentence on, the fewest sentences
(at least two) with SPAN words or more are a span, and its hash is that of its
words in ASCII lower case. Cuts after UNIT words depend on where the sentence
begins. So longer sentences are also cut into pieces, of at most UNIT words, where
the words themselves say so: before the pair of words with the smallest hash
among REACH to either side. The fewest pieces and short sentences with SPAN words
are spans too; a passage that begins within a sentence has the same pieces after
a few words, whatever stands before it.

Spans are joined over the whole corpus by hash; all but the first, by id and
place, are repeats, and the words that any repeat covers are removed. A passage
of more than 50 words that stands in several documents so stays in the first of
them only, but for a few words at its ends that are glued to other text.
n_removed counts the sentences of UNIT words at most that lost words.

Hashes of 64 bits stand for spans. Finding the hashes that come twice takes only
counts, and their first places only minima, which are formed where the rows lie;
the joins that mark the others may be split, so a passage in a third of all
documents burdens no task.

Defined results: null and empty texts, and texts without a whole span, stay as
they are; rows with equal id and text are one document, so they never repeat
each other and come out alike; rows without an id come last in the order; equal
texts under other ids are removed but for one. Other columns pass through;
those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.llm.common import fresh, read, written
from tidemark.llm.shingles import mix, range_hashes, words_of

UNIT = 16
SPAN = 20
#: A piece opens at the smallest hash among so many words to either side.
REACH = 4
#: Bytes of text that are hashed at a time.
SLICE = 1 << 17
_STOPS = np.zeros(256, bool)
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_STOPS[[ord(c) for c in ".!?"]] = True


def sentences(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all words of all texts: text, first byte and hash; and the words that open a sentence, and a piece."""
    buffer, words, starts, ends, count = words_of(texts)
    if not len(words):
        none = np.empty(0, np.int64)
        return none, none, words, none, none
    lines = np.concatenate([[0], np.cumsum(buffer == 10)])
    doc = np.repeat(np.arange(len(texts)), count)
    closes = _STOPS[buffer[ends - 1]]
    closes[:-1] |= (lines[starts[1:]] > lines[ends[:-1]]) | (doc[1:] != doc[:-1])
    closes[-1] = True
    opens = np.concatenate([[True], closes[:-1]])
    return doc, starts, words, _every(opens), _every(opens | _marked(words, opens))


def _every(opens: np.ndarray) -> np.ndarray:
    """The words that open something, and every UNIT-th from each of them on."""
    at = np.arange(len(opens))
    return np.flatnonzero((at - np.maximum.accumulate(np.where(opens, at, 0))) % UNIT == 0)


def _marked(words: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Words of sentences of more than UNIT words whose pair with the next word has the one smallest hash within REACH words of the sentence."""
    number = np.cumsum(opens)
    pair = mix(words + np.roll(words, -1) * _NEXT)
    least = np.bincount(number)[number] > UNIT
    for k in range(1, min(REACH + 1, len(words))):
        apart, up = number[k:] != number[:-k], pair[k:] > pair[:-k]
        least[:-k] &= apart | up
        least[k:] &= apart | (pair[k:] < pair[:-k])
    return least


def _runs(doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end words of the spans of sentences or pieces."""
    end = np.concatenate([first[1:], [len(doc)]])
    last = np.maximum(np.searchsorted(end, first + SPAN), np.arange(len(first)) + 1)
    fits = np.flatnonzero(last < len(first))
    fits = fits[doc[first[last[fits]]] == doc[first[fits]]]
    return first[fits], end[last[fits]]


def spans(doc: np.ndarray, units: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end words of all spans, and their numbers: twice the first word's in its text, and one more if only pieces have the span."""
    a, b = _runs(doc, units)
    c, d = _runs(doc, pieces)
    new = ~np.isin(c << 32 | d, a << 32 | b)
    first = np.concatenate([a, c[new]])
    number = 2 * (first - np.searchsorted(doc, doc[first]))
    number[len(a) :] += 1
    return first, np.concatenate([b, d[new]]), number


def _slices(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE or i == len(texts) - 1:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        name, mark = batch["name"].to_numpy(), batch["mark"].to_numpy()
        for base, texts in _slices([(t or "").encode() for t in batch["text"]]):
            doc, _, words, units, pieces = sentences(texts)
            a, b, number = spans(doc, units, pieces)
            if len(a):
                yield pd.DataFrame({"name": name[base + doc[a]], "mark": mark[base + doc[a]], "at": number.astype(np.int32), "hash": range_hashes(words, a, b).view(np.int64)})


def without(text: bytes, repeats: np.ndarray) -> tuple[bytes, int, int]:
    """text without what lies under repeated spans, given by their numbers; and the numbers of
    sentences and of those that lost words."""
    doc, byte, _, units, pieces = sentences([text])
    if not len(repeats):
        return text, len(units), 0
    a, b, number = spans(doc, units, pieces)
    hit = np.isin(number, repeats)
    covered = np.zeros(len(doc) + 1, np.int64)
    np.add.at(covered, a[hit], 1)
    np.add.at(covered, b[hit], -1)
    gone = np.cumsum(covered)[:-1] > 0
    edges = np.concatenate([byte, [len(text)]])
    turns = np.flatnonzero(np.diff(gone, prepend=True, append=True))  # kept runs open and close in turn
    kept = text[: edges[0]] + b"".join(text[edges[i] : edges[j]] for i, j in zip(turns[0::2], turns[1::2]))
    return kept.rstrip(), len(units), int(np.logical_or.reduceat(gone, units).sum())


def _cleaned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, repeats in batches:
        out = []
        for t, r in zip(texts, repeats):
            clean, n, removed = without((t or "").encode(), np.asarray([] if r is None else r, np.int64))
            out.append((None if t is None else clean.decode(), n, removed))
        yield pd.DataFrame(out, columns=["text", "n_sentences", "n_removed"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with text but for repeated spans, n_sentences and n_removed."""
    mark = F.xxhash64(F.col(text))
    rows = docs.select(F.col(doc_id).alias("name"), mark.alias("mark"), F.col(text).alias("text")).where(F.length("text") > 0)
    kind = docs.schema[doc_id].dataType
    hashed = written(rows.mapInPandas(_hashed, StructType([StructField("name", kind), StructField("mark", LongType()), StructField("at", IntegerType()), StructField("hash", LongType())])))
    place = F.struct(F.col("name").isNull().alias("unnamed"), "name", "mark", "at")
    often = written(hashed.groupBy("hash").count().where("count > 1").select("hash"))  # apart from the joins, so that their hot partitions can be split
    alike = written(hashed.join(often, "hash"))
    firsts = written(alike.groupBy("hash").agg(F.min(place).alias("low")))
    repeats = alike.join(firsts, "hash").where(place != F.col("low")).groupBy("name", "mark").agg(F.collect_set("at").alias("repeats"))
    a, b, c = fresh(docs, "at_name"), fresh(docs, "at_mark"), fresh(docs, "at_repeats")
    repeats = repeats.select(F.col("name").alias(a), F.col("mark").alias(b), F.col("repeats").alias(c))
    both = docs.join(repeats, F.col(doc_id).eqNullSafe(F.col(a)) & (mark == F.col(b)), "left")
    kept = [x for x in docs.columns if x.lower() not in (text.lower(), "n_sentences", "n_removed")]
    done = fresh(docs, "done")
    cleaned = F.pandas_udf(_cleaned, "text string, n_sentences int, n_removed int")
    return both.select(*kept, cleaned(F.col(text), F.col(c)).alias(done)).select(*kept, f"{done}.text", f"{done}.n_sentences", f"{done}.n_removed")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand in an earlier place."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_sentences", "n_removed", "text")
