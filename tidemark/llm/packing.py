"""Packing token sequences by vector bin packing with the dot-product heuristic.

A sequence has a limit for each dimension at once: tokens, segments and
loss-bearing tokens. The packer keeps one sequence open and adds the waiting
piece whose demand has the largest dot product with what is left of the limits
among those that fit, so pieces that are large where room is large go first and
the last gap gets the piece that fills it best.

Documents are cut at multiples of the length, so full pieces are sequences of
their own and need no packing. The remaining pieces are dealt evenly to tasks,
sorted there and packed GROUP at a time; the sequences that a group leaves
unfilled are taken apart and packed again with the next group. A task's memory
is bounded by GROUP and its input by an even deal, whatever the keys.

Defined results: a null text is an empty one and gives only the closing id;
repeated rows are packed each; an empty table gives an empty one; other columns
aren't read.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.llm.common import give_back, read, written
from tidemark.llm.shingles import words_of

LENGTH = 2048
CLOSING_ID = 1
GROUP = 8192
#: Pieces for each packing task, so that its last sequences weigh little.
PIECES_PER_TASK = 4 * GROUP
#: Words and ids that a worker remembers (24 bytes a word or so), and bytes of text that it encodes at a time.
WORDS, IDS, SLICE = 1_000_000, 8_000_000, 1 << 18
#: Words that are encoded as one text, with this character between them.
LINE, MARK = 64, "\x01"
#: Documents that are tokenised at a time.
ROWS = 512


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = LENGTH
    segments: int = 256
    loss: int = LENGTH


class _Words:
    """A worker's tokenizer, and the ids of the words that it has met, by hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.forget()

    def forget(self) -> None:
        """Known hashes in order, with the first id and the number of ids of each."""
        self.known, self.low, self.size = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32)
        self.ids, self.used = np.empty(1 << 16, self.kind), 0

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and their numbers; a line of words is one text."""
        lines = [f" {MARK} ".join(words[k : k + LINE]) for k in range(0, len(words), LINE)]
        found = self.tokenizer.encode_batch_fast([x + f" {MARK}" for x in lines], add_special_tokens=False)
        ids = np.concatenate([np.array(f.ids, self.kind) for f in found])
        ends = np.flatnonzero(ids == self.mark)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        low, size = [], []
        for k in range(0, len(words), 8 * LINE):
            part = words[k : k + 8 * LINE]
            if any(MARK in w for w in part):
                each = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in part]
                new, sizes = np.array([i for e in each for i in e], self.kind), np.array([len(e) for e in each])
            else:
                new, sizes = self.ids_of(part)
            if self.used + len(new) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty(len(self.ids) // 2 + len(new), self.kind)])
            self.ids[self.used : self.used + len(new)] = new
            low.append(self.used + np.cumsum(sizes) - sizes)
            size.append(sizes)
            self.used += len(new)
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.low, self.size = np.insert(self.low, at, np.concatenate(low)), np.insert(self.size, at, np.concatenate(size))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and their numbers."""
        if len(self.known) > WORDS or self.used > IDS:
            self.forget()
        buffer, words, starts, ends, count = words_of(texts)
        distinct, first, back = np.unique(words, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        held = at < len(self.known)
        held[held] = self.known[at[held]] == distinct[held]
        new = np.flatnonzero(~held)
        if len(new):
            raw = buffer.tobytes()
            self.learn(distinct[new], [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            at = np.searchsorted(self.known, distinct)
        low, size = self.low[at][back].astype(np.int64), self.size[at][back].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(total[-1]) + np.repeat(low - total[:-1], size)
        edges = total[np.concatenate([[0], np.cumsum(count)])]
        return self.ids[at].astype("<u4"), np.diff(edges)


def _worker(path: str) -> _Words:
    """What this worker process keeps from task to task."""
    name = f"_tidemark_tokenizer_{zlib.crc32(path.encode())}"
    if name not in sys.modules:
        held = types.ModuleType(name)
        held.words = _Words(path)
        sys.modules[name] = held
    return sys.modules[name].words


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about SLICE, cut at spaces."""
    at = 0
    while len(text) - at > SLICE and (space := text.find(b" ", at + SLICE)) >= 0:
        yield text[at:space]
        at = space
    yield text[at:]


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """Each text's ids as little-endian 32-bit integers.

    The vocabulary drops white space and case, and no token or normalisation
    crosses white space, so a text's ids are those of its words, and each
    distinct word of a slice is looked up once. Words are told apart by 64-bit
    hashes. Only a text that spells out a special token is encoded as a whole.
    """
    worker = _worker(path)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        ids, numbers = worker.encode([part for _, part in held])
        for (k, _), part in zip(held, np.split(ids, np.cumsum(numbers)[:-1])):
            found[k].append(part)
        held.clear()

    size = 0
    for k, text in enumerate(texts):
        coded = text.encode()
        if any(s in coded for s in worker.special):
            found[k].append(np.array(worker.tokenizer.encode(text, add_special_tokens=False).ids, "<u4"))
            continue
        for part in _parts(coded):
            held.append((k, part))
            size += len(part)
            if size >= SLICE:
                flush()
                size = 0
    if held:
        flush()
    return [np.concatenate(f) if f else np.empty(0, "<u4") for f in found]


def cut(ids: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(start, length, checksum) of the pieces of a document's ids."""
    for start in range(0, len(ids), length):
        part = ids[start : start + length]
        yield start, len(part), zlib.crc32(part)


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every document's pieces."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                found = token_ids([t or "" for t in part.column(1).to_pylist()], path)
                cuts = [(k, *piece, len(ids) + 1) for k, ids in enumerate(found) for piece in cut(np.append(ids, np.uint32(CLOSING_ID)).astype("<u4"))]
                rows, *columns = (pa.array(c, pa.int64()) for c in zip(*cuts))
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), *columns], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(tokenise, StructType([docs.schema["doc_id"], *[StructField(c, LongType()) for c in names[1:]]]))


def fill(demand: np.ndarray, limit: np.ndarray) -> list[list[int]]:
    """Items of [n, dimensions] demands dealt to bins; an item over a limit gets a bin of its own."""
    share = demand / limit
    waiting = np.argsort(-share.sum(axis=1), kind="stable")
    bins: list[list[int]] = []
    over = (share > 1).any(axis=1)
    bins += [[int(i)] for i in waiting[over[waiting]]]
    waiting = waiting[~over[waiting]]
    want = share[waiting].T.copy()
    here = np.ones(len(waiting), bool)
    left_over = len(waiting)
    while left_over:
        room, now = np.ones(len(limit)), []
        fits = here.copy()
        while True:
            score = np.where(fits, room @ want, -1)
            k = int(score.argmax())
            if score[k] < 0:
                break
            now.append(int(waiting[k]))
            here[k] = False
            room -= want[:, k]
            fits &= here
            for d in range(len(limit)):
                fits &= want[d] <= room[d] + 1e-9
        bins.append(now)
        left_over -= len(now)
        if left_over < len(waiting) // 2:
            waiting, want = waiting[here], want[:, here].copy()
            here = np.ones(len(waiting), bool)
    return bins


def pack(items: DataFrame, limits: tuple[tuple[str, int], ...], size: str) -> DataFrame:
    """items with sequence_id and offset, within limits by column; size is the column that offsets count.

    Items are dealt evenly, so a task's share needs no key. Sequence ids hold
    the task's number above 33 bits and count up within it.
    """
    columns, limit = [c for c, _ in limits], np.array([float(x) for _, x in limits])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, number = TaskContext.get().partitionId() << 33, 0

        def closed(rows: pd.DataFrame, bins: list[list[int]]) -> pd.DataFrame:
            nonlocal number
            order = [i for b in bins for i in b]
            out = rows.iloc[order].copy()
            out["sequence_id"] = first + number + np.repeat(np.arange(len(bins)), [len(b) for b in bins])
            number += len(bins)
            before = out[size].to_numpy(np.int64).cumsum() - out[size].to_numpy(np.int64)
            opens = np.cumsum([0, *[len(b) for b in bins[:-1]]])
            out["offset"] = before - np.repeat(before[opens], [len(b) for b in bins])
            return out

        def packed(rows: pd.DataFrame, last: bool) -> tuple[pd.DataFrame | None, pd.DataFrame]:
            demand = rows[columns].to_numpy(float)
            bins = fill(demand, limit)
            good = bins if last else [b for b in bins if (demand[b].sum(axis=0) / limit).max() >= 0.995]
            rest = rows.drop(rows.index[[i for b in good for i in b]])
            return (closed(rows, good) if good else None), rest

        held = None
        for batch in batches:
            for i in range(0, len(batch), GROUP):
                part = batch.iloc[i : i + GROUP]
                held = (part if held is None else pd.concat([held, part])).reset_index(drop=True)
                if len(held) >= GROUP:
                    out, held = packed(held, len(held) >= 3 * GROUP)
                    if out is not None:
                        yield out
        if held is not None and len(held):
            yield packed(held.reset_index(drop=True), True)[0]
        give_back()

    tasks = max(1, items.count() // PIECES_PER_TASK)
    dealt = items.repartition(tasks).sortWithinPartitions(*[c for c, kind in items.dtypes if not kind.startswith("map")])
    return dealt.mapInPandas(run, StructType([*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits()) -> DataFrame:
    """Every piece of every document with its place; all but a document's first id bear loss."""
    found = pieces(docs, path).withColumn("segments", F.lit(1)).withColumn("loss", F.col("length") - F.when(F.col("start") == 0, 1).otherwise(0))
    return pack(written(found), (("length", limits.tokens), ("segments", limits.segments), ("loss", limits.loss)), "length")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    packed = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss")
