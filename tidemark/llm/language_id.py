"""Language identification by a bidirectional recurrent network over bytes.

The network (bigru.py) is trained on the driver by backpropagation through time
on a bounded sample of labelled rows, then reads every byte of every text in
windows of 64. It gives each byte class probabilities; a document's are the
mean over its bytes, so a text of any length costs memory for one slice only.

Defined results: a null text, an empty one and one without a letter give `und`
and score 0. Without any labelled row everything is `und`. Rows are judged one
by one, so equal texts agree, repeated rows repeat and a tie between classes
goes to the first by name. Null labels teach nothing. Columns named like the
results are replaced; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.llm.bigru import STEPS, BiGRU, cut
from tidemark.llm.common import give_back, read

UNKNOWN = "und"
#: Bytes that are held as windows at a time.
SLICE = 1 << 20


@dataclass(frozen=True)
class Sampling:
    """Bounds of the training sample; prediction has none."""

    rows_per_class: int = 400
    windows_per_row: int = 3


@dataclass(frozen=True)
class Identifier:
    """A trained network and the names of its classes."""

    names: tuple[str, ...]
    net: BiGRU | None


def held_out(doc_id: Column) -> Column:
    """Rows of every fifth checksum never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_windows(labelled: DataFrame, doc_id: str, text: str, label: str, sampling: Sampling) -> pd.DataFrame:
    """At most rows x windows pieces of text of every label.

    Rows are taken by a hash of their id under a threshold that each class's
    count sets, so the sample has the same size at any input size, and pieces
    lie anywhere in a text.
    """
    labelled = labelled.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(label).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    counts = labelled.groupBy("l").count().orderBy(F.desc("count"), "l").collect()
    if not counts:
        return pd.DataFrame({"l": [], "w": []})
    wanted = F.create_map(*[F.lit(x) for r in counts for x in (r["l"], min(1.0, 1.3 * sampling.rows_per_class / r["count"]))])
    at = lambda k: F.pmod(F.xxhash64("i", F.lit(k)), F.greatest(F.length("t") - STEPS + 1, F.lit(1))).cast("int") + 1
    picked = (
        labelled.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < wanted[F.col("l")] * (1 << 30))
        .select("i", "l", F.explode(F.array(*[F.col("t").substr(at(k), F.lit(STEPS)) for k in range(sampling.windows_per_row)])).alias("w"))
        .where(F.col("w").rlike(r"\p{L}"))
    )
    most = len(counts) * sampling.rows_per_class * sampling.windows_per_row
    return picked.orderBy(F.xxhash64("i"), "w").limit(most).select("l", "w").toPandas().sort_values(["l", "w"], ignore_index=True)


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "lang", sampling: Sampling = Sampling(), hidden: int = 8, epochs: int = 8) -> Identifier:
    """Fit an identifier on rows of labelled."""
    sample = sample_windows(labelled, doc_id, text, label, sampling)
    names = tuple(sorted(set(sample["l"])))
    if not names:
        return Identifier((), None)
    pieces = [w.encode()[:STEPS] for w in sample["w"]]
    lengths = np.array([len(p) for p in pieces])
    windows = cut(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths, lengths)
    net = BiGRU(len(names), hidden)
    net.fit(windows, np.array([names.index(x) for x in sample["l"]]), lengths, epochs)
    return Identifier(names, net)


def _probabilities(net: BiGRU, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """[texts, classes] mean probabilities, and shares of bytes labelled with each class."""
    lengths = np.array([len(t) for t in texts])
    windows = -(-lengths // STEPS)
    doc = np.repeat(np.arange(len(texts)), windows)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = np.repeat(np.cumsum(lengths) - lengths, windows) + STEPS * nth
    real = np.minimum(STEPS, np.repeat(lengths, windows) - STEPS * nth)
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    mass, votes = np.zeros((2, net.classes, len(texts)))
    for i in range(0, len(doc), 2048):
        part = slice(i, i + 2048)
        for total, found in zip((mass, votes), net.pooled(cut(buffer, start[part], real[part]), real[part])):
            for c in range(net.classes):
                total[c] += np.bincount(doc[part], found[c], len(texts))
    return (mass / lengths).T, (votes / lengths).T


def _slices(texts: list[bytes]) -> Iterator[list[int]]:
    now, size = [], 0
    for i, t in enumerate(texts):
        if now and size + len(t) > SLICE:
            yield now
            now, size = [], 0
        now.append(i)
        size += len(t)
    if now:
        yield now


def predictor(model: Identifier):
    """A column function from text to (lang_pred, score, label_share)."""

    @F.pandas_udf("lang_pred string, score double, label_share double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            name = np.full(len(series), UNKNOWN, object)
            score, share = np.zeros(len(series)), np.zeros(len(series))
            lettered = [i for i, t in enumerate(series) if t is not None and any(map(str.isalpha, t))] if model.net else []
            coded = [series.iat[i].encode() for i in lettered]
            for part in _slices(coded):
                p, v = _probabilities(model.net, [coded[i] for i in part])
                best = np.round(p, 4).argmax(axis=1)
                at = [lettered[i] for i in part]
                rows = np.arange(len(part))
                name[at] = [model.names[b] for b in best]
                score[at], share[at] = np.round(np.clip(p[rows, best], 0, 1), 4), np.round(v[rows, best], 4)
            yield pd.DataFrame({"lang_pred": name, "score": score, "label_share": share})
        give_back()

    return predict


def identify(docs: DataFrame, model: Identifier, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and label_share, the share of bytes labelled so."""
    found = predictor(model)(F.col(text))
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "label_share")]
    return docs.select(*kept, found.alias("__found")).select(*kept, "__found.*")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "label_share"
    )
