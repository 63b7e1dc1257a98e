"""Secrets in texts: rules for three kinds, and random tokens that the rules miss.

A candidate is a run of at least 16 letters, digits, `+`, `/`, `_` or `-` (at
most 512, as longer ones are data) that holds more than digits and no other
letters beside it; of a run with signs in it, either the whole counts or its
parts between the signs, whichever look more random. Each is put to the
battery of randomness.py under its encoding. A candidate that fails it has the
p-value 1, any other that of written tokens looking as random; within each
stratum (encoding and band of length) Benjamini and Hochberg's procedure over
all documents decides which are secrets, so that of those reported at any length
about RATE are not. Its counts are p-values by tenths of a decade, 36 strata at
any size of the corpus.

What written tokens look like is learned from decoys, whose words come from
the letters that follow each other in the words of all documents. For that
texts are read once, and once more into spans and candidates with their
p-values; the thresholds found from those are then applied in SQL.

Defined results: a null text is an empty one and has no spans; repeated rows
repeat and count in the procedure each; columns named like the results are
replaced and all others pass through; an empty table gives an empty one.
Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tidemark.llm.common import read, written
from tidemark.llm.randomness import LONGEST, SHORTEST, STRATA, battery, encodings, null_of_writing, p_random, p_written, stratum, written_words
from tidemark.llm.terms import pieces, runs

#: In the order in which kinds are listed; the last is the battery's.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
#: Share of false discoveries, and the least p-value of being random.
RATE, LEAST_RANDOM = 0.01, 0.001
#: p-values are counted by this many to a decade, up to TOP.
TENTHS, TOP = 10, 300
#: Words that decoys are made of, drawn from the chain of all documents' words; letters of a word at most, and its mark of an end.
CHAINED, LETTERS, END = 4000, 12, "$"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_KEYS = ("passw", "secret", "token", "api")

_HEX, _CAPITAL, _TOKEN, _SIGN = (np.zeros(256, bool) for _ in range(4))
_HEX[list(b"0123456789abcdef")] = True
_CAPITAL[[*range(0x30, 0x3A), *range(0x41, 0x5B)]] = True
_SIGN[list(b"+/_-")] = True
_TOKEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TOKEN |= _SIGN

Span = tuple[int, int, int]


def assigned(text: str) -> list[Span]:
    """Spans of values given to names of secrets."""
    low = text.lower()
    if not any(k in low for k in _KEYS):
        return []
    return [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]


def _parts(data: np.ndarray, a: int, b: int) -> list[tuple[int, int]]:
    """The stretches between the signs of a run that are long enough."""
    cuts = np.flatnonzero(_SIGN[data[a:b]]) + a
    edges = [a - 1, *cuts.tolist(), b]
    return [(x + 1, y) for x, y in zip(edges, edges[1:]) if y - x - 1 >= SHORTEST]


def candidates(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, null) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, p-value in tenths of decades) of the tokens in runs of token characters."""
    tokens: list[tuple[int, int, int]] = []
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        part = data[a:b]
        if part.max() >= 0x80:
            continue
        inner = np.flatnonzero(~_SIGN[part])
        if not len(inner):
            continue
        low, high = a + int(inner[0]), a + int(inner[-1]) + 1
        whole = [(low, high)] if SHORTEST <= high - low <= LONGEST else []
        split = [x for x in _parts(data, low, high) if x != (low, high) and x[1] - x[0] <= LONGEST]
        tokens += [(k, *x) for x in whole + split]
    if not tokens:
        return []
    owner, a, b = (np.array(x) for x in zip(*tokens))
    encoding = encodings(data, a, b)
    good = encoding >= 0
    owner, a, b, encoding = owner[good], a[good], b[good], encoding[good]
    if not len(a):
        return []
    fisher, place = battery(data, a, b, encoding), stratum(encoding, b - a)
    p = np.where(p_random(fisher) >= LEAST_RANDOM, p_written(fisher, place, null), 1.0)
    tenths = np.minimum(TOP, np.floor(-TENTHS * np.log10(np.clip(p, 1e-300, 1)) + 1e-9)).astype(np.int64)
    out, at = [], 0
    for k, n in zip(*np.unique(owner, return_counts=True)):
        mine = range(at, at + n)
        at += n
        wide = next((i for i in mine if n > 1 and b[i] - a[i] == max(b[j] - a[j] for j in mine)), None)
        if wide is not None:
            inner = [i for i in mine if i != wide]
            mine = [wide] if all(tenths[i] <= tenths[wide] for i in inner) else inner
        out += [(int(a[i]), int(b[i]), int(place[i]), int(tenths[i])) for i in mine]
    return out


def _scan(column: pa.Array, null) -> tuple[list[list[Span]], list[list[tuple[int, int, int, int]]]]:
    """Base spans and candidates of every text, in code points."""
    base = [assigned(t or "") for t in column.to_pylist()]
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in base]
    passed = 0  # code points of a cut text in earlier pieces
    for piece in pieces(column, _TOKEN):
        data = piece.data
        passed = passed if piece.continues else 0
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        place = lambda byte, seg: int(chars[byte] - chars[piece.at[seg]]) + (passed if seg == 0 else 0)
        starts, ends, segment = runs(piece, _HEX)
        for i in np.flatnonzero(ends - starts >= 32):
            s = segment[i]
            base[piece.rows[s]].append((place(starts[i], s), place(ends[i], s), 2))
        starts, ends, segment = runs(piece, _CAPITAL)
        for i in np.flatnonzero(ends - starts >= 16):
            key = data[starts[i] : ends[i]].tobytes().find(b"AKIA")
            if key >= 0 and ends[i] - starts[i] - key >= 16:
                s = segment[i]
                base[piece.rows[s]].append((place(starts[i] + key, s), place(ends[i], s), 1))
        starts, ends, segment = runs(piece, _TOKEN)
        long = np.flatnonzero(ends - starts >= SHORTEST)
        starts, ends, segment = starts[long], ends[long], segment[long]
        for a, b, where, tenths in candidates(data, starts, ends, null):
            s = segment[np.searchsorted(starts, a, side="right") - 1]
            found[piece.rows[s]].append((place(a, s), place(b, s), where, tenths))
        passed += int(chars[-1] - chars[piece.at[-1]]) if len(piece.rows) == 1 else 0
    for row, spans in enumerate(base):
        spans.sort(key=lambda x: (x[0], x[2]))
        if spans and found[row]:
            edges: list[list[int]] = []
            for a, b, _ in spans:
                if edges and a <= edges[-1][1]:
                    edges[-1][1] = max(edges[-1][1], b)
                else:
                    edges.append([a, b])
            lows = [a for a, _ in edges]
            free = lambda a, b: (k := bisect_right(lows, b - 1) - 1) < 0 or edges[k][1] <= a
            found[row] = [x for x in found[row] if free(x[0], x[1])]
    return base, found


_SPAN = StructType([StructField("start", LongType()), StructField("kind", IntegerType()), StructField("stop", LongType())])
_FOUND = StructType([StructField("start", LongType()), StructField("stop", LongType()), StructField("stratum", IntegerType()), StructField("tenths", IntegerType())])


def scanned(rows: DataFrame, null) -> DataFrame:
    """row, base and found of rows of (row, text)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
    token = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("stratum", pa.int32()), ("tenths", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = _scan(batch.column(1), null)
            spans = pa.array([[{"start": a, "kind": k, "stop": b} for a, b, k in x] for x in base], span)
            tokens = pa.array([[{"start": a, "stop": b, "stratum": s, "tenths": t} for a, b, s, t in x] for x in found], token)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, tokens], ["row", "base", "found"])

    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("base", ArrayType(_SPAN)), StructField("found", ArrayType(_FOUND))]))


def thresholds(counts: dict[int, dict[int, int]], rate: float = RATE) -> dict[int, int]:
    """By stratum the least tenths whose p-value Benjamini and Hochberg's procedure rejects; none where it rejects nothing."""
    out = {}
    for place, by in counts.items():
        total, above, least = sum(by.values()), 0, None
        for tenths in sorted(by, reverse=True):
            above += by[tenths]
            if tenths and 10 ** (-tenths / TENTHS) <= rate * above / total:
                least = tenths
        if least is not None:
            out[place] = least
    return out


def word_chain(docs: DataFrame, text: str) -> dict[str, dict[str, int]]:
    """How often which letter (or END) follows which two in the words of all documents: runs of ASCII letters, cut at LETTERS.

    A word weighs the whole binary logarithm of how many (document, spelling) pairs
    hold it, so neither very frequent words nor the pieces of tokens, which hardly
    ever repeat, rule the chain. At most 27 * 27 pairs with 27 followers come back,
    whatever the corpus.
    """
    spelled = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,%d}" % LETTERS), F.lit(0)))
    words = docs.select(F.explode(spelled).alias("w")).groupBy(F.lower("w").alias("w")).agg((F.length(F.bin(F.count("*"))) - 1).cast("long").alias("weight")).where("weight > 0")
    marked = F.concat(F.lit(END * 2), F.col("w"), F.lit(END))
    steps = words.select("weight", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(marked, i, F.lit(3)))).alias("s"))
    chain: dict[str, dict[str, int]] = {}
    for r in steps.groupBy("s").agg(F.sum("weight").alias("n")).orderBy("s").collect():
        chain.setdefault(r["s"][:2], {})[r["s"][2]] = r["n"]
    return chain


def chained_words(chain: dict[str, dict[str, int]], count: int, seed: int = 21) -> list[str]:
    """Words of two to LETTERS letters drawn from a chain; none from an empty one."""
    rng = np.random.default_rng(seed)
    drawn = {pair: (list(next_), np.cumsum(list(next_.values()))) for pair, next_ in chain.items()}
    out = []
    for _ in range(count if chain else 0):
        word = END * 2
        while len(word) < LETTERS + 2:
            letters, total = drawn[word[-2:]]
            letter = letters[int(np.searchsorted(total, rng.integers(total[-1]), side="right"))]
            if letter == END:
                break
            word += letter
        out.append(word[2:])
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["stop"])), ",")


def _of_kind(k: int):
    return lambda s: s["kind"] == k


def find_secrets(docs: DataFrame, text: str = "text", rate: float = RATE, keep: list[str] | None = None) -> DataFrame:
    """docs (or of these the columns to keep) with n_assign, n_access and n_hex (the rules' spans), base_sha256, spans (kind:start:end of all spans,
    comma-joined), secrets (the same as an array) and n_added, the number of random tokens."""
    names = {*[f"n_{k}" for k in BASE], "base_sha256", "spans", "secrets", "n_added"}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    null = null_of_writing(chained_words(word_chain(docs, text), CHAINED) + written_words(400))
    held = written(scanned(docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text")), null))
    each = held.select(F.explode("found").alias("f")).groupBy("f.stratum", "f.tenths").count().collect()  # STRATA x TOP rows at most
    counts: dict[int, dict[int, int]] = {}
    for r in each:
        counts.setdefault(r["stratum"], {})[r["tenths"]] = r["count"]
    least = thresholds(counts, rate)
    bars = F.array(*[F.lit(least.get(s, TOP + 1)) for s in range(STRATA)])
    random = F.transform(
        F.filter("found", lambda f: f["tenths"] >= bars[f["stratum"]]),
        lambda f: F.struct(f["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), f["stop"].alias("stop")),
    )
    out = held.select("row", "base", F.array_sort(F.concat("base", random)).alias("secrets"))
    n = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    added = (F.size("secrets") - F.size("base")).cast("long").alias("n_added")
    return out.select("row.*", *n, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), "secrets", added)


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; n_* count the base spans, n_added the battery's."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return find_secrets(docs, keep=["doc_id"]).select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_added")
