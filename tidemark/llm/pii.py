"""Personal data in texts: rules for four kinds, and a tagger that adds what they miss.

The tagger (bilstm_crf.py) is a character-level bidirectional LSTM with CRF
transitions, trained on the driver from labelled spans: windows of a bounded
sample of documents, labelled by the rules, and written examples, which also
hold telephone numbers in national forms and keys and tokens of access (kind
`secret`), neither of which the rules know, and things that only look alike. It
reads windows of WINDOW characters that overlap by
half. A character's label is that of the window it is most central in; spans
are read from the labels of the whole text, so windows can't disagree.

A span without a digit or an at sign is none, so a window without either
needs no reading; the outcome is the same as if every window was read. A span
of the tagger counts only if its form is valid and no rule's span overlaps it.

Defined results: a null text is an empty one and has no spans; repeated rows
repeat; columns named like the results are replaced and all others pass through.
Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.bilstm_crf import BiLSTMCRF
from tidemark.llm.common import give_back, read

#: In the order in which kinds are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
WINDOW = 64
STRIDE = WINDOW // 2
SYMBOLS = 98
#: Bounds of the training sample: documents looked at, and windows taken.
SAMPLE_DOCS, SAMPLE_WINDOWS = 8000, 1500
WRITTEN_WINDOWS = 3000

_TRIGGER = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile("[0-9]+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
_SECRETIVE = re.compile(r"(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{14,}")
_NATIONAL = re.compile(r"\(?[0-9]{2,4}\)?(?:[ .-]{1,2}[0-9]{2,5}){1,4}")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, in one pass."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Every four parts of a dotted run of numbers are a match, valid up to 255 each."""
    for run in _DOTTED.finditer(text):
        parts = list(_DIGITS.finditer(text, run.start(), run.end()))
        for k in range(0, len(parts) - 3, 4):
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in parts[k : k + 4]):
                yield parts[k].start(), parts[k + 3].end()


def rule_spans(text: str) -> list[Span]:
    """The rules' spans by start, then kind."""
    if not _TRIGGER.search(text):
        return []
    found = [(a, b, "email") for a, b in emails(text)] + [(a, b, "ip") for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def symbols(text: str) -> np.ndarray:
    """Printable ASCII one by one; white space as a space; other letters and the rest as one symbol each."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where((code > 32) & (code < 127), code - 32, 0)
    return np.where(code >= 128, 96, out).astype(np.int64)


def labels(length: int, spans: list[Span]) -> np.ndarray:
    """0 outside, 1 + 2k at the start of a span of kind k, 2 + 2k inside it."""
    out = np.zeros(length, np.int64)
    for a, b, kind in spans:
        out[a:b] = 2 + 2 * KINDS.index(kind)
        out[a] -= 1
    return out


def written_examples(count: int, seed: int = 9) -> tuple[list[str], list[list[Span]]]:
    """Windows of made-up words around one item, personal or only alike."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, low, high: "".join(rng.choice(list(chars), rng.integers(low, high + 1)))
    lower, digit, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    letter = lower + lower.upper()
    names = ["token", "password", "secret", "key", "api_key", "auth", "bearer"]

    def card() -> str:
        first = pick(digit, 11, 18)
        return next(first + d for d in digit if luhn(first + d))

    def spaced(s: str) -> str:
        gap = str(rng.choice(["", "", " ", "-"]))
        return gap.join(s[i : i + 4] for i in range(0, len(s), 4))

    makers = [
        (3, "email", lambda: f"{pick(lower, 2, 8)}{rng.choice(['', '.', '_', '+'])}{pick(lower + digit, 1, 5)}@{pick(lower + digit, 2, 7)}.{rng.choice(['com', 'org', 'example.com', 'co.uk', 'net'])}"),
        (3, "ip", lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4))),
        (3, "card", lambda: spaced(card())),
        (3, "phone", lambda: f"+{rng.integers(1, 99)} ({pick(digit, 3, 3)}) {pick(digit, 3, 3)}-{pick(digit, 4, 4)}"),
        (1, "phone", lambda: f"+{rng.integers(1, 99)}{rng.choice([' ', '-', '.', ''])}{pick(digit, 3, 4)}{rng.choice([' ', '-', '.', ''])}{pick(digit, 5, 7)}"),
        (2, "phone", lambda: f"({pick(digit, 3, 3)}) {pick(digit, 3, 3)}-{pick(digit, 4, 4)}"),
        (1, "phone", lambda: rng.choice(["-", ".", " "]).join([pick(digit, 3, 3), pick(digit, 3, 3), pick(digit, 4, 4)])),
        (4, "secret", lambda: pick(hexa, 24, 48)),
        (1, "secret", lambda: pick(letter + digit, 20, 48)),
        (1, "secret", lambda: f"{rng.choice(['sk', 'pk', 'ghp', 'key', 'tok'])}{rng.choice(['-', '_'])}{pick(letter + digit, 16, 40)}"),
        (1, "secret", lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16)),
        (1, "", lambda: pick(lower, 14, 40)),
        (1, "", lambda: pick(digit, 13, 24)),
        (1, "", lambda: f"{rng.choice(['www.', ''])}{pick(lower, 4, 12)}.{rng.choice(['com', 'org', 'net'])}/{pick(lower, 2, 9)}-{pick(lower, 2, 9)}/{rng.integers(1, 999)}"),
        (1, "", lambda: f"{rng.integers(1, 20)}.{rng.integers(0, 20)}"),
        (1, "", lambda: f"{rng.integers(1990, 2031)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"),
        (1, "", lambda: str(rng.integers(0, 99999))),
        (1, "", lambda: f"{rng.integers(0, 24)}:{rng.integers(10, 60)}"),
        (1, "", lambda: f"{rng.integers(1, 9)}.{rng.integers(0, 30)}.{rng.integers(0, 30)}"),
        (1, "", lambda: f"{rng.integers(1, 999)},{pick(digit, 3, 3)},{pick(digit, 3, 3)}"),
    ]
    weight = np.array([m[0] for m in makers], float)
    texts, spans = [], []
    for _ in range(count):
        _, kind, make = makers[rng.choice(len(makers), p=weight / weight.sum())]
        item = str(make())[: WINDOW - 2]
        if kind == "secret" and not valid(item, (0, len(item), kind)):
            kind = ""
        quote = str(rng.choice(["", "", "", "\"", "'"])) if len(item) <= WINDOW - 4 else ""
        room = WINDOW - len(item) - 2 * len(quote)
        words = " ".join(pick(lower + "éüñ", 1, 9) + str(rng.choice(["", "", ".", ","])) for _ in range(24))
        before = int(rng.integers(0, room + 1))
        left = words[:before][: max(0, before - 1)] + (" " * min(1, before))
        right = quote + (" " + words[before:])[: room - len(left)]
        if kind in ("secret", "") and len(left) > 14 and rng.random() < 0.4:
            left = (left[:-12] + f" {rng.choice(names)}{rng.choice([' = ', '=', ': ', ' '])}").rjust(len(left))[-len(left) :]
        left += quote
        whole, a, b = (left + item + right).ljust(WINDOW), len(left), len(left) + len(item)
        if kind == "secret" and rng.random() < 0.4:  # cut by an edge of the window
            gone = int(rng.integers(1, len(item) - 9))
            whole, a, b = (whole[a + gone :].ljust(WINDOW), 0, len(item) - gone) if rng.random() < 0.5 else (whole[: b - gone].rjust(WINDOW), WINDOW - len(item) + gone, WINDOW)
        texts.append(whole)
        spans.append([(a, b, kind)] if kind else [])
    return texts, spans


def sample_windows(docs: DataFrame, doc_id: str, text: str) -> list[str]:
    """At most SAMPLE_WINDOWS windows around triggers from about SAMPLE_DOCS documents, taken by hash."""
    docs = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    picked = docs.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < int(share * (1 << 30))).where(F.col("t").rlike("[0-9@]"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t in zip(batch["i"], batch["t"]):
                hits = [m.start() for m in _TRIGGER.finditer(t)]
                for k, at in enumerate(hits[:: max(1, len(hits) // 3)][:3]):
                    start = max(0, at - (hash((int(i), k)) % WINDOW))
                    out.append((i, k, t[start : start + WINDOW].ljust(WINDOW)))
            yield pd.DataFrame(out, columns=["i", "k", "w"])

    found = picked.withColumn("i", F.xxhash64("i")).mapInPandas(windows, "i long, k int, w string")
    return [r["w"] for r in found.orderBy("i", "k", "w").limit(SAMPLE_WINDOWS).collect()]


def unsure(text: str) -> bool:
    """Whether a form that the rules don't know stands outside of their spans: such a window teaches nothing."""
    rules = rule_spans(text)
    if any(all(m.end() <= a or b <= m.start() for a, b, _ in rules) for m in _SECRETIVE.finditer(text)):
        return True
    return any(sum(c in "0123456789" for c in m[0]) >= 7 and all(m.end() <= a or b <= m.start() for a, b, _ in rules) for m in _NATIONAL.finditer(text))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", epochs: int = 9) -> BiLSTMCRF:
    """A tagger from the rules' spans in a bounded sample of docs and from written examples."""
    texts, spans = written_examples(WRITTEN_WINDOWS)
    sampled = [t for t in sample_windows(docs, doc_id, text) if not unsure(t)]
    x = np.stack([symbols(t) for t in texts + sampled], axis=1)
    y = np.stack([labels(WINDOW, s) for s in spans + [rule_spans(t) for t in sampled]], axis=1)
    net = BiLSTMCRF(SYMBOLS, 1 + 2 * len(KINDS))
    net.fit(x, y, epochs)
    return net


def needed(text: str) -> list[int]:
    """Numbers of the windows that hold a digit or an at sign."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    hits = {m.start() // STRIDE for m in _TRIGGER.finditer(text)}
    return sorted({k for h in hits for k in (h - 1, h) if 0 <= k <= last})


def reconcile(length: int, numbers: list[int], paths: np.ndarray) -> np.ndarray:
    """One label a character: that of the window in whose middle half it lies, or the text's first and last."""
    out = np.zeros(length, np.int64)
    last = max(0, -(-(length - WINDOW) // STRIDE))
    for k, path in zip(numbers, paths.T):
        a = 0 if k == 0 else k * STRIDE + STRIDE // 2
        b = length if k == last else k * STRIDE + STRIDE // 2 + STRIDE
        out[a:b] = path[a - k * STRIDE : b - k * STRIDE]
    return out


def tagged(text: str, path: np.ndarray) -> Iterator[Span]:
    """Spans of a label path, without white space and quotes at their ends."""
    kinds = np.where(path > 0, (path - 1) // 2, -1)
    edge = np.flatnonzero((np.diff(kinds, prepend=-2) != 0) | (path % 2 == 1))
    for a, b in zip(edge, [*edge[1:], len(path)]):
        if kinds[a] >= 0:
            part = text[a:b]
            b = a + len(part.rstrip(" .,;:\"'"))
            a += len(part) - len(part.lstrip(" \"'"))
            if a < b:
                yield int(a), int(b), KINDS[kinds[a]]


def valid(text: str, span: Span) -> bool:
    """Whether a tagger's span has a form of its kind and stands alone."""
    a, b, kind = span
    part = text[a:b]
    if (a and text[a - 1].isalnum()) or text[b : b + 1].isalnum():
        return False
    digits = sum(c in "0123456789" for c in part)
    if kind == "phone":
        return bool(_NATIONAL.fullmatch(part)) and 10 <= digits <= 15
    if kind == "secret":
        return bool(_SECRET.fullmatch(part)) and digits >= 2 and sum(c.isalpha() for c in part) >= 2
    return (0, b - a, kind) in rule_spans(part)


def added_spans(net: BiLSTMCRF, texts: list[str], rules: list[list[Span]]) -> list[list[Span]]:
    """The tagger's valid spans that no rule's span overlaps."""
    numbers = [needed(t) for t in texts]
    out: list[list[Span]] = [[] for _ in texts]
    todo = [i for i, n in enumerate(numbers) if n]
    while todo:
        part, size = [], 0
        while todo and size < 2048:
            part.append(todo.pop())
            size += len(numbers[part[-1]])
        coded = []
        for i in part:
            s = symbols(texts[i])
            s = np.concatenate([s, np.zeros(WINDOW, np.int64)])
            coded += [s[k * STRIDE : k * STRIDE + WINDOW] for k in numbers[i]]
        paths = np.concatenate([net.decode(np.stack(coded[a : a + 2048], axis=1)) for a in range(0, len(coded), 2048)], axis=1)
        at = 0
        for i in part:
            path = reconcile(len(texts[i]), numbers[i], paths[:, at : at + len(numbers[i])])
            at += len(numbers[i])
            out[i] = [s for s in tagged(texts[i], path) if valid(texts[i], s) and all(s[1] <= r[0] or r[1] <= s[0] for r in rules[i])]
    return out


def finder(net: BiLSTMCRF):
    """A column function from text to counts, digest, spans and their number that the tagger added."""
    shape = ", ".join([*[f"n_{k} long" for k in BASE], "base_sha256 string", "spans string", "n_added long", "clean string"])

    @F.pandas_udf(shape)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts = [t or "" for t in series]
            rules = [rule_spans(t) for t in texts]
            added = added_spans(net, texts, rules)
            spans = [ordered(r + a) for r, a in zip(rules, added)]
            yield pd.DataFrame(
                {
                    **{f"n_{k}": [sum(s[2] == k for s in r) for r in rules] for k in BASE},
                    "base_sha256": [hashlib.sha256(joined(r).encode()).hexdigest() for r in rules],
                    "spans": [joined(s) for s in spans],
                    "n_added": [len(a) for a in added],
                    "clean": [redacted(t, s) if s else None for t, s in zip(texts, spans)],
                }
            )
        give_back()

    return find


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or union of overlapping ones, replaced by the first one's kind."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_personal(docs: DataFrame, net: BiLSTMCRF, text: str = "text") -> DataFrame:
    """docs with n_email, n_ip, n_card and n_phone (the rules' spans), base_sha256, spans, n_added, and
    clean, the text with all spans replaced, or null where it has none."""
    names = {*[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_added", "clean"}
    kept = [c for c in docs.columns if c.lower() not in names]
    return docs.select(*kept, finder(net)(F.col(text)).alias("__found")).select(*kept, "__found.*")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document; n_* count the base spans, n_added the tagger's."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return find_personal(docs, train(docs)).select("doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_added")
