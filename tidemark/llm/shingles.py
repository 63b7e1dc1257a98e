"""Word shingles of whole texts as 64-bit hashes, computed over byte buffers with numpy."""

from __future__ import annotations

import numpy as np

#: Bytes that part words: space, and tab to carriage return.
GAPS = np.zeros(256, bool)
GAPS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 to base^(n-1), wrapping."""
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


_TABLES = {"n": 0}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for as long a buffer as was seen."""
    if _TABLES["n"] < n:
        _TABLES.update(n=n, up=powers(_BASE, n), down=powers(_INVERSE, n))
    return _TABLES["up"], _TABLES["down"]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' buffer with a space behind each, and of all words in order: hashes, starts, ends, and words by text."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edges = np.flatnonzero(np.diff(GAPS[buffer], prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    up, down = _tables(len(buffer))
    total = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[buffer]] * up[: len(buffer)], out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    return buffer, words, starts, ends, np.bincount(owner, minlength=len(texts))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    _, words, _, _, count = words_of(texts)
    return words, count


def range_hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences [first, end), alike wherever they stand."""
    up, down = _tables(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, one after another, and their numbers.

    A text with fewer words than width has its whole sequence as one shingle,
    and one without words has none.
    """
    words, count = word_hashes(texts)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < width))
    found = np.maximum(count - width + 1, 0)
    at = np.repeat(first, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        value += words[at + k] * _PLACE[k]
    whole = [sum((int(w) * int(p) for w, p in zip(words[first[i] : first[i] + count[i]], _PLACE)), int(count[i])) % (1 << 64) for i in short]
    owner = np.concatenate([np.repeat(np.arange(len(texts)), found), short])
    value = mix(np.concatenate([value, np.array(whole, np.uint64)]))
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(texts))


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Wrapping sums of consecutive runs."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def signatures(values: np.ndarray, counts: np.ndarray, hashes: int, seed: int = 11) -> np.ndarray:
    """[hashes, sets] 32-bit minima under random linear maps; only sets that aren't empty may be given."""
    rng = np.random.default_rng(seed)
    by = rng.integers(1, 2**63, hashes, dtype=np.uint64) | np.uint64(1)
    plus = rng.integers(0, 2**63, hashes, dtype=np.uint64)
    out = np.empty((hashes, len(counts)), np.uint32)
    starts = np.cumsum(counts) - counts
    step = max(1, 1 << 15)
    cuts, now = [0], 0
    for i, c in enumerate(counts):  # sets are kept whole; a piece holds about 2^15 values
        now += c
        if now >= step:
            cuts.append(i + 1)
            now = 0
    if cuts[-1] != len(counts):
        cuts.append(len(counts))
    for a, b in zip(cuts, cuts[1:]):
        low = starts[a]
        part, at = values[low : starts[b - 1] + counts[b - 1]], starts[a:b] - low
        work = np.empty_like(part)
        for k in range(hashes):
            np.multiply(part, by[k], out=work)
            work += plus[k]
            high = work.view(np.uint32)[1::2]
            out[k, a:b] = np.minimum.reduceat(high, at)
    return out
