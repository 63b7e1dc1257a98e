"""A battery of randomness tests for tokens, each under the encoding that its characters suggest.

For a token of n symbols of an alphabet of A:

- uniformity: chi-squared of the symbols' counts, with A - 1 degrees of freedom;
- runs: how often the class of character changes between neighbours, against its
  mean and deviation for independent symbols;
- serial correlation of neighbouring symbols' values.

Fisher's sum of the three, -2 ln(p1 p2 p3), is small for random tokens and grows
with the length of written ones. How it is distributed for those is learned from
decoys: words put together as identifiers, paths, constants and encoded text, by
encoding and band of length, in logarithms. So a token has two p-values: that of
being random, and that of looking as random if it were written.
"""

from __future__ import annotations

import math

import numpy as np

#: Lengths of tokens: the least, the ends of the bands, and the most; longer runs are data, not secrets.
BANDS = (16, 20, 24, 32, 48, 80, 513)
SHORTEST, LONGEST = BANDS[0], BANDS[-1] - 1
#: Encodings with the shares of their classes of characters.
ENCODINGS = {
    "alpha": (26, (5 / 26, 21 / 26)),  # vowels and others
    "hex": (16, (10 / 16, 6 / 16)),
    "base32": (32, (6 / 32, 26 / 32)),
    "base36": (36, (10 / 36, 26 / 36)),
    "base62": (62, (10 / 62, 26 / 62, 26 / 62)),
    "base64": (64, (10 / 64, 26 / 64, 26 / 64, 2 / 64)),
}
NAMES = tuple(ENCODINGS)
STRATA = len(ENCODINGS) * (len(BANDS) - 1)
DECOYS = 300

_DIGIT, _LOWER, _UPPER, _OTHER = range(4)
_CLASS = np.full(256, _OTHER)
_CLASS[0x30:0x3A], _CLASS[0x61:0x7B], _CLASS[0x41:0x5B] = _DIGIT, _LOWER, _UPPER
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouAEIOU")] = True
_FOLDED = np.arange(256)
_FOLDED[0x41:0x5B] += 32


def _values() -> np.ndarray:
    """[encoding, byte] a byte's value there."""
    out = np.zeros((len(NAMES), 256), np.int64)
    byte = np.arange(256)
    letter, digit = _FOLDED - 0x61, byte - 0x30
    is_digit, is_upper = _CLASS == _DIGIT, _CLASS == _UPPER
    out[0] = letter
    out[1] = np.where(is_digit, digit, 10 + letter)
    out[2] = np.where(is_digit, 26 + digit - 2, letter)
    out[3] = np.where(is_digit, digit, 10 + letter)
    out[4] = np.where(is_digit, digit, np.where(is_upper, 10 + letter, 36 + letter))
    out[5] = out[4]
    out[5][list(b"+-")], out[5][list(b"/_")] = 62, 63
    return out


_VALUE = _values()


def encodings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each token's encoding as a number, -1 for digits alone: the smallest alphabet that has its characters."""
    out = []
    for a, b in zip(starts, ends):
        part = data[a:b]
        kinds = set(_CLASS[part].tolist())
        if _OTHER in kinds:
            out.append(5 if kinds != {_DIGIT, _OTHER} else -1)
        elif {_LOWER, _UPPER} <= kinds:
            out.append(4)
        elif kinds == {_DIGIT}:
            out.append(-1)
        elif _DIGIT not in kinds:
            out.append(0)
        elif _FOLDED[part].max() <= ord("f"):
            out.append(1)
        else:
            digits = part[_CLASS[part] == _DIGIT]
            out.append(2 if _UPPER in kinds and digits.min() >= ord("2") and digits.max() <= ord("7") else 3)
    return np.array(out, np.int64)


def _upper(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal."""
    return np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in z.tolist()])


def battery(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encoding: np.ndarray) -> np.ndarray:
    """Fisher's sum of the three tests for every token."""
    n = ends - starts
    owner = np.repeat(np.arange(len(n)), n)
    byte = data[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())]
    value = _VALUE[encoding[owner], byte]
    size = np.array([ENCODINGS[e][0] for e in NAMES])[encoding]

    counts = np.bincount(owner * 64 + value, minlength=64 * len(n)).reshape(-1, 64)
    chi, free = size / n * (counts**2).sum(axis=1) - n, size - 1.0
    uniform = _upper((np.cbrt(np.maximum(chi, 0) / free) - (1 - 2 / (9 * free))) / np.sqrt(2 / (9 * free)))

    kind = np.where(encoding[owner] == 0, _VOWEL[byte], _CLASS[byte])
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    changes = np.bincount(owner[pair], weights=kind[pair] != kind[pair + 1], minlength=len(n))
    share = np.array([sum(p * (1 - p) for p in ENCODINGS[e][1]) for e in NAMES])[encoding]
    both = np.array([sum(p * (1 - p) ** 2 for p in ENCODINGS[e][1]) for e in NAMES])[encoding]
    spread = np.sqrt(np.maximum((n - 1) * share * (1 - share) + 2 * (n - 2) * (both - share**2), 1e-9))
    runs = 2 * _upper(np.abs(changes - (n - 1) * share) / spread)

    off = value - (size[owner] - 1) / 2
    lag = np.bincount(owner[pair], weights=off[pair] * off[pair + 1], minlength=len(n))
    serial = 2 * _upper(np.abs(lag / ((size**2 - 1) / 12)) / np.sqrt(n - 1))
    return -2 * sum(np.log(np.clip(p, 1e-300, 1)) for p in (uniform, runs, serial))


def p_random(fisher: np.ndarray) -> np.ndarray:
    """The chance of such a sum or a larger one for a random token: chi-squared with six degrees."""
    half = fisher / 2
    return np.exp(-half) * (1 + half + half**2 / 2)


def band(length: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(BANDS[1:]), length, side="right")


def stratum(encoding: np.ndarray, length: np.ndarray) -> np.ndarray:
    return encoding * (len(BANDS) - 1) + band(length)


def written_words(count: int, seed: int = 12) -> list[str]:
    """Pronounceable words of two to four syllables."""
    rng = np.random.default_rng(seed)
    heads, cores, tails = "b c d f g h l m n p r s t v w st tr pl ch".split(), "a e i o u ea ie ou".split(), ["", "", "n", "r", "s", "t", "l", "ng", "ck"]
    return ["".join(str(rng.choice(x)) for _ in range(rng.integers(2, 5)) for x in (heads, cores, tails)) for _ in range(count)]


def decoy(encoding: str, length: int, words: list[str], rng: np.random.Generator) -> str:
    """Something written that has the encoding's characters."""
    pick = lambda: words[rng.integers(len(words))].lower()
    number = lambda top=9999: str(rng.integers(0, top))
    out = ""
    case = str.upper if rng.random() < 0.3 else str.lower
    way = rng.random()
    while len(out) < length:
        if encoding == "alpha":
            out += case(pick())
        elif encoding == "hex":
            out += pick().encode().hex() if way < 0.6 else number() + "abcdef"[: rng.integers(0, 3)]
        elif encoding == "base32":
            out += pick().upper() + "".join(rng.choice(list("234567"), rng.integers(0, 3)))
        elif encoding == "base36":
            out += case(pick()) + (number(int(rng.choice([10, 100, 2030]))) if rng.random() < 0.6 else "")
        elif encoding == "base62":
            out += pick().capitalize() + (number(100) if rng.random() < 0.2 else "")
        else:
            out += (pick().capitalize() if way < 0.3 else case(pick())) + str(rng.choice(list("-_/+"), p=[0.4, 0.3, 0.25, 0.05])) + (number() if rng.random() < 0.15 else "")
    return out[:length]


def null_of_writing(words: list[str], seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the logarithm of Fisher's sum of decoys, by stratum."""
    rng = np.random.default_rng(seed)
    tokens, at = [], []
    for e, name in enumerate(NAMES):
        for b, (low, high) in enumerate(zip(BANDS, BANDS[1:])):
            for _ in range(DECOYS):
                tokens.append(decoy(name, int(rng.integers(low, min(high, 161))), words, rng).encode())
                at.append((e, e * (len(BANDS) - 1) + b))
    encoding, place = np.array(at).T
    ends = np.cumsum([len(t) for t in tokens])
    log = np.log(battery(np.frombuffer(b"".join(tokens), np.uint8), ends - [len(t) for t in tokens], ends, encoding))
    mean, spread = np.zeros(STRATA), np.zeros(STRATA)
    for s in range(STRATA):
        mean[s], spread[s] = log[place == s].mean(), max(0.15, log[place == s].std())
    return mean, spread


def p_written(fisher: np.ndarray, place: np.ndarray, null: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The chance of such a sum or a smaller one for written tokens of the stratum."""
    mean, spread = null
    return _upper((mean[place] - np.log(np.maximum(fisher, 1e-9))) / spread[place])
