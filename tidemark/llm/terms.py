"""Words of whole texts as ranges of bytes in Arrow buffers, and their hashes, with numpy.

A word is a maximal run of ASCII letters, digits and bytes of other characters.
Texts are read in pieces of about PIECE bytes; a longer text is cut between
words, so what a piece needs in memory does not grow with its texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.shingles import LOWER, mix

PIECE = 1 << 20
#: Words longer than this are hashed one by one.
LONG = 48

WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


@dataclass
class Piece:
    """Consecutive texts, or a part of one. rows: each segment's row; at: its start in data."""

    data: np.ndarray
    rows: np.ndarray
    at: np.ndarray
    #: Whether the first segment goes on where the last one of the piece before ended.
    continues: bool


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its texts' offsets in them; null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def pieces(column: pa.Array, inside: np.ndarray = WORD, size: int | None = None) -> Iterator[Piece]:
    """The column's texts in order, in pieces; texts beyond the size are cut where no byte is inside a word."""
    size, (data, offsets) = size or PIECE, buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        low, high = int(offsets[row]), int(offsets[end])
        if high - low <= size:
            yield Piece(data[low:high], np.arange(row, end), offsets[row:end] - low, False)
        else:
            first = True
            while low < high:
                cut = min(high, low + size)
                while cut < high and inside[data[cut]]:
                    gap = np.flatnonzero(~inside[data[cut : cut + size]])
                    cut = cut + int(gap[0]) if len(gap) else min(high, cut + size)
                yield Piece(data[low:cut], np.array([row]), np.zeros(1, np.int64), not first)
                low, first = cut, False
        row = end


def runs(piece: Piece, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and segments of all maximal runs of bytes that are inside; none spans two texts."""
    word = inside[piece.data]
    edge = np.zeros(len(word) + 1, bool)
    edge[piece.at] = True
    edge[-1] = True
    before = edge[:-1].copy()
    before[1:] |= ~word[:-1]
    after = edge[1:].copy()
    after[:-1] |= ~word[1:]
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(piece.at, starts, side="right") - 1


def folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed, step: Callable, whole: Callable) -> np.ndarray:
    """A hash of each range: step folds one byte into those of all ranges that have it, whole hashes a long range."""
    size = np.minimum(ends - starts, LONG + 1).astype(np.uint8)
    order = np.argsort(LONG + 1 - size, kind="stable")
    at, size = starts[order], size[order]
    state = np.full(len(at), seed)
    many = int((size > LONG).sum())
    for k in range(int(size[many]) if many < len(size) else 0):
        left = np.searchsorted(-size.astype(np.int16), -k, side="left")
        state[many:left] = step(state[many:left], data[at[many:left] + k])
    for i in range(many):
        state[i] = whole(data[at[i] : ends[order[i]]].tobytes())
    out = np.empty_like(state)
    out[order] = state
    return out


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each range's unsigned CRC-32."""
    step = lambda c, b: _CRC[(c ^ b) & np.uint32(255)] ^ (c >> np.uint32(8))
    return ~folded(data, starts, ends, np.uint32(0xFFFFFFFF), step, lambda b: ~zlib.crc32(b) & 0xFFFFFFFF)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range."""
    step = lambda h, b: (h ^ b) * np.uint64(0x100000001B3)
    whole = lambda b: int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")
    return mix(folded(data, starts, ends, np.uint64(0xCBF29CE484222325), step, whole))


def lowered(piece: Piece) -> np.ndarray:
    """The piece's bytes with A-Z in lower case."""
    return LOWER[piece.data]
