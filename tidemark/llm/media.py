"""Media columns: storing samples, and sniffing types by signature.

Sniffing runs an Aho-Corasick automaton of magic bytes over whole payloads, once.
A magic alone proves nothing, so a validator of its format confirms the header's
structure and the length that it states; only then does it count. The outermost
confirmed medium at the start corrects a declared type, and confirmed media
further inside are carved with their offsets and lengths.

The query stores a text's bytes, padded with zeros to a multiple of 64, as 8-bit
samples of a WAVE, a bitmap or a PNG image; which, the payload's checksum says. It
finds the medium again by sniffing, parses the stored bytes and computes
everything from what it reads back.

Paths of chunks, blocks, pages and boxes are remembered by place, so many headers
on one path cost no more than one: time grows in proportion for every format that
a text can hold. Binary data can still make PNG's checksums and gzip's streams,
whose magic bytes no text has, overlap and be read once for each header.

Defined results: a null text or payload is an empty one; an empty payload has no
type; repeated rows repeat; columns named like the results are replaced and all
others pass through.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
import types
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import read

BLOCK = 64
#: The formats' magic bytes, where in a file they stand, and type names.
MAGIC = {
    "wav": (b"RIFF", 0),
    "bmp": (b"BM", 0),
    "png": (b"\x89PNG\r\n\x1a\n", 0),
    "gif": (b"GIF8", 0),
    "jpeg": (b"\xff\xd8\xff", 0),
    "flac": (b"fLaC", 0),
    "ogg": (b"OggS", 0),
    "gzip": (b"\x1f\x8b\x08", 0),
    "zip": (b"PK\x03\x04", 0),
    "mp4": (b"ftyp", 4),
    "pdf": (b"%PDF-", 0),
}


def padded(payload: bytes) -> bytes:
    """Zeros behind it, up to a positive multiple of BLOCK."""
    return payload.ljust(max(BLOCK, -(-len(payload) // BLOCK) * BLOCK), b"\0")


def as_wav(samples: bytes) -> bytes:
    """One channel of 8-bit samples at 8 kHz."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
    body = b"WAVE" + form + struct.pack("<4sI", b"data", len(samples)) + samples
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def as_bmp(samples: bytes) -> bytes:
    """An 8-bit image of BLOCK columns, lowest row first, with a grey palette."""
    rows = len(samples) // BLOCK
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256))
    head = struct.pack("<2sIHHI", b"BM", 14 + 40 + 1024 + len(samples), 0, 0, 14 + 40 + 1024)
    info = struct.pack("<IiiHHIIiiII", 40, BLOCK, rows, 1, 8, 0, len(samples), 2835, 2835, 256, 0)
    return head + info + palette + samples


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def as_png(samples: bytes) -> bytes:
    """An 8-bit grey image of BLOCK columns, rows unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, BLOCK)
    lines = np.zeros((len(rows), BLOCK + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", BLOCK, len(rows), 8, 0, 0, 0, 0)
    return MAGIC["png"][0] + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


STORES = (as_wav, as_bmp, as_png)


class _Chain:
    """Places of a buffer, each with the one after it. However many paths lead over a place, it is looked at once.

    step(place) gives the next place, or None where the path ends, and a kind;
    of every place the end of its path is known, and for each of the sought
    kinds the first place that has it. A jump goes far ahead on the path, so
    that the first place beyond a given one is found in a logarithm's steps.
    """

    def __init__(self, step: Callable[[int], tuple[int | None, bytes]], sought: tuple[bytes, ...]):
        self.step, self.sought, self.known = step, sought, {}

    def of(self, place: int) -> tuple[int, int, int, int, tuple[int | None, ...]]:
        """next, jump, steps to the end, end, and the first places of the sought kinds."""
        new = []
        while place not in self.known:
            after, kind = self.step(place)
            new.append((place, after, kind))
            if after is None:
                break
            place = after
        for here, after, kind in reversed(new):
            if after is None:
                self.known[here] = (here, here, 0, here, tuple(here if kind == x else None for x in self.sought))
                continue
            _, jump, steps, end, first = self.known[after]
            _, beyond, from_jump, _, _ = self.known[jump]
            far = beyond if steps - from_jump == from_jump - self.known[beyond][2] else after
            self.known[here] = (after, far, steps + 1, end, tuple(here if kind == x else f for x, f in zip(self.sought, first)))
        return self.known[new[0][0] if new else place]

    def beyond(self, place: int, bound: int) -> int:
        """The first place on the path beyond the bound, or its end."""
        while place <= bound:
            after, jump, _, end, _ = self.of(place)
            if place == end:
                break
            place = jump if jump <= bound else after
        return place


@lru_cache(maxsize=4)
def _riff_chain(b: bytes, odd: int) -> _Chain:
    """Chunks that begin at places as odd or even as their file."""

    def step(place: int):
        if place + 8 > len(b):
            return None, b""
        after = place + 8 + int.from_bytes(b[place + 4 : place + 8], "little")
        return after + (after % 2 ^ odd), b[place : place + 4]

    return _Chain(step, (b"fmt ", b"data"))


def _wav_length(b: bytes, at: int) -> int | None:
    if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    total = 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if at + total > len(b):
        return None
    chain, last = _riff_chain(b, at % 2), at + total - 8
    if last < at + 12 or any(x is None or x > last for x in chain.of(at + 12)[4]):
        return None
    return total if abs(chain.beyond(at + 12, last) - at - total) <= 1 else None


def _bmp_length(b: bytes, at: int) -> int | None:
    if len(b) - at < 54:
        return None
    total, _, _, start, info, width, height, planes, bits = struct.unpack_from("<IHHIIiiHH", b, at + 2)
    good = info in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 0 < width < 1 << 20 and height
    good = good and 54 <= start <= total and at + total <= len(b) and start + (width * bits + 31) // 32 * 4 * abs(height) <= total
    return total if good else None


@lru_cache(maxsize=2)
def _png_chain(b: bytes) -> _Chain:
    def step(place: int):
        end = place + 12 + int.from_bytes(b[place : place + 4], "big")
        if place + 12 > len(b) or end > len(b) or zlib.crc32(b[place + 4 : end - 4]) != int.from_bytes(b[end - 4 : end], "big"):
            return None, b""
        kind = b[place + 4 : place + 8]
        return (None if kind == b"IEND" else end), kind

    return _Chain(step, (b"IEND",))


def _png_length(b: bytes, at: int) -> int | None:
    if b[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return None
    end = _png_chain(b).of(at + 8)[4][0]
    return None if end is None else end + 12 + int.from_bytes(b[end : end + 4], "big") - at


@lru_cache(maxsize=2)
def _gif_chain(b: bytes) -> _Chain:
    """Twice a place where a block begins, and one more where a part of its data does."""

    def step(twice: int):
        place = twice // 2
        if place >= len(b):
            return None, b""
        lead = b[place]
        if twice % 2:
            return 2 * (place + 1 + lead) + (lead > 0), b""
        if lead == 0x2C and place + 10 < len(b):
            return 2 * (place + 10 + (3 << (b[place + 9] & 7) + 1 if b[place + 9] & 128 else 0) + 1) + 1, b""
        if lead == 0x21:
            return 2 * (place + 2) + 1, b""
        return None, b"\x3b" if lead == 0x3B else b""

    return _Chain(step, (b"\x3b",))


def _gif_length(b: bytes, at: int) -> int | None:
    if len(b) - at < 14 or b[at + 4 : at + 6] not in (b"7a", b"9a"):
        return None
    first = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0)
    end = _gif_chain(b).of(2 * first)[4][0]
    return None if end is None else end // 2 + 1 - at


@lru_cache(maxsize=2)
def _jpeg_chain(b: bytes) -> _Chain:
    marks = [m.start() for m in re.finditer(rb"\xff(?=[^\0\xd0-\xd7])", b, re.S)]

    def step(place: int):
        if place + 2 > len(b) or b[place] != 0xFF:
            return None, b""
        kind = b[place + 1]
        if kind == 0xD9:
            return None, b"\xd9"
        after = place + 2 + int.from_bytes(b[place + 2 : place + 4], "big")
        if kind == 0xDA:
            k = bisect_left(marks, after)
            return (marks[k] if k < len(marks) else None), b""
        return after, b""

    return _Chain(step, (b"\xd9",))


def _jpeg_length(b: bytes, at: int) -> int | None:
    end = _jpeg_chain(b).of(at + 2)[4][0]
    return None if end is None else end + 2 - at


def _flac_length(b: bytes, at: int) -> int | None:
    good = len(b) - at >= 42 and b[at + 4] & 127 == 0 and int.from_bytes(b[at + 5 : at + 8], "big") == 34
    return len(b) - at if good else None


@lru_cache(maxsize=2)
def _ogg_chain(b: bytes) -> _Chain:
    """Pages; a path with one that is cut off has the kind of that."""

    def step(place: int):
        if place + 27 > len(b) or b[place : place + 5] != b"OggS\0":
            return None, b""
        n = b[place + 26]
        end = place + 27 + n + sum(b[place + 27 : place + 27 + n])
        return (end, b"") if end <= len(b) else (None, b"cut")

    return _Chain(step, (b"cut",))


def _ogg_length(b: bytes, at: int) -> int | None:
    _, _, _, end, (cut,) = _ogg_chain(b).of(at)
    return None if cut is not None else end - at or None


def _gzip_length(b: bytes, at: int) -> int | None:
    if len(b) - at < 18 or b[at + 3] & 0xE0:
        return None
    inflate = zlib.decompressobj(31)
    try:
        for i in range(at, len(b), 1 << 16):
            inflate.decompress(b[i : i + (1 << 16)])
            if inflate.eof:
                return min(i + (1 << 16), len(b)) - len(inflate.unused_data) - at
    except zlib.error:
        pass
    return None


@lru_cache(maxsize=4)
def _places(b: bytes, mark: bytes) -> list[int]:
    """Where a mark stands in the data, found once for all the magics that ask for it."""
    return [m.start() for m in re.finditer(re.escape(mark), b)]


@lru_cache(maxsize=2)
def _zip_ends(b: bytes) -> dict[int, int]:
    """The end of each archive by its start, as the closing records say."""
    ends: dict[int, int] = {}
    for end in _places(b, b"PK\x05\x06"):
        if end + 22 <= len(b):
            size, start, note = struct.unpack_from("<IIH", b, end + 12)
            at = end - start - size
            if at >= 0 and b[at + start : at + start + 4] == b"PK\x01\x02" and end + 22 + note <= len(b):
                ends.setdefault(at, end + 22 + note)
    return ends


def _zip_length(b: bytes, at: int) -> int | None:
    return _zip_ends(b)[at] - at if at in _zip_ends(b) else None


@lru_cache(maxsize=2)
def _mp4_chain(b: bytes) -> _Chain:
    def step(place: int):
        size, kind = int.from_bytes(b[place : place + 4], "big"), b[place + 4 : place + 8]
        if place + 8 > len(b) or size < 8 or place + size > len(b) or not kind.isalnum():
            return None, b""
        return place + size, kind

    return _Chain(step, (b"moov",))


def _mp4_length(b: bytes, at: int) -> int | None:
    _, _, _, end, (moov,) = _mp4_chain(b).of(at)
    return None if moov is None else end - at


def _pdf_length(b: bytes, at: int) -> int | None:
    if not b[at + 5 : at + 6].isdigit():
        return None
    ends, links = _places(b, b"%%EOF"), _places(b, b"startxref")
    k, j = bisect_left(ends, at), bisect_left(links, at)
    return ends[k] + 5 - at if k < len(ends) and j < len(links) and links[j] + 9 <= ends[k] else None


LENGTHS = {
    "wav": _wav_length, "bmp": _bmp_length, "png": _png_length, "gif": _gif_length, "jpeg": _jpeg_length, "flac": _flac_length,
    "ogg": _ogg_length, "gzip": _gzip_length, "zip": _zip_length, "mp4": _mp4_length, "pdf": _pdf_length,
}


def _automaton():
    """The worker's automaton over all magic bytes; a byte is the character of its number."""
    if "_tidemark_magic" not in sys.modules:
        import ahocorasick

        held = types.ModuleType("_tidemark_magic")
        held.found = ahocorasick.Automaton()
        for kind, (magic, lead) in MAGIC.items():
            held.found.add_word(magic.decode("latin-1"), (kind, lead + len(magic) - 1))
        held.found.make_automaton()
        sys.modules["_tidemark_magic"] = held
    return sys.modules["_tidemark_magic"].found


def sniffed(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the confirmed media in data, by offset; ones inside another come after it."""
    out, tried = [], set()
    for end, (kind, lead) in _automaton().iter(data.decode("latin-1")):
        at = end - lead
        if at >= 0 and (kind, at) not in tried:
            tried.add((kind, at))
            length = LENGTHS[kind](data, at)
            if length:
                out.append((kind, at, length))
    return sorted(out, key=lambda m: (m[1], -m[2], m[0]))


def samples_of(kind: str, data: bytes) -> bytes:
    """The 8-bit samples of a stored medium, from its own header."""
    if kind == "wav":
        return data[44 : 44 + int.from_bytes(data[40:44], "little")]
    if kind == "bmp":
        start, width, height = (int.from_bytes(data[i : i + 4], "little") for i in (10, 18, 22))
        return data[start : start + width * height]
    place, packed = 8, []
    while place < len(data):
        size = int.from_bytes(data[place : place + 4], "big")
        if data[place + 4 : place + 8] == b"IDAT":
            packed.append(data[place + 8 : place + 8 + size])
        place += 12 + size
    width = int.from_bytes(data[16:20], "big")
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def sniff(files: DataFrame, data: str, declared: str) -> DataFrame:
    """files with type (corrected), corrected (whether the declared one was wrong) and carved, all further media."""

    def look(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for blobs, names in batches:
            out = []
            for blob, name in zip(blobs, names):
                found = sniffed(bytes(blob or b""))
                own = found[0][0] if found and found[0][1] == 0 else None
                inside = found[1:] if own else found
                out.append((own, own is not None and own != name, [{"type": k, "offset": a, "length": n} for k, a, n in inside]))
            yield pd.DataFrame(out, columns=["type", "corrected", "carved"])

    look = F.pandas_udf(look, "type string, corrected boolean, carved array<struct<type: string, offset: long, length: long>>")
    kept = [c for c in files.columns if c.lower() not in ("type", "corrected", "carved")]
    return files.select(*kept, look(F.col(data), F.col(declared)).alias("__seen")).select(*kept, "__seen.*")


def stored(payload: bytes) -> bytes:
    """A padded payload as a medium that its checksum chooses."""
    return STORES[zlib.crc32(payload) % len(STORES)](payload)


def described(text: str | None) -> tuple:
    """Everything that the query returns of one text, from its stored medium as read back."""
    data = (text or "").encode()
    medium = stored(padded(data))
    found = sniffed(medium)
    kind, _, length = found[0]
    back = samples_of(kind, medium[:length])
    levels = np.frombuffer(back, np.uint8)
    moved = int(np.abs(np.diff(levels.astype(np.int16))).sum())
    feature = f"{kind} {len(back)} samples, mean {levels.mean():.3f}, deviation {levels.std():.3f}, variation {moved}, inside {len(found) - 1}"
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(medium), hashlib.sha256(medium).hexdigest(), feature, kind, back[: len(data)] == data


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a medium, found by its signature and read back."""

    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(
                [described(t) for t in texts],
                columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "lossless"],
            )

    shape = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, lossless boolean"
    describe = F.pandas_udf(describe, shape)
    return read(spark, sf_dir, "documents").select("doc_id", describe(F.col("text")).alias("m")).select("doc_id", "m.*")
