import gzip
import hashlib
import io
import random
import wave
import zipfile
import zlib

from tidemark.llm import media


def payloads():
    rng = random.Random(1)
    return [b"", b"a", "é BM RIFF GIF89a \x89PNG".encode() * 9, bytes(rng.randrange(256) for _ in range(3000)), b"x" * 64, b"y" * 65]


def test_round_trips_through_every_store():
    for data in payloads():
        full = media.padded(data)
        assert len(full) % 64 == 0 and len(full) >= 64 and full.startswith(data)
        for store, kind in zip(media.STORES, ("wav", "bmp", "png")):
            blob = store(full)
            assert media.sniffed(blob)[0] == (kind, 0, len(blob))
            assert media.samples_of(kind, blob) == full


def test_stored_form_opens_elsewhere():
    with wave.open(io.BytesIO(media.as_wav(b"\1" * 64))) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(64)) == (1, 1, b"\1" * 64)


def other_media():
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.txt", "hello")
    return {
        "gzip": gzip.compress(b"hello" * 40),
        "zip": packed.getvalue(),
        "gif": b"GIF89a" + b"\1\0\1\0\0\0\0" + b"\x2c" + b"\0" * 8 + b"\0" + b"\2" + b"\2\x44\1" + b"\0" + b"\x3b",
        "jpeg": b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04cd\x11\xff\0\x22\xff\xd9",
        "ogg": b"OggS\0" + b"\0" * 21 + b"\1" + b"\3" + b"abc",
        "mp4": b"\0\0\0\x0cftypisom" + b"\0\0\0\x08moov",
        "pdf": b"%PDF-1.4\n...startxref\n9\n%%EOF",
    }


def test_carves_and_rejects():
    for kind, blob in other_media().items():
        assert (kind, 0, len(blob)) in media.sniffed(blob), kind
        inside = b"some text " + blob + b" more text"
        assert (kind, 10, len(blob)) in media.sniffed(inside), kind
        assert not any(k == kind for k, _, _ in media.sniffed(blob[:-1])), kind
    assert media.sniffed(b"BM is no bitmap, RIFF no sound, PK\x03\x04 no archive, %PDF-1 nothing") == []
    image = media.as_png(b"z" * 64)
    assert media.sniffed(image[:40] + b"!" + image[41:]) == []


def test_declared_types(spark):
    blob = media.as_wav(media.as_png(b"q" * 128).ljust(256, b"\0"))
    rows = [(1, blob, "png", 5), (2, blob, "wav", 5), (3, None, "wav", 5), (4, b"", None, 5), (5, b"plain", "bmp", 5)]
    out = {r["id"]: r for r in media.sniff(spark.createDataFrame(rows, "id long, data binary, declared string, type int"), "data", "declared").collect()}
    assert (out[1]["type"], out[1]["corrected"], out[2]["corrected"]) == ("wav", True, False)
    assert [c["type"] for c in out[1]["carved"]] == ["png"] and out[1]["carved"][0]["offset"] == 44
    assert all(out[i]["type"] is None and not out[i]["corrected"] and out[i]["carved"] == [] for i in (3, 4, 5))


def test_descriptions():
    for text in [None, "", "abc", "é" * 100, "x" * 100_000]:
        data = (text or "").encode()
        n, size, digest, tail, stored, _, _, _, lossless = media.described(text)
        full = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (n, size, digest, tail) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert lossless and stored > 0
    assert media.described("same") == media.described("same")


def test_hostile_texts_take_linear_time():
    riff = lambda k: b"RIFF" + (1_000_000 - 12 * k - 20).to_bytes(4, "little") + b"WAVE"
    parts = [b"%PDF-1 x", b"PK\x03\x04PK\x05\x06" + bytes(18), b"%PDF-1 startxref ", b"\0\0\0\x08ftyp", b"GIF89a\0\0\0\0\0\0\0!\xf9\0", b"BM", b"\xff\xd8\xff\xda\0\2"]
    for part in parts:
        assert media.sniffed(part * (1_000_000 // len(part))) == []
    assert media.sniffed(b"".join(riff(k) for k in range(40_000)) + b"fmt \0\0\0\0" * 80_000) == []
    pages = media.sniffed((b"OggS\0" + bytes(22)) * 30_000)
    assert len(pages) == 30_000 and pages[0] == ("ogg", 0, 27 * 30_000)


def test_paths_are_those_of_a_plain_walk():
    """Files within files and behind one another, whose paths run together."""
    rng = random.Random(3)
    parts = [b"RIFF", b"WAVE", b"fmt ", b"data", b"\4\0\0\0", b"\x3c\0\0\0", b"\0", b"a", media.as_wav(b"x" * 64), b"RIFF\x34\0\0\0WAVEfmt \4\0\0\0abcd", b"data\x14\0\0\0" + bytes(20)]

    def walked(b, at):
        total = 8 + int.from_bytes(b[at + 4 : at + 8], "little")
        if len(b) - at < 44 or b[at + 8 : at + 12] != b"WAVE" or at + total > len(b):
            return None
        place, seen = at + 12, set()
        while place + 8 <= at + total:
            seen.add(b[place : place + 4])
            place += 8 + int.from_bytes(b[place + 4 : place + 8], "little")
            place += place % 2 ^ at % 2
        return total if {b"fmt ", b"data"} <= seen and abs(place - at - total) <= 1 else None

    for _ in range(4000):
        data = b"".join(rng.choices(parts, k=rng.randint(0, 30)))
        want = [(at, walked(data, at)) for at in range(len(data)) if data.startswith(b"RIFF", at) and walked(data, at)]
        assert [(at, n) for kind, at, n in media.sniffed(data) if kind == "wav"] == want
