"""Media columns with signature sniffing.

An Aho-Corasick automaton over the magic bytes of all known formats finds candidate offsets in one pass; the
format's validator then walks its structure (chunk checks, segment, block and box lengths) and gives the true
length, or rejects the candidate. What validates at offset 0 corrects the declared type; what validates further
in is carved out as embedded media, outermost first.

Cases: null bytes count as empty: no media, sniffed type null; a truncated or overlong structure isn't reported;
media inside reported media are not searched; equal bytes, and repeated rows, give equal results; bytes of any length
are searched whole; an empty table gives an empty result; an existing column named like the output is replaced, others
pass through whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import table, text_udf

UNIT = 576
RATE = 8000


def _png(b: bytes, at: int) -> int:
    i, first = at + 8, True
    while i + 12 <= len(b):
        n, kind = int.from_bytes(b[i : i + 4], "big"), b[i + 4 : i + 8]
        if i + 12 + n > len(b) or (first and (kind != b"IHDR" or n != 13)):
            return 0
        if zlib.crc32(b[i + 4 : i + 8 + n]) != int.from_bytes(b[i + 8 + n : i + 12 + n], "big"):
            return 0
        i, first = i + 12 + n, False
        if kind == b"IEND":
            return i - at
    return 0


def _jpeg(b: bytes, at: int) -> int:
    i, frame = at + 2, False
    while i + 4 <= len(b) and b[i] == 0xFF:
        m = b[i + 1]
        if m == 0xD9:
            return i + 2 - at if frame else 0
        if m == 0xFF:
            i += 1
            continue
        n = int.from_bytes(b[i + 2 : i + 4], "big")
        if n < 2 or m in (0x00, 0x01) or 0xD0 <= m <= 0xD8:
            return 0
        frame |= 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC)
        i += 2 + n
        if m == 0xDA:  # entropy-coded data up to the next marker
            while True:
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return 0
                if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7:
                    i += 2
                else:
                    break
    return i + 2 - at if frame and b[i : i + 2] == b"\xff\xd9" else 0


def _gif(b: bytes, at: int) -> int:
    if at + 13 > len(b):
        return 0
    flags = b[at + 10]
    i = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    seen = False

    def blocks(i: int) -> int:
        while i < len(b):
            n = b[i]
            i += 1 + n
            if n == 0:
                return i
        return -1

    while 0 <= i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at if seen else 0
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 < len(b):
            f = b[i + 9]
            i = blocks(i + 10 + (3 << ((f & 7) + 1) if f & 0x80 else 0) + 1)
            seen = True
        else:
            return 0
    return 0


def _riff(form: bytes):
    def check(b: bytes, at: int) -> int:
        if at + 12 > len(b) or b[at + 8 : at + 12] != form:
            return 0
        end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
        i, kinds = at + 12, []
        while i + 8 <= end <= len(b):
            n = int.from_bytes(b[i + 4 : i + 8], "little")
            kinds.append(b[i : i + 4])
            i += 8 + n + n % 2
        need = {b"WAVE": {b"fmt ", b"data"}, b"AVI ": {b"LIST"}, b"WEBP": set()}[form]
        return end - at if i == end and kinds and need <= set(kinds) else 0

    return check


def _bmp(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    width, height = struct.unpack_from("<ii", b, at + 18)
    if zero or header not in (40, 52, 56, 64, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32):
        return 0
    plain = struct.unpack_from("<I", b, at + 30)[0] in (0, 3) if at + 34 <= len(b) else False
    rows = abs(height) * ((width * bits + 31) // 32 * 4)
    return size if width > 0 and offset >= 14 + header and at + size <= len(b) and (not plain or offset + rows <= size) and offset <= size else 0


@cache
def _crc_table(bits: int, poly: int) -> tuple[int, ...]:
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for x in range(256):
        r = x << (bits - 8)
        for _ in range(8):
            r = (r << 1) ^ poly if r & top else r << 1
        out.append(r & mask)
    return tuple(out)


def _flac_header(b: bytes, i: int) -> tuple[int, int]:
    """(bytes, samples) of the frame header at i, (0, 0) if there is none: its own check must fit."""
    if i + 6 > len(b) or b[i] != 0xFF or b[i + 1] & 0xFE != 0xF8 or b[i + 3] & 1 or b[i + 3] >> 4 > 10:
        return 0, 0
    size, rate, lead = b[i + 2] >> 4, b[i + 2] & 15, b[i + 4]
    more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    at = i + 5 + more
    wide, tail = {6: 1, 7: 2}.get(size, 0), {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if size == 0 or rate == 15 or at + wide + tail >= len(b):
        return 0, 0
    samples = int.from_bytes(b[at : at + wide], "big") + 1 if wide else 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    at += wide + tail
    crc, r = _crc_table(8, 0x07), 0
    for x in b[i:at]:
        r = crc[r ^ x]
    return (at + 1 - i, samples) if r == b[at] else (0, 0)


def _flac(b: bytes, at: int) -> int:
    """Frames carry no lengths: one ends where its check fits and a frame follows, or all samples are there."""
    i, last, total = at + 4, False, None
    while not last:
        if i + 4 > len(b):
            return 0
        last, kind, n = bool(b[i] & 0x80), b[i] & 0x7F, int.from_bytes(b[i + 1 : i + 4], "big")
        if kind == 127 or (total is None and (kind, n) != (0, 34)) or i + 4 + n > len(b):
            return 0
        if total is None:
            total = int.from_bytes(b[i + 17 : i + 22], "big") & 0xFFFFFFFFF
        i += 4 + n
    crc, done, known = _crc_table(16, 0x8005), 0, total or 0
    while not known or done < known:
        head, samples = _flac_header(b, i)
        if not head:
            break
        r, end = 0, 0
        for k in range(i, len(b)):
            r = ((r << 8) & 0xFFFF) ^ crc[(r >> 8) ^ b[k]]
            if r == 0 and k > i + head and (not known or done + samples >= known or k + 1 == len(b) or _flac_header(b, k + 1)[0]):
                end = k + 1
                break
        if not end:
            break
        i, done = end, done + samples
    return i - at if done >= known else 0


def _ogg(b: bytes, at: int) -> int:
    crc, i, ended = _crc_table(32, 0x04C11DB7), at, False
    while b[i : i + 4] == b"OggS" and i + 27 <= len(b) and b[i + 4] == 0:
        n = b[i + 26]
        size = 27 + n + sum(b[i + 27 : i + 27 + n])
        page = bytearray(b[i : i + size])
        if len(page) < size:
            break
        told, page[22:26] = int.from_bytes(page[22:26], "little"), b"\0\0\0\0"
        r = 0
        for x in page:
            r = (r << 8) & 0xFFFFFFFF ^ crc[(r >> 24) ^ x]
        if r != told:
            break
        i, ended = i + size, bool(b[i + 5] & 4)
    return i - at if ended else 0


def _mp4(b: bytes, at: int) -> int:
    """The magic, ftyp, stands four bytes into the file."""
    i, kinds = at, []
    while i + 8 <= len(b):
        n, kind = int.from_bytes(b[i : i + 4], "big"), b[i + 4 : i + 8]
        if n == 1 and i + 16 <= len(b):
            n = int.from_bytes(b[i + 8 : i + 16], "big")
        if n < 8 or i + n > len(b) or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"udta", b"meta", b"moof", b"mfra", b"sidx", b"styp", b"pdin", b"uuid"):
            break
        kinds.append(kind)
        i += n
    return i - at if kinds[:1] == [b"ftyp"] and (b"moov" in kinds or b"moof" in kinds or b"meta" in kinds) else 0


_RATES = {1: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}  # fixed values: kbit/s of MPEG 1 and 2 layer III


def _mp3(b: bytes, at: int) -> int:
    if at + 10 > len(b) or b[at + 3] > 4 or any(x & 0x80 for x in b[at + 6 : at + 10]):
        return 0
    i = at + 10 + sum(x << s for x, s in zip(b[at + 6 : at + 10], (21, 14, 7, 0), strict=True))
    frames = 0
    while i + 4 <= len(b) and b[i] == 0xFF and b[i + 1] & 0xE6 == 0xE2:
        version = 1 if b[i + 1] & 0x18 == 0x18 else 2
        rate, hz = b[i + 2] >> 4, (b[i + 2] >> 2) & 3
        if rate in (0, 15) or hz == 3:
            break
        freq = (44100, 48000, 32000)[hz] >> (version - 1 + (b[i + 1] & 0x18 == 0))
        n = (144 if version == 1 else 72) * _RATES[version][rate] * 1000 // freq + ((b[i + 2] >> 1) & 1)
        if i + n > len(b):
            break
        i, frames = i + n, frames + 1
    return i - at if frames >= 2 else 0


#: Magic bytes, where they stand in the file, type, validator (bytes, start) -> length or 0.
FORMATS = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"BM", 0, "image/bmp", _bmp),
    (b"WAVE", 8, "audio/wav", _riff(b"WAVE")),
    (b"AVI ", 8, "video/x-msvideo", _riff(b"AVI ")),
    (b"WEBP", 8, "image/webp", _riff(b"WEBP")),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
    (b"ID3", 0, "audio/mpeg", _mp3),
)


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, (magic, *_) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), k)
    a.make_automaton()
    return a


def sniff(b: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the media in b, in order, without those inside others."""
    starts = []
    for last, k in automaton().iter(b.decode("latin-1")):
        magic, into, _, _ = FORMATS[k]
        at = last - len(magic) + 1 - into
        if at >= 0 and (into != 8 or b[at : at + 4] == b"RIFF"):
            starts.append((at, k))
    out, free = [], 0
    for at, k in sorted(starts):
        if at >= free and (n := FORMATS[k][3](b, at)):
            out.append((at, n, FORMATS[k][2]))
            free = at + n
    return out


_FOUND = pa.struct([("type", pa.string()), ("media", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])))])


def sniff_media(df: DataFrame, media: str, declared: str | None = None, out: str = "sniffed") -> DataFrame:
    """df with `out`: struct<type, media>: all media found, and the type of the whole column value: that of what
    stands at offset 0, else the declared one, else null."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in it:
            rows = []
            for x in batch:
                found = sniff(x.as_py() or b"")
                rows.append({"type": found[0][2] if found and found[0][0] == 0 else None, "media": [{"offset": a, "length": n, "type": t} for a, n, t in found]})
            yield pa.array(rows, type=_FOUND)

    got = F.arrow_udf(run, "struct<type:string,media:array<struct<offset:long,length:long,type:string>>>")(F.col(media))
    told = F.col(declared) if declared else F.lit(None).cast("string")
    return df.withColumn(out, got).withColumn(out, F.struct(F.coalesce(F.col(out).type, told).alias("type"), F.col(out).media.alias("media")))


def carve(df: DataFrame, media: str, sniffed: str = "sniffed", out: str = "carved") -> DataFrame:
    """A row for each embedded or leading medium: df's columns and `out`: struct<offset, type, bytes>."""
    pieces = F.transform(F.col(sniffed).media, lambda m: F.struct(m.offset.alias("offset"), m.type.alias("type"), F.substring(F.col(media), m.offset + 1, m.length).alias("bytes")))
    return df.withColumn(out, F.explode(pieces))


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "replace")
    want = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw + b"\xff" * (want - len(raw)), len(raw)


def wav(samples: bytes) -> bytes:
    """One channel of unsigned 8-bit PCM."""
    return b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples


def samples_of(b: bytes) -> bytes:
    """The samples of a WAV file, found by walking its chunks."""
    i = 12
    while i + 8 <= len(b):
        n = int.from_bytes(b[i + 4 : i + 8], "little")
        if b[i : i + 4] == b"data":
            return b[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    raise ValueError("no samples")


#: What the stored column claims before its bytes are looked at.
DECLARED = "application/octet-stream"
_DIGEST = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def digest(text: str) -> dict:
    """Stores the padded text as WAV, sniffs the stored bytes, carves the leading medium and reads it back."""
    payload, n = padded(text)
    stored = wav(payload)
    found = sniff(stored)
    at, length, kind = found[0]
    back = samples_of(stored[at : at + length])
    x = np.frombuffer(back, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    feature = {
        "declared": DECLARED,
        "type": kind,
        "samples": len(x),
        "mean": f"{x.mean():.4f}",
        "rms": f"{np.sqrt(np.mean((x.astype(np.float64) - 128) ** 2)):.4f}",
        "entropy": f"{-(share * np.log2(share)).sum():.4f}",
        "crossings": int(np.count_nonzero(np.diff(x >= 128))),
        "embedded": "+".join(f"{t}@{a}:{k}" for a, k, t in sniff(back)) or "none",
    }
    return {
        "n_bytes": n,
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-32:]),
        "media_bytes": len(stored),
        "media_sha256": hashlib.sha256(stored).hexdigest(),
        "feature": ";".join(f"{k}={v}" for k, v in feature.items()),
    }


def op4_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string>"
    work = text_udf(lambda: lambda texts: [digest(t) for t in texts], kind, _DIGEST)
    return table(spark, sf_dir, "documents").select("doc_id", work("text").alias("m")).select("doc_id", "m.*")


QUERIES = {"op4_media_sniff": op4_media_sniff}
SQL: dict[str, str] = {}
