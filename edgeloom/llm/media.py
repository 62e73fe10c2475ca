"""Media columns: signature sniffing of stored bytes.

An Aho-Corasick automaton finds every known magic string in one pass; a validator of the format then walks the
structure from there and says where the medium ends. What begins at byte 0 corrects the declared type; whatever
validates further inside is embedded media and can be carved.
"""

from __future__ import annotations

import binascii
import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 192


def _png(b: bytes, i: int) -> int | None:
    at, first = i + 8, True
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        end = at + 12 + n
        if end > len(b) or first and (kind != b"IHDR" or n != 13):
            return None
        if zlib.crc32(memoryview(b)[at + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end
        at, first = end, False
    return None


def _gif(b: bytes, i: int) -> int | None:
    if i + 13 > len(b):
        return None
    width, height, flags = struct.unpack_from("<HHB", b, i + 6)
    at = i + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    if not width or not height:
        return None

    def blocks(at: int) -> int | None:
        while at < len(b):
            if not b[at]:
                return at + 1
            at += 1 + b[at]
        return None

    while at is not None and at < len(b):
        kind = b[at]
        if kind == 0x3B:
            return at + 1
        if kind == 0x21:
            at = blocks(at + 2)
        elif kind == 0x2C and at + 10 <= len(b):
            local = b[at + 9]
            at = blocks(at + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, i: int) -> int | None:
    at, framed = i + 2, False
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        kind = b[at + 1]
        if kind == 0xD9:
            return at + 2 if framed else None
        if kind in (0x01, *range(0xD0, 0xD8)):
            at += 2
            continue
        n = struct.unpack_from(">H", b, at + 2)[0]
        if n < 2 or kind in (0x00, 0xFF):
            return None
        framed |= kind in (0xC0, 0xC1, 0xC2)
        at += 2 + n
        if kind == 0xDA:  # entropy-coded data up to the next real marker
            while True:
                at = b.find(b"\xff", at)
                if at < 0 or at + 1 >= len(b):
                    return None
                if b[at + 1] == 0 or 0xD0 <= b[at + 1] <= 0xD7:
                    at += 2
                else:
                    break
    return at + 2 if framed and b[at : at + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, i: int) -> int | None:
    if i + 54 > len(b):
        return None
    size, _, _, offset, header = struct.unpack_from("<IHHII", b, i + 2)
    if header not in (12, 40, 52, 56, 64, 108, 124) or not 14 + header <= offset <= size or i + size > len(b):
        return None
    return i + size


def _riff(b: bytes, i: int, form: bytes) -> int | None:
    if i + 12 > len(b) or b[i + 8 : i + 12] != form:
        return None
    end = i + 8 + struct.unpack_from("<I", b, i + 4)[0]
    at, seen = i + 12, set()
    if end > len(b):
        return None
    while at + 8 <= end:
        kind, n = struct.unpack_from("<4sI", b, at)
        seen.add(kind)
        at += 8 + n + (n & 1)
    whole = at == end and (seen >= {b"fmt ", b"data"} if form == b"WAVE" else bool(seen & {b"VP8 ", b"VP8L", b"VP8X"}))
    return end if whole else None


def _pdf(b: bytes, i: int) -> int | None:
    if not b[i + 5 : i + 6].isdigit() or (end := b.find(b"%%EOF", i)) < 0 or b.find(b"startxref", i, end) < 0:
        return None
    return end + 5


def _zip(b: bytes, i: int) -> int | None:
    if i + 30 > len(b) or (at := b.find(b"PK\x05\x06", i)) < 0 or at + 22 > len(b):
        return None
    size, offset, comment = struct.unpack_from("<IIH", b, at + 12)
    return at + 22 + comment if i + offset + size == at and at + 22 + comment <= len(b) else None


def _gzip(b: bytes, i: int) -> int | None:
    if i + 18 > len(b) or b[i + 3] & 0xE0:
        return None
    d = zlib.decompressobj(31)
    at = i
    try:
        while at < len(b) and not d.eof:
            d.decompress(d.unconsumed_tail + b[at : at + 65536], 1 << 20)
            at += 65536
            while d.unconsumed_tail and not d.eof:
                d.decompress(d.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return min(at, len(b)) - len(d.unused_data) if d.eof else None


def _ogg(b: bytes, i: int) -> int | None:
    at = i
    while at + 27 <= len(b) and b[at : at + 5] == b"OggS\0":
        n = b[at + 26]
        end = at + 27 + n + sum(b[at + 27 : at + 27 + n])
        if end > len(b):
            return None
        if b[at + 5] & 4:
            return end
        at = end
    return None


def _flac(b: bytes, i: int) -> int | None:
    at, first = i + 4, True
    while at + 4 <= len(b):
        last, kind, n = b[at] >> 7, b[at] & 127, int.from_bytes(b[at + 1 : at + 4], "big")
        if first and (kind, n) != (0, 34) or at + 4 + n > len(b):
            return None
        at, first = at + 4 + n, False
        if last:  # frames follow; their end is where the sync code stops being found, so take the rest
            return len(b) if b[at : at + 1] == b"\xff" else None
    return None


#: magic bytes, media type, validator(bytes, start) -> end or None
FORMATS = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", lambda b, i: _riff(b, i, b"WAVE")),
    (b"RIFF", "image/webp", lambda b, i: _riff(b, i, b"WEBP")),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"OggS", "audio/ogg", _ogg),
    (b"fLaC", "audio/flac", _flac),
]


_built: list = []  # the automaton, once it is needed


def _automaton():
    if not _built:
        import ahocorasick

        found = ahocorasick.Automaton()
        for magic in {m for m, _, _ in FORMATS}:
            found.add_word(magic.decode("latin-1"), magic)
        found.make_automaton()
        _built.append(found)
    return _built[0]


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, end) of every medium that validates, outermost first; media inside one already found are listed too."""
    out = []
    for last, magic in _automaton().iter(data.decode("latin-1")):
        start = last + 1 - len(magic)
        for m, kind, valid in FORMATS:
            if m == magic and (end := valid(data, start)) is not None:
                out.append((kind, start, end))
    return sorted(out, key=lambda x: (x[1], -x[2], x[0]))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """A mono WAV whose 8-bit samples are the payload (of even length)."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def from_wav(stored: bytes, start: int = 0) -> bytes:
    """The samples of the WAV at `start`, found by walking its chunks."""
    at = start + 12
    while True:
        kind, n = struct.unpack_from("<4sI", stored, at)
        if kind == b"data":
            return stored[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)


def sniff_column(df: DataFrame, data: str = "data", declared: str | None = None) -> DataFrame:
    """df with `media_type`, `type_corrected` and `embedded` (array of struct<type, start, length>) for a binary column.

    Null or unrecognised bytes keep the declared type, are not corrected and embed nothing. Columns of df that bear
    the new names are replaced. Each row is decided by itself, so repeated rows agree.
    """
    base = df.drop("media_type", "type_corrected", "embedded")
    declared_col = F.col(declared).cast("string") if declared else F.lit(None).cast("string")
    kind = "media_type string, type_corrected boolean, embedded array<struct<type:string,start:bigint,length:bigint>>"

    @F.pandas_udf(kind)
    def look(blobs, types):
        import pandas as pd

        rows = []
        for b, said in zip(blobs, types, strict=True):
            found = sniff(bytes(b)) if b is not None else []
            own = next((x for x in found if x[1] == 0), None)
            real = own[0] if own else said
            inside = [{"type": k, "start": s, "length": e - s} for k, s, e in found if (k, s, e) != own]
            rows.append((real, bool(own and said is not None and said != real), inside))
        return pd.DataFrame(rows, columns=["media_type", "type_corrected", "embedded"])

    return base.withColumn("_m", look(F.col(data).cast("binary"), declared_col)).select(*base.columns, "_m.*")


def _features(part: pa.RecordBatch) -> dict:
    import numpy as np

    ids, texts = part.column(0), part.column(1)
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
    for doc, value in zip(ids.to_pylist(), texts, strict=True):
        raw = value.as_buffer().to_pybytes()
        n = len(raw)
        stored = to_wav(raw + b" " * (max(1, -(-n // UNIT)) * UNIT - n))
        found = sniff(stored)
        kind, start, end = next(x for x in found if x[1] == 0)
        payload = from_wav(stored, start)
        samples = np.frombuffer(payload, np.uint8)
        inside = ",".join(f"{k}@{s - 44}+{e - s}" for k, s, e in found if s >= 44)
        mean = int(samples.sum(dtype=np.int64)) * 1000 // len(samples)
        crossings = int(np.count_nonzero(np.diff(samples >= 128)))
        row = (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-16:]), end - start, hashlib.sha256(stored).hexdigest(), f"{kind};8bit;{len(samples)};mean={mean};peak={int(samples.max())};crossings={crossings};embedded={inside}")
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
    return out


def store_texts(docs: DataFrame) -> DataFrame:
    """Each whole text as an 8-bit WAV, sniffed and read back: the digest columns of op2.

    A null text counts as empty (192 spaces); a null doc_id stays null; rows are independent, so ties and repeated
    rows give equal values; other columns are ignored. Nothing is shuffled: one narrow pass over the scan.
    """
    from edgeloom.llm.common import mapped, text_of

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return mapped(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), _features, schema)
