"""Media columns: what stored bytes really are.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass.  A validator for each format then
reads the structure behind a hit (chunk lengths, checksums, terminators) and either confirms it with its exact length or
rejects it.  A confirmed hit at the start corrects the declared type; confirmed hits further in are carved out.  What a
validator finds out behind a position (the next end marker, where a chain of blocks ends) is kept for the hits that
follow, so magic bytes that repeat all over a long text are read once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

# fixed values: formats with their magic bytes and where in the file those begin
MAGIC: dict[str, list[tuple[bytes, int]]] = {
    "image/png": [(b"\x89PNG\r\n\x1a\n", 0)],
    "image/gif": [(b"GIF87a", 0), (b"GIF89a", 0)],
    "image/jpeg": [(b"\xff\xd8\xff", 0)],
    "image/bmp": [(b"BM", 0)],
    "image/webp": [(b"WEBP", 8)],
    "audio/wav": [(b"WAVE", 8)],
    "audio/flac": [(b"fLaC", 0)],
    "application/ogg": [(b"OggS", 0)],
    "application/pdf": [(b"%PDF-", 0)],
    "application/zip": [(b"PK\x03\x04", 0)],
    "application/gzip": [(b"\x1f\x8b\x08", 0)],
}
#: Samples of a stored payload come in blocks of so many bytes.
BLOCK = 576


class Found(NamedTuple):
    kind: str
    start: int
    length: int


def _png(b: bytes, s: int, memo: dict) -> int:
    i = s + 8
    first = True
    while i + 12 <= len(b):
        n, name = struct.unpack(">I", b[i : i + 4])[0], b[i + 4 : i + 8]
        if first and (name, n) != (b"IHDR", 13) or i + 12 + n > len(b) or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack(">I", b[i + 8 + n : i + 12 + n])[0]:
            return 0
        first, i = False, i + 12 + n
        if name == b"IEND":
            return i - s
    return 0


def _next(b: bytes, what: bytes, s: int, memo: dict) -> int:
    """Where what next occurs from s on, -1 if nowhere; s never falls from one call to the next."""
    at = memo.get(what)
    if at is None or 0 <= at < s:
        at = memo[what] = b.find(what, s)
    return at


def _gif(b: bytes, s: int, memo: dict) -> int:
    if s + 13 > len(b):
        return 0
    ends: dict[int, int] = memo.setdefault("gif", {})  # of a chain of blocks: where it ends, 0 if it is broken
    i, path, end = s + 13 + (3 << (b[s + 10] & 7) + 1 if b[s + 10] & 128 else 0), [], 0
    while i < len(b):
        if i in ends:
            end = ends[i]
            break
        path.append(i)
        if b[i] == 0x3B:
            end = i + 1
            break
        if b[i] == 0x21:
            i = -(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            i = -(i + 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 128 else 0))
        else:
            break
        while -i < len(b) and i not in ends and b[-i]:  # data blocks, under negative positions
            path.append(i)
            i -= 1 + b[-i]
        if i in ends:
            end = ends[i]
            break
        path.append(i)
        i = 1 - i
    ends.update(dict.fromkeys(path, end))
    return end - s if end else 0


def _jpeg(b: bytes, s: int, memo: dict) -> int:
    i = s + 2
    while i + 4 <= len(b) and b[i] == 0xFF:
        m = b[i + 1]
        if m == 0xFF:
            i += 1
            continue
        n = int.from_bytes(b[i + 2 : i + 4], "big")
        if m in (0x00, 0xD8, 0xD9) or n < 2 or i + 2 + n > len(b):
            return 0
        i += 2 + n
        if m == 0xDA:  # entropy-coded data up to the next marker that is neither stuffing nor a restart
            while True:
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return 0
                if b[i + 1] == 0xD9:
                    return i + 2 - s
                if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7:
                    i += 2
                else:
                    break
    return 0


def _bmp(b: bytes, s: int, memo: dict) -> int:
    if s + 30 > len(b):
        return 0
    size, reserved, data, header = struct.unpack("<IIII", b[s + 2 : s + 18])
    planes, bits = struct.unpack("<HH", b[s + 26 : s + 30])
    ok = reserved == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return size if ok and 14 + header <= data <= size and s + size <= len(b) else 0


def _riff(kind: bytes) -> Callable[[bytes, int, dict], int]:
    def check(b: bytes, s: int, memo: dict) -> int:
        if b[s : s + 4] != b"RIFF" or s + 12 > len(b):
            return 0
        end = s + 8 + struct.unpack("<I", b[s + 4 : s + 8])[0]
        i, names = s + 12, []
        if end > len(b):
            return 0
        while i + 8 <= end:
            names.append(b[i : i + 4])
            i += 8 + (n := struct.unpack("<I", b[i + 4 : i + 8])[0]) + n % 2
        need = (b"fmt ", b"data") if kind == b"WAVE" else ()
        return end - s if i == end and names and all(x in names for x in need) else 0

    return check


def _flac(b: bytes, s: int, memo: dict) -> int:
    if b[s + 4 : s + 8] not in (b"\x00\x00\x00\x22", b"\x80\x00\x00\x22") or s + 42 > len(b):
        return 0
    i = s + 4
    while i + 4 <= len(b):
        last, n = b[i] & 128, int.from_bytes(b[i + 1 : i + 4], "big")
        i += 4 + n
        if i > len(b):
            return 0
        if last:  # frames carry no length: the stream reaches to the end
            return len(b) - s if i + 2 <= len(b) and b[i] == 0xFF and b[i + 1] & 0xFC == 0xF8 else 0
    return 0


def _ogg(b: bytes, s: int, memo: dict) -> int:
    i, serial = s, b[s + 14 : s + 18]
    while b[i : i + 5] == b"OggS\x00" and i + 27 <= len(b) and b[i + 14 : i + 18] == serial:
        n = b[i + 26]
        j = i + 27 + n + sum(b[i + 27 : i + 27 + n])
        if j > len(b):
            return 0
        last, i = b[i + 5] & 4, j
        if last:
            return i - s
    return 0


def _pdf(b: bytes, s: int, memo: dict) -> int:
    if not b[s + 5 : s + 6].isdigit():
        return 0
    end = _next(b, b"%%EOF", s, memo)
    return end + 5 - s if end > 0 and 0 < _next(b, b"startxref", s, memo) < end else 0


def _zip(b: bytes, s: int, memo: dict) -> int:
    i = _next(b, b"PK\x05\x06", s, memo)
    if i < 0 or i + 22 > len(b):
        return 0
    count, size, offset, note = struct.unpack("<HIIH", b[i + 10 : i + 22])
    ok = s + offset + size == i and (count == 0 or b[s + offset : s + offset + 4] == b"PK\x01\x02")
    return i + 22 + note - s if ok and i + 22 + note <= len(b) else 0


def _gzip(b: bytes, s: int, memo: dict) -> int:
    if s + 18 > len(b) or b[s + 3] & 0xE0:
        return 0
    d = zlib.decompressobj(31)
    at = s
    try:
        while at < len(b) and not d.eof:  # in pieces: a bomb's output is not kept
            part = b[at : at + 65536]
            while part and not d.eof:
                d.decompress(part, 1 << 20)
                part = d.unconsumed_tail
            at += 65536
    except zlib.error:
        return 0
    return min(at, len(b)) - len(d.unused_data) - s if d.eof else 0


VALID: dict[str, Callable[[bytes, int, dict], int]] = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "image/webp": _riff(b"WEBP"), "audio/wav": _riff(b"WAVE"),
    "audio/flac": _flac, "application/ogg": _ogg, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, magics in MAGIC.items():
        for magic, at in magics:
            a.add_word(magic.decode("latin-1"), (kind, at, len(magic)))
    a.make_automaton()
    return a


def sniff(b: bytes) -> list[Found]:
    """Confirmed media in b, outermost first: a hit inside one that is confirmed belongs to it and is not listed."""
    hits = sorted((end - n + 1 - at, kind) for end, (kind, at, n) in automaton().iter(b.decode("latin-1")) if end - n + 1 >= at)
    out: list[Found] = []
    free, memo = 0, {}
    for s, kind in hits:
        if s >= free and (n := VALID[kind](b, s, memo)):
            out.append(Found(kind, s, n))
            free = s + n
    return out


def corrected_type(b: bytes, declared: str | None) -> str:
    """The type of b: that of confirmed media at its start, else text if it is UTF-8, else unknown bytes."""
    first = [f.kind for f in sniff(b) if f.start == 0]
    if first:
        return first[0]
    try:
        b.decode("utf-8")
    except UnicodeDecodeError:
        return "application/octet-stream"
    return declared if (declared or "").startswith("text/") else "text/plain"


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """payload as unsigned 8-bit samples of one channel, without loss."""
    odd = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def from_wav(b: bytes) -> bytes:
    """The samples in stored bytes; ValueError if those are not a whole 8-bit WAV file."""
    found = sniff(b)
    if not found or found[0] != ("audio/wav", 0, len(b)):
        raise ValueError("not a whole WAV file")
    i = 12
    while b[i : i + 4] != b"data":
        if b[i : i + 4] == b"fmt " and struct.unpack("<HH", b[i + 8 : i + 12] if len(b) > i + 12 else b"\0" * 4) != (1, 1):
            raise ValueError("not 8-bit samples of one channel")
        i += 8 + (n := struct.unpack("<I", b[i + 4 : i + 8])[0]) + n % 2
    return b[i + 8 : i + 8 + struct.unpack("<I", b[i + 4 : i + 8])[0]]


def inspect(df: DataFrame, bytes_col: str, declared_col: str | None = None, carve: bool = True) -> DataFrame:
    """df with media_type string, embedded array<struct<kind, start, length[, content]>>, mismatch boolean.

    Columns of those names are replaced.  Null bytes: media_type null, no embedded, mismatch false.  Null declared type:
    never a mismatch.  Repeated rows are handled alike; an empty table gives no rows.
    """
    df = df.drop("media_type", "embedded", "mismatch")
    piece = "struct<kind:string,start:long,length:long" + (",content:binary>" if carve else ">")

    def run(data: pd.Series, declared: pd.Series) -> pd.DataFrame:
        out = []
        for b, d in zip(data, declared, strict=True):
            if b is None:
                out.append((None, [], False))
                continue
            kind = corrected_type(b := bytes(b), d)
            inner = [(*f, b[f.start : f.start + f.length]) if carve else tuple(f) for f in sniff(b) if f.start or f.length < len(b)]
            out.append((kind, inner, bool(d) and d.lower() != kind))
        return pd.DataFrame(out, columns=["media_type", "embedded", "mismatch"])

    run.__annotations__ = {"data": pd.Series, "declared": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(run, f"media_type string, embedded array<{piece}>, mismatch boolean")
    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    held = df.select(F.struct(*df.columns).alias("row"), udf(F.col(bytes_col), declared).alias("found"))
    return held.select("row.*", "found.media_type", "found.embedded", "found.mismatch")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = False) -> DataFrame:
    """A row per row of docs: the text's bytes as WAV samples, and features of the payload read back from them.

    Columns: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, if
    with_media, media (the stored bytes).  The payload is the UTF-8 text and bytes 255 up to a positive multiple of 576.
    The files are written to the shared folder as a column, and all features come from what is read from there.  Null
    text: an empty one.  feature names the stored type, the payload's own (declared text/plain, corrected where media
    stand at its start), then every piece of media carved from the payload as kind:start:length.  Equal texts give equal
    values; very long texts make long files; an empty table gives no rows; other columns are not looked at.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode("utf-8") for t in batch.column(1).to_pylist()]
            files = [to_wav(r + b"\xff" * (BLOCK * max(1, -(-len(r) // BLOCK)) - len(r))) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], names=[id_col, "n_bytes", "media"])

    def one(n: int, media: bytes) -> tuple:
        back = from_wav(media)
        found = sniff(back)
        own = found[0].kind if found and not found[0].start else "text/plain"
        feature = ",".join([corrected_type(media, None), own, *(f"{f.kind}:{f.start}:{f.length}" for f in found)])
        row = (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        return (*row, media) if with_media else row

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * with_media]
        names = [id_col, *(x.split()[0] for x in schema.split(", ")[1:])]
        for batch in batches:
            cols = list(zip(*map(one, batch.column(1).to_pylist(), batch.column(2).to_pylist()), strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    files = cut(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(store, f"`{id_col}` {kind}, n_bytes long, media binary"))
    return files.mapInArrow(read, schema)
