"""Media columns: ISO base media containers built from, and read in, a binary column.

``pack_media`` wraps bytes as 8-bit PCM samples (codec ``ipcm``) of 64 bytes in a file with the usual
nested boxes (ftyp, moov/trak/mdia/minf/stbl, mdat). ``probe_media`` walks any such file's boxes,
decodes its sample tables (stts, stsc, stsz, stco or co64, stss) and gives codec, time scale,
duration, sample count and the byte ranges of its sync samples, reading no payload.
``payload_of`` follows the tables to the samples' bytes.

Boxes with 64-bit sizes, boxes that reach to the end, unknown boxes, and boxes in any order are read.
A file that is cut short or contradicts itself gives a row with ``error`` and nulls, never a crash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from overlapkit.llm import _shared as S

UNIT = 64  # bytes in a sample
TIMESCALE = 8_000  # 8-bit mono samples a second
PER_CHUNK = 16  # samples in a chunk; each chunk's first sample is a sync sample
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return b"".join([struct.pack(">I4s", size, kind), *parts])
    return b"".join([struct.pack(">I4sQ", 1, kind, size + 8), *parts])


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    """Zero bytes appended, up to a positive multiple of ``unit``."""
    return payload.ljust(max(unit, -(-len(payload) // unit) * unit), b"\0")


def build(payload: bytes) -> bytes:
    """The container of a payload whose length is a positive multiple of ``UNIT``. Equal in, equal out."""
    samples = len(payload) // UNIT
    chunks = -(-samples // PER_CHUNK)
    duration = len(payload)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    entry = box(b"ipcm", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, TIMESCALE << 16), full(b"pcmC", b"\x00\x08"))
    left = samples - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK, 1)] if chunks > 1 or left == PER_CHUNK else []
    if left != PER_CHUNK:
        runs.append((chunks, left, 1))
    sync = np.arange(chunks, dtype=np.int64) * PER_CHUNK + 1

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * PER_CHUNK * UNIT
        wide = first + len(payload) >= 1 << 32
        table = full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if wide else full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, samples, UNIT)),
            full(b"stss", struct.pack(">I", chunks), sync.astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", UNIT, samples)),
            table,
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0), version=1)
        hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0")
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, duration), bytes(8), struct.pack(">HHHH", 0, 0, 0x0100, 0), MATRIX, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, TIMESCALE, duration, 0x10000, 0x0100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    size = len(moov(0))
    first = len(ftyp) + size + head
    made = moov(first)
    if len(made) != size:  # wide offsets take more room
        first += len(made) - size
        made = moov(first)
    return b"".join([ftyp, made, box(b"mdat", payload)])


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start, end) of every box's content, parents before children."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box is cut short")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} does not fit its parent")
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


def probe(data: bytes) -> dict:
    """Codec, timescale, duration, and offset, size and sync flag of the first track's samples."""
    tables: dict[bytes, tuple[int, int]] = {}
    track = 0
    for path, a, b in walk(data):
        track += path[-1] == b"trak"
        if track == 1 and path[0] == b"moov" and len(path) > 2:
            tables.setdefault(path[-1], (a, b))
    missing = [k.decode() for k in (b"mdhd", b"stsd", b"stts", b"stsc", b"stsz") if k not in tables]
    if missing or not {b"stco", b"co64"} & tables.keys():
        raise ValueError("no " + (missing or ["stco"])[0])

    def ints(kind: bytes, at: int, n: int, size: int = 4) -> np.ndarray:
        a, b = tables[kind]
        if n < 0 or a + at + n * size > b:
            raise ValueError(f"table {kind.decode()} is cut short")
        return np.frombuffer(data, dtype=f">u{size}", count=n, offset=a + at).astype(np.int64)

    one = lambda kind, at: int(ints(kind, at, 1)[0])
    wide = data[tables[b"mdhd"][0]] == 1 if tables[b"mdhd"][1] > tables[b"mdhd"][0] else False
    timescale = one(b"mdhd", 20 if wide else 12)
    codec = data[tables[b"stsd"][0] + 12 : tables[b"stsd"][0] + 16].decode("latin-1")
    stts = ints(b"stts", 8, 2 * one(b"stts", 4)).reshape(-1, 2)
    fixed, n = one(b"stsz", 4), one(b"stsz", 8)
    if fixed and n > len(data):
        raise ValueError("more samples than bytes")
    sizes = np.full(n, fixed, dtype=np.int64) if fixed else ints(b"stsz", 12, n)
    chunk = b"stco" if b"stco" in tables else b"co64"
    offsets = ints(chunk, 8, one(chunk, 4), 4 if chunk == b"stco" else 8)
    runs = ints(b"stsc", 8, 3 * one(b"stsc", 4)).reshape(-1, 3)
    firsts = np.r_[runs[:, 0], len(offsets) + 1]
    if (np.diff(firsts) < 0).any() or (len(runs) and firsts[0] != 1) or (runs[:, 1] > n).any():
        raise ValueError("table stsc is out of order")
    per_chunk = np.repeat(runs[:, 1], np.diff(firsts))
    if per_chunk.sum() != n or stts[:, 0].sum() != n:
        raise ValueError("the tables disagree on the number of samples")
    in_chunk = np.repeat(np.arange(len(offsets)), per_chunk)
    before = np.cumsum(sizes) - sizes
    first_of = np.cumsum(per_chunk) - per_chunk
    at = offsets[in_chunk] + before - before[np.minimum(first_of, max(n - 1, 0))][in_chunk] if n else np.zeros(0, dtype=np.int64)
    if n and ((at < 0).any() or (at + sizes > len(data)).any()):
        raise ValueError("a sample lies outside the file")
    sync = ints(b"stss", 8, one(b"stss", 4)) - 1 if b"stss" in tables else np.arange(n)
    if len(sync) and (sync.min() < 0 or sync.max() >= n):
        raise ValueError("table stss is out of range")
    return {"codec": codec, "timescale": timescale, "duration": int((stts[:, 0] * stts[:, 1]).sum()), "offsets": at, "sizes": sizes, "sync": sync}


def payload_of(data: bytes, found: dict) -> bytes:
    """The samples' bytes, in order; neighbours are read as one range."""
    at, end = found["offsets"], found["offsets"] + found["sizes"]
    if not len(at):
        return b""
    cut = np.flatnonzero(at[1:] != end[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(at[np.r_[0, cut]].tolist(), end[np.r_[cut - 1, len(end) - 1]].tolist(), strict=True))


def pack_media(docs: DataFrame, *, text_col: str = "text", keep: list[str], media_col: str = "media") -> DataFrame:
    """``keep`` columns, n_bytes (of the text), and the container of the padded text. Null is empty.

    Equal texts, in repeated rows or others, have equal containers; an empty table gives no rows. A
    column to keep may not be called ``n_bytes`` or ``media_col``; other columns are dropped.
    """
    if clash := {"n_bytes", media_col} & set(keep):
        raise ValueError(f"columns to keep have the results' names: {sorted(clash)}")
    schema = S.schema_of(docs, keep, **{"n_bytes": "long", media_col: "binary"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, text_col):
            texts = S.utf8(batch.column(text_col))
            n = pa.array([len(t) for t in texts], pa.int64())
            yield S.with_columns(batch, keep, n_bytes=n, **{media_col: pa.array([build(padded(t)) for t in texts], pa.binary())})

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, schema)


def probe_media(media: DataFrame, *, media_col: str = "media", keep: list[str], digests: bool = False) -> DataFrame:
    """``keep`` columns and codec, timescale, duration, n_samples, keyframes (array of offset and size), error.

    ``digests`` adds media_bytes, media_sha256 and, over the samples' bytes, payload_bytes,
    payload_sha256 and tail_crc32 (of the last 64).

    Cases: null media give nulls and error "null", and damaged ones their error; repeated rows are read
    alike, each with a row; an empty table gives no rows; a column to keep may not have a result's name.
    """
    more = {"codec": "string", "timescale": "long", "duration": "long", "n_samples": "long", "keyframes": "array<struct<offset: long, size: long>>", "error": "string"}
    if digests:
        more |= {"media_bytes": "long", "media_sha256": "string", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long"}
    if clash := set(more) & set(keep):
        raise ValueError(f"columns to keep have the results' names: {sorted(clash)}")
    schema = S.schema_of(media, keep, **more)
    pairs = pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))
    types = {"codec": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "n_samples": pa.int64(), "keyframes": pairs, "error": pa.string()}
    if digests:
        types |= {"media_bytes": pa.int64(), "media_sha256": pa.string(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64()}

    def one(data: bytes | None) -> dict:
        if data is None:
            return {"error": "null"}
        out: dict = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()} if digests else {}
        try:
            found = probe(data)
        except (ValueError, struct.error) as e:
            return out | {"error": str(e)}
        at, size = found["offsets"][found["sync"]].tolist(), found["sizes"][found["sync"]].tolist()
        out |= {k: found[k] for k in ("codec", "timescale", "duration")} | {"n_samples": len(found["sizes"])}
        out["keyframes"] = [{"offset": a, "size": b} for a, b in zip(at, size, strict=True)]
        if digests:
            payload = payload_of(data, found)
            out |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:])}
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches, media_col):
            rows = [one(x) for x in batch.column(media_col).to_pylist()]
            yield S.with_columns(batch, keep, **{c: pa.array([r.get(c) for r in rows], t) for c, t in types.items()})

    return media.select(*dict.fromkeys([*keep, media_col])).mapInArrow(run, schema)
