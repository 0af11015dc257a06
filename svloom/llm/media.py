"""Documents as media columns in ISO media containers, and a reader that never decodes payloads.

A payload of bytes becomes one track of raw 8-bit audio samples in an MP4 file: ftyp, moov with a sample
table (stsd, stts, stss, stsc, stsz, co64), mdat. read_media walks the nested boxes of such a file, decodes
the sample tables and returns codec, duration and the byte ranges of the key frames; it touches the media
data only where payload bytes are asked for by range.

Defined cases: null and empty texts are 64 zero bytes; texts of any length are whole; equal texts give
equal files; repeated rows are stored row by row; an empty table gives an empty result; columns besides
doc_id and text are ignored, whatever their names. Boxes that lie about their size, and boxes with 64-bit
sizes or "to the end" sizes, are read as far as the bytes go and never looped over.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from svloom.llm.common import Workspace

UNIT = 64
RATE = 8000
FRAME = 4096
KEY_EVERY = 8
#: Boxes that hold boxes, after so many bytes of their own.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"stsd": 8, b"dref": 8, b"meta": 4}
#: Bytes that a box needs for what is read of it.
SHORTEST = {b"mdhd": 20, b"stsd": 16, b"stco": 8, b"co64": 8, b"stsc": 8, b"stsz": 12, b"stss": 8, b"stts": 8}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


# ---------------------------------------------------------------- writing
def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body if len(body) < 2**32 - 8 else struct.pack(">I", 1) + kind + struct.pack(">Q", 16 + len(body)) + body


def full_box(kind: bytes, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return payload + bytes(UNIT - len(payload) % UNIT if len(payload) % UNIT or not payload else 0)


def write_media(payload: bytes, frame: int = FRAME, key_every: int = KEY_EVERY) -> bytes:
    """An MP4 file with payload as raw 8-bit mono audio, frame bytes a sample; every key_every-th sample is a key frame."""
    n_whole, tail = divmod(len(payload), frame)
    n = n_whole + (tail > 0)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 0), b"isom", b"mp41")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    times = ([(n_whole, frame)] if n_whole else []) + ([(1, tail)] if tail else [])
    sizes = struct.pack(">II", 0 if tail else frame, n) + (struct.pack(f">{n}I", *([frame] * n_whole + [tail])) if tail else b"")
    keys = range(1, n + 1, key_every)

    def moov(offset: int) -> bytes:
        stbl = box(
            b"stbl",
            full_box(b"stsd", 0, struct.pack(">I", 1), entry),
            full_box(b"stts", 0, struct.pack(">I", len(times)), *(struct.pack(">II", *t) for t in times)),
            full_box(b"stss", 0, struct.pack(">I", len(keys)), *(struct.pack(">I", k) for k in keys)),
            full_box(b"stsc", 0, struct.pack(">IIII", 1, 1, n, 1)),
            full_box(b"stsz", 0, sizes),
            full_box(b"co64", 0, struct.pack(">IQ", 1, offset)),
        )
        dinf = box(b"dinf", full_box(b"dref", 0, struct.pack(">I", 1), full_box(b"url ", 1)))
        minf = box(b"minf", full_box(b"smhd", 0, bytes(4)), dinf, stbl)
        mdhd = full_box(b"mdhd", 1 << 24, struct.pack(">QQIQHH", 0, 0, RATE, len(payload), 0x55C4, 0))
        hdlr = full_box(b"hdlr", 0, bytes(4), b"soun", bytes(12), b"sound\x00")
        tkhd = full_box(b"tkhd", 1 << 24 | 7, struct.pack(">QQIIQ", 0, 0, 1, 0, len(payload)), bytes(8), struct.pack(">hhhH", 0, 0, 256, 0), MATRIX, bytes(8))
        mvhd = full_box(b"mvhd", 1 << 24, struct.pack(">QQIQIH", 0, 0, RATE, len(payload), 0x10000, 256), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = len(ftyp) + len(moov(0)) + (16 if len(payload) >= 2**32 - 8 else 8)
    return b"".join([ftyp, moov(head), box(b"mdat", payload)])


# ---------------------------------------------------------------- reading
def walk(data: memoryview, start: int, end: int) -> Iterator[tuple[int, bytes, int, int]]:
    """(depth, kind, body start, body end) of all boxes, parents first, however deep they lie."""
    todo = [(start, end, 0)]
    while todo:
        start, end, depth = todo.pop()
        if start + 8 > end:
            continue
        size, kind, body = int.from_bytes(data[start : start + 4], "big"), bytes(data[start + 4 : start + 8]), start + 8
        if size == 1 and start + 16 <= end:
            size, body = int.from_bytes(data[start + 8 : start + 16], "big"), start + 16
        stop = end if size == 0 else min(start + size, end)
        if stop < body:
            continue
        yield depth, kind, body, stop
        todo.append((stop, end, depth))
        if kind in CONTAINERS:
            todo.append((body + CONTAINERS[kind], stop, depth + 1))


def _table(data: memoryview, body: int, end: int, dtype: str, columns: int = 1, skip: int = 4) -> np.ndarray:
    """The entries of a counted table after its version, flags and count; as many as are there."""
    at, width = body + skip + 4, np.dtype(dtype).itemsize * columns
    n = min(int.from_bytes(data[body + skip : at], "big"), max(0, end - at) // width)
    return np.frombuffer(data, dtype, n * columns, at).astype(np.int64).reshape(-1, columns)


def read_media(data: bytes) -> list[dict]:
    """One dict a track: codec, timescale, duration, n_samples, offsets, sizes, key_ranges (first byte, end)."""
    view, tracks = memoryview(data), []
    for _, kind, body, end in walk(view, 0, len(view)):
        if kind == b"trak":
            tracks.append({})
        if not tracks:
            continue
        track = tracks[-1]
        if end - body < SHORTEST.get(kind, 0):
            continue
        if kind == b"mdhd":
            wide = data[body] == 1 and end - body >= 32
            at = body + (20 if wide else 12)
            track["timescale"], track["duration"] = struct.unpack_from(">IQ" if wide else ">II", data, at)
        elif kind == b"stsd":
            track["codec"] = bytes(view[body + 12 : body + 16]).decode("latin1").strip()
        elif kind in (b"stco", b"co64"):
            track["chunks"] = _table(view, body, end, ">u4" if kind == b"stco" else ">u8")[:, 0]
        elif kind == b"stsc":
            track["stsc"] = _table(view, body, end, ">u4", 3)
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, body + 4)
            track["sizes"] = np.full(min(n, len(data) // same + 1), same, np.int64) if same else _table(view, body, end, ">u4", skip=8)[:, 0]
        elif kind == b"stss":
            track["keys"] = _table(view, body, end, ">u4")[:, 0] - 1
        elif kind == b"stts":
            track["stts"] = _table(view, body, end, ">u4", 2)
    return [_with_ranges(t) for t in tracks if "sizes" in t]


def _with_ranges(track: dict) -> dict:
    """Adds each sample's offset from the chunk tables, and the key frames' byte ranges."""
    sizes, chunks, runs = track["sizes"], track.get("chunks", np.zeros(0, np.int64)), track.get("stsc", np.zeros((0, 3), np.int64))
    per_chunk = np.zeros(len(chunks), np.int64)
    for k, (first, samples, _) in enumerate(runs.tolist()):
        last = int(runs[k + 1, 0]) - 1 if k + 1 < len(runs) else len(chunks)
        per_chunk[max(first, 1) - 1 : max(last, 0)] = min(samples, len(sizes))
    owner = np.repeat(np.arange(len(chunks)), per_chunk)[: len(sizes)]
    sizes = sizes[: len(owner)]
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
    starts = np.concatenate([[0], np.cumsum(per_chunk)[:-1]]) if len(chunks) else per_chunk
    offsets = chunks[owner] + before - before[np.minimum(starts[owner], max(len(sizes) - 1, 0))] if len(sizes) else sizes
    keys = track.get("keys", np.arange(len(sizes)))
    keys = keys[(keys >= 0) & (keys < len(sizes))]
    stts = track.get("stts", np.zeros((0, 2), np.int64))
    return {
        "codec": track.get("codec", ""), "timescale": track.get("timescale", 0), "duration": track.get("duration", 0), "n_samples": len(sizes), "ticks": int((stts[:, 0] * stts[:, 1]).sum()),
        "offsets": offsets, "sizes": sizes, "key_ranges": np.stack([offsets[keys], offsets[keys] + sizes[keys]], 1),
    }


def payload_of(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track, read by its sample ranges; neighbouring samples are read together."""
    if not track["n_samples"]:
        return b""
    offsets, ends = track["offsets"], track["offsets"] + track["sizes"]
    cut = np.flatnonzero(offsets[1:] != ends[:-1]) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(offsets)]]) - 1
    return b"".join(data[a:b] for a, b in zip(offsets[first].tolist(), ends[last].tolist(), strict=True))


# ---------------------------------------------------------------- Spark jobs
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary, codec string, timescale long, duration long, key_ranges array<struct<first:long,end:long>>"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media and what read_media finds in it, for every row of docs."""

    def build(batches):
        for batch in batches:
            n_bytes, media, tracks = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                payload = text or b""
                n_bytes.append(len(payload))
                media.append(write_media(pad(payload)))
                tracks.append(read_media(media[-1])[0])
            ranges = [[{"first": a, "end": b} for a, b in t["key_ranges"].tolist()] for t in tracks]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(media, pa.binary()), pa.array([t["codec"] for t in tracks]), pa.array([t["timescale"] for t in tracks], pa.int64()), pa.array([t["duration"] for t in tracks], pa.int64()), pa.array(ranges, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_bytes", "media", "codec", "timescale", "duration", "key_ranges"],
            )

    return docs.select("doc_id", "text").mapInArrow(build, MEDIA_SCHEMA)


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of a media table: the stored bytes are read back by the ranges in the container."""

    def read(batches):
        for batch in batches:
            rows = []
            for doc_id, n_bytes, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                track = read_media(data)[0]
                payload = payload_of(data, track)
                samples = np.frombuffer(payload, np.uint8)
                seconds = track["duration"] / max(track["timescale"], 1)
                feature = f"{track['codec']}/{track['timescale']}/{seconds:.3f}s/{len(track['key_ranges'])}k/{int(samples.max())}max/{float(samples.mean()):.4f}mean"
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, track["codec"], seconds, len(track["key_ranges"])))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "seconds", "n_key_ranges"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, n_key_ranges long"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, schema)


def documents_as_media(docs: DataFrame) -> DataFrame:
    """Store every text as a media column in the shared folder, then read its digests and features back."""
    space = Workspace(docs.sparkSession, "media")
    return media_features(space.save(to_media(docs), "media"))
