"""Alignments in the block-compressed binary format (BAM) with its binning index (BAI), as a source and a sink.

A contig and a range reach the file: the index gives the chunks of blocks that may hold records over the range, the linear index drops those
that end before it, and a task reads its chunks by block, never the file. Without a range the linear index cuts the file
into parts. The sink writes blocks in tasks, sorted by ranges; a task tells where its records lie, and the commit joins the parts
and their indexes, as blocks are whole for themselves.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from svloom.sources.committed import COPY_BYTES, files_at
from svloom.sources.readers import READ_SCHEMA

#: Fixed values of the format: operations of an alignment, the empty block at the end, bytes of a block, positions of a window of the linear index.
OPS = "MIDNSHP=X"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_BYTES, WINDOW_SHIFT = 0xFF00, 14
#: Compressed bytes of one partition, about.
PART_BYTES = 32 << 20
_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")
NAMES = [x.split(" ")[0] for x in READ_SCHEMA.split(", ")]


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds [start, end)."""
    end -= 1
    for level, shift in ((5, 14), (4, 17), (3, 20), (2, 23), (1, 26)):
        if start >> shift == end >> shift:
            return ((1 << 3 * level) - 1) // 7 + (start >> shift)
    return 0


def bins_over(start: int, end: int) -> list[int]:
    """All bins that may hold records over [start, end)."""
    out = [0]
    for level, shift in ((1, 26), (2, 23), (3, 20), (4, 17), (5, 14)):
        first = ((1 << 3 * level) - 1) // 7
        out += range(first + (start >> shift), first + (end - 1 >> shift) + 1)
    return out


# ---------------------------------------------------------------- blocks and records
def pack_block(data: bytes) -> bytes:
    body = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    return struct.pack("<4BIBBH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data))


class Blocks:
    """The inflated bytes of a file from a virtual offset on, block by block."""

    def __init__(self, file, offset: int):
        self.file, self.at, self.data, self.place = file, offset >> 16, b"", 0
        self.next = self.at
        self._load()
        self.place = offset & 0xFFFF

    def _load(self) -> bool:
        self.at = self.next
        self.file.seek(self.at)
        head = self.file.read(18)
        if len(head) < 18:
            self.data, self.place = b"", 0
            return False
        extra = struct.unpack_from("<H", head, 10)[0]
        size = struct.unpack_from("<H", head, 16)[0] + 1
        self.data = zlib.decompress(self.file.read(size - 18)[extra - 6 : -8], -15)
        self.next, self.place = self.at + size, 0
        return True

    def offset(self) -> int:
        """Where the next byte lies."""
        while self.place >= len(self.data):
            if not self._load():
                break
        return self.at << 16 | self.place

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.place >= len(self.data) and not self._load():
                break
            part = self.data[self.place : self.place + n - len(out)]
            self.place += len(part)
            out += part
        return out


def pack_record(row: dict, contig: int) -> bytes:
    """The bytes of a record; sequence and qualities are left out, as the caller reads neither."""
    ops = [int(n) << 4 | OPS.index(op) for n, op in _CIGAR.findall(row["cigar"] or "")]
    name = (row["read_name"] or "*").encode()[:254] + b"\0"
    tags = b"" if row["nm"] is None else b"NMi" + struct.pack("<i", row["nm"])
    if row["sa"]:
        tags += b"SAZ" + row["sa"].encode() + b"\0"
    start = row["ref_start"]
    body = struct.pack("<iiBBHHHiiii", contig, start, len(name), row["mapq"], bin_of(start, max(start + 1, start + span(row["cigar"]))) & 0xFFFF, len(ops), row["flag"], 0, -1, -1, 0)
    body += name + struct.pack(f"<{len(ops)}I", *ops) + tags
    return struct.pack("<i", len(body)) + body


def span(cigar: str | None) -> int:
    """Positions of the contig that an alignment covers."""
    return sum(int(n) for n, op in _CIGAR.findall(cigar or "") if op in "MDN=X")


def _tags(data: bytes, at: int) -> tuple[int | None, str | None]:
    """NM and SA of a record's tags."""
    nm, sa, sizes = None, None, {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2], chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            if tag == b"SA":
                sa = data[at:end].decode()
            at = end + 1
        elif kind == "B":
            n = struct.unpack_from("<i", data, at + 1)[0]
            at += 5 + n * sizes[chr(data[at])]
        else:
            if tag == b"NM" and kind in "cCsSiI":
                nm = struct.unpack_from(f"<{kind.replace('c', 'b').replace('C', 'B').replace('s', 'h').replace('S', 'H')}", data, at)[0]
            at += sizes[kind]
    return nm, sa


def unpack_record(data: bytes, ordinal: int, contigs: list[str]) -> tuple:
    """A row of READ_SCHEMA."""
    ref, start, l_name, mapq, _, n_ops, flag, l_seq, _, _, _ = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + l_name
    ops = [(x >> 4, OPS[x & 15]) for x in struct.unpack_from(f"<{n_ops}I", data, at)]
    nm, sa = _tags(data, at + 4 * n_ops + (l_seq + 1) // 2 + l_seq)
    total = lambda kinds: sum(n for n, op in ops if op in kinds)
    lead = 0
    for n, op in ops:
        if op not in "SH":
            break
        lead += n if op == "S" else 0
    cigar = "".join(f"{n}{op}" for n, op in ops) or None
    return (
        ordinal, data[32 : 32 + l_name - 1].decode(), flag, contigs[ref] if ref >= 0 else None, start, start + total("MDN=X"), mapq, cigar, nm, sa,
        l_seq or total("MIS=X"), lead, lead + total("MI=X"), total("MISH=X"),
    )


def read_header(fs, path: str) -> tuple[list[str], int]:
    """Names of the contigs, and the virtual offset of the first record."""
    with fs.open_input_file(path) as file:
        blocks = Blocks(file, 0)
        if blocks.read(4) != b"BAM\1":
            raise ValueError(f"{path} is no BAM file")
        blocks.read(struct.unpack("<i", blocks.read(4))[0])
        names = []
        for _ in range(struct.unpack("<i", blocks.read(4))[0]):
            names.append(blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode())
            blocks.read(4)
        return names, blocks.offset()


def read_index(fs, path: str) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """Chunks by bin, and the linear index, of each contig."""
    with fs.open_input_stream(f"{path}.bai", compression=None) as file:
        data = file.read()
    if data[:4] != b"BAI\1":
        raise ValueError(f"{path}.bai is no index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins, n = {}, struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n):
            number, m = struct.unpack_from("<Ii", data, at)
            flat = struct.unpack_from(f"<{2 * m}Q", data, at + 8)
            bins[number] = list(zip(flat[::2], flat[1::2], strict=True))
            at += 8 + 16 * m
        n = struct.unpack_from("<i", data, at)[0]
        out.append((bins, list(struct.unpack_from(f"<{n}Q", data, at + 4))))
        at += 4 + 8 * n
    return out


# ---------------------------------------------------------------- source
@dataclass
class Chunk(InputPartition):
    start: int
    end: int


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.contig = options["path"], options.get("contig")
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", 1 << 29))

    def partitions(self) -> list[Chunk]:
        fs, path = files_at(self.path)
        names, first = read_header(fs, path)
        index, whole = read_index(fs, path), fs.get_file_info(path).size << 16
        if self.contig is None:
            cuts = sorted({o for _, linear in index for o in linear if o > first})
            found = [(a, b) for a, b in zip([first, *cuts], [*cuts, whole], strict=True)]
        elif self.contig not in names or self.start >= self.end:
            return [Chunk(0, 0)]
        else:
            bins, linear = index[names.index(self.contig)]
            least = linear[min(self.start >> WINDOW_SHIFT, len(linear) - 1)] if linear else 0
            found = sorted(c for b in bins_over(self.start, self.end) for c in bins.get(b, ()) if c[1] > least)
        out: list[Chunk] = []
        for a, b in found:
            # chunks that touch, and short ones side by side, are read together
            if out and a >> 16 <= (out[-1].end >> 16) + (1 << 16) and (max(b, out[-1].end) - out[-1].start) >> 16 <= PART_BYTES:
                out[-1].end = max(out[-1].end, b)
            else:
                out.append(Chunk(max(a, out[-1].end) if out else a, b))
        return [c for c in out if c.start < c.end] or [Chunk(0, 0)]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.end:
            return
        fs, path = files_at(self.path)
        names, _ = read_header(fs, path)
        schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for n, t in (x.split(" ") for x in READ_SCHEMA.split(", "))])
        with fs.open_input_file(path) as file:
            blocks, rows = Blocks(file, partition.start), []
            while (at := blocks.offset()) < partition.end:
                size = blocks.read(4)
                if len(size) < 4:
                    break
                row = unpack_record(blocks.read(struct.unpack("<i", size)[0]), at, names)
                if self.contig is not None and (row[3] != self.contig or row[4] >= self.end):
                    break  # sorted: nothing that follows lies in the range
                if self.contig is None or row[5] > self.start:
                    rows.append(row)
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


# ---------------------------------------------------------------- sink
@dataclass
class Part(WriterCommitMessage):
    """A part of the file: its blocks, and where its records lie in it (contig, bin) -> chunks, (contig, window) -> first offset."""

    task: int
    at: str
    size: int
    chunks: dict[tuple[int, int], list[list[int]]] = field(default_factory=dict)
    windows: dict[tuple[int, int], int] = field(default_factory=dict)


class BamWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.names, self.lengths = options["path"], options["contigs"].split(","), [int(x) for x in options["lengths"].split(",")]
        self.work = f"{self.path}.work-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, work = files_at(self.work)
        fs.create_dir(work, recursive=True)
        part, place = Part(context.partitionId(), f"{work}/{context.partitionId():06d}-{context.taskAttemptId()}", 0), {n: k for k, n in enumerate(self.names)}
        with fs.open_output_stream(part.at, compression=None, buffer_size=1 << 20) as out:
            data = bytearray()

            def flush(most: int) -> None:
                while len(data) > most:
                    block = pack_block(bytes(data[:BLOCK_BYTES]))
                    del data[:BLOCK_BYTES]
                    out.write(block)
                    part.size += len(block)

            for batch in iterator:
                for row in batch.to_pylist():
                    contig, start, end = place[row["contig"]], row["ref_start"], row["ref_start"] + max(1, span(row["cigar"]))
                    record = pack_record(row, contig)
                    if data and len(data) + len(record) > BLOCK_BYTES:
                        flush(0)  # records begin blocks where they can, so chunks are short
                    begin = part.size << 16 | len(data)
                    data += record
                    flush(BLOCK_BYTES - 1)
                    stop = part.size << 16 | len(data)
                    chunks = part.chunks.setdefault((contig, bin_of(start, end)), [])
                    if chunks and chunks[-1][1] == begin:
                        chunks[-1][1] = stop
                    else:
                        chunks.append([begin, stop])
                    for window in range(start >> WINDOW_SHIFT, (end - 1 >> WINDOW_SHIFT) + 1):
                        part.windows.setdefault((contig, window), begin)
            flush(0)
        return part

    def commit(self, messages: list[Part | None]) -> None:
        fs, path = files_at(self.path)
        text = "@HD\tVN:1.6\tSO:coordinate\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in zip(self.names, self.lengths, strict=True))
        head = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(self.names))
        for n, k in zip(self.names, self.lengths, strict=True):
            head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k)
        bins: list[dict[int, list]] = [{} for _ in self.names]
        windows: list[dict[int, int]] = [{} for _ in self.names]
        _, work = files_at(self.work)
        fs.create_dir(work, recursive=True)
        try:
            with fs.open_output_stream(f"{work}/whole", compression=None) as out:
                base = 0
                for k in range(0, len(head), BLOCK_BYTES):
                    block = pack_block(head[k : k + BLOCK_BYTES])
                    out.write(block)
                    base += len(block)
                for part in sorted((m for m in messages if m is not None), key=lambda m: m.task):
                    with fs.open_input_stream(part.at, compression=None) as file:
                        while block := file.read(COPY_BYTES):
                            out.write(block)
                    for (contig, number), chunks in part.chunks.items():
                        bins[contig].setdefault(number, []).extend((a + (base << 16), b + (base << 16)) for a, b in chunks)
                    for (contig, window), at in part.windows.items():
                        windows[contig].setdefault(window, at + (base << 16))
                    base += part.size
                out.write(END_BLOCK)
            with fs.open_output_stream(f"{work}/index", compression=None) as out:
                out.write(b"BAI\1" + struct.pack("<i", len(self.names)))
                for own, starts in zip(bins, windows, strict=True):
                    out.write(struct.pack("<i", len(own)))
                    for number, chunks in sorted(own.items()):
                        out.write(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
                    known, last = sorted(starts), max(starts, default=-1)
                    linear = [starts[known[min(bisect_left(known, w), len(known) - 1)]] for w in range(last + 1)]
                    out.write(struct.pack(f"<i{len(linear)}Q", len(linear), *linear))
            fs.move(f"{work}/index", f"{path}.bai")
            fs.move(f"{work}/whole", path)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow.fs import FileType

        fs, work = files_at(self.work)
        if fs.get_file_info(work).type == FileType.Directory:
            fs.delete_dir(work)


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "svloom_bam"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> BamReader:
        return BamReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> BamWriter:
        return BamWriter(dict(self.options))


def read_bam(spark: SparkSession, path: str, contig: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of READ_SCHEMA, of one contig or of the records over [start, end) of it. read_ordinal is a record's place in the file.

    Lengths and ends come from the alignment's operations.
    """
    spark.dataSource.register(BamSource)
    given = {k: str(v) for k, v in (("contig", contig), ("start", start), ("end", end)) if v is not None}
    return spark.read.format(BamSource.name()).option("path", path).options(**given).load()


def write_bam(reads: DataFrame, contigs: DataFrame, path: str) -> None:
    """Placed reads as one sorted and indexed file, in whole or not at all; contigs has contig, length, ord (a header's, few)."""
    spark = reads.sparkSession
    spark.dataSource.register(BamSource)
    head = contigs.select("contig", "length", "ord").orderBy("ord").collect()
    order = ["ord", "ref_start", "read_ordinal"]
    rows = reads.join(contigs.select("contig", "ord"), "contig").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(*NAMES)
    rows.write.format(BamSource.name()).mode("append").option("path", path).option("contigs", ",".join(r.contig for r in head)).option("lengths", ",".join(str(r.length) for r in head)).save()
