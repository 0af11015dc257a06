"""WARC archives of pages with a two-level capture index.

Tasks write one gzip member per record and report (key, file, offset, length). Keys are URLs with the host
reversed, so captures of one site lie together. The index sorts the keys over range partitions into
compressed blocks; each index file ends in a sparse directory (first key, offset and length of every
block), and the catalogue holds the first key of every index file. A look-up searches the catalogue, then
the directory, reads one block by range, searches it, and reads one record by range.

Payloads of equal bytes, of at least min_bytes, are stored once: the row with the largest page_id is the
response, the others are revisit records that refer to it.

Defined cases: null html is an empty payload; a null URL has the empty key; a null page_id is kept as null
and refers or is referred to by it; rows that repeat the largest page_id are all responses; an empty table
gives an empty result; columns besides page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import io
import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from svloom.llm.common import BROADCAST_ROWS, Workspace, shared_fs, tasks_for

FILE_BYTES = 1 << 28
BLOCK_LINES = 2048
#: Look-ups, and bytes of records, of one task.
TASK_LOOKUPS, TASK_BYTES = 1 << 18, 1 << 26
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
STAMP = "1970-01-01T00:00:00Z"


def capture_key(url: str | None) -> str:
    """host labels reversed, then the rest: http://www.a.org/x?y is org,a,www)/x?y"""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return url or ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    return ",".join(reversed(rest[:end].lower().split("."))) + ")" + rest[end:]


# ---------------------------------------------------------------- records
def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _from_urn(urn: str) -> int | None:
    value = urn[len("<urn:page:") : -1]
    return int(value) if value else None


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One gzip member: a response with the payload, or a revisit with the HTTP head alone (refers_to: (page_id,))."""
    kind, block = ("revisit", HTTP_HEAD) if refers_to else ("response", HTTP_HEAD + payload)
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {target}", f"WARC-Date: {STAMP}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to:
        lines += [f"WARC-Refers-To: {_urn(refers_to[0])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


# ---------------------------------------------------------------- index files
def pack_index(lines: list[tuple[str, str, int, int]], block_lines: int = BLOCK_LINES) -> tuple[bytes, int]:
    """Sorted (key, file, offset, length) lines as compressed blocks and their directory; the last 8 bytes tell where it begins."""
    out, directory = io.BytesIO(), []
    for k in range(0, len(lines), block_lines):
        part = lines[k : k + block_lines]
        packed = zlib.compress("\n".join(f"{_quote(key)}\t{file}\t{offset}\t{length}" for key, file, offset, length in part).encode(), 6)
        directory.append(f"{_quote(part[0][0])}\t{out.tell()}\t{len(packed)}")
        out.write(packed)
    start = out.tell()
    out.write(zlib.compress("\n".join(directory).encode()))
    out.write(struct.pack("<Q", start))
    return out.getvalue(), len(directory)


def _quote(key: str) -> str:
    return key.replace("%", "%25").replace("\t", "%09").replace("\n", "%0A")


def _unquote(key: str) -> str:
    return key.replace("%0A", "\n").replace("%09", "\t").replace("%25", "%")


class IndexFile:
    """An index file by range reads: the directory once, then one block for each look-up."""

    def __init__(self, path: str):
        filesystem, local = shared_fs(path)
        self.file = filesystem.open_input_file(local)
        size = self.file.size()
        (start,) = struct.unpack("<Q", self._range(size - 8, 8))
        rows = [x.split("\t") for x in zlib.decompress(self._range(start, size - 8 - start)).decode().split("\n")]
        self.blocks = [(_unquote(k), int(a), int(n)) for k, a, n in rows]
        self.keys = [b[0] for b in self.blocks]
        self.last: tuple[int, list] = (-1, [])

    def _range(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def block(self, k: int) -> list[tuple[str, str, int, int]]:
        _, start, length = self.blocks[k]
        rows = (x.split("\t") for x in zlib.decompress(self._range(start, length)).decode().split("\n"))
        return [(_unquote(key), file, int(a), int(n)) for key, file, a, n in rows]

    def find(self, key: str) -> list[tuple[str, str, int, int]]:
        """All captures of a key: from the last block that begins before it, as far as it goes.

        The block that was searched last stays unpacked, as look-ups come in the order of their keys.
        """
        out, k = [], max(0, bisect.bisect_left(self.keys, key) - 1)
        while k < len(self.blocks) and self.keys[k] <= key:
            if self.last[0] != k:
                self.last = k, self.block(k)
            rows = self.last[1]
            at = bisect.bisect_left(rows, (key,))
            while at < len(rows) and rows[at][0] == key:
                out.append(rows[at])
                at += 1
            k += 1
        return out

    def close(self) -> None:
        self.file.close()


def read_record(file: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    filesystem, local = shared_fs(file)
    with filesystem.open_input_file(local) as f:
        f.seek(offset)
        return parse_record(f.read(length))


# ---------------------------------------------------------------- Spark jobs
def with_roles(pages: DataFrame, min_bytes: int, space: Workspace) -> DataFrame:
    """page_id, url, html, digest (hex), refers_to (null for responses), is_revisit.

    Repeated digests are told from narrow rows. Up to BROADCAST_ROWS of them are sent to every task, so pages are not
    shuffled at all; more are joined with the narrow rows first, and pages then with the revisits by page_id and digest.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    narrow = rows.filter(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    large = narrow.groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").select("d", "last")
    large = space.save(large, "repeated")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    if large.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(large), F.col("digest") == F.col("d"), "left")
    else:
        revisits = narrow.join(large, F.col("digest") == F.col("d")).filter(revisit).select(F.col("page_id").alias("p"), "d", "last").distinct()
        joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    return joined.select("page_id", "url", "html", "digest", F.coalesce(revisit, F.lit(False)).alias("is_revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, space: Workspace, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write WARC files into a folder of space; returns a row for each capture: key, file, offset, length.

    An attempt writes files of its own name; only those that a successful attempt reports are read.
    """

    folder = space.folder("archives")

    def write(batches):
        task, seq, out, path, size = TaskContext.get(), 0, None, "", 0
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        filesystem, root = shared_fs(folder)
        filesystem.create_dir(root, recursive=True)
        for batch in batches:
            found = []
            columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), *(batch.column(k).to_pylist() for k in (3, 4, 5))]
            for page_id, url, html, digest, is_revisit, refers_to in zip(*columns, strict=True):
                if out is None or size >= file_bytes:
                    if out is not None:
                        out.close()
                    path = f"{name}-{seq:04d}.warc.gz"
                    out, seq, size = filesystem.open_output_stream(shared_fs(path)[1], compression=None), seq + 1, 0
                data = record_bytes(page_id, url, html.as_py(), base64.b32encode(bytes.fromhex(digest)).decode(), (refers_to,) if is_revisit else None)
                out.write(data)
                found.append((capture_key(url), path, size, len(data)))
                size += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return with_roles(pages, min_bytes, space).mapInArrow(write, "key string, file string, offset long, length long")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures into index files; returns the catalogue: first_key, last_key, index_file, n_blocks, n_captures."""

    def write(batches):
        task, seq, lines = TaskContext.get(), 0, []

        def flush():
            nonlocal lines, seq
            path = f"{folder}/index-{task.partitionId():06d}-{task.taskAttemptId()}-{seq:04d}.idx"
            filesystem, local = shared_fs(path)
            filesystem.create_dir(local.rpartition("/")[0], recursive=True)
            data, n_blocks = pack_index(lines)
            with filesystem.open_output_stream(local, compression=None) as out:
                out.write(data)
            row = {"first_key": [lines[0][0]], "last_key": [lines[-1][0]], "index_file": [path], "n_blocks": [n_blocks], "n_captures": [len(lines)]}
            lines, seq = [], seq + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            lines += zip(*(c.to_pylist() for c in batch.columns), strict=True)
            while len(lines) >= 512 * BLOCK_LINES:
                rest, lines = lines[512 * BLOCK_LINES :], lines[: 512 * BLOCK_LINES]
                yield flush()
                lines = rest
        if lines:
            yield flush()

    ordered = captures.select("key", "file", "offset", "length").repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return ordered.mapInArrow(write, "first_key string, last_key string, index_file string, n_blocks long, n_captures long")


def index_entries(catalogue: DataFrame) -> DataFrame:
    """Every capture, from the index files' blocks: a full listing."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                index = IndexFile(path)
                for k in range(len(index.blocks)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index.block(k), strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])

    return catalogue.select("index_file").repartition(max(1, catalogue.count())).mapInArrow(read, "key string, file string, offset long, length long")


RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(entries: DataFrame) -> DataFrame:
    """The records at (file, offset, length), each by its range, in ascending order within pieces of files.

    The digest of a response is computed from the payload as read.
    """
    total = entries.agg(F.count("*"), F.sum("length")).first()
    n_tasks = tasks_for(entries.sparkSession, total[1] or 0, TASK_BYTES, max(1, total[0]))

    def read(batches):
        opened = {}
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path not in opened:
                    for f in opened.values():
                        f.close()
                    filesystem, local = shared_fs(path)
                    opened = {path: filesystem.open_input_file(local)}
                opened[path].seek(offset)
                headers, payload = parse_record(opened[path].read(length))
                kind = headers["WARC-Type"]
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" else headers["WARC-Payload-Digest"].removeprefix("sha1:")
                n = len(payload) if kind == "response" else int(headers["WARC-Payload-Length"])
                rows.append((_from_urn(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], n, digest, kind, _from_urn(headers["WARC-Refers-To"]) if kind == "revisit" else None))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    piece = F.floor(F.col("offset") / (TASK_BYTES // 8))
    return entries.select("file", "offset", "length").repartition(n_tasks, "file", piece).sortWithinPartitions("file", "offset").mapInArrow(read, RECORD_SCHEMA)


def lookup(urls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """key, file, offset, length of every capture of the URLs' keys: catalogue, directory, block, each by binary search.

    Look-ups are sorted by key over tasks, so a task opens neighbouring index files and unpacks a block once. A key
    meets an index file only where it lies between the file's first and last key. Every task is sent the catalogue,
    one row for each index file of a million captures. URLs that share a key are one look-up.
    """
    files = [tuple(r) for r in catalogue.select("first_key", "last_key", "index_file").orderBy("first_key").toLocalIterator()]
    captures = catalogue.agg(F.sum("n_captures")).first()[0] or 0
    n_tasks = tasks_for(urls.sparkSession, captures, TASK_LOOKUPS, max(1, captures // BLOCK_LINES))

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u) for u in batch.column(0).to_pylist()], pa.string())], names=["key"])

    def find(batches):
        first, opened = [f[0] for f in files], {}
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                k = max(0, bisect.bisect_left(first, key) - 1)
                while k < len(files) and first[k] <= key:
                    if key <= files[k][1]:
                        name = files[k][2]
                        if name not in opened:
                            if len(opened) > 8:
                                opened.pop(next(iter(opened))).close()
                            opened[name] = IndexFile(name)
                        rows += opened[name].find(key)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "file", "offset", "length"])

    wanted = urls.select("url").distinct().mapInArrow(keys, "key string").distinct()
    return wanted.repartitionByRange(n_tasks, "key").sortWithinPartitions("key").mapInArrow(find, "key string, file string, offset long, length long")


def archive_pages(pages: DataFrame, min_bytes: int = 0, space: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """Write archives and index of pages; returns (catalogue, the pages' records, looked up by URL in the index and read by range)."""
    space = space or Workspace(pages.sparkSession, "warc")
    captures = space.save(write_archives(pages, space, min_bytes), "captures")
    catalogue = space.save(write_index(captures, space.folder("index")), "catalogue")
    return catalogue, read_records(space.save(lookup(pages, catalogue), "entries"))
