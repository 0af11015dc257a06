"""Text files that appear whole or not at all: a sink of rows (file, line) in the order in which they come.

Tasks write a part for each file whose lines they have, under a name of their attempt. The commit puts the parts of a file
together in the order of the tasks, block by block, and renames the files only when all of them are whole. A job that fails, or a commit that
does, leaves nothing under the files' names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

COPY_BYTES = 1 << 23
#: Hadoop's scheme of a store to pyarrow's.
STORES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "gcs": "gs"}


def files_at(uri: str):
    """The pyarrow file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    if sep:
        uri = f"{STORES.get(scheme, scheme)}://{rest}"
    return fs.FileSystem.from_uri(uri if sep or uri.startswith(("/", "file:")) else f"/{uri}")


@dataclass
class Parts(WriterCommitMessage):
    """What a task has written: (file, path of the part, lines)."""

    task: int
    written: list[tuple[str, str, int]] = field(default_factory=list)


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.work = path.rstrip("/"), f"_work-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = files_at(self.path)
        folder = f"{root}/{self.work}/{context.partitionId():06d}-{context.taskAttemptId()}"
        out, parts = None, Parts(context.partitionId())
        try:
            for batch in iterator:
                for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not parts.written or parts.written[-1][0] != name:
                        if out is not None:
                            out.close()
                        fs.create_dir(folder, recursive=True)
                        at = f"{folder}/{len(parts.written):06d}"
                        out = fs.open_output_stream(at, compression=None, buffer_size=1 << 20)
                        parts.written.append((name, at, 0))
                    out.write(line.encode() + b"\n")
                    parts.written[-1] = (*parts.written[-1][:2], parts.written[-1][2] + 1)
        finally:
            if out is not None:
                out.close()
        return parts

    def commit(self, messages: list[Parts | None]) -> None:
        fs, root = files_at(self.path)
        whole: dict[str, list[str]] = {}
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for name, at, _ in message.written:
                whole.setdefault(name, []).append(at)
        try:
            for name, parts in whole.items():
                with fs.open_output_stream(f"{root}/{self.work}/{name}", compression=None) as out:
                    for at in parts:
                        with fs.open_input_stream(at, compression=None) as part:
                            while block := part.read(COPY_BYTES):
                                out.write(block)
            for name in whole:
                fs.move(f"{root}/{self.work}/{name}", f"{root}/{name}")
        finally:
            self._clean()

    def abort(self, messages: list[Parts | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        from pyarrow.fs import FileType

        fs, root = files_at(self.path)
        if fs.get_file_info(f"{root}/{self.work}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{self.work}")


class LinesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "svloom_lines"

    def writer(self, schema: StructType, overwrite: bool) -> LinesWriter:
        if schema.names != ["file", "line"]:
            raise ValueError("rows of file and line are written")
        return LinesWriter(self.options["path"])


def write_lines(rows: DataFrame, path: str) -> None:
    """Rows (file, line) to files below path; those of a file lie together and in order over the partitions of rows."""
    spark = rows.sparkSession
    spark.dataSource.register(LinesSource)
    rows.select("file", "line").write.format(LinesSource.name()).mode("append").option("path", path).save()
