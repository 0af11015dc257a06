"""Feature stores as array files: <stem>.npy (a row a window), <stem>_index.npy and <stem>_label.npy beside it.

The reader looks at the headers of the files alone and deals ranges of rows to partitions; a task seeks to its range in each of the three
files and reads no more than that, so a file of any size is read by many tasks and never as a whole. The writer streams the
rows of a stem into its files, which come under their names together, when all tasks are done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from svloom.sources.committed import files_at

SUFFIXES = ("_index", "_label", "_predict")
SCHEMA = "stem string, row long, index array<int>, features array<float>, label int"
#: Bytes of features of one partition, what the files of a stem count beside their bytes, and rows of one batch.
PART_BYTES, OPEN_BYTES, BATCH_ROWS = 64 << 20, 1 << 20, 256
#: The types that an index may have.
INDEX = {"int": np.dtype(np.int32), "bigint": np.dtype(np.int64)}


@dataclass(frozen=True)
class Header:
    """Where the rows of an array file begin, how many there are, and what a row is."""

    rows: int
    width: int
    dtype: np.dtype
    offset: int

    @classmethod
    def of(cls, fs, path: str) -> "Header":
        with fs.open_input_file(path) as file:
            version = np.lib.format.read_magic(file)
            shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
            if by_column or dtype.hasobject or not shape:
                raise ValueError(f"{path} is no array of rows")
            return cls(shape[0], int(np.prod(shape[1:], dtype=np.int64)), dtype, file.tell())

    def read(self, file, lo: int, hi: int) -> np.ndarray:
        each = self.width * self.dtype.itemsize
        file.seek(self.offset + lo * each)
        return np.frombuffer(file.read((hi - lo) * each), self.dtype).reshape(hi - lo, self.width)


@dataclass
class Rows(InputPartition):
    """A range of rows, and more of them where stores are small."""

    stem: str
    lo: int
    hi: int
    more: list[tuple[str, int, int]] = field(default_factory=list)


class ArraysReader(DataSourceReader):
    def __init__(self, path: str, index: str = "int"):
        self.path, self.index = path.rstrip("/"), INDEX[index]

    def partitions(self) -> list[Rows]:
        from pyarrow.fs import FileSelector

        fs, root = files_at(self.path)
        out, room = [], 0
        for info in sorted(fs.get_file_info(FileSelector(root, recursive=True)), key=lambda i: i.path):
            stem = info.path.removeprefix(root).lstrip("/").removesuffix(".npy")
            if not info.is_file or not info.path.endswith(".npy") or stem.endswith(SUFFIXES) or "/_work-" in info.path:
                continue
            head = Header.of(fs, info.path)
            size = max(1, head.width * head.dtype.itemsize)
            each = max(1, PART_BYTES // size)
            for lo in range(0, head.rows, each):
                hi = min(lo + each, head.rows)
                cost = OPEN_BYTES + (hi - lo) * size
                if not out or cost > room:
                    out.append(Rows(stem, lo, hi))
                    room = PART_BYTES
                else:
                    out[-1].more.append((stem, lo, hi))
                room -= cost
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        for stem, lo, hi in [(partition.stem, partition.lo, partition.hi), *partition.more]:
            if lo < hi:
                yield from self._range(stem, lo, hi)

    def _range(self, stem: str, begin: int, end: int) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        fs, root = files_at(self.path)
        paths = [f"{root}/{stem}{x}.npy" for x in ("", "_index", "_label")]
        there = [info.type == FileType.File for info in fs.get_file_info(paths)]
        heads = [Header.of(fs, p) if x else None for p, x in zip(paths, there, strict=True)]
        if any(h is not None and h.rows != heads[0].rows for h in heads):
            raise ValueError(f"the arrays of {stem} differ in rows")
        files = [fs.open_input_file(p) if x else None for p, x in zip(paths, there, strict=True)]
        try:
            for lo in range(begin, end, BATCH_ROWS):
                hi = min(lo + BATCH_ROWS, end)
                features, index, label = (h.read(f, lo, hi) if h is not None else None for h, f in zip(heads, files, strict=True))
                n = hi - lo
                if index is not None:
                    index, read = index.astype(self.index), index
                    if (index != read).any():
                        raise ValueError(f"the index of {stem} does not fit {self.index}")
                labels = pa.array(label.reshape(n, -1)[:, 0].astype(np.int32)) if label is not None else pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([stem] * n), pa.array(np.arange(lo, hi)), _lists(index) if index is not None else pa.nulls(n, pa.list_(pa.from_numpy_dtype(self.index))), _lists(features.astype(np.float32)), labels],
                    names=["stem", "row", "index", "features", "label"],
                )
        finally:
            for file in files:
                if file is not None:
                    file.close()


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


@dataclass
class Stored(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class ArraysWriter(DataSourceArrowWriter):
    """Rows (stem, n, index, features, label); those of a stem come one after the other, n is their number."""

    def __init__(self, path: str, dtype: str, index: str):
        self.path, self.dtype, self.index, self.work = path.rstrip("/"), np.dtype(dtype), INDEX[index], f"_work-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Stored:
        from pyspark import TaskContext

        fs, root = files_at(self.path)
        folder, out = f"{root}/{self.work}/{TaskContext.get().taskAttemptId()}", Stored()
        now, files, left = None, {}, 0

        def begin(stem: str, row: dict) -> None:
            for suffix, dtype, value in (("", self.dtype, row["features"]), ("_index", self.index, row["index"]), ("_label", np.dtype(np.uint8), row["label"])):
                if value is None:
                    continue
                at = f"{folder}/{stem}{suffix}.npy"
                fs.create_dir(at.rpartition("/")[0], recursive=True)
                files[suffix] = (fs.open_output_stream(at, compression=None, buffer_size=1 << 20), dtype)
                shape = (row["n"],) if suffix == "_label" else (row["n"], len(value))
                np.lib.format.write_array_header_1_0(files[suffix][0], {"descr": np.lib.format.dtype_to_descr(dtype), "fortran_order": False, "shape": shape})
                out.files.append((at, f"{root}/{stem}{suffix}.npy"))

        def end() -> None:
            for file, _ in files.values():
                file.close()
            files.clear()
            if left:
                raise ValueError(f"{left} rows of {now} are missing")

        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["stem"] != now:
                        end()
                        now, left = row["stem"], row["n"]
                        begin(now, row)
                    for suffix, (file, dtype) in files.items():
                        file.write(np.asarray(row[{"": "features", "_index": "index", "_label": "label"}[suffix]], dtype).tobytes())
                    left -= 1
        finally:
            end()
        return out

    def commit(self, messages: list[Stored | None]) -> None:
        fs, _ = files_at(self.path)
        for at, to in [x for m in messages if m is not None for x in m.files]:
            fs.create_dir(to.rpartition("/")[0], recursive=True)
            fs.move(at, to)
        self.abort(messages)

    def abort(self, messages: list[Stored | None]) -> None:
        from pyarrow.fs import FileType

        fs, root = files_at(self.path)
        if fs.get_file_info(f"{root}/{self.work}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{self.work}")


class ArraysSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "svloom_arrays"

    def schema(self) -> str:
        return SCHEMA.replace("array<int>", f"array<{self.options.get('index', 'int')}>")

    def reader(self, schema: StructType) -> ArraysReader:
        return ArraysReader(self.options["path"], self.options.get("index", "int"))

    def writer(self, schema: StructType, overwrite: bool) -> ArraysWriter:
        return ArraysWriter(self.options["path"], self.options.get("dtype", "float16"), schema["index"].dataType.elementType.simpleString())


def read_arrays(spark: SparkSession, path: str, index: str = "int") -> DataFrame:
    """stem, row, index, features, label of all feature stores below path; index and label are null where their files are not there.

    index: int or bigint, what the index is read as; an index that does not fit is an error.
    """
    spark.dataSource.register(ArraysSource)
    return spark.read.format(ArraysSource.name()).option("path", path).option("index", index).load()


def write_arrays(windows: DataFrame, path: str, order: list[str], dtype: str = "float16") -> None:
    """windows (stem, index, features, label and the columns of order) as array files, a store a stem, rows in order.

    An index of int or bigint is written as what it is.
    """
    spark = windows.sparkSession
    spark.dataSource.register(ArraysSource)
    sizes = windows.groupBy("stem").agg(F.count("*").alias("n"))
    rows = windows.join(sizes, "stem").repartition("stem").sortWithinPartitions("stem", *order).select("stem", "n", "index", "features", "label")
    rows.write.format(ArraysSource.name()).mode("append").option("path", path).option("dtype", dtype).save()
