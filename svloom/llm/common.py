"""Shared folder, written tables and file access for the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A session on one machine that names none is given a temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


#: Hadoop's scheme of a store to pyarrow's.
STORES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "gcs": "gs"}


#: A row group and a page for each row of megabytes. Neither their least and largest values nor a dictionary are kept, as a writer would
#: hold them until its file ends.
LARGE_ROWS = {
    "parquet.block.size": 1 << 22, "parquet.page.size": 1 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1,
    "parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false",
}


class Workspace:
    """Written tables of one run below the shared folder; they cut lineage and survive executors.

    The tables that an operator's result reads stay until its workspace is closed. Who wants them gone gives the
    operator a workspace of their own, `with Workspace(spark, name) as space`, and writes the result within it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = f"svloom-{name}-{uuid.uuid4().hex[:12]}"
        self.path = f"{shared_root(spark)}/{self.name}"
        self._n = 0

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Delete all tables and files of this run."""
        self.drop(self.path)

    def folder(self, name: str) -> str:
        """A new sub-folder for files that tasks write themselves."""
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None, large_rows: bool = False) -> DataFrame:
        """Write df as Parquet and read it again, with the lineage cut.

        large_rows: for rows of megabytes, of which Parquet would hold a hundred before it looks at their size.
        """
        path = self.folder(name)
        writer = df.write.option("compression", "zstd")
        writer = writer.options(**LARGE_ROWS) if large_rows else writer
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._svloom_path = path
        return out

    def drop(self, df: DataFrame | str) -> None:
        """Delete a table that is no longer read."""
        path = df if isinstance(df, str) else df._svloom_path
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def shared_fs(uri: str):
    """The pyarrow file system of a folder in the shared store, and the folder's path in it.

    Hadoop's names of object stores are given as pyarrow knows them; hdfs and viewfs addresses go through libhdfs.
    """
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    if sep:
        uri = f"{STORES.get(scheme, scheme)}://{rest}"
    return fs.FileSystem.from_uri(uri if sep or uri.startswith(("/", "file:")) else f"/{uri}")


def write_whole(uri: str, parts) -> int:
    """Write the byte strings of parts to one file; it appears under its name only when it is whole."""
    filesystem, path = shared_fs(uri.rpartition("/")[0])
    filesystem.create_dir(path, recursive=True)
    target, size = f"{path}/{uri.rpartition('/')[2]}", 0
    with filesystem.open_output_stream(f"{target}.part", compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    filesystem.move(f"{target}.part", target)
    return size


def tasks_for(spark: SparkSession, amount: int, each: int, most: int) -> int:
    """Tasks for so much work at `each` a task: all cores are used where there are units enough, `most` tasks at most."""
    return max(1, min(most, max(-(-amount // each), 2 * spark.sparkContext.defaultParallelism)))


#: Rows of a few numbers each that are sent to every task at most (tens of MB).
BROADCAST_ROWS = 1_000_000


def small(table: DataFrame) -> DataFrame:
    """A written table with a broadcast hint if it has at most BROADCAST_ROWS rows, else as it is, to be shuffled."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def text_hash(text: Column) -> Column:
    """What a text is known by, beside its doc_id; null is as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df has not."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name
