"""Tables and files of a run in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new local folder where it is unset in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spillway-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if "://" in found or found.startswith("file:") else "file://" + found


_MADE: list[Scratch] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Folders that are made inside go at its end: for a step whose result is saved elsewhere by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        while len(_MADE) > before:
            _MADE.pop().drop()


def sweep() -> int:
    """Delete all folders that this process has made and not dropped; their number. Frames that still read them fail."""
    n = len(_MADE)
    while _MADE:
        _MADE.pop().drop()
    return n


class Scratch:
    """Tables and files of one run in a folder of its own below the shared folder.

    Tables are committed by Spark's own writer, so tasks that are run again after the loss of
    an executor leave no doubled rows. A result that is read lazily keeps its folder; it goes
    by drop(), at the end of a `temporary` block, by sweep(), or with the shared folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        _MADE.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _hadoop(self, uri: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def folder(self, name: str) -> str:
        """A new folder for files that tasks write themselves."""
        path, fs = self._hadoop(self.path(name))
        fs.mkdirs(path)
        return self.path(name)

    def save(self, df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
        """Write df once and return it read back: this cuts the lineage. group_bytes: a file's row groups, each of which writers and
        readers hold in memory, end there and are looked at after every row: for rows of megabytes."""
        writer = df.write
        if group_bytes:
            writer = writer.option("parquet.block.size", group_bytes).option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names or ("",):
            path, fs = self._hadoop(f"{self.root}/{name}".rstrip("/"))
            fs.delete(path, True)


def open_fs(uri: str):
    """(file system, path) of a folder or file, for bytes that Spark's readers and writers can't handle."""
    from pyarrow import fs

    if "://" not in uri:
        import os

        uri = "file://" + os.path.abspath(uri.removeprefix("file:"))
    return fs.FileSystem.from_uri(uri)
