"""Sorted runs from a stream: each micro-batch is sorted and written by itself, and the runs merge without a sort.

A batch that runs again after a failure replaces its own run, so the runs hold each value of the stream once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import merge_files
from ..operators.sort import global_sort
from ..scratch import open_fs
from ..sources import write_fixedbin


def write_runs(values: DataFrame, folder: str, checkpoint: str, dtype: str = "u32") -> StreamingQuery:
    """Start a query over what a stream of `value` has now: a folder run-<batch> of sorted parts for each batch that has rows."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write_fixedbin(global_sort(batch.select("value"), "value", spread=True), f"{folder}/run-{batch_id:012d}", dtype, mode="overwrite")

    return values.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_runs(spark: SparkSession, folder: str, dtype: str = "u32") -> DataFrame:
    """The values of all whole runs in ascending order."""
    from pyarrow.fs import FileSelector, FileType

    fs, local = open_fs(folder)
    names = sorted(x.base_name for x in fs.get_file_info(FileSelector(local, allow_not_found=True)) if x.type == FileType.Directory and x.base_name.startswith("run-") and ".staged-" not in x.base_name)
    return merge_files(spark, [f"{folder}/{x}" for x in names], dtype)
