"""The arithmetic of a sort in bounded memory, for reports and for the source's partitions."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import round_down
from ..types import Options, dtype

MIN_FAN_IN = 2


def thread_count() -> int:
    return os.cpu_count() or 2


def level0_bytes(size: int, threads: int, memory: int) -> int:
    """Bytes of a chunk before it is cut to whole records: a thread's share of memory, or half a thread's share of an input that fits."""
    return size // (2 * threads) if memory >= size else memory // threads


def chunk_bytes(size: int, width: int, threads: int, memory: int) -> int:
    """Bytes of a chunk of whole records, at least one."""
    return max(width, level0_bytes(size, threads, memory) // width * width)


def chunk_count(size: int, chunk: int) -> int:
    return -(-size // chunk) if size else 0


def fan_in(chunks: int, options: Options) -> int:
    """How many chunks a merge takes: all, a fixed number, or the root of their number that the tree's height gives."""
    if options.flat_merge:
        return max(MIN_FAN_IN, chunks)
    return max(MIN_FAN_IN, options.fan_in or round(chunks ** (1 / max(2, options.tree_height))))


@dataclass(frozen=True)
class SortPlan:
    threads: int
    input_bytes: int
    chunk_bytes: int
    chunks: int
    fan_in: int
    input_buffer: int
    output_buffer: int


def sort_plan(size: int, options: Options | None = None) -> SortPlan:
    """The plan of a run; an input buffer or output buffer under one record is an error."""
    options = options or Options()
    threads, width = options.threads or thread_count(), dtype(options.dtype).width
    chunk = chunk_bytes(size, width, threads, options.memory_bytes)
    n = chunk_count(size, chunk)
    ways = fan_in(n, options)
    share = options.memory_bytes // threads
    up = lambda x: -(-int(x) // width) * width
    into, out = up(share * options.io_ratio / ways), up(share * (1 - options.io_ratio))
    if share * options.io_ratio / ways < width or share * (1 - options.io_ratio) < width:
        raise ValueError("memory is too small for a record in each buffer")
    return SortPlan(threads, size, chunk, n, ways, into, out)


def chunk_plan(frame: DataFrame, memory: int, width: int) -> DataFrame:
    """threads, input_bytes to the chunks' size and number."""
    size, threads = F.col("input_bytes"), F.col("threads")
    l0 = F.when(F.lit(memory) >= size, F.call_function("div", size, threads * 2)).otherwise(F.call_function("div", F.lit(memory), threads))
    out = frame.withColumn("l0_bytes", l0.cast("long"))
    return out.select(threads.cast("long"), size.cast("long"), "l0_bytes", F.call_function("div", size, F.col("l0_bytes")).cast("long").alias("chunk_number"), round_down(F.col("l0_bytes"), width).cast("long").alias("chunk_bytes"))


def memory_plan(frame: DataFrame, memory: int, ratio: float = 0.5) -> DataFrame:
    """Each active thread's memory for reading, writing and both."""
    threads = F.col("threads")
    share = lambda x: F.call_function("div", F.lit(x).cast("long"), threads).cast("long")
    return frame.select(threads.cast("long"), share(int(memory * ratio)).alias("imem"), share(memory - int(memory * ratio)).alias("omem"), share(memory).alias("tmem"))


def grid(spark: SparkSession, threads: list[int], sizes: list[int] | None = None) -> DataFrame:
    """Every number of threads, with every size where there are some."""
    if sizes is None:
        return spark.createDataFrame([(t,) for t in threads], "threads long")
    return spark.createDataFrame([(t, s) for t in threads for s in sizes], "threads long, input_bytes long")
