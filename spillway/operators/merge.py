"""Merges: ordered unions of chunks that keep duplicates, merges of sorted files without a shuffle, and the merge tree.

Frames are merged by range partitions. Files that are sorted already need none: each task bisects
them for its own equal share of the ranks, whatever values repeat, and merges the slices that it reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import open_fs
from ..sources.fixedbin import BATCH, input_files, read_fixedbin, to_arrow, write_fixedbin
from ..types import DType, dtype as dtype_of

#: Bytes that one task of a file merge reads and holds, on average.
SHARE_BYTES = 32 << 20


def kway_merge(chunks: list[DataFrame], *keys: str, spread: bool = False) -> DataFrame:
    """All rows of the chunks in the order of keys; spread deals rows of equal keys over partitions, in no order of their own."""
    if not chunks:
        raise ValueError("nothing to merge")
    return _ordered(reduce(DataFrame.unionByName, chunks), [F.col(k) for k in keys], spread)


def two_way_merge(first: DataFrame, second: DataFrame, key: str = "value", source: str = "src", spread: bool = True) -> DataFrame:
    """Rows of both in the order of key, with their source, 0 or 1; of equal keys the second's come first."""
    both = first.withColumn(source, F.lit(0).cast("long")).unionByName(second.withColumn(source, F.lit(1).cast("long")))
    return _ordered(both, [F.col(key), F.desc(source)], spread)


def _ordered(rows: DataFrame, order: list[Column], spread: bool) -> DataFrame:
    if not spread:
        return rows.orderBy(*order)
    return rows.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*order, "_tie").drop("_tie")


class _Sorted:
    """A sorted file, opened for bisection and slices."""

    def __init__(self, path: str, size: int, kind: DType, fs):
        self.file, self.n, self.kind = fs.open_input_file(path), size // kind.width, kind

    def slice(self, first: int, last: int) -> np.ndarray:
        width = self.kind.width
        return np.frombuffer(self.file.read_at((last - first) * width, first * width), self.kind.layout)

    def at_most(self, value: int, low: int, high: int) -> int:
        """How many records are at most value, known to lie in low .. high."""
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if int(self.slice(mid, mid + 1)[0]) <= value else (low, mid)
        return low


def cut(files: list[_Sorted], rank: int, kind: DType) -> list[int]:
    """Places in the files before which their `rank` least records lie; of equal ones those of earlier files come first."""
    if rank <= 0:
        return [0] * len(files)
    low, high, least, most = [0] * len(files), [f.n for f in files], kind.least, kind.most
    while least < most:
        mid = (least + most) // 2
        places = [f.at_most(mid, a, b) for f, a, b in zip(files, low, high, strict=True)]
        if sum(places) >= rank:
            most, high = mid, places
        else:
            least, low = mid + 1, places
    # least is the value at the rank; low: the records below it
    out, left = [], rank - sum(low)
    for a, b in zip(low, high, strict=True):
        take = min(left, b - a)
        out.append(a + take)
        left -= take
    return out


def merge_files(spark: SparkSession, paths: list[str], dtype: str = "u32", partitions: int | None = None) -> DataFrame:
    """The values of sorted files (or of folders of sorted files) in ascending order, in partitions of equal size, without a shuffle."""
    kind = dtype_of(dtype)
    inputs = [x for p in paths for x in input_files(p)]
    for path, size in inputs:
        if size % kind.width:
            raise ValueError(f"size of {path} is {size} bytes, no multiple of the {kind.width} bytes of {kind.name}")
    total, root = sum(n for _, n in inputs) // kind.width, paths[0] if paths else ""
    parts = partitions or max(spark.sparkContext.defaultParallelism, -(-total * kind.width // SHARE_BYTES))

    def merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in batch.column("id").to_pylist():
                fs = open_fs(root)[0]
                files = [_Sorted(p, n, kind, fs) for p, n in inputs]
                first, last = (cut(files, total * x // parts, kind) for x in (k, k + 1))
                values = np.concatenate([f.slice(a, b) for f, a, b in zip(files, first, last, strict=True)] or [np.zeros(0, kind.layout)])
                values = np.sort(values, kind="stable")
                for i in range(0, len(values), BATCH):
                    yield pa.RecordBatch.from_arrays([to_arrow(values[i : i + BATCH], kind)], ["value"])
                for f in files:
                    f.file.close()

    return spark.range(0, parts, 1, parts).mapInArrow(merge, f"value {kind.spark}")


def merge_by_tree(spark: SparkSession, source: str, work: str, base: int, dtype: str = "u32") -> tuple[DataFrame, int]:
    """The values of a folder of sorted files in order, merged level by level, `base` files to a node; and the levels.
    A node is a folder <level>_<id> below work with its sorted parts; nodes of one level do not depend on each other."""
    if base < 2:
        raise ValueError("a merge takes two inputs or more")
    now, level = [[p] for p, _ in input_files(source)], 0
    scheme = source.split("://")[0] + "://" if "://" in source else ""
    now = [[f"{scheme}{p}"] for x in now for p in x]
    while len(now) > 1:
        level += 1
        nodes = max(1, len(now) // base)
        up = []
        for i in range(nodes):
            members = now[i * base : (i + 1) * base if i < nodes - 1 else None]
            path = f"{work.rstrip('/')}/{level}_{i:x}"
            write_fixedbin(_merge_runs(spark, members, dtype), path, dtype)
            up.append([path])
        now = up
    return (read_fixedbin(spark, now[0][0], dtype) if now else spark.createDataFrame([], f"value {dtype_of(dtype).spark}")), level


def _merge_runs(spark: SparkSession, runs: list[list[str]], dtype: str) -> DataFrame:
    size = sum(n for r in runs for p in r for _, n in input_files(p))
    return merge_files(spark, [p for r in runs for p in r], dtype, max(1, -(-size // SHARE_BYTES)))


def tree_node(chunk: Column, chunks: Column, base: int) -> Column:
    """The node over a chunk: groups of `base`, and a shorter rest joins the last group."""
    return F.least(F.floor(chunk / base), F.greatest(F.floor(chunks / base), F.lit(1)) - 1).cast("long")


def merge_tree(spark: SparkSession, chunks: int, base: int) -> DataFrame:
    """All nodes of the merge tree over `chunks` sorted chunks: lvl, id, parent (null at the root), in merge order."""
    if base < 2:
        raise ValueError("a merge takes two inputs or more")
    levels, n, level = [], chunks, 0
    while n > 0:
        parents = 0 if n == 1 and level else max(1, n // base)
        ids = spark.range(n)
        parent = tree_node(F.col("id"), F.lit(n), base) if parents else F.lit(None).cast("long")
        levels.append(ids.select(F.lit(level).alias("lvl"), "id", parent.alias("parent")))
        n, level = parents, level + 1
    if not levels:
        return spark.createDataFrame([], "lvl int, id long, parent long")
    return reduce(DataFrame.unionByName, levels).orderBy("lvl", "id")
