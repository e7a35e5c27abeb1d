"""Global and per-chunk sorts, positions in the order, and the choice of the sort's algorithm."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..types import ALGORITHMS

#: Row numbers of a partition lie in the low bits of Spark's increasing id, the partition's above.
_BITS = 33


@contextmanager
def sort_algorithm(spark: SparkSession, algorithm: str = "radix"):
    """Sorts that run inside use radix, or for heap and std the comparison sort. Results are the same."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {', '.join(ALGORITHMS)}")
    name = "spark.sql.sort.enableRadixSort"
    before = spark.conf.get(name)
    spark.conf.set(name, str(algorithm == "radix").lower())
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _order(key: str | Column, ascending: bool) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return c.asc_nulls_last() if ascending else c.desc_nulls_last()


def global_sort(df: DataFrame, *keys: str | Column, ascending: bool = True, spread: bool = False) -> DataFrame:
    """df in the order of keys, by range partitions; nulls last.

    spread deals rows of equal keys over partitions by a row number behind the keys: for inputs
    where one key may hold a large part of the rows.
    """
    order = [_order(k, ascending) for k in keys or df.columns]
    if not spread:
        return df.orderBy(*order)
    return df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*order, "_tie").drop("_tie")


def shifted_sort(df: DataFrame, key: str, shift: int, *ties: str) -> DataFrame:
    """df in the order of key shifted right by `shift` bits, then of ties, else of the key."""
    return df.orderBy(F.shiftright(key, shift), *(ties or (key,)))


def chunk_sort(df: DataFrame, chunk: str, *keys: str, partitions: int | None = None) -> DataFrame:
    """Each chunk sorted for itself; a chunk lies in one partition, and chunks there follow each other."""
    by = df.repartition(partitions, chunk) if partitions else df.repartition(chunk)
    return by.sortWithinPartitions(chunk, *keys)


def with_chunk_position(df: DataFrame, chunk: str, *keys: str, name: str = "pos") -> DataFrame:
    """df with each row's place from 0 in its chunk's order. Chunks have a bounded size."""
    by = Window.partitionBy(chunk).orderBy(*keys)
    return df.withColumn(name, (F.row_number().over(by) - 1).cast("long"))


def with_position(ordered: DataFrame, name: str = "pos") -> DataFrame:
    """A globally sorted frame with each row's place from 0.

    The frame is written once, as range bounds are sampled anew by each run. Places are the sum of a
    partition's first place, from the partitions' counts, and the row's place in it; no row
    passes a single task. A count a partition passes the driver.
    """
    spark = ordered.sparkSession
    numbered = Scratch(spark, "order").save(ordered.withColumn("_id", F.monotonically_increasing_id()), "rows")
    counts = numbered.groupBy(F.shiftright("_id", _BITS).alias("part")).agg(F.count("*").alias("n")).collect()
    first, offsets = 0, []
    for part, n in sorted((r["part"], r["n"]) for r in counts):
        offsets.append((part, first))
        first += n
    places = spark.createDataFrame(offsets, "_part long, _first long")
    joined = numbered.withColumn("_part", F.shiftright("_id", _BITS)).join(F.broadcast(places), "_part")
    row = F.col("_id").bitwiseAND((1 << _BITS) - 1)
    return joined.select((F.col("_first") + row).alias(name), *[c for c in ordered.columns])


def sort_with_position(df: DataFrame, *keys: str | Column, ascending: bool = True, name: str = "pos", spread: bool = False) -> DataFrame:
    return with_position(global_sort(df, *keys, ascending=ascending, spread=spread), name)


def array_sort_by(values: Column, less) -> Column:
    """An array sorted by a comparison: less(a, b) is a Boolean column."""
    return F.array_sort(values, lambda a, b: F.when(less(a, b), -1).when(less(b, a), 1).otherwise(0))


def sort_file(spark: SparkSession, source: str, target: str, options=None, assemble: bool = True, mode: str = "overwrite") -> None:
    """A file of fixed-width integers to an ascending file of equal size; the input stays as it is.

    With options.skip_sort the input's files are sorted already, each by itself, and are merged without a sort. assemble copies
    the sorted parts into one file, which the driver does alone: for outputs of more than one writer can copy, leave the parts.
    """
    from ..plans.planning import chunk_bytes
    from ..sources import read_fixedbin, write_fixedbin
    from ..sources.fixedbin import input_files
    from ..types import Options, dtype
    from .merge import merge_files

    options = options or Options()
    if options.skip_sort:
        write_fixedbin(merge_files(spark, [source], options.dtype), target, options.dtype, assemble, mode)
        return
    size = sum(n for _, n in input_files(source))
    values = read_fixedbin(spark, source, options.dtype, chunk_bytes(size, dtype(options.dtype).width, spark.sparkContext.defaultParallelism, options.memory_bytes))
    with sort_algorithm(spark, options.algorithm):
        write_fixedbin(global_sort(values, "value", spread=True), target, options.dtype, assemble, mode)
