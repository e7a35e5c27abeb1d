"""What the operators of this package share: scratch tables, table paths, skew-safe lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, open_fs, shared_dir

__all__ = ["BROADCAST_BYTES", "Scratch", "claim", "doc_bucket", "open_fs", "shared_dir", "shuffle_partitions", "skew_lookup", "table"]

#: Sides up to this many bytes are broadcast; larger ones go through a shuffle.
BROADCAST_BYTES = 16 << 20

#: Rows of one key that one task takes. A key with more is hot: its rows are dealt over as many tasks as that makes.
TASK_ROWS = 250_000

#: Hot keys hold at least this part of the rows, or TASK_ROWS, whichever is less; but never under LEAST_ROWS.
HOT_PART = 0.005
LEAST_ROWS = 1_000

#: There are at most so many hot keys, whatever the rows: beyond that, a hot key holds more.
MOST_HOT = 100_000


_OWNER: list = [None, None]


def claim(owner: object, forget: Callable[[], object]) -> None:
    """Say that owner's memo is in use in this worker process. A worker serves many stages; the memo
    of another owner is emptied, so that one at a time takes memory."""
    if _OWNER[0] is not owner:
        if _OWNER[1]:
            _OWNER[1]()
            _give_back()
        _OWNER[:] = [owner, forget]


def _give_back() -> None:
    """Return what is free to the system: allocators keep it else."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_bucket(doc_id: str = "doc_id", modulus: int = 4) -> Column:
    """crc32 of the id as text, modulo; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def skew_lookup(big: DataFrame, small: DataFrame, key: str, columns: list[str], rows: str, total: int, row_key: Column, size: int | None = None) -> DataFrame:
    """big left-joined to small on key, where one key may hold a large part of big.

    small has one row a key; its column `rows` tells how many rows of big hold that key, of
    `total`. If small has at most BROADCAST_BYTES (size: its bytes, where known) it is broadcast.
    Else big is shuffled by the key and a salt. Hot keys, of which there are at most MOST_HOT, are
    broadcast with their number of salts alone, a hundred bytes or so each: as row_key falls, their rows go to one of the salts, and small
    has their row once for each. row_key also spreads the rows that need no partner.
    """
    if size is not None and size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small.select(key, *columns)), key, "left")
    least = max(LEAST_ROWS, min(TASK_ROWS, int(total * HOT_PART)), total // MOST_HOT)
    # a key of a part of the rows gets as many salts as tasks share that part, one of many rows as its rows need
    salts = F.greatest(F.ceil(F.col(rows) / least), F.lit(1)).cast("int")
    hot = small.filter(F.col(rows) >= least).select(F.col(key), salts.alias("_salts"))
    dealt = small.withColumn("_s", F.explode(F.sequence(F.lit(0), F.when(F.col(rows) >= least, salts - 1).otherwise(0)))).select(key, F.col("_s").cast("long").alias("_s"), *columns)
    alone = -1 - F.pmod(F.xxhash64(row_key), F.lit(1 << 30))
    spread = F.when(F.col(key).isNull(), alone).when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(row_key), F.col("_salts"))).otherwise(F.lit(0))
    out = big.join(F.broadcast(hot), key, "left").withColumn("_s", spread.cast("long")).join(dealt, [key, "_s"], "left")
    return out.select(*[F.col(c) for c in big.columns], *columns)
