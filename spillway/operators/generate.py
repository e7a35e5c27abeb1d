"""Generators of test data: sequences, permutations, uniform random values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import dtype as dtype_of
from .verify import summary, write_hash


def sequence(spark: SparkSession, n: int, dtype: str = "u32") -> DataFrame:
    """value: the type's least value and those after it, n in all."""
    kind = dtype_of(dtype)
    if n > kind.most - kind.least + 1:
        raise ValueError(f"{kind.name} has no {n} distinct values")
    if kind.name == "u64" or kind.name == "i64" and n > 1 << 62:
        return spark.range(n).select((F.col("id").cast("decimal(20,0)") + F.lit(kind.least)).cast(kind.spark).alias("value"))
    return spark.range(n).select((F.col("id") + F.lit(kind.least)).cast(kind.spark).alias("value"))


def shuffle(df: DataFrame, seed: int) -> DataFrame:
    """A random permutation of df's rows; the same for the same seed and partitions."""
    return df.orderBy(F.rand(seed))


def uniform(spark: SparkSession, n: int, seed: int, dtype: str = "u32") -> DataFrame:
    """n independent values, uniform from 0 to the type's largest value."""
    kind = dtype_of(dtype)
    high = F.floor(F.rand(seed) * (1 << 32)).cast("long")
    if kind.most < 1 << 32:
        return spark.range(n).select(F.floor(F.rand(seed) * (kind.most + 1)).cast(kind.spark).alias("value"))
    low = F.floor(F.rand(seed + 1) * (1 << 32)).cast("long")
    if kind.name == "i64":
        return spark.range(n).select((F.shiftleft(high.bitwiseAND((1 << 31) - 1), 32) + low).alias("value"))
    return spark.range(n).select((high.cast("decimal(20,0)") * F.lit(1 << 32) + low).cast(kind.spark).alias("value"))


def write_test_data(spark: SparkSession, path: str, size: int, kind: str = "shuffle", dtype: str = "u32", seed: int = 1, hash_path: str | None = None, mode: str = "overwrite") -> str | None:
    """Write `size` bytes of test data; for a shuffled sequence also the checksum of it in order, returned in hex."""
    from ..sources import write_fixedbin

    n = size // dtype_of(dtype).width
    if kind == "random":
        if hash_path:
            raise ValueError("random data have no checksum that is known beforehand")
        write_fixedbin(uniform(spark, n, seed, dtype), path, dtype, mode=mode)
        return None
    if kind != "shuffle":
        raise ValueError(f"unknown kind {kind!r}; known: shuffle, random")
    values = sequence(spark, n, dtype)
    crc = summary(values, "value", dtype)["crc"]
    if hash_path:
        write_hash(hash_path, crc)
    write_fixedbin(shuffle(values, seed), path, dtype, mode=mode)
    return crc
