"""What a radix pass over integers counts: bit lengths, the bins' shift, sizes and first places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At most 2^MAX_SPLITS bins; ranges of up to FINISHING bits finish in one pass; bins hold 2^MEAN values on average.
MAX_SPLITS = 11
FINISHING = 12
MEAN = 2


def bit_length(x: Column) -> Column:
    """Significant bits of a non-negative integer; 0 has none."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def log_divisor(count: int, span: int) -> int:
    """By how many bits values of a range `span` are shifted to their bin."""
    bits = span.bit_length()
    extra = bits - count.bit_length()
    if extra <= 0 and bits <= FINISHING:
        return 0
    return max(extra + MEAN, bits - MAX_SPLITS)


def bins(df: DataFrame, value: str = "value") -> tuple[DataFrame, int, int]:
    """(bin, n) of the values, with the shift and the first bin's number. Three numbers pass the driver."""
    least, most, n = df.agg(F.min(value), F.max(value), F.count("*")).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin long, n long"), 0, 0
    shift = log_divisor(n, most - least)
    first = least >> shift
    own = (F.shiftright(F.col(value).cast("long"), shift) - F.lit(first).cast("long")).alias("bin")
    return df.groupBy(own).agg(F.count("*").alias("n")), shift, first


def with_starts(sizes: DataFrame) -> DataFrame:
    """(bin, n) with each bin's first place. There are at most 2^MAX_SPLITS bins and a few, so one task orders them."""
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("start_pos", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
