"""Verification: order, sizes, checksums and extremes, from one row a partition."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixedbin import from_arrow
from ..types import dtype as dtype_of
from . import crc64 as c

_PARTIAL = "part int, n long, first decimal(20,0), last decimal(20,0), inversions long, crc binary, bytes long"


def partials(ordered: DataFrame, value: str = "value", dtype: str = "u32") -> DataFrame:
    """One row for each partition of an ordered frame: count, first and last value, falls, checksum, bytes.

    The order survives: rows are read as their partition has them.
    """
    kind = dtype_of(dtype)

    def scan(it):
        from pyspark import TaskContext

        n, first, last, falls, crc = 0, None, None, 0, 0
        for batch in it:
            values = from_arrow(batch.column(0), kind)
            if not len(values):
                continue
            falls += int((values[1:] < values[:-1]).sum()) + int(last is not None and values[0] < last)
            first, last = values[0] if first is None else first, values[-1]
            crc = c.crc64(values.tobytes(), crc)
            n += len(values)
        big = lambda x: pa.array([None if x is None else int(x)], pa.decimal128(20, 0))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), big(first), big(last), pa.array([falls], pa.int64()), pa.array([crc.to_bytes(8, "little")], pa.binary()), pa.array([n * kind.width], pa.int64())], [x.split()[0] for x in _PARTIAL.split(", ")])

    return ordered.select(value).mapInArrow(scan, _PARTIAL)


def summary(ordered: DataFrame, value: str = "value", dtype: str = "u32") -> dict:
    """n, bytes, inversions, is_sorted and crc of an ordered frame. A row a partition passes the driver."""
    n, size, falls, crc, last = 0, 0, 0, 0, None
    for r in sorted(partials(ordered, value, dtype).collect(), key=lambda r: r["part"]):
        if not r["n"]:
            continue
        falls += r["inversions"] + int(last is not None and r["first"] < last)
        last = r["last"]
        crc = c.combine(crc, int.from_bytes(r["crc"], "little"), r["bytes"])
        n, size = n + r["n"], size + r["bytes"]
    return {"n": n, "bytes": size, "inversions": falls, "is_sorted": falls == 0, "crc": c.hex64(crc)}


def is_sorted(df: DataFrame, position: str, value: str, dtype: str = "i64") -> DataFrame:
    """n, inversions and is_sorted of the values in the order of their positions."""
    spark = df.sparkSession
    got = summary(df.select(position, F.col(value).cast("long").alias("value")).orderBy(position), "value", dtype)
    return spark.createDataFrame([(got["n"], got["inversions"], got["is_sorted"])], "n long, inversions long, is_sorted boolean")


def crc_frame(ordered: DataFrame, value: str = "value", dtype: str = "u32") -> DataFrame:
    return ordered.sparkSession.createDataFrame([(summary(ordered, value, dtype)["crc"],)], "crc string")


def crc_of_file(spark: SparkSession, path: str, dtype: str = "u32") -> str:
    """The checksum of a file, or of a folder's parts in name order."""
    from ..sources import read_fixedbin

    return summary(read_fixedbin(spark, path, dtype), "value", dtype)["crc"]


def size_check(spark: SparkSession, before: DataFrame, after: DataFrame, width: int) -> DataFrame:
    """Bytes of both frames' records, and whether they are equal."""
    a = before.agg((F.count("*") * width).alias("input_bytes"), F.lit(1).alias("k"))
    b = after.agg((F.count("*") * width).alias("output_bytes"), F.lit(1).alias("k"))
    return a.join(b, "k").select("input_bytes", "output_bytes", (F.col("input_bytes") == F.col("output_bytes")).alias("sizes_match"))


def extremes(df: DataFrame, value: str = "value") -> DataFrame:
    return df.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count("*").alias("n"))


def write_hash(path: str, crc: str) -> None:
    """The sidecar of a checksum: its eight bytes."""
    from ..scratch import open_fs

    fs, local = open_fs(path)
    with fs.open_output_stream(local, compression=None) as out:
        out.write(int(crc, 16).to_bytes(8, "little"))


def read_hash(path: str) -> str:
    from ..scratch import open_fs

    fs, local = open_fs(path)
    with fs.open_input_stream(local, compression=None) as f:
        raw = f.read(9)
    if len(raw) != 8:
        raise ValueError(f"{path} holds no checksum of 8 bytes")
    return c.hex64(int.from_bytes(raw, "little"))


def check_file(spark: SparkSession, source: str, target: str, dtype: str = "u32", hash_path: str | None = None) -> dict:
    """Whether target is what a sort of source should give: equal size and ascending, or equal to the kept checksum."""
    from ..sources import read_fixedbin
    from ..sources.fixedbin import input_files

    if hash_path:
        want, got = read_hash(hash_path), crc_of_file(spark, target, dtype)
        return {"ok": want == got, "expected": want, "actual": got}
    sizes = [sum(n for _, n in input_files(p)) for p in (source, target)]
    found = summary(read_fixedbin(spark, target, dtype), "value", dtype)
    return {"ok": sizes[0] == sizes[1] and found["is_sorted"], "sizes": sizes, "inversions": found["inversions"]}


