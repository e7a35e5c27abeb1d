"""Headerless files of little-endian fixed-width integers, as a Spark data source "fixedbin".

Options: path (a file, or a folder of part files that are read in name order), dtype, chunkBytes
(bytes of a partition), position (true: add `pos`, the record's place in the whole input), assemble
(writing; true: one file instead of a folder). Rows are never null.

Reading never changes the input. A missing path, or a size that is no multiple of the record's
width, is an error before any task runs; an empty file has no rows. Each task writes a file of its own
attempt; the commit moves those of the attempts that count to part-<partition>, so parts in name order
are the rows in partition order.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..scratch import open_fs
from ..types import DType, dtype

CHUNK_BYTES = 128 << 20

#: Records in an Arrow batch.
BATCH = 1 << 20


def to_arrow(values: np.ndarray, kind: DType) -> pa.Array:
    target = {"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "tinyint": pa.int8(), "decimal(20,0)": pa.decimal128(20, 0)}[kind.spark]
    return pa.array(values).cast(target)


def from_arrow(column: pa.Array, kind: DType) -> np.ndarray:
    """Values as they lie in the file; nulls and values that the type can't hold are errors."""
    if column.null_count:
        raise ValueError("fixedbin holds no nulls")
    try:
        return np.asarray(column.cast({"<u1": pa.uint8(), "<u2": pa.uint16(), "<u4": pa.uint32(), "<u8": pa.uint64(), "<i1": pa.int8(), "<i2": pa.int16(), "<i4": pa.int32(), "<i8": pa.int64()}[kind.layout])).astype(kind.layout, copy=False)
    except pa.ArrowInvalid as e:
        raise ValueError(f"a value does not fit {kind.name}: {e}") from e


@dataclass
class Chunk(InputPartition):
    """Bytes of one file; first: the place of its first record in the whole input."""

    path: str
    offset: int
    size: int
    first: int


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    records: int


def input_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the input's files in name order."""
    from pyarrow.fs import FileSelector, FileType

    fs, local = open_fs(path)
    info = fs.get_file_info(local)
    if info.type == FileType.NotFound:
        raise FileNotFoundError(f"path not found: {path}")
    if info.type == FileType.File:
        return [(local, info.size)]
    found = [x for x in fs.get_file_info(FileSelector(local)) if x.type == FileType.File and not x.base_name.startswith(("_", "."))]
    return sorted((x.path, x.size) for x in found)


def chunks(files: list[tuple[str, int]], kind: DType, chunk_bytes: int) -> list[Chunk]:
    """The input cut into chunks of whole records."""
    step = max(kind.width, chunk_bytes - chunk_bytes % kind.width)
    out, first = [], 0
    for path, size in files:
        if size % kind.width:
            raise ValueError(f"size of {path} is {size} bytes, no multiple of the {kind.width} bytes of {kind.name}")
        for at in range(0, size, step):
            out.append(Chunk(path, at, min(step, size - at), first + at // kind.width))
        first += size // kind.width
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.kind = dtype(options.get("dtype", "u32"))
        self.chunk_bytes = int(options.get("chunkbytes", CHUNK_BYTES))
        self.position = str(options.get("position", "false")).lower() == "true"

    def partitions(self) -> Sequence[InputPartition]:
        return chunks(input_files(self.path), self.kind, self.chunk_bytes) or [Chunk("", 0, 0, 0)]

    def read(self, partition: Chunk) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        width = self.kind.width
        fs, _ = open_fs(self.path)
        with fs.open_input_file(partition.path) as f:
            for at in range(0, partition.size, BATCH * width):
                raw = f.read_at(min(BATCH * width, partition.size - at), partition.offset + at)
                values = np.frombuffer(raw, self.kind.layout)
                columns = [to_arrow(values, self.kind)]
                if self.position:
                    first = partition.first + at // width
                    columns.insert(0, pa.array(np.arange(first, first + len(values))))
                yield pa.RecordBatch.from_arrays(columns, ["pos", "value"][-len(columns) :])


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        from pyarrow.fs import FileType

        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.kind = dtype(options.get("dtype", "u32"))
        self.assemble = str(options.get("assemble", "false")).lower() == "true"
        fs, local = open_fs(self.path)
        self.staged = f"{self.path}.staged-{uuid.uuid4().hex}"
        if not overwrite and fs.get_file_info(local).type != FileType.NotFound:
            raise FileExistsError(f"path exists: {self.path}")
        fs.create_dir(open_fs(self.staged)[1], recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        from pyspark import TaskContext

        name, n, out = uuid.uuid4().hex, 0, None
        fs, local = open_fs(self.staged)
        for batch in iterator:
            if not batch.num_rows:
                continue
            out = out or fs.open_output_stream(f"{local}/{name}", compression=None)
            column = batch.column("value" if "value" in batch.schema.names else 0)
            out.write(from_arrow(column, self.kind).tobytes())
            n += batch.num_rows
        if out:
            out.close()
        return Part(TaskContext.get().partitionId(), name if n else "", n)

    def commit(self, messages: list[Part | None]) -> None:
        from pyarrow.fs import FileType

        fs, local = open_fs(self.path)
        _, staged = open_fs(self.staged)
        parts = sorted((m for m in messages if m and m.name), key=lambda m: m.partition)
        kind = fs.get_file_info(local).type
        if kind == FileType.File:
            fs.delete_file(local)
        elif kind == FileType.Directory:
            fs.delete_dir(local)
        if self.assemble:
            with fs.open_output_stream(local, compression=None) as out:
                for m in parts:
                    with fs.open_input_stream(f"{staged}/{m.name}", compression=None) as f:
                        while block := f.read(8 << 20):
                            out.write(block)
        else:
            fs.create_dir(local, recursive=True)
            for m in parts:
                fs.move(f"{staged}/{m.name}", f"{local}/part-{m.partition:05d}")
        fs.delete_dir(staged)

    def abort(self, messages: list[Part | None]) -> None:
        fs, staged = open_fs(self.staged)
        fs.delete_dir(staged)


class FixedBin(DataSource):
    """The data source "fixedbin"."""

    @classmethod
    def name(cls) -> str:
        return "fixedbin"

    def schema(self) -> str:
        pos = str(self.options.get("position", "false")).lower() == "true"
        return ("pos bigint not null, " if pos else "") + f"value {dtype(self.options.get('dtype', 'u32')).spark} not null"

    def _options(self) -> dict:
        options = {k.lower(): v for k, v in self.options.items()}
        if "path" not in options:
            raise ValueError("fixedbin needs a path")
        return options

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self._options())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self._options(), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FixedBin)


def read_fixedbin(spark: SparkSession, path: str, dtype: str = "u32", chunk_bytes: int = CHUNK_BYTES, position: bool = False) -> DataFrame:
    """Records of a file or folder: value, and with position also pos."""
    register(spark)
    options = {"dtype": dtype, "chunkBytes": str(chunk_bytes), "position": str(position).lower()}
    return spark.read.format("fixedbin").options(**options).load(path)


def write_fixedbin(df: DataFrame, path: str, dtype: str = "u32", assemble: bool = False, mode: str = "errorifexists") -> None:
    """Write the column value, or the only one, in partition order. A sorted frame gives sorted parts."""
    register(df.sparkSession)
    append = "overwrite" if mode == "overwrite" else "append"
    df.write.format("fixedbin").mode(append).options(dtype=dtype, assemble=str(assemble).lower()).save(path)
