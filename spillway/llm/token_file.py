"""Operator 1: token ids of documents in binary files, document bounds Elias-Fano encoded.

A file: magic, ids (little-endian, `width` bytes each), the Elias-Fano sequence of the documents' first
positions (n + 1 of them: low bits, high bits, select samples), that of their doc ids less the least one,
a JSON footer with the lengths of these parts, its length (uint32), magic. A reader holds these sequences as they
lie in the file and gets every offset and doc id from them by select, a block of documents at a time.

Defined results: a null or empty text is a document of only the end id; rows with a null doc_id
come first, as a number in the footer; rows that share a doc_id are documents of their own, in the order of a hash of their
texts, and with tied hashes in any order, their texts being equal; a very long text is one document; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import array
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, open_fs, shuffle_partitions
from .eliasfano import EliasFano
from .tokens import batches, encoder

MAGIC = b"SPWTOK01"

#: Bytes of text in a file, at most on average; there is a file a partition.
PART_BYTES = 256 << 20
MANIFEST = "part int, path string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


#: Documents whose bounds and doc ids are decoded at a time.
DOCS = 4096


def write_file(uri: str, documents: Iterator[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Write documents (doc_id, ids as bytes) in ascending order of doc_id, nulls first; the number of documents and ids. Only bounds and doc ids are held."""
    fs, path = open_fs(uri)
    keys, bounds, at, nulls = array.array("q"), array.array("q", [0]), 0, 0
    with fs.open_output_stream(path, compression=None) as out:
        out.write(MAGIC)
        for key, raw in documents:
            out.write(raw)
            at += len(raw) // width
            bounds.append(at)
            if key is None and not keys:
                nulls += 1
            elif key is None or keys and key < keys[-1]:
                raise ValueError("doc ids must ascend, nulls first")
            else:
                keys.append(key)
        base = keys[0] if keys else 0
        less = np.frombuffer(keys, np.uint64) - np.uint64(base % (1 << 64)) if keys else np.zeros(0, np.uint64)
        parts, foot = {}, {"width": width, "n": nulls + len(keys), "nulls": nulls, "base": base, "tokens": at}
        for name, ef in (("bounds", EliasFano.encode(np.frombuffer(bounds, np.int64))), ("keys", EliasFano.encode(less))):
            foot[name] = ef.bits
            parts |= {f"{name}_low": ef.low, f"{name}_high": ef.high, f"{name}_samples": ef.samples}
        for raw in parts.values():
            out.write(raw.tobytes())
        foot = json.dumps(foot | {"parts": {k: len(v) for k, v in parts.items()}}).encode()
        out.write(foot + len(foot).to_bytes(4, "little") + MAGIC)
    return nulls + len(keys), at


class TokenFile:
    """A file opened for reading: bounds and doc ids by select, ids by document, or all documents in order."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(12, size - 12) if size >= 20 else b""
        if tail[4:] != MAGIC or self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{uri} is no whole token file")
        length = int.from_bytes(tail[:4], "little")
        foot = json.loads(self.file.read_at(length, size - 12 - length))
        self.n, self.width, self.tokens, self.nulls = foot["n"], foot["width"], foot["tokens"], foot["nulls"]
        self.base = np.uint64(foot["base"] % (1 << 64))
        at, raw = 8 + self.tokens * self.width, {}
        for k, v in foot["parts"].items():
            raw[k] = np.frombuffer(self.file.read_at(v, at), np.uint8)
            at += v
        part = lambda name, n: EliasFano(n, foot[name], raw[f"{name}_low"], raw[f"{name}_high"], raw[f"{name}_samples"])
        self.bounds, self.keys = part("bounds", self.n + 1), part("keys", self.n - self.nulls)

    def nbytes(self) -> int:
        """Bytes of what is held in memory."""
        return self.bounds.nbytes() + self.keys.nbytes()

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        """doc ids of documents first .. last - 1."""
        a, b = (max(0, x - self.nulls) for x in (first, last))
        return [None] * (last - first - (b - a)) + (self.keys.values(a, b) + self.base).view(np.int64).tolist()

    def document(self, i: int) -> np.ndarray:
        """ids of the i-th document, by select of its bounds."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        a, b = self.bounds.values(i, i + 2).astype(np.int64).tolist()
        return np.frombuffer(self.file.read_at((b - a) * self.width, 8 + a * self.width), f"<u{self.width}")

    def document_at(self, position: int) -> int:
        """The document that holds the id at a position of the file."""
        if not 0 <= position < self.tokens:
            raise IndexError(position)
        return self.bounds.find(position) - 1

    def documents(self, slab: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first position, ids) of all documents; the bounds of DOCS documents and about `slab` ids, or one document, are held at a time."""
        for first in range(0, self.n, DOCS):
            last = min(self.n, first + DOCS)
            at, keys, i = self.bounds.values(first, last + 1).astype(np.int64), self.doc_ids(first, last), 0
            while i < last - first:
                j = min(last - first, max(i + 1, int(np.searchsorted(at, at[i] + slab, side="right")) - 1))
                ids = np.frombuffer(self.file.read_at(int(at[j] - at[i]) * self.width, 8 + int(at[i]) * self.width), f"<u{self.width}")
                for k in range(i, j):
                    yield keys[k], int(at[k]), ids[at[k] - at[i] : at[k + 1] - at[i]]
                i = j

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, blank: bool, width: int = 2) -> DataFrame:
    """Write docs (doc_id, text) as token files in ascending doc_id order; their manifest, one row a file.

    The texts are dealt out by range of doc_id, so files follow each other; ids never pass a
    shuffle. A file's name is its task attempt's own, and only the attempt that is committed
    gets into the manifest.
    """

    def write(it):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer, blank, width)
        end = np.array([end_id], f"<u{width}").tobytes()

        def rows():
            for batch, first, last, texts in batches(it):
                yield from zip(batch.column("doc_id")[first:last].to_pylist(), [x + end for x in enc.encode(texts)], strict=True)

        some = rows()
        if (head := next(some, None)) is None:
            return
        name = f"{folder}/tokens-{part:06d}-{uuid.uuid4().hex}.bin"
        n, tokens = write_file(name, (x for y in ([head], some) for x in y), width)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "n_docs": [n], "n_tokens": [tokens]})

    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(shuffle_partitions(docs.sparkSession), -(-size // PART_BYTES))
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, *by).sortWithinPartitions(*by)
    return ranged.mapInArrow(write, MANIFEST)


def read_tokens(spark: SparkSession, manifest: list, width: int = 2) -> DataFrame:
    """One row a document, from the files: its doc_id, the ids before it in all files, its ids' number and crc32 as uint32."""
    base, files = 0, []
    for r in sorted(manifest, key=lambda r: r["part"]):
        files.append((r["path"], base))
        base += r["n_tokens"]

    def read(it):
        for batch in it:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = TokenFile(path)
                rows: list = []
                for key, at, ids in file.documents():
                    rows.append((key, first + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)
                file.close()

    names = spark.createDataFrame(files, "path string, base long")
    return names.repartition(max(1, len(files))).mapInArrow(read, ROWS)


def _rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, blank: bool = False, width: int = 2) -> DataFrame:
    """Write docs' ids to files of the shared folder and read them back.

    The manifest has a row a file, a few dozen bytes, and passes the driver; nothing that
    grows with the documents does.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    manifest = scratch.save(write_tokens(docs, scratch.folder("files"), tokenizer, end_id, blank, width), "manifest").collect()
    return read_tokens(spark, manifest, width)
