"""Operator 8: WARC archives with revisit records, and a reader that salvages damaged ones.

A record is a gzip member of its own (or plain). The reader checks members, version lines,
lengths and digests. After a failed check it searches for the next member that opens with a
version line, or the next plain version line, goes on there, and reports the bytes between as a
gap: nothing after a damaged place is lost. Headers are read to their end and records whole, however long they
are. Gaps are rows of the reader, and `salvage_log` gives and logs those of a read.

Defined results: null html is an empty payload, equal to that of an empty text; rows that share the
largest page_id of a payload are all responses; a null page_id stays null and is a revisit of a
response with an id, or a response where no copy has an id; null urls are left out of the headers; very
long payloads and urls are written and read whole, a record at a time in memory; an empty table gives no archives and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, open_fs, skew_lookup

#: Files that a log names, those with the most bytes lost; the returned rows have all.
LOGGED = 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:spillway:page:"
FILES = "path string, records long, bytes long"
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, gap_start long, gap_end long, gap_reason string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record: a response, or a revisit of page refers_to, whose block has the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{'none' if page_id is None else page_id}>"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


@dataclass
class Record:
    start: int
    end: int
    headers: dict[str, str]
    block: bytes

    @property
    def type(self) -> str:
        return self.headers.get("warc-type", "")

    def http(self) -> tuple[dict[str, str], bytes]:
        """The HTTP headers and the payload."""
        head, _, payload = self.block.partition(b"\r\n\r\n")
        pairs = (x.split(":", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ":" in x)
        return {k.strip().lower(): v.strip() for k, v in pairs}, payload

    def page(self, name: str = "warc-record-id") -> int | None:
        value = self.headers.get(name, "").strip("<>").removeprefix(URN)
        return int(value) if re.fullmatch(r"-?\d+", value) else None


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Damaged(Exception):
    pass


@dataclass
class Salvage:
    """Records and gaps of an archive, in order of their place. read(n, at) gives bytes of it."""

    read: object
    size: int
    window: int = 1 << 20
    _at: int = field(default=0, init=False)
    _held: bytes = field(default=b"", init=False)

    def _bytes(self, at: int, n: int) -> bytes:
        if not (self._at <= at and at + n <= self._at + len(self._held)):
            self._at, self._held = at, self.read(min(max(n, self.window), self.size - at), at)
        return self._held[at - self._at : at - self._at + n]

    def _inflate(self, at: int, most: int | None = None) -> tuple[bytes, int]:
        """A member's content and its end; or, with most, the content's first bytes."""
        inflate, out, held, pos, step = zlib.decompressobj(31), [], 0, at, 4096
        try:
            while not inflate.eof:
                part = self._bytes(pos, min(step, self.size - pos))
                if not part:
                    raise Damaged("member cut short")
                got = inflate.decompress(part, most - held) if most else inflate.decompress(part)
                out.append(got)
                held += len(got)
                pos += len(part)
                step = min(2 * step, self.window)
                if most and held >= most:
                    break
        except zlib.error as e:
            raise Damaged(f"bad member: {e}") from e
        return b"".join(out), pos - len(inflate.unused_data)

    def _parse(self, raw: bytes, whole: bool) -> tuple[dict[str, str], bytes, int]:
        """Headers, block and length of the record that raw opens with."""
        head, found, _ = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not re.fullmatch(r"WARC/\d\.\d", lines[0]) or not found:
            raise Damaged("no version line or no end of headers")
        if any(":" not in x and not x.startswith((" ", "\t")) for x in lines[1:]):
            raise Damaged("bad header line")
        headers = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        if not re.fullmatch(r"\d+", headers.get("content-length", "")):
            raise Damaged("no content length")
        a = len(head) + 4
        b = a + int(headers["content-length"])
        if raw[b : b + 4] != b"\r\n\r\n" or whole and len(raw) != b + 4:
            raise Damaged("wrong content length")
        block = raw[a:b]
        digest = headers.get("warc-block-digest", "")
        if digest.startswith("sha1:") and digest[5:] != base32_sha1(block):
            raise Damaged("wrong block digest")
        return headers, block, b + 4

    def _plain(self, at: int) -> Record:
        headers, step, begin, length = b"", 4096, 0, None
        while True:  # line by line, until the empty one; a line that is no header ends it early
            end = headers.find(b"\r\n", begin)
            if end < 0:
                if at + len(headers) >= self.size or len(headers) - begin > 4096 and b":" not in headers[begin : begin + 4096]:
                    raise Damaged("no end of headers")
                headers, step = bytes(self._bytes(at, min(step, self.size - at))), 2 * step
                continue
            line = headers[begin:end]
            if not line:
                break
            if begin and b":" not in line and line[:1] not in (b" ", b"\t"):
                raise Damaged("bad header line")
            if found := re.fullmatch(rb"(?i)content-length:\s*(\d+)\s*", line):
                length = int(found[1])
            begin = end + 2
        if length is None:
            raise Damaged("no content length")
        n = begin + 2 + length + 4
        if at + n > self.size:
            raise Damaged("record cut short")
        headers, block, n = self._parse(self._bytes(at, n), False)
        return Record(at, at + n, headers, block)

    def _record(self, at: int) -> Record:
        if self._bytes(at, 2) == b"\x1f\x8b":
            raw, end = self._inflate(at)
            headers, block, _ = self._parse(raw, True)
            return Record(at, end, headers, block)
        if self._bytes(at, 5) == b"WARC/":
            return self._plain(at)
        raise Damaged("neither a member nor a version line")

    def _next(self, at: int) -> int:
        """The next place from at on where a record may begin."""
        while at < self.size:
            part = self._bytes(at, min(self.window, self.size - at))
            for m in re.finditer(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n", part):
                place = at + m.start()
                if m[0][:4] == b"WARC":
                    return place
                try:
                    if self._inflate(place, 5)[0] == b"WARC/":
                        return place
                except Damaged:
                    pass
            if at + len(part) >= self.size:
                break
            at += max(1, len(part) - 16)
        return self.size

    def __iter__(self) -> Iterator[Record | Gap]:
        at = 0
        while at < self.size:
            try:
                found = self._record(at)
            except Damaged as e:
                end = self._next(at + 1)
                yield Gap(at, end, str(e))
                at = end
                continue
            yield found
            at = found.end


def write_archives(pages: DataFrame, folder: str, compress: bool = True, roll: int = 256 << 20) -> DataFrame:
    """Archives of pages (page_id, url, html, payload_hex, refers_to), of about `roll` bytes at most; one row a file.

    A file's name is its task attempt's own; only committed attempts get into the returned rows.
    """

    def write(it):
        out, name, n, size = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

        for batch in it:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "payload_hex", "refers_to")]
            for i in range(batch.num_rows):
                key, url, html, digest, other = (c[i].as_py() for c in columns)
                raw = record(key, url, (html or "").encode(), base64.b32encode(bytes.fromhex(digest)).decode(), other)
                raw = member(raw) if compress else raw
                if out and size + len(raw) > roll:
                    yield closed()
                    out = None
                if not out:
                    name, n, size = f"{folder}/pages-{uuid.uuid4().hex}.warc{'.gz' * compress}", 0, 0
                    fs, path = open_fs(name)
                    out = fs.open_output_stream(path, compression=None)
                out.write(raw)
                n += 1
                size += len(raw)
        if out:
            yield closed()

    return pages.select("page_id", "url", "html", "payload_hex", "refers_to").mapInArrow(write, FILES)


def read_archives(files: DataFrame, n: int) -> DataFrame:
    """Records of the archives named in files.path, and the gaps, with their file and reason, as rows of record_type 'gap'."""

    def read(it):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = [x.split()[0] for x in ROWS.split(", ")]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in it:
            for path in batch.column("path").to_pylist():
                fs, local = open_fs(path)
                rows: list = []
                with fs.open_input_file(local) as f:
                    for x in Salvage(f.read_at, f.size()):
                        rows.append(_row(x, path))
                        if len(rows) == 10_000:
                            yield make(rows)
                            rows = []
                if rows:
                    yield make(rows)

    return files.select("path").repartition(max(1, n)).mapInArrow(read, ROWS)


def _row(x: Record | Gap, path: str) -> tuple:
    if isinstance(x, Gap):
        return None, None, None, "gap", None, path, x.start, x.end, x.reason
    http, payload = x.http()
    revisit = x.type == "revisit"
    size = int(http["content-length"]) if revisit else len(payload)
    digest = x.headers.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(payload)
    if not revisit and digest != x.headers.get("warc-payload-digest", "").removeprefix("sha1:"):
        return None, None, None, "gap", None, path, x.start, x.end, "wrong payload digest"
    return x.page(), size, digest, x.type, x.page("warc-refers-to"), path, None, None, None


def salvage_log(rows: DataFrame) -> DataFrame:
    """The gaps among the rows of a read: file, gap_start, gap_end, gap_reason. Each file's number of them and of their bytes is logged."""
    gaps = rows.filter("record_type = 'gap'").select("file", "gap_start", "gap_end", "gap_reason")
    for r in gaps.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.col("gap_end") - F.col("gap_start")).alias("size")).orderBy(F.desc("size")).limit(LOGGED).collect():
        logging.getLogger(__name__).warning("%s: %d gaps, %d bytes", r["file"], r["n"], r["size"])
    return gaps


def with_revisits(pages: DataFrame, scratch: Scratch, least: int = 0) -> DataFrame:
    """pages with payload_hex and refers_to: the largest page_id with an equal payload of `least` bytes or more, where that is another one."""
    text = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    hashed = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(text).alias("payload_hex"))
    large = hashed.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= least) if least else hashed
    counts = large.groupBy("payload_hex").agg(F.max("page_id").alias("keep"), F.count("*").alias("copies"))
    copied = scratch.save(counts.filter("copies > 1 and keep is not null"), "copied")
    seen = copied.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    out = skew_lookup(hashed, copied, "payload_hex", ["keep"], "copies", seen[1], F.col("page_id"), size=100 * seen[0])
    return out.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")))


def warc_round_trip(pages: DataFrame, least: int = 0, compress: bool = True) -> DataFrame:
    """Write pages (page_id, url, html) as archives in the shared folder; the records read back from them. Gaps are logged and left out."""
    scratch = Scratch(pages.sparkSession, "warc")
    files = scratch.save(write_archives(with_revisits(pages, scratch, least), scratch.folder("files"), compress), "manifest")
    rows = scratch.save(read_archives(files, files.count()), "records")
    salvage_log(rows)
    return rows.filter("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
d AS (SELECT page_id, CAST(octet_length(raw) AS BIGINT) AS payload_bytes, sha1(raw) AS h FROM p),
k AS (SELECT h, max(page_id) AS keep FROM d GROUP BY h),
b AS (SELECT h, keep, list_transform(range(8), lambda g: CAST('0x' || substr(h, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT)) AS parts FROM k),
c AS (SELECT h, keep, array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), '')), '') AS payload_digest FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM keep AND keep IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM keep THEN keep END AS refers_to FROM d JOIN c USING (h)
"""
