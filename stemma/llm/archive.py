"""Web archives in ZIP packages: a writer of WARC records and a reader that extracts nothing.

A package is a ZIP file of stored members: archive/data.warc.gz, with a gzip member per record, and
indexes/index.cdxj, with the offset and length of each record. The reader parses the end record, the ZIP64 records
and the central directory, finds where the stored members begin, reads the index, and range-reads each record.

Paths may lie in any store that pyarrow.fs opens by URI. A task writes a package under a name of its own and
reports it only when it is whole; only reported packages are read, so a lost or repeated task does no harm.

Defined results: a null html is an empty payload. Of rows with one page_id each is a record of its own; among equal
payloads the smallest (page_id, url) is the response, null page_ids come last, and of wholly equal rows one is. A null url
has no WARC-Target-URI. Payloads of any length are one record; sizes beyond four bytes take ZIP64 fields. An empty table makes no package. Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, scratch, written

#: Payloads below this size are never written as revisits.
LEAST_REVISIT = 100
#: A package is closed when it holds so many bytes of records, which bounds what a reader handles in one row.
PACKAGE_BYTES = 32 << 20
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


# -- ZIP ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


class PackageWriter:
    """Writes stored members one after another; ZIP64 records are written where sizes, offsets or counts need them, or always if asked."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> int:
        """Adds a member and returns where its data begins."""
        crc, raw, at = zlib.crc32(data), name.encode(), self.at
        large = self.zip64 or len(data) >= _MAX32
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if large else b""
        size = _MAX32 if large else len(data)
        self._put(struct.pack("<4s5H3I2H", b"PK\3\4", 45 if large else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra)
        begin = self.at
        self._put(data)
        self.members.append((raw, crc, len(data), at))
        return begin

    def close(self) -> None:
        start = self.at
        for raw, crc, size, at in self.members:
            big_size, big_at = self.zip64 or size >= _MAX32, self.zip64 or at >= _MAX32
            values = [size, size] * big_size + [at] * big_at
            extra = struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values) if values else b""
            shown = _MAX32 if big_size else size
            self._put(
                struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45 if values else 20, 0x800, 0, 0, 33, crc, shown, shown, len(raw), len(extra), 0, 0, 0, 0, _MAX32 if big_at else at)
                + raw
                + extra
            )
        size, n = self.at - start, len(self.members)
        if self.zip64 or start >= _MAX32 or size >= _MAX32 or n >= _MAX16:
            end = self.at
            self._put(struct.pack("<4sQ2H2I4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
            n, size, start = _MAX16, _MAX32, _MAX32
        self._put(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, n, n, size, start, 0))


class PackageReader:
    """Finds stored members of a ZIP file that allows random reads, and reads ranges of them."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.members = {m.name: m for m in self._directory()}
        self._begins: dict[str, int] = {}

    def _read(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise ValueError("a ZIP record lies outside the file")
        self.file.seek(at)
        return self.file.read(n)

    def _directory(self) -> Iterator[Member]:
        tail_at = max(0, self.size - 22 - _MAX16)
        tail = self._read(tail_at, self.size - tail_at)
        k = len(tail)
        while True:
            k = tail.rfind(b"PK\5\6", 0, k)
            if k < 0:
                raise ValueError("no end of central directory")
            if len(tail) - k >= 22 and k + 22 + int.from_bytes(tail[k + 20 : k + 22], "little") == len(tail):
                break
        n, size, start = struct.unpack("<H2I", tail[k + 10 : k + 20])
        end = tail_at + k
        if end >= 20 and (n == _MAX16 or size == _MAX32 or start == _MAX32):
            signature, _, at, _ = struct.unpack("<4sIQI", self._read(end - 20, 20))
            if signature == b"PK\6\7":
                record = self._read(at, 56)
                if record[:4] != b"PK\6\6":
                    raise ValueError("no ZIP64 end of central directory")
                n, size, start = struct.unpack("<3Q", record[32:56])
        directory, at = self._read(start, size), 0
        for _ in range(n):
            if directory[at : at + 4] != b"PK\1\2":
                raise ValueError("bad central directory")
            method = struct.unpack_from("<H", directory, at + 10)[0]
            packed, plain, name_n, extra_n, note_n = struct.unpack_from("<2I3H", directory, at + 20)
            header_at = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + name_n].decode()
            extra = directory[at + 46 + name_n : at + 46 + name_n + extra_n]
            while len(extra) >= 4:
                kind, length = struct.unpack_from("<2H", extra)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                    plain = next(wide) if plain == _MAX32 else plain
                    packed = next(wide) if packed == _MAX32 else packed
                    header_at = next(wide) if header_at == _MAX32 else header_at
                extra = extra[4 + length :]
            yield Member(name, method, packed, header_at)
            at += 46 + name_n + extra_n + note_n

    def begin(self, name: str) -> int:
        """Where a stored member's data begins."""
        if name not in self._begins:
            m = self.members[name]
            if m.method:
                raise ValueError(f"{name} isn't stored")
            header = self._read(m.header_at, 30)
            if header[:4] != b"PK\3\4":
                raise ValueError("bad local header")
            self._begins[name] = m.header_at + 30 + sum(struct.unpack("<2H", header[26:30]))
        return self._begins[name]

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        m = self.members[name]
        n = m.size - at if n is None else n
        if at + n > m.size:
            raise ValueError("a range lies outside its member")
        return self._read(self.begin(name) + at, n)


# -- WARC ---------------------------------------------------------------------------------------


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, record_type: str) -> bytes:
    """One gzip member with a response that holds the payload, or a revisit that names its digest and response."""
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127))).replace("%", "")))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
        payload = b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner


def write_package(path: str, rows: list[tuple[dict, bytes]], zip64: bool = False) -> int:
    """Writes records with their index to a new file; index entries are made of the given dicts. Returns its size."""
    store, inner = _open(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    index, at = [], 0
    for entry, data in rows:
        index.append(json.dumps(entry | {"offset": at, "length": len(data)}, separators=(",", ":")))
        at += len(data)
    with store.open_output_stream(inner) as out:
        package = PackageWriter(out, zip64)
        package.add("archive/data.warc.gz", b"".join(data for _, data in rows))
        package.add("indexes/index.cdxj", "\n".join(index).encode())
        package.close()
        return package.at


def read_package(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record that the index names, each by a range read."""
    store, inner = _open(path)
    size = store.get_file_info(inner).size
    with store.open_input_file(inner) as file:
        package = PackageReader(file, size)
        for line in io.BytesIO(package.read("indexes/index.cdxj")):
            entry = json.loads(line)
            yield parse_record(package.read("archive/data.warc.gz", entry["offset"], entry["length"]))


# -- Spark --------------------------------------------------------------------------------------


def write_archives(pages: DataFrame, folder: str, least_revisit: int = LEAST_REVISIT, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes pages to packages in folder and returns the table of packages: path, bytes, records."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    # Only digests are grouped, map-side first; few keys are left for the join.
    key = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url")
    alike = rows.where(F.col("size") >= least_revisit).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    first = alike.groupBy("digest").agg(F.min(F.struct(key.alias("key"), "n")).alias("first"), F.sum("n").alias("n")).where("n > 1")
    first = written(first.select("digest", F.col("first.key").alias("first"), F.col("first.n").alias("ties")), "first")
    is_first = key.eqNullSafe(F.col("first"))
    rows = rows.join(first, "digest", "left").withColumn("kind", F.when(F.col("first").isNull() | is_first, "response").otherwise("revisit"))
    if first.where("ties > 1").limit(1).count():
        # Wholly equal rows tie for the smallest: one of them is the response.
        tied = (F.col("kind") == "response") & (F.coalesce("ties", F.lit(1)) > 1)
        rest = rows.where(~tied)
        ranked = rows.where(tied).withColumn("_n", F.row_number().over(Window.partitionBy("digest").orderBy("page_id")))
        rows = rest.unionByName(ranked.withColumn("kind", F.when(F.col("_n") > 1, "revisit").otherwise("response")).drop("_n"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[dict, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            out = pa.RecordBatch.from_pydict({"path": [path], "bytes": [write_package(path, held)], "records": [len(held)]})
            held, size = [], 0
            return out

        for batch in batches:
            for page_id, url, html, digest, n, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record_bytes(page_id, url, html.encode(), digest, n, refers, kind)
                held.append(({"id": page_id, "digest": digest}, data))
                size += len(data)
                if size >= package_bytes:
                    yield flush()
        if held:
            yield flush()

    out = rows.select("page_id", "url", "html", "digest", "size", "kind", F.when(F.col("kind") == "revisit", F.col("first.page_id")).alias("refers_to"))
    packages = mapped(out, write, "path string, bytes long, records long")
    return written(packages, "packages")


def read_archives(packages: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to of each record in the packages."""

    def number(urn: str) -> int | None:
        digits = urn[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
                for headers, payload in read_package(path):
                    revisit = headers["WARC-Type"] == "revisit"
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"a payload in {path} doesn't have its digest")
                    values = (number(headers["WARC-Record-ID"]), int(headers["X-Payload-Length"]) if revisit else len(payload), digest, headers["WARC-Type"], number(headers["WARC-Refers-To"]) if revisit else None)
                    for column, v in zip(out.values(), values, strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    return mapped(packages.select("path"), read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    packages = write_archives(pages, scratch(spark, "archives"))
    return read_archives(packages.repartition(max(1, spark.sparkContext.defaultParallelism)))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, CASE WHEN strlen(html) >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id::BIGINT AS page_id, strlen(html)::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END::BIGINT AS refers_to
FROM q
"""
