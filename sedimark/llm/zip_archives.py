"""WARC records in ZIP packages, read in place.

A package has stored members: ``archive/data.warc.gz``, in which each record is
a gzip member of its own, and ``indexes/index.cdx`` with a line for each record
(page, position, length, type, digest). The reader finds the central directory from the end of
the file, follows the ZIP64 records where the plain fields overflow, locates the
members and reads single records by range; nothing is extracted.

Packages go to the shared folder under names of their own for each attempt of a
task, and a manifest table, committed by Spark, names those that count.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zipfile
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm._common import open_filesystem, shared_folder, slices, stored, text_of

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
MANIFEST = "path string, bytes long, n_records long"
_CRLF, _STAMP = b"\r\n", (1980, 1, 1, 0, 0, 0)


def warc_record(kind: str, record_id: str, uri: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A WARC/1.1 record with an HTTP response as its block; a revisit has the response's head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _head(fields) + block + _CRLF + _CRLF


def _head(fields: list[tuple[str, str]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + _CRLF


def _fields(lines: list[bytes]) -> dict[str, str]:
    """Header lines by their names in lower case, whatever case and white space they have."""
    split = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in split}


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, dict[str, str]]:
    """Fields, payload and HTTP fields; a record that isn't an HTTP response has its whole block as payload."""
    head, _, rest = data.partition(_CRLF + _CRLF)
    version, *lines = head.split(_CRLF)
    if not version.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _fields(lines)
    length = int(fields["content-length"])
    if rest[length : length + 4] != _CRLF + _CRLF:
        raise ValueError("a record's end is missing")
    block = rest[:length]
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return fields, block, {}
    http, _, payload = block.partition(_CRLF + _CRLF)
    return fields, payload, _fields(http.split(_CRLF)[1:])


class ZipReader:
    """Members of a ZIP file by ranges. read(position, length) gives bytes of the file."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of a central directory")
        count, length, start = struct.unpack_from("<HII", tail, end + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, start):
            locator = tail_at + end - 20
            mark, _, at64, _ = struct.unpack("<4sIQI", read(locator, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record = read(at64, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of a central directory")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
        self.members = self._directory(read(start, length), count)

    @staticmethod
    def _directory(data: bytes, count: int) -> dict[str, tuple[int, int, int]]:
        """Name: (method, stored length, position of the local header)."""
        members, at = {}, 0
        for _ in range(count):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            stored_length, length, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
            position = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # ZIP64: the fields that overflow, in this order
                    values = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    length = next(values) if length == 0xFFFFFFFF else length
                    stored_length = next(values) if stored_length == 0xFFFFFFFF else stored_length
                    position = next(values) if position == 0xFFFFFFFF else position
                e += 4 + n
            members[name] = (method, stored_length, position)
            at += 46 + n_name + n_extra + n_comment
        return members

    def locate(self, name: str) -> tuple[int, int]:
        """Position and length of a stored member's bytes in the file."""
        method, length, header = self.members[name]
        if method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is compressed")
        local = self.read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError("a broken local header")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return header + 30 + n_name + n_extra, length


class Package:
    """Records of a package: the index once, then a range for each record."""

    def __init__(self, read, size: int):
        self.zip, self.read = ZipReader(read, size), read
        self.data_at, self.data_length = self.zip.locate(DATA)
        at, length = self.zip.locate(INDEX)
        self.index = [line.split(" ") for line in read(at, length).decode().splitlines()]

    def record(self, position: int, length: int) -> tuple[dict[str, str], bytes, dict[str, str]]:
        if position + length > self.data_length:
            raise ValueError("a record beyond the archive")
        return parse_record(gzip.decompress(self.read(self.data_at + position, length)))

    def records(self) -> Iterator[tuple[str, dict[str, str], bytes, dict[str, str]]]:
        for name, position, length, *_ in self.index:
            yield (name, *self.record(int(position), int(length)))


class _PackageWriter:
    """A package that goes to its stream record by record; only the index is held."""

    def __init__(self, out):
        self.out, self.index, self.at = out, [], 0
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA, _STAMP), "w", force_zip64=True)

    def add(self, record: bytes, name: str, note: str) -> None:
        self.data.write(record)
        self.index.append(f"{name} {self.at} {len(record)} {note}\n")
        self.at += len(record)

    def close(self) -> int:
        """The package's bytes."""
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX, _STAMP), "".join(self.index))
        self.zip.close()
        size = self.out.tell()
        self.out.close()
        return size


def write_packages(records: DataFrame, folder: str, package_bytes: int = 64 << 20, date: str | None = None) -> DataFrame:
    """Write (page_id, url, payload, payload_digest, record_type, refers_to); the manifest table.

    date is the records' WARC-Date, by default the time of this call.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_filesystem(f"{folder}/packages")
        files.create_dir(root, recursive=True)
        package, name, made = None, "", []

        def close() -> None:
            made.append((f"{folder}/packages/{name}", package.close(), len(package.index)))

        for batch in slices(batches):
            for key, uri, payload, digest, kind, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = gzip.compress(warc_record(kind, "null" if key is None else str(key), uri, payload, digest, None if refers is None else str(refers), date), 5, mtime=0)
                if package and package.at + len(record) > package_bytes:
                    close()
                    package = None
                if package is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    package = _PackageWriter(files.open_output_stream(f"{root}/{name}"))
                package.add(record, "null" if key is None else str(key), f"{kind} {digest}")
        if package:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), [pa.string(), pa.int64(), pa.int64()], strict=True)], ["path", "bytes", "n_records"])

    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"\s+", "%20")
    return stored(records.select("page_id", uri.alias("url"), "payload", "payload_digest", "record_type", "refers_to").mapInArrow(write, MANIFEST), folder, "manifest")


def read_packages(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record.

    A response's digest is computed from the payload that was read and must be
    the one in its header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, name = open_filesystem(path)
                with files.open_input_file(name) as f:
                    rows = []
                    for key, fields, payload, http in Package(lambda at, n, f=f: f.read_at(n, at), size).records():
                        digest, kind, refers = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], fields.get("warc-refers-to")
                        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(http["content-length"])):
                            raise ValueError(f"record {key} of {path} is broken")
                        rows.append((None if key == "null" else int(key), int(http["content-length"]), digest, kind, refers and int(refers.removeprefix("<urn:page:").rstrip(">"))))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = manifest.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def classified(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """pages with payload, payload_digest, record_type and refers_to.

    Of equal payloads of least_bytes or more, the largest page_id is the response
    and others revisit it; rows that repeat its id are responses too. A null html
    is empty; a null page_id is never referred to and is a response where its
    payload has no other page.
    """
    payload = text_of("html").cast("binary")
    marked = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"))
    large = F.length("payload") >= least_bytes
    newest = marked.filter(large).groupBy(F.col("payload_digest").alias("_digest")).agg(F.max("page_id").alias("_newest"), F.count("*").alias("_n")).filter("_n > 1")
    joined = marked.join(newest, large & (F.col("payload_digest") == F.col("_digest")), "left")
    revisit = F.col("_newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_newest"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_newest")).alias("refers_to"))


def archive(pages: DataFrame) -> DataFrame:
    """Write pages to packages in the shared folder and read them back."""
    return read_packages(write_packages(classified(pages), shared_folder(pages.sparkSession)))
