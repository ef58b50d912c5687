"""WARC records inside ZIP packages: written by partition, found through ZIP directories, read by byte range."""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, spread_left, stored

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 24 << 20
RUN_BYTES = 4 << 20
STAMP = "20240101000000"
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
IDS = uuid.UUID("6f1d3f52-0000-4000-0000-000000000000").int


class WarcError(ValueError):
    """An archive, directory or record that can't be right."""


# The ZIP side. Only stored members can be read by range: their bytes lie in the package as they are.

_END, _END64, _LOCATOR = struct.Struct("<4s4H2LH"), struct.Struct("<4sQ2H2L4Q"), struct.Struct("<4sLQL")
_ENTRY, _LOCAL = struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int


def read_directory(file, size: int) -> dict[str, Member]:
    """Members by name, from the central directory at the end of a ZIP file; 64-bit fields where the plain ones are full.

    ``file`` needs only ``read_at(count, offset)``.
    """
    tail_at = max(0, size - _END.size - 65535)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (len(tail) - at < _END.size or at + _END.size + _END.unpack_from(tail, at)[7] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise WarcError("no end of a central directory")
    _, _, _, _, entries, length, offset, _ = _END.unpack_from(tail, at)
    if at >= _LOCATOR.size and tail[at - _LOCATOR.size : at - _LOCATOR.size + 4] == b"PK\x06\x07":
        _, _, end64, _ = _LOCATOR.unpack_from(tail, at - _LOCATOR.size)
        magic, _, _, _, _, _, _, entries, length, offset = _END64.unpack(file.read_at(_END64.size, end64))
        if magic != b"PK\x06\x06":
            raise WarcError("no 64-bit end of the central directory where its locator points")
    directory = file.read_at(length, offset)
    members, at = {}, 0
    for _ in range(entries):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise WarcError("the central directory is damaged")
        _, _, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _, header = _ENTRY.unpack_from(directory, at)
        name = directory[at + _ENTRY.size : at + _ENTRY.size + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, k = directory[at + _ENTRY.size + n_name : at + _ENTRY.size + n_name + n_extra], 0
        while k + 4 <= len(extra):
            tag, count = struct.unpack_from("<HH", extra, k)
            if tag == 1:  # 64-bit fields, only those that are full in the entry, in this order
                wide = iter(struct.unpack_from(f"<{count // 8}Q", extra, k + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            k += 4 + count
        members[name] = Member(name, method, plain, packed, header)
        at += _ENTRY.size + n_name + n_extra + n_note
    return members


def data_offset(file, member: Member) -> int:
    """Where a stored member's bytes begin: after its local header, whose name and extra field have their own lengths."""
    if member.method != zipfile.ZIP_STORED or member.size != member.packed:
        raise WarcError(f"{member.name} is compressed and can't be read by range")
    fields = _LOCAL.unpack(file.read_at(_LOCAL.size, member.header))
    if fields[0] != b"PK\x03\x04":
        raise WarcError(f"no local header for {member.name}")
    return member.header + _LOCAL.size + fields[-2] + fields[-1]


# The WARC side.


def record_id(page_id: int | None) -> str:
    return "<urn:uuid:none>" if page_id is None else f"<urn:uuid:{uuid.UUID(int=IDS | (page_id & (2**64 - 1)))}>"


def page_of(name: str) -> int | None:
    if name == "<urn:uuid:none>":
        return None
    low = uuid.UUID(name[10:-1]).int & (2**64 - 1)
    return low - 2**64 if low >= 2**63 else low


def target(url: str | None) -> str:
    """A page's address without spaces or line ends."""
    return quote(url or "about:blank", safe=":/?#[]@!$&()*+,;=%~-._")


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One gzipped record; a revisit keeps the HTTP head, with the full payload's length, but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {target(url)}", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}


def read_record(packed: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a gzipped record.

    A response's length and digest are computed from the payload and held against its head; a revisit's are its head's.
    """
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise WarcError("no record where the index points")
    warc = _fields(head)
    block = rest[: int(warc["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise WarcError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(_fields(http)["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
    page, kind = page_of(warc["warc-record-id"]), warc["warc-type"]
    if kind == "response":
        if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
            raise WarcError(f"the payload of {warc['warc-record-id']} is not what its record says")
        return page, len(payload), digest, kind, None
    return page, size, digest, kind, page_of(warc["warc-refers-to"])


# Writing: each task streams packages of bounded size to the shared store.


class _Package:
    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(MEMBER), "w", force_zip64=True)
        self.size, self.lines = 0, []

    def add(self, record: bytes, url: str | None) -> None:
        self.member.write(record)
        self.lines.append(f'{target(url)} {STAMP} {{"offset": {self.size}, "length": {len(record)}}}')
        self.size += len(record)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(sorted(self.lines)))  # by address and time, as look-ups need it
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines), self.size


def _write_batches(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    package, done = None, []
    for batch in batches:
        cols = [batch.column(n) for n in ("page_id", "url", "html", "digest", "size", "refers_to", "revisit")]
        for row in zip(*cols, strict=True):
            page, url, html, digest, size, refers, revisit = (x.as_py() for x in row)
            package = package or _Package(folder)
            package.add(make_record(page, url, html or b"", digest, size, refers, revisit), url)
            if package.size >= ARCHIVE_BYTES:
                done.append(package.close())
                package = None
    if package:
        done.append(package.close())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "bytes"])


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html binary, digest, size, refers_to, revisit) of every row of ``pages``.

    Of rows with equal payloads of at least ``least`` bytes that with the largest page_id is the response, and the
    others revisit it, rows without a page_id too; rows that repeat the largest id all are responses. A revisit's html
    is left out. Maxima are taken per digest before the join; a payload with a great share of the rows is joined apart.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"))
    rows = rows.withColumn("payload", F.struct(F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("size")))
    counts = stored(rows.groupBy("payload").agg(F.max("page_id").alias("top"), F.count("*").alias("_n")), "payloads")
    top = counts.where((F.col("payload.size") >= least) & F.col("top").isNotNull() & (F.col("_n") > 1)).select("payload", "top")
    revisit = F.col("top").isNotNull() & ~F.col("top").eqNullSafe(F.col("page_id"))
    return spread_left(rows, top, "payload", counts).select(
        "page_id", "url", F.when(revisit, None).otherwise(F.col("html")).alias("html"), "payload.digest", "payload.size",
        F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("revisit"),
    )


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write packages of about ``ARCHIVE_BYTES`` under ``folder`` and return their list (path, records, bytes).

    Names are random, so a task that is run again writes files anew, and the stored list names only those of tasks that
    ended well. The folder's store must be one that pyarrow opens by its URI.
    """
    folder = folder or new_folder(records.sparkSession, "archives")
    return stored(records.mapInArrow(partial(_write_batches, folder=folder), "path string, records long, bytes long"), "archive-list")


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_package(path: str) -> Iterator[tuple]:
    """All records of one package: directories, then the index, then the records in runs of bounded size, by range."""
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as file:
        members = read_directory(file, file.size())
        if INDEX not in members or MEMBER not in members:
            raise WarcError(f"{path} lacks its archive or its index")
        index, start = members[INDEX], data_offset(file, members[MEMBER])
        lines = file.read_at(index.size, data_offset(file, index)).decode().split("\n")
        told = [json.loads(line.split(" ", 2)[2]) for line in lines if line]
        spans = sorted((x["offset"], x["length"]) for x in told)
        k = 0
        while k < len(spans):
            first, last = spans[k][0], k
            while last + 1 < len(spans) and spans[last + 1][0] + spans[last + 1][1] - first <= RUN_BYTES and spans[last + 1][0] == sum(spans[last]):
                last += 1
            run = io.BytesIO(file.read_at(sum(spans[last]) - first, start + first)).getbuffer()
            for at, size in spans[k : last + 1]:
                yield read_record(bytes(run[at - first : at - first + size]))
            k = last + 1


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows = list(read_package(path))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def read_archives(paths: DataFrame) -> DataFrame:
    """The records of the packages in ``paths`` (path), one row each; packages are dealt out to tasks."""
    spark = paths.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return paths.select("path").repartition(tasks).mapInArrow(_read_batches, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Every row of ``pages`` written as a record and read back: null html is an empty payload, repeated rows and rows
    without a page_id have records of their own, columns beside page_id, url and html are left out, and an empty table
    gives no rows."""
    return read_archives(write_archives(with_revisits(pages)))
