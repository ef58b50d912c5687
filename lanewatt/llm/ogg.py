"""Payloads as 8-bit samples in Ogg: pages with checksums, laced packets, two logical streams, granule positions."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

UNIT = 576
RATE = 8000
PAGE_SEGMENTS = 32
STREAMS = 2
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    """A page or packet that can't be right."""


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32 of a page whose checksum field is zero: zlib's polynomial, bits the other way round, from zero."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{raw:032b}"[::-1], 2)


class StreamWriter:
    """Packets of one logical stream, cut into pages of at most ``PAGE_SEGMENTS`` lacing values.

    A page's granule position is that of the last packet that ends on it, -1 if none does.
    """

    def __init__(self, serial: int):
        self.serial, self.sequence, self.pages = serial, 0, []
        self.lacing, self.body, self.granule, self.continued = bytearray(), bytearray(), -1, False

    def packet(self, data: bytes, granule: int, flush: bool = False, last: bool = False) -> None:
        values = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        for k, value in enumerate(values):
            if len(self.lacing) == PAGE_SEGMENTS:
                self._page(0)
                self.continued = k > 0
            self.lacing.append(value)
            self.body += data[at : at + value]
            at += value
        self.granule = granule
        if flush or last:
            self._page(LAST if last else 0)

    def _page(self, flags: int) -> None:
        flags |= CONTINUED * self.continued | FIRST * (self.sequence == 0)
        head = _HEAD.pack(b"OggS", 0, flags, self.granule, self.serial, self.sequence, 0, len(self.lacing)) + bytes(self.lacing)
        page = bytearray(head + self.body)
        page[22:26] = page_checksum(bytes(page)).to_bytes(4, "little")
        self.pages.append((self.granule, bytes(page)))
        self.sequence += 1
        self.lacing, self.body, self.granule, self.continued = bytearray(), bytearray(), -1, False


def padded(payload: bytes) -> bytes:
    """The payload and as many bytes 255 as make its length a positive multiple of ``UNIT``."""
    size = max(UNIT, -(-len(payload) // UNIT) * UNIT)
    return payload + b"\xff" * (size - len(payload))


def write_ogg(samples: bytes) -> bytes:
    """Unsigned 8-bit samples as Ogg: packets of ``UNIT`` samples, dealt in turn to ``STREAMS`` logical streams.

    A stream's first packet tells its format, its number and the packets to come. A packet's granule position is the
    number of the last sample it holds in the whole, so times can be told, and the whole put in order, from positions
    alone. Serial numbers come from the samples, so equal texts make equal files. First pages come first, then the
    streams' pages in order of position.
    """
    base = zlib.crc32(samples)
    writers = [StreamWriter((base + k) & 0xFFFFFFFF) for k in range(STREAMS)]
    count = len(samples) // UNIT
    for k, w in enumerate(writers):
        own = len(range(k, count, STREAMS))
        w.packet(b"PCMu8\0" + struct.pack("<IHHI", RATE, k, STREAMS, own), 0, flush=own > 0, last=own == 0)
    heads = [p for w in writers for _, p in w.pages]
    for w in writers:
        w.pages = []
    for i in range(count):
        writers[i % STREAMS].packet(samples[i * UNIT : (i + 1) * UNIT], (i + 1) * UNIT, last=i + STREAMS >= count)
    ready: list[tuple[int, int, bytes]] = []
    for k, w in enumerate(writers):
        at = 0
        for granule, page in w.pages:
            at = max(at, granule)
            ready.append((at, k, page))
    ready.sort(key=lambda x: (x[0], x[1]))
    return b"".join(heads) + b"".join(p for *_, p in ready)


@dataclass
class Stream:
    serial: int
    packets: list[tuple[bytes, int]] = field(default_factory=list)  # a packet, its page's granule position or -1
    partial: bytearray | None = None
    pages: int = 0
    next_sequence: int = 0
    ended: bool = False


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, memoryview]]:
    """(flags, granule, serial, sequence, lacing, body) of every page, each page's checksum verified."""
    view, at = memoryview(data), 0
    while at < len(data):
        if len(data) - at < _HEAD.size:
            raise OggError(f"a page is cut short at byte {at}")
        magic, version, flags, granule, serial, sequence, checksum, segments = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page at byte {at}")
        body_at = at + _HEAD.size + segments
        lacing = data[at + _HEAD.size : body_at]
        end = body_at + sum(lacing)
        if len(lacing) < segments or end > len(data):
            raise OggError(f"a page is cut short at byte {at}")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != checksum:
            raise OggError(f"the checksum is wrong at byte {at}")
        yield flags, granule, serial, sequence, lacing, view[body_at:end]
        at = end


def demultiplex(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number, their packets put together from lacing values across pages."""
    streams: dict[int, Stream] = {}
    for flags, granule, serial, sequence, lacing, body in read_pages(data):
        if (serial not in streams) != bool(flags & FIRST):
            raise OggError(f"stream {serial} has {'two first pages' if flags & FIRST else 'no first page'}")
        s = streams.setdefault(serial, Stream(serial))
        if s.ended or sequence != s.next_sequence:
            raise OggError(f"stream {serial}: page {sequence} where {s.next_sequence} should be")
        s.next_sequence, s.pages = sequence + 1, s.pages + 1
        if bool(flags & CONTINUED) != (s.partial is not None):
            raise OggError(f"stream {serial}: a packet's pages don't fit together")
        at, packet, done, open_end = 0, s.partial if s.partial is not None else bytearray(), [], s.partial is not None
        for value in lacing:
            packet += body[at : at + value]
            at += value
            open_end = value == 255
            if not open_end:
                done.append(bytes(packet))
                packet = bytearray()
        s.partial = packet if open_end else None
        s.packets += [(p, granule if k == len(done) - 1 else -1) for k, p in enumerate(done)]
        s.ended = bool(flags & LAST)
    for s in streams.values():
        if s.partial is not None or not s.ended:
            raise OggError(f"stream {s.serial} has no end")
    return streams


def read_samples(data: bytes) -> tuple[bytes, dict[str, int]]:
    """The samples that ``write_ogg`` stored, in order of their packets' times, and features of the streams and samples.

    Granule positions are given for the last packet that ends on a page; those of the packets before it on the same page
    follow from it, as a stream's packets are ``STREAMS`` units apart.
    """
    timed: list[tuple[int, bytes]] = []
    facts = {"streams": 0, "pages": 0, "packets": 0, "last": 0}
    for s in demultiplex(data).values():
        head, *packets = s.packets
        rate, number, streams, own = struct.unpack("<IHHI", head[0][6:])
        if head[0][:6] != b"PCMu8\0" or own != len(packets):
            raise OggError(f"stream {s.serial}: its head does not fit")
        position = None
        for packet, granule in reversed(packets):
            position = granule if granule >= 0 else position - streams * UNIT
            timed.append((position - len(packet), packet))
        facts["streams"] += 1
        facts["pages"] += s.pages
        facts["packets"] += len(packets)
        facts["last"] = max([facts["last"], *(g for _, g in packets)])
        facts["rate"] = rate
    timed.sort()
    samples = b"".join(p for _, p in timed)
    if any(t != k * UNIT for k, (t, _) in enumerate(timed)) or len(samples) != facts["last"]:
        raise OggError("the packets' times leave a gap")
    return samples, facts


def encode_text(text: str | None) -> tuple[bytes, int]:
    payload = (text or "").encode("utf-8", "replace")
    return write_ogg(padded(payload)), len(payload)


def feature(samples: bytes, facts: dict[str, int]) -> str:
    """Integers only, so equal samples say the same anywhere: duration in microseconds, counts, and of all samples the
    sum, the sum of squares, the peak and how often they cross the middle."""
    wave = np.frombuffer(samples, np.uint8)
    total, power = int(wave.sum(dtype=np.int64)), int((wave.astype(np.int32) ** 2).sum(dtype=np.int64))
    high = wave >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    counts = f"streams={facts['streams']};pages={facts['pages']};packets={facts['packets']}"
    return f"us={facts['last'] * 1_000_000 // facts['rate']};{counts};sum={total};squares={power};peak={int(wave.max())};crossings={crossings}"


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_FACTS = pa.schema([(n, t) for n, t in (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))])
SOME = 16 << 20


def _emit(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, held = [], 0
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            media, n = encode_text(text.as_py())
            rows.append((doc, n, media))
            held += len(media)
            if held > SOME:
                yield _emit(_MEDIA, rows)
                rows, held = [], 0
        if rows:
            yield _emit(_MEDIA, rows)


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, n, kept in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            media = kept.as_py()
            samples, facts = read_samples(media)
            rows.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples, facts)))
        if rows:
            yield _emit(_FACTS, rows)


def media_column(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text's UTF-8 bytes, padded, as an Ogg file in a binary column.

    A null text counts as empty, and an empty one is one unit of padding. Each row is a file of its own, so memory is
    bounded by a batch of rows; results leave in batches of about 16 MB.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode_batches, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Features of a table (doc_id, n_bytes, media), from samples read back; a damaged file is an error."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read_batches, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def document_media(documents: DataFrame) -> DataFrame:
    """Features of every row's text as media: the media table is written to the shared folder, and its stored bytes are
    read back. Null texts count as empty, repeated rows are files of their own, equal texts have equal values, columns
    beside doc_id and text are left out, and an empty table gives no rows."""
    return read_media(stored(media_column(documents), "media"))
