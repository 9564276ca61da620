"""Ogg media columns: containers with page checksums, lacing, streams and granules.

``mux`` interleaves logical streams of packets into pages; ``demux`` verifies
each page's checksum and sequence, reassembles packets from lacing values
across pages, separates the streams by serial number and derives timestamps
from granule positions.  ``media_columns`` does both for a text column.

Null and empty texts give one packet of 64 zero bytes.  Equal texts give equal
bytes: serial numbers are derived from the payload.  A damaged page raises
``OggError`` and names the byte offset.  A text of any length is stored whole;
every row, also one that repeats another or has no id, has a row of its own; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.text import encode

CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
PAD = 64
#: Bytes of a packet, packets between two streams' turns, and samples a second.
PACKET, RATE = 4096, 8000
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


class OggError(ValueError):
    pass


def page_crc(page: bytes) -> int:
    """Ogg's CRC: polynomial 0x04C11DB7, most significant bit first, no inversion.

    It equals the bit-reversed reflected CRC of the bit-reversed bytes, which
    zlib computes at memory speed; starting from all ones and inverting the
    result cancels zlib's own inversions.
    """
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return head[:22] + struct.pack("<I", page_crc(whole)) + head[26:] + body


def stream_pages(packets: list[tuple[bytes, int]], serial: int) -> Iterator[bytes]:
    """Pages of one logical stream; packets come with their granule position at the end."""
    lacing, body, granule, number, flags = bytearray(), bytearray(), -1, 0, FIRST
    for k, (packet, position) in enumerate(packets):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = used = 0
        while at < len(values):
            if len(lacing) == 255:
                yield _page(flags, granule, serial, number, bytes(lacing), bytes(body))
                lacing, body, granule, number = bytearray(), bytearray(), -1, number + 1
                flags = CONTINUED if at else 0
            part = values[at : at + 255 - len(lacing)]
            size = sum(part)
            lacing += part
            body += packet[used : used + size]
            at, used = at + len(part), used + size
        granule = position
    yield _page(flags | LAST, granule, serial, number, bytes(lacing), bytes(body))


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical stream: first pages of all logical streams, then their pages in turns."""
    turns = [stream_pages(packets, serial) for serial, packets in streams.items()]
    out = [next(t) for t in turns]
    while turns:
        left = []
        for t in turns:
            page = next(t, None)
            if page is not None:
                out.append(page)
                left.append(t)
        turns = left
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    partial: bytearray = field(default_factory=bytearray)
    open: bool = False

    def seconds(self, rate: int = RATE) -> float:
        return max([0, *self.granules]) / rate


def demux(data: bytes) -> dict[int, Stream]:
    """The logical streams of a physical stream, by serial number in order of appearance."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < HEADER.size or data[at : at + 4] != CAPTURE:
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        start = at + HEADER.size + n
        lacing = data[at + HEADER.size : start]
        end = start + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            raise OggError(f"page cut short at byte {at}")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"checksum differs at byte {at}")
        s = streams.get(serial)
        if s is None:
            if not flags & FIRST:
                raise OggError(f"stream {serial} starts without its first page at byte {at}")
            s = streams[serial] = Stream()
        if number != s.pages or bool(flags & CONTINUED) != s.open or s.ended:
            raise OggError(f"page out of sequence at byte {at}")
        s.pages += 1
        finished = 0
        for value in lacing:
            s.partial += data[start : start + value]
            start += value
            s.open = value == 255
            if not s.open:
                s.packets.append(bytes(s.partial))
                s.partial = bytearray()
                finished += 1
        if finished:
            if granule < 0:
                raise OggError(f"packets end without a granule position at byte {at}")
            s.granules.append(granule)
        s.ended = bool(flags & LAST)
        at = end
    if any(s.open or not s.ended for s in streams.values()):
        raise OggError("a stream has no last page")
    return streams


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + b"\0" * (-len(data) % PAD if data else PAD)


def store(payload: bytes, packet: int = PACKET) -> bytes:
    """The payload as 8-bit samples in two logical streams that take packets in turns."""
    base = zlib.crc32(payload)
    parts = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    streams: dict[int, list[tuple[bytes, int]]] = {}
    for turn in range(min(2, len(parts))):
        own, position = [], 0
        for part in parts[turn::2]:
            position += len(part)
            own.append((part, position))
        streams[(base + turn) & 0xFFFFFFFF] = own
    return mux(streams)


def load(media: bytes) -> tuple[bytes, dict[int, Stream]]:
    streams = demux(media)
    queues = [s.packets for s in streams.values()]
    turns = [q[i] for i in range(max(map(len, queues), default=0)) for q in queues if i < len(q)]
    return b"".join(turns), streams


def feature(payload: bytes, streams: dict[int, Stream]) -> str:
    """Streams, pages, packets, seconds, and the share of letters, high bytes and zeros."""
    n = len(payload)
    letters = n - len(payload.translate(None, bytes(range(65, 91)) + bytes(range(97, 123))))
    high = n - len(payload.translate(None, bytes(range(128, 256))))
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};"
        f"packets={sum(len(s.packets) for s in streams.values())};"
        f"seconds={','.join(f'{s.seconds():.4f}' for s in streams.values())};"
        f"letters={letters};high={high};zeros={payload.count(0)}"
    )


MEDIA_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long,"
    " media_bytes long, media_sha256 string, feature string, media binary, timestamps array<double>"
)


def media_columns(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """Each document's Ogg bytes (``media``), packet-page timestamps and read-back digests."""

    names = [c.split()[0] for c in MEDIA_SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.float64())]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                raw = encode(text)
                media = store(pad(raw))
                payload, streams = load(media)
                rows.append((
                    len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media),
                    hashlib.sha256(media).hexdigest(), feature(payload, streams),
                    media if with_media else None,
                    [g / RATE for s in streams.values() for g in s.granules] if with_media else None,
                ))
            columns = [batch["doc_id"].cast(pa.int64()), *[pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds[1:])]]
            yield pa.record_batch(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(convert, MEDIA_SCHEMA)
