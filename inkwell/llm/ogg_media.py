"""Media columns: bytes stored losslessly in Ogg and read back.

A file holds two logical streams whose pages alternate: an "info" stream (one packet that names the sample format)
and a "samples" stream (a header packet, then packets of at most `PACKET` 8-bit samples at `RATE` Hz). Packets are laced into
segments of at most 255 bytes; a page has at most 255 of them and a checksum. A page's granule position counts the
samples of the packets that end on it, or is -1 where none does. Reading verifies each checksum and page number,
splits the pages by serial number, joins packets by their lacing values and takes times from granule positions.

Cases: a null or empty text becomes 64 zero bytes; nothing depends on the document but its text, so equal texts give
equal values; repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, whole_text

ALIGN = 64
RATE = 8000
PACKET = 4000
_INFO, _SAMPLES = 1, 2
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")


class OggError(ValueError):
    """Bytes that aren't a well-formed Ogg file."""


def page_crc(data: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, from 0: zlib's, on bit-reversed bytes."""
    register = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(register.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def _pages(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream; a packet comes with the granule position at its end. The first packet has a page of its own."""
    out, lacing, body, granule, carried = [], bytearray(), bytearray(), -1, False

    def close(last: bool, goes_on: bool) -> None:
        nonlocal lacing, body, granule, carried
        flags = (1 if carried else 0) | (2 if not out else 0) | (4 if last else 0)
        out.append(_page(flags, granule, serial, len(out), bytes(lacing), bytes(body)))
        lacing, body, granule, carried = bytearray(), bytearray(), -1, goes_on

    for k, (data, at) in enumerate(packets):
        laces = [255] * (len(data) // 255) + [len(data) % 255]
        start = 0
        for i, n in enumerate(laces):
            if len(lacing) == 255:
                close(False, i > 0)
            lacing.append(n)
            body += data[start : start + n]
            start += n
        granule = at
        if k == 0 or k == len(packets) - 1:
            close(k == len(packets) - 1, False)
    return out


def write_ogg(payload: bytes) -> bytes:
    info = _pages([(b"\x80info\0format=u8;rate=%d;channels=1" % RATE, 0)], _INFO)
    packets = [(b"\x80samples\0" + struct.pack("<IBB", RATE, 1, 8), 0)]
    packets += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    samples = _pages(packets, _SAMPLES)
    return b"".join([samples[0], info[0], *samples[1:], *info[1:]])


@dataclass
class Stream:
    """One logical stream: its packets, and for each packet that is the last to end on a page (index, granule position)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    begun: bool = False
    ended: bool = False
    partial: bytearray | None = None


def read_ogg(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; raises OggError on bad pages, checksums, page numbers or lacing."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise OggError("short page header")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError("no page here")
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("short page")
        if page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError("wrong checksum")
        s = streams.setdefault(serial, Stream())
        if s.ended or number != s.pages or bool(flags & 2) != (not s.begun) or bool(flags & 1) != (s.partial is not None):
            raise OggError("page out of order")
        s.begun, s.pages, s.ended = True, s.pages + 1, bool(flags & 4)
        whole = len(s.packets)
        part = s.partial if s.partial is not None else bytearray()
        opened = s.partial is not None
        for n in lacing:
            part += data[body : body + n]
            body += n
            opened = n == 255
            if not opened:
                s.packets.append(bytes(part))
                part = bytearray()
        s.partial = part if opened else None
        if (len(s.packets) > whole) != (granule != -1):
            raise OggError("granule position without a packet's end")
        if granule != -1:
            s.granules.append((len(s.packets) - 1, granule))
        at = end
    if any(s.partial is not None or not s.ended for s in streams.values()):
        raise OggError("stream not ended")
    return streams


def read_samples(data: bytes) -> tuple[bytes, dict[str, int]]:
    """The payload, and features: pages, packets, streams, duration in milliseconds and time of the middle page."""
    streams = read_ogg(data)
    s = streams[_SAMPLES]
    if not s.packets[0].startswith(b"\x80samples\0"):
        raise OggError("no sample header")
    rate = struct.unpack_from("<I", s.packets[0], 9)[0]
    payload = b"".join(s.packets[1:])
    if s.granules[-1][1] != len(payload):
        raise OggError("granule positions don't match the samples")
    times = [g * 1000 // rate for _, g in s.granules]
    return payload, {"streams": len(streams), "pages": sum(x.pages for x in streams.values()), "packets": len(s.packets), "ms": times[-1], "mid_ms": times[len(times) // 2]}


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = {c: b[c].to_pylist() for c in ("doc_id", "text")}
        for part in slices(lists, "text"):
            rows = []
            for text in part["text"]:
                raw = text.encode("utf-8", "surrogatepass")
                n = max(ALIGN, -(-len(raw) // ALIGN) * ALIGN)
                media = write_ogg(raw.ljust(n, b"\0"))
                rows.append((len(raw), media))
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: an Ogg file per document as a binary column."""
    ship(docs.sparkSession)
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(_media, "doc_id long, n_bytes long, media binary")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for doc, n, media in zip(*(c.to_pylist() for c in b.columns), strict=True):
            payload, f = read_samples(media)
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), ";".join(f"{k}={v}" for k, v in f.items())))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def media_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: read from the stored files."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return encode_media(docs).mapInArrow(_report, schema)
