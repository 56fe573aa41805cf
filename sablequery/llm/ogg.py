"""Ogg media columns.

Pages follow RFC 3533: capture pattern, flags, granule position, serial number, page sequence number, checksum, and
lacing values that say how packets cross page bounds. Reading verifies every page's checksum, rebuilds packets from the
lacing values, separates logical streams by serial number, and turns granule positions into timestamps.

The checksum (polynomial 0x04c11db7, most significant bit first, no inversion) is the mirror image of the CRC-32 in
zlib, so bytes and result are bit-reversed around zlib's C code instead of looping over bytes here.

A payload is stored as two logical streams: the samples, in packets of up to 960 unsigned 8-bit samples at 8 kHz whose
granule position counts samples, and a comment stream with the unpadded length. Serial numbers and all else come from
the payload, so equal texts give equal media. Media are a binary column of a table in the shared folder; each row is
encoded and decoded alone, and no task holds more than a batch.

Defined cases: null text is empty; an empty payload is padded to 192 spaces; a null doc_id keeps its row; repeated rows
are stored each; no rows give no rows; a text of any length is stored whole, in as many pages as it takes; other columns of
whatever names are ignored; damaged pages raise OggError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, stored, utf8_bytes

UNIT = 192
PACKET = 960
RATE = 8000
#: Fixed values of the format: capture pattern, and the flags for a continued packet, a stream's first and last page.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
NO_PACKET_ENDS = -1
HEAD = struct.Struct("<8sBBIH")
HEAD_NAME, NOTE_NAME = b"PCMu8\0\0\0", b"comment\0"
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """The bytes are not a whole, undamaged Ogg stream."""


def page_checksum(page: bytes) -> int:
    """Of a page whose checksum field is zero."""
    mirrored = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(REVERSED), "big")


def _page(body: bytes, lacing: bytes, flags: int, granule: int, serial: int, number: int) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    checksum = page_checksum(head + body)
    return head[:22] + checksum.to_bytes(4, "little") + head[26:] + body


def write_stream(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """Pages of one logical stream from (packet, granule position at its end); the first packet has its own page."""
    pages: list[bytes] = []
    lacing, body, granule, continued = bytearray(), bytearray(), NO_PACKET_ENDS, False

    def flush(last: bool, open_packet: bool) -> None:
        nonlocal lacing, body, granule, continued
        flags = CONTINUED * continued | FIRST * (not pages) | LAST * last
        pages.append(_page(bytes(body), bytes(lacing), flags, granule, serial, len(pages)))
        lacing, body, granule, continued = bytearray(), bytearray(), NO_PACKET_ENDS, open_packet

    for k, (packet, end) in enumerate(packets):
        segments = len(packet) // 255 + 1
        at = 0
        for j in range(segments):
            if len(lacing) == 255:
                flush(False, j > 0)
            part = packet[at : at + 255]
            lacing.append(len(part))
            body += part
            at += len(part)
        granule = end
        if k == 0 and len(packets) > 1:
            flush(False, False)
    flush(True, False)
    return pages


@dataclass
class LogicalStream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the page on which the packet ends
    pages: int = 0
    ended: bool = False
    partial: bytearray | None = None


def read_streams(media: bytes) -> dict[int, LogicalStream]:
    """Verify and separate: logical streams by serial number, in order of their first pages."""
    streams: dict[int, LogicalStream] = {}
    at = 0
    while at < len(media):
        if len(media) - at < HEADER.size:
            raise OggError("truncated page header")
        capture, version, flags, granule, serial, number, checksum, segments = HEADER.unpack_from(media, at)
        if capture != CAPTURE or version:
            raise OggError(f"no page at byte {at}")
        start = at + HEADER.size + segments
        lacing = media[at + HEADER.size : start]
        end = start + sum(lacing)
        if end > len(media) or len(lacing) < segments:
            raise OggError("truncated page")
        page = media[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            raise OggError(f"checksum of the page at byte {at}")
        stream = streams.get(serial)
        if stream is None:
            if not flags & FIRST:
                raise OggError("a stream without a first page")
            stream = streams[serial] = LogicalStream(serial)
        if number != stream.pages or stream.ended:
            raise OggError("a page is missing or out of order")
        if bool(flags & CONTINUED) != (stream.partial is not None):
            raise OggError("a packet's continuation is missing")
        stream.pages += 1
        _packets(stream, lacing, page[end - at - sum(lacing) :], granule)
        stream.ended = bool(flags & LAST)
        at = end
    if any(not s.ended or s.partial is not None for s in streams.values()):
        raise OggError("a stream has no last page")
    return streams


def _packets(stream: LogicalStream, lacing: bytes, body: bytes, granule: int) -> None:
    packet, at, start = stream.partial, 0, 0
    for value in lacing:
        at += value
        if value < 255:
            part = body[start:at]
            stream.packets.append(part if packet is None else bytes(packet) + part)
            stream.granules.append(granule)
            packet, start = None, at
    if lacing and lacing[-1] == 255:
        packet = (packet or bytearray()) + body[start:at]
    stream.partial = packet


def padded(text: bytes) -> bytes:
    short = -len(text) % UNIT if text else UNIT
    return text + b" " * short


def encode_media(text: bytes) -> bytes:
    """A physical stream with the payload's samples and its comment stream, pages interleaved."""
    payload = padded(text)
    serial = zlib.crc32(payload)
    samples = [(HEAD.pack(HEAD_NAME, 1, 8, RATE, PACKET), 0)]
    samples += [(payload[at : at + PACKET], min(at + PACKET, len(payload))) for at in range(0, len(payload), PACKET)]
    notes = [(NOTE_NAME, 0), (struct.pack("<Q", len(text)), 0)]
    one, two = write_stream(samples, serial), write_stream(notes, serial ^ 0xFFFFFFFF)
    return b"".join([one[0], two[0], *two[1:], *one[1:]])


def decode_media(media: bytes) -> dict:
    """The payload, the unpadded length, and features: streams, pages, packets, seconds, times at which pages end."""
    streams = read_streams(media)
    audio = next((s for s in streams.values() if s.packets[0][:8] == HEAD_NAME), None)
    notes = next((s for s in streams.values() if s.packets[0] == NOTE_NAME), None)
    if audio is None or notes is None:
        raise OggError("a logical stream is missing")
    _, _, bits, rate, _ = HEAD.unpack(audio.packets[0])
    payload = b"".join(audio.packets[1:])
    times = sorted({g for g in audio.granules if g >= 0})
    if times[-1] * bits // 8 != len(payload):
        raise OggError("the last granule position doesn't match the samples")
    (length,) = struct.unpack("<Q", notes.packets[1])
    pages = sum(s.pages for s in streams.values())
    packets = sum(len(s.packets) for s in streams.values())
    mean = sum(payload) / len(payload)
    feature = f"streams={len(streams)};pages={pages};packets={packets};rate={rate};seconds={times[-1] / rate:.6f};first_page_end={times[min(1, len(times) - 1)] / rate:.6f};mean={mean:.6f};peak={max(payload)}"
    return {"payload": payload, "n_bytes": length, "feature": feature}


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary), written to the shared folder."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": batch.column(0), "media": pa.array([encode_media(x) for x in utf8_bytes(batch.column(1))], pa.binary())})

    return stored(map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), encode, "doc_id long, media binary"), "ogg-media")


def media_features(media: DataFrame) -> DataFrame:
    """Read each stored medium back and describe it."""

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for x in batch.column(1).to_pylist():
            found = decode_media(x)
            payload = found["payload"]
            rows.append((found["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(x), hashlib.sha256(x).hexdigest(), found["feature"]))
        names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        return pa.record_batch({"doc_id": batch.column(0)} | {n: pa.array(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)})

    return map_batches(media.select("doc_id", "media"), decode, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
