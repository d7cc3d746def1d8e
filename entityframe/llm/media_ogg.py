"""Media columns: Ogg containers in a binary column, written and read with numpy and zlib.

Pages carry the checksum of the format (polynomial 0x04C11DB7, no reflection, zero
start), packets are cut into lacing values, logical streams are told apart by their
serial numbers, and timestamps come from granule positions.

Defined results: null or empty texts are 64 zero bytes of payload; very long texts give
many pages; equal texts and repeated rows give equal files (serials derive from the payload);
an empty table gives an empty one; other columns of the input don't matter. A damaged page
raises ``ValueError``.
"""

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

from .common import release, text_batches

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
#: Samples in an audio packet, and samples a second of the timestamps.
PACKET, RATE = 4096, 8000


def page_checksum(page: bytes) -> int:
    """The page's checksum: zlib's reflected one over bit-reversed bytes, turned back."""
    c = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(c.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the page on which each packet ends; -1: another packet's
    ended: bool = False


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + struct.pack("<I", page_checksum(whole)) + whole[26:]


def pages_of(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """One logical stream's pages; the first packet stands alone on the first page."""
    out, lacing, body, granule, continued = [], bytearray(), bytearray(), -1, False

    def close(last: bool, next_continued: bool) -> None:
        nonlocal lacing, body, granule, continued
        flags = (1 if continued else 0) | (2 if not out else 0) | (4 if last else 0)
        out.append(_page(serial, len(out), flags, granule, bytes(lacing), bytes(body)))
        lacing, body, granule, continued = bytearray(), bytearray(), -1, next_continued

    for k, (packet, g) in enumerate(zip(packets, granules, strict=True)):
        values = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        at = used = 0
        while used < len(values):
            if len(lacing) == 255:
                close(False, at > 0)
            take = values[used : used + 255 - len(lacing)]
            lacing += take
            size = sum(take)
            body += packet[at : at + size]
            at, used = at + size, used + len(take)
        granule = g
        if k == 0 and len(packets) > 1:
            close(False, False)
    close(True, False)
    return out


def encode(payload: bytes) -> bytes:
    """``payload`` as 8-bit samples of an audio stream, multiplexed with a stream of marks."""
    serial = zlib.crc32(payload)
    head = b"\x7fPCM8\x00" + struct.pack("<IQ", RATE, len(payload))
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min(len(payload), i + PACKET) for i in range(0, len(payload), PACKET)]
    audio = pages_of(serial, [head, *parts], [0, *ends])
    marks = pages_of(serial ^ 0x5A5A5A5A, [b"\x7fMARK\x00", struct.pack("<Q", len(parts))], [0, len(payload)])
    return b"".join([audio[0], marks[0], *audio[1:], *marks[1:]])


def demux(data: bytes) -> dict[int, Stream]:
    """Verified pages, packets reassembled by stream."""
    streams: dict[int, Stream] = {}
    open_parts: dict[int, bytearray] = {}
    numbers: dict[int, int] = {}
    at = 0
    while at < len(data):
        magic, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        start = at + 27 + n
        end = start + sum(lacing)
        if end > len(data) or page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise ValueError(f"damaged page at byte {at}")
        if flags & 2:
            if serial in streams:
                raise ValueError(f"stream {serial} begins twice")
            streams[serial], open_parts[serial], numbers[serial] = Stream(serial), bytearray(), 0
        s, part = streams[serial], open_parts[serial]
        if numbers[serial] != number or bool(flags & 1) != bool(part):
            raise ValueError(f"lost page before byte {at}")
        numbers[serial] += 1
        pos, done = start, len(s.packets)
        for v in lacing:
            part += data[pos : pos + v]
            pos += v
            if v < 255:
                s.packets.append(bytes(part))
                s.granules.append(-1)
                part.clear()
        if len(s.packets) > done:
            s.granules[-1] = granule
        s.ended = bool(flags & 4)
        at = end
    if any(open_parts.values()) or not all(s.ended for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def decode(data: bytes) -> tuple[bytes, Stream, int]:
    """(payload, audio stream, count of streams) of a file made by :func:`encode`."""
    streams = demux(data)
    audio = next(s for s in streams.values() if s.packets[0].startswith(b"\x7fPCM8\x00"))
    return b"".join(audio.packets[1:]), audio, len(streams)


def timestamps(audio: Stream) -> list[tuple[int, float]]:
    """(packet number, seconds at its end) of every packet.

    A page's granule position is the count of samples at the end of its last packet; from there
    the packets before it on the page are reached by the samples that each holds.
    """
    ends = list(audio.granules)
    for i in range(len(ends) - 2, -1, -1):
        if ends[i] < 0:
            ends[i] = ends[i + 1] - len(audio.packets[i + 1])
    return [(i, g / RATE) for i, g in enumerate(ends)]


def feature_of(payload: bytes, audio: Stream, streams: int) -> str:
    """Loudness, zero crossings and last timestamp of the samples read back."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    rms = float(np.sqrt(np.mean(x.astype(np.float64) ** 2)))
    return f"streams={streams};packets={len(audio.packets) - 1};seconds={timestamps(audio)[-1][1]:.6f};rms={rms:.4f};crossings={crossings}"


def padded(text: bytes) -> bytes:
    return text + b"\0" * ((-len(text)) % 64 or (0 if text else 64))


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media binary) of every row."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_batches(batches, "_text"):
            media = [encode(padded(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], names=["_id", "n_bytes", "media"])
        release()

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(step, f"_id {kind}, n_bytes long, media binary").withColumnRenamed("_id", id_col)


def read_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of every media file: pages verified, payload reassembled."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n, data in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                stored_form = data.as_py()
                payload, audio, streams = decode(stored_form)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored_form), hashlib.sha256(stored_form).hexdigest(), feature_of(payload, audio, streams)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    names = ["_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    src = media.select(F.col(id_col).alias("_id"), "n_bytes", "media")
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(step, f"_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("_id", id_col)
