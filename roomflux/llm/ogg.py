"""Media columns in Ogg: a lossless container of 8-bit samples, written, read back and described.

A payload is stored as two logical streams, of the samples at even and at odd places (its left and right channel), in packets
of ``PACKET`` samples. The reader verifies the checksum of each page, reassembles packets from lacing values, also across
pages, tells the streams apart by serial number, and takes a packet's time from the granule position of its page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomflux.llm.batches import bounded, slices

RATE = 8000
PACKET = 4000
SEGMENTS = 255
MAGIC = b"\x7fPCM8"
HEAD = "<4sBBqIIIB"
HEAD_SIZE = struct.calcsize(HEAD)
#: Each byte with its bits in reverse: the container's checksum shifts left, the library's shifts right.
_REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def page_crc(page: bytes) -> int:
    """Polynomial 0x04c11db7, register 0, no final inversion, most significant bit first."""
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes and zero bytes up to a positive multiple of 64; the length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def _pages(serial: int, packets: list[tuple[bytes, int]]) -> list[tuple[int, bytes]]:
    """(granule, page) of one logical stream; packets carry the granule position that they end at."""
    segments: list[tuple[bytes, int, bool]] = []  # data, granule or -1, starts a packet
    for data, granule in packets:
        pieces = [data[k : k + 255] for k in range(0, len(data) + 1, 255)]  # a last piece of under 255 bytes ends a packet
        segments += [(p, granule if k == len(pieces) - 1 else -1, k == 0) for k, p in enumerate(pieces)]
    out, last = [], 0
    chunks = [segments[:1], *(segments[k : k + SEGMENTS] for k in range(1, len(segments), SEGMENTS))]  # the first page holds the header alone
    for number, page in enumerate(chunks):
        granule = max((g for _, g, _ in page), default=-1)
        flags = (0 if page[0][2] else 1) | (2 if number == 0 else 0) | (4 if number == len(chunks) - 1 else 0)
        head = struct.pack(HEAD, b"OggS", 0, flags, granule, serial, number, 0, len(page)) + bytes(len(p) for p, _, _ in page)
        raw = head + b"".join(p for p, _, _ in page)
        out.append((max(granule, last), raw[:22] + page_crc(raw).to_bytes(4, "little") + raw[26:]))
        last = max(granule, last)
    return out


def mux(payload: bytes) -> bytes:
    """The payload as two logical streams, headers first, then pages by granule position."""
    serial = zlib.crc32(payload)
    streams = []
    for channel in (0, 1):
        own = payload[channel::2]
        head = MAGIC + struct.pack("<BIQ", channel, RATE, len(own))
        packets = [(head, 0), *((own[k : k + PACKET], min(len(own), k + PACKET)) for k in range(0, len(own), PACKET))]
        streams += [(granule, page[18:22] != b"\0\0\0\0", channel, n, page) for n, (granule, page) in enumerate(_pages((serial + channel) % 2**32, packets))]
    streams.sort(key=lambda x: x[:4])
    return b"".join(page for *_, page in streams)


def demux(media: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """serial: packets with the granule position of the page on which each ends. Raises ValueError on a broken page."""
    streams: dict[int, list[tuple[bytes, int]]] = {}
    partial: dict[int, bytearray] = {}
    numbers: dict[int, int] = {}
    at = 0
    while at < len(media):
        if len(media) < at + HEAD_SIZE:
            raise ValueError("page cut off")
        capture, version, flags, granule, serial, number, crc, n = struct.unpack_from(HEAD, media, at)
        lacing = media[at + HEAD_SIZE : at + HEAD_SIZE + n]
        end = at + HEAD_SIZE + n + sum(lacing)
        if capture != b"OggS" or version or len(lacing) < n or end > len(media):
            raise ValueError("not a page")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError("page checksum")
        if number != numbers.get(serial, -1) + 1 or bool(flags & 1) != bool(partial.get(serial)) or bool(flags & 2) != (number == 0):
            raise ValueError("page order")
        numbers[serial] = number
        found, own, place = streams.setdefault(serial, []), partial.setdefault(serial, bytearray()), at + HEAD_SIZE + n
        for lace in lacing:
            own += media[place : place + lace]
            place += lace
            if lace < 255:
                found.append((bytes(own), granule))
                own.clear()
        at = end
    if any(partial.values()):
        raise ValueError("packet cut off")
    return streams


def read(media: bytes) -> tuple[bytes, list[tuple[int, float]]]:
    """The payload, and (channel, end time in seconds) of each packet of samples."""
    channels: dict[int, bytes] = {}
    times = []
    for packets in demux(media).values():
        head = packets[0][0]
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("unknown stream")
        channel, rate, n = struct.unpack_from("<BIQ", head, len(MAGIC))
        channels[channel] = b"".join(p for p, _ in packets[1:])
        if len(channels[channel]) != n or packets[-1][1] != n:
            raise ValueError("samples missing")
        times += [(channel, granule / rate) for _, granule in packets[1:]]
    out = bytearray(sum(map(len, channels.values())))
    out[0::2], out[1::2] = channels[0], channels[1]
    return bytes(out), times


def describe(payload: bytes, times: list[tuple[int, float]]) -> str:
    """Features of samples centred at 128: seconds, packets, mean, root mean square, zero crossings and peak."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(((x[:-1] < 0) != (x[1:] < 0)).sum())
    return f"s={max(t for _, t in times):.6f};packets={len(times)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};zc={crossings};peak={int(np.abs(x).max())}"


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):  # small batches: media is as large as the text
            made = [payload_of(t.as_py()) for t in s.column("text")]
            yield pa.RecordBatch.from_arrays([s.column("doc_id").cast(pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array([mux(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """The stored bytes read back: doc_id, n_bytes and digests of payload and media, and the feature string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column("media"):
                stored = m.as_py()
                payload, times = read(stored)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(payload, times)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame) -> DataFrame:
    """Each row's whole text stored as media and read back.

    A null text is an empty one (64 zero bytes); equal texts have equal values; a null doc_id and repeated rows are kept; an
    empty table gives an empty one; columns besides doc_id and text are ignored.
    """
    return decode(encode(docs))
