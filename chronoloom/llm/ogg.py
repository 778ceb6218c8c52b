"""Media columns as Ogg: two multiplexed logical streams of 8-bit samples.

A text's bytes, padded with spaces to whole blocks, are the samples. Even blocks go to
one logical stream and odd blocks to another. The reader verifies every page's checksum
and sequence number, demultiplexes by serial number, reassembles packets from lacing
values and derives timestamps from granule positions.

Defined results: null text is stored as an empty text is, one block of spaces; equal texts
give equal bytes (serial numbers come from the content); damaged pages raise
``ValueError``; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded

BLOCK = 192
#: Samples of one packet; its ten blocks need eight lacing values, so packets span pages.
PACKET = 10 * BLOCK
RATE = 8000
_HEAD = struct.Struct("<4sBBqIIIB")
_MAGIC = b"\x01pcm8ogg"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """The container's CRC (0x04c11db7, most significant bit first, from zero).

    It is the bit-reversed image of the common CRC-32 over bit-reversed bytes.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def _page(flags: int, granule: int, serial: int, number: int, segments: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(segments))
    crc = page_checksum(head + segments + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + segments + body


def _stream_pages(serial: int, packets: list[bytes], samples: list[int]) -> list[bytes]:
    """Pages of one logical stream; ``samples`` has the granule after each packet."""
    pages = [_page(2, 0, serial, 0, lacing(len(packets[0])), packets[0])]
    segments, ends = bytearray(), []
    for p in packets[1:]:
        segments += lacing(len(p))
        ends.append(len(segments))
    body, at, done = b"".join(packets[1:]), 0, 0
    for first in range(0, len(segments), 255):
        values = bytes(segments[first : first + 255])
        before = done
        while done < len(ends) and ends[done] <= first + len(values):
            done += 1
        flags = (first > 0 and segments[first - 1] == 255) | 4 * (first + 255 >= len(segments))
        size = sum(values)
        granule = samples[done] if done > before else -1
        pages.append(_page(flags, granule, serial, len(pages), values, body[at : at + size]))
        at += size
    if len(pages) == 1:
        pages.append(_page(4, 0, serial, 1, b"", b""))
    return pages


def write(payload: bytes) -> bytes:
    """The payload (whole blocks) as a physical stream of two interleaved logical ones."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    serial = zlib.crc32(payload)
    streams = []
    for lane in (0, 1):
        data = blocks[lane::2].tobytes()
        parts = [data[i : i + PACKET] for i in range(0, len(data), PACKET)]
        head = _MAGIC + struct.pack("<BBIQ", lane, 2, RATE, len(payload))
        granules = [0, *np.cumsum([len(p) for p in parts]).tolist()]
        streams.append(_stream_pages((serial + lane) & 0xFFFFFFFF, [head, *parts], granules))
    out = [s[0] for s in streams]
    for i in range(1, max(map(len, streams))):
        out += [s[i] for s in streams if i < len(s)]
    return b"".join(out)


@dataclass
class Stream:
    """What was read of one logical stream; ``times`` has each page's end in seconds."""

    pages: int = 0
    ended: bool = False
    segments: bytearray = field(default_factory=bytearray)
    bodies: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)

    @property
    def packets(self) -> list[bytes]:
        values = np.frombuffer(bytes(self.segments), np.uint8)
        stops = np.cumsum(values)[values < 255].tolist()
        if len(values) and values[-1] == 255:
            raise ValueError("the last packet has no end")
        body = b"".join(self.bodies)
        return [body[a:b] for a, b in zip([0, *stops], stops)]

    @property
    def times(self) -> list[float]:
        return [g / RATE for g in self.granules if g >= 0]


def read(media: bytes) -> dict[int, Stream]:
    """The logical streams by serial number, every page verified."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(media):
        if len(media) < at + _HEAD.size:
            raise ValueError("a page's head is cut off")
        magic, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        body_at = at + _HEAD.size + count
        segments = media[at + _HEAD.size : body_at]
        end = body_at + sum(segments)
        if len(segments) < count or end > len(media):
            raise ValueError("a page is cut off")
        if page_checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"wrong checksum of the page at byte {at}")
        if flags & 2 and serial in streams:
            raise ValueError("a stream begins twice")
        stream = streams.setdefault(serial, Stream())
        open_packet = bool(stream.segments) and stream.segments[-1] == 255
        if number != stream.pages or stream.ended or bool(flags & 1) != open_packet:
            raise ValueError(f"a page of stream {serial} is missing")
        stream.pages += 1
        stream.ended = bool(flags & 4)
        stream.segments += segments
        stream.bodies.append(media[body_at:end])
        stream.granules.append(granule)
        at = end
    if not all(s.ended for s in streams.values()):
        raise ValueError("a stream has no end")
    return streams


def payload_of(streams: dict[int, Stream]) -> bytes:
    """The samples of both lanes, put back in order, checked against granule positions."""
    lanes, total = {}, 0
    for stream in streams.values():
        head, *parts = stream.packets
        if not head.startswith(_MAGIC):
            raise ValueError("an unknown stream")
        lane, _, _, total = struct.unpack_from("<BBIQ", head, len(_MAGIC))
        lanes[lane] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, BLOCK)
        if max(stream.granules) != lanes[lane].size:
            raise ValueError("granule positions do not match the samples")
    out = np.empty((total // BLOCK, BLOCK), np.uint8)
    for lane, blocks in lanes.items():
        out[lane::2] = blocks
    return out.tobytes()


def padded(text: str | None) -> bytes:
    data = (text or "").encode("utf-8")
    return data + b" " * ((-len(data)) % BLOCK if data else BLOCK)


def encode(texts: pd.Series) -> pd.Series:
    return pd.Series([write(padded(t)) for t in texts], dtype="object")


def feature(streams: dict[int, Stream], payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    crossings = int(np.count_nonzero(np.diff(np.signbit(x))))
    pages = sum(s.pages for s in streams.values())
    packets = sum(len(s.packets) - 1 for s in streams.values())
    seconds = max(t for s in streams.values() for t in s.times)
    mean, power = float(x.mean(dtype=np.float64)), float(np.sqrt(np.square(x).mean(dtype=np.float64)))
    return (
        f"streams={len(streams)};pages={pages};packets={packets};seconds={seconds:.3f};"
        f"mean={mean:.4f};rms={power:.4f};crossings={crossings}"
    )


_DESCRIBED = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, seconds double"
)


def describe(media: pd.Series) -> pd.DataFrame:
    out = []
    for m in media:
        streams = read(m)
        payload = payload_of(streams)
        out.append(
            (
                len(payload),
                hashlib.sha256(payload).hexdigest(),
                zlib.crc32(payload[-16:]),
                len(m),
                hashlib.sha256(m).hexdigest(),
                feature(streams, payload),
                len(payload) / RATE,
            )
        )
    return pd.DataFrame(out, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds"])


def decode(media: pd.Series) -> pd.Series:
    return pd.Series([payload_of(read(m)) for m in media], dtype="object")


def media_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the stored form of every text."""
    return bounded(docs).select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.pandas_udf(encode, "binary")(F.col(text_col)).alias("media"),
    )


def described(media: DataFrame, column: str | Column = "media") -> DataFrame:
    col = F.col(column) if isinstance(column, str) else column
    return media.withColumn("d", F.pandas_udf(describe, _DESCRIBED)(col)).select(*[c for c in media.columns if c != column], "d.*")
