"""Media columns in Ogg: pages, packets and logical streams written and read, with checksums and times.

A payload is stored as unsigned 8-bit mono samples in one logical stream, with the header (big-endian) of the OggPCM
layout, beside a second logical stream of our own that indexes it (one packet for each data packet: its first sample and length); pages of the two
are interleaved, as a multiplexed Ogg file has them. Reading verifies every page's CRC-32 and sequence
number, reassembles packets from lacing values (also across pages), takes the streams apart by serial
number, and turns granule positions (samples so far) into times.

Defined cases: null text is an empty text (64 bytes of 0 are stored); a text is held whole in its task, however long; equal texts give equal media;
repeated rows give one result each; an empty table gives an empty result; other columns are left out.
A damaged page raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RATE, PACKET, PAGE_SEGMENTS = 8000, 4096, 255
PCM, INDEX = 0x50434D31, 0x494E4458
# Fixed value: the OggPCM header's code of unsigned 8-bit samples.
UNSIGNED_8 = 1
_HEAD = "<4sBBqIIIB"
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(data: bytes) -> int:
    """Ogg's CRC-32 (0x04C11DB7, most significant bit first, no inversion), by way of zlib's reflected one."""
    return int(f"{zlib.crc32(data.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


class Page(NamedTuple):
    serial: int
    sequence: int
    flags: int  # 1: goes on a packet, 2: first of its stream, 4: last
    granule: int
    lacing: bytes
    body: bytes


def page_bytes(page: Page) -> bytes:
    head = struct.pack(_HEAD, b"OggS", 0, page.flags, page.granule, page.serial, page.sequence, 0, len(page.lacing)) + page.lacing
    crc = page_crc(head + page.body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + page.body


class Stream:
    """Packets of one logical stream into pages."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0

    def pages(self, packets: list[tuple[bytes, int]], first: bool = False, last: bool = False) -> Iterator[bytes]:
        """packets: (data, granule position at its end). Packets may run over several pages."""
        lacing, body, granule, goes_on = bytearray(), bytearray(), -1, False
        made: list[tuple[bytes, bytes, int, bool]] = []
        for data, end in packets:
            whole, rest = divmod(len(data), 255)
            values = b"\xff" * whole + bytes([rest])
            while values:
                room = PAGE_SEGMENTS - len(lacing)
                part, values = values[:room], values[room:]
                n = sum(part)
                lacing += part
                body += data[:n]
                data = data[n:]
                if not values:
                    granule = end
                if len(lacing) == PAGE_SEGMENTS:
                    made.append((bytes(lacing), bytes(body), granule, goes_on))
                    lacing, body, granule, goes_on = bytearray(), bytearray(), -1, bool(values)
        if lacing or not made:
            made.append((bytes(lacing), bytes(body), granule, goes_on))
        for k, (table, content, at, onward) in enumerate(made):
            flags = onward | 2 * (first and k == 0) | 4 * (last and k == len(made) - 1)
            yield page_bytes(Page(self.serial, self.sequence, flags, at, table, content))
            self.sequence += 1


def write_media(payload: bytes, rate: int = RATE) -> bytes:
    pcm, index, out = Stream(PCM), Stream(INDEX), []
    out += pcm.pages([(b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, UNSIGNED_8, rate, 8, 1, 0, 0), 0)], first=True)
    out += index.pages([(b"RVINDEX\0" + struct.pack(">II", PACKET, rate), 0)], first=True)
    step = PACKET * 16
    for a in range(0, max(1, len(payload)), step):
        part, last = payload[a : a + step], a + step >= len(payload)
        cuts = [(a + b, part[b : b + PACKET]) for b in range(0, len(part), PACKET)]
        out += pcm.pages([(x, at + len(x)) for at, x in cuts], last=last)
        out += index.pages([(struct.pack("<QI", at, len(x)), at + len(x)) for at, x in cuts], last=last)
    return b"".join(out)


def read_pages(media: bytes) -> Iterator[Page]:
    at = 0
    while at < len(media):
        magic, version, flags, granule, serial, sequence, crc, n = struct.unpack_from(_HEAD, media, at)
        if magic != b"OggS" or version:
            raise ValueError(f"no Ogg page at byte {at}")
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = media[at:end]
        if len(lacing) < n or end > len(media) or page_crc(page[:22] + bytes(4) + page[26:]) != crc:
            raise ValueError(f"the Ogg page at byte {at} fails its checksum")
        yield Page(serial, sequence, flags, granule, lacing, page[27 + n :])
        at = end


class Packet(NamedTuple):
    data: bytes
    granule: int  # of the page on which it ends; -1 if another packet ends after it there


def demultiplex(media: bytes) -> dict[int, list[Packet]]:
    """serial -> packets, with sequence numbers, first and last pages checked."""
    streams: dict[int, list[Packet]] = {}
    held: dict[int, bytes | None] = {}
    due: dict[int, int] = {}
    ended = set()
    for page in read_pages(media):
        s = page.serial
        if (s not in due) != bool(page.flags & 2) or page.sequence != due.get(s, 0) or s in ended or (held.get(s) is not None) != bool(page.flags & 1):
            raise ValueError(f"stream {s:#x} is broken at page {page.sequence}")
        due[s], at, data = page.sequence + 1, 0, held.get(s)
        packets = streams.setdefault(s, [])
        run, mark = 0, len(packets)
        for value in page.lacing:
            run += value
            if value < 255:
                packets.append(Packet((data or b"") + page.body[at : at + run], -1))
                at, run, data = at + run, 0, None
        held[s] = (data or b"") + page.body[at:] if run or (page.lacing and page.lacing[-1] == 255) else data
        if len(packets) > mark:
            packets[-1] = packets[-1]._replace(granule=page.granule)
        if page.flags & 4:
            ended.add(s)
    if ended != set(streams) or any(x is not None for x in held.values()):
        raise ValueError("a stream has no last page")
    return streams


class Media(NamedTuple):
    payload: bytes
    rate: int
    seconds: float
    packets: int
    times: list[float]  # end of each page's last packet


def read_media(media: bytes) -> Media:
    streams = demultiplex(media)
    head, *data = streams[PCM]
    _, *index = streams[INDEX]
    if head.data[:8] != b"PCM     ":
        raise ValueError("the first stream holds no PCM samples")
    coding, rate = struct.unpack_from(">II", head.data, 12)
    if coding != UNSIGNED_8:
        raise ValueError(f"samples of coding {coding:#x} are not read here")
    at = 0
    for packet, entry in zip(data, index, strict=True):
        if struct.unpack("<QI", entry.data) != (at, len(packet.data)) or packet.granule not in (-1, at + len(packet.data)):
            raise ValueError(f"packet at sample {at} and its index or granule position differ")
        at += len(packet.data)
    return Media(b"".join(x.data for x in data), rate, at / rate, len(data), [x.granule / rate for x in data if x.granule >= 0])


def padded(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % 64 if payload else 64)


def features(media: Media) -> str:
    """Length in time, packets, and the samples' mean, deviation and crossings of the mean level."""
    samples = np.frombuffer(media.payload, np.uint8)
    crossings = int(np.count_nonzero((samples[1:] >= 128) != (samples[:-1] >= 128)))
    return f"seconds={media.seconds:.3f};packets={media.packets};pages={len(media.times)};mean={samples.mean():.4f};std={samples.std():.4f};crossings={crossings}"


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE) -> DataFrame:
    """(doc_id, n_bytes, media binary) for every row."""
    slim = docs.select(common.id_of(docs, id_col).alias(id_col), common.text_of(docs, text_col).alias("__text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in common.in_parts(rows, 256):
                texts = [x.as_py().encode() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array([write_media(padded(x), rate) for x in texts], pa.binary())], [id_col, "n_bytes", "media"])

    return slim.mapInArrow(task, f"`{id_col}` {common.id_kind(docs, id_col)}, n_bytes long, media binary")


def read_column(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read media back: payload and media digests, and features."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: list[tuple] = []
            for stored in rows.column("media"):
                data = stored.as_py()
                read = read_media(data)
                out.append((len(read.payload), hashlib.sha256(read.payload).hexdigest(), zlib.crc32(read.payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(read)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(x, kind) for x, kind in zip(zip(*out) if out else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([rows.column(id_col), rows.column("n_bytes"), *columns], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select(id_col, "n_bytes", "media").mapInArrow(task, f"`{id_col}` {common.id_kind(media, id_col)}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media in a table in the shared folder, and read that table."""
    return read_column(common.written(encode(docs, id_col, text_col), common.shared_folder(docs.sparkSession, "ogg"), "media"), id_col)
