"""Ogg columns: pages with checksums, packets by lacing values, logical streams, times by granule positions.

Bytes are stored as 8-bit mono samples of logical stream AUDIO, one packet per FRAME samples, beside a logical
stream META whose one data packet names the length before padding. Pages of the two interleave, so reading a file
back means verifying each page's checksum, putting packets together from their segments, and telling streams apart.
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
from pyspark.sql import types as T

from colonnade.llm.common import prepare, text_bytes

FRAME, RATE = 576, 8000
AUDIO, META = 0x41554431, 0x4D455441
AUDIO_MAGIC, META_MAGIC = b"\x80pcm8\x01", b"\x80meta\x01"
#: Fixed values of the container format: capture pattern, header layout, header flags.
CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """The format's CRC-32: generator 04c11db7, most significant bit first, no inversions.

    zlib's runs over the same generator with mirrored bits and inversions, which are undone here.
    """
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


@dataclass
class Page:
    serial: int
    sequence: int
    granule: int
    flags: int
    segments: bytes
    body: bytes


@dataclass
class Stream:
    """What one logical stream holds; granules has the position that each packet's last page gives, or -1, and follows
    says whether a packet stands right behind the one before it. gaps counts the places where pages are missing."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    follows: list[bool] = field(default_factory=list)
    pages: int = 0
    gaps: int = 0
    ended: bool = False
    #: Segments so far of a packet that goes on, the next page's number, whether a cut packet's rest is being passed over,
    #: and whether the next packet stands right behind the last one.
    parts: list[bytes] = field(default_factory=list)
    due: int = 0
    skipping: bool = False
    joined: bool = True

    def take(self, page: Page) -> None:
        """Add the packets that end in a page."""
        if page.sequence != self.due:
            self.gaps += 1
        if page.flags & CONTINUED:
            cut = page.sequence != self.due or not (self.parts or self.skipping)
            self.skipping |= cut
        else:
            cut = page.sequence != self.due or bool(self.parts)
            self.skipping = False
        if cut:
            self.parts.clear()
            self.joined = False
        self.due = page.sequence + 1
        self.pages += 1
        self.ended |= bool(page.flags & LAST)
        at, first = 0, len(self.packets)
        for lace in page.segments:
            if not self.skipping:
                self.parts.append(page.body[at : at + lace])
            at += lace
            if lace < 255:
                if not self.skipping:
                    self.packets.append(b"".join(self.parts))
                    self.granules.append(-1)
                    self.follows.append(self.joined)
                    self.joined = True
                self.parts.clear()
                self.skipping = False
        if len(self.packets) > first and page.granule >= 0:
            self.granules[-1] = page.granule

    def close(self) -> None:
        """No page follows; a stream without its last page has a gap there."""
        self.gaps += not self.ended
        self.parts.clear()


def page_bytes(page: Page) -> bytes:
    head = HEADER.pack(CAPTURE, 0, page.flags, page.granule, page.serial, page.sequence, 0, len(page.segments))
    raw = head + page.segments + page.body
    return raw[:22] + struct.pack("<I", checksum(raw)) + raw[26:]


def _lace(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def paginate(serial: int, packets: list[bytes], granules: list[int], most: int = 255) -> list[Page]:
    """Packets -> pages of at most `most` segments; the first packet, a header, has a page of its own."""
    pages: list[Page] = []
    segments, parts, granule, continued = b"", [], -1, False

    def close(flags: int = 0) -> None:
        nonlocal segments, parts, granule, continued
        flags |= (CONTINUED if continued else 0) | (0 if pages else FIRST)
        pages.append(Page(serial, len(pages), granule, flags, segments, b"".join(parts)))
        continued = segments[-1:] == b"\xff"
        segments, parts, granule = b"", [], -1

    for k, (packet, at) in enumerate(zip(packets, granules, strict=True)):
        lace, done = _lace(len(packet)), 0
        while lace:
            room = most - len(segments)
            if not room:
                close()
                room = most
            taken, lace = lace[:room], lace[room:]
            size = sum(taken)
            segments += taken
            parts.append(packet[done : done + size])
            done += size
        granule = at
        if not k and len(packets) > 1:
            close()
    close(LAST)
    return pages


def write_payload(payload: bytes, plain: int) -> bytes:
    """An Ogg file that holds the payload as samples and `plain`, its length before padding, beside them."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    ends = np.minimum(np.arange(1, len(frames) + 1) * FRAME, len(payload)).tolist()
    audio = paginate(AUDIO, [AUDIO_MAGIC + struct.pack("<IB", RATE, 1), *frames], [0, *ends])
    meta = paginate(META, [META_MAGIC, struct.pack("<QQ", plain, len(payload))], [0, 0])
    heads = [audio.pop(0), meta.pop(0)]
    return b"".join(map(page_bytes, [*heads, audio[0], *meta, *audio[1:]]))


def read_pages(raw: bytes) -> Iterator[tuple[Page | None, int]]:
    """Each page in turn with its place; None in place of a page that its checksum refutes.

    After damage, reading goes on at the next capture pattern.
    """
    at, size = 0, len(raw)
    while (at := raw.find(CAPTURE, at)) >= 0:
        if at + HEADER.size > size:
            yield None, at
            return
        _, version, flags, granule, serial, sequence, crc, count = HEADER.unpack_from(raw, at)
        start = at + HEADER.size
        segments = raw[start : start + count]
        end = start + count + sum(segments)
        whole = raw[at:end]
        if version or len(segments) < count or end > size or checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            yield None, at
            at += 4
            continue
        yield Page(serial, sequence, granule, flags, segments, raw[start + count : end]), at
        at = end


def demultiplex(raw: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of damaged pages.

    A packet that a damaged or missing page cuts is left out. Any jump in a stream's page numbers counts as one of its
    gaps, and so does a missing last page.
    """
    streams: dict[int, Stream] = {}
    damaged = 0
    for page, _ in read_pages(raw):
        if page is None:
            damaged += 1
        else:
            streams.setdefault(page.serial, Stream()).take(page)
    for stream in streams.values():
        stream.close()
    return streams, damaged


@dataclass
class Media:
    """A file's samples, their length before padding, the seconds at which each packet of samples ends, and counts."""

    payload: bytes
    plain: int
    times: list[float | None]
    packets: int
    pages: int
    damaged: int
    gaps: int

    @property
    def duration(self) -> float:
        return next((t for t in reversed(self.times) if t is not None), 0.0)


def packet_ends(stream: Stream) -> list[int | None]:
    """The sample at which each packet ends: what pages give, and counted from there over packets that follow each other.

    None where a gap leaves it unknown.
    """
    ends: list[int | None] = [g if g >= 0 else None for g in stream.granules]
    for i in range(len(ends) - 2, -1, -1):
        if ends[i] is None and ends[i + 1] is not None and stream.follows[i + 1]:
            ends[i] = ends[i + 1] - len(stream.packets[i + 1])
    for i in range(1, len(ends)):
        if ends[i] is None and ends[i - 1] is not None and stream.follows[i]:
            ends[i] = ends[i - 1] + len(stream.packets[i])
    return ends


def read_payload(raw: bytes) -> Media:
    """The samples of a file from write_payload(); damaged files give what is intact, at RATE if the header is lost."""
    streams, damaged = demultiplex(raw)
    audio, meta = streams.get(AUDIO, Stream()), streams.get(META, Stream())
    head = bool(audio.packets) and audio.packets[0].startswith(AUDIO_MAGIC)
    rate = struct.unpack_from("<I", audio.packets[0], len(AUDIO_MAGIC))[0] if head else RATE
    packets, ends = audio.packets[head:], packet_ends(audio)[head:]
    payload = b"".join(packets)
    plain = next((struct.unpack("<QQ", p)[0] for p in meta.packets if len(p) == 16), len(payload))
    return Media(payload, plain, [None if e is None else e / rate for e in ends], len(packets), audio.pages + meta.pages, damaged, audio.gaps + meta.gaps)


def pad(text: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of FRAME."""
    return text + b"\xff" * (max(1, -(-len(text) // FRAME)) * FRAME - len(text))


def feature(media: Media) -> str:
    """Seconds, packets, pages, and of the samples the mean, root mean square and rate of zero crossings."""
    samples = np.frombuffer(media.payload, np.uint8)
    if not samples.size:
        return "0.0000:0:0:0.0000:0.0000:0.0000"
    centred = samples.astype(np.int16) - 128
    total, square = int(centred.sum(dtype=np.int64)), int(np.square(centred, dtype=np.int32).sum(dtype=np.int64))
    signs = centred >= 0
    crossings = int(np.count_nonzero(signs[1:] != signs[:-1])) / samples.size
    return f"{media.duration:.4f}:{media.packets}:{media.pages}:{total / samples.size:.4f}:{(square / samples.size) ** 0.5:.4f}:{crossings:.4f}"


def encode(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs with `text` -> the kept columns and `media`, the text's bytes stored as an Ogg file; null counts as empty."""
    prepare(docs.sparkSession)
    frame = docs.select(*keep, text_bytes().alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [write_payload(pad(t), len(t)) for t in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=[*batch.schema.names[:-1], "media"])

    return frame.mapInArrow(run, frame.drop("body").schema.add("media", "binary"))


def decode(stored: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with `media` -> the kept columns, n_bytes, payload, duration, times, packets, pages, damaged, gaps, feature.

    times has the seconds at which each packet ends, null where a gap leaves it unknown. A null or damaged file gives
    what is intact of it, possibly nothing; `damaged` counts the refuted pages, `gaps` the places where pages are missing.
    """
    prepare(stored.sparkSession)
    frame = stored.select(*keep, F.coalesce("media", F.lit(b"")).alias("media"))
    schema = frame.select("*").schema.add("n_bytes", "long").add("payload", "binary").add("duration", "double").add("times", T.ArrayType(T.DoubleType()))
    for name in ("packets", "pages", "damaged", "gaps"):
        schema = schema.add(name, "long")
    schema = schema.add("feature", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_payload(m) for m in batch.column("media").to_pylist()]
            columns = [
                pa.array([m.plain for m in found], pa.int64()),
                pa.array([m.payload for m in found], pa.binary()),
                pa.array([m.duration for m in found], pa.float64()),
                pa.array([m.times for m in found], pa.list_(pa.float64())),
                *(pa.array([getattr(m, k) for m in found], pa.int64()) for k in ("packets", "pages", "damaged", "gaps")),
                pa.array([feature(m) for m in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return frame.mapInArrow(run, schema)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
