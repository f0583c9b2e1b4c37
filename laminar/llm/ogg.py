"""Media columns: bytes in Ogg streams of 8-bit samples, and their reading.

`to_ogg` stores each text's UTF-8 bytes, padded with zero bytes to a positive multiple
of 64, as the samples of a PCM stream (8-bit, mono, `RATE` a second; a header and a comment
packet come first). A second logical stream, interleaved with it, carries the number and the
CRC-32 of each sample packet. `from_ogg` verifies every page's checksum and sequence number,
rebuilds packets from lacing values across pages, separates the logical streams by serial
number, and turns granule positions into time stamps; packets are compared with their CRCs.

Contract: null and empty texts are 64 zero bytes. Reading raises no error, whatever the
bytes are: a page whose checksum fails or that is cut off is left out and reading goes on at
the next capture pattern; a packet that misses a part is left out. `damaged` counts runs of
bytes outside valid pages, gaps in page numbers, packets that miss a part, streams without their last page, sample
packets that don't match their CRC and packets that only one of the two streams has. Rows are
independent, repeated rows equal, extra columns ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_in_arrow, field

RATE, PACKET = 8000, 8192
#: Segments of a page: 255 at most by the format.
SEGMENTS = 255
SAMPLES, CHECKS = 0x50434D38, 0x43524332  # serial numbers
#: Version 0.0, format 1 (unsigned 8 bit), rate, significant bits, channels, frames of a packet at most, further headers.
FIRST_SAMPLES = b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, RATE, 8, 1, PACKET, 0)
#: Vendor and no comments, as in other audio mappings.
COMMENT = struct.pack("<I", 7) + b"laminar" + struct.pack("<I", 0)
FIRST_CHECKS = b"CRC32   "
CHECK = struct.Struct("<II")
HEAD = struct.Struct("<4sBBqIIIB")
TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's CRC-32: zlib's polynomial with bits in the other order, start and end value 0."""
    crc = zlib.crc32(page.translate(TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(TURNED), "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return b"".join((whole[:22], struct.pack("<I", page_crc(whole)), whole[26:]))


def stream_pages(serial: int, first: bytes, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of a logical stream; packets come with the granule position at their end."""
    pages = [page(2, 0, serial, 0, bytes([len(first)]), first)]
    lacing, body, granule, continued = bytearray(), bytearray(), -1, False
    last = len(packets) - 1
    for k, (data, end) in enumerate(packets):
        segments = [255] * (len(data) // 255) + [len(data) % 255]
        at = 0
        for j, n in enumerate(segments):
            lacing.append(n)
            body += data[at : at + n]
            at += n
            done = j == len(segments) - 1
            if done:
                granule = end
            if len(lacing) == SEGMENTS or done and k == last:
                pages.append(page(continued | (4 if done and k == last else 0), granule, serial, len(pages), bytes(lacing), bytes(body)))
                lacing, body, granule, continued = bytearray(), bytearray(), -1, not done
    return pages


def to_ogg(payload: bytes) -> bytes:
    """An Ogg file with the payload as 8-bit samples."""
    cuts = [payload[k : k + PACKET] for k in range(0, len(payload), PACKET)]
    ends = [min((k + 1) * PACKET, len(payload)) for k in range(len(cuts))]
    a = stream_pages(SAMPLES, FIRST_SAMPLES, [(COMMENT, 0), *zip(cuts, ends, strict=True)])
    b = stream_pages(CHECKS, FIRST_CHECKS, [(CHECK.pack(k, zlib.crc32(c)), e) for k, (c, e) in enumerate(zip(cuts, ends, strict=True))])
    # Both first pages lead; then the pages of the streams alternate in proportion.
    out, j = [a[0], b[0]], 1
    for i in range(1, len(a)):
        out.append(a[i])
        to = 1 + (i * (len(b) - 1)) // (len(a) - 1)
        out += b[j:to]
        j = to
    return b"".join(out)


def valid_pages(media: bytes) -> Iterator[tuple | None]:
    """(flags, granule, serial, number, lacing, body) of each page whose checksum holds; None for a run of other bytes."""
    at, lost = 0, False
    while at < len(media):
        if media.startswith(b"OggS", at) and at + HEAD.size <= len(media):
            _, version, kind, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
            lacing = media[at + HEAD.size : at + HEAD.size + n]
            start = at + HEAD.size + n
            end = start + sum(lacing)
            if end <= len(media) and page_crc(b"".join((media[at : at + 22], b"\0\0\0\0", media[at + 26 : end]))) == crc:
                if lost:
                    yield None
                yield kind, granule, serial, number, lacing, media[start:end]
                at, lost = end, False
                continue
        lost = True
        at = media.find(b"OggS", at + 1)
        if at < 0:
            break
    if lost:
        yield None


class Stream:
    """A logical stream as its pages come: whole packets as (bytes, granule position at the end or None)."""

    def __init__(self) -> None:
        self.first: bytes | None = None
        self.packets: list[tuple[bytes, int | None]] = []
        self.part: list[bytes] | None = None  # of the packet that goes on
        self.next = self.damaged = 0
        self.closed = False

    def add(self, kind: int, granule: int, number: int, lacing: bytes, body: bytes) -> None:
        if number != self.next:
            self.damaged += 1
            self.part = None
        self.next = number + 1
        self.closed = bool(kind & 4)
        if self.part is not None and not kind & 1:  # the packet's rest is missing
            self.damaged += 1
            self.part = None
        skip = kind & 1 and self.part is None  # the packet's beginning is missing
        self.damaged += bool(skip)
        ends, begin, at = [], 0, 0
        for size in lacing:
            at += size
            if size < 255:
                if skip:
                    skip = False
                else:
                    ends.append(b"".join([*(self.part or ()), body[begin:at]]))
                self.part, begin = None, at
        if lacing and lacing[-1] == 255 and not skip:
            self.part = [*(self.part or ()), body[begin:at]]
        if kind & 2 and ends:
            self.first = ends.pop(0)
        position = granule
        timed = []
        for data in reversed(ends):  # a packet ends where the samples behind it on its page begin
            timed.append((data, position if granule >= 0 else None))
            position -= len(data)
        self.packets += timed[::-1]

    def finish(self) -> int:
        return self.damaged + (self.part is not None) + (not self.closed)


def from_ogg(media: bytes) -> dict:
    """Sample packets as (bytes, seconds at the end or None), the first packets by serial number, and what was found."""
    streams: dict[int, Stream] = {}
    pages = damaged = 0
    for got in valid_pages(media):
        if got is None:
            damaged += 1
            continue
        kind, granule, serial, number, lacing, body = got
        pages += 1
        streams.setdefault(serial, Stream()).add(kind, granule, number, lacing, body)
    damaged += sum(s.finish() for s in streams.values())
    damaged += sum(x not in streams for x in (SAMPLES, CHECKS))
    samples, checks = (streams[x].packets if x in streams else [] for x in (SAMPLES, CHECKS))
    samples = [p for p in samples if p[0] != COMMENT or p[1] != 0]
    known = {k: crc for k, crc in (CHECK.unpack(c) for c, _ in checks if len(c) == CHECK.size)}
    damaged += sum(len(c) != CHECK.size for c, _ in checks)
    met = set()
    for data, end in samples:
        number = None if end is None else (end - 1) // PACKET
        met.add(number)
        damaged += known.get(number) != zlib.crc32(data)
    damaged += len(set(known) - met)
    firsts = {serial: s.first for serial, s in streams.items() if s.first is not None}
    return {"pages": pages, "damaged": damaged, "samples": [(p, None if end is None else end / RATE) for p, end in samples], "firsts": firsts}


def padded(text: bytes) -> bytes:
    return text + bytes(64 - len(text) if not text else -len(text) % 64)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: the text's bytes as an Ogg file."""
    fields = [field("n_bytes", T.LongType()), field("media", T.BinaryType())]
    return append_in_arrow(docs, text_col, [id_col], fields, lambda texts: [[len(t) for t in texts], [to_ogg(padded(t)) for t in texts]])


def read(media: DataFrame, media_col: str = "media", keep: list[str] | None = None) -> DataFrame:
    """The kept columns and what the stored bytes hold: payload digests, page and packet counts, duration, sample statistics."""
    kinds = {"payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(), "media_bytes": T.LongType(), "media_sha256": T.StringType(), "pages": T.IntegerType(), "packets": T.IntegerType(), "damaged": T.IntegerType(), "seconds": T.DoubleType(), "feature": T.StringType()}

    def one(data: bytes) -> tuple:
        got = from_ogg(data)
        packets = got["samples"]
        payload = b"".join(p for p, _ in packets)
        times = [s for _, s in packets if s is not None]
        samples = np.frombuffer(payload, np.uint8)
        centred = samples >= 128
        crossings = int(np.count_nonzero(centred[1:] != centred[:-1]))
        feature = f"pages={got['pages']};packets={len(packets)};streams={len(got['firsts'])};end_s={times[-1] if times else 0.0:.6f};mean={samples.mean() if len(samples) else 0.0:.4f};peak={samples.max(initial=0)};crossings={crossings};damaged={got['damaged']}"
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), got["pages"], len(packets), got["damaged"], times[-1] if times else 0.0, feature)

    fields = [field(c, k) for c, k in kinds.items()]
    return append_in_arrow(media, media_col, keep or [], fields, lambda rows: list(zip(*map(one, rows), strict=True)))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return read(encode(docs, id_col, text_col), "media", [id_col, "n_bytes"])

