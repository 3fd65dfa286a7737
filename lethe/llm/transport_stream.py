"""Media columns: MPEG transport streams in binary columns.

``mux`` stores a payload losslessly as one private elementary stream: program
tables first, then packetised elementary units with 90 kHz timestamps, the first
packet of each marked as a random-access point and carrying a clock reference.
``demux`` reads any such stream back: it parses the program association and map
tables (with their checksums), follows the continuity counter of every packet
identifier, reassembles sections and elementary packets, whatever packets they
span, and lists timestamps and random-access points.

Scale: one narrow pass over Arrow batches, one row's payload at a time.
"""

from __future__ import annotations

import binascii
import hashlib
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, free_name, table

PACKET = 188
SYNC = 0x47
PROGRAM, PMT_PID, STREAM_PID = 1, 0x0100, 0x0101
#: Fixed values of the standard: private data in packetised elementary units.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
CLOCK = 90_000
#: Payload bytes in an elementary unit, and units a second.
UNIT, RATE = 8192, 25
UNIT_BYTES = 64


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The checksum of table sections; 0 over a section with its own checksum."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int = 0) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter, 0]) + section).ljust(PACKET, b"\xff")


def _stamp(prefix: int, ticks: int) -> bytes:
    return bytes([prefix << 4 | ticks >> 29 & 0x0E | 1, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream that holds ``payload``, the same for the same bytes."""
    tables = [
        _table_packet(0, _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))),
        _table_packet(PMT_PID, _section(0x02, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE])
                                        + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")),
    ]
    out, counter = tables, 0
    start, go_on = bytes([SYNC, 0x40 | STREAM_PID >> 8, STREAM_PID & 0xFF]), bytes([SYNC, STREAM_PID >> 8, STREAM_PID & 0xFF])
    for n, at in enumerate(range(0, len(payload), UNIT)):
        data = payload[at:at + UNIT]
        ticks = n * CLOCK // RATE
        unit = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(2, ticks & (1 << 33) - 1) + data
        clock = ((ticks & (1 << 33) - 1) << 15 | 0x7E00).to_bytes(6, "big")
        pos = 0
        while pos < len(unit):
            extra = b"\x50" + clock if pos == 0 else b""  # random access, clock reference
            room = PACKET - 4 - (len(extra) + 1 if extra else 0)
            part = unit[pos:pos + room]
            if len(part) < room or extra:
                length = PACKET - 5 - len(part)
                body = bytes([length]) + ((extra or b"\x00").ljust(length, b"\xff") if length else b"") + part
                mark = 0x30
            else:
                body, mark = part, 0x10
            out.append((go_on if pos else start) + bytes([mark | counter]) + body)
            counter = counter + 1 & 15
            pos += len(part)
    return b"".join(out)


@dataclass
class Stream:
    """What demux finds."""

    payload: bytes = b""  # of the stream with the least packet identifier
    payloads: dict[int, bytes] = field(default_factory=dict)  # by packet identifier
    packets: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)  # packet identifier: stream type
    bad_sections: int = 0
    lost_sync: int = 0
    discontinuities: int = 0
    duplicates: int = 0
    timestamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # packet numbers


def _tables(found: Stream, pid: int, section: bytes) -> None:
    if len(section) < 12 or len(section) < (size := 3 + ((section[1] & 0x0F) << 8 | section[2])) or section_crc(section[:size]):
        found.bad_sections += 1
        return
    body = section[8:size - 4]
    if pid == 0 and section[0] == 0x00:
        for i in range(0, len(body) - 3, 4):
            if number := body[i] << 8 | body[i + 1]:
                found.programs[number] = (body[i + 2] & 0x1F) << 8 | body[i + 3]
    elif section[0] == 0x02 and len(body) >= 4:
        i = 4 + ((body[2] & 0x0F) << 8 | body[3])
        while i + 5 <= len(body):
            found.streams[(body[i + 1] & 0x1F) << 8 | body[i + 2]] = body[i]
            i += 5 + ((body[i + 3] & 0x0F) << 8 | body[i + 4])


def _sections(found: Stream, pid: int, sections: dict[int, bytes], more: bytes) -> None:
    """Add ``more`` to what is open of a packet identifier's sections, and parse those that are whole; 0xFF fills up."""
    data = sections[pid] + more
    while data and data[0] != 0xFF and len(data) >= 3 and len(data) >= (size := 3 + ((data[1] & 0x0F) << 8 | data[2])):
        _tables(found, pid, data[:size])
        data = data[size:]
    sections[pid] = b"" if data[:1] == b"\xff" else data


def _unit(found: Stream, parts: list[bytes]) -> bytes:
    unit = b"".join(parts)
    if len(unit) < 9 or unit[:3] != b"\x00\x00\x01":
        return b""
    size, head = unit[4] << 8 | unit[5], 9 + unit[8]
    if unit[7] & 0x80 and len(unit) >= 14:
        t = unit[9:14]
        found.timestamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1)
    return unit[head:6 + size] if size else unit[head:]


def demux(data: bytes) -> Stream:
    """Parse a transport stream; malformed packets are counted and left out."""
    found, out, sections = Stream(), {}, {}
    open_units: dict[int, list[bytes]] = {}
    last: dict[int, tuple[int, int]] = {}  # packet identifier: counter, start of that packet
    at = 0
    while at + PACKET <= len(data):
        if data[at] != SYNC:
            found.lost_sync += 1
            at = data.find(SYNC, at + 1)
            if at < 0:
                break
            continue
        b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
        number, pid, begins = found.packets, (b1 & 0x1F) << 8 | b2, b1 & 0x40
        found.packets += 1
        here, at = at, at + PACKET
        if pid == 0x1FFF or b1 & 0x80:
            continue
        body, jump = here + 4, False
        if b3 & 0x20:
            length = data[body]
            if length and body + length < at:
                flags = data[body + 1]
                jump = bool(flags & 0x80)
                if flags & 0x40:
                    found.random_access.append(number)
            body += 1 + length
        if not b3 & 0x10 or body >= at:
            continue
        counter = b3 & 0x0F
        if pid in last and not jump:
            was, packet = last[pid]
            if counter == was and data[packet + 4:packet + PACKET] == data[here + 4:at]:
                found.duplicates += 1
                continue
            if counter != was + 1 & 15:
                found.discontinuities += 1
                open_units.pop(pid, None)
        last[pid] = (counter, here)
        if pid == 0 or pid in found.programs.values():
            part = data[body:at]
            if begins:
                first = 1 + part[0]  # what stands before belongs to the section that began earlier
                if pid in sections:
                    _sections(found, pid, sections, part[1:first])
                    found.bad_sections += bool(sections.pop(pid))
                sections[pid], part = b"", part[first:]
            if pid in sections:
                _sections(found, pid, sections, part)
        elif pid in found.streams:
            if begins:
                if pid in open_units:
                    out.setdefault(pid, []).append(_unit(found, open_units[pid]))
                open_units[pid] = [data[body:at]]
            elif pid in open_units:
                open_units[pid].append(data[body:at])
    for pid, parts in open_units.items():
        out.setdefault(pid, []).append(_unit(found, parts))
    found.bad_sections += sum(map(bool, sections.values()))
    found.payloads = {pid: b"".join(units) for pid, units in sorted(out.items())}
    found.payload = next(iter(found.payloads.values()), b"")
    return found


def pad(data: bytes) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of 64."""
    return data.ljust(max(UNIT_BYTES, -(-len(data) // UNIT_BYTES) * UNIT_BYTES), b"\0")


def feature(found: Stream) -> str:
    """Counts and bounds of a parsed stream, and a checksum of its timestamps and random-access points."""
    marks = ",".join(map(str, found.timestamps)) + ";" + ",".join(map(str, found.random_access))
    return (f"packets={found.packets} programs={len(found.programs)} streams={len(found.streams)} units={len(found.timestamps)}"
            f" first_pts={found.timestamps[0] if found.timestamps else -1} last_pts={found.timestamps[-1] if found.timestamps else -1}"
            f" random_access={len(found.random_access)} discontinuities={found.discontinuities} duplicates={found.duplicates}"
            f" bad_sections={found.bad_sections} lost_sync={found.lost_sync} marks={zlib.crc32(marks.encode()):08x}")


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` and the binary column ``media``: each padded UTF-8 text as a transport stream.

    Null texts count as empty and give 64 bytes 0; whole texts are stored,
    however long; equal texts, and so ties and repeated rows, give equal bytes,
    a row for each; an empty table gives no rows; other columns pass through,
    but one called ``media`` gives way.
    """
    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([mux(pad((t.as_py() or "").encode("utf-8", "surrogatepass"))) for t in texts], pa.binary())]

    return append_columns(docs, [text], T.StructType([T.StructField(media, T.BinaryType(), False)]), make)


MEDIA_FIELDS = T.StructType([
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()),
    T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
    T.StructField("timestamps", T.ArrayType(T.LongType())), T.StructField("random_access", T.ArrayType(T.LongType()))])


def describe(stored: DataFrame, media: str = "media") -> DataFrame:
    """``stored`` and MEDIA_FIELDS, read back from the bytes of ``media``; null media give null fields."""
    def make(blobs: pa.Array) -> list[pa.Array]:
        rows = []
        for blob in blobs:
            if not blob.is_valid:
                rows.append((None,) * len(MEDIA_FIELDS))
                continue
            data = blob.as_py()
            found = demux(data)
            rows.append((len(found.payload), hashlib.sha256(found.payload).hexdigest(), binascii.crc32(found.payload[-UNIT_BYTES:]),
                         len(data), hashlib.sha256(data).hexdigest(), feature(found), found.timestamps, found.random_access))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    return append_columns(stored, [media], MEDIA_FIELDS, make)


def media_columns(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and its texts as transport streams, under a name that is free."""
    return store(docs, media=free_name(docs, "media"))


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document stored as a transport stream and read back."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = describe(store(docs).drop("text"))
    return out.select("doc_id", "n_bytes", *[f.name for f in MEDIA_FIELDS])
