import binascii
import hashlib
import os

import pytest

from lethe.llm import transport_stream as M
from lethe.llm.common import table

from .cases import frame


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 157, 158, 168, 183, 184, 185, 8191, 8192, 8193, 100_000])
def test_round_trip(n):
    payload = M.pad(os.urandom(n))
    data = M.mux(payload)
    found = M.demux(data)
    assert found.payload == payload and len(data) % M.PACKET == 0 and len(payload) % 64 == 0
    assert found.programs == {1: M.PMT_PID} and found.streams == {M.STREAM_PID: M.STREAM_TYPE}
    assert (found.discontinuities, found.duplicates, found.bad_sections, found.lost_sync) == (0, 0, 0, 0)
    assert found.timestamps == [i * 3600 for i in range(-(-len(payload) // M.UNIT))] and len(found.random_access) == len(found.timestamps)


def test_damage_is_noticed():
    data = M.mux(M.pad(os.urandom(30_000)))
    packet = lambda i: data[i * 188:(i + 1) * 188]
    assert M.demux(data[:188 * 50] + data[188 * 51:]).discontinuities == 1
    twice = M.demux(data[:188 * 51] + packet(50) + data[188 * 51:])
    assert twice.duplicates == 1 and twice.payload == M.demux(data).payload
    assert M.demux(b"xyz" + data).lost_sync == 1
    assert M.demux(data[:20] + b"\x00" + data[21:]).bad_sections == 1
    assert M.demux(b"").payload == b"" and M.demux(os.urandom(500)).packets <= 2


def test_timestamps_pass_33_bits():
    assert M._stamp(2, (1 << 33) - 1) == bytes([0x2F, 0xFF, 0xFF, 0xFF, 0xFF])


def test_query_reads_back_what_is_stored(spark):
    got = {r.doc_id: r for r in M.op10_transport_stream(spark, "/root/testdata/sf0.001").collect()}
    for d in table(spark, "/root/testdata/sf0.001", "documents").collect():
        r, payload = got[d.doc_id], M.pad(d.text.encode())
        assert r.n_bytes == len(d.text.encode()) and r.payload_bytes == len(payload)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == binascii.crc32(payload[-64:])


def test_equal_texts_and_null_media(spark):
    docs = frame(spark, clash=True)
    rows = M.describe(M.media_columns(docs)).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 14 and by[1].media_sha256 == by[2].media_sha256 and by[4].payload_bytes == by[5].payload_bytes == 64
    assert M.describe(spark.createDataFrame([(None,)], "media binary")).first().feature is None


def test_sections_that_span_packets():
    body = b"".join((0xE000 | 0x200 + k).to_bytes(2, "big").join([bytes([6]), b"\xf0\x00"]) for k in range(60))
    section = M._section(0x02, 1, b"\xe2\x00\xf0\x00" + body)
    assert len(section) > M.PACKET
    head = bytes([M.SYNC, 0x40 | M.PMT_PID >> 8, M.PMT_PID & 0xFF, 0x10, 0]) + section[:183]
    rest = bytes([M.SYNC, M.PMT_PID >> 8, M.PMT_PID & 0xFF, 0x11]) + section[183:].ljust(184, b"\xff")
    data = M.mux(M.pad(b"x" * 500))
    found = M.demux(data[:188] + head + rest + data[188 * 2:])
    assert found.bad_sections == 0 and len(found.streams) == 60
    assert M.demux(data[:188] + head + data[188 * 2:]).bad_sections == 1


def test_streams_are_kept_apart():
    a, b = M.pad(os.urandom(1000)), M.pad(os.urandom(700))
    one, two = M.mux(a), M.mux(b)
    other = b"".join(two[i:i + 1] + bytes([two[i + 1] & 0xE0 | 0x02]) + two[i + 2:i + 188] for i in range(188 * 2, len(two), 188))
    more = M._section(0x02, 1, b"\xe1\x01\xf0\x00" + b"\x06\xe1\x01\xf0\x00" + b"\x06\xe2\x01\xf0\x00")
    found = M.demux(one[:188] + M._table_packet(M.PMT_PID, more) + one[188 * 2:] + other)
    assert found.payloads == {0x101: a, 0x201: b} and found.payload == a
