"""Transport streams: exact round trips, damage, timestamps."""

import hashlib
import zlib

import pytest
from edges import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstead.llm import media


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=2000))
def test_round_trip(payload):
    stream = media.mux(payload)
    got = media.demux(stream)
    assert len(stream) % 188 == 0 and all(stream[i] == 0x47 for i in range(0, len(stream), 188))
    assert got.payload == payload and got.counter_errors == 0 and got.timestamps == [0] and got.random_access == [2]


def test_units():
    payload = bytes(range(256)) * 4096
    got = media.demux(media.mux(payload))
    n = len(payload) // media.UNIT
    assert got.payload == payload and got.timestamps == [k * media.STEP for k in range(n)]
    assert len(got.random_access) == -(-n // media.KEY_EVERY) and got.pid == media.MEDIA_PID


def test_checksum():
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_damage():
    stream = bytearray(media.mux(b"x" * 5000))
    for at in (0, 20, 188 + 15):
        bad = bytearray(stream)
        bad[at] ^= 0xFF
        with pytest.raises(ValueError):
            media.demux(bytes(bad))
    with pytest.raises(ValueError):
        media.demux(bytes(stream[:-1]))
    assert media.demux(bytes(stream[:-188])).damaged_units == 1
    skipped = bytearray(stream)
    skipped[188 * 5 + 3] ^= 0x05
    assert media.demux(bytes(skipped)).counter_errors > 0


def test_later_tables():
    """The tables are those of the stream itself, though an earlier one began with the same packets."""
    stream, null = media.mux(b"x" * 5000), b"\x47\x1f\xff\x10" + b"\xff" * 184
    late = stream[:188] + null + stream[188:]
    assert media.demux(late).payload == b"x" * 5000
    bad = bytearray(late)
    bad[2 * 188 + 15] ^= 0xFF
    with pytest.raises(ValueError):
        media.demux(bytes(bad))


def foreign(payload, sections, pmt_pid=0x1F0, pid=0x44):
    """A stream of another writer: no stuffing in sections, a program list first, video without lengths, tables again midway."""

    def table(on, data, room=184):
        packets = []
        for k, a in enumerate(range(0, len(data), room)):
            part = data[a : a + room]
            packets.append(bytes([0x47, (0x40 if k == 0 else 0) | on >> 8, on & 0xFF, 0x10 | k & 15]) + part + b"\xff" * (184 - len(part)))
        return packets

    pat = media._section(0, 7, b"\0\0\xe0\x10" + b"\0\x05" + (0xE000 | pmt_pid).to_bytes(2, "big"))
    descriptors = bytes([0x52, 250]) + b"d" * 250 if sections > 1 else b""
    pmt = media._section(2, 5, (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(descriptors)).to_bytes(2, "big") + descriptors + bytes([0x1B]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\0")
    tables = table(0, b"\0" + pat) + table(pmt_pid, b"\0" + pmt)
    pes, body, counter = b"\0\0\1\xe0\0\0\x80\x80\x05" + media._stamp(1 << 32 | 77) + payload, [], 9
    for k, a in enumerate(range(0, len(pes), 184)):
        part = pes[a : a + 184]
        stuffing = 184 - len(part)
        field = b"" if not stuffing else bytes([stuffing - 1]) + (b"\0" + b"\xff" * (stuffing - 2) if stuffing > 1 else b"")
        body.append(bytes([0x47, (0x40 if k == 0 else 0) | pid >> 8, pid & 0xFF, (0x30 if field else 0x10) | counter & 15]) + field + part)
        counter += 1
    middle = len(body) // 2
    return tables, [*body[:middle], *tables, b"\x47\x1f\xff\x10" + b"\xff" * 184, *body[middle:]]


@pytest.mark.parametrize("sections", [1, 2])
def test_foreign_streams(sections):
    payload = bytes(range(251)) * 20
    tables, body = foreign(payload, sections)
    got = media.demux(b"".join(tables + body))
    assert (got.payload, got.pid, got.stream_type, got.timestamps, got.counter_errors, got.damaged_units) == (payload, 0x44, 0x1B, [1 << 32 | 77], 0, 0)
    # a packet sent twice, then one lost; the first tables damaged, the later ones not
    twice = media.demux(b"".join(tables + body[:2] + [body[1]] + body[2:]))
    assert twice.payload == payload and twice.repeated == 1 and twice.counter_errors == 0
    lost = media.demux(b"".join(tables + body[:2] + body[3:]))
    assert lost.counter_errors == 1 and lost.payload == payload[: 2 * 184 - 14] + payload[3 * 184 - 14 :]
    broken = bytearray(b"".join(tables + body))
    broken[188 + 30] ^= 1
    assert media.demux(bytes(broken)).payload == payload


def test_error_column(spark):
    stream = media.mux(b"y" * 70_000)
    rows = [(1, 70_000, stream), (2, 0, None), (3, 0, b"short"), (4, 0, stream[188:]), (5, 0, stream[: 188 * 30] + stream[188 * 31 :])]
    got = {r["doc_id"]: r for r in media.describe(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["error"] is None and got[1]["payload_bytes"] == 70_000 and "errors=0 damaged=0" in got[1]["feature"]
    assert all(got[i]["error"] and got[i]["payload_bytes"] is None for i in (2, 3, 4))
    assert got[5]["error"] is None and "errors=1 damaged=1" in got[5]["feature"] and got[5]["payload_bytes"] == 70_000 - 184


def test_columns(documents, edges, nothing):
    for df, rows in ((documents, [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]), (edges, EDGES)):
        got = media.describe(media.with_media(df)).collect()

        def want(text):
            n, payload = media.padded(text)
            assert n == len((text or "").encode()) and len(payload) % 64 == 0 and len(payload) > 0
            return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])

        assert sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=str) == sorted(((i, *want(t)) for i, t in rows), key=str)
    assert media.describe(media.with_media(nothing)).count() == 0
