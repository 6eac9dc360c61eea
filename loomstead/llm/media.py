"""Media columns: payloads as MPEG transport streams.

`mux` stores bytes losslessly as elementary packets (PES, one access unit of up to UNIT bytes each, with a
timestamp) in 188-byte transport packets behind a program association and a program map table. `demux` parses the
tables, whose sections may go over several packets, checks continuity counters, leaves out packets that are sent twice,
reassembles the elementary packets of the first stream of the first program, and lists timestamps with random-access
points. Gaps in the counters and elementary packets with bytes missing are counted, and what is there of them is kept.

Null texts count as empty; payloads are padded with zeros to a positive multiple of 64 bytes; equal texts (ties, repeated
rows) give equal streams and values. Very long texts are streams of many packets, whole in a task's memory. A null
stream, or one that isn't whole packets or names no program, gives nulls and says in `error` why. Other columns, whatever
their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
PACKET, SYNC, PAT_PID, NULL_PID, CRC_POLYNOMIAL = 188, 0x47, 0x0000, 0x1FFF, 0x04C11DB7
PRIVATE_STREAM, PRIVATE_TYPE, CLOCK = 0xBD, 0x06, 90_000
#: Elementary packets without the optional header, and the one among them that is padding.
BARE_STREAMS, PADDING_STREAM = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF), 0xBE
#: Choices of this writer.
PARSED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<long>, random_access array<long>, error string"
PMT_PID, MEDIA_PID, PROGRAM, UNIT, STEP, KEY_EVERY = 0x0100, 0x0101, 1, 32_768, 3_600, 8


def crc32_mpeg(data: bytes) -> int:
    """The sections' checksum: most significant bit first, all ones at the start, not inverted."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ CRC_POLYNOMIAL if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(pts: int) -> bytes:
    """33 bits of timestamp with marker bits."""
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(payload: bytes) -> bytes:
    """A transport stream that holds payload."""
    chunks, counter = [_TABLES], 0
    for k, begin in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[begin : begin + UNIT], k * STEP & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(pts) + unit
        # the first packet has a clock reference, and the random-access flag at every KEY_EVERYth unit
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        field = bytes([0x50 if k % KEY_EVERY == 0 else 0x10]) + clock
        lead = bytes([len(field)]) + field
        room = PACKET - 4 - len(lead)
        if len(pes) < room:
            lead = bytes([len(field) + room - len(pes)]) + field + b"\xff" * (room - len(pes))
            room = len(pes)
        body = len(pes) - room
        full, tail = divmod(body, PACKET - 4)
        n = 1 + full + (tail > 0)
        grid = np.empty((n, PACKET), np.uint8)
        grid[:, 0], grid[:, 1], grid[:, 2] = SYNC, MEDIA_PID >> 8, MEDIA_PID & 0xFF
        grid[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        grid[0, 1] |= 0x40
        grid[0, 3] |= 0x20
        grid[0, 4:] = np.frombuffer(lead + pes[:room], np.uint8)
        data = np.frombuffer(pes, np.uint8)
        grid[1 : 1 + full, 4:] = data[room : room + full * (PACKET - 4)].reshape(full, PACKET - 4)
        if tail:
            stuffing = PACKET - 4 - tail
            grid[-1, 3] |= 0x20
            grid[-1, 4 : 4 + stuffing] = 0xFF
            grid[-1, 4] = stuffing - 1
            if stuffing > 1:
                grid[-1, 5] = 0
            grid[-1, 4 + stuffing :] = data[len(data) - tail :]
        counter += n
        chunks.append(grid.tobytes())
    return b"".join(chunks)


@dataclass
class Stream:
    payload: bytes
    packets: int
    pid: int
    stream_type: int
    timestamps: list[int]
    random_access: list[int]
    """Numbers of the packets at which decoding can begin."""
    counter_errors: int
    damaged_units: int
    repeated: int


def _pids(grid: np.ndarray) -> np.ndarray:
    return (grid[:, 1] & 0x1F).astype(np.int64) << 8 | grid[:, 2]


def _sections(grid: np.ndarray, pid: int, table: int) -> Iterator[bytes]:
    """Bodies, between head and checksum, of a table's sections that are whole; others are passed over."""
    held = None
    for packet in grid[(_pids(grid) == pid) & (grid[:, 3] & 0x10 > 0)]:
        raw = packet.tobytes()
        data = raw[4 + (1 + raw[4] if raw[3] & 0x20 else 0) :]
        begun = None
        if raw[1] & 0x40 and data:
            # the section before ends where the pointer says that the next begins
            begun, data = data[1 + data[0] :], data[1 : 1 + data[0]]
        for part, fresh in ((data, False), (begun, True)):
            if part is None or not fresh and held is None:
                continue
            held = part if fresh else held + part
            while held is not None and len(held) >= 3 and held[0] != 0xFF and len(held) >= (size := 3 + ((held[1] & 0x0F) << 8 | held[2])):
                section, held = held[:size], held[size:]
                if section[0] == table and size >= 12 and not crc32_mpeg(section):
                    yield section[8:-4]
            if held is not None and held[:1] == b"\xff":
                held = None


def _programs(grid: np.ndarray) -> tuple[int, int]:
    """Pid and type of the first elementary stream that the tables name."""
    for body in _sections(grid, PAT_PID, 0):
        for i in range(0, len(body) - 3, 4):
            if body[i : i + 2] != b"\0\0":
                for program in _sections(grid, (body[i + 2] & 0x1F) << 8 | body[i + 3], 2):
                    at = 4 + ((program[2] & 0x0F) << 8 | program[3])
                    if at + 5 <= len(program):
                        return (program[at + 1] & 0x1F) << 8 | program[at + 2], program[at]
    raise ValueError("no program")


def demux(media: bytes) -> Stream:
    """The payload and what the stream says of it."""
    if not media or len(media) % PACKET:
        raise ValueError("not whole packets")
    grid = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pid, kind = _programs(grid)
    numbers = np.flatnonzero(_pids(grid) == pid)
    own = grid[numbers]
    field = np.where(own[:, 3] & 0x20, own[:, 4].astype(np.int64) + 1, 0)
    has_data = (own[:, 3] & 0x10) > 0
    begin = np.where(has_data, np.minimum(4 + field, PACKET), PACKET)
    # a packet may be sent twice: the same counter and data
    again = np.zeros(len(own), bool)
    alike = (own[1:, 3] == own[:-1, 3]) & has_data[1:] & (begin[1:] == begin[:-1])
    spots = np.flatnonzero(alike)
    again[spots + 1] = ((own[spots + 1] == own[spots]) | (np.arange(PACKET) < begin[spots, None])).all(1)
    numbers, own, field, has_data, begin = (x[~again] for x in (numbers, own, field, has_data, begin))
    counters, jump = (own[:, 3] & 15).astype(np.int64), (field > 1) & (own[:, 5] & 0x80 > 0)
    errors = int((((counters[1:] - counters[:-1]) % 16 != has_data[1:]) & ~jump[1:]).sum())
    access = numbers[(field > 1) & (own[:, 5] & 0x40 > 0)]
    data = own[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    parts, stamps = [], []
    starts = np.flatnonzero((own[:, 1] & 0x40 > 0) & has_data)
    bounds = [*(int(ends[s - 1]) if s else 0 for s in starts), len(data)]
    damaged = int(bounds[0] > 0)
    for a, b in zip(bounds, bounds[1:], strict=False):
        pes = data[a:b]
        if pes[:3] != b"\0\0\1" or len(pes) < 9:
            damaged += 1
            continue
        length = pes[4] << 8 | pes[5]
        if length:
            damaged += length + 6 != len(pes)
            pes = pes[: length + 6]
        if pes[3] in BARE_STREAMS:
            parts.append(b"" if pes[3] == PADDING_STREAM else pes[6:])
            continue
        if pes[7] & 0x80 and len(pes) >= 14:
            p = pes[9:14]
            stamps.append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1)
        parts.append(pes[9 + pes[8] :])
    return Stream(b"".join(parts), len(grid), pid, kind, stamps, access.tolist(), errors, damaged, int(again.sum()))


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text with zeros to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def transport_stream(texts: pa.Array) -> pa.Array:
    """Texts as stored streams."""
    sizes, streams = [], []
    for text in texts:
        n, payload = padded(text.as_py())
        sizes.append(n)
        streams.append(mux(payload))
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(streams, pa.binary())], ["n_bytes", "media"])


def parsed_stream(media: pa.Array) -> pa.Array:
    """Digests and features of the streams' payloads, with timestamps and random-access packets, or what is wrong."""
    rows = []
    for item in media:
        raw = item.as_py()
        try:
            s = demux(raw or b"")
        except ValueError as e:
            rows.append((None, None, None, raw and len(raw), raw and hashlib.sha256(raw).hexdigest(), None, None, None, str(e)))
            continue
        seconds = (s.timestamps[-1] - s.timestamps[0]) / CLOCK if s.timestamps else 0
        feature = f"pid={s.pid} type={s.stream_type} packets={s.packets} units={len(s.timestamps)} seconds={seconds:.2f} access={','.join(map(str, s.random_access))} errors={s.counter_errors} damaged={s.damaged_units} repeated={s.repeated}"
        rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, s.timestamps, s.random_access, None))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps", "random_access", "error"]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media column of every row of docs."""
    streams = F.arrow_udf(transport_stream, "n_bytes long, media binary")
    return docs.select("doc_id", streams(text).alias("_m")).select("doc_id", "_m.n_bytes", "_m.media")


def describe(stored: DataFrame) -> DataFrame:
    """What a media column (doc_id, n_bytes, media) says when read back."""
    parsed = F.arrow_udf(parsed_stream, PARSED)
    return stored.select("doc_id", "n_bytes", parsed("media").alias("_p")).select("doc_id", "n_bytes", "_p.*")
