"""MPEG transport streams as a column: 188-byte packets that carry a payload, written and read with numpy.

A stream holds one programme with one private elementary stream: a programme association table, a programme map table,
and packetised elementary packets of up to UNIT bytes. Each has a 90 kHz presentation timestamp; its first transport
packet carries a clock reference and the random-access flag.

The reader takes any stream of 188-byte packets: it finds elementary streams by the tables, checks the CRC of tables and the
continuity counters, joins elementary packets and lists their timestamps and random-access points. Damage is counted, not
raised: a lost sync byte, a failed CRC, a counter that jumps.

Cases: null counts as empty; a payload is padded with zero bytes to a positive multiple of 64, so an empty text is 64 zero
bytes; equal payloads give equal streams; long payloads take as many packets as needed.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = 188
PAT_PID, PMT_PID, DATA_PID = 0, 0x100, 0x101
PROGRAM = 1
#: Stream type and stream id for private data.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Payload bytes of one elementary packet, and ticks of 90 kHz from one to the next.
UNIT = 60_000
TICKS = 3600


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(ticks: int) -> bytes:
    t = ticks % (1 << 33)
    return bytes([0x21 | t >> 29 & 0x0E, t >> 22 & 255, t >> 14 & 254 | 1, t >> 7 & 255, t << 1 & 254 | 1])


def _clock(ticks: int) -> bytes:
    t = ticks % (1 << 33)
    return bytes([t >> 25 & 255, t >> 17 & 255, t >> 9 & 255, t >> 1 & 255, (t & 1) << 7 | 0x7E, 0])


def _unit(data: bytes, ticks: int, counter: int) -> tuple[bytes, int]:
    """Transport packets of one elementary packet, and the next continuity counter."""
    size = len(data) + 8
    body = np.frombuffer(b"\x00\x00\x01" + bytes([STREAM_ID]) + (size if size < 65536 else 0).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(ticks) + data, np.uint8)
    first = PACKET - 4 - 8
    n = 1 + max(0, -(-(len(body) - first) // 184))
    out = np.empty((n, PACKET), np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = 0x47, DATA_PID >> 8, DATA_PID & 255
    out[0, 1] |= 0x40
    out[:, 3] = 0x10 | (counter + np.arange(n)) & 15
    out[0, 3] |= 0x20
    space = first + 184 * (n - 1)
    stuffing = space - len(body)
    if n == 1:
        out[0, 4] = 7 + stuffing
        out[0, 5:12] = np.frombuffer(b"\x50" + _clock(ticks), np.uint8)
        out[0, 12 : 12 + stuffing] = 255
        out[0, 12 + stuffing :] = body
    else:
        out[0, 4] = 7
        out[0, 5:12] = np.frombuffer(b"\x50" + _clock(ticks), np.uint8)
        out[0, 12:] = body[:first]
        full = n - 2
        out[1 : 1 + full, 4:] = body[first : first + 184 * full].reshape(full, 184)
        tail = body[first + 184 * full :]
        at = PACKET - len(tail)
        if at > 4:
            out[-1, 3] |= 0x20
            out[-1, 4] = at - 5
            out[-1, 5:at] = 255
            out[-1, 5 : min(at, 6)] = 0
        out[-1, at:] = tail
    return out.tobytes(), (counter + n) & 15


def muxed(payload: bytes) -> bytes:
    """A transport stream that carries the payload."""
    out, counter = [_TABLES], 0
    for i, at in enumerate(range(0, len(payload), UNIT)):
        data, counter = _unit(payload[at : at + UNIT], (i + 1) * TICKS, counter)
        out.append(data)
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds. units: (pid, pts or None, dts or None, random access, data)."""

    packets: int = 0
    bad_sync: int = 0
    bad_crc: int = 0
    jumps: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    types: dict[int, int] = field(default_factory=dict)
    clocks: int = 0
    units: list[tuple[int, int | None, int | None, bool, bytes]] = field(default_factory=list)


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def _sections(data: bytes, out: Stream) -> Iterator[bytes]:
    """Whole sections with a right CRC, from the joined payload of one packet that starts one."""
    at = 1 + data[0] if data else 0
    while at + 3 <= len(data) and data[at] != 0xFF:
        size = 3 + ((data[at + 1] & 15) << 8 | data[at + 2])
        section = data[at : at + size]
        if len(section) < size or size < 12 or crc32_mpeg(section):
            out.bad_crc += 1
            return
        yield section
        at += size


def demuxed(media: bytes) -> Stream:
    out = Stream(packets=len(media) // PACKET)
    a = np.frombuffer(media, np.uint8, out.packets * PACKET).reshape(-1, PACKET)
    good = (a[:, 0] == 0x47) & (a[:, 1] < 0x80)
    out.bad_sync = int(len(a) - good.sum())
    a = a[good]
    if not len(a):
        return out
    pid = (a[:, 1].astype(np.int32) & 31) << 8 | a[:, 2]
    start = (a[:, 1] & 0x40) > 0
    control = a[:, 3] >> 4 & 3
    counter = (a[:, 3] & 15).astype(np.int32)
    adapted = (control & 2) > 0
    size = np.where(adapted, a[:, 4].astype(np.int32), -1)
    flags = np.where(adapted & (size > 0), a[:, 5], 0)
    offset = np.minimum(5 + size, PACKET)
    carries = (control & 1) > 0
    offset[~carries] = PACKET
    out.clocks = int(((flags & 0x10) > 0).sum())

    def rows(p: int) -> np.ndarray:
        return np.flatnonzero((pid == p) & carries)

    def joined(r: np.ndarray) -> bytes:
        return a[r][np.arange(PACKET) >= offset[r][:, None]].tobytes()

    def tables(p: int) -> Iterator[bytes]:
        r = rows(p)
        for k in np.split(r, np.flatnonzero(start[r])[0:]) if len(r) else []:
            if len(k) and start[k[0]]:
                yield from _sections(joined(k), out)

    for s in tables(PAT_PID):
        if s[0] == 0:
            for i in range(8, len(s) - 4, 4):
                number = s[i] << 8 | s[i + 1]
                if number:
                    out.programs[number] = (s[i + 2] & 31) << 8 | s[i + 3]
    for p in sorted(set(out.programs.values())):
        for s in tables(p):
            if s[0] == 2:
                i = 12 + ((s[10] & 15) << 8 | s[11])
                while i + 5 <= len(s) - 4:
                    out.types[(s[i + 1] & 31) << 8 | s[i + 2]] = s[i]
                    i += 5 + ((s[i + 3] & 15) << 8 | s[i + 4])
    for p in sorted(out.types):
        r = rows(p)
        step = np.diff(counter[r]) & 15
        told = (flags[r[1:]] & 0x80) > 0
        # A packet may be sent twice: the second has the same counter and the same bytes after its flags.
        twice = np.flatnonzero(step == 0)
        again = np.array([k for k in twice if (a[r[k], 6:] == a[r[k + 1], 6:]).all()], int)
        wrong = (step != 1) & ~told
        wrong[again] = False
        out.jumps += int(wrong.sum())
        r = np.delete(r, again + 1)
        for k in np.split(r, np.flatnonzero(start[r])):
            if not len(k) or not start[k[0]]:
                continue
            b = joined(k)
            if b[:3] != b"\x00\x00\x01" or len(b) < 9:
                out.bad_sync += 1
                continue
            length, has = b[4] << 8 | b[5], b[7] >> 6
            pts = _ticks(b[9:14]) if has & 2 and len(b) >= 14 else None
            dts = _ticks(b[14:19]) if has == 3 and len(b) >= 19 else pts
            out.units.append((p, pts, dts, bool(flags[k[0]] & 0x40), b[9 + b[8] : 6 + length if length else len(b)]))
    return out


def padded(text: bytes) -> bytes:
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def feature(s: Stream) -> str:
    stamps = [u[1] for u in s.units if u[1] is not None]
    points = [u[1] for u in s.units if u[3]]
    return f"packets={s.packets};programs={len(s.programs)};streams={len(s.types)};units={len(s.units)};first_pts={min(stamps, default=-1)};last_pts={max(stamps, default=-1)};access={len(points)};last_access={max((p for p in points if p is not None), default=-1)};clocks={s.clocks};jumps={s.jumps};bad={s.bad_sync + s.bad_crc}"


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """One row for each row of docs, from the stream as read back.

    id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; timestamps and
    access_points (90 kHz ticks) of the elementary packets; media itself if asked for.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = docs.schema["id"].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("timestamps", pa.list_(pa.int64())), ("access_points", pa.list_(pa.int64()))]
        if keep_media:
            fields.append(("media", pa.binary()))
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                texts, rows = b.column("t"), []
                for i in range(b.num_rows):
                    text = (texts[i].as_py() or "").encode()
                    media = muxed(padded(text))
                    s = demuxed(media)
                    payload = b"".join(u[4] for u in s.units)
                    rows.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), [u[1] for u in s.units], [u[1] for u in s.units if u[3]], *([media] if keep_media else [])))
                yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(fields))], names=["id", *(n for n, _ in fields)])

    out = docs.mapInArrow(store, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, timestamps array<bigint>, access_points array<bigint>" + ", media binary" * keep_media)
    return out.withColumnRenamed("id", id_col)
