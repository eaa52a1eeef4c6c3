"""MPEG transport streams: a lossless multiplexer for byte payloads and a parser."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import slices

# Fixed values of ISO/IEC 13818-1 and the identifiers that this multiplexer uses.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, ES_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in PES packets, private stream 1
#: Streams whose elementary packets have no header beyond their length.
BARE = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)
CLOCK, TICK = 90_000, 3_600  # 90 kHz, 25 access units a second
#: Payload bytes in one elementary packet.
UNIT = 576 * 32


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    """A table section with its header and checksum."""
    n = 5 + len(body) + 4
    head = bytes([table_id, 0xB0 | n >> 8, n & 0xFF, number >> 8, number & 0xFF, 0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0, 1, bytes([PROGRAM >> 8, PROGRAM & 0xFF, 0xE0 | PMT_PID >> 8, PMT_PID & 0xFF])))
_PMT = _table_packet(
    PMT_PID, _section(2, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 0xFF, 0xF0, 0]))
)


def _stamp(t: int) -> bytes:
    return bytes([0x21 | (t >> 29) & 0x0E, t >> 22 & 0xFF, 1 | (t >> 14) & 0xFE, t >> 7 & 0xFF, 1 | (t << 1) & 0xFE])


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """A transport stream with one program whose private stream carries ``payload``.

    Each ``unit`` bytes make one elementary packet with a time stamp; its first transport packet
    is marked as a random-access point. The last one is filled up by an adaptation field.
    """
    out = [_PAT, _PMT]
    counter = 0
    for k, at in enumerate(range(0, len(payload), unit)):
        data = payload[at : at + unit]
        n = len(data) + 8
        pes = b"\x00\x00\x01" + bytes([STREAM_ID, n >> 8, n & 0xFF, 0x84, 0x80, 5]) + _stamp(k * TICK % (1 << 33)) + data
        # The first packet has 2 bytes of adaptation field, later ones have none but the last.
        packets = 1 + max(0, -(-(len(pes) - 182) // 184))
        m = np.full((packets, PACKET), 0xFF, np.uint8)
        m[:, 0], m[:, 1], m[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        m[0, 1] |= 0x40
        m[:, 3] = 0x10 | (counter + np.arange(packets)) & 0x0F
        counter += packets
        body = np.frombuffer(pes, np.uint8)
        if packets == 1:
            fill = 182 - len(body)
            m[0, 3] |= 0x20
            m[0, 4], m[0, 5] = 1 + fill, 0x40
            m[0, 6 + fill :] = body
        else:
            m[0, 3] |= 0x20
            m[0, 4], m[0, 5] = 1, 0x40
            m[0, 6:] = body[:182]
            whole = (len(body) - 182) // 184
            m[1 : 1 + whole, 4:] = body[182 : 182 + 184 * whole].reshape(-1, 184)
            if left := len(body) - 182 - 184 * whole:
                m[-1, 3] |= 0x20
                m[-1, 4] = 183 - left
                if left < 183:
                    m[-1, 5] = 0
                m[-1, PACKET - left :] = body[len(body) - left :]
        out.append(m.tobytes())
    return b"".join(out)


def _sections(packets: list[tuple[bool, bytes]]):
    """Whole table sections from a table's packets, each (a section begins in it, its payload)."""
    buffer = None
    for begins, data in packets:
        if begins:
            at = data[0] if data else 0
            parts = [(buffer or b"") + data[1 : 1 + at] if buffer is not None else b"", data[1 + at :]]
        else:
            parts = [(buffer or b"") + data if buffer is not None else b""]
        buffer = None
        for x in parts:
            while len(x) >= 3 and x[0] != 0xFF:
                n = 3 + ((x[1] & 0x0F) << 8 | x[2])
                if len(x) < n:
                    break
                yield x[:n]
                x = x[n:]
            buffer = x if x and x[0] != 0xFF else None


def demux(stream: bytes) -> dict:
    """Parse a transport stream; raises ValueError, and nothing else, if it is none or has no program.

    Returns the first program's first elementary stream and what was found on the way: packets,
    table checksum errors, continuity errors, packets sent twice (they count once), units cut short,
    and for each elementary packet its time stamp (-1: none), size, number of its first transport
    packet and whether that is a random-access point. Payload before the first elementary packet is left out.
    """
    if len(stream) % PACKET:
        raise ValueError("not a whole number of transport packets")
    m = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if len(m) == 0 or (m[:, 0] != SYNC).any():
        raise ValueError("lost synchronisation")
    pid = (m[:, 1].astype(np.int32) & 0x1F) << 8 | m[:, 2]
    begins, control, counter = (m[:, 1] & 0x40) > 0, m[:, 3] >> 4 & 3, m[:, 3] & 0x0F
    field = np.where(control & 2, m[:, 4].astype(np.int32) + 1, 0)
    start = np.minimum(4 + field, PACKET)
    flags = np.where((control & 2 > 0) & (field > 1), m[:, 5], 0)
    bad_tables = 0

    def of(which: int) -> tuple[np.ndarray, int]:
        """Packets with payload of one kind, without those that repeat the one before, and how many did."""
        own = np.flatnonzero((pid == which) & (control & 1 > 0))
        again = np.r_[False, (m[own][1:] == m[own][:-1]).all(axis=1)] if len(own) else np.zeros(0, bool)
        return own[~again], int(again.sum())

    def section(which: int, table_id: int) -> bytes:
        nonlocal bad_tables
        own, _ = of(which)
        for data in _sections([(bool(begins[i]), m[i, start[i] :].tobytes()) for i in own.tolist()]):
            if len(data) >= 12 and crc32_mpeg(data) == 0:
                if data[0] == table_id:
                    return data
            else:
                bad_tables += 1
        raise ValueError(f"no valid table in packets {which:#x}")

    pat = section(PAT_PID, 0)
    entries = [(pat[i] << 8 | pat[i + 1], (pat[i + 2] & 0x1F) << 8 | pat[i + 3]) for i in range(8, len(pat) - 7, 4)]
    programs = [(n, p) for n, p in entries if n]  # number 0 leads to network tables
    if not programs:
        raise ValueError("no program")
    pmt = section(programs[0][1], 2)
    streams, i = [], 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
    while i + 5 <= len(pmt) - 4:
        streams.append((pmt[i], (pmt[i + 1] & 0x1F) << 8 | pmt[i + 2]))
        i += 5 + ((pmt[i + 3] & 0x0F) << 8 | pmt[i + 4])
    if not streams:
        raise ValueError("a program without streams")
    own, repeats = of(streams[0][1])
    step = np.diff(counter[own].astype(np.int32)) & 0x0F
    told = flags[own][1:] & 0x80 > 0  # a jump that the stream announces
    bad_counters = int(((step != 1) & ~told).sum())
    inside = np.arange(PACKET) >= start[own][:, None]
    body, size = m[own][inside], PACKET - start[own]
    heads = np.flatnonzero(begins[own])
    ends = np.r_[0, np.cumsum(size)]
    bounds = np.r_[ends[heads], ends[-1]]
    parts, stamps, sizes, cut = [], [], [], 0
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h = body[a : min(b, a + 19)].tobytes()
        if h[:3] != b"\x00\x00\x01" or len(h) < 6:
            raise ValueError("no elementary packet where one should begin")
        n, stamp, at = h[4] << 8 | h[5], -1, a + 6
        if h[3] not in BARE:
            if len(h) < 9:
                raise ValueError("an elementary packet without its header")
            at = a + 9 + h[8]
            if h[7] & 0x80 and len(h) >= 14:
                stamp = (h[9] >> 1 & 7) << 30 | h[10] << 22 | (h[11] >> 1) << 15 | h[12] << 7 | h[13] >> 1
        end = a + 6 + n if n else b
        cut += end > b
        data = body[min(at, b) : min(end, b)]
        stamps.append(stamp)
        parts.append(data)
        sizes.append(len(data))
    return {
        "payload": np.concatenate(parts).tobytes() if parts else b"",
        "packets": len(m),
        "programs": [n for n, _ in programs],
        "streams": streams,
        "bad_tables": bad_tables,
        "bad_counters": bad_counters,
        "repeats": repeats,
        "cut": int(cut),
        "stamps": stamps,
        "sizes": sizes,
        "first_packets": own[heads].tolist(),
        "random_access": ((flags[own[heads]] & 0x40) > 0).tolist(),
    }


def pad(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 size and its bytes filled with 255 to a positive multiple of 576."""
    data = (text or "").encode()
    return len(data), data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")


def describe(found: dict) -> str:
    """The parsed stream's structure in one line; a function of the stored bytes alone."""
    points = [f"{t}@{p}" for t, p, ok in zip(found["stamps"], found["first_packets"], found["random_access"]) if ok]
    index = hashlib.sha256(",".join(points).encode()).hexdigest()[:16]
    kinds = ",".join(f"{k:#04x}:{p:#06x}" for k, p in found["streams"])
    return (
        f"packets={found['packets']};streams={kinds};tables_bad={found['bad_tables']};continuity_bad={found['bad_counters']};"
        f"units={len(found['sizes'])};largest={max(found['sizes'], default=0)};pts={min(found['stamps'], default=-1)}-{max(found['stamps'], default=-1)};random_access={len(points)}:{index}"
    )


def with_streams(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text stored as a transport stream in the binary column media.

    Null texts are empty; ids may be null; repeated rows are stored each; a very long text makes one
    long stream; extra columns are ignored; an empty table gives none.
    """

    def build(batches):
        for b in batches:
            for part in slices(b, 1, rows=500):
                n, media = [], []
                for text in part.column(1).to_pylist():
                    size, payload = pad(text)
                    n.append(size)
                    media.append(mux(payload))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, "doc_id long, n_bytes long, media binary")


def read_streams(streams: DataFrame) -> DataFrame:
    """Parse the media column (transport streams) and describe each; null or broken media raise no error but give nulls."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>"

    def parse(batches):
        for b in (part for batch in batches for part in slices(batch, 2, rows=500)):
            rows = []
            for doc, n, media in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    found = demux(media or b"")
                except ValueError as e:
                    rows.append((doc, n, None, None, None, len(media or b""), hashlib.sha256(media or b"").hexdigest(), f"error={e}", None, None))
                    continue
                p = found["payload"]
                points = [i for i, ok in zip(found["first_packets"], found["random_access"]) if ok]
                rows.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(found), found["stamps"], points))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 10, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return streams.select("doc_id", "n_bytes", "media").mapInArrow(parse, schema)


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_streams(with_streams(table(spark, sf_dir, "documents")))
