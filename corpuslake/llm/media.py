"""Media columns as MPEG transport streams.

Bytes are stored as a one-programme transport stream of 188-byte packets: a programme association and a
programme map table before each access unit, and one private-data elementary stream whose PES packets carry
at most UNIT bytes, a presentation time stamp and, in the first packet's adaptation field, the random-access
flag and a clock reference. Reading checks sync bytes and table CRCs, finds the elementary stream by way of
both tables, checks continuity counters, reassembles the PES packets and lists time stamps and random-access
points.

Nulls and edge cases: a null text is empty and stored as 64 zero bytes; a null id is passed on; a broken
stream raises ValueError. Any length works: units are cut, never whole texts.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from corpuslake.llm.common import ids_and_text

PACKET, BLOCK, UNIT, TICKS = 188, 64, 32_768, 3_600
PAT_PID, PMT_PID, DATA_PID, PROGRAMME, PRIVATE_DATA, PRIVATE_STREAM = 0, 0x1000, 0x0100, 1, 0x06, 0xBD


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


@lru_cache(32)
def _tables(counter: int) -> bytes:
    """The two table packets with this continuity counter."""
    pat = _section(0, 1, struct.pack(">HH", PROGRAMME, 0xE000 | PMT_PID))
    pmt = _section(2, PROGRAMME, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, PRIVATE_DATA, 0xE000 | DATA_PID, 0xF000))
    return b"".join((struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10 | counter, 0) + s).ljust(PACKET, b"\xff") for pid, s in ((PAT_PID, pat), (PMT_PID, pmt)))


def _stamp(prefix: int, pts: int) -> bytes:
    return struct.pack(">BHH", prefix << 4 | (pts >> 30 & 7) << 1 | 1, (pts >> 15 & 0x7FFF) << 1 | 1, (pts & 0x7FFF) << 1 | 1)


def mux(payload: bytes) -> bytes:
    """The transport stream of ``payload``."""
    out, counter = [], 0
    for k, at in enumerate(range(0, len(payload), UNIT)):
        unit, pts = payload[at : at + UNIT], k * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + struct.pack(">BHBBB", PRIVATE_STREAM, len(unit) + 8, 0x84, 0x80, 5) + _stamp(2, pts) + unit
        clock = struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        n = 1 + max(0, -(-(len(pes) - 176) // 184))
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0] = 0x47
        packets[:, 1], packets[:, 2] = DATA_PID >> 8, DATA_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        packets[0, 3] |= 0x20
        data = np.frombuffer(pes, np.uint8)
        packets[0, 5] = 0x50
        packets[0, 6:12] = np.frombuffer(clock, np.uint8)
        first = min(176, len(data))
        packets[0, 4] = 183 - first
        packets[0, PACKET - first :] = data[:first]
        whole = (len(data) - first) // 184
        packets[1 : 1 + whole, 4:] = data[first : first + 184 * whole].reshape(whole, 184)
        rest = len(data) - first - 184 * whole
        if rest:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = 183 - rest
            if rest < 183:
                packets[-1, 5] = 0
            packets[-1, PACKET - rest :] = data[-rest:]
        out += [_tables(k & 15), packets.tobytes()]
        counter = counter + n & 15
    return b"".join(out)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(f"transport stream: {what}")


def _body(packet: np.ndarray, table: int) -> bytes:
    raw = packet[5 + int(packet[4]) :].tobytes()
    size = struct.unpack(">H", raw[1:3])[0] & 0xFFF
    _need(raw[0] == table and crc32_checked(raw[: 3 + size]), f"table {table}")
    return raw[8 : size - 1]


@lru_cache(64)
def crc32_checked(section: bytes) -> bool:
    return crc32_mpeg(section) == 0


def demux(media: bytes) -> dict:
    """``payload, packets, pts (list), random_access (packet numbers), continuity_errors``."""
    _need(len(media) % PACKET == 0 and len(media) > 0, "length")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    _need(bool((p[:, 0] == 0x47).all()), "sync byte")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    association = _body(p[np.flatnonzero(pid == PAT_PID)[0]], 0)
    programmes = dict(struct.unpack(">HH", association[i : i + 4]) for i in range(0, len(association), 4))
    pmt_pid = next(v & 0x1FFF for n, v in programmes.items() if n)
    listing = _body(p[np.flatnonzero(pid == pmt_pid)[0]], 2)
    at, streams = 4 + (struct.unpack(">H", listing[2:4])[0] & 0xFFF), {}
    while at < len(listing):
        kind, number, extra = struct.unpack(">BHH", listing[at : at + 5])
        streams[kind] = number & 0x1FFF
        at += 5 + (extra & 0xFFF)
    rows = np.flatnonzero(pid == streams[PRIVATE_DATA])
    es = p[rows]
    counters = es[:, 3] & 15
    errors = int(((counters[1:] - counters[:-1] & 15) != 1).sum())
    adapted = (es[:, 3] & 0x20) > 0
    offset = 4 + np.where(adapted, 1 + es[:, 4].astype(np.int32), 0)
    access = rows[adapted & (es[:, 4] > 0) & ((es[:, 5] & 0x40) > 0)]
    data = es[np.arange(PACKET)[None, :] >= offset[:, None]]
    begins = (np.cumsum(PACKET - offset) - (PACKET - offset))[(es[:, 1] & 0x40) > 0].tolist() + [len(data)]
    parts, stamps = [], []
    for a, b in zip(begins, begins[1:], strict=False):
        h = data[a : a + 14].tobytes()
        _need(h[:4] == b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) and struct.unpack(">H", h[4:6])[0] == b - a - 6, "PES packet")
        x, y, z = struct.unpack(">BHH", h[9:14])
        stamps.append((x >> 1 & 7) << 30 | y >> 1 << 15 | z >> 1)
        parts.append(data[a + 9 + h[8] : b].tobytes())
    return {"payload": b"".join(parts), "packets": len(p), "pts": stamps, "random_access": access.tolist(), "continuity_errors": errors}


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b"\0")


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media binary``: every text as a transport stream."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [padded(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": [n for n, _ in raw], "media": [mux(b) for _, b in raw]})

    return ids_and_text(docs, id_col, text_col).mapInPandas(write, "id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of stored streams; the payload itself is available from ``demux``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, n, stored in zip(pdf["id"], pdf["n_bytes"], pdf["media"], strict=True):
                got = demux(stored)
                body = got["payload"]
                feature = f"packets={got['packets']};pes={len(got['pts'])};pts={got['pts'][0]}-{got['pts'][-1]};random_access={len(got['random_access'])};continuity_errors={got['continuity_errors']};mean={np.frombuffer(body, np.uint8).mean():.3f}"
                rows.append((doc, n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({"doc_id": "Int64"})

    return media.mapInPandas(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
