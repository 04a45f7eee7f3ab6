"""MPEG transport streams as a binary column: program tables, continuity, elementary packets, time stamps.

``demux`` reads whole streams, one row each, and returns one row for each reassembled elementary packet, with its
time stamps (90 kHz), whether a random-access point begins there, and the continuity errors seen in it.

Cases: a null or empty stream, one without sync bytes or one without valid program tables gives no rows; bytes before
the first sync and after a lost one are skipped up to the next packet; sections with a wrong CRC are ignored; packets
with the error bit, scrambled ones and null packets carry nothing; an exact repeat of a packet is dropped; a packet
lost in a unit marks that unit; bytes before a stream's first unit start are dropped; rows are read one by one, so
repeated rows repeat their results; an empty table gives an empty result; other columns are not read.

``mux`` is the writer for tests and for the registered query, since the tables hold no media: one program with the
text's lines as access units and a private stream with the metadata.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKET = 188
FIELDS = {
    "program": pa.int32(),
    "pid": pa.int32(),
    "stream_type": pa.int32(),
    "unit": pa.int64(),
    "pts": pa.int64(),
    "dts": pa.int64(),
    "random_access": pa.bool_(),
    "n_packets": pa.int64(),
    "n_bytes": pa.int64(),
    "cc_errors": pa.int64(),
    "complete": pa.bool_(),
    "crc32": pa.int64(),
    "payload": pa.binary(),
}

#: Stream ids whose packets have no header fields after the length: maps, padding, private 2, ECM, EMM, DSM-CC and such.
_PLAIN = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF))
_CRC = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC.append(_c)


def crc_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


# ~~ reading
def packets(data: bytes) -> np.ndarray:
    """(n, 188) packets; what lies between packets that keep the sync byte is skipped."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) // PACKET
    if n and len(raw) == n * PACKET and (raw[::PACKET] == 0x47).all():
        return raw.reshape(n, PACKET)
    out, at = [], 0
    while at + PACKET <= len(raw):
        if raw[at] == 0x47 and (at + PACKET == len(raw) or at + PACKET < len(raw) and raw[at + PACKET] == 0x47):
            out.append(at)
            at += PACKET
            continue
        if raw[at] == 0x47 and out and out[-1] + PACKET == at:
            out.append(at)  # the last packet of an unbroken run
            at += PACKET
            continue
        found = np.flatnonzero(raw[at + 1 : len(raw) - PACKET + 1] == 0x47)
        found = found + at + 1
        after = np.minimum(found + PACKET, len(raw) - 1)
        good = found[(found + PACKET == len(raw)) | (raw[after] == 0x47)]
        if not len(good):
            break
        at = int(good[0])
    return raw[np.array(out, np.int64)[:, None] + np.arange(PACKET)] if out else np.zeros((0, PACKET), np.uint8)


def sections(pk: np.ndarray, start: np.ndarray, pusi: np.ndarray) -> list[bytes]:
    """Whole sections with a right CRC, from the packets of one PID."""
    out, held = [], b""

    def take(buffer: bytes) -> bytes:
        while len(buffer) >= 3 and buffer[0] != 0xFF:
            size = 3 + ((buffer[1] & 0x0F) << 8 | buffer[2])
            if len(buffer) < size:
                return buffer
            if crc_mpeg(buffer[:size]) == 0:
                out.append(buffer[:size])
            buffer = buffer[size:]
        return b""

    for p, s, u in zip(pk, start.tolist(), pusi.tolist(), strict=True):
        body = p[s:].tobytes()
        if u and body:
            point = body[0]
            take(held + body[1 : 1 + point])
            held = take(body[1 + point :])
        elif held:
            held = take(held + body)
    return out


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def parse(data: bytes | None) -> list[tuple]:
    """Rows of ``FIELDS`` for one stream, by PID and then in stream order."""
    if not data:
        return []
    pk = packets(data)
    if not len(pk):
        return []
    pid = (pk[:, 1].astype(np.int32) & 0x1F) << 8 | pk[:, 2]
    pusi = (pk[:, 1] & 0x40) != 0
    adapt = (pk[:, 3] & 0x20) != 0
    body = (pk[:, 3] & 0x10) != 0
    cc = pk[:, 3] & 0x0F
    usable = ((pk[:, 1] & 0x80) == 0) & ((pk[:, 3] & 0xC0) == 0) & (pid != 0x1FFF)
    extra = np.where(adapt, 1 + pk[:, 4].astype(np.int64), 0)
    start = 4 + extra
    body &= start < PACKET
    flags = np.where(adapt & (extra > 1), pk[:, 5], 0)

    def of(p: int, need_body: bool = True) -> np.ndarray:
        return np.flatnonzero(usable & (pid == p) & (body if need_body else True))

    maps: dict[int, int] = {}
    at = of(0)
    for s in sections(pk[at], start[at], pusi[at]):
        if s[0] == 0 and s[5] & 1:
            for i in range(8, len(s) - 4, 4):
                number, p = s[i] << 8 | s[i + 1], (s[i + 2] & 0x1F) << 8 | s[i + 3]
                if number:
                    maps[p] = number
    streams: dict[int, tuple[int, int]] = {}
    for p in sorted(maps):
        at = of(p)
        for s in sections(pk[at], start[at], pusi[at]):
            if s[0] != 2 or not s[5] & 1:
                continue
            i = 12 + ((s[10] & 0x0F) << 8 | s[11])
            while i + 5 <= len(s) - 4:
                streams[(s[i + 1] & 0x1F) << 8 | s[i + 2]] = (s[3] << 8 | s[4], s[i])
                i += 5 + ((s[i + 3] & 0x0F) << 8 | s[i + 4])
    rows: list[tuple] = []
    for p, (program, kind) in sorted(streams.items()):
        at = of(p, need_body=False)
        if not len(at):
            continue
        has = body[at]
        step = (cc[at][1:].astype(np.int64) - cc[at][:-1]) & 15
        same = np.zeros(len(at), bool)
        # a repeated packet may carry a new clock reference
        plain = pk[at].copy()
        plain[np.ix_((flags[at] & 0x10) != 0, range(6, 12))] = 0
        same[1:] = (step == 0) & has[1:] & has[:-1] & (plain[1:] == plain[:-1]).all(axis=1)
        bad = np.zeros(len(at), bool)
        bad[1:] = (step != has[1:]) & ~same[1:] & ((flags[at][1:] & 0x80) == 0)
        keep = has & ~same
        # an error on a packet without payload counts for the unit under way
        unit = np.cumsum(pusi[at] & keep) - 1
        heads = np.flatnonzero(pusi[at] & keep)
        errors = np.bincount(unit[bad & (unit >= 0)], minlength=len(heads))
        for u, head in enumerate(heads.tolist()):
            last = heads[u + 1] if u + 1 < len(heads) else len(at)
            own = at[head:last][keep[head:last]]
            es = b"".join(pk[i, start[i] :].tobytes() for i in own.tolist())
            pts = dts = None
            whole = False
            if len(es) >= 6 and es[:3] == b"\0\0\1" and es[3] in _PLAIN:
                size = es[4] << 8 | es[5]
                whole = len(es) >= 6 + size
                es = es[6 : 6 + size] if size else es[6:]
            elif len(es) >= 9 and es[:3] == b"\0\0\1":
                size = es[4] << 8 | es[5]
                mark, head_size = es[7] >> 6, es[8]
                if mark & 2 and len(es) >= 14:
                    pts = dts = _stamp(es[9:14])
                    if mark & 1 and len(es) >= 19:
                        dts = _stamp(es[14:19])
                whole = not size or len(es) >= 6 + size
                es = es[9 + head_size : 6 + size if size else None]
            else:
                es = b""
            lost = int(errors[u])
            rows.append(
                (program, p, kind, u, pts, dts, bool(flags[at[head]] & 0x40), len(own), len(es), lost, whole and not lost, zlib.crc32(es), es)
            )
    return rows


def demux(media: DataFrame, id_col: str = "doc_id", data_col: str = "ts", payload: bool = True) -> DataFrame:
    """One row for each elementary packet of each stream: id, ``FIELDS`` (``payload`` only if asked for)."""
    names = [c for c in FIELDS if payload or c != "payload"]
    read = media.select(F.col(id_col).alias("__id"), F.col(data_col).alias("__data"))
    kinds = {"int32": "int", "int64": "long", "bool": "boolean", "binary": "binary"}
    schema = f"id {read.schema['__id'].dataType.simpleString()}, " + ", ".join(f"{c} {kinds[str(FIELDS[c])]}" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows, row_of = [], []
                for i, data in enumerate(b.column(1)):
                    got = parse(data.as_py())
                    rows += got
                    row_of += [i] * len(got)
                cols = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
                arrays = [pa.array(c, FIELDS[f]) for f, c in zip(FIELDS, cols, strict=True) if f in names]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row_of, pa.int64())), *arrays], names=["id", *names]
                )

    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)


# ~~ writing
def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0])
    return head + body + crc_mpeg(head + body).to_bytes(4, "big")


def _ticks(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29 & 14) | 1, t >> 22 & 255, (t >> 14 & 254) | 1, t >> 7 & 255, (t << 1 & 254) | 1])


_PAT = _section(0, 1, bytes([0, 1, 0xF0, 0x00]))
_PMT = _section(2, 1, bytes([0xE1, 0x00, 0xF0, 0x00, 0x1B, 0xE1, 0x00, 0xF0, 0x00, 0x06, 0xE1, 0x01, 0xF0, 0x00]))


def _table(pid: int, section: bytes, cc: int) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x10 | cc, 0]) + section).ljust(PACKET, b"\xff")


def _unit(pid: int, cc: int, es: bytes, pts: int, dts: int, random_access: bool, out: list[bytes]) -> int:
    size = len(es) + 13
    pes = b"\0\0\1\xe0" + (size if size < 65536 else 0).to_bytes(2, "big") + b"\x80\xc0\x0a" + _ticks(3, pts) + _ticks(1, dts) + es
    at, first = 0, True
    while at < len(pes):
        field = b"\x40" if first and random_access else b""
        room = 184 - (1 + len(field) if field else 0)
        n = min(room, len(pes) - at)
        if n < room or field:
            fill = 184 - n - 1
            field = (field or (b"\0" if fill else b"")).ljust(fill, b"\xff")
            head = bytes([0x47, 0x40 * first | pid >> 8, pid & 255, 0x30 | cc, fill]) + field
        else:
            head = bytes([0x47, 0x40 * first | pid >> 8, pid & 255, 0x10 | cc])
        out.append(head + pes[at : at + n])
        at += n
        cc = cc + 1 & 15
        first = False
    return cc


def mux(units: list[bytes], meta: bytes = b"", lose: int | None = None) -> bytes:
    """A stream of one program: ``units`` at 25 a second, every eighth a random-access point; ``lose`` drops one packet."""
    out: list[bytes] = []
    cc = 0
    for i, es in enumerate(units):
        if i % 64 == 0:
            k = i // 64 & 15
            out += [_table(0, _PAT, k), _table(0x1000, _PMT, k)]
            if i == 0:
                _unit(0x101, 0, meta, 0, 0, True, out)
        cc = _unit(0x100, cc, es, 7200 + 3600 * i, 3600 * i, i % 8 == 0, out)
    if lose is not None and len(out) > 3:
        del out[3 + lose % (len(out) - 3)]
    return b"".join(out)



def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = ("lang", "source"),
    lossy: bool = True,
) -> DataFrame:
    """(id, ts): the stream of every text, a line to an access unit. If ``lossy``, ids that leave 3 modulo 17 lose one
    packet, so that continuity errors occur."""
    read = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.concat_ws("/", *meta_cols).alias("meta")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out = []
                for i, text, meta in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    lose = i if lossy and i is not None and i % 17 == 3 else None
                    out.append(None if text is None else mux([x.encode() for x in text.split("\n")], meta.encode(), lose))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "ts"])

    return read.mapInArrow(run, "id long, ts binary").withColumnRenamed("id", id_col)
