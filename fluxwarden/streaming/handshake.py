"""TLS handshakes put together from TCP segments: each packet with what its connection has shown of itself so far.

A connection's two directions share a key, so that a packet finds the handshake of either. Segments are kept by their sequence numbers until the bytes
from the handshake's first record on have no hole, whatever the order in which they came; messages may reach over records. A side that has been collecting for
``BUFFER_S`` seconds is dropped, and so is what a side has shown when it is ``SESSION_S`` seconds old and when a side holds more than ``MOST`` bytes. The same small machine serves the
batch form (packets sorted by connection and time pass it, so one connection is held at a time) and the stream (its state as a row, timers drop it).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import fingerprint
from .keyed import LATE, InOrder, _run

BUFFER_S, SESSION_S, MOST = 10, 60, 1 << 16
MICROS = 1_000_000
#: Fixed values of the protocol: record and message types, extension numbers.
HANDSHAKE, CLIENT_HELLO, CERTIFICATE = 22, 1, 11
SERVER_NAME, GROUPS, POINT_FORMATS = 0, 10, 11
SHOWN = "version int, ciphers array<int>, extensions array<int>, curves array<int>, formats array<int>, sni string, cert_self_signed boolean, cert_validity_days double"
NAMES = [f.split()[0] for f in SHOWN.split(", ")]
OUT = f"key string, id bigint, {SHOWN}"


def _words(raw: bytes) -> list[int]:
    return list(struct.unpack(f">{len(raw) // 2}H", raw[: len(raw) // 2 * 2]))


def client_hello(body: bytes) -> dict:
    """Version, ciphers, extensions, curves, point formats and server name of a ClientHello."""
    at = 34
    at += 1 + body[at]
    n = int.from_bytes(body[at : at + 2], "big")
    out = {"version": int.from_bytes(body[:2], "big"), "ciphers": _words(body[at + 2 : at + 2 + n]), "extensions": [], "curves": [], "formats": [], "sni": ""}
    at += 2 + n
    at += 1 + body[at]
    stop = min(len(body), at + 2 + int.from_bytes(body[at : at + 2], "big"))
    at += 2
    while at + 4 <= stop:
        kind, n = struct.unpack(">HH", body[at : at + 4])
        data, at = body[at + 4 : at + 4 + n], at + 4 + n
        out["extensions"].append(kind)
        if kind == SERVER_NAME and len(data) >= 5:
            out["sni"] = data[5 : 5 + int.from_bytes(data[3:5], "big")].decode(errors="replace")
        elif kind == GROUPS:
            out["curves"] = _words(data[2 : 2 + int.from_bytes(data[:2], "big")])
        elif kind == POINT_FORMATS and data:
            out["formats"] = list(data[1 : 1 + data[0]])
    return out


def _der(raw: bytes, at: int) -> tuple[int, int, int]:
    """Tag of the value at a place, where its content begins, and where it ends."""
    n, start = raw[at + 1], at + 2
    if n & 0x80:
        size = n & 0x7F
        n, start = int.from_bytes(raw[start : start + size], "big"), start + size
    return raw[at], start, start + n


def _time(tag: int, text: bytes) -> datetime:
    said = text.decode().rstrip("Z")
    if tag == 0x17:  # two digits for the year
        said = ("19" if int(said[:2]) >= 50 else "20") + said
    return datetime.strptime(said[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc)


def certificate(body: bytes) -> dict:
    """Whether the first certificate of the message names itself as its issuer, and the whole days that it is valid."""
    n = int.from_bytes(body[3:6], "big")
    raw = body[6 : 6 + n]
    at = _der(raw, _der(raw, 0)[1])[1]
    if raw[at] == 0xA0:
        at = _der(raw, at)[2]
    at = _der(raw, _der(raw, at)[2])[2]  # past the serial number and the signature's algorithm
    issuer = _der(raw, at)
    valid = _der(raw, issuer[2])
    first = _der(raw, valid[1])
    last = _der(raw, first[2])
    subject = _der(raw, valid[2])
    days = (_time(last[0], raw[last[1] : last[2]]) - _time(first[0], raw[first[1] : first[2]])).days
    return {"cert_self_signed": raw[issuer[1] : issuer[2]] == raw[subject[1] : subject[2]], "cert_validity_days": float(days)}


class Connection:
    """The state of one connection: for each side the segments of a handshake that isn't whole, (base, since, [(seq, bytes)]), and what it has shown, (since, values)."""

    def __init__(self):
        self.held: dict[bool, tuple[int | None, int, list[tuple[int, bytes]]]] = {}
        self.shown: dict[bool, tuple[int, dict]] = {}

    def drop_old(self, us: int) -> None:
        self.held = {k: v for k, v in self.held.items() if us - v[1] <= BUFFER_S * MICROS}
        self.shown = {k: v for k, v in self.shown.items() if us - v[0] <= SESSION_S * MICROS}

    def feed(self, us: int, side: bool, seq: int | None, data: bytes | None) -> dict | None:
        """Takes a packet and tells what its connection has shown, its own side first."""
        self.drop_old(us)
        if data:
            base, since, parts = self.held.get(side, (None, us, []))
            if len(data) >= 3 and data[0] == HANDSHAKE and data[1] == 3 and 1 <= data[2] <= 3 and (base is None or seq is not None and (base - seq) % (1 << 32) < 1 << 31):
                base = seq if seq is not None else 0  # of several records that begin a segment the first one counts
            if seq is None:  # without numbers segments are taken as they come
                seq, parts = (parts[-1][0] + len(parts[-1][1]) if parts else 0), parts if base is not None else []
            parts = [*parts, (seq, data)] if base is not None or seq else parts
            self.held[side] = (base, since, parts)
            if base is not None:
                self._read(us, side)
            if side in self.held and sum(len(d) for _, d in self.held[side][2]) > MOST:
                del self.held[side]
        found = self.shown.get(side) or self.shown.get(not side)
        return found[1] if found else None

    def _read(self, us: int, side: bool) -> None:
        base, since, parts = self.held[side]
        raw = bytearray()
        for at, data in sorted((((seq - base) % (1 << 32), data) for seq, data in parts), key=lambda p: p[0]):
            if at <= len(raw) < at + len(data):
                raw += data[len(raw) - at :]
        at, said, over = 0, bytearray(), False
        while at + 5 <= len(raw) and not over:
            kind, n = raw[at], int.from_bytes(raw[at + 3 : at + 5], "big")
            if kind != HANDSHAKE:
                over = True
            elif at + 5 + n > len(raw):
                break
            else:
                said += raw[at + 5 : at + 5 + n]
                at += 5 + n
        place = 0
        while place + 4 <= len(said) and place + 4 + int.from_bytes(said[place + 1 : place + 4], "big") <= len(said):
            kind, n = said[place], int.from_bytes(said[place + 1 : place + 4], "big")
            body, place = bytes(said[place + 4 : place + 4 + n]), place + 4 + n
            try:
                values = client_hello(body) if kind == CLIENT_HELLO else certificate(body) if kind == CERTIFICATE else None
            except (IndexError, ValueError, struct.error):  # a message that breaks its own format says nothing
                values = None
            if values:
                self.shown[side] = (us, (self.shown[side][1] if side in self.shown else {}) | values)
        if over or at == len(raw) and place == len(said):  # nothing is left that a later segment could complete
            self.held.pop(side, None)

    def rows(self) -> list[tuple]:
        """The state as rows: (side, since, base, seq, data) of held segments and (side, since, values) of what was shown."""
        held = [(s, since, base, seq, data) for s, (base, since, parts) in self.held.items() for seq, data in parts]
        return held, [(s, since, *[v.get(n) for n in NAMES]) for s, (since, v) in self.shown.items()]

    @classmethod
    def of(cls, held, shown) -> Connection:
        c = cls()
        for side, since, base, seq, data in held:
            parts = c.held.get(side, (base, since, []))[2]
            c.held[side] = (base, since, [*parts, (seq, bytes(data))])
        for side, since, *values in shown:
            c.shown[side] = (since, {n: v for n, v in zip(NAMES, values, strict=True) if v is not None})
        return c


class Handshakes(InOrder):
    def __init__(self):
        super().__init__("us bigint, id bigint, side boolean, seq bigint, data binary", "", SESSION_S)

    def open(self, handle):
        self.held = handle.getListState("held", "side boolean, since bigint, base bigint, seq bigint, data binary")
        self.shown = handle.getListState("shown", f"side boolean, since bigint, {SHOWN}")

    def steps(self, key, due):
        c = Connection.of((tuple(r) for r in self.held.get()), (tuple(r) for r in self.shown.get()))
        for us, at, side, seq, data in due:
            found = c.feed(us, side, seq, bytes(data) if data is not None else None) or {}
            yield Row(key=key, id=at, **{n: found.get(n) for n in NAMES})
        for state, rows in zip((self.held, self.shown), c.rows(), strict=True):
            if rows:
                state.put(rows)
            else:
                state.clear()

    def forget(self):
        self.held.clear()
        self.shown.clear()


def _ends() -> tuple[Column, Column]:
    a, b = (F.concat_ws(":", *cs) for cs in (("src_ip", "src_port"), ("dst_ip", "dst_port")))
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b)), a <= b


def stream_sessions(packets: DataFrame, ts: str = "ts", order: str = "packet_id", late: str = LATE) -> DataFrame:
    """(key, id, ...) of a stream of packets (src_ip, src_port, dst_ip, dst_port, seq, payload): each with the handshake fields known of its connection."""
    key, side = _ends()
    d = packets.withColumn("_key", key)
    return _run(d, Handshakes(), OUT, "_key", ts, order, late, side.alias("side"), F.col("seq").cast("bigint").alias("seq"), F.col("payload").alias("data"))


def sessions(packets: DataFrame, ts: str = "ts", order: str = "packet_id") -> DataFrame:
    """The batch form of ``stream_sessions``."""
    key, side = _ends()
    kinds = {"version": pa.int32(), "sni": pa.string(), "cert_self_signed": pa.bool_(), "cert_validity_days": pa.float64()}
    schema = pa.schema([("key", pa.string()), ("id", pa.int64()), *[(n, kinds.get(n, pa.list_(pa.int32()))) for n in NAMES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, c = None, Connection()
        for batch in batches:
            out = []
            for name, us, i, s, seq, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if name != at:
                    at, c = name, Connection()
                out.append({"key": name, "id": i} | (c.feed(us, s, seq, data) or {}))
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in out], schema)

    d = packets.select(key.alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(order).cast("bigint").alias("id"), side.alias("side"), F.col("seq").cast("bigint").alias("seq"), F.col("payload").alias("data"))
    return d.repartition("key").sortWithinPartitions("key", "us", "id").mapInArrow(run, OUT)


def with_fingerprints(found: DataFrame) -> DataFrame:
    """Packets with handshake fields plus ja3 and ja4 of those that have a client's hello."""
    c = F.col
    real = lambda a: F.filter(a, lambda x: x.bitwiseAND(0x0F0F) != 0x0A0A)
    hello = c("version").isNotNull()
    return found.withColumns({"ja3": F.when(hello, fingerprint.ja3(c("version"), c("ciphers"), c("extensions"), real(c("curves")), c("formats"))), "ja4": F.when(hello, fingerprint.ja4_capture(c("version"), c("sni"), c("ciphers"), c("extensions")))})
