"""Handshakes written here, cut into segments that come in any order, with repeats and holes; what is too old goes."""

import hashlib
import random
import struct
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fluxwarden.streaming import handshake, keyed

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
PACKET = "packet_id bigint, ts timestamp, src_ip string, src_port int, dst_ip string, dst_port int, seq bigint, payload binary"
CIPHERS, CURVES = [0x1301, 0x0A0A, 0xC02B], [0x1A1A, 29, 23]


def record(body, kind=22):
    return struct.pack(">BHH", kind, 0x0301, len(body)) + body


def message(kind, body):
    return bytes([kind]) + len(body).to_bytes(3, "big") + body


def hello(name="host.example.com"):
    ext = lambda k, d: struct.pack(">HH", k, len(d)) + d
    sni = name.encode()
    exts = ext(0, struct.pack(">HBH", len(sni) + 3, 0, len(sni)) + sni) + ext(0x2A2A, b"") + ext(10, struct.pack(">H3H", 6, *CURVES)) + ext(11, b"\x01\x00")
    return message(1, struct.pack(">H", 771) + b"r" * 32 + b"\x04abcd" + struct.pack(">H3H", 6, *CIPHERS) + b"\x01\x00" + struct.pack(">H", len(exts)) + exts)


def der(tag, *parts):
    body = b"".join(parts)
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big")) + body


def cert(issuer, subject, first=b"240101000000Z", last=b"240111120000Z"):
    name = lambda n: der(0x30, der(0x0C, n))
    inner = der(0x30, der(0xA0, der(2, b"\x02")), der(2, b"\x01"), der(0x30, b"\x06\x00"), name(issuer), der(0x30, der(0x17, first), der(0x18, b"20" + last)), name(subject), der(0x30, b"k" * 300))
    raw = der(0x30, inner, der(0x30, b""), der(3, b"\x00"))
    chain = len(raw).to_bytes(3, "big") + raw
    return message(11, len(chain).to_bytes(3, "big") + chain)


def cut(rng, raw, base):
    at, out = 0, []
    while at < len(raw):
        n = rng.randrange(1 if at else 3, 90)
        out.append(((base + at) % (1 << 32), raw[at : at + n]))
        at += n
    return out


@pytest.mark.parametrize("seed", range(30))
def test_segments_in_any_order(seed):
    rng = random.Random(seed)
    raw = hello()
    half = rng.randrange(1, len(raw))
    parts = cut(rng, record(raw[:half]) + record(raw[half:]), (1 << 32) - 40)
    parts += rng.sample(parts, 2) + [(parts[1][0], parts[1][1][:1])]  # repeats, one of them shorter
    rng.shuffle(parts)
    c, seen = handshake.Connection(), []
    for k, (seq, data) in enumerate(parts):
        seen.append(c.feed(k * 1000, True, seq, data))
        c = handshake.Connection.of(*c.rows())  # as a state store would keep it
    known = [s for s in seen if s]
    assert known and all(k == known[0] for k in known)
    assert known[0] == {"version": 771, "ciphers": CIPHERS, "extensions": [0, 0x2A2A, 10, 11], "curves": CURVES, "formats": [0], "sni": "host.example.com"}
    assert c.feed(10**6, False, 5, None) == known[0]  # the other direction sees it


def test_certificate_and_what_goes():
    c, us = handshake.Connection(), 1_000_000
    raw = record(message(2, b"s" * 40) + cert(b"me", b"me"))
    assert c.feed(0, False, 1, raw[:100]) is None
    assert c.feed(9 * us, False, 101, raw[100:])["cert_self_signed"] is True
    assert c.feed(69 * us, False, 9, None) == {"cert_self_signed": True, "cert_validity_days": 10.0}
    assert c.feed(70 * us, False, 9, None) is None and not c.shown
    c = handshake.Connection()
    assert c.feed(0, False, 1, raw[:100]) is None and c.feed(11 * us, False, 101, raw[100:]) is None  # the first part was dropped after ten seconds
    assert handshake.Connection().feed(0, True, 1, record(cert(b"a", b"b")))["cert_self_signed"] is False
    c = handshake.Connection()
    c.feed(0, True, 1, record(hello()) + record(b"x" * 50, 23))
    assert not c.held and c.shown
    c = handshake.Connection()
    for k in range(80):
        c.feed(k, True, 10**6 + 1000 * k, b"z" * 1000)
    assert sum(len(d) for _, _, p in c.held.values() for _, d in p) <= handshake.MOST
    assert handshake.Connection().feed(0, True, None, record(hello()))["sni"] == "host.example.com"
    assert handshake.Connection().feed(0, True, 1, record(message(1, b"broken"))) is None


def packets():
    rng, rows = random.Random(1), []
    for conn in range(8):
        at = START + timedelta(seconds=20 * conn)
        client, server = (f"10.0.0.{conn}", 5000 + conn), ("9.9.9.9", 443)
        parts = [(client, server, *p) for p in cut(rng, record(hello(f"h{conn}.example.com")), 1000)] + [(server, client, *p) for p in cut(rng, record(cert(b"i", b"i" if conn % 2 else b"s")), 77)]
        rng.shuffle(parts)
        for a, b, seq, data in [*parts, (client, server, 5, None)]:
            at += timedelta(milliseconds=50)
            rows.append((len(rows), at, *a, *b, seq, data))
        rows.append((len(rows), at + timedelta(seconds=100), *client, *server, 6, None))
    return rows


def test_batch_and_stream(spark, tmp_path):
    rows = packets()
    d = spark.createDataFrame(rows, PACKET)
    want = {r["id"]: r for r in handshake.with_fingerprints(handshake.sessions(d.repartition(4))).collect()}
    assert len(want) == len(rows)
    for r in rows:
        conn = next(k for k in range(8) if f"10.0.0.{k}" in (r[2], r[4]))
        if r[6] == 5:
            found = want[r[0]]
            assert (found["sni"], found["cert_validity_days"]) in ((f"h{conn}.example.com", None), (f"h{conn}.example.com", 10.0))
            assert found["ja3"] == hashlib.md5(b"771,4865-49195,0-10-11,29-23,0").hexdigest() and found["ja4"].startswith("t12d0203_")
        if r[6] == 6:
            assert want[r[0]]["sni"] is None and want[r[0]]["ja3"] is None
    rng = random.Random(3)
    dealt = sorted(rows, key=lambda r: r[1].timestamp() + rng.uniform(0, 500))
    for k in range(3):
        spark.createDataFrame(dealt[k * len(rows) // 3 : (k + 1) * len(rows) // 3], PACKET).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(9999, START + timedelta(days=2), "x", 1, "y", 2, 1, None)], PACKET).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    keyed.use_rocksdb(spark)
    out = handshake.stream_sessions(spark.readStream.schema(PACKET).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    got = {r["id"]: r for r in handshake.with_fingerprints(spark.read.schema(out.schema).parquet(f"{tmp_path}/out")).collect()}
    assert got == want
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 10
    assert handshake.sessions(d.where(F.lit(False))).count() == 0
