"""Capture files written here: both byte orders, both units of time, pieces of any size, a file within a file, cut-off ends."""

import random
import struct
from collections import Counter, defaultdict

import pytest

from fluxwarden.sources import capture


def frame(src, dst, sport, dport, proto, body=b"", flags=0x18):
    ip4 = lambda a: bytes(map(int, a.split(".")))
    inner = struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) if proto == 6 else struct.pack(">HHHH", sport, dport, 8, 0) if proto == 17 else b"\x08\x00"
    return b"\x00" * 12 + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(inner) + len(body), 0, 0, 64, proto, 0) + ip4(src) + ip4(dst) + inner + body


def written(path, packets, magic=b"\xd4\xc3\xb2\xa1", limit=65535, link=1, tail=b""):
    order, parts = capture.MAGIC[magic]
    out = magic + struct.pack(order + "HHiIII", 2, 4, 0, 0, limit, link)
    for ts, data in packets:
        out += struct.pack(order + "IIII", int(ts), int(round(ts % 1 * parts)) % parts, len(data), len(data)) + data
    path.write_bytes(out + tail)


def some_packets(seed, n):
    rng, out, ts = random.Random(seed), [], 1.7e9
    for _ in range(n):
        ts += rng.choice([0.25, 0.5, 30.0])
        a, b = rng.sample([("10.0.0.1", 5000), ("10.0.0.2", 443), ("9.9.9.9", 53), ("10.0.0.1", 5001)], 2)
        out.append((ts, frame(a[0], b[0], a[1], b[1], rng.choice([6, 6, 17, 1]), rng.randbytes(rng.randrange(300)))))
    return out


@pytest.mark.parametrize("magic", list(capture.MAGIC))
def test_pieces_hold_every_packet_once(spark, tmp_path, magic):
    packets = some_packets(1, 400)
    written(tmp_path / "a.pcap", packets, magic)
    written(tmp_path / "b.pcap", packets[:3], magic, tail=b"\x01\x02\x03")
    written(tmp_path / "none.pcap", [], magic)
    for split in (0, 700, 5_000, 1 << 20):
        got = capture.packets(spark, str(tmp_path), split).collect()
        assert Counter((r["path"].rsplit("/", 1)[-1], r["ts"], bytes(r["data"])) for r in got) == Counter([("a.pcap", *p) for p in packets] + [("b.pcap", *p) for p in packets[:3]])
    assert capture.packets(spark, str(tmp_path / "a.pcap"), 5_000).rdd.getNumPartitions() > 10
    whole = capture.packets_of_files(spark, str(tmp_path))
    assert whole.count() == 403 and whole.schema == capture.packets(spark, str(tmp_path)).schema


@pytest.mark.parametrize("cut", [1, 20, 100])
def test_a_cut_off_end_loses_only_its_packet(spark, tmp_path, cut):
    packets = [(t, d.ljust(150, b"x")) for t, d in some_packets(5, 100)]
    written(tmp_path / "a.pcap", packets)
    (tmp_path / "a.pcap").write_bytes((tmp_path / "a.pcap").read_bytes()[:-cut])
    for split in range(200, 3_000, 331):
        assert Counter(r["ts"] for r in capture.packets(spark, str(tmp_path / "a.pcap"), split).collect()) == Counter(t for t, _ in packets[:-1])


def test_a_capture_inside_a_packet_is_no_silent_loss(spark, tmp_path):
    written(tmp_path / "inner", [(t, d[:60]) for t, d in some_packets(2, 300)])
    inner = (tmp_path / "inner").read_bytes()[24:]
    written(tmp_path / "x.pcap", [(1.7e9, inner), *some_packets(3, 40)])
    assert capture.packets(spark, str(tmp_path / "x.pcap"), 0).count() == 41
    with pytest.raises(Exception, match="split_bytes 0"):
        capture.packets(spark, str(tmp_path / "x.pcap"), len(inner) // 2).collect()
    (tmp_path / "odd").write_bytes(b"no capture at all, only some text")
    with pytest.raises(Exception, match="no classic capture file"):
        capture.packets(spark, str(tmp_path / "odd")).collect()


def test_flows(spark, tmp_path):
    packets = some_packets(4, 200)
    written(tmp_path / "a.pcap", packets)
    want = defaultdict(list)
    for ts, d in packets:
        proto = d[23] if d[23] in (6, 17) else 0
        ends = [(".".join(map(str, d[26 + k : 30 + k])), struct.unpack(">H", d[34 + k // 2 : 36 + k // 2])[0] if proto else 0) for k in (0, 4)]
        want[tuple(sorted(ends)), proto].append((ts, ends[0], struct.unpack(">H", d[16:18])[0]))
    got = capture.capture_flows(capture.packets(spark, str(tmp_path), 3_000), 2).collect()
    assert len(got) == sum(len(v) >= 3 for v in want.values()) > 5
    for r in got:
        own = want[tuple(sorted([(r["lo"]["ip"], r["lo"]["port"]), (r["hi"]["ip"], r["hi"]["port"])])), r["proto"]]
        assert (r["packets"], r["bytes"], r["first_seen"], (r["src"], r["sport"]), r["label"]) == (len(own), sum(x[2] for x in own), min(own)[0], min(own)[1], 2)
