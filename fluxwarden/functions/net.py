"""Addresses, ports and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
#: Private networks.
INTERNAL = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16")
PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP", 58: "ICMPv6"}


def ip_to_long(ip: Column) -> Column:
    """IPv4 text as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    value = F.lit(0).cast("long")
    for i in range(4):
        value = value * 256 + F.get(parts, F.lit(i)).try_cast("long")
    return F.when(ip.rlike(IPV4), value)


def long_to_ip(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)])


def cidr_bounds(cidr: Column) -> tuple[Column, Column]:
    """First and last address of a.b.c.d/n as numbers, host bits cleared; a bare address is itself."""
    bits = F.coalesce(F.get(F.split(cidr, "/"), F.lit(1)).try_cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("long")
    ip = ip_to_long(F.get(F.split(cidr, "/"), F.lit(0)))
    low = ip - ip % size
    return low, low + size - 1


def _bound(value: Column, f) -> Column:
    """f(value) with ``value`` computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _v6_words(text: Column) -> Column:
    """The eight groups of an IPv6 text as numbers; null for anything else."""
    low = F.lower(text)
    tail = ip_to_long(F.substring_index(low, ":", -1))  # an IPv4 address may stand for the last two groups
    low = F.when(F.contains(low, F.lit(".")), F.concat(F.regexp_replace(low, "[^:]*$", ""), F.lower(F.hex(F.shiftright(tail, 16))), F.lit(":"), F.lower(F.hex(tail.bitwiseAND(65535))))).otherwise(low)
    groups = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))

    def filled(halves: Column) -> Column:
        left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
        zeros = F.lit(8) - F.size(left) - F.size(right)
        return F.when((F.size(halves) == 1) & (F.size(left) == 8), left).when((F.size(halves) == 2) & (zeros >= 1), F.concat(left, F.array_repeat(F.lit("0"), F.greatest(zeros, F.lit(0))), right))

    whole = lambda g: F.when(F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$")), F.transform(g, lambda x: F.conv(x, 16, 10).cast("long")))
    return _bound(F.split(low, "::"), lambda halves: _bound(filled(halves), whole))


def address(ip: Column) -> Column:
    """struct(family, hi, lo) of an IPv4 or IPv6 text, null for anything else: the address's bits from the left of ``hi`` on, so that prefixes of either
    family are cut in the same way."""

    def v6(w: Column) -> Column:
        at = lambda i: F.get(w, F.lit(i))
        four = lambda k: F.shiftleft(at(k), 48).bitwiseOR(F.shiftleft(at(k + 1), 32)).bitwiseOR(F.shiftleft(at(k + 2), 16)).bitwiseOR(at(k + 3))
        return F.when(w.isNotNull(), F.struct(F.lit(6).alias("family"), four(0).alias("hi"), four(4).alias("lo")))

    v4 = F.when(ip.rlike(IPV4), F.struct(F.lit(4).alias("family"), F.shiftleft(ip_to_long(ip), 32).alias("hi"), F.lit(0).cast("long").alias("lo")))
    return F.when(F.contains(ip, F.lit(":")), _bound(_v6_words(ip), v6)).otherwise(v4)


def network(cidr: Column) -> Column:
    """struct(family, bits, p1, p2) of address/bits, of address/mask or of a bare address, host bits cleared; null for anything else."""
    parts = F.split(F.trim(cidr), "/")
    size = F.get(parts, F.lit(1))
    mask = F.when(size.rlike(IPV4), F.bit_count(ip_to_long(size)))

    def cut(a: Column) -> Column:
        most = F.when(a["family"] == 4, 32).otherwise(128)
        bits = F.when(F.size(parts) == 1, most).when(F.size(parts) == 2, F.coalesce(mask, size.try_cast("int")))
        return F.when(a.isNotNull() & bits.between(0, most), F.struct(a["family"].alias("family"), bits.alias("bits"), *prefix(a, bits)))

    return _bound(address(F.get(parts, F.lit(0))), cut)


def prefix(a: Column, bits: Column) -> tuple[Column, Column]:
    """The first bits of an address as two numbers, p1 and p2."""
    right = lambda x, n: F.call_function("shiftrightunsigned", x, n.cast("int"))
    p1 = F.when(bits == 0, F.lit(0).cast("long")).when(bits <= 64, right(a["hi"], 64 - bits)).otherwise(a["hi"])
    p2 = F.when(bits <= 64, F.lit(0).cast("long")).otherwise(right(a["lo"], 128 - bits))
    return p1.alias("p1"), p2.alias("p2")


def is_within(a: Column, net: Column) -> Column:
    """Whether an address (see ``address``) lies in a network (see ``network``)."""
    p1, p2 = prefix(a, net["bits"])
    return F.coalesce((a["family"] == net["family"]) & (p1 == net["p1"]) & (p2 == net["p2"]), F.lit(False))


def clean_cidr(text: Column) -> Column:
    """A bare address becomes /32 (or /128 with colons)."""
    t = F.trim(text)
    return F.when(F.contains(t, F.lit("/")), t).when(F.contains(t, F.lit(":")), F.concat(t, F.lit("/128"))).otherwise(F.concat(t, F.lit("/32")))


def is_internal(ip: Column) -> Column:
    n, out = ip_to_long(ip), F.lit(False)
    for net in INTERNAL:
        base, bits = net.split("/")
        a, b, c, d = map(int, base.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        out = out | n.between(low, low + (1 << (32 - int(bits))) - 1)
    return F.coalesce(out, F.lit(False))


def has_internal_prefix(ip: Column) -> Column:
    """By text, as the certificate rule has it."""
    return F.coalesce(ip.rlike(r"^(10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)"), F.lit(False))


def has_loose_internal_prefix(ip: Column) -> Column:
    """By text, with any 172. network."""
    return F.startswith(ip, F.lit("10.")) | F.startswith(ip, F.lit("192.168.")) | F.startswith(ip, F.lit("172."))


def protocol_name(proto: Column) -> Column:
    out = F.lit(None).cast("string")
    code = proto.try_cast("int")
    for number, name in PROTOCOLS.items():
        out = F.when(code == number, name).otherwise(out)
    return F.substring(F.coalesce(out, proto.cast("string")), 1, 10)


def is_uuid(s: Column) -> Column:
    return F.coalesce(s.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), F.lit(False))


#: Numbers that stand for protocols (by what the name holds) and connection states; others are 0.
PROTOCOL_CODES = {"tcp": 1.0, "udp": 2.0, "icmp": 3.0}
STATE_CODES = {"CON": 1.0, "INT": 2.0, "REQ": 3.0, "RST": 4.0, "SF": 5.0, "S0": 6.0, "REJ": 7.0, "RSTO": 8.0, "FIN": 9.0, "URP": 10.0}


def protocol_code(proto: Column) -> Column:
    name, out = F.lower(F.trim(F.coalesce(proto.cast("string"), F.lit("")))), F.lit(0.0)
    for word, code in reversed(PROTOCOL_CODES.items()):
        out = F.when(F.contains(name, F.lit(word)), code).otherwise(out)
    return out


def state_code(state: Column) -> Column:
    name, out = F.upper(F.trim(F.coalesce(state.cast("string"), F.lit("")))), F.lit(0.0)
    for word, code in STATE_CODES.items():
        out = F.when(name == word, code).otherwise(out)
    return out
