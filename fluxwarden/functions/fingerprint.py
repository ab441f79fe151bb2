"""TLS and QUIC fingerprints from parsed hellos (arrays of code points) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reserved values that clients send at random: 0x0a0a, 0x1a1a, ... 0xfafa.
GREASE = tuple(0x0A0A + 0x1010 * i for i in range(16))
SKIPPED_EXTENSIONS = (0x0000, 0x0010)
VERSIONS = {0x0301: "10", 0x0302: "11", 0x0303: "12", 0x0304: "13"}
LOG_VERSIONS = {"TLSv1": "10", "TLSv1.1": "11", "TLSv1.2": "12", "TLSv1.3": "13"}


def without_grease(a: Column) -> Column:
    return F.filter(F.coalesce(a, F.array().cast("array<int>")), lambda x: ~x.isin(*GREASE))


def _dashed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), "-")


def ja3_text(version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column) -> Column:
    return F.concat_ws(",", version.cast("string"), _dashed(without_grease(ciphers)), _dashed(without_grease(extensions)), _dashed(without_grease(curves)), _dashed(F.coalesce(formats, F.array().cast("array<int>"))))


def ja3(*parts: Column) -> Column:
    return F.md5(ja3_text(*parts))


def ja3s(version: Column, cipher: Column, extensions: Column) -> Column:
    return F.md5(F.concat_ws(",", version.cast("string"), cipher.cast("string"), _dashed(without_grease(extensions))))


def _map(c: Column, table: dict) -> Column:
    out = F.lit("00")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _short(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def _sorted_text(a: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(a), lambda x: x.cast("string")), ",")


def _two(n: Column) -> Column:
    return F.when(n < 100, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))


def ja4(version: Column, sni: Column, ciphers: Column, extensions: Column, alpn: Column) -> Column:
    """Reserved values don't count among ciphers nor in hashes; the number of extensions counts all."""
    c = without_grease(ciphers)
    hashed = F.filter(without_grease(extensions), lambda x: ~x.isin(*SKIPPED_EXTENSIONS))
    first = F.coalesce(F.substring(F.get(alpn, F.lit(0)), 1, 2), F.lit("00"))
    return F.concat(
        F.lit("t"), _map(version, VERSIONS), F.when(F.length(sni) > 0, "d").otherwise("i"), _two(F.size(c)), _two(F.size(F.coalesce(extensions, F.array().cast("array<int>")))),
        F.lit("_"), _short(_sorted_text(c)), F.lit("_"), _short(F.concat(_sorted_text(hashed), F.lit("_"), first)),
    )


def ja4_from_log(version: Column, sni: Column, cipher: Column, curve: Column, next_protocol: Column) -> Column:
    """What log records allow: one cipher, ten extensions."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        F.lit("t"), _map(F.coalesce(version, F.lit("TLSv1.3")), LOG_VERSIONS), F.when(F.length(sni) > 0, "d").otherwise("i"), F.lit("010a_"),
        _short(text(cipher)), F.lit("_"), _short(F.concat(text(curve), text(next_protocol))),
    )


def ja4_capture(version: Column, sni: Column, ciphers: Column, extensions: Column) -> Column:
    """Reserved values by their bit mask, ciphers as four hex digits, counts up to 99."""
    real = lambda a: F.filter(F.coalesce(a, F.array().cast("array<int>")), lambda x: x.bitwiseAND(0x0F0F) != 0x0A0A)
    hexed = lambda a: F.array_join(F.sort_array(F.transform(real(a), lambda x: F.lower(F.lpad(F.hex(x), 4, "0")))), ",")
    count = lambda a: F.lpad(F.least(F.size(real(a)), F.lit(99)).cast("string"), 2, "0")
    return F.concat(F.lit("t"), _map(version, VERSIONS), F.when(F.length(sni) > 0, "d").otherwise("i"), count(ciphers), count(extensions), F.lit("_"), _short(hexed(ciphers)), F.lit("_"), _short(hexed(extensions)))


def ja4_plain(version: Column, sni: Column, ciphers: Column, extensions: Column) -> Column:
    """All values, reserved ones as well, sorted; versions by the names that logs use."""
    some = lambda a: F.coalesce(a, F.array().cast("array<int>"))
    return F.concat(
        F.lit("t"), _map(version, LOG_VERSIONS), F.when(F.length(sni) > 0, "d").otherwise("i"), _two(F.size(some(ciphers))), _two(F.size(some(extensions))),
        F.lit("_"), _short(_sorted_text(some(ciphers))), F.lit("_"), _short(_sorted_text(some(extensions))),
    )


def quic_fingerprint(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(",", *[p.cast("string") for p in parts]), 256), 1, 16)


def is_quic(first_byte: Column) -> Column:
    return first_byte.bitwiseAND(192) == 192
