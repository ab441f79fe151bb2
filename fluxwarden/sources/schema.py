"""Canonical schemas, and the alias projection that brings any flow record to the canonical one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import net

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "map<string;double>": T.MapType(T.StringType(), T.DoubleType()),
}


def _struct(fields: str) -> T.StructType:
    """Built without a session, so that this module can be imported before there is one."""
    return T.StructType([T.StructField(*(lambda n, k: (n, _TYPES[k]))(*f.split())) for f in fields.split(",")])


FLOW = _struct("""
  flow_id string, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, proto string,
  orig_bytes bigint, resp_bytes bigint, orig_pkts bigint, resp_pkts bigint, duration_s double, payload_entropy double,
  ja3 string, ja4 string, sni string, tls_version string, cert_validity_days double, cert_self_signed boolean, dns_query string
""")
PACKET = _struct("ts double, src string, dst string, sport int, dport int, len int, proto int, flags int, iat_ns bigint")
ALERT = _struct("""
  alert_id string, flow_id string, ts timestamp, threat_type string, severity string, confidence double,
  mitre_ttps array<string>, explanation string, shap_values map<string;double>, analyst_status string
""")
RULE = _struct("""
  rule_id string, created_at timestamp, enabled boolean, expires_at timestamp, src_cidr string, dst_cidr string,
  dst_port int, sni_pattern string, threat_type string
""")
REVIEW = _struct("review_id string, flow_id string, label string, reviewed_at timestamp")
RESPONSE = _struct("response_id string, alert_id string, action string, target string, status string, created_at timestamp, expires_at timestamp")
SENSOR = _struct("sensor_id string, last_seen timestamp, packet_loss double")
#: canonical name: its aliases, first one first.
ALIASES = {
    "flow_id": ("flow_id", "uid", "id"), "src_ip": ("src_ip", "src"), "dst_ip": ("dst_ip", "dst"), "src_port": ("src_port", "sport"),
    "dst_port": ("dst_port", "dport"), "orig_bytes": ("orig_bytes", "bytes_out"), "sni": ("sni", "server_name"), "ja3": ("ja3", "ja3_hash"),
    "ja4": ("ja4", "ja4_hash"), "ts": ("ts", "timestamp"),
}
DEFAULTS = {"dst_port": 0, "src_port": 0, "orig_bytes": 0, "resp_bytes": 0, "orig_pkts": 1, "duration_s": 1.0}


def _typed(c: Column, kind: T.DataType, name: str) -> Column:
    if name == "ts":
        return F.coalesce(c.try_cast("timestamp"), F.timestamp_seconds(c.cast("string").try_cast("double")))
    return c.cast("string").try_cast(kind)


def canonical_flows(raw: DataFrame) -> DataFrame:
    """Any flow-like record: the first alias that has a value, in the canonical type; a failing cast gives the default. Other
    columns go. Missing columns are null, or the default."""
    have = {c.lower(): c for c in raw.columns}
    out = []
    for f in FLOW.fields:
        found = [F.col(f"`{have[a]}`") for a in ALIASES.get(f.name, (f.name,)) if a in have]
        value = F.coalesce(*[_typed(c, f.dataType, f.name) if not isinstance(f.dataType, T.StringType) else c.cast("string") for c in found]) if found else F.lit(None).cast(f.dataType)
        if f.name == "proto":
            value = net.protocol_name(value)
        if f.name in DEFAULTS:
            value = F.coalesce(value, F.lit(DEFAULTS[f.name]).cast(f.dataType))
        out.append(value.alias(f.name))
    return raw.select(*out)


def conform(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Exactly these columns: those that are missing are null."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c in columns])
