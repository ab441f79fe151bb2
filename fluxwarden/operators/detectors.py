"""Rule detectors: flows with their running state to scored alerts.

Each takes flows with the columns it names and returns flow_id, threat_type, severity, confidence (three places),
mitre_ttps, explanation. Thresholds and windows are parameters; their defaults are the usual ones for live traffic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import net, strings
from . import state

#: Fixed values of the rules.
SCAN_IGNORED_PORTS = (80, 443, 8080, 53, 123, 1900, 67, 68, 5353, 5355)
LATERAL_THRESHOLDS = {445: 4, 3389: 3, 135: 4, 5985: 3, 22: 5}
LATERAL_TECHNIQUES = {445: "T1021.002,T1570,T1486", 3389: "T1021.001", 135: "T1047,T1021.003", 5985: "T1021.006", 22: "T1021.004"}
LATERAL_ELSE = "T1570,T1021"
LATERAL_NAMES = {445: "smb_spread", 3389: "rdp_spread", 135: "wmi_rpc_spread", 5985: "winrm_spread", 22: "ssh_spread"}
BRUTE_RULES = {
    22: (10, "ssh_brute_force", "T1110,T1110.001"), 3389: (8, "rdp_brute_force", "T1110,T1110.001"), 21: (12, "ftp_brute_force", "T1110,T1110.001"),
    25: (8, "smtp_brute_force", "T1110,T1078"), 110: (8, "pop3_brute_force", "T1110"), 5432: (15, "postgres_brute", "T1110"), 3306: (15, "mysql_brute", "T1110"),
}
RESOLVER_IPS = (
    "8.8.8.8", "8.8.4.4", "1.1.1.1", "1.0.0.1", "162.159.36.1", "162.159.46.1",
    "9.9.9.9", "149.112.112.112", "94.140.14.14", "94.140.15.15", "45.90.28.0", "45.90.30.0",
)
RESOLVER_DOMAINS = ("dns.google", "dns.google.com", "cloudflare-dns.com", "one.one.one.one", "dns.quad9.net", "dns.adguard.com", "dns.nextdns.io")
ENTROPY_IGNORED_PORTS = (80, 23, 21, 25, 110, 143, 8080, 53, 67, 68, 123, 161, 137, 138, 139, 445, 443, 853)
FINGERPRINTS = {
    "e7d705a3286e19ea42f587b344ee6865": "CobaltStrike C2 Client (Default)",
    "6d37c8e9aa2ef8649e7f6d5e9b94f4f1": "Sliver C2 Client Protocol",
    "a0e9f5d64349fb13191bc781f81f42e1": "Metasploit Meterpreter Client",
    "72a589da586844d7f0818ce684948eea": "Empire C2 Client Sockets",
    "b386946a5a44d1ddcc843bc75336dfce": "Generic RAT Client / NLBrute Core",
}
TECHNIQUES = {"c2_beacon": "T1071.001,T1573.001,T1573.002", "dns_tunnel": "T1048.003,T1071.004", "exfiltration": "T1041,T1048,T1048.001"}
HUNT_THRESHOLDS = {"default_ops": -2.0, "irc_hunt_mode": -3.0, "p2p_hunt_mode": -7.0, "max_sensitivity": -10.0}
RANSOMWARE_TECHNIQUES = "T1486,T1490,T1489,T1021.002,T1083"
#: The order in which a flow's alerts are collected, and the threat each detector's alerts are stored as.
COLLECTED = ("port_scan", "lateral_movement", "brute_force", "ransomware", "tls_fingerprint", "tls_certificate", "jitter_beacon", "doh_dot", "entropy_exfil")
STORED_AS = {"tls_fingerprint": "c2_beacon", "tls_certificate": "c2_beacon", "jitter_beacon": "c2_beacon", "doh_dot": "dns_tunnel", "entropy_exfil": "exfiltration"}


def _pick(key: Column, table: dict, default=None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def _alerts(df: DataFrame, fires: Column, kind: Column, severity: Column, confidence: Column, ttps: Column, why: Column) -> DataFrame:
    own = [c for c in ("ts", "src_ip", "dst_ip", "dst_port") if c in df.columns]
    return df.where(fires).select("flow_id", *own, kind.alias("threat_type"), severity.alias("severity"), F.round(confidence, 3).alias("confidence"), F.split(ttps, ",").alias("mitre_ttps"), why.alias("explanation"))


def _says(text: str, *values) -> Column:
    """``text`` with %s for each value; a missing one is left out."""
    return F.format_string(text, *[F.coalesce((F.col(v) if isinstance(v, str) else v).cast("string"), F.lit("")) for v in values])


def port_scan(flows: DataFrame, window_s: int = 60, ports: int = 30, hosts: int = 50, stealth_bytes: int = 80) -> DataFrame:
    """Distinct ports (vertical) or hosts (horizontal) of a source in a window; flows to ignored ports aren't counted."""
    f = flows.where(F.col("src_ip").isNotNull() & (F.col("src_ip") != "") & (F.col("dst_port") != 0) & ~F.col("dst_port").isin(*SCAN_IGNORED_PORTS))
    f = f.withColumn("_b", state.bucket(F.col("ts"), window_s))
    f = state.with_running_distinct(f, "_ports", "dst_port", ["src_ip", "_b"], ["ts", "flow_id"])
    f = state.with_running_distinct(f, "_hosts", "dst_ip", ["src_ip", "_b"], ["ts", "flow_id"])
    p, h = F.col("_ports"), F.col("_hosts")
    vertical = p >= ports
    confidence = F.when(vertical, F.least(F.lit(0.98), F.lit(0.60) + (p - ports) * F.lit(0.02))).otherwise(F.least(F.lit(0.97), F.lit(0.65) + (h - hosts) * F.lit(0.015)))
    stealth = F.col("orig_bytes") / F.greatest(F.col("orig_pkts"), F.lit(1)) < stealth_bytes
    kind = F.concat(F.when(stealth, "stealth_").otherwise(""), F.when(vertical, "vertical").otherwise("horizontal"))
    severity = F.when(stealth, "high").when(vertical, F.when(p > 50, "high").otherwise("medium")).otherwise("high")
    ttps = F.concat(F.when(vertical, "T1046,T1590.005").otherwise("T1595,T1595.002,T1590"), F.when(stealth, ",T1595.001").otherwise(""))
    why = F.when(vertical, _says(f"%s tried %s ports within {window_s} s", "src_ip", p)).otherwise(_says(f"%s tried %s hosts within {window_s} s", "src_ip", h))
    return _alerts(f, vertical | (h >= hosts), kind, severity, F.when(stealth, F.least(F.lit(0.99), confidence + F.lit(0.05))).otherwise(confidence), ttps, why)


def lateral_movement(flows: DataFrame, window_s: int = 300, thresholds: dict[int, int] | None = None, default: int = 10, internal: Callable[[Column], Column] = net.is_internal) -> DataFrame:
    """Distinct internal targets of an internal source per port in a window. ``internal`` judges an address: only valid ones by default; ``net.has_internal_prefix``
    is for names that look like addresses, as the flow view of events makes them (from user 65,536 on, 10.0.256.0)."""
    f = flows.where(internal(F.col("src_ip")) & internal(F.col("dst_ip")) & (F.col("src_ip") != F.col("dst_ip")))
    f = f.withColumn("_b", state.bucket(F.col("ts"), window_s))
    f = state.with_running_distinct(f, "_n", "dst_ip", ["src_ip", "dst_port", "_b"], ["ts", "flow_id"])
    limit = _pick(F.col("dst_port"), LATERAL_THRESHOLDS if thresholds is None else thresholds, default)
    severity = F.when((F.col("dst_port") == 445) & (F.col("_n") > 8), "critical").otherwise("high")
    return _alerts(f, F.col("_n") >= limit, F.lit("lateral_movement"), severity, F.least(F.lit(0.97), F.lit(0.65) + (F.col("_n") - limit) * F.lit(0.04)), _pick(F.col("dst_port"), LATERAL_TECHNIQUES, LATERAL_ELSE),
                   _says(f"%s reached %s internal hosts on port %s within {window_s} s (%s)", "src_ip", "_n", "dst_port", _pick(F.col("dst_port"), LATERAL_NAMES, "generic_fan_out")))


def brute_force(flows: DataFrame, window_s: int = 60, scale: float = 1.0, spray_targets: int = 4, spray_rate: int = 3) -> DataFrame:
    """Connections of a pair to a login port in a window, or one source trying many hosts on it (spray goes first). ``scale``
    multiplies the per-port limits."""
    f = flows.where((F.col("src_ip") != "") & (F.col("dst_ip") != "")).withColumn("_b", state.bucket(F.col("ts"), window_s))
    f = f.withColumn("_rate", state.running_count(["src_ip", "dst_ip", "dst_port", "_b"], ["ts", "flow_id"]))
    f = f.where(F.col("dst_port").isin(*BRUTE_RULES))  # other ports are counted apart, so they may go after the count
    f = state.with_running_distinct(f, "_targets", "dst_ip", ["src_ip", "dst_port", "_b"], ["ts", "flow_id"])
    limit = _pick(F.col("dst_port"), {p: max(1, int(r[0] * scale)) for p, r in BRUTE_RULES.items()})
    r, t = F.col("_rate"), F.col("_targets")
    spray = (t >= spray_targets) & (r >= spray_rate)
    kind = F.when(spray, "password_spray").otherwise(_pick(F.col("dst_port"), {p: x[1] for p, x in BRUTE_RULES.items()}))
    confidence = F.when(spray, F.least(F.lit(0.95), F.lit(0.65) + (t - spray_targets) * F.lit(0.05))).otherwise(F.least(F.lit(0.97), F.lit(0.60) + (r - limit) * F.lit(0.02)))
    severity = F.when(~spray & (r > 3 * limit), "critical").otherwise("high")
    ttps = F.when(spray, "T1110,T1110.003,T1078").otherwise(_pick(F.col("dst_port"), {p: x[2] for p, x in BRUTE_RULES.items()}))
    why = F.when(spray, _says(f"%s tried to log in on %s hosts, port %s, within {window_s} s", "src_ip", t, "dst_port")).otherwise(_says(f"%s connected %s times to %s, port %s, within {window_s} s", "src_ip", r, "dst_ip", "dst_port"))
    return _alerts(f, spray | (r >= limit), kind, severity, confidence, ttps, why)


def ransomware(flows: DataFrame, lateral: Column, c2: Column, window_s: int = 60, gap_s: int = 300, rate: int = 30, least: int = 2) -> DataFrame:
    """Two or more kinds of signal of a source, each at most ``gap_s`` seconds after the signal before it; fires on any flow of the source
    until as long after the last one. Only flows with a signal keep the set alive."""
    smb, port, order = F.col("dst_port") == 445, F.col("dst_port"), ["ts", "flow_id"]
    f = flows.withColumn("_b", state.bucket(F.col("ts"), window_s))
    f = f.withColumn("_rate", F.sum(F.when(smb, 1).otherwise(0)).over(state.running(["src_ip", "dst_ip", "_b"], order)))
    pps = F.coalesce(F.nullif("orig_pkts", F.lit(0)), F.lit(1)) / F.greatest(F.coalesce(F.nullif("duration_s", F.lit(0.0)), F.lit(0.1)), F.lit(0.001))
    signals = {
        "smb_write_burst": smb & ((F.col("_rate") >= rate) | (F.col("orig_bytes") >= 500_000)),
        "shadow_copy_kill_pattern": port.isin(135, 445) & lateral,
        "pre_encrypt_c2": c2,
        "smb_enumeration": smb & (pps > 50) & (F.col("orig_bytes") < 10_000),
    }
    for k, c in enumerate(signals.values()):
        f = f.withColumn(f"_s{k}", F.coalesce(c, F.lit(False)))
    any_ = F.greatest(*[F.col(f"_s{k}") for k in range(len(signals))])
    f = f.withColumn("_at", F.when(any_, state.seconds(F.col("ts"))))
    before = F.max("_at").over(Window.partitionBy("src_ip").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    f = f.withColumn("_new", F.when(F.col("_at").isNotNull() & (before.isNull() | (F.col("_at") - before > gap_s)), 1).otherwise(0))
    f = f.withColumn("_run", F.sum("_new").over(state.running(["src_ip"], order))).withColumn("_last", F.max("_at").over(state.running(["src_ip"], order)))
    w = state.running(["src_ip", "_run"], order)
    names = F.array_compact(F.array(*[F.when(F.max(f"_s{k}").over(w), F.lit(name)) for k, name in enumerate(signals)]))
    f = f.withColumn("_names", names).withColumn("_n", F.size("_names"))
    fires = (F.col("_n") >= least) & (state.seconds(F.col("ts")) - F.col("_last") <= gap_s)
    return _alerts(f, fires, F.lit("ransomware"), F.lit("critical"), F.least(F.lit(0.99), F.lit(0.70) + (F.col("_n") - 2) * F.lit(0.10)), F.lit(RANSOMWARE_TECHNIQUES), _says("%s shows %s", "src_ip", F.array_join("_names", ", ")))


def tls_fingerprint(flows: DataFrame, sensitive: str = r"^10\.14\.[12]\.") -> DataFrame:
    """Blacklisted client fingerprints; else a fingerprint new for a source that is known."""
    f = flows.withColumn("_fp", F.coalesce(F.nullif(F.col("ja3"), F.lit("")), F.nullif(F.col("ja4"), F.lit("")))).where("_fp is not null")
    bad = F.coalesce(F.col("ja3").isin(*FINGERPRINTS), F.lit(False)) | F.coalesce(F.col("ja4").isin(*FINGERPRINTS), F.lit(False))
    listed = _alerts(f.where(bad), F.lit(True), F.lit("blacklisted_tls_client"), F.lit("critical"), F.lit(0.98), F.lit("T1071.001,T1573.002"),
                     _says("%s uses a known client of attackers: %s", "src_ip", F.coalesce(_pick(F.col("ja3"), FINGERPRINTS), _pick(F.col("ja4"), FINGERPRINTS))))
    rest = state.with_first_seen(f.where(~bad), "_new", "_fp", ["src_ip"], ["ts", "flow_id"])
    severity = F.when(F.col("src_ip").rlike(sensitive), "high").otherwise("medium")
    return listed.unionByName(_alerts(rest, F.col("_new"), F.lit("anomalous_tls_client"), severity, F.lit(0.78), F.lit("T1071.001"), _says("%s uses the client fingerprint %s for the first time", "src_ip", "_fp")))


def tls_certificate(flows: DataFrame) -> DataFrame:
    """External self-signed certificates, or short-lived ones with a long or random first label."""
    outside = ~net.has_internal_prefix(F.col("dst_ip")) & (F.col("dst_ip") != "")
    signed = F.coalesce(F.col("cert_self_signed"), F.lit(False))
    sni = F.coalesce(F.col("sni"), F.lit(""))
    odd = (F.col("cert_validity_days") > 0) & (F.col("cert_validity_days") < 10) & ((strings.string_entropy(F.substring_index(sni, ".", 1)) > 4.2) | (F.length(sni) > 35))
    return _alerts(
        flows, outside & (signed | F.coalesce(odd, F.lit(False))), F.when(signed, "self_signed_external_cert").otherwise("suspicious_short_lived_cert"), F.lit("high"),
        F.when(signed, 0.88).otherwise(0.82), F.when(signed, "T1587.003,T1573.002").otherwise("T1587.003,T1071.001"),
        F.when(signed, _says("%s shows a certificate that it signed itself", "dst_ip")).otherwise(_says("%s shows a certificate of %s days for %s", "dst_ip", "cert_validity_days", sni)),
    )


def jitter_beacon(flows: DataFrame, history: int = 15, least: int = 8, size_cv: float = 0.20, keys: tuple[str, ...] = ("src_ip",), most: int = 25) -> DataFrame:
    """Regular but not constant intervals, and even total sizes, of a source's last ``history`` flows, the current one included; with ``keys`` src_ip and
    dst_ip, of a pair's. Flows without total_bytes have the sum of both directions."""
    order = Window.partitionBy(*keys).orderBy("ts", "flow_id")
    size = F.col("total_bytes") if "total_bytes" in flows.columns else F.coalesce("orig_bytes", F.lit(0)) + F.coalesce("resp_bytes", F.lit(0))
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    f = flows.withColumn("_gap", (us - F.lag(us).over(order)) / F.lit(1e6)).withColumn("_size", size.cast("double"))
    # A history of n flows has n - 1 intervals; the first flow's own is null.
    gaps, sizes = order.rowsBetween(2 - min(history, most + 1), 0), order.rowsBetween(1 - min(history, most), 0)
    f = f.withColumns({"_n": F.count("_gap").over(gaps), "_mean": F.avg("_gap").over(gaps), "_std": F.stddev_pop("_gap").over(gaps), "_size_mean": F.avg("_size").over(sizes), "_size_std": F.stddev_pop("_size").over(sizes)})
    f = f.where((F.col("_n") >= least) & (F.col("_mean") >= 0.8)).withColumn("_cv", F.col("_std") / F.col("_mean"))
    even = F.when(F.col("_size_mean") > 0, F.col("_size_std") / F.col("_size_mean")).otherwise(0.0) < size_cv
    return _alerts(
        f, F.col("_cv").between(0.05, 0.45) & even, F.lit("jittered_c2_beacon"), F.when(F.col("_mean") < 10, "high").otherwise("medium"),
        F.least(F.lit(0.96), F.lit(0.70) + F.lit(0.5) * (F.lit(0.45) - F.col("_cv"))), F.lit("T1071,T1071.001"), _says("%s calls at intervals that vary by %s %%", "src_ip", F.round(F.col("_cv") * 100, 1)),
    )


def doh_dot(flows: DataFrame, max_packet: int = 500, high_below: int = 200) -> DataFrame:
    """Small packets to public resolvers on 443 or 853."""
    sni = F.lower(F.coalesce(F.col("sni"), F.lit(""))) if "sni" in flows.columns else F.lit("")
    named = F.lit(False)
    for d in RESOLVER_DOMAINS:
        named = named | F.contains(sni, F.lit(d))
    size = F.col("orig_bytes") / F.greatest(F.col("orig_pkts"), F.lit(1))
    fires = (F.col("dst_ip") != "") & (F.col("dst_ip").isin(*RESOLVER_IPS) | named) & F.col("dst_port").isin(443, 853) & (size < max_packet)
    return _alerts(flows, fires, F.when(F.col("dst_port") == 443, "doh_tunnel").otherwise("dot_tunnel"), F.when(size < high_below, "high").otherwise("medium"), F.when(sni != "", 0.92).otherwise(0.85), F.lit("T1071.004,T1071.001"),
                   _says("packets of %s bytes to the resolver %s, port %s", F.floor(size), "dst_ip", "dst_port"))


def entropy_exfil(flows: DataFrame, min_bytes: int = 50_000, min_entropy: float = 7.2) -> DataFrame:
    """Large uploads of random-looking bytes on ports that don't carry TLS."""
    tls = F.coalesce(F.col("ja3"), F.lit("")) != "" if "ja3" in flows.columns else F.lit(False)
    e = F.col("payload_entropy")
    fires = ~F.col("dst_port").isin(*ENTROPY_IGNORED_PORTS) & (F.col("orig_bytes") >= min_bytes) & ~tls & (e >= min_entropy)
    return _alerts(flows, fires, F.lit("high_entropy_exfil"), F.when(F.col("orig_bytes") > 500_000, "critical").otherwise("high"), F.least(F.lit(0.95), F.lit(0.75) + F.lit(0.20) * (e - min_entropy)), F.lit("T1048.003,T1048"),
                   _says("%s bytes of entropy %s to %s, port %s, without TLS", "orig_bytes", F.round(e, 2), "dst_ip", "dst_port"))


def threshold_exfil(flows: DataFrame, baseline: DataFrame, max_bytes: int = 1_000_000, factor: float = 5.0) -> DataFrame:
    """Uploads over a fixed size or a multiple of the source's average (baseline: src_ip, avg_bytes)."""
    f = flows.join(baseline.select("src_ip", F.col("avg_bytes").alias("_avg")), "src_ip", "left")
    fires = (F.col("orig_bytes") > max_bytes) | F.coalesce((F.col("_avg") > 0) & (F.col("orig_bytes") > factor * F.col("_avg")), F.lit(False))
    return _alerts(f, fires, F.lit("exfiltration"), F.lit("critical"), F.lit(0.80), F.lit(TECHNIQUES["exfiltration"]), _says("%s bytes sent to %s", "orig_bytes", "dst_ip"))


def baseline(flows: DataFrame) -> DataFrame:
    return flows.groupBy("src_ip").agg(F.sum("orig_bytes").alias("total_bytes"), F.count("*").alias("n_flows")).withColumn("avg_bytes", F.col("total_bytes") / F.col("n_flows"))


def merged_baseline(stored: DataFrame, new: DataFrame) -> DataFrame:
    """A stored baseline with what was learned since added to it."""
    both = stored.select("src_ip", "total_bytes", "n_flows").unionByName(new.select("src_ip", "total_bytes", "n_flows"))
    return both.groupBy("src_ip").agg(F.sum("total_bytes").alias("total_bytes"), F.sum("n_flows").alias("n_flows")).withColumn("avg_bytes", F.col("total_bytes") / F.col("n_flows"))


def learn_or_detect(flows: DataFrame, learning: Column, stored: DataFrame | None = None, factor: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """The baseline after the flows for which ``learning`` holds, and alerts on the others that exceed it by the factor. Flows that are learned from give no alerts, and
    sources without a baseline neither."""
    learned = baseline(flows.where(learning))
    if stored is not None:
        learned = merged_baseline(stored, learned)
    return learned, threshold_exfil(flows.where(~learning).join(learned.select("src_ip"), "src_ip", "left_semi"), learned, (1 << 63) - 1, factor)


def ranked(*alerts: DataFrame) -> DataFrame:
    """All alerts, with the place of their detector in the order given."""
    out = None
    for rank, a in enumerate(alerts):
        a = a.withColumn("detector_rank", F.lit(rank))
        out = a if out is None else out.unionByName(a, allowMissingColumns=True)
    return out


def with_flag(flows: DataFrame, alerts: DataFrame, name: str) -> DataFrame:
    """``flows`` plus whether one of the alerts is of the flow."""
    hit = alerts.select("flow_id").distinct().withColumn(name, F.lit(True))
    return flows.join(hit, "flow_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def collected(by_detector: dict[str, DataFrame]) -> DataFrame:
    """The alerts of named detectors (``COLLECTED``, and ml before them) in the order in which a flow's alerts are stored: detector_rank, the
    threat that they are stored as, and the detector's own kind in ``kind``."""
    names = [n for n in ("ml", *COLLECTED) if n in by_detector]
    if unknown := set(by_detector) - set(names):
        raise KeyError(f"no detector is called {sorted(unknown)}")
    place = {n: i for i, n in enumerate(("ml", *COLLECTED))}
    out = None
    for n in names:
        a = by_detector[n].withColumn("kind", F.col("threat_type")).withColumn("detector_rank", F.lit(place[n]))
        a = a.withColumn("threat_type", F.col("kind") if n == "ml" else F.lit(STORED_AS.get(n, n)))
        out = a if out is None else out.unionByName(a, allowMissingColumns=True)
    return out


def with_techniques(alerts: DataFrame) -> DataFrame:
    """Alerts without techniques get those of their threat; unknown threats have none."""
    usual = _pick(F.col("threat_type"), TECHNIQUES)
    return alerts.withColumn("mitre_ttps", F.coalesce("mitre_ttps", F.split(usual, ","), F.array().cast("array<string>")))


def exfil_predict(score: Column, probability: Column | None, bytes_ratio: Column, extreme: float = 20.0) -> Column:
    """struct(anomaly_score, exfil_probability, prediction, trigger) from an isolation score (negative: anomalous) and, where there is one, a
    classifier's probability. An extreme ratio of bytes out to bytes in decides by itself."""
    anomaly = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) - score))
    p = F.when(score >= 0, F.lit(0.0)).otherwise(anomaly if probability is None else F.coalesce(probability, anomaly))
    called = F.when(score >= 0, "benign").otherwise("anomaly") if probability is None else F.when(score >= 0, "benign").when(probability > 0.6, "exfil").otherwise("anomaly")
    lone = F.coalesce(bytes_ratio > extreme, F.lit(False))
    return F.struct(
        anomaly.alias("anomaly_score"), F.when(lone, F.greatest(p, F.lit(0.85))).otherwise(p).alias("exfil_probability"), F.when(lone, "exfil").otherwise(called).alias("prediction"),
        F.when(lone, "extreme_bytes_ratio").alias("trigger"),
    )


CLASSES = ("clean", "c2_beacon", "dns_tunnel", "exfiltration")


def fuse(meta: Column, is_c2: Column, c2_confidence: Column, dns: Column, exfil: Column, duration: Column, orig: Column, resp: Column) -> Column:
    """struct(threat_type, confidence) of the ensemble. ``meta``: the meta-learner's probabilities of ``CLASSES``. The linear C2 model goes before it, and
    it may not call C2 itself; then DNS at 0.5 and exfiltration at 0.7 go before both; C2 is dropped for short browsing and for bulk uploads."""
    pick = lambda k, p: F.struct(F.lit(CLASSES[k]).alias("threat_type"), p.alias("confidence"))
    at = lambda k: F.coalesce(F.get(meta, F.lit(k)), F.lit(0.0))
    learned = F.when((at(0) >= at(2)) & (at(0) >= at(3)), pick(0, at(0))).when(at(2) >= at(3), pick(2, at(2))).otherwise(pick(3, at(3)))
    ratio = orig / (resp + F.lit(1.0))
    dropped = ((duration < 5) & (ratio < 0.3) & (orig < 5000)) | ((ratio > 5) & (orig > 5_000_000))
    return (
        F.when(dns >= 0.5, pick(2, dns)).when(exfil >= 0.7, pick(3, exfil))
        .when(is_c2 & dropped, pick(0, 1 - c2_confidence)).when(is_c2, pick(1, c2_confidence)).otherwise(learned)
    )


def top_reasons(values: Column, k: int = 5) -> Column:
    """The k entries of a map of contributions that weigh most, as (name, value), by absolute value and name."""
    entries = F.transform(F.map_entries(values), lambda e: F.struct((-F.abs(e["value"])).alias("w"), e["key"].alias("name"), e["value"].alias("value")))
    return F.slice(F.transform(F.array_sort(entries), lambda e: F.struct(e["name"], e["value"])), 1, k)


def severity_of(kind: Column, confidence: Column, beacon: Column) -> Column:
    return F.when(kind == "clean", "info").when((confidence > 0.9) | (beacon > 0.9), "critical").when(confidence > 0.75, "high").when(confidence > 0.5, "medium").otherwise("low")


def passes_gate(kind: Column, confidence: Column) -> Column:
    return (kind != "clean") & (confidence > 0.5)


def second_stage(orig: Column, resp: Column, duration: Column, cutoff_s: float = 0.1) -> Column:
    """Whether a suspected beacon stays one: not huge, not too short, not symmetric."""
    ratio = orig / F.greatest(resp, F.lit(1))
    return ~((orig > 100_000_000) | (duration < cutoff_s) | ((ratio > 0.95) & (ratio < 1.05)))


def two_stage(z: Column, threshold: float, seen: Column, p: Column, cv: Column, regular: Column, duration_cv: Column) -> Column:
    """struct(verdict, probability): stage one by its score z, stage two by the model or the host's regularity."""
    heuristic = (cv < 0.25) | (regular > 0.8) | (duration_cv < 0.20)
    chance = F.coalesce(p, F.when(heuristic, 0.85).otherwise(0.15))
    verdict = (
        F.when(z < threshold, F.struct(F.lit("benign").alias("verdict"), (1 / (1 + F.exp(-z))).alias("probability")))
        .when(seen < 2, F.when(z > -3, F.struct(F.lit("c2").alias("verdict"), F.lit(0.65).alias("probability"))).otherwise(F.struct(F.lit("suspicious").alias("verdict"), F.lit(0.5).alias("probability"))))
        .otherwise(F.struct(F.when(chance >= 0.45, "c2").otherwise("benign").alias("verdict"), chance.alias("probability")))
    )
    return verdict


def exfil_context(confidence: Column, large_uploads: Column, orig_bytes: Column, extreme_ratio: Column) -> Column:
    """Lower without earlier large uploads to the same place (unless huge or extreme), else higher."""
    lone = (large_uploads < 2) & (orig_bytes <= 10_000_000) & ~extreme_ratio
    return F.when(lone, confidence * F.lit(0.4)).when(large_uploads < 2, confidence).otherwise(F.least(F.lit(0.99), confidence * F.lit(1.3)))


def response_action(confidence: Column, auto: bool, least: float = 0.99) -> Column:
    return F.when(F.lit(auto) & (confidence > least), "auto_block").otherwise("queue")


def requested_response(confidence: Column, least: float = 0.90) -> Column:
    """What an analyst's request leads to: done at once if the alert is sure enough, else it waits for approval."""
    return F.when(confidence >= least, "execute").otherwise("await_approval")


def response_target(target: Column) -> Column:
    """block_ip for an IPv4 address, else block_domain."""
    return F.when(net.ip_to_long(target).isNotNull(), "block_ip").otherwise("block_domain")
