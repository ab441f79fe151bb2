"""Suppression by keys against a plain loop over the rules, with both address families, patterns, ties and wildcards; plans with many rules."""

import ipaddress
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fluxwarden.functions import net
from fluxwarden.operators import rules

RULE = "rule_id string, created_at timestamp, enabled boolean, expires_at timestamp, src_cidr string, dst_cidr string, dst_port int, sni_pattern string, threat_type string"
ALERT = "flow_id int, src_ip string, dst_ip string, dst_port int, sni string, threat_type string, note string"
NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)


def some_ip(rng):
    return rng.choice([f"10.{rng.randrange(3)}.{rng.randrange(3)}.{rng.randrange(256)}", f"2001:db8:{rng.randrange(3)}::{rng.randrange(1, 5)}:{rng.randrange(16):x}", "::1", "", None, "no address", f"::ffff:10.0.0.{rng.randrange(9)}", "FE80::1", "1:2:3:4:5:6:7::", "1::2::3", "256.1.1.1"])


def some_net(rng):
    return rng.choice([None, None, "", f"10.{rng.randrange(3)}.0.0/{rng.choice([0, 8, 15, 16, 23, 24, 32])}", f"10.0.{rng.randrange(3)}.7/255.255.255.0", f"2001:db8:{rng.randrange(3)}::/{rng.choice([0, 32, 47, 48, 64, 65, 112, 128])}", "10.1.1.1", "::1", "nonsense/8", "10.0.0.0/40"])


def some_rules(seed, n):
    rng, out = random.Random(seed), []
    for i in range(n):
        out.append((f"r{i:03d}", NOW - timedelta(days=rng.randrange(5)), rng.choice([True, True, True, None, False]), rng.choice([None, None, NOW + timedelta(days=1), NOW - timedelta(days=1)]), some_net(rng), some_net(rng),
                    rng.choice([None, 0, 443, 22]), rng.choice([None, None, None, r"^a\d+\.example\.com$", r".*\.corp\.local", "host", "x|y", r"^$", r"[ab]z", "e", r"^splunk-.*\.net$", ""]), rng.choice([None, "", "c2", "scan"])))
    return out


def some_alerts(seed, n):
    rng = random.Random(seed)
    return [(i, some_ip(rng), some_ip(rng), rng.choice([443, 22, 80, None]), rng.choice([None, "", "a12.example.com", "b.corp.local", "myhost", "yes", "az", "splunk-1.net", "zzz"]), rng.choice(["c2", "scan", "other", None]), "n") for i in range(n)]


def ip_of(text):
    try:
        return ipaddress.ip_address(text or "0.0.0.0")
    except ValueError:
        return None


def plain_rule(alert, live):
    _, src, dst, port, sni, threat, _ = alert
    for r in live:
        rule_id, _, _, _, src_net, dst_net, rule_port, pattern, rule_threat = r
        try:
            nets = [(ip_of(ip), ipaddress.ip_network(c, strict=False)) for ip, c in ((src, src_net), (dst, dst_net)) if c]
        except ValueError:
            continue
        if all(ip is not None and ip in n for ip, n in nets) and (not rule_port or rule_port == port) and (not rule_threat or rule_threat == threat) and (not pattern or re.search(pattern, sni or "")):
            return rule_id
    return None


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 40, 200), (2, 300, 1), (4, 0, 200)])
def test_first_rule(spark, monkeypatch, seed, n, block):
    monkeypatch.setattr(rules, "BLOCK", block)
    monkeypatch.setattr(rules, "MAX_BROADCAST_RULES", 0 if seed == 2 else 10_000)
    made, alerts = some_rules(seed, n), some_alerts(seed, 400)
    if seed == 1:  # rules without any condition decide all that no earlier rule does
        made = [r for r in made if any(r[4:9])] + [("r999", NOW, True, None, None, "", None, None, "")]
    live = sorted((r for r in made if r[2] is not False and (r[3] is None or r[3] > NOW)), key=lambda r: (r[1], r[0]))
    got = rules.suppress(spark.createDataFrame(alerts, ALERT).repartition(3), spark.createDataFrame(made, RULE), ["flow_id"], F.lit(NOW))
    want = {a[0]: plain_rule(a, live) for a in alerts}
    assert {r["flow_id"]: r["rule_id"] for r in got.collect()} == want
    assert got.columns == [*(c.split()[0] for c in ALERT.split(", ")), "rule_id"]


def test_addresses_of_both_families(spark):
    rng = random.Random(4)
    texts = [some_ip(rng) for _ in range(80)] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(60)] + [ipaddress.IPv6Address(rng.getrandbits(128)).exploded for _ in range(20)] + ["::", "1::", "::8", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "12345::", ":::", ":1", "1:", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.400", "g::", "1:2:3:4:5:6:7:8::"]
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("a", net.address(F.col("t")))

    def plain(t):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return None
        n = int(a) << 96 if a.version == 4 else int(a)
        return a.version, n >> 64, n & (1 << 64) - 1

    for r in d.collect():
        got = (r["a"]["family"], r["a"]["hi"] % (1 << 64), r["a"]["lo"] % (1 << 64)) if r["a"] else None
        assert got == plain(r["t"]), r["t"]


def test_no_nested_loop_with_many_rules(spark):
    n = 100_000
    i = F.col("id")
    made = spark.range(n).select(
        F.concat(F.lit("r"), i.cast("string")).alias("rule_id"), F.timestamp_seconds(i).alias("created_at"), F.lit(True).alias("enabled"), F.lit(None).cast("timestamp").alias("expires_at"),
        F.when(i % 3 == 0, F.concat(F.lit("10."), (i % 200).cast("string"), F.lit("."), F.floor(i / 400).cast("string"), F.lit(".0/24"))).alias("src_cidr"), F.when(i % 3 == 1, F.concat(F.lit("2001:db8:"), F.lower(F.hex(i % 65536)), F.lit("::/48"))).alias("dst_cidr"),
        F.when(i % 2 == 0, 443).alias("dst_port"), F.when(i % 3 == 2, F.concat(F.lit(r"^host"), i.cast("string"), F.lit(r"\.example\.com$"))).alias("sni_pattern"), F.lit(None).cast("string").alias("threat_type"),
    )
    alerts = spark.range(3_000).select(i.alias("flow_id"), F.concat(F.lit("10."), (i % 200).cast("string"), F.lit("."), (i % 256).cast("string"), F.lit(".9")).alias("src_ip"), F.concat(F.lit("2001:db8:"), F.lower(F.hex(i)), F.lit("::7")).alias("dst_ip"), F.lit(443).alias("dst_port"), F.concat(F.lit("host"), i.cast("string"), F.lit(".example.com")).alias("sni"), F.lit("c2").alias("threat_type"))
    got = rules.suppress(alerts, made, ["flow_id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = {r["flow_id"]: r["rule_id"] for r in got.collect()}
    assert len(found) == 3_000 and found[5] == "r5" and found[1] == "r1" and None not in [found[k] for k in range(2, 3_000, 3)]
