"""Suppression rules: alerts against rules whose null or empty fields match anything; the first rule (by age, then id) wins.

Rules are joined by equality only, so their number may grow: each has a shape (which network is looked up, its family and length, whether a port and a
threat are named) and a key of that shape: the network's prefix, the port, the threat. An alert has one key for every shape that occurs. What a
key can't hold (a second network, a pattern) is looked at for the rules that a key found. Rules that name nothing but a pattern are found by three letters in a row that
every match must contain, the rarest such letters of the pattern among all patterns, and are looked at once for each distinct name; patterns without such
letters meet the distinct names in blocks. Shapes go to the driver (a few hundred at most, one for each prefix length), rules don't.

An alert without an address counts as 0.0.0.0, one without a name as the empty name. Rules with a network that can't be read match nothing; patterns
must be valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from .storage import written

MAX_BROADCAST_RULES = 10_000
#: Patterns of a block of those that can't be looked up by letters.
BLOCK = 200
#: Patterns made of letters, digits, escaped dots and .*, with or without anchors: a match contains all their letters.
PLAIN = r"^\^?(?:[A-Za-z0-9_-]|\\\.|\.\*)*\$?$"


def prepared(rules: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Enabled rules that haven't expired, with networks as prefixes; written, since they are read several times. Rules whose networks can't be read go."""
    now = F.current_timestamp() if as_of is None else as_of
    live = rules.where(F.coalesce("enabled", F.lit(True)) & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    said = {side: F.nullif(F.trim(F.col(f"{side}_cidr")), F.lit("")) for side in ("src", "dst")}
    read = written(live.select(
        "rule_id", "created_at", *[net.network(c).alias(f"{side}_net") for side, c in said.items()], *[c.isNotNull().alias(f"{side}_said") for side, c in said.items()], F.nullif(F.col("dst_port"), F.lit(0)).alias("rule_dst_port"),
        *[F.nullif(F.col(c), F.lit("")).alias(f"rule_{c}") for c in ("sni_pattern", "threat_type")],
    ), "rules")
    for side in said:
        read = read.where(~F.col(f"{side}_said") | F.col(f"{side}_net").isNotNull())
    return read.drop("src_said", "dst_said")


def _keyed(live: DataFrame) -> DataFrame:
    """Rules with their shape and key. The network looked up is the narrower one."""
    wide = lambda side: F.col(f"{side}_net.bits") + F.when(F.col(f"{side}_net.family") == 4, 96).otherwise(0)
    side = F.when(F.col("src_net").isNotNull() & (F.col("dst_net").isNull() | (wide("src") >= wide("dst"))), "src").when(F.col("dst_net").isNotNull(), "dst").otherwise("")
    live = live.withColumn("side", side)
    held = F.when(F.col("side") == "src", F.col("src_net")).when(F.col("side") == "dst", F.col("dst_net"))
    other = F.when(F.col("side") == "src", F.col("dst_net")).when(F.col("side") == "dst", F.col("src_net"))
    return live.withColumns({"_held": held, "rest_net": other}).select(
        F.struct("created_at", "rule_id").alias("rule"), "side", F.coalesce("_held.family", F.lit(0)).alias("family"), F.coalesce("_held.bits", F.lit(0)).alias("bits"),
        F.col("rule_dst_port").isNotNull().alias("by_port"), F.col("rule_threat_type").isNotNull().alias("by_threat"),
        F.coalesce("_held.p1", F.lit(0).cast("long")).alias("p1"), F.coalesce("_held.p2", F.lit(0).cast("long")).alias("p2"), F.coalesce(F.col("rule_dst_port").cast("long"), F.lit(-1)).alias("port"), F.coalesce("rule_threat_type", F.lit("")).alias("threat"),
        "rest_net", F.col("rule_sni_pattern").alias("pattern"),
    )


SHAPE, KEY = ("side", "family", "bits", "by_port", "by_threat"), ("p1", "p2", "port", "threat")


def _small(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules) if rules.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES else rules


def _by_key(narrow: DataFrame, keyed: DataFrame) -> DataFrame | None:
    """(_id, rule) of the rules that are found by a key."""
    shapes = keyed.select(*SHAPE).distinct().collect()
    if not shapes:
        return None
    # Of rules that their key says whole, the first one is enough.
    whole = F.col("rest_net").isNull() & F.col("pattern").isNull()
    found = keyed.where(whole).groupBy(*SHAPE, *KEY).agg(F.min("rule").alias("rule")).withColumn("rest_net", F.lit(None).cast(keyed.schema["rest_net"].dataType)).withColumn("pattern", F.lit(None).cast("string"))
    found = found.unionByName(keyed.where(~whole).select(*found.columns))
    every = F.array(*[F.struct(*[F.lit(s[c]).alias(c) for c in SHAPE]) for s in shapes])

    def key(s: Column) -> Column:
        a = F.when(s["side"] == "src", F.col("src")).when(s["side"] == "dst", F.col("dst"))
        p1, p2 = net.prefix(a, s["bits"])
        fits = (s["side"] == "") | (a["family"] == s["family"])
        zero = F.lit(0).cast("long")
        parts = F.struct(*[s[c].alias(c) for c in SHAPE], F.when(s["side"] == "", zero).otherwise(p1).alias("p1"), F.when(s["side"] == "", zero).otherwise(p2).alias("p2"), F.when(s["by_port"], F.col("port").cast("long")).otherwise(-1).alias("port"), F.when(s["by_threat"], F.col("threat")).otherwise("").alias("threat"))
        return F.when(fits, parts)

    keys = narrow.select("_id", F.col("src").alias("_src"), F.col("dst").alias("_dst"), "sni", F.explode(F.array_compact(F.transform(every, key))).alias("k"))
    keys = keys.select("_id", "_src", "_dst", "sni", "k.*")
    hits = keys.join(_small(found), [*SHAPE, *KEY])
    rest = F.col("rest_net").isNull() | net.is_within(F.when(F.col("side") == "src", F.col("_dst")).otherwise(F.col("_src")), F.col("rest_net"))
    return hits.where(rest & (F.col("pattern").isNull() | F.rlike("sni", F.col("pattern")))).select("_id", "rule")


def _grams(c: Column) -> Column:
    """The distinct runs of three characters of a text."""
    n = F.char_length(c)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _by_pattern(narrow: DataFrame, patterns: DataFrame) -> DataFrame:
    """(_id, rule) of rules (pattern, rule) that name nothing but a pattern."""
    parts = F.transform(F.split(F.regexp_replace("pattern", r"^\^|\$$", ""), r"\.\*"), lambda x: F.replace(x, F.lit("\\."), F.lit(".")))
    longest = F.element_at(F.array_sort(F.transform(parts, lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x")))), -1)["x"]
    patterns = patterns.groupBy("pattern").agg(F.min("rule").alias("rule"))
    patterns = patterns.withColumn("grams", F.when(F.rlike("pattern", F.lit(PLAIN)), _grams(longest)).otherwise(F.array().cast("array<string>")))
    names = narrow.select("sni").distinct()
    each = patterns.select("pattern", "rule", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = each.join(often, "gram").groupBy("pattern").agg(F.min(F.struct("n", "gram")).alias("g"), F.min("rule").alias("rule")).select("pattern", "rule", F.col("g.gram").alias("gram"))
    found = names.select("sni", F.explode(_grams(F.col("sni"))).alias("gram")).join(_small(rarest), "gram").where(F.rlike("sni", F.col("pattern"))).select("sni", "rule")
    loose = patterns.where(F.size("grams") == 0)
    if n := loose.count():
        blocks = -(-n // BLOCK)
        dealt = loose.groupBy(F.pmod(F.xxhash64("pattern"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("rule", "pattern")).alias("rules"))
        met = names.select("sni", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")).join(dealt, "block")
        met = met.select("sni", F.array_min(F.transform(F.filter("rules", lambda r: F.rlike(F.col("sni"), r["pattern"])), lambda r: r["rule"])).alias("rule"))
        found = found.unionByName(met.where("rule is not null"))
    found = found.groupBy("sni").agg(F.min("rule").alias("rule"))
    return narrow.select("_id", "sni").join(found, "sni").select("_id", "rule")


def suppress(alerts: DataFrame, rules: DataFrame, key: list[str], as_of: Column | None = None) -> DataFrame:
    """``alerts`` plus rule_id of the first rule that matches, else null. ``key`` identifies an alert."""
    keyed = _keyed(prepared(rules, as_of))
    ip = lambda c: net.address(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("0.0.0.0")))
    sni = F.coalesce(F.col("sni"), F.lit("")) if "sni" in alerts.columns else F.lit("")
    narrow = alerts.select(F.struct(*key).alias("_id"), ip("src_ip").alias("src"), ip("dst_ip").alias("dst"), F.col("dst_port").alias("port"), F.col("threat_type").alias("threat"), sni.alias("sni"))
    bare = (F.col("side") == "") & ~F.col("by_port") & ~F.col("by_threat")
    known = keyed.agg(F.min(F.when(bare & F.col("pattern").isNull(), F.col("rule"))).alias("always"), F.count_if(bare & F.col("pattern").isNotNull()).alias("patterns")).first()
    always = known["always"]
    found = [h for h in (_by_key(narrow, keyed.where(~bare)),) if h is not None]
    if known["patterns"]:
        found.append(_by_pattern(narrow, keyed.where(bare & F.col("pattern").isNotNull()).select("pattern", "rule")))
    first = F.lit(None).cast(keyed.schema["rule"].dataType)
    if always is not None:
        first = F.struct(F.lit(always["created_at"]).cast(keyed.schema["rule"].dataType["created_at"].dataType).alias("created_at"), F.lit(always["rule_id"]).cast(keyed.schema["rule"].dataType["rule_id"].dataType).alias("rule_id"))
    if not found:
        return alerts.withColumn("rule_id", first["rule_id"])
    hits = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    hits = hits.groupBy("_id").agg(F.min("rule").alias("_rule"))
    joined = alerts.withColumn("_key", F.struct(*key)).join(hits, F.col("_key").eqNullSafe(F.col("_id")), "left")
    best = F.array_min(F.array_compact(F.array(F.col("_rule"), first)))
    return joined.withColumn("rule_id", best["rule_id"]).select(*alerts.columns, "rule_id")


def status_after(alerts: DataFrame, rules: DataFrame, key: list[str], status: str = "analyst_status", as_of: Column | None = None) -> DataFrame:
    """Retroactive suppression: the status of alerts that a rule matches becomes suppressed."""
    found = suppress(alerts, rules, key, as_of)
    return found.withColumn(status, F.when(F.col("rule_id").isNotNull(), "suppressed").otherwise(F.col(status))).drop("rule_id")
