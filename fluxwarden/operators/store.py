"""Stored tables and the analyst's queries: functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import state

#: Severities of the common event format; others count as info.
SEVERITY_LEVELS = {"info": 1, "low": 3, "medium": 5, "high": 8, "critical": 10}


def list_alerts(alerts: DataFrame, flows: DataFrame, severity: str | None = None, threat_type: str | None = None, src_like: str | None = None, min_confidence: float | None = None, status: str | None = None, alert_id: str | None = None) -> DataFrame:
    """Alerts with their flows, narrowed by the filters that are given."""
    if alert_id is not None:
        alerts = alerts.where(F.col("alert_id") == alert_id)
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    if threat_type:
        alerts = alerts.where(F.col("threat_type") == threat_type)
    if min_confidence is not None:
        alerts = alerts.where(F.col("confidence") >= min_confidence)
    if status:
        alerts = alerts.where(F.col("analyst_status") == status)
    if src_like:
        flows = flows.where(F.contains("src_ip", F.lit(src_like)))
    return alerts.join(flows, "flow_id")


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def alert_flow(alerts: DataFrame, flows: DataFrame) -> DataFrame:
    return alerts.join(flows, "flow_id", "left")


def feedback(flows: DataFrame, reviews: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Flows that were labelled in the last days, newest review first."""
    recent = reviews.where(F.col("label").isNotNull() & (F.col("reviewed_at") > as_of - F.make_dt_interval(F.lit(days))))
    return flows.join(recent, "flow_id").orderBy(F.desc("reviewed_at"), "flow_id")


def only_alerted(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    return flows.join(alerts, "flow_id", "left_semi")


def insert_absent(new: DataFrame, stored: DataFrame, key: str, order: list) -> DataFrame:
    """Rows to append: those whose key isn't stored yet, the first of each key."""
    from pyspark.sql.window import Window

    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.join(stored.select(key), key, "left_anti").withColumn("_rn", first).where("_rn = 1").drop("_rn")


def false_positive_rate(alerts: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    recent = alerts.where(F.col("ts") >= as_of - F.make_dt_interval(F.lit(days)))
    out = recent.groupBy("threat_type").agg(F.count("*").alias("total"), F.count_if(F.col("analyst_status") == "false_positive").alias("false_positives"))
    return out.withColumn("rate", F.round(F.col("false_positives") / F.col("total") * 100, 2))


def status_counts(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("analyst_status").isNotNull()).groupBy("analyst_status").agg(F.count("*").alias("n"))


def dead_sensors(heartbeats: DataFrame, as_of: Column, timeout_s: int = 60) -> DataFrame:
    """Latest state of each sensor that has been silent for longer than the timeout."""
    last = heartbeats.groupBy("sensor_id").agg(F.max("last_seen").alias("last_seen"), F.max_by("packet_loss", "last_seen").alias("packet_loss"))
    return last.where(F.col("last_seen") < as_of - F.make_dt_interval(secs=F.lit(timeout_s).cast("decimal(18,6)")))


def with_expiry(responses: DataFrame, hours: int = 24) -> DataFrame:
    return responses.withColumn("expires_at", F.col("created_at") + F.make_dt_interval(hours=F.lit(hours)))


def next_status(status: Column, event: Column) -> Column:
    """pending -> approved -> executed or failed; anything else stays."""
    return F.when((status == "pending") & (event == "approve"), "approved").when(status.isin("pending", "approved") & (event == "execute"), "executed").when(status.isin("pending", "approved") & (event == "fail"), "failed").otherwise(status)


def merge_max(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the larger of two aggregates."""
    right = b.select(F.col(key), F.col(value).alias("_other"))
    return a.select(key, value).join(right, key, "full").select(key, F.greatest(value, "_other").alias(value))


def _text(alerts: DataFrame, name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in alerts.columns else F.lit(default)


def cef_line(alerts: DataFrame, vendor: str = "fluxwarden", product: str = "flows") -> DataFrame:
    """A syslog line (local facility 0, warning) of the common event format per alert."""
    level = F.lit(SEVERITY_LEVELS["info"])
    for name, n in SEVERITY_LEVELS.items():
        level = F.when(F.col("severity") == name, n).otherwise(level)
    kind = _text(alerts, "threat_type")
    line = F.format_string(
        f"<132> CEF:0|{vendor}|{product}|1.0|%s|%s Detected|%d|src=%s dst=%s dpt=%s msg=%s", kind, kind, level,
        _text(alerts, "src_ip"), _text(alerts, "dst_ip"), _text(alerts, "dst_port", "0"), _text(alerts, "explanation"),
    )
    return alerts.select("flow_id", line.alias("line"))


SUB_SCORES = ("beacon_prob", "dns_tunnel_prob", "exfil_score")


def save_alert(alerts: DataFrame) -> DataFrame:
    """Alerts as rows of the stored table: an id from what identifies the alert, sub-scores as columns of their own, contributions as JSON."""
    have = set(alerts.columns)
    score = lambda k: (F.try_element_at("sub_scores", F.lit(k)) if "sub_scores" in have else F.lit(None)).cast("double").alias(k)
    own = lambda c, kind, default: (F.coalesce(F.col(c), default) if c in have else default).cast(kind).alias(c)
    key = F.concat_ws("|", F.col("flow_id").cast("string"), F.col("ts").cast("string"), "threat_type", own("kind", "string", F.lit("")))
    return alerts.select(
        F.md5(key).alias("alert_id"), "flow_id", "ts", "threat_type", "severity", "confidence", *[score(k) for k in SUB_SCORES],
        (F.coalesce(F.to_json("shap_values"), F.lit("{}")) if "shap_values" in have else F.lit("{}")).alias("shap_values"),
        own("explanation", "string", F.lit(None)), own("mitre_ttps", "array<string>", F.array().cast("array<string>")), F.lit("unreviewed").alias("analyst_status"),
    )


def append(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Adds rows to a stored table. ``kind`` is parquet, json (a line each, without nulls) or csv (with a header, nulls as 0)."""
    if kind == "csv":
        df = df.fillna(0)
    writer = df.write.mode("append")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def reset(df: DataFrame, path: str) -> None:
    """Empties a stored table of ``df``'s schema."""
    df.limit(0).write.mode("overwrite").parquet(path)


def alert_json(alerts: DataFrame) -> DataFrame:
    """An alert as JSON without its nulls."""
    return alerts.select("flow_id", F.to_json(F.struct(*alerts.columns)).alias("json"))


def feed_json(alerts: DataFrame) -> DataFrame:
    """The message that live viewers get of an alert, with a value for all that may be missing."""
    have = set(alerts.columns)
    first = lambda *cs: [F.col(c) for c in cs if c in have]
    fields = F.struct(
        *[F.col(c).cast("string").alias(c) for c in ("alert_id",) if c in have], F.col("flow_id"), state.seconds(F.col("ts")).alias("timestamp"), "threat_type",
        F.coalesce(*first("severity", "alert_severity"), F.lit("medium")).alias("alert_severity"), F.coalesce(*first("confidence"), F.lit(0.5)).cast("double").alias("confidence"),
        _text(alerts, "src_ip", "0.0.0.0").alias("src"), _text(alerts, "dst_ip", "0.0.0.0").alias("dst"), F.coalesce(*first("dst_port"), F.lit(0)).cast("int").alias("dport"),
        _text(alerts, "sni").alias("sni"), _text(alerts, "explanation").alias("explanation"), F.coalesce(*first("mitre_ttps"), F.array().cast("array<string>")).alias("mitre_ttps"), F.lit("unreviewed").alias("analyst_status"),
    )
    return alerts.select("flow_id", F.to_json(fields).alias("json"))


def topic_rows(alerts: DataFrame, topic: str = "alerts:feed") -> DataFrame:
    """Messages of alerts as a topic sink takes them: topic, key (the source, so that its alerts stay in order) and value. A broker may
    not allow the usual name's colon: give another then."""
    keyed = alerts.select("flow_id", _text(alerts, "src_ip", "0.0.0.0").alias("key")).distinct()
    return feed_json(alerts).join(keyed, "flow_id").select(F.lit(topic).alias("topic"), "key", F.col("json").alias("value"))


def tag_list(text: Column) -> Column:
    """A list of strings from JSON or from a list written with single quotes; a plain word is a list of itself, nothing is an empty one."""
    trimmed = F.trim(text)
    inside = F.filter(F.transform(F.split(F.regexp_replace(trimmed, r"^\[|\]$", ""), ","), lambda x: F.regexp_replace(F.trim(x), "^['\"]|['\"]$", "")), lambda x: x != "")
    return F.coalesce(F.when(trimmed.startswith("["), F.coalesce(F.from_json(trimmed, "array<string>"), inside)).when(trimmed != "", F.array(trimmed)), F.array().cast("array<string>"))


def api_alerts(alerts: DataFrame) -> DataFrame:
    """Stored alerts (joined with their flows) as the interface returns them: ids as text, times as epoch seconds, addresses and port never missing."""
    have = set(alerts.columns)
    return alerts.select(
        F.col("alert_id").cast("string").alias("alert_id"), F.col("flow_id").cast("string").alias("flow_id"), state.seconds(F.col("ts")).alias("timestamp"), "threat_type", F.col("severity").alias("alert_severity"), "confidence",
        _text(alerts, "src_ip", "0.0.0.0").alias("src"), _text(alerts, "dst_ip", "0.0.0.0").alias("dst"), F.coalesce(F.col("dst_port"), F.lit(0)).cast("int").alias("dport"),
        *[F.col(c) for c in ("sni",) if c in have], _text(alerts, "explanation").alias("explanation"), "mitre_ttps", _text(alerts, "analyst_status", "unreviewed").alias("analyst_status"),
    )


def enriched(alerts: DataFrame, intelligence: Column) -> DataFrame:
    """What is known of the other side goes to the explanation of alerts that aren't suppressed."""
    text = F.coalesce("explanation", F.lit(""))
    return alerts.withColumn("explanation", F.when(F.coalesce(F.col("analyst_status") == "suppressed", F.lit(False)), F.col("explanation")).otherwise(F.concat(text, F.lit(" | TI: "), F.coalesce(intelligence, F.lit("unknown")))))


def flow_detail(flows: DataFrame, alerts: DataFrame, packets: DataFrame, flow_id, most: int = 100) -> DataFrame:
    """A flow with its latest alert, if any, and its first ``most`` packets in order."""
    one = flows.where(F.col("flow_id") == flow_id)
    alert = alerts.where(F.col("flow_id") == flow_id).groupBy("flow_id").agg(F.max_by(F.struct("threat_type", "severity", "confidence"), F.struct("ts", "threat_type")).alias("prediction"))
    first = packets.where(F.col("flow_id") == flow_id).orderBy("ts", "packet_id").limit(most)
    line = first.groupBy("flow_id").agg(F.sort_array(F.collect_list(F.struct("ts", "packet_id", "size"))).alias("packet_timeline"))
    return one.join(alert, "flow_id", "left").join(line, "flow_id", "left").withColumn("packet_timeline", F.coalesce("packet_timeline", F.array().cast("array<struct<ts:timestamp_ntz,packet_id:bigint,size:double>>")))


def snapshot(flows: DataFrame, alerts: DataFrame, kinds: tuple[str, ...] = ("c2_beacon", "dns_tunnel", "exfiltration", "lateral_movement")) -> DataFrame:
    """One row of counters: all flows, alerts of each kind (0 where there are none), and flows per second between the first and last."""
    span = state.seconds(F.max("ts")) - state.seconds(F.min("ts"))
    f = flows.agg(F.count("*").alias("total_flows"), F.coalesce(F.round(F.count("*") / F.greatest(span, F.lit(1.0)), 1), F.lit(0.0)).alias("flows_per_sec"), F.coalesce(F.floor(span), F.lit(0)).alias("uptime_s"))
    a = alerts.agg(F.count("*").alias("total_alerts"), *[F.count_if(F.col("threat_type") == k).alias(k) for k in kinds])
    return f.crossJoin(a)  # a row each


def lossy_sensors(heartbeats: DataFrame, most: float = 5.0) -> DataFrame:
    """Heartbeats of sensors that lose more than ``most`` percent of their packets."""
    return heartbeats.where(F.col("packet_loss") > most)


def merged(stored: DataFrame, new: DataFrame, key: list[str] | None = None, newest: Column | None = None) -> DataFrame:
    """Stored and new rows; with a key, the newest of each by ``newest``, new ones before stored ones where that is equal."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    if not key:
        return both.drop("_new")
    rest = [c for c in both.columns if c not in (*key, "_new")]
    best = F.max_by(F.struct(*rest), F.struct((newest if newest is not None else F.lit(0)).alias("n"), F.col("_new"))).alias("_row")
    return both.groupBy(*key).agg(best).select(*key, "_row.*")


def node_degrees(edges: DataFrame, src: str, dst: str, weight: str) -> DataFrame:
    """Per node: flows out and in, distinct neighbours and of these those called and calling, bytes; burst is called ones for each flow out, spread the same
    with 1 at most."""
    out = edges.groupBy(F.col(src).alias("node")).agg(F.count("*").alias("out_degree"), F.sum(weight).alias("out_bytes"))
    into = edges.groupBy(F.col(dst).alias("node")).agg(F.count("*").alias("in_degree"), F.sum(weight).alias("in_bytes"))
    pairs = edges.select(F.col(src).alias("node"), F.col(dst).alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select(dst, src, F.lit(0), F.lit(1)))
    near = pairs.groupBy("node", "other").agg(F.max("o").alias("o"), F.max("i").alias("i")).groupBy("node").agg(F.count("*").alias("neighbours"), F.sum("o").alias("unique_dsts"), F.sum("i").alias("unique_srcs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    n = near.join(out, "node", "left").join(into, "node", "left").select("node", "neighbours", "unique_dsts", "unique_srcs", *[zero(c) for c in ("out_degree", "in_degree", "out_bytes", "in_bytes")])
    return n.withColumn("burst", F.col("unique_dsts") / (F.col("out_degree") + 1)).withColumn("spread", F.least(F.lit(1.0), F.col("unique_dsts") / F.greatest("out_degree", F.lit(1))))


def with_default(df: DataFrame, known: DataFrame, key: str, value: str, default) -> DataFrame:
    """``df`` plus the value that a table has for its key, else the default. The table has a row per key."""
    return df.join(known.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def cached_join(left: DataFrame, right: DataFrame, key: str, ts: str = "ts", ttl_s: int = 300) -> DataFrame:
    """Each left row with the newest right row of its key that was stored at most ``ttl_s`` seconds before it (null columns where there is none): what a
    cache with a time to live would have held. Both sides are ordered together, so a key's rows are never paired with each other."""
    from pyspark.sql.window import Window

    kept = [c for c in right.columns if c not in (key, ts)]
    a = left.select(key, F.col(ts).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(ts, *kept).alias("x")).schema["x"].dataType).alias("_right"))
    b = right.select(key, F.col(ts).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(ts, *kept).alias("_right"))
    w = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    fresh = state.seconds(F.col("_at")) - state.seconds(F.col("_last")[ts]) <= ttl_s
    return d.select("_left.*", *[F.when(fresh, F.col("_last")[c]).alias(c) for c in kept])


def progress(df: DataFrame, dataset: str, expected: dict[str, int]) -> DataFrame:
    """dataset, rows, percent of the expected rows that have been seen, 100 at most; null where nothing is expected."""
    target = F.lit(None).cast("long")
    for name, n in expected.items():
        target = F.when(F.col(dataset) == name, F.lit(n)).otherwise(target)
    g = df.groupBy(F.col(dataset).alias("dataset")).agg(F.count("*").alias("rows"), F.first(target).alias("_t"))
    return g.select("dataset", "rows", F.when(F.col("_t") > 0, F.least(F.lit(100.0), F.try_divide(F.col("rows") * 100.0, F.col("_t")))).alias("percent"))
