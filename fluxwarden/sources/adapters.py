"""Adapters from public flow-dataset layouts to one feature row, and label mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import strings
from .schema import conform

#: The names of the feature row.
FEATURES = [
    "duration_s", "iat_mean_ms", "iat_std_ms", "iat_cv", "iat_min_ms", "iat_max_ms", "iat_median_ms",
    "pkt_size_mean", "pkt_size_std", "pkt_size_min", "pkt_size_max", "pkt_size_entropy", "small_pkt_ratio", "large_pkt_ratio",
    "total_bytes", "orig_bytes", "resp_bytes", "bytes_ratio", "orig_pkts", "resp_pkts", "pkt_ratio",
    "periodicity_score", "dominant_period_ms", "iat_skewness", "iat_kurtosis", "sni_entropy", "sni_len", "tls_resumed",
    "ja3_malware_score", "ja4_malware_score", "cert_validity_days", "cert_self_signed",
    "dns_query_len", "dns_label_count", "dns_max_label_len", "dns_unique_chars", "dns_shannon_entropy", "dns_bigram_entropy",
    "dns_vowel_ratio", "dns_digit_ratio", "dns_hyphen_ratio", "dns_is_ip_encoded", "dns_consecutive_digits", "dns_longest_run",
    "connection_count_1m", "connection_count_5m", "failed_connection_ratio",
]


def _number(df: DataFrame, name: str, divisor: float = 1.0) -> Column:
    have = {c.strip(): c for c in df.columns}
    return F.col(f"`{have[name]}`").cast("string").try_cast("double") / divisor if name in have else F.lit(None).cast("double")


def _out(df: DataFrame, cols: dict[str, Column], label: str = "label") -> DataFrame:
    own = df.select(*[c.alias(n) for n, c in cols.items()], (F.col(label) if label in df.columns else F.lit(0)).cast("int").alias("_label"))
    full = own.select(*own.columns)
    missing = [F.lit(None).cast("double").alias(f) for f in FEATURES if f not in cols]
    return full.select("*", *missing).select(*[F.col(f).cast("double").alias(f) for f in FEATURES], F.col("_label").alias("label"))


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("double")


def cicids(df: DataFrame) -> DataFrame:
    """Flow meter CSV: microseconds become seconds or milliseconds; packet extremes become flags."""
    n = lambda c, d=1.0: _number(df, c, d)
    fwd, bwd = n("Total Fwd Packets"), n("Total Backward Packets")
    orig, resp, pkts = n("Total Length of Fwd Packets"), n("Total Length of Bwd Packets"), F.coalesce(fwd, F.lit(0.0)) + F.coalesce(bwd, F.lit(0.0))
    mean, std = n("Fwd IAT Mean", 1000), n("Fwd IAT Std", 1000)
    return _out(df, {
        "duration_s": n("Flow Duration", 1e6), "iat_mean_ms": mean, "iat_std_ms": std, "iat_min_ms": n("Fwd IAT Min", 1000), "iat_max_ms": n("Fwd IAT Max", 1000),
        "pkt_size_mean": n("Fwd Packet Length Mean"), "pkt_size_std": n("Fwd Packet Length Std"), "pkt_size_min": n("Fwd Packet Length Min"), "pkt_size_max": n("Fwd Packet Length Max"),
        "orig_bytes": orig, "resp_bytes": resp, "orig_pkts": pkts, "resp_pkts": bwd, "failed_connection_ratio": n("RST Flag Count"),
        "total_bytes": F.coalesce(orig, F.lit(0.0)) + F.coalesce(resp, F.lit(0.0)), "bytes_ratio": orig / (resp + 1), "pkt_ratio": pkts / (bwd + 1), "iat_cv": std / (F.abs(mean) + 1e-9),
        "small_pkt_ratio": _flag(n("Fwd Packet Length Min") < 100), "large_pkt_ratio": _flag(n("Fwd Packet Length Max") > 1400),
    })


def binetflow(df: DataFrame) -> DataFrame:
    total, src = _number(df, "TotBytes"), _number(df, "SrcBytes")
    resp = total - F.coalesce(src, F.lit(0.0))
    return _out(df, {"duration_s": _number(df, "Dur"), "total_bytes": total, "orig_bytes": src, "orig_pkts": _number(df, "TotPkts"), "resp_bytes": resp, "bytes_ratio": src / (resp + 1)})


def unsw(df: DataFrame) -> DataFrame:
    s, d = _number(df, "sbytes"), _number(df, "dbytes")
    sp, dp = _number(df, "spkts"), _number(df, "dpkts")
    pkts = F.coalesce(sp, F.lit(0.0)) + F.coalesce(dp, F.lit(0.0))
    return _out(df, {"duration_s": _number(df, "dur"), "orig_bytes": s, "resp_bytes": d, "orig_pkts": pkts, "resp_pkts": dp, "pkt_size_mean": _number(df, "smeansz"), "total_bytes": F.coalesce(s, F.lit(0.0)) + F.coalesce(d, F.lit(0.0)), "bytes_ratio": s / (d + 1), "pkt_ratio": pkts / (dp + 1)})


def kdd(df: DataFrame) -> DataFrame:
    s, d = _number(df, "src_bytes"), _number(df, "dst_bytes")
    return _out(df, {"duration_s": _number(df, "duration"), "orig_bytes": s, "resp_bytes": d, "bytes_ratio": s / (d + 1), "connection_count_1m": _number(df, "count"), "failed_connection_ratio": _number(df, "serror_rate")})


def dns_only(df: DataFrame, query: str = "query") -> DataFrame:
    f = strings.dns_features(F.col(query))
    return _out(df, {k: v.cast("double") for k, v in f.items() if k in FEATURES})


def generic(df: DataFrame) -> DataFrame:
    return _out(df, {})


def adapt(df: DataFrame, dataset: str) -> DataFrame:
    """The adapter whose name the dataset key holds; conformed tables pass."""
    if set(FEATURES) <= set(df.columns):
        return conform(df, FEATURES)
    for name, f in (("cicids", cicids), ("ctu13", binetflow), ("unsw", unsw), ("dns", dns_only), ("kdd", kdd)):
        if name in dataset.lower():
            return f(df)
    return generic(df)


def map_labels(df: DataFrame, column: str, mapping: dict[str, int], out: str = "label") -> DataFrame:
    """Trimmed labels as numbers; rows with unknown or negative ones go."""
    value = F.lit(None).cast("int")
    for k, v in mapping.items():
        value = F.when(F.trim(F.col(column)) == k, v).otherwise(value)
    return df.withColumn(out, value).where(F.col(out) >= 0)


def label_by_patterns(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """The first pattern that the lower-case text contains, else 0."""
    value = F.lit(0)
    for p, v in reversed(patterns):
        value = F.when(F.contains(F.lower(text), F.lit(p)), v).otherwise(value)
    return value


#: Columns of the flow meter, of connection logs, and labels as the second family of adapters names them.
FLOW_METER = {
    "Flow Duration": "duration_s", "Fwd IAT Mean": "iat_mean_ms", "Fwd IAT Std": "iat_std_ms", "Fwd IAT Min": "iat_min_ms", "Fwd IAT Max": "iat_max_ms", "Fwd Packet Length Mean": "pkt_size_mean",
    "Fwd Packet Length Std": "pkt_size_std", "Fwd Packet Length Min": "pkt_size_min", "Fwd Packet Length Max": "pkt_size_max", "Total Length of Fwd Packets": "orig_bytes", "Total Length of Bwd Packets": "resp_bytes",
    "Total Fwd Packets": "orig_pkts", "Total Backward Packets": "resp_pkts", "Flow Bytes/s": "bytes_per_sec", "Flow Packets/s": "pkts_per_sec",
}
CONNECTION_LOG = {"duration": "duration_s", "orig_bytes": "orig_bytes", "resp_bytes": "resp_bytes", "orig_pkts": "orig_pkts", "resp_pkts": "resp_pkts", "id.resp_p": "dport"}
FLOW_METER_LABELS = {"BENIGN": 0, "Bot": 1, "Infiltration": 3, "PortScan": 2}
CONNECTION_LABELS = {"Botnet": 1, "Normal": 0, "Background": 0}


def _labelled(df: DataFrame, column: str, mapping: dict[str, int]) -> Column:
    value = F.lit(None).cast("int")
    for k, v in mapping.items():
        value = F.when(F.col(f"`{column}`") == k, v).otherwise(value)
    return value


def _sourced(df: DataFrame, name: str, tls: bool, dns: bool, timing: bool) -> DataFrame:
    return df.withColumns({"dataset_source": F.lit(name), "has_tls_features": F.lit(tls), "has_dns_features": F.lit(dns), "has_timing_features": F.lit(timing)})


def flow_meter(df: DataFrame) -> DataFrame:
    """Flow meter CSV by its column names: what a table lacks is missing, not zero; rows whose label is none of the known ones go."""
    n = lambda c: F.expr(f"`{c}`").try_cast("double") if c in df.columns else F.lit(None).cast("double")
    scale = {"duration_s": 1e6, "iat_mean_ms": 1000.0, "iat_std_ms": 1000.0}
    cols = {ours: n(theirs) / F.lit(scale.get(ours, 1.0)) for theirs, ours in FLOW_METER.items()}
    label = next((c for c in ("Label", " Label") if c in df.columns), None)
    out = df.select(*[c.alias(k) for k, c in cols.items()], *([_labelled(df, label, FLOW_METER_LABELS).alias("label")] if label else []))
    out = out.withColumns({"total_bytes": F.col("orig_bytes") + F.col("resp_bytes"), "bytes_ratio": F.col("orig_bytes") / (F.col("resp_bytes") + 1), "pkt_ratio": F.col("orig_pkts") / (F.col("resp_pkts") + 1), "iat_cv": F.col("iat_std_ms") / (F.col("iat_mean_ms") + F.lit(1e-9))})
    return _sourced(out.where("label is not null") if label else out, "CICIDS", False, False, True)


def connection_log(df: DataFrame) -> DataFrame:
    """Connection logs: the columns that are there, totals, and labels of the botnet set (others are missing)."""
    have = {theirs: ours for theirs, ours in CONNECTION_LOG.items() if theirs in df.columns}
    size = lambda c: F.expr(f"`{c}`").try_cast("double") if c in df.columns else F.lit(0.0)
    out = df.select(
        *[F.expr(f"`{theirs}`").try_cast("double").alias(ours) for theirs, ours in have.items()], (size("orig_bytes") + size("resp_bytes")).alias("total_bytes"),
        (size("orig_bytes") / (size("resp_bytes") + 1)).alias("bytes_ratio"), *([_labelled(df, "label", CONNECTION_LABELS).alias("label")] if "label" in df.columns else []),
    )
    return _sourced(out, "CTU13", False, False, False)


def dns_exfil(df: DataFrame) -> DataFrame:
    """DNS queries with their features computed anew; a tunnel is class 2."""
    query = F.coalesce(F.col("query"), F.lit("")) if "query" in df.columns else F.lit("")
    tunnel = F.coalesce(F.col("label") == "tunnel", F.lit(False)) if "label" in df.columns else F.lit(False)
    out = df.select(*[c.alias(k) for k, c in strings.dns_features(query).items()], F.when(tunnel, 2).otherwise(0).alias("label"))
    return _sourced(out, "dns_exfil", False, True, False)


#: The features that hold across families of malware, in the order that the linear model takes them.
INVARIANT = ("duration_s", "total_bytes", "orig_bytes", "orig_pkts", "resp_bytes", "bytes_ratio")
#: Columns that tell where a row comes from, not what it is.
ORIGIN = ("flow_id", "label", "timestamp", "dataset_source", "has_tls_features", "has_dns_features", "has_timing_features")


def invariant(df: DataFrame) -> DataFrame:
    """The six invariant features of an adapted table, and its label."""
    return df.select(*INVARIANT, *[c for c in ("label",) if c in df.columns])


def learnable(columns: list[str]) -> list[str]:
    """Feature columns without those that would give the answer away."""
    return [c for c in columns if c not in ORIGIN]


def with_origin(df: DataFrame, dataset: str, raw_columns: list[str]) -> DataFrame:
    """An adapted table plus its dataset and which kinds of feature its raw columns allow."""
    have = " ".join(raw_columns).lower()
    flag = lambda *words: F.lit(any(w in have for w in words))
    return df.withColumns({"dataset_source": F.lit(dataset), "has_tls_features": flag("ja3", "tls", "cert", "sni"), "has_dns_features": flag("query", "dns", "domain"), "has_timing_features": flag("iat", "dur")})


def unsw_strict(df: DataFrame, bad: tuple[str, ...] = ("Backdoors", "Backdoor", "Worms")) -> DataFrame:
    """Backdoors and worms against normal traffic; other attacks go. Adds y_true."""
    hit = F.coalesce(F.col("attack_cat").isin(*bad), F.lit(False))
    keep = hit | F.coalesce(F.col("attack_cat") == "Normal", F.lit(False)) | F.coalesce(F.col("label") == 0, F.lit(False))
    return df.where(keep).withColumn("y_true", hit.cast("int"))


def binary_subset(df: DataFrame, positive: int, label: str = "label") -> DataFrame:
    """Rows of class 0 and of one other, which becomes 1."""
    return df.where(F.col(label).isin(0, positive)).withColumn(label, (F.col(label) == positive).cast("int"))


def sampled_by_class(df: DataFrame, text: str, key: str, word: str = "botnet", keep: tuple[float, float] = (0.02, 0.05), most: int | None = None) -> DataFrame:
    """Adds label (1 where the text holds the word) and keeps a share of each class, by the hash of the key: the same rows however they are dealt.
    ``most`` reads so many rows by key first; it is a limit that the caller asks for."""
    if most is not None:
        df = df.orderBy(key).limit(most)
    d = df.withColumn("label", F.coalesce(F.contains(F.lower(F.col(text)), F.lit(word)), F.lit(False)).cast("int"))
    share = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return d.where(share < F.when(d["label"] == 1, keep[1]).otherwise(keep[0]))


def certificate(not_before: Column, not_after: Column, subject: Column, issuer: Column) -> Column:
    """struct(cert_validity_days, cert_self_signed) of a parsed certificate: whole days, and whether it names itself as its issuer."""
    days = F.floor((F.unix_micros(not_after.cast("timestamp")) - F.unix_micros(not_before.cast("timestamp"))) / F.lit(86_400_000_000)).cast("double")
    return F.struct(days.alias("cert_validity_days"), F.coalesce(subject == issuer, F.lit(False)).alias("cert_self_signed"))


#: Client fingerprints that count as malware when an analyst looks at a stored flow, and what is filled in where a flow doesn't keep it.
REVIEWED_FINGERPRINTS = ("e7d705a3286e19ea42f587b344ee6865", "b386946a5a44d1ddcc843bc75336dfce")
FILLERS = {"pkt_size_std": 0.0, "large_pkt_ratio": 0.1, "tls_resumed": 0.0, "connection_count_1m": 1.0, "connection_count_5m": 5.0}


def reviewed_status(verdict: Column) -> Column:
    return F.when(verdict == "true_positive", "confirmed_tp").when(verdict == "false_positive", "false_positive").otherwise("unreviewed")


def reconstructed(flows: DataFrame) -> DataFrame:
    """flow_id and a feature row estimated from what a stored flow keeps: packets from bytes, spread from mean and variation."""
    have = set(flows.columns)
    n = lambda c, d=0.0: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(d)) if c in have else F.lit(d)
    orig, resp, duration = n("orig_bytes"), n("resp_bytes"), F.greatest(F.lit(0.001), n("duration_s", 1.0))
    pkts = lambda b: F.greatest(F.lit(1.0), F.floor(b / 1000).cast("double"))
    total, every = orig + resp, pkts(orig) + pkts(resp)
    sni = F.coalesce(F.col("sni"), F.lit("")) if "sni" in have else F.lit("")
    cols = {
        "duration_s": n("duration_s", 1.0), "total_bytes": total, "orig_bytes": orig, "resp_bytes": resp, "orig_pkts": pkts(orig), "bytes_ratio": F.coalesce(F.nullif(n("bytes_ratio"), F.lit(0.0)), orig / F.greatest(resp, F.lit(1.0))),
        "pkts_per_sec": every / duration, "bytes_per_sec": total / duration, "iat_mean_ms": n("iat_mean_ms"), "iat_std_ms": n("iat_mean_ms") * n("iat_cv"), "iat_cv": n("iat_cv"), "pkt_size_mean": total / F.greatest(F.lit(1.0), every),
        "periodicity_score": n("periodicity_score"), "dominant_period_ms": n("dominant_period_ms"), "sni_len": F.length(sni).cast("double"), "sni_entropy": strings.string_entropy(sni),
        "ja3_malware_score": F.when(F.col("ja3_hash").isin(*REVIEWED_FINGERPRINTS), 0.98).otherwise(0.0) if "ja3_hash" in have else F.lit(0.0),
    }
    return flows.select("flow_id", *[c.alias(k) for k, c in cols.items()], *[F.lit(v).alias(k) for k, v in FILLERS.items()])


def bucket_and_key(url: Column) -> Column:
    """struct(bucket, key) of an object store's URL."""
    rest = F.regexp_extract(url, "^[a-zA-Z0-9+.-]+://([^/?#]*)/*([^?#]*)", 1), F.regexp_extract(url, "^[a-zA-Z0-9+.-]+://([^/?#]*)/*([^?#]*)", 2)
    return F.struct(rest[0].alias("bucket"), rest[1].alias("key"))


def loaded(spark, paths: dict[str, str | list[str]]) -> DataFrame:
    """Several datasets as one feature table: each is read by its reader, adapted, and marked with its name."""
    from . import readers

    out = None
    for dataset, path in paths.items():
        one = adapt(readers.read(spark, dataset, path), dataset).withColumn("dataset_source", F.lit(dataset))
        out = one if out is None else out.unionByName(one)
    return out
