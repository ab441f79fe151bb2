"""Readers for the file layouts of public flow datasets, and a registry of them. A read that fails raises; nothing is simulated in
its place."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net

#: How surely a client fingerprint is one of attackers.
FINGERPRINT_SCORES = {
    "e7d705a3286e19ea42f587b344ee6865": 1.0, "6d37c8e9aa2ef8649e7f6d5e9b94f4f1": 1.0, "a0e9f5d64349fb13191bc781f81f42e1": 0.9,
    "72a589da586844d7f0818ce684948eea": 0.8, "b386946a5a44d1ddcc843bc75336dfce": 0.7,
}
BINETFLOW = "StartTime string, Dur string, Proto string, SrcAddr string, Sport string, Dir string, DstAddr string, Dport string, State string, sTos string, dTos string, TotPkts string, TotBytes string, SrcBytes string, Label string"


def csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.csv(path, header=True, mode="DROPMALFORMED")


def binetflow(spark: SparkSession, path: str | list[str]) -> DataFrame:
    d = spark.read.csv(path, header=True, schema=BINETFLOW, mode="DROPMALFORMED")
    return d.withColumns({c: F.col(c).try_cast("double") for c in ("Dur", "TotPkts", "TotBytes", "SrcBytes")})


def dns_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated log: comments go, rows have nine fields at least, the tenth is the query ('' if absent)."""
    parts = F.split("value", "\t")
    d = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.size(parts) >= 9))
    return d.select(F.coalesce(F.get(parts, F.lit(9)), F.lit("")).alias("query"))


def zeek_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A tab-separated log whose names stand in its #fields line; without one, the first line has the names. ``-`` and ``(empty)`` are
    null. Files of one path that name different fields are an error: read them one by one."""
    lines = spark.read.text(path)
    named = lines.where(F.startswith("value", F.lit("#fields\t"))).distinct().limit(2).collect()
    if not named:
        return spark.read.csv(path, sep="\t", header=True, comment="#", nullValue="-")
    if len(named) > 1:
        raise ValueError(f"files of {path} have different fields: {named[0]['value']!r} and {named[1]['value']!r}")
    names = named[0]["value"].split("\t")[1:]
    cells = lines.where(~F.startswith("value", F.lit("#")) & (F.col("value") != "")).select(F.split("value", "\t").alias("c"))
    value = lambda i: F.get("c", F.lit(i))
    return cells.select(*[F.when(~value(i).isin("-", "(empty)"), value(i)).alias(n) for i, n in enumerate(names)])


def conn_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    d = zeek_log(spark, path)
    numbers = [c for c in ("ts", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts") if c in d.columns]
    return d.withColumns({c: F.col(c).try_cast("double") for c in numbers})


def tls_log(spark: SparkSession, path: str | list[str]) -> DataFrame:
    d = zeek_log(spark, path)
    flags = [c for c in ("resumed", "established") if c in d.columns]
    return d.withColumns({c: F.col(c).isin("T", "true") for c in flags} | ({"ts": F.col("ts").try_cast("double")} if "ts" in d.columns else {}))


def labelled_files(spark: SparkSession, folder: str, labels: tuple[tuple[str, int], ...], glob: str = "*.csv") -> DataFrame:
    """The CSV files of a folder with label: the first keyword that a file's name holds decides; files with none are left out."""
    d = spark.read.csv(folder, header=True, mode="DROPMALFORMED", pathGlobFilter=glob).withColumn("_name", F.lower(F.element_at(F.split(F.input_file_name(), "/"), -1)))
    label = F.lit(None).cast("int")
    for word, value in reversed(labels):
        label = F.when(F.contains("_name", F.lit(word.lower())), value).otherwise(label)
    return d.withColumn("label", label).where("label is not null").drop("_name")


def fingerprints(spark: SparkSession, path: str | None = None) -> DataFrame:
    """ja3, score: a JSON object of fingerprints and scores, under the known ones, whose scores go first."""
    known = spark.createDataFrame(list(FINGERPRINT_SCORES.items()), "ja3 string, score double")
    if path is None:
        return known
    listed = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,double>")).alias("ja3", "score"))
    return known.unionByName(listed.join(known.select("ja3"), "ja3", "left_anti").groupBy("ja3").agg(F.max("score").alias("score")))


def without_local(flows: DataFrame, ports: tuple[int, ...] = ()) -> DataFrame:
    """Flows without those of the machine with itself and, where given, of management ports on either side."""
    local = F.coalesce(F.startswith("src_ip", F.lit("127.")), F.lit(False)) | F.coalesce(F.startswith("dst_ip", F.lit("127.")), F.lit(False))
    out = flows.where(~local)
    for c in ("src_port", "dst_port"):
        if ports and c in flows.columns:
            out = out.where(~F.coalesce(F.col(c).isin(*ports), F.lit(False)))
    return out


def dns_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    d = spark.read.csv(path, header=True, quote='"')
    return d.where(F.col("host").isNotNull() & (F.trim("host") != "") & F.contains("host", F.lit(".")))


def packets_json(spark: SparkSession, path: str | list[str]) -> DataFrame:
    from .schema import PACKET

    return spark.read.schema(PACKET).json(path)


def raw_packets(packets: DataFrame, data: str = "data", ts: str = "ts", all_ip: bool = False) -> DataFrame:
    """Ethernet frames as binary: addresses, ports, length, protocol and flags of IPv4 TCP and UDP; with ``all_ip`` of other IPv4 protocols as well, with ports 0."""
    at = lambda i, n=1: F.conv(F.hex(F.substring(F.col(data), i + 1, n)), 16, 10).cast("long")
    ihl = at(14).bitwiseAND(15) * 4
    byte = lambda off, n: F.conv(F.hex(F.substring(F.col(data), F.lit(15) + ihl.cast("int") + off, F.lit(n))), 16, 10).cast("int")
    ported = at(23).isin(6, 17)
    d = packets.where((at(12, 2) == 0x0800) & (F.lit(all_ip) | ported))
    return d.select(
        F.col(ts).cast("double").alias("ts"), net.long_to_ip(at(26, 4)).alias("src"), net.long_to_ip(at(30, 4)).alias("dst"), F.when(ported, byte(0, 2)).otherwise(0).alias("sport"), F.when(ported, byte(2, 2)).otherwise(0).alias("dport"),
        at(16, 2).cast("int").alias("len"), at(23).cast("int").alias("proto"), F.when(at(23) == 6, byte(13, 1)).otherwise(0).alias("flags"),
    )


@dataclass(frozen=True)
class Dataset:
    reader: Callable
    label: str | None = None
    labels: tuple[tuple[str, int], ...] = ()


REGISTRY = {"cicids": Dataset(csv, " Label"), "ctu13": Dataset(binetflow, "Label"), "unsw": Dataset(csv, "label"), "kdd": Dataset(csv, "labels"), "dns_log": Dataset(dns_log), "dns_csv": Dataset(dns_csv, "class"), "tls_log": Dataset(tls_log), "conn_log": Dataset(conn_log, "label")}


def read(spark: SparkSession, dataset: str, path: str | list[str]) -> DataFrame:
    for key, d in REGISTRY.items():
        if key in dataset.lower():
            return d.reader(spark, path)
    raise KeyError(f"no reader for {dataset!r}; known: {', '.join(REGISTRY)}")


def flows_of(packets: DataFrame, least: int = 3) -> DataFrame:
    """Packets to flows in both directions: the key is the sorted pair of ends; the first packet's source is the origin."""
    a, b = F.struct(F.col("src").alias("ip"), F.col("sport").alias("port")), F.struct(F.col("dst").alias("ip"), F.col("dport").alias("port"))
    p = packets.withColumn("lo", F.least(a, b)).withColumn("hi", F.greatest(a, b))
    first = p.groupBy("lo", "hi", "proto").agg(
        F.min_by("src", "ts").alias("src"), F.min_by("sport", "ts").alias("sport"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("packets"),
        F.sum("len").alias("bytes"), F.bit_or("flags").alias("flags"), F.sum(F.when(F.col("src") == F.col("lo.ip"), F.col("len")).otherwise(0)).alias("lo_bytes"),
    )
    orig = F.when(F.col("src") == F.col("lo.ip"), F.col("lo_bytes")).otherwise(F.col("bytes") - F.col("lo_bytes"))
    return first.where(F.col("packets") >= least).withColumn("orig_bytes", orig).withColumn("resp_bytes", F.col("bytes") - orig).withColumn("duration_s", F.col("last_seen") - F.col("first_seen")).drop("lo_bytes")
