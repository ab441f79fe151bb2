"""The graph of hosts as each flow found it: degrees and neighbours so far, new neighbours, chains of flows that follow each other in time, and alerts on them.

Every flow is an edge from its source to its destination. What an edge sees is what had been seen up to it, itself included: running sums per host over
slices of time, so a host that takes part in a third of all flows isn't sorted by one task. A neighbour is new at the pair's first flow, which is found by an
aggregate, not by sorting the pair's flows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import state
from .detectors import _alerts, _says

#: Ports over which hosts are taken, and techniques of the alert.
LATERAL_PORTS = (445, 135, 139, 3389, 5985)
TECHNIQUES = "T1021,T1570,T1550"
DAY = 86400


def _ends(edges: DataFrame, *carried: str) -> DataFrame:
    """Two rows for each edge: its source's (out) and its destination's."""
    ends = F.array(F.struct(F.col("src_ip").alias("host"), F.lit(True).alias("out"), F.col("dst_ip").alias("peer")), F.struct(F.col("dst_ip").alias("host"), F.lit(False).alias("out"), F.col("src_ip").alias("peer")))
    return edges.select("flow_id", "ts", *carried, F.explode(ends).alias("e")).select("flow_id", "ts", *carried, "e.*")


def edge_features(flows: DataFrame, slice_s: int = DAY) -> DataFrame:
    """``flows`` with both addresses, plus what the graph knew at each of them: out_degree, in_degree, unique_dsts, unique_srcs and bytes_sent of the source, dst_in_degree and
    dst_unique_srcs of the destination, new_neighbour, burst (unique_dsts / (out_degree + 1)) and spread (unique_dsts / out_degree). Flows of one time are taken by id;
    of a flow from a host to itself the outgoing end goes first."""
    edges = flows.where((F.col("src_ip") != "") & (F.col("dst_ip") != ""))
    first = edges.groupBy("src_ip", "dst_ip").agg(F.min(F.struct("ts", "flow_id")).alias("f")).select(F.col("f.flow_id").alias("_first"))
    marked = edges.select("flow_id", "ts", "src_ip", "dst_ip", "orig_bytes").join(first, F.col("flow_id") == F.col("_first"), "left").withColumn("new_neighbour", F.col("_first").isNotNull())
    ends = _ends(marked, "orig_bytes", "new_neighbour")
    one = lambda c: F.when(c, 1).otherwise(0)
    sums = {
        "out_degree": one(F.col("out")), "in_degree": one(~F.col("out")), "unique_dsts": one(F.col("out") & F.col("new_neighbour")), "unique_srcs": one(~F.col("out") & F.col("new_neighbour")),
        "bytes_sent": F.when(F.col("out"), F.coalesce("orig_bytes", F.lit(0))).otherwise(0),
    }
    ends = state.with_running(ends.withColumn("_last", ~F.col("out")), sums, ["host"], "ts", ["ts", "flow_id", "_last"], slice_s)
    seen = ends.groupBy("flow_id").agg(
        F.max(F.when(F.col("out"), F.struct("new_neighbour", *sums))).alias("s"), F.max(F.when(~F.col("out"), F.struct(F.col("in_degree").alias("dst_in_degree"), F.col("unique_srcs").alias("dst_unique_srcs")))).alias("d"),
    )
    out = edges.join(seen.select("flow_id", "s.*", "d.*"), "flow_id")
    return out.withColumn("burst", F.col("unique_dsts") / (F.col("out_degree") + 1)).withColumn("spread", F.col("unique_dsts") / F.greatest("out_degree", F.lit(1)))


def with_chain_depth(flows: DataFrame, within_s: int = 300, most: int = 4, slice_s: int = DAY) -> DataFrame:
    """``flows`` plus chain_depth: how many flows, up to ``most``, lead to this one, each from the host that the one before reached, at most ``within_s`` seconds after
    it (a flow alone: 1). One pass for each level: a flow is one deeper than level k if its source was reached in time by a flow of level k."""
    edges = flows.where((F.col("src_ip") != "") & (F.col("dst_ip") != "")).select("flow_id", "ts", "src_ip", "dst_ip", F.lit(1).alias("chain_depth"))
    for level in range(1, most):
        reached = F.when(~F.col("out") & (F.col("chain_depth") >= level), F.unix_micros(F.col("ts").cast("timestamp")))
        ends = state.with_running(_ends(edges, "chain_depth"), {}, ["host"], "ts", ["ts", "flow_id"], slice_s, {"reached": reached})
        deeper = F.unix_micros(F.col("ts").cast("timestamp")) - F.col("reached") <= within_s * 1_000_000
        edges = ends.where("out").select("flow_id", "ts", F.col("host").alias("src_ip"), F.col("peer").alias("dst_ip"), F.when(deeper, level + 1).otherwise(F.col("chain_depth")).alias("chain_depth"))
    return flows.join(edges.select("flow_id", "chain_depth"), "flow_id")


#: How much each sign weighs in ``lateral_probability``.
WEIGHTS = {"new_neighbour": 0.25, "fan_out": 0.5, "port": 0.4, "chain": 0.6}


def lateral_probability(fan_out: int = 10, most: int = 4, weights: dict[str, float] | None = None) -> Column:
    """The chance that at least one sign is right, each weighing as given: a new neighbour, the source's neighbours as a share of ``fan_out``, a port for taking hosts, and
    the chain's depth as a share of ``most``."""
    w = weights or WEIGHTS
    signs = {
        "new_neighbour": F.col("new_neighbour").cast("double"), "fan_out": F.least(F.lit(1.0), F.col("unique_dsts") / F.lit(fan_out)), "port": F.coalesce(F.col("dst_port").isin(*LATERAL_PORTS), F.lit(False)).cast("double"),
        "chain": (F.col("chain_depth") - 1) / F.lit(most - 1),
    }
    none = F.lit(1.0)
    for name, share in w.items():
        none = none * (1 - F.lit(share) * signs[name])
    return 1 - none


def graph_lateral_alerts(flows: DataFrame, threshold: float = 0.75, within_s: int = 300, most: int = 4, probability: Column | None = None, slice_s: int = DAY) -> DataFrame:
    """Alerts on edges whose lateral probability is above the threshold, with unique_destinations and out_degree. ``probability`` may be any column over the features
    of ``edge_features`` and chain_depth, as a trained model's."""
    f = with_chain_depth(edge_features(flows, slice_s), within_s, most, slice_s)
    f = f.withColumn("_p", lateral_probability(most=most) if probability is None else probability)
    why = _says("%s reached %s hosts (lateral movement score: %s), port %s, chain of %s", "src_ip", "unique_dsts", F.round("_p", 3), "dst_port", "chain_depth")
    f = f.where(F.col("_p") > threshold)
    alerts = _alerts(f, F.lit(True), F.lit("lateral_movement"), F.when(F.col("_p") > 0.9, "critical").otherwise("high"), F.col("_p"), F.lit(TECHNIQUES), why)
    return alerts.join(f.select("flow_id", F.col("unique_dsts").alias("unique_destinations"), "out_degree", "chain_depth"), "flow_id")
