"""Queries over the graph of hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..sources.flowview import sparse_flows
from .registry import query

DAY = 86400
#: Flows between inner hosts: those that the view sends to a server go to a host instead.
EDGES = """(select * replace (case when starts_with(dst_ip,'10.1.0.') then concat('10.0.0.', (flow_id*7) % 150) else dst_ip end as dst_ip) from {flows})"""
_SEEN = f"""with e as (select *, row_number() over (partition by src_ip, dst_ip order by ts, flow_id)=1 as new from {EDGES}),
 n as (select flow_id, ts, src_ip as host, true as o, new, orig_bytes from e union all select flow_id, ts, dst_ip, false, new, orig_bytes from e),
 s as (select flow_id, o, sum(o::int) over w as out_degree, sum((not o)::int) over w as in_degree, sum((o and new)::int) over w as unique_dsts, sum((not o and new)::int) over w as unique_srcs, sum(case when o then orig_bytes else 0 end) over w as bytes_sent
   from n window w as (partition by host order by ts, flow_id, not o rows unbounded preceding)),
 f as (select e.*, a.out_degree::bigint as out_degree, a.in_degree::bigint as in_degree, a.unique_dsts::bigint as unique_dsts, a.unique_srcs::bigint as unique_srcs, a.bytes_sent::bigint as bytes_sent, b.in_degree::bigint as dst_in_degree, b.unique_srcs::bigint as dst_unique_srcs
   from e join s a on a.flow_id=e.flow_id and a.o join s b on b.flow_id=e.flow_id and not b.o)"""


def _level(k: int) -> str:
    return f"""c{k + 1} as (select c.flow_id, c.us, c.src_ip, c.dst_ip, case when c.us - max(p.us) <= 7200000000 then {k + 1} else c.depth end as depth from c{k} c left join c{k} p on p.dst_ip=c.src_ip and p.us<c.us and p.depth>={k} group by c.flow_id, c.us, c.src_ip, c.dst_ip, c.depth)"""


_CHAINS = f"c1 as (select flow_id, epoch_us(ts) as us, src_ip, dst_ip, 1 as depth from {EDGES}), " + ", ".join(map(_level, (1, 2, 3)))


def edges(spark, sf_dir):
    f = sparse_flows(spark, sf_dir)
    inner = F.concat(F.lit("10.0.0."), (F.col("flow_id") * 7 % 150).cast("string"))
    return f.withColumn("dst_ip", F.when(F.startswith("dst_ip", F.lit("10.1.0.")), inner).otherwise(F.col("dst_ip")))


@query(_SEEN + " select flow_id, new as new_neighbour, out_degree, in_degree, unique_dsts, unique_srcs, bytes_sent, dst_in_degree, dst_unique_srcs, round(unique_dsts/(out_degree+1),6) as burst, round(unique_dsts/out_degree,6) as spread from f")
def graph_edge_features(spark, sf_dir):
    f = graph.edge_features(edges(spark, sf_dir), 3 * DAY)
    return f.select("flow_id", "new_neighbour", "out_degree", "in_degree", "unique_dsts", "unique_srcs", "bytes_sent", "dst_in_degree", "dst_unique_srcs", F.round("burst", 6).alias("burst"), F.round("spread", 6).alias("spread"))


@query(f"with {_CHAINS} select flow_id, depth as chain_depth from c4")
def graph_chain_depth(spark, sf_dir):
    return graph.with_chain_depth(edges(spark, sf_dir), 7200, 4, 3 * DAY).select("flow_id", "chain_depth")


@query(_SEEN + f""", {_CHAINS}, p as (select f.*, depth, 1-(1-0.25e0*new::int)*(1-0.5e0*least(1e0,unique_dsts/10e0))*(1-0.4e0*(dst_port in (445,135,139,3389,5985))::int)*(1-0.6e0*((depth-1)/3e0)) as p from f join c4 using (flow_id))
 select flow_id, 'lateral_movement' as threat_type, case when p>0.9e0 then 'critical' else 'high' end as severity, round(p,3) as confidence, 'T1021,T1570,T1550' as mitre_ttps, unique_dsts as unique_destinations, out_degree, depth as chain_depth,
  concat(src_ip,' reached ',unique_dsts,' hosts (lateral movement score: ',round(p,3),'), port ',dst_port,', chain of ',depth) as explanation from p where p>0.75e0""")
def graph_lateral_alerts(spark, sf_dir):
    a = graph.graph_lateral_alerts(edges(spark, sf_dir), within_s=7200, slice_s=3 * DAY)
    return a.select("flow_id", "threat_type", "severity", "confidence", F.array_join("mitre_ttps", ",").alias("mitre_ttps"), "unique_destinations", "out_degree", "chain_depth", "explanation")
