"""Further queries: joins by session key, exported lines, two-stage verdicts, folds, histograms, label scans."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays, net, strings
from ..operators import detectors, order, state, store
from ..sources import adapters
from ..sources.flowview import sparse_flows, table
from .analysis import ALERTS, alerts
from .registry import query

DAY = 86400
LATENCY = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0)


@query("""select count(*) filter (event_id is null) as event_id, count(*) filter (event_type is null) as event_type, count(*) filter (value is null) as value, count(*) filter (nullif(event_type,'view') is null) as not_view from events""")
def null_census(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in ("event_id", "event_type", "value")], F.count_if(F.nullif("event_type", F.lit("view")).isNull()).alias("not_view"))


@query("""select event_type, count(*) as n, round(count(*)*100e0/sum(count(*)) over (),4) as percent from events group by 1""")
def class_distribution(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return per.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


@query("""select event_type, n from (select event_type, count(*) as n, row_number() over (order by count(*) desc, event_type) as r from events where contains(props,'1') group by 1) where r<=3""")
def label_scan(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.contains("props", F.lit("1"))).groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("""select flow_id, lag(flow_id) over (partition by least(src_ip,dst_ip), greatest(src_ip,dst_ip), dst_port order by ts, flow_id) as session_flow, lag(orig_bytes) over (partition by least(src_ip,dst_ip), greatest(src_ip,dst_ip), dst_port order by ts, flow_id) as session_bytes
  from {flows} where dst_port=443""")
def session_either_direction(spark, sf_dir):
    f = sparse_flows(spark, sf_dir).where("dst_port = 443")
    return state.with_latest(f, {"session_flow": "flow_id", "session_bytes": "orig_bytes"}, [F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip"), "dst_port"], ["ts", "flow_id"]).select("flow_id", "session_flow", "session_bytes")


@query("""select flow_id from {flows} where (flow_id, orig_bytes, dst_port) in (select event_id, case when event_type='click' then round(value*10000)::bigint else 0 end, 443 from events)""")
def origin_verification(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("flow_id"), F.when(F.col("event_type") == "click", F.round(F.col("value") * 10000).cast("long")).otherwise(0).alias("orig_bytes"), F.lit(443).alias("dst_port"))
    return sparse_flows(spark, sf_dir).join(e, ["flow_id", "orig_bytes", "dst_port"], "left_semi").select("flow_id")


@query("""select flow_id, n from (select flow_id, count(*) over (partition by src_ip order by ts, flow_id rows between 49 preceding and current row) as n from {flows}) where n>=7""")
def history_last50(spark, sf_dir):
    f = sparse_flows(spark, sf_dir).withColumn("h", state.history(["orig_bytes"], ["src_ip"], ["ts", "flow_id"], 50))
    return f.select("flow_id", F.size("h").cast("long").alias("n")).where("n >= 7")


@query("""select flow_id, least(count(*) over (partition by dst_ip order by epoch_us(ts) range between 3599999999 preceding and current row),200) as n from {flows}""")
def beacon_history_hour(spark, sf_dir):
    return sparse_flows(spark, sf_dir).select("flow_id", F.least(state.sliding_count(["dst_ip"], "ts", 3600), F.lit(200)).alias("n"))


@query("""with r as (select event_id, floor((row_number() over (order by ts, event_id)-1)*6/count(*) over ())::bigint as part from events) select f.fold, count(*) filter (part<f.fold) as train, count(*) filter (part=f.fold) as test from r, (select unnest([1,2,3,4,5])::bigint as fold) f group by 1""")
def cv_folds(spark, sf_dir):
    e = order.with_row_number(table(spark, sf_dir, "events"), order.micros(F.col("ts")), ["ts", "event_id"])
    per = e.select(F.floor((F.col("_rn") - 1) * 6 / F.col("_rn_total")).alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    per = per.select("n", "part", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("fold"))
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return per.groupBy(F.col("fold").cast("long").alias("fold")).agg(share(F.col("part") < F.col("fold")).alias("train"), share(F.col("part") == F.col("fold")).alias("test"))


_LE = ", ".join(f"({x}e0)" for x in LATENCY)


@query(f"""select le, count(*) filter (value<=le) as n from events, (values {_LE}) v(le) group by le""")
def latency_histogram(spark, sf_dir):
    row = table(spark, sf_dir, "events").agg(*[F.count_if(F.col("value") <= x).alias(f"b{i}") for i, x in enumerate(LATENCY)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("le"), F.col(f"b{i}").alias("n")) for i, x in enumerate(LATENCY)])).alias("h")).select("h.*")


@query("""select event_id, round(case when e>2e0 and ml>3 then greatest(p, least(0.97e0, 0.60e0+0.15e0*(e-4)+0.20e0*d)) else p end,6) as p from (select event_id, value/100 as p, value/2 as e, event_id % 60 as ml, (event_id % 7)/7e0 as d from events)""".replace("e>2e0 and ml>3", "e>4 and ml>30"))
def dns_probability(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.round(strings.tunnel_probability(v / 100, v / 2, i % 60, (i % 7) / 7), 6).alias("p"))


@query("""select event_id, case when z<-2e0 then 'benign' when seen<2 then case when z>-3 then 'c2' else 'suspicious' end when coalesce(p, case when cv<0.25e0 then 0.85e0 else 0.15e0 end)>=0.45e0 then 'c2' else 'benign' end as verdict
 from (select event_id, value-5 as z, event_id % 4 as seen, case when event_id % 3 = 0 then value/10 end as p, (event_id % 10)/10e0 as cv from events)""")
def two_stage_c2(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    out = detectors.two_stage(v - 5, detectors.HUNT_THRESHOLDS["default_ops"], i % 4, F.when(i % 3 == 0, v / 10), (i % 10) / 10, F.lit(0.0), F.lit(1.0))
    return table(spark, sf_dir, "events").select("event_id", out["verdict"].alias("verdict"))


@query("""select flow_id, round(case when large<2 and orig_bytes<=10000000 and orig_bytes<=20*greatest(resp_bytes,1) then c*0.4e0 when large<2 then c else least(0.99e0,c*1.3e0) end,6) as confidence from
 (select *, payload_entropy/8 as c, coalesce(sum((orig_bytes>100000)::int) over (partition by src_ip,dst_ip order by ts, flow_id rows between 10 preceding and 1 preceding),0) as large from {flows})""")
def exfil_context(spark, sf_dir):
    f = sparse_flows(spark, sf_dir).withColumn("h", state.history(["orig_bytes"], ["src_ip", "dst_ip"], ["ts", "flow_id"], 10, include_current=False))
    large = F.size(F.filter("h", lambda x: x["orig_bytes"] > 100_000))
    return f.select("flow_id", F.round(detectors.exfil_context(F.col("payload_entropy") / 8, large, F.col("orig_bytes"), F.col("orig_bytes") > 20 * F.greatest("resp_bytes", F.lit(1))), 6).alias("confidence"))


@query(f"select flow_id, case when confidence>0.99e0 then 'auto_block' else 'queue' end as action from {ALERTS}")
def response_policy(spark, sf_dir):
    return alerts(spark, sf_dir).select("flow_id", detectors.response_action(F.col("confidence"), True).alias("action"))


@query("""select flow_id, case when contains(c,'/') then c when contains(c,':') then concat(c,'/128') else concat(c,'/32') end as cidr from (select flow_id, case flow_id % 3 when 0 then dst_ip when 1 then concat(dst_ip,'/24') else 'fe80::1' end as c from {flows})""")
def cidr_cleaner(spark, sf_dir):
    i = F.col("flow_id") % 3
    raw = F.when(i == 0, F.col("dst_ip")).when(i == 1, F.concat("dst_ip", F.lit("/24"))).otherwise("fe80::1")
    return sparse_flows(spark, sf_dir).select("flow_id", net.clean_cidr(F.concat(F.lit(" "), raw)).alias("cidr"))


@query("""select event_id, case when contains(event_type,'vi') then 2 when contains(event_type,'e') then 1 else 0 end as label from events""")
def label_patterns(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", adapters.label_by_patterns(F.upper("event_type"), [("vi", 2), ("e", 1)]).alias("label"))


@query("""select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: power(least(1e0, 0.5e0/sqrt(list_sum(list_transform(embedding, lambda u: cast(u as double)*cast(u as double)))))*cast(v as double),2)))),6) as norm, 100::bigint as n from embeddings""")
def clipped_norm(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = arrays.norm_clip(v, 0.5)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(out, F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"), F.size(arrays.pad(v, 100, F.lit(0.0))).cast("long").alias("n"))


def idle_sql(keys: str, gap_s: int, name: str) -> str:
    return f"""(select flow_id, count(*) over (partition by {keys}, s order by ts, flow_id rows unbounded preceding) as {name} from (select *, sum(new) over (partition by {keys} order by ts, flow_id rows unbounded preceding) as s from
  (select *, case when epoch_us(ts)-lag(epoch_us(ts)) over (partition by {keys} order by ts, flow_id) <= {gap_s}000000 then 0 else 1 end as new from {{flows}})))"""


@query(f"select * from {idle_sql('src_ip, dst_ip', 60, 'n_1m')} join {idle_sql('src_ip, dst_ip', 300, 'n_5m')} using (flow_id) join {idle_sql('src_ip, dst_ip', 3600, 'n_1h')} using (flow_id)")
def idle_connection_count(spark, sf_dir):
    f = state.with_idle_counts(sparse_flows(spark, sf_dir), {"n_1m": 60, "n_5m": 300, "n_1h": 3600}, ["src_ip", "dst_ip"], "ts", ["ts", "flow_id"])
    return f.select("flow_id", "n_1m", "n_5m", "n_1h")


_DNS = [("src_ip, dst_ip", 21600, "domain_1m"), ("src_ip, dst_ip", 86400, "domain_5m"), ("src_ip", 21600, "total_1m"), ("src_ip", 86400, "total_5m")]


@query("select * from " + " join ".join(idle_sql(*x) + (" using (flow_id)" if i else "") for i, x in enumerate(_DNS)))
def dns_query_counters(spark, sf_dir):
    f = sparse_flows(spark, sf_dir)  # the other side stands for the name asked for; windows are wide, as the flows are sparse
    f = state.with_idle_counts(f, {"domain_1m": 21600, "domain_5m": 86400}, ["src_ip", "dst_ip"], "ts", ["ts", "flow_id"])
    f = state.with_idle_counts(f, {"total_1m": 21600, "total_5m": 86400}, ["src_ip"], "ts", ["ts", "flow_id"])
    return f.select("flow_id", *[n for *_, n in _DNS])


@query(f"select flow_id, severity, analyst_status as status, case when analyst_status is null then 5 else 6 end::bigint as n_fields from {ALERTS}")
def alert_json(spark, sf_dir):
    j = store.alert_json(alerts(spark, sf_dir))
    return j.select("flow_id", F.get_json_object("json", "$.severity").alias("severity"), F.get_json_object("json", "$.analyst_status").alias("status"), F.size(F.json_object_keys("json")).cast("long").alias("n_fields"))


def fingerprint(df):
    """fingerprint, n: the sum of the rows' hashes, so it doesn't depend on their order."""
    return df.agg(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("fingerprint"), F.count("*").alias("n"))


@query()
def dataset_fingerprint(spark, sf_dir):
    return fingerprint(table(spark, sf_dir, "events"))
