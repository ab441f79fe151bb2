"""Queries over alerts on their way from the detectors to the analyst: fusion, storage, messages, details, counters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import net, strings
from ..ml import metrics, split
from ..operators import detectors, store
from ..sources import readers
from ..sources.flowview import sparse_flows, table
from .analysis import ALERTS, alerts
from .registry import query


@query("""with e as (select event_id, value/10 as v, event_id % 10 as a, event_id % 7 as b, event_id % 5 as c from events),
 m as (select *, (1+a)/(10e0+a+b+c) as p0, (2+b)/(10e0+a+b+c) as p2, (3+c)/(10e0+a+b+c) as p3, a>6 as c2, 0.5e0+b/20e0 as c2p, b/10e0 as dns, c/5e0 as exfil, a*1e0 as duration, b*1000000 as orig, c*100000 as resp from e),
 f as (select *, (duration<5 and orig/(resp+1e0)<0.3e0 and orig<5000) or (orig/(resp+1e0)>5 and orig>5000000) as dropped from m)
 select event_id, case when dns>=0.5e0 then 'dns_tunnel' when exfil>=0.7e0 then 'exfiltration' when c2 and dropped then 'clean' when c2 then 'c2_beacon' when p0>=p2 and p0>=p3 then 'clean' when p2>=p3 then 'dns_tunnel' else 'exfiltration' end as threat_type,
  round(case when dns>=0.5e0 then dns when exfil>=0.7e0 then exfil when c2 and dropped then 1-c2p when c2 then c2p else greatest(p0,p2,p3) end,6) as confidence from f""")
def ensemble_fusion(spark, sf_dir):
    i = F.col("event_id")
    a, b, c = i % 10, i % 7, i % 5
    total = F.lit(10.0) + a + b + c
    meta = F.array((1 + a) / total, F.lit(0.99), (2 + b) / total, (3 + c) / total)  # the C2 class is never taken from here
    out = detectors.fuse(meta, a > 6, F.lit(0.5) + b / F.lit(20.0), b / F.lit(10.0), c / F.lit(5.0), a.cast("double"), b * 1_000_000, c * 100_000)
    return table(spark, sf_dir, "events").select("event_id", out.alias("o")).select("event_id", "o.threat_type", F.round("o.confidence", 6).alias("confidence"))


@query("""with e as (select event_id, (event_id % 21)/20e0-0.5e0 as score, case when event_id % 3 > 0 then (event_id % 11)/10e0 end as p, case when event_id % 4 > 0 then value*10 end as ratio from events),
 f as (select *, greatest(0e0,least(1e0,0.5e0-score)) as anomaly, score<0 as odd, coalesce(ratio>20,false) as lone from e)
 select event_id, round(anomaly,6) as anomaly_score, round(case when lone then greatest(0.85e0, case when odd then coalesce(p,anomaly) else 0e0 end) when odd then coalesce(p,anomaly) else 0e0 end,6) as exfil_probability,
  case when lone then 'exfil' when not odd then 'benign' when p>0.6e0 then 'exfil' else 'anomaly' end as prediction, case when lone then 'extreme_bytes_ratio' end as trigger from f""")
def exfil_predict(spark, sf_dir):
    i = F.col("event_id")
    out = detectors.exfil_predict((i % 21) / F.lit(20.0) - 0.5, F.when(i % 3 > 0, (i % 11) / F.lit(10.0)), F.when(i % 4 > 0, F.col("value") * 10))
    o = table(spark, sf_dir, "events").select("event_id", out.alias("o"))
    return o.select("event_id", F.round("o.anomaly_score", 6).alias("anomaly_score"), F.round("o.exfil_probability", 6).alias("exfil_probability"), "o.prediction", "o.trigger")


@query(f"""select 'alerts:feed' as topic, src_ip as key, a.flow_id::varchar as flow_id, threat_type, src_ip as src from {ALERTS} a join {{flows}} f using (flow_id)""")
def alert_topic(spark, sf_dir):
    m = store.topic_rows(alerts(spark, sf_dir).join(sparse_flows(spark, sf_dir).drop("ts"), "flow_id"))
    g = lambda k: F.get_json_object("value", f"$.{k}").alias(k)
    return m.select("topic", "key", g("flow_id"), g("threat_type"), g("src"))


_TTPS = """case threat_type when 'c2_beacon' then 'T1071.001,T1573.001,T1573.002' when 'dns_tunnel' then 'T1048.003,T1071.004' when 'exfiltration' then 'T1041,T1048,T1048.001' else '' end"""


@query(f"select flow_id, threat_type, {_TTPS} as mitre_ttps from {ALERTS}")
def mitre_map(spark, sf_dir):
    a = detectors.with_techniques(alerts(spark, sf_dir).withColumn("mitre_ttps", F.lit(None).cast("array<string>")))
    return a.select("flow_id", "threat_type", F.array_join("mitre_ttps", ",").alias("mitre_ttps"))


@query(f"""select md5(concat(flow_id,'|',strftime(ts, '%Y-%m-%d %H:%M:%S'),'|',threat_type,'|')) as alert_id, flow_id, threat_type, severity, confidence, confidence as beacon_prob, null::double as dns_tunnel_prob, null::double as exfil_score,
  concat('{{"iat_cv":', flow_id % 3, '}}') as shap_values, {_TTPS} as mitre_ttps, 'unreviewed' as analyst_status from {ALERTS}""")
def save_alert(spark, sf_dir):
    a = alerts(spark, sf_dir).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("analyst_status")
    a = a.withColumn("sub_scores", F.create_map(F.lit("beacon_prob"), F.col("confidence"))).withColumn("shap_values", F.create_map(F.lit("iat_cv"), F.col("flow_id") % 3)).withColumn("mitre_ttps", F.lit(None).cast("array<string>"))
    return store.save_alert(detectors.with_techniques(a)).withColumn("mitre_ttps", F.array_join("mitre_ttps", ",")).drop("ts", "explanation")


@query(f"""select a.flow_id, json_extract_string(j,'$.src') as src, json_extract_string(j,'$.alert_severity') as severity, json_extract_string(j,'$.dport')::int as dport, json_extract_string(j,'$.analyst_status') as status from
  (select a.flow_id, json_object('src', src_ip, 'alert_severity', severity, 'dport', dst_port, 'analyst_status', 'unreviewed') as j from {ALERTS} a join {{flows}} f using (flow_id)) a""")
def feed_json(spark, sf_dir):
    a = store.feed_json(alerts(spark, sf_dir).join(sparse_flows(spark, sf_dir).drop("ts"), "flow_id"))
    g = lambda k: F.get_json_object("json", f"$.{k}")
    return a.select("flow_id", g("src").alias("src"), g("alert_severity").alias("severity"), g("dport").cast("int").alias("dport"), g("analyst_status").alias("status"))


@query(f"""select a.flow_id::varchar as flow_id, epoch_us(a.ts)/1e6 as timestamp, threat_type, severity as alert_severity, confidence, src_ip as src, coalesce(dst_ip,'0.0.0.0') as dst, coalesce(dst_port,0) as dport, coalesce(analyst_status,'unreviewed') as analyst_status
  from {ALERTS} a join (select flow_id, src_ip, case when dst_port<>22 then dst_ip end as dst_ip, case when dst_port<>22 then dst_port end as dst_port from {{flows}}) f using (flow_id)""")
def api_alerts(spark, sf_dir):
    f = sparse_flows(spark, sf_dir).select("flow_id", "src_ip", *[F.when(F.col("dst_port") != 22, F.col(c)).alias(c) for c in ("dst_ip", "dst_port")])
    a = alerts(spark, sf_dir).withColumn("alert_id", F.col("flow_id")).withColumn("mitre_ttps", F.array().cast("array<string>")).join(f, "flow_id")
    return store.api_alerts(a).drop("alert_id", "explanation", "mitre_ttps")


@query(f"select flow_id, case when analyst_status = 'confirmed' then 'x' else concat('x | TI: ', case when flow_id % 2 = 0 then 'listed' else 'unknown' end) end as explanation from {ALERTS}")
def threat_intel_enrichment(spark, sf_dir):
    a = alerts(spark, sf_dir).withColumn("explanation", F.lit("x")).withColumn("analyst_status", F.when(F.col("analyst_status") == "confirmed", "suppressed").otherwise(F.col("analyst_status")))
    return store.enriched(a, F.when(F.col("flow_id") % 2 == 0, "listed")).select("flow_id", "explanation")


@query(f"""with f as (select * from {{flows}} where orig_bytes>50000 order by flow_id limit 1), p as (select l_linenumber as n, l_quantity as q from lineitem where l_orderkey = 1)
 select f.flow_id, src_ip, a.threat_type as threat, (select count(*) from p) as packets, (select round(sum(q),2)::double from p) as total from f left join {ALERTS} a using (flow_id)""")
def flow_detail(spark, sf_dir):
    flows = sparse_flows(spark, sf_dir)
    first = flows.where("orig_bytes > 50000").agg(F.min("flow_id")).first()[0]
    li = table(spark, sf_dir, "lineitem").where("l_orderkey = 1")
    packets = li.select(F.lit(first).alias("flow_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("ts"), F.col("l_linenumber").cast("long").alias("packet_id"), F.col("l_quantity").cast("double").alias("size"))
    d = store.flow_detail(flows, alerts(spark, sf_dir), packets, first)
    total = F.aggregate("packet_timeline", F.lit(0.0), lambda a, x: a + x["size"])
    return d.select("flow_id", "src_ip", F.col("prediction.threat_type").alias("threat"), F.size("packet_timeline").cast("long").alias("packets"), F.round(total, 2).alias("total"))


@query(f"""select (select count(*) from {{flows}}) as total_flows, (select floor((epoch_us(max(ts))-epoch_us(min(ts)))/1e6)::bigint from {{flows}}) as uptime_s, (select round(count(*)/greatest((epoch_us(max(ts))-epoch_us(min(ts)))/1e6,1),1) from {{flows}}) as flows_per_sec,
  count(*) as total_alerts, count(*) filter (threat_type='c2_beacon') as c2_beacon, count(*) filter (threat_type='dns_tunnel') as dns_tunnel, count(*) filter (threat_type='exfiltration') as exfiltration, count(*) filter (threat_type='lateral_movement') as lateral_movement from {ALERTS}""")
def counter_snapshot(spark, sf_dir):
    return store.snapshot(sparse_flows(spark, sf_dir), alerts(spark, sf_dir)).withColumn("uptime_s", F.col("uptime_s").cast("long"))


@query("select event_id as sensor_id, value as packet_loss from events where value > 5")
def packet_loss_alarm(spark, sf_dir):
    return store.lossy_sensors(table(spark, sf_dir, "events").select(F.col("event_id").alias("sensor_id"), F.col("value").alias("packet_loss")))


@query(f"""with s as (select *, 0 as new from {ALERTS} where flow_id % 2 = 0), n as (select flow_id, ts, 'merged' as threat_type, severity, confidence, analyst_status, 1 as new from {ALERTS} where flow_id % 3 = 0)
 select flow_id, arg_max(threat_type, new) as threat_type, count(*)-1 as replaced from (select * from s union all select * from n) group by 1""")
def incremental_merge(spark, sf_dir):
    a = alerts(spark, sf_dir)
    stored, new = a.where("flow_id % 2 = 0"), a.where("flow_id % 3 = 0").withColumn("threat_type", F.lit("merged"))
    out = store.merged(stored, new, ["flow_id"])
    return out.select("flow_id", "threat_type", F.when(F.col("flow_id") % 6 == 0, 1).otherwise(0).cast("long").alias("replaced"))


@query("""select event_id, case event_id % 4 when 0 then 'a,b c' when 1 then 'x' when 2 then '' else 'T1,T2' end as tags, case event_id % 4 when 0 then 2 when 1 then 1 when 2 then 0 else 2 end::bigint as n from events""")
def tag_lists(spark, sf_dir):
    i = F.col("event_id") % 4
    raw = F.when(i == 0, F.lit("['a', 'b c']")).when(i == 1, F.lit("x")).when(i == 2, F.lit("")).otherwise(F.lit('["T1", "T2"]'))
    return table(spark, sf_dir, "events").select("event_id", store.tag_list(raw).alias("t")).select("event_id", F.array_join("t", ",").alias("tags"), F.size("t").cast("long").alias("n"))


@query("""select event_id, case when event_id % 3 = 0 then 'block_domain' else 'block_ip' end as target_kind, case when value/10 >= 0.9e0 then 'execute' else 'await_approval' end as step from events""")
def response_request(spark, sf_dir):
    target = F.when(F.col("event_id") % 3 == 0, "evil.example.com").otherwise("198.51.100.7")
    return table(spark, sf_dir, "events").select("event_id", detectors.response_target(target).alias("target_kind"), detectors.requested_response(F.col("value") / 10).alias("step"))


@query("""select event_id, reasons from (select event_id, string_agg(concat(n,'=',v), ',' order by abs(v) desc, n) as reasons from (select event_id, unnest(['a','b','c']) as n, unnest([event_id % 5 - 2, event_id % 3 - 1, event_id % 7 - 3]) as v from events) group by 1)""")
def alert_reasons(spark, sf_dir):
    i = F.col("event_id")
    m = F.map_from_arrays(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(i % 5 - 2, i % 3 - 1, i % 7 - 3))
    top = detectors.top_reasons(m, 3)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(top, lambda x: F.concat(x["name"], F.lit("="), x["value"].cast("string"))), ",").alias("reasons"))


@query("select flow_id from {flows} where dst_port not in (22, 3389)")
def management_port_filter(spark, sf_dir):
    return readers.without_local(sparse_flows(spark, sf_dir), (22, 3389)).select("flow_id")


@query("""select page_id, length(h)::bigint as sni_length, round((select -sum(c/n*log2(c/n)) from (select count(*)::double as c, length(l)::double as n from (select unnest(string_split(l,'')) as ch) group by ch)),6) as label_entropy
 from (select page_id, split_part(split_part(url,'://',2),'/',1) as h, split_part(split_part(split_part(url,'://',2),'/',1),'.',1) as l from pages where contains(url,'://')) where l<>''""".replace("(select -sum(c/n*log2(c/n)) from (select count(*)::double as c, length(l)::double as n from (select unnest(string_split(l,'')) as ch) group by ch))", "-list_sum(list_transform(list_distinct(string_split(l,'')), lambda ch: (len(list_filter(string_split(l,''), lambda x: x=ch))/length(l)::double)*log2(len(list_filter(string_split(l,''), lambda x: x=ch))/length(l)::double)))"))
def sni_features(spark, sf_dir):
    host = F.substring_index(F.substring_index(F.col("url"), "://", -1), "/", 1)
    p = table(spark, sf_dir, "pages").where(F.contains("url", F.lit("://"))).select("page_id", host.alias("sni"))
    p = p.where(F.substring_index("sni", ".", 1) != "")
    return p.select("page_id", F.length("sni").cast("long").alias("sni_length"), F.round(strings.string_entropy(F.substring_index("sni", ".", 1)), 6).alias("label_entropy"))


@query("""with h as (select event_id, event_type, ('0x'||substr(md5(event_id::varchar),1,12))::bigint as h from events), r as (select *, row_number() over (partition by event_type order by h, event_id) as rn, count(*) over (partition by event_type) as n from h)
 select event_id, rn <= floor(0.8e0*n) as train from r""")
def stratified_split(spark, sf_dir):
    return split.stratified_split(table(spark, sf_dir, "events"), "event_type", "event_id").select("event_id", "train")


@query("""with b as (select * from events where event_id % 10 = 0), k as (select count(*)//3 as m from b), r as (select event_type, row_number() over (partition by event_type order by md5(event_id::varchar), event_id) as rn from events where event_id % 10 > 0)
 select event_type, count(*) as n from (select event_type from b union all select event_type from r, k where rn<=m) group by 1""")
def balanced_mix(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return split.balanced_mix(e.where("event_id % 10 = 0"), e.where("event_id % 10 > 0"), "event_type", "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""select 'value' as feature, round(avg(value) filter (event_type<>'error'),6) as mean_0, round(avg(value) filter (event_type='error'),6) as mean_1, round(avg(value) filter (event_type='error')-avg(value) filter (event_type<>'error'),6) as difference from events""")
def class_separation(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("y", (F.col("event_type") == "error").cast("int"))
    return metrics.separation(e, "y", ["value"]).select("feature", *[F.round(c, 6).alias(c) for c in ("mean_0", "mean_1", "difference")])


@query("select event_id, case when event_id % 5 = 0 then 0e0 else (event_id % 5)/4e0 end as reputation from events")
def fingerprint_reputation(spark, sf_dir):
    known = spark.createDataFrame([(f"h{k}", k / 4) for k in range(1, 5)], "ja3 string, score double")
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("h"), (F.col("event_id") % 5).cast("string")).alias("ja3"))
    return store.with_default(e, known, "ja3", "score", 0.0).select("event_id", F.col("score").alias("reputation"))


@query("select event_id, (event_id % 3 = 0) as is_uuid from events")
def uuid_check(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, "123e4567-e89b-12d3-a456-426614174000").otherwise("123e4567-e89b-12d3-a456-42661417400")
    return table(spark, sf_dir, "events").select("event_id", net.is_uuid(raw).alias("is_uuid"))
