"""Queries over dataset preparation, review, and evaluation over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, fingerprint, net, strings
from ..functions.common import iso_time
from ..ml import metrics
from ..operators import detectors, state, store
from ..sources import adapters
from ..sources.flowview import sparse_flows, table
from .detection import DAY, FINGER, LATERAL, flat, lateral, with_tls
from .registry import query


@query("""select event_id, event_type in ('click','error') as bad from events where event_type in ('click','error','view') or user_id % 5 = 0""")
def unsw_strict_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "Normal").otherwise(F.col("event_type")).alias("attack_cat"), (F.col("user_id") % 5).alias("label"))
    return adapters.unsw_strict(e, ("click", "error")).select("event_id", (F.col("y_true") == 1).alias("bad"))


@query("select event_id, (event_id % 4 = 2)::int as label from events where event_id % 4 in (0, 2)")
def binary_relabel(spark, sf_dir):
    return adapters.binary_subset(table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("label")), 2)


@query("""select event_id, (event_type='error')::int as label from events where ('0x'||substr(md5(event_id::varchar),1,12))::bigint / 281474976710656e0 < case when event_type='error' then 0.5e0 else 0.2e0 end""")
def sampled_scan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("flow=From-"), F.upper("event_type")).alias("text"))
    return adapters.sampled_by_class(e, "text", "event_id", "error", (0.2, 0.5)).select("event_id", "label")


@query("""select o_orderkey, (o_custkey % 100)::double as duration_s, o_totalprice::double as total_bytes, round((o_totalprice-o_custkey)::double,4) as resp_bytes from orders""")
def invariant_projection(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("TotBytes"), F.col("o_custkey").alias("SrcBytes"), (F.col("o_custkey") % 100).alias("Dur"), F.lit(3).alias("TotPkts"), F.col("o_orderkey").cast("int").alias("label"))
    out = adapters.invariant(adapters.binetflow(raw))
    return out.select(F.col("label").cast("long").alias("o_orderkey"), "duration_s", "total_bytes", F.round("resp_bytes", 4).alias("resp_bytes"))


@query("""select flow_id, greatest(1, orig_bytes//1000)::double as orig_pkts, round((orig_bytes+resp_bytes)/greatest(0.001e0, coalesce(nullif(duration_s,0e0),1e0)),4) as bytes_per_sec, round(coalesce(nullif(orig_bytes,0),0)/greatest(resp_bytes,1e0),6) as bytes_ratio,
  round((orig_bytes+resp_bytes)/(greatest(1,orig_bytes//1000)+greatest(1,resp_bytes//1000)),4) as pkt_size_mean, 0.1e0 as large_pkt_ratio from {flows}""")
def feature_reconstruction(spark, sf_dir):
    f = adapters.reconstructed(sparse_flows(spark, sf_dir))
    return f.select("flow_id", "orig_pkts", "large_pkt_ratio", F.round("bytes_per_sec", 4).alias("bytes_per_sec"), F.round("bytes_ratio", 6).alias("bytes_ratio"), F.round("pkt_size_mean", 4).alias("pkt_size_mean"))


@query("""select event_id, case event_id % 3 when 0 then 'confirmed_tp' when 1 then 'false_positive' else 'unreviewed' end as analyst_status from events""")
def verdict_status(spark, sf_dir):
    v = F.when(F.col("event_id") % 3 == 0, "true_positive").when(F.col("event_id") % 3 == 1, "false_positive").otherwise("unsure")
    return table(spark, sf_dir, "events").select("event_id", adapters.reviewed_status(v).alias("analyst_status"))


@query("""select event_id, floor(value)::double as days, event_type='click' as self_signed from events""")
def certificate_validity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    after = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 86_400_000_000).cast("long"))
    c = adapters.certificate(F.col("ts").cast("timestamp"), after, F.col("event_type"), F.lit("click"))
    return e.select("event_id", c.alias("c")).select("event_id", F.col("c.cert_validity_days").alias("days"), F.col("c.cert_self_signed").alias("self_signed"))


@query("""select page_id, split_part(split_part(split_part(split_part(url,'://',2),'?',1),'#',1),'/',1) as bucket, ltrim(substr(split_part(split_part(split_part(url,'://',2),'?',1),'#',1), length(split_part(split_part(split_part(split_part(url,'://',2),'?',1),'#',1),'/',1))+1),'/') as key from pages where contains(url,'://')""")
def store_url_split(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(F.contains("url", F.lit("://"))).select("page_id", adapters.bucket_and_key(F.col("url")).alias("u")).select("page_id", "u.bucket", "u.key")


_NOW = "2024-01-20 00:00:00"


@query(f"""select (epoch(timestamp '{_NOW}') + k*21600)::bigint as start, count(ts) as n from (select unnest(range(-12, 0)) as k) b left join events e
  on epoch_us(ts) between epoch_us(timestamp '{_NOW}') + k*21600000000 and epoch_us(timestamp '{_NOW}') + (k+1)*21600000000 group by 1""")
def trailing_timeline(spark, sf_dir):
    return state.trailing_buckets(table(spark, sf_dir, "events"), "ts", F.to_timestamp(F.lit(_NOW)), 21600, 12)


@query("""with c as (select event_id // 1000 as chunk, event_id % 3 as y, case when value > 3 then event_id % 3 else user_id % 3 end as p from events),
 s as (select k.chunk, y, p, count(*) as n from (select distinct chunk from c) k join c on c.chunk <= k.chunk group by all),
 t as (select chunk, sum(n) as n, sum(n) filter (y=p) as hit from s group by 1),
 a as (select chunk, y as cls, sum(n) as actual, sum(n) filter (y=p) as tp from s group by 1,2), b as (select chunk, p as cls, sum(n) as called from s group by 1,2),
 f as (select chunk, sum(2*tp/(actual+called))/3 as f1, sum(actual*called) as chance from a join b using (chunk, cls) group by 1)
 select chunk, n::bigint as n, round(hit/n,6) as accuracy, round(f1,6) as macro_f1, round((hit/n-chance/(n*n))/(1-chance/(n*n)),6) as kappa from t join f using (chunk)""")
def prequential_metrics(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.floor(i / 1000).cast("long").alias("chunk"), (i % 3).alias("y"), F.when(F.col("value") > 3, i % 3).otherwise(F.col("user_id") % 3).alias("p"))
    m = metrics.prequential(e, "chunk", "y", "p", [0, 1, 2])
    return m.select("chunk", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "kappa")])


@query("""select flow_id, count(*)::bigint as n from (select a.flow_id, b.flow_id as other from (select *, row_number() over (partition by src_ip order by ts, flow_id) as k from {flows}) a
  join (select *, row_number() over (partition by src_ip order by ts, flow_id) as k from {flows}) b on a.src_ip=b.src_ip and b.k between a.k-14 and a.k and epoch_us(b.ts) >= epoch_us(a.ts)-172800000000) group by 1""")
def history_with_ttl(spark, sf_dir):
    f = sparse_flows(spark, sf_dir).withColumn("h", state.history_within(["flow_id"], ["src_ip"], "ts", ["ts", "flow_id"], 15, 2 * 86400))
    return f.select("flow_id", F.size("h").cast("long").alias("n"))


@query("""with a as (select * from {flows} where flow_id % 2 = 0), b as (select flow_id as session, src_ip, ts from {flows} where flow_id % 2 = 1),
 j as (select a.flow_id, arg_max(b.session, {{'t': b.ts, 's': b.session}}) as session, max(b.ts) as t, any_value(a.ts) as at from a join b on a.src_ip=b.src_ip and b.ts<=a.ts group by 1)
 select a.flow_id, case when epoch_us(j.at)-epoch_us(j.t)<=86400000000 then j.session end as session from a left join j using (flow_id)""".replace("{{", "{").replace("}}", "}"))
def cached_session_join(spark, sf_dir):
    f = sparse_flows(spark, sf_dir)
    a, b = f.where("flow_id % 2 = 0").select("flow_id", "src_ip", "ts"), f.where("flow_id % 2 = 1").select("src_ip", "ts", F.col("flow_id").alias("session"))
    return store.cached_join(a, b, "src_ip", "ts", 86400).select("flow_id", "session")


@query("select event_type as dataset, count(*) as rows, case event_type when 'click' then 100e0 when 'view' then round(count(*)*100e0/1000000,6) end as percent from events group by 1")
def training_progress(spark, sf_dir):
    p = store.progress(table(spark, sf_dir, "events"), "event_type", {"click": 10, "view": 1_000_000})
    return p.select("dataset", "rows", F.round("percent", 6).alias("percent"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as at from events")
def iso_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", iso_time(F.col("ts")).alias("at"))


@query("""select o_orderkey, concat('t', case o_custkey % 3 when 0 then '12' when 1 then '13' else '00' end, case when o_custkey % 2 = 0 then 'd' else 'i' end, '0202_', substr(sha256(concat(least(o_custkey, 2570), ',', greatest(o_custkey, 2570))),1,12), '_', substr(sha256('0,16'),1,12)) as ja4 from orders""")
def ja4_plain(spark, sf_dir):
    k = F.col("o_custkey")
    version = F.when(k % 3 == 0, "TLSv1.2").when(k % 3 == 1, "TLSv1.3").otherwise("SSLv3")
    sni = F.when(k % 2 == 0, "a.b").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", fingerprint.ja4_plain(version, sni, F.array(k.cast("long"), F.lit(2570).cast("long")), F.array(F.lit(16), F.lit(0))).alias("ja4"))


@query("""select event_id, case when event_type='click' then 1e0 when event_type='view' then 2e0 when event_type='error' then 3e0 else 0e0 end as proto, case event_id % 4 when 0 then 5e0 when 1 then 8e0 when 2 then 0e0 else 1e0 end as state from events""")
def connection_codes(spark, sf_dir):
    name = F.when(F.col("event_type") == "click", " TCP6 ").when(F.col("event_type") == "view", "udp").when(F.col("event_type") == "error", "ipv6-icmp").otherwise("arp")
    i = F.col("event_id") % 4
    st = F.when(i == 0, "sf ").when(i == 1, "RSTO").when(i == 2, "other").otherwise("CON")
    return table(spark, sf_dir, "events").select("event_id", net.protocol_code(name).alias("proto"), net.state_code(st).alias("state"))


@query("""select event_id, (event_id % 5 = 3)::int as nx, (event_type='click')::int as txt, (event_type='view')::int as nul, (event_type='error')::int as mx from events""")
def dns_query_flags(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "TXT").when(F.col("event_type") == "view", "NULL").when(F.col("event_type") == "error", "MX")
    f = strings.query_flags(kind, F.col("event_id") % 5)
    return table(spark, sf_dir, "events").select("event_id", *[f[k].alias(n) for k, n in (("dns_is_nxdomain", "nx"), ("dns_qtype_is_txt", "txt"), ("dns_qtype_is_null", "nul"), ("dns_qtype_is_mx", "mx"))])


@query("""with x as (select vec_id, cast(unnest(embedding) as double) as x, unnest(range(len(embedding))) as i from embeddings), c as (select vec_id, i, x - avg(x) over (partition by vec_id) as d from x), p as (select vec_id, sum(d*d) as p from c group by 1),
 r as (select a.vec_id, b.i-a.i as lag, sum(a.d*b.d) as s from c a join c b on a.vec_id=b.vec_id and b.i>a.i group by all), q as (select vec_id, lag, round(s/p,5) as score, row_number() over (partition by vec_id order by s/p desc, lag desc) as k from r join p using (vec_id))
 select vec_id, string_agg(lag, ',' order by k) as lags, max(score) as best from q where k<=5 group by 1""")
def acf_top_lags(spark, sf_dir):
    top = arrays.top_lags(F.transform("embedding", lambda x: x.cast("double")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", top.alias("t"))
    return e.select("vec_id", F.array_join(F.transform("t", lambda x: x["lag"].cast("string")), ",").alias("lags"), F.round(F.get("t", F.lit(0))["score"], 5).alias("best"))


@query("""with h as (select le::double as le, count(*) filter (value<=le) as n from events, (values (0.5),(1),(2),(4),(8),(16)) v(le) group by 1), g as (select *, max(n) over () as al, coalesce(lag(n) over (order by le),0) as lo, coalesce(lag(le) over (order by le),0) as f from h)
 select round(min(f+(le-f)*(al*0.9-lo)/(n-lo)),6) as quantile from g where n>=al*0.9 and lo<al*0.9""")
def histogram_quantile(spark, sf_dir):
    bounds = (0.5, 1.0, 2.0, 4.0, 8.0, 16.0)
    row = table(spark, sf_dir, "events").agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    h = row.select(F.explode(F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("h")).select("h.*")
    return metrics.histogram_quantile(h, 0.9).select(F.round("quantile", 6).alias("quantile"))


@query("""with e as (select event_type, floor(epoch(ts)/86400)::bigint as bucket, ts, event_id, row_number() over (partition by event_type order by ts, event_id) as c from events)
 select event_type, bucket, round(case when max(epoch_us(ts))>min(epoch_us(ts)) then (max(c)-min(c))/((max(epoch_us(ts))-min(epoch_us(ts)))/1e6) end,9) as per_second from e group by 1,2""")
def counter_rates(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("c", state.running_count(["event_type"], ["ts", "event_id"]))
    return metrics.counter_rate(e, ["event_type"], "ts", "c", DAY).select("event_type", "bucket", F.round("per_second", 9).alias("per_second"))


@query(f"""with f as (select *, flow_id in (select flow_id from {LATERAL}) as lateral_hit, flow_id in (select flow_id from {FINGER} where threat_type='blacklisted_tls_client') as c2_hit from {{flows}}),
 g as (select *, dst_port=445 and (orig_bytes>=500000 or sum((dst_port=445)::int) over (partition by src_ip, dst_ip, floor(epoch(ts)/86400) order by ts, flow_id rows unbounded preceding)>=30) as s1, dst_port in (135,445) and lateral_hit as s2, c2_hit as s3,
   dst_port=445 and coalesce(nullif(orig_pkts,0),1)/greatest(coalesce(nullif(duration_s,0e0),0.1e0),0.001e0)>50 and orig_bytes<10000 as s4 from f),
 h as (select *, case when s1 or s2 or s3 or s4 then epoch_us(ts) end as hit_us from g),
 i as (select *, max(hit_us) over (partition by src_ip order by ts, flow_id rows between unbounded preceding and 1 preceding) as prior, max(hit_us) over (partition by src_ip order by ts, flow_id rows unbounded preceding) as last from h),
 j as (select *, sum((hit_us is not null and (prior is null or hit_us-prior>604800000000))::int) over (partition by src_ip order by ts, flow_id rows unbounded preceding) as run from i),
 k as (select *, max(s1::int) over w + max(s2::int) over w + max(s3::int) over w + max(s4::int) over w as n from j window w as (partition by src_ip, run order by ts, flow_id rows unbounded preceding))
 select flow_id, 'ransomware' as threat_type, 'critical' as severity, round(least(0.99e0,0.70e0+(n-2)*0.10e0),3) as confidence, 'T1486,T1490,T1489,T1021.002,T1083' as mitre_ttps from k where n>=2 and epoch_us(ts)-last<=604800000000""")
def ransomware_from_detectors(spark, sf_dir):
    f = with_tls(sparse_flows(spark, sf_dir))
    c2 = detectors.tls_fingerprint(f).where("threat_type = 'blacklisted_tls_client'")
    f = detectors.with_flag(detectors.with_flag(f, lateral(f), "lateral_hit"), c2, "c2_hit")
    return flat(detectors.ransomware(f, F.col("lateral_hit"), F.col("c2_hit"), window_s=DAY, gap_s=7 * DAY))


_METER = """(select event_id, case when event_id % 9 > 0 then (value*1000000)::varchar else 'bad' end as duration, event_id % 100 as mean, event_id % 13 as std, event_id*3 as orig, event_id % 50 as resp, case event_type when 'click' then 'BENIGN' when 'view' then 'Bot' when 'error' then 'Infiltration' when 'purchase' then 'PortScan' else 'Heartbleed' end as label from events)"""


@query(f"""select orig::double as orig_bytes, round(try_cast(duration as double)/1e6,6) as duration_s, mean/1000e0 as iat_mean_ms, null::double as iat_min_ms, (orig+resp)::double as total_bytes, round(orig/(resp+1e0),6) as bytes_ratio, round((std/1000e0)/(mean/1000e0+1e-9),4) as iat_cv,
  case label when 'BENIGN' then 0 when 'Bot' then 1 when 'Infiltration' then 3 else 2 end as label, 'CICIDS' as dataset_source, true as has_timing_features from {_METER} where label<>'Heartbleed'""")
def flow_meter_adapter(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    raw = table(spark, sf_dir, "events").select(
        F.when(i % 9 > 0, (F.col("value") * 1_000_000).cast("string")).otherwise("bad").alias("Flow Duration"), (i % 100).alias("Fwd IAT Mean"), (i % 13).alias("Fwd IAT Std"), (i * 3).alias("Total Length of Fwd Packets"), (i % 50).alias("Total Length of Bwd Packets"),
        F.when(kind == "click", "BENIGN").when(kind == "view", "Bot").when(kind == "error", "Infiltration").when(kind == "purchase", "PortScan").otherwise("Heartbleed").alias(" Label"),
    )
    d = adapters.flow_meter(raw)
    return d.select("orig_bytes", F.round("duration_s", 6).alias("duration_s"), "iat_mean_ms", "iat_min_ms", "total_bytes", F.round("bytes_ratio", 6).alias("bytes_ratio"), F.round("iat_cv", 4).alias("iat_cv"), "label", "dataset_source", "has_timing_features")


@query("""select event_id::double as orig_bytes, (event_id % 7)::double as resp_bytes, (event_id % 600)::double as dport, (event_id + event_id % 7)::double as total_bytes, round(event_id/(event_id % 7 + 1e0),6) as bytes_ratio, case event_type when 'click' then 1 when 'view' then 0 when 'error' then 0 end as label, 'CTU13' as dataset_source from events""")
def connection_log_adapter(spark, sf_dir):
    i, kind = F.col("event_id"), F.col("event_type")
    raw = table(spark, sf_dir, "events").select(i.cast("string").alias("orig_bytes"), (i % 7).alias("resp_bytes"), (i % 600).alias("id.resp_p"), F.when(kind == "click", "Botnet").when(kind == "view", "Normal").when(kind == "error", "Background").otherwise("Other").alias("label"))
    return adapters.connection_log(raw).select("orig_bytes", "resp_bytes", "dport", "total_bytes", F.round("bytes_ratio", 6).alias("bytes_ratio"), "label", "dataset_source")
