"""Queries over stored tables, splits, metrics, adapters and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..ml import metrics, split
from ..operators import order, store
from ..sources import adapters
from ..sources.flowview import dense_flows, sparse_flows, table
from .registry import query

AS_OF = "2024-01-31 00:00:00"
ALERTS = """(select flow_id, ts, case when dst_port=22 then 'ssh_brute_force' when dst_port=8888 then 'high_entropy_exfil' else 'c2_beacon' end as threat_type, case when orig_bytes>500000 then 'critical' when orig_bytes>200000 then 'high' else 'low' end as severity,
 round(payload_entropy/8,4) as confidence, case flow_id % 5 when 0 then 'false_positive' when 1 then 'confirmed' when 2 then 'new' end as analyst_status from {flows} where orig_bytes>50000)"""


def alerts(spark, sf_dir):
    port, size = F.col("dst_port"), F.col("orig_bytes")
    return sparse_flows(spark, sf_dir).where(size > 50000).select(
        "flow_id", "ts", F.when(port == 22, "ssh_brute_force").when(port == 8888, "high_entropy_exfil").otherwise("c2_beacon").alias("threat_type"),
        F.when(size > 500000, "critical").when(size > 200000, "high").otherwise("low").alias("severity"), F.round(F.col("payload_entropy") / 8, 4).alias("confidence"),
        F.when(F.col("flow_id") % 5 == 0, "false_positive").when(F.col("flow_id") % 5 == 1, "confirmed").when(F.col("flow_id") % 5 == 2, "new").alias("analyst_status"),
    )


def as_of():
    return F.to_timestamp_ntz(F.lit(AS_OF))


@query(f"""select flow_id, threat_type, src_ip, dst_ip from {ALERTS} a join {{flows}} f using (flow_id) where severity='critical' and confidence>=0.8e0 and contains(src_ip,'.1')""")
def alerts_filtered(spark, sf_dir):
    return store.list_alerts(alerts(spark, sf_dir), sparse_flows(spark, sf_dir).drop("ts"), severity="critical", min_confidence=0.8, src_like=".1").select("flow_id", "threat_type", "src_ip", "dst_ip")


@query(f"select a.flow_id, concat('a', a.flow_id) as alert_id, threat_type, src_ip, dst_ip from {ALERTS} a join {{flows}} f using (flow_id) where a.flow_id = (select max(flow_id) from {ALERTS})")
def alert_by_id(spark, sf_dir):
    a = alerts(spark, sf_dir).withColumn("alert_id", F.concat(F.lit("a"), F.col("flow_id").cast("string")))
    newest = a.agg(F.max("flow_id")).first()[0]
    return store.list_alerts(a, sparse_flows(spark, sf_dir).drop("ts"), alert_id=f"a{newest}").select("flow_id", "alert_id", "threat_type", "src_ip", "dst_ip")


@query(f"select flow_id, threat_type from {ALERTS} order by ts desc, flow_id limit 50 offset 100")
def alerts_page(spark, sf_dir):
    return store.page(alerts(spark, sf_dir).select("flow_id", "threat_type", "ts"), [F.desc("ts"), "flow_id"], 50, 100).drop("ts")


@query(f"select flow_id, threat_type, dst_ip from {ALERTS} a left join (select flow_id, dst_ip from {{flows}} where dst_port<>22) f using (flow_id)")
def alert_flow_left(spark, sf_dir):
    return store.alert_flow(alerts(spark, sf_dir), sparse_flows(spark, sf_dir).where("dst_port <> 22").select("flow_id", "dst_ip")).select("flow_id", "threat_type", "dst_ip")


@query("""select f.flow_id, r.label from {flows} f join (select event_id as flow_id, ts + interval 1 day as reviewed_at, case event_id % 3 when 0 then 'c2' when 1 then 'benign' end as label from events where event_id % 7 = 0) r using (flow_id)
  where label is not null and reviewed_at > timestamp '2024-01-31 00:00:00' - interval 10 day""")
def feedback_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id % 7 = 0")
    reviews = e.select(F.col("event_id").alias("flow_id"), (F.col("ts") + F.expr("interval 1 day")).alias("reviewed_at"), F.when(F.col("event_id") % 3 == 0, "c2").when(F.col("event_id") % 3 == 1, "benign").alias("label"))
    return store.feedback(sparse_flows(spark, sf_dir), reviews, as_of(), 10).select("flow_id", "label")


@query(f"select flow_id, src_ip from {{flows}} where flow_id in (select flow_id from {ALERTS})")
def semi_alerted_flows(spark, sf_dir):
    return store.only_alerted(sparse_flows(spark, sf_dir), alerts(spark, sf_dir)).select("flow_id", "src_ip")


@query("select min(o_orderkey) as o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment='HOUSEHOLD') group by o_custkey")
def anti_new_flows(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").where("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("o_custkey"))
    return store.insert_absent(table(spark, sf_dir, "orders"), stored, "o_custkey", ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query(f"""select threat_type, count(*) as total, count(*) filter (analyst_status='false_positive') as false_positives, round(count(*) filter (analyst_status='false_positive')/count(*)*100,2) as rate
  from {ALERTS} where ts >= timestamp '{AS_OF}' - interval 20 day group by 1""")
def fp_rate_30d(spark, sf_dir):
    return store.false_positive_rate(alerts(spark, sf_dir), as_of(), 20)


@query(f"select analyst_status, count(*) as n from {ALERTS} where analyst_status is not null group by 1")
def status_counts(spark, sf_dir):
    return store.status_counts(alerts(spark, sf_dir))


@query("""select user_id as sensor_id, round(arg_max(value, ts),6) as packet_loss from events group by 1 having max(ts) < timestamp '2024-01-30 00:00:00' - interval 60 second""")
def sensor_dead(spark, sf_dir):
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("sensor_id"), F.col("ts").alias("last_seen"), F.col("value").alias("packet_loss"))
    return store.dead_sensors(beats, F.to_timestamp_ntz(F.lit("2024-01-30 00:00:00"))).select("sensor_id", F.round("packet_loss", 6).alias("packet_loss"))


@query("select event_id, ts + interval 24 hour as expires_at, case when event_type='click' then 'approved' when event_type='view' then 'executed' when event_type='error' then 'failed' else 'pending' end as status from events")
def response_expiry(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("created_at", F.col("ts"))
    event = F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "view", "execute").when(F.col("event_type") == "error", "fail").otherwise("none")
    return store.with_expiry(e).select("event_id", "expires_at", store.next_status(F.lit("pending"), event).alias("status"))


@query("""with e as (select src_ip, dst_ip, orig_bytes from {flows}), n as (select node, count(distinct o) as neighbours, count(distinct o) filter (called) as unique_dsts, count(distinct o) filter (not called) as unique_srcs from (select src_ip as node, dst_ip as o, true as called from e union all select dst_ip, src_ip, false from e) group by 1)
 select node, neighbours, unique_dsts, unique_srcs, coalesce(od,0)::bigint as out_degree, coalesce(id,0)::bigint as in_degree, coalesce(ob,0)::bigint as out_bytes, coalesce(ib,0)::bigint as in_bytes, unique_dsts/(coalesce(od,0)+1) as burst, least(1e0, unique_dsts/greatest(coalesce(od,0),1)) as spread from n
 left join (select src_ip as node, count(*) od, sum(orig_bytes) ob from e group by 1) using (node) left join (select dst_ip as node, count(*) id, sum(orig_bytes) ib from e group by 1) using (node)""")
def node_degree(spark, sf_dir):
    return store.node_degrees(sparse_flows(spark, sf_dir), "src_ip", "dst_ip", "orig_bytes")


@query("""select o_custkey as k, greatest(a.v, b.v) as v from (select o_custkey, max(o_totalprice) as v from orders where o_orderstatus='F' group by 1) a full join (select o_custkey, max(o_totalprice) as v from orders where o_orderstatus='O' group by 1) b using (o_custkey)""")
def merge_max_full_outer(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    side = lambda s: o.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return store.merge_max(side("F"), side("O"), "k", "v")


@query(f"""select a.flow_id, concat('<132> CEF:0|fluxwarden|flows|1.0|', threat_type, '|', threat_type, ' Detected|', case severity when 'low' then 3 when 'medium' then 5 when 'high' then 8 when 'critical' then 10 else 1 end,
  '|src=', src_ip, ' dst=', dst_ip, ' dpt=', dst_port, ' msg=', case when a.flow_id % 2 = 0 then concat('seen ', f.orig_bytes) else '' end) as line from {ALERTS} a join {{flows}} f using (flow_id)""")
def cef_format(spark, sf_dir):
    a = store.alert_flow(alerts(spark, sf_dir), sparse_flows(spark, sf_dir).drop("ts"))
    return store.cef_line(a.withColumn("explanation", F.when(F.col("flow_id") % 2 == 0, F.concat(F.lit("seen "), F.col("orig_bytes").cast("string")))))


@query("""select src as src_ip, count(*) as packets, sum(bytes)::bigint as bytes, min(ts) as first_seen, max(ts) as last_seen, bit_or(port)::int as flags from {dense} group by src""")
def flow_aggregation(spark, sf_dir):
    d = dense_flows(spark, sf_dir)
    return d.groupBy(F.col("src").alias("src_ip")).agg(F.count("*").alias("packets"), F.sum("bytes").alias("bytes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.bit_or("port").alias("flags"))


@query("""select label, predicted, count(*) as n from (select event_id % 4 as label, case when value>5 then event_id % 4 else user_id % 4 end as predicted from events) group by 1,2""")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_classified(spark, sf_dir), "label", "predicted")


def _classified(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 4).alias("label"), F.when(F.col("value") > 5, F.col("event_id") % 4).otherwise(F.col("user_id") % 4).alias("predicted"), (F.col("event_id") % 4 == 1).cast("int").alias("y"), F.round(F.col("value") / 100, 4).alias("score"))


_C = "(select event_id % 4 as label, case when value>5 then event_id % 4 else user_id % 4 end as predicted, (event_id % 4 = 1)::int as y, round(value/100,4) as score from events)"


@query(f"""with c as (select unnest([0,1,2,3])::bigint as cls), g as (select cls, (select count(*) from {_C} where label=cls and predicted=cls) as tp, (select count(*) from {_C} where label=cls) as actual, (select count(*) from {_C} where predicted=cls) as called from c)
 select cls, round(tp/called,6) as precision, round(tp/actual,6) as recall, round(2*(tp/called)*(tp/actual)/((tp/called)+(tp/actual)),6) as f1 from g""")
def prf_by_class(spark, sf_dir):
    return metrics.by_class(_classified(spark, sf_dir), "label", "predicted").select("cls", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""with m as (select avg((label=predicted)::int) as po from {_C}), p as (select sum(a*b)/sum(n0)/sum(n0)*count(*) as pe from (select a.c::double as a, b.c::double as b, (select count(*) from events)::double as n0 from (select label, count(*) c from {_C} group by 1) a join (select predicted, count(*) c from {_C} group by 1) b on label=predicted))
 select round(po,6) as accuracy, round((po-pe*1.0)/(1-pe),6) as kappa from m, (select sum(a*b)/any_value(n0)/any_value(n0) as pe from (select a.c::double as a, b.c::double as b, (select count(*) from events)::double as n0 from (select label, count(*) c from {_C} group by 1) a join (select predicted, count(*) c from {_C} group by 1) b on label=predicted))""")
def kappa(spark, sf_dir):
    return metrics.kappa(_classified(spark, sf_dir), "label", "predicted").select(F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"))


@query(f"""with g as (select score, sum(y) as p, sum(1-y) as n from {_C} group by 1), c as (select *, sum(p) over (order by score desc) as tp from g) select round((sum(n*(tp-p/2))/(sum(p)*sum(n)))::double,6) as auc from c""")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_classified(spark, sf_dir), "y", "score").select(F.round("auc", 6).alias("auc"))


@query(f"""with g as (select score, sum(y) as p, sum(1-y) as n from {_C} group by 1), c as (select score, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as fp from g) select score as threshold, round(tp/(tp+fp),6) as precision, round(tp/(select sum(y) from {_C}),6) as recall from c""")
def pr_curve(spark, sf_dir):
    return metrics.precision_recall(_classified(spark, sf_dir), "y", "score").select("threshold", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"select round(avg(power(score-y,2)),6) as brier from {_C}")
def brier(spark, sf_dir):
    return metrics.brier(_classified(spark, sf_dir), "y", "score").select(F.round("brier", 6).alias("brier"))


@query(f"""select t as threshold, round(case when count(*) filter (score>=t)>0 then count(*) filter (score>=t and y=1)/count(*) filter (score>=t) else 0e0 end,6) as precision, round(count(*) filter (score>=t and y=1)/count(*) filter (y=1),6) as recall,
  round(2*count(*) filter (score>=t and y=1)/(2*count(*) filter (score>=t and y=1)+count(*) filter (score>=t and y<>1)+count(*) filter (score<t and y=1)),6) as f1 from {_C}, (values (0.02e0),(0.05e0),(0.1e0)) v(t) group by t""")
def threshold_sweep(spark, sf_dir):
    return metrics.sweep(_classified(spark, sf_dir), "y", "score", [0.02, 0.05, 0.1]).select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""with g as (select score, sum(y) as p, sum(1-y) as n from {_C} group by 1), c as (select score, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as fp from g) select coalesce(min(score) filter (tp/(tp+fp)>=0.3e0), arg_max(score, tp/(tp+fp))) as threshold from c""")
def precision_floor_threshold(spark, sf_dir):
    return metrics.precision_floor(_classified(spark, sf_dir), "y", "score", 0.3)


@query("""with a as (select value x from events where event_type='click'), b as (select value x from events where event_type='view'), v as (select x from a union select x from b),
 d as (select abs((select count(*) from a where a.x<=v.x)/(select count(*) from a) - (select count(*) from b where b.x<=v.x)/(select count(*) from b)) as d from v) select round(max(d),6) as d, (select count(*) from a) as n_a, (select count(*) from b) as n_b from d""")
def ks_two_sample(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return metrics.ks_two_sample(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "value").select(F.round("d", 6).alias("d"), "n_a", "n_b")


@query("""select i, round(sum(cast(v as double)*n)/sum(n),6) as weight from (select unnest(embedding) as v, unnest(range(len(embedding))) as i, label+1 as n from embeddings) group by i""")
def fedavg(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "v"), (F.col("label") + 1).alias("n")).select(F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("weight"), "n")
    return metrics.fed_avg(e, "i", "weight", "n").select("i", F.round("weight", 6).alias("weight"))


@query("""select event_id, case when rn<=floor(0.7e0*n) then 'train' when rn<=floor(0.85e0*n) then 'validation' else 'test' end as split from (select event_id, row_number() over (order by ts, event_id) as rn, count(*) over () as n from events)""")
def time_split(spark, sf_dir):
    return split.time_split(table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "split")


@query("""select test, count(*) as n, count(distinct l_orderkey) as groups from (select l_orderkey, ('0x'||substr(md5(l_orderkey::varchar),1,15))::bigint % 100 < 25 as test from lineitem) group by 1""")
def group_holdout(spark, sf_dir):
    return split.group_holdout(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("test").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("groups"))


@query("""with e as (select *, event_type='purchase' as pos from events), k as (select 2*count(*) as m from e where pos) select event_id from e where pos union all select event_id from (select event_id, row_number() over (order by md5(cast(event_id as varchar)), event_id) as rn from e where not pos) where rn <= (select m from k)""")
def class_downsample(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("y", (F.col("event_type") == "purchase").cast("int"))
    return split.downsample(e, "y", "event_id", 2).select("event_id")


@query("""select event_type, count(*) * greatest(1, floor(least((select max(c) from (select count(*) c from events group by event_type)), 20000)/count(*)))::bigint as n from events group by 1""")
def class_balance(spark, sf_dir):
    return split.oversample(table(spark, sf_dir, "events"), "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


@query("select event_id, event_type from (select *, row_number() over (partition by event_type order by ts desc, event_id) as rn from events) where rn<=100")
def replay_cap(spark, sf_dir):
    return split.replay_buffer(table(spark, sf_dir, "events"), "event_type", [F.desc("ts"), "event_id"], 100).select("event_id", "event_type")


@query("""select vec_id from (select vec_id, -sum(p*ln(p+1e-9)) as h from (select vec_id, abs(cast(unnest(embedding) as double))/list_sum(list_transform(embedding, lambda v: abs(cast(v as double)))) as p from embeddings) group by 1) order by round(h,9) desc, vec_id limit 20""")
def uncertainty_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    p = F.transform("v", lambda x: x / F.aggregate(F.col("v"), F.lit(0.0), lambda a, y: a + y))
    return split.uncertain(e, F.round(arrays.prediction_entropy(p), 9), "vec_id", 20).select("vec_id")


@query("""select l_orderkey, l_linenumber, round(l_extendedprice/1e6,9) as duration_s, round(l_quantity/1000,6) as iat_mean_ms, round(l_tax/1000/(abs(l_quantity/1000)+1e-9),6) as iat_cv, (l_partkey<100)::int::double as small_pkt_ratio, (l_partkey>1400)::int::double as large_pkt_ratio, round(l_extendedprice/(l_discount+1),4) as bytes_ratio from lineitem""")
def adapter_cicids(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    raw = li.select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias(" Flow Duration"), F.col("l_quantity").alias(" Fwd IAT Mean"), F.col("l_tax").alias("Fwd IAT Std"), F.col("l_partkey").alias("Fwd Packet Length Min"),
        F.col("l_partkey").alias("Fwd Packet Length Max"), F.col("l_extendedprice").alias("Total Length of Fwd Packets"), F.col("l_discount").alias("Total Length of Bwd Packets"),
    )
    # The adapter drops identities (they would leak), so its expressions are put beside the keys here by position in one projection.
    out = adapters.cicids(raw.withColumn("label", F.col("l_orderkey") * 10 + F.col("l_linenumber")))
    key = F.col("label")
    return out.select(F.floor(key / 10).cast("long").alias("l_orderkey"), (key % 10).cast("int").alias("l_linenumber"), F.round("duration_s", 9).alias("duration_s"), F.round("iat_mean_ms", 6).alias("iat_mean_ms"), F.round("iat_cv", 6).alias("iat_cv"), "small_pkt_ratio", "large_pkt_ratio", F.round("bytes_ratio", 4).alias("bytes_ratio"))


@query("""select o_orderkey, round(o_totalprice-o_custkey,4) as resp_bytes, round(o_custkey/(o_totalprice-o_custkey+1),8) as bytes_ratio from orders""")
def adapter_ctu(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("TotBytes"), F.col("o_custkey").alias("SrcBytes"), F.lit("1").alias("Dur"), F.lit(3).alias("TotPkts"), F.col("o_orderkey").alias("label"))
    return adapters.binetflow(raw).select(F.col("label").cast("long").alias("o_orderkey"), F.round("resp_bytes", 4).alias("resp_bytes"), F.round("bytes_ratio", 8).alias("bytes_ratio"))


@query("select event_id, case event_type when 'click' then 0 when 'view' then 0 when 'error' then 1 end as label from events where event_type in ('click','view','error')")
def label_map(spark, sf_dir):
    padded = table(spark, sf_dir, "events").withColumn("t", F.concat(F.lit(" "), "event_type", F.lit(" ")))
    return adapters.map_labels(padded, "t", {"click": 0, "view": 0, "error": 1, "purchase": -1}).select("event_id", "label")


@query("select s_suppkey as id, s_name as name, null::bigint as size from supplier union all select p_partkey, p_name, p_size from part")
def dataset_union(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""select event_type, count(*) as n, round(avg(value),6) as mean, round(stddev_pop(value),6) as std, round(min(value),6) as low, round(max(value),6) as high, round(median(value),6) as median, round(quantile_cont(value,0.25),6) as q25, round(quantile_cont(value,0.75),6) as q75, round(avg((value=0)::int),6) as zeros, round(case when stddev_pop(value)>0 and stddev_pop(user_id % 2)>0 then corr(value, (user_id % 2)::double) else 0e0 end,6) as pointbiserial from events group by 1""")
def class_summary(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.round(F.min(v), 6).alias("low"), F.round(F.max(v), 6).alias("high"), F.round(F.median(v), 6).alias("median"), *[F.round(F.percentile(v, F.lit(q)), 6).alias(f"q{round(100 * q)}") for q in (0.25, 0.75)],
        F.round(F.avg((v == 0).cast("int")), 6).alias("zeros"), F.round(metrics.correlation(v, (F.col("user_id") % 2).cast("double")), 6).alias("pointbiserial"),
    )


@query("""select round(regr_slope(m, c),8) as slope from (select chunk::double as c, avg(value) as m from (select value, floor((row_number() over (order by ts, event_id)-1)/(count(*) over ()/10)) as chunk from events) group by 1)""")
def temporal_slope(spark, sf_dir):
    e = order.with_row_number(table(spark, sf_dir, "events"), order.micros(F.col("ts")), ["ts", "event_id"])
    chunk = F.floor((F.col("_rn") - 1) / (F.col("_rn_total") / 10))
    return e.select("value", chunk.alias("chunk")).groupBy("chunk").agg(F.avg("value").alias("m")).agg(F.round(F.regr_slope("m", F.col("chunk").cast("double")), 8).alias("slope"))


@query("""select conv_id, count(*) as turns, string_agg(role, '>' order by turn) as roles, sum(length(text))::bigint as chars from conversations group by 1 having count(*)>=2""")
def sequence_builder(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("s"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("turns"))
    return c.where("turns >= 2").select("conv_id", "turns", F.array_join(F.transform("s", lambda x: x["role"]), ">").alias("roles"), "chars")


@query("""pivot (select event_type, case when value>5 then 'high' else 'low' end as b, 1 as one from events) on b in ('high','low') using sum(one)::bigint group by event_type""")
def pivot_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") > 5, "high").otherwise("low").alias("b"))
    return e.groupBy("event_type").pivot("b", ["high", "low"]).agg(F.count(F.lit(1)))


@query(f"""with x as (select label, predicted, score from {_C}), c as (select unnest([0,1,2,3])::bigint as cls),
 g as (select cls, (select count(*) from x where label=cls and predicted=cls) as tp, (select count(*) from x where label=cls) as actual, (select count(*) from x where predicted=cls) as called from c),
 f as (select cls, actual, called, tp, tp/called as p, tp/actual as r, 2*(tp/called)*(tp/actual)/((tp/called)+(tp/actual)) as f1 from g),
 a as (select sum(tp)/sum(actual) as po, sum(actual*called::double)/pow(sum(actual),2) as pe from g),
 s as (select score, count(*) filter (label>0) as pos, count(*) filter (label=0) as neg from x group by 1),
 t as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as p, sum(neg) over () as n from s window w as (order by score desc rows unbounded preceding)),
 m as (select 'precision' as metric, cls::varchar as cls, p as value from f union all select 'recall', cls::varchar, r from f union all select 'f1', cls::varchar, f1 from f union all select 'support', cls::varchar, actual::double from f
  union all select 'macro_f1', null, avg(f1) from f union all select 'weighted_f1', null, sum(f1*actual)/sum(actual) from f union all select 'accuracy', null, po from a union all select 'kappa', null, (po-pe)/(1-pe) from a
  union all select concat('predicted_', predicted), label::varchar, count(*)::double from x group by label, predicted
  union all select 'roc_auc', null, sum(neg*(tp-pos/2.0))/any_value(p*n::double) from t union all select 'average_precision', null, sum(pos/p*(tp/(tp+fp))) from t
  union all select 'brier', null, avg(pow(score-(label>0)::int,2)) from x)
 select metric, cls, round(value,6) as value from m""")
def evaluation_report(spark, sf_dir):
    r = metrics.evaluation_report(_classified(spark, sf_dir), "label", "predicted", "score")
    return r.select("metric", "cls", F.round("value", 6).alias("value"))
