"""Queries over scalar and array features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, common, fingerprint, net, strings
from ..operators import state
from ..sources.flowview import sparse_flows, table
from .registry import query

HOST = "regexp_extract(url, '://([^/?#]*)', 1)"
ENTROPY = "(select coalesce(-sum(c/n*log2(c/n)),0e0)+0e0 from (select count(*)::double c, sum(count(*)) over ()::double n from (select unnest({items}) x) group by x))"


def hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("q"))


@query("""select flow_id, src_ip, dst_ip, dst_port, orig_bytes, resp_bytes, orig_pkts, duration_s, round(payload_entropy,6) as payload_entropy,
  round(orig_bytes/(resp_bytes+1),6) as ratio_plus1, round(orig_bytes/greatest(resp_bytes,1),6) as ratio_floor1,
  case when resp_bytes>0 then round(orig_bytes/resp_bytes,6) else -1e0 end as ratio_sentinel, round(orig_bytes/(duration_s+1e-9),3) as bytes_per_sec from {flows}""")
def flow_projection(spark, sf_dir):
    f = sparse_flows(spark, sf_dir)
    o, r = F.col("orig_bytes"), F.col("resp_bytes")
    return f.select(
        "flow_id", "src_ip", "dst_ip", "dst_port", "orig_bytes", "resp_bytes", "orig_pkts", "duration_s", F.round("payload_entropy", 6).alias("payload_entropy"),
        F.round(common.ratio_plus1(o, r), 6).alias("ratio_plus1"), F.round(common.ratio_floor1(o, r), 6).alias("ratio_floor1"),
        F.when(r > 0, F.round(o / r, 6)).otherwise(F.lit(-1.0)).alias("ratio_sentinel"), F.round(common.ratio_eps(o, F.col("duration_s")), 3).alias("bytes_per_sec"),
    )


@query("""select flow_id, dst_ip, string_split(dst_ip,'.')[1]::bigint*16777216+string_split(dst_ip,'.')[2]::bigint*65536+string_split(dst_ip,'.')[3]::bigint*256+string_split(dst_ip,'.')[4]::bigint as n,
  dst_ip as back from {flows}""")
def ip_to_long(spark, sf_dir):
    n = net.ip_to_long(F.col("dst_ip"))
    return sparse_flows(spark, sf_dir).select("flow_id", "dst_ip", n.alias("n"), net.long_to_ip(n).alias("back"))


@query("""select flow_id, starts_with(dst_ip,'10.') or starts_with(dst_ip,'192.168.') or regexp_matches(dst_ip,'^172\\.(1[6-9]|2[0-9]|3[01])\\.') as internal,
  starts_with(dst_ip,'10.') or starts_with(dst_ip,'192.168.') or starts_with(dst_ip,'172.') as loose from {flows}""")
def rfc1918_flag(spark, sf_dir):
    return sparse_flows(spark, sf_dir).select("flow_id", net.is_internal(F.col("dst_ip")).alias("internal"), net.has_loose_internal_prefix(F.col("dst_ip")).alias("loose"))


@query("""with f as (select flow_id, dst_ip, string_split(dst_ip,'.')[1]::bigint*16777216+string_split(dst_ip,'.')[2]::bigint*65536+string_split(dst_ip,'.')[3]::bigint*256+string_split(dst_ip,'.')[4]::bigint as n from {flows}),
 c(cidr, lo, bits) as (values ('10.1.0.0/27',167837696::bigint,27),('198.51.100.8/29',3325256712::bigint,29),('8.8.8.8/32',134744072::bigint,32))
 select flow_id, cidr from f join c on n between lo and lo + (1::bigint << (32-bits)) - 1""")
def cidr_match(spark, sf_dir):
    nets = spark.createDataFrame([("10.1.0.0/27",), ("198.51.100.8/29",), ("8.8.8.8/32",)], "cidr string")
    low, high = net.cidr_bounds(F.col("cidr"))
    nets = nets.select("cidr", low.alias("lo"), high.alias("hi"))
    f = sparse_flows(spark, sf_dir).select("flow_id", net.ip_to_long(F.col("dst_ip")).alias("n"))
    return f.join(F.broadcast(nets), (F.col("n") >= F.col("lo")) & (F.col("n") <= F.col("hi"))).select("flow_id", "cidr")


@query(f"""select page_id, round({ENTROPY.format(items="string_split(q,'')")},6) as entropy,
  round(case when length(q)<2 then 0e0 else {ENTROPY.format(items="list_transform(range(1,length(q)), lambda i: q[i:i+1])")} end,6) as bigram_entropy
  from (select page_id, {HOST} as q from pages)""")
def string_entropy(spark, sf_dir):
    q = F.col("q")
    return hosts(spark, sf_dir).select("page_id", F.round(strings.string_entropy(q), 6).alias("entropy"), F.round(strings.bigram_entropy(q), 6).alias("bigram_entropy"))


_BIGRAMS = " + ".join(f"abs(len(list_filter(g, lambda x: x = '{b}'))::double/len(g) - {p}e0)" for b, p in strings.ENGLISH_BIGRAMS.items())


@query(f"""select page_id, round(case when length(q)<4 then 0e0 else {_BIGRAMS} end,6) as deviation
  from (select page_id, q, list_transform(range(1,length(q)), lambda i: q[i:i+1]) as g from (select page_id, {HOST} as q from pages))""")
def bigram_deviation(spark, sf_dir):
    return hosts(spark, sf_dir).select("page_id", F.round(strings.bigram_deviation(F.col("q")), 6).alias("deviation"))


@query(f"""select page_id, length(q) as dns_query_len, len(string_split(q,'.')) as dns_label_count, list_max(list_transform(string_split(q,'.'), lambda x: length(x))) as dns_max_label_len,
  len(list_distinct(string_split(q,''))) as dns_unique_chars,
  case when len(string_split(q,'.'))>2 then array_to_string(string_split(q,'.')[1:-3],'.') else string_split(q,'.')[1] end as subdomain,
  array_to_string(string_split(q,'.')[-2:],'.') as sld from (select page_id, lower({HOST}) as q from pages)""")
def dns_labels(spark, sf_dir):
    q = strings.normal_query(F.col("q"))
    f = strings.dns_features(F.col("q"))
    names = ("dns_query_len", "dns_label_count", "dns_max_label_len", "dns_unique_chars")
    return hosts(spark, sf_dir).select("page_id", *[f[n].cast("long").alias(n) for n in names], strings.subdomain(q).alias("subdomain"), strings.second_level(q).alias("sld"))


@query(f"""select page_id, round(length(regexp_replace(q,'[^aeiou]','','g'))/length(q),6) as vowels, round(length(regexp_replace(q,'[^0-9]','','g'))/length(q),6) as digits,
  round(length(regexp_replace(q,'[^-]','','g'))/length(q),6) as hyphens from (select page_id, lower({HOST}) as q from pages)""")
def dns_char_ratios(spark, sf_dir):
    q = F.lower("q")
    return hosts(spark, sf_dir).select("page_id", *[F.round(strings.share_of(q, c), 6).alias(n) for c, n in (("aeiou", "vowels"), ("0-9", "digits"), ("-", "hyphens"))])


@query("""select page_id, coalesce(list_max(list_transform(regexp_extract_all(u,'[0-9]+'), lambda x: length(x))),0) as digit_run, coalesce(list_max(list_transform(regexp_extract_all(u,'[a-z]+'), lambda x: length(x))),0) as alpha_run,
  coalesce(list_max(list_transform(regexp_extract_all(u,'[a-z]+|[0-9]+|[^a-z0-9]+'), lambda x: length(x))),0) as longest_run from (select page_id, lower(url) as u from pages)""")
def dns_runs(spark, sf_dir):
    u = F.lower("url")
    return table(spark, sf_dir, "pages").select("page_id", *[x.cast("long").alias(n) for x, n in ((strings.max_run(u, "0-9"), "digit_run"), (strings.max_run(u, "a-z"), "alpha_run"), (strings.longest_class_run(u), "longest_run"))])


@query("""select event_id, regexp_matches(k,'^[a-f0-9]{32,}$') or regexp_matches(k,'^[A-Za-z0-9+/]{20,}={0,2}$') or regexp_matches(k,'^[a-z0-9]{40,}$') or regexp_matches(k,'^\\d{1,3}-\\d{1,3}-\\d{1,3}-\\d{1,3}$') as tunnel
  from (select event_id, case event_id % 4 when 0 then md5(cast(event_id as varchar)) when 1 then concat('1-2-3-',cast(event_id%300 as varchar)) when 2 then event_type else substr(md5(props),1,19) end as k from events)""")
def tunnel_regex(spark, sf_dir):
    i = F.col("event_id")
    k = F.when(i % 4 == 0, F.md5(i.cast("string"))).when(i % 4 == 1, F.concat(F.lit("1-2-3-"), (i % 300).cast("string"))).when(i % 4 == 2, F.col("event_type")).otherwise(F.substring(F.md5("props"), 1, 19))
    return table(spark, sf_dir, "events").select("event_id", strings.matches_tunnel(k).alias("tunnel"))


@query(f"""select page_id, case when {ENTROPY.format(items="string_split(s,'')")} > 3.2e0 then 'entropy' when ml > 52 then 'label_length' when length(regexp_replace(s,'[^aeiou]','','g'))/length(s) < 0.03e0 and length(q) > 30 then 'vowels' end as reason
  from (select page_id, q, list_max(list_transform(string_split(q,'.'), lambda x: length(x))) as ml, case when len(string_split(q,'.'))>2 then array_to_string(string_split(q,'.')[1:-3],'.') else string_split(q,'.')[1] end as s
  from (select page_id, lower({HOST}) as q from pages))""")
def dns_heuristic(spark, sf_dir):
    return hosts(spark, sf_dir).select("page_id", strings.tunnel_reason(strings.dns_features(F.col("q")), 3.2).alias("reason"))


@query("""select o_orderkey, md5(concat_ws(',', cast(769 + o_orderkey % 4 as varchar), concat(cast(o_custkey % 50 as varchar),'-',cast(o_orderkey % 70 as varchar)), '10', '23', '0')) as ja3,
  substr(sha256(concat_ws(',', cast(o_custkey as varchar), o_orderstatus)),1,16) as quic from orders""")
def ja3_hash(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", fingerprint.ja3(769 + k % 4, F.array(c % 50, F.lit(2570), k % 70), F.array(F.lit(10), F.lit(6682)), F.array(F.lit(23)), F.array(F.lit(0))).alias("ja3"),
        fingerprint.quic_fingerprint(c, F.col("o_orderstatus")).alias("quic"),
    )


@query("""select o_orderkey, concat('t', case o_orderkey % 4 when 0 then '10' when 1 then '11' when 2 then '12' else '13' end, case when o_orderstatus='F' then 'd' else 'i' end, '0203_',
   substr(sha256(case when a<b then concat(cast(a as varchar),',',cast(b as varchar)) else concat(cast(b as varchar),',',cast(a as varchar)) end),1,12), '_', substr(sha256('43_h2'),1,12)) as ja4
  from (select *, o_custkey % 50 as a, 100 + o_orderkey % 70 as b from orders)""")
def ja4_hash(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sni = F.when(F.col("o_orderstatus") == "F", "a.example.com").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", fingerprint.ja4(769 + k % 4, sni, F.array(100 + k % 70, F.lit(2570).cast("long"), c % 50), F.array(F.lit(43), F.lit(0), F.lit(16)), F.array(F.lit("h2"))).alias("ja4"))


@query("""select event_id, concat('t', case event_id % 2 when 0 then '12' else '13' end, 'd010a_', substr(sha256(event_type),1,12), '_', substr(sha256('x25519h2'),1,12)) as ja4 from events""")
def ja4_log(spark, sf_dir):
    version = F.when(F.col("event_id") % 2 == 0, "TLSv1.2").otherwise("TLSv1.3")
    return table(spark, sf_dir, "events").select("event_id", fingerprint.ja4_from_log(version, F.lit("a.b"), F.col("event_type"), F.lit("x25519"), F.lit("h2")).alias("ja4"))


@query("""select o_orderkey, ((concat('0x',substr(md5(cast(o_orderkey as varchar)),1,16))::ubigint::hugeint % 10) * 6 + (concat('0x',substr(md5(cast(o_orderkey as varchar)),17,16))::ubigint::hugeint % 10)) % 10 as part from orders""")
def md5_partition(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.md5_bucket(F.col("o_orderkey").cast("string")).cast("long").alias("part"))


_SERIES = "select src_ip, list(iat order by ts, flow_id) as a from (select *, date_diff('microsecond', lag(ts) over (partition by src_ip order by ts, flow_id), ts)/1e6 as iat from {flows}) where iat is not null group by src_ip"


def intervals(spark, sf_dir):
    """Intervals of each source in seconds, oldest first."""
    f = sparse_flows(spark, sf_dir).withColumn("iat", state.interval("ts", ["src_ip"], ["ts", "flow_id"])).where("iat is not null")
    return f.groupBy("src_ip").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "flow_id", "iat"))), lambda x: x["iat"]).alias("a"))


@query(f"""select src_ip, round(avg(x),3) as mean, round(stddev_pop(x),3) as std, round(min(x),6) as low, round(max(x),6) as high, round(quantile_disc(x,0.5),6) as median, round(case when avg(x)>0 then stddev_pop(x)/avg(x) else 0e0 end,6) as cv,
  round(case when count(*)>=4 and stddev_pop(x)>0 then avg(power((x-m)/s,3)) else 0e0 end,5) as skew, round(case when count(*)>=4 and stddev_pop(x)>0 then avg(power((x-m)/s,4))-3 else 0e0 end,4) as kurt
  from (select src_ip, x, avg(x) over (partition by src_ip) as m, stddev_pop(x) over (partition by src_ip) as s from (select src_ip, unnest(a) as x from ({_SERIES}))) group by src_ip""")
def interval_stats(spark, sf_dir):
    # Aggregates of the lag column: no source's intervals are gathered into one row.
    f = sparse_flows(spark, sf_dir).withColumn("x", state.interval("ts", ["src_ip"], ["ts", "flow_id"])).where("x is not null")
    x, sd, some = F.col("x"), F.stddev_pop("x"), (F.count("x") >= 4) & (F.stddev_pop("x") > 0)
    cols = {
        "mean": (F.avg(x), 3), "std": (sd, 3), "low": (F.min(x), 6), "high": (F.max(x), 6), "median": (F.expr("percentile_disc(0.5) within group (order by x)"), 6), "cv": (F.when(F.avg(x) > 0, sd / F.avg(x)).otherwise(0.0), 6),
        "skew": (F.when(some, F.skewness(x)).otherwise(0.0), 5), "kurt": (F.when(some, F.kurtosis(x)).otherwise(0.0), 4),
    }
    return f.groupBy("src_ip").agg(*[F.round(c, n).alias(k) for k, (c, n) in cols.items()])


_EMB = "select vec_id, cast(unnest(embedding) as double)*8000 as x, unnest(range(len(embedding))) as i from embeddings"


@query(f"""with c as (select vec_id, i, x - avg(x) over (partition by vec_id) as d, avg(x) over (partition by vec_id) as m from ({_EMB})),
 p as (select vec_id, sum(d*d) as p, any_value(m) as m from c group by vec_id),
 r as (select a.vec_id, b.i-a.i as lag, sum(a.d*b.d) as s from c a join c b on a.vec_id=b.vec_id and b.i>a.i group by all)
 select vec_id, round(greatest(0e0, max(s/p)),5) as score, round(arg_max(lag, s/p)*any_value(m),3) as period from r join p using (vec_id) group by vec_id""")
def acf_periodicity(spark, sf_dir):
    a = F.transform("embedding", lambda x: x.cast("double") * 8000)
    p = table(spark, sf_dir, "embeddings").select("vec_id", arrays.periodicity(a).alias("p"))
    return p.select("vec_id", F.round("p.score", 5).alias("score"), F.round("p.period", 3).alias("period"))


@query(f"""select vec_id, round(coalesce(-sum(c/n*log2(c/n+1e-9)),0e0),6) as entropy from (select vec_id, count(*)::double as c, sum(count(*)) over (partition by vec_id)::double as n
  from (select vec_id, least(floor(x/93.75e0),15) as b from ({_EMB}) where x between 0 and 1500) group by vec_id, b) group by vec_id
  union all select vec_id, 0e0 from embeddings where len(list_filter(embedding, lambda v: cast(v as double)*8000 between 0 and 1500)) = 0""")
def hist_entropy(spark, sf_dir):
    a = F.transform("embedding", lambda x: x.cast("double") * 8000)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.histogram_entropy(a), 6).alias("entropy"))


@query(f"""select vec_id, round(avg((x<100)::int),6) as small, round(avg((x>1400)::int),6) as large, round(avg((x<10)::int),6) as burst from ({_EMB}) group by vec_id""")
def size_ratios(spark, sf_dir):
    a = F.transform("embedding", lambda x: x.cast("double") * 8000)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(arrays.small_ratio(a), 6).alias("small"), F.round(arrays.large_ratio(a), 6).alias("large"), F.round(arrays.burst_ratio(a), 6).alias("burst"))


@query("""select event_id, (select k from (values (1,60),(2,300),(3,3600),(4,30),(5,120),(6,10)) v(o,k) where abs(value*10-k)/k < 0.35e0 order by o limit 1) as known from events""")
def known_interval_match(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", arrays.known_interval(F.col("value") * 10).alias("known"))


@query("""select vec_id, list_transform(list_sort(list_transform(range(len(embedding)), lambda i: {'v': -cast(embedding[i+1] as double), 'i': i}))[1:5], lambda s: s.i)::varchar as places from embeddings""")
def attention_top5(spark, sf_dir):
    top = arrays.top_k(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join(F.transform(top, lambda s: s["place"].cast("string")), ", "), F.lit("]")).alias("places"))


@query()
def fft_period(spark, sf_dir):
    return intervals(spark, sf_dir).select("src_ip", arrays.fft_period("a").alias("period"))


@query()
def acf_findpeaks(spark, sf_dir):
    return intervals(spark, sf_dir).select("src_ip", arrays.peak_period("a").alias("p")).select("src_ip", "p.*")
