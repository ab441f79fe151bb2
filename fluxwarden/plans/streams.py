"""Keyed streams and their batch forms on events, with the SQL of the batch form; a stream gives the rows that its watermark, a day behind the last event, has passed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state
from ..sources.flowview import table
from ..streaming import handshake, keyed
from .models import _streamed
from .registry import query

LATE, DAY = "1 day", 86400
PASSED = "ts < (select max(ts) - interval 1 day from events)"


def stream(spark, sf_dir, transform):
    keyed.use_rocksdb(spark)
    return _streamed(spark, sf_dir, transform)


@query(f"""with s as (select *, case when epoch_us(ts)-lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) <= 86400000000 then 0 else 1 end as new from events),
 g as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from s)
 select event_id, user_id::varchar as key, n, first, total from (select ts, event_id, user_id, count(*) over w as n, first(event_id) over w as first, sum(event_id) over w::bigint as total from g window w as (partition by user_id, session order by ts, event_id rows 14 preceding)) where {PASSED}""")
def stream_history(spark, sf_dir):
    h = stream(spark, sf_dir, lambda s: keyed.history(s, ["event_id"], "user_id", order="event_id", n=15, idle_s=DAY, late=LATE))
    total = F.aggregate("history", F.lit(0).cast("long"), lambda a, x: a + x["event_id"])
    return h.select(F.col("id").alias("event_id"), "key", F.size("history").cast("long").alias("n"), F.col("history")[0]["event_id"].alias("first"), total.alias("total"))


@query(f"""select event_id, user_id::varchar as key, new from (select *, row_number() over (partition by user_id, event_type order by ts, event_id)=1 and row_number() over (partition by user_id order by ts, event_id)>1 as new from events) where {PASSED}""")
def stream_first_seen(spark, sf_dir):
    return stream(spark, sf_dir, lambda s: keyed.first_seen(s, "event_type", "user_id", order="event_id", late=LATE)).select(F.col("id").alias("event_id"), "key", "new")


@query(f"""select event_id, user_id::varchar as key, n from (select *, count(*) over (partition by user_id order by epoch_us(ts) range between 43199999999 preceding and current row) as n from events) where {PASSED}""")
def stream_sliding_count(spark, sf_dir):
    return stream(spark, sf_dir, lambda s: keyed.sliding_count(s, "user_id", order="event_id", window_s=DAY / 2, late=LATE)).select(F.col("id").alias("event_id"), "key", "n")


_NEWEST = """(select user_id, us, len(t) as n, t[1] as oldest, list_sum(list_transform(t, lambda x: us-x))::bigint as age from (select user_id, us, list_filter(list(us) over (partition by user_id order by us rows {frame} preceding), lambda x: x >= us-{ttl}) as t from (select distinct user_id, epoch_us(ts) as us from events)))"""


def _ages(df):
    return F.size("times").cast("long").alias("n"), F.col("times")[0].alias("oldest"), F.aggregate("times", F.lit(0).cast("long"), lambda a, t: a + F.element_at("times", -1) - t).alias("age")


@query("select user_id, us, n, oldest, age from " + _NEWEST.format(frame=199, ttl=604800000000))
def beacon_history_newest(spark, sf_dir):
    d = state.newest_times(table(spark, sf_dir, "events"), ["user_id"], "ts", 200, 7 * DAY)
    return d.select("user_id", "us", *_ages(d))


@query(f"""select event_id, e.user_id::varchar as key, n, oldest, age from events e join {_NEWEST.format(frame=9, ttl=259200000000)} t on t.user_id=e.user_id and t.us=epoch_us(e.ts) where {PASSED}""")
def stream_newest_times(spark, sf_dir):
    d = stream(spark, sf_dir, lambda s: keyed.newest_times(s, "user_id", order="event_id", n=10, ttl_s=3 * DAY, late=LATE))
    return d.select(F.col("id").alias("event_id"), "key", *_ages(d))


_READ = """(with s as (select *, event_type='purchase' as reads, case when lag(event_type) over k = 'purchase' or epoch_us(ts)-lag(epoch_us(ts)) over k >= 172800000000 then 1 else 0 end as new from events window k as (partition by user_id order by ts, event_id)),
 g as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as stretch from s)
 select * from (select ts, event_id, user_id, reads, count(*) over w as n, coalesce(sum(event_id) over w,0)::bigint as total from g window w as (partition by user_id, stretch order by ts, event_id rows between 5 preceding and 1 preceding)) where reads)"""


def _packets(d):
    return F.size("packets").cast("long").alias("n"), F.aggregate("packets", F.lit(0).cast("long"), lambda a, x: a + x["event_id"]).alias("total")


@query("select event_id, user_id, n, total from " + _READ)
def packet_buffer(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("reads", F.col("event_type") == "purchase")
    d = state.read_once(e, ["event_id"], "reads", ["user_id"], "ts", ["ts", "event_id"], 5, 2 * DAY)
    return d.select("event_id", "user_id", *_packets(d))


@query(f"select event_id, user_id::varchar as key, n, total from {_READ} where {PASSED}")
def stream_packet_buffer(spark, sf_dir):
    d = stream(spark, sf_dir, lambda s: keyed.read_once(s.withColumn("reads", F.col("event_type") == "purchase"), ["event_id"], "reads", "user_id", order="event_id", n=5, ttl_s=2 * DAY, late=LATE))
    return d.select(F.col("id").alias("event_id"), "key", *_packets(d))


def hello_packets(events):
    """Three packets of each event's own connection: the second part of a client's hello, then the first, then one without payload, a tenth of a second apart."""
    i = F.col("event_id")
    hexed = lambda n, width: F.lpad(F.hex(n), width, "0")
    sni = F.concat(F.col("event_type"), F.lit(".example.com"))
    n, size = 1 + i % 5, F.length(sni)
    name = F.concat(F.lit("0000"), hexed(size + 5, 4), hexed(size + 3, 4), F.lit("00"), hexed(size, 4), F.hex(sni.cast("binary")))
    body = F.concat(F.lit("0303" + "00" * 33), hexed(2 * n, 4), F.expr("repeat('C02B', cast(1 + event_id % 5 as int))"), F.lit("0100"), hexed(size + 9, 4), name)
    length = F.length(body) / 2
    raw = F.unhex(F.concat(F.lit("160301"), hexed((length + 4).cast("long"), 4), F.lit("01"), hexed(length.cast("long"), 6), body))
    d = events.select("event_id", "ts", raw.alias("raw"), (5 + i % 40).cast("int").alias("cut"))
    parts = F.array(*[F.struct(F.lit(k).alias("k"), seq.cast("long").alias("seq"), data.alias("payload")) for k, (seq, data) in enumerate(((1000 + F.col("cut"), F.substring("raw", F.col("cut") + 1, F.length("raw"))), (F.lit(1000), F.substring("raw", F.lit(1), F.col("cut"))), (F.lit(2000), F.lit(None).cast("binary"))))])
    d = d.select("event_id", "ts", F.explode(parts).alias("p"))
    return d.select((i * 3 + F.col("p.k")).alias("packet_id"), (F.col("ts").cast("timestamp") + F.expr("make_dt_interval(0, 0, 0, p.k / 10.0)")).alias("ts"), F.concat(F.lit("10.0.0."), i.cast("string")).alias("src_ip"), F.lit(5000).alias("src_port"), F.lit("9.9.9.9").alias("dst_ip"), F.lit(443).alias("dst_port"), "p.seq", "p.payload")


@query("""select event_id*3+k as packet_id, concat(event_type,'.example.com') as sni, md5(concat('771,',rtrim(repeat('49195-',(1+event_id % 5)::int),'-'),',0,,')) as ja3 from events, (select unnest([1,2])::bigint as k)
  union all select event_id*3, null, null from events""")
def tls_sessions(spark, sf_dir):
    d = handshake.with_fingerprints(handshake.sessions(hello_packets(table(spark, sf_dir, "events"))))
    return d.select(F.col("id").alias("packet_id"), "sni", "ja3")
