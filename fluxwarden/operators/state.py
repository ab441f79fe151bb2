"""Keyed state as window functions: what a counter or set held when each row had been seen.

Epoch-aligned windows are running aggregates per (key, bucket); idle-timeout state is a running aggregate per gap session;
lists of the last N are row frames. Every frame ends at the current row unless said otherwise. Order ties are broken by
the given id, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .storage import written


def seconds(ts: Column) -> Column:
    """Epoch seconds with fractions."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def bucket(ts: Column, width_s: int) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / (width_s * 1_000_000)).cast("long")


def running(keys: list, order: list) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_count(keys: list, order: list) -> Column:
    return F.count("*").over(running(keys, order))


def with_running_distinct(df: DataFrame, name: str, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` plus the exact number of distinct values so far per key. A value counts at its first row, so the state is a flag
    and a sum, not a set per row."""
    first = F.when((F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order)) == 1) & F.col(value).isNotNull(), 1).otherwise(0)
    return df.withColumn("_first", first).withColumn(name, F.sum("_first").over(running(keys, order))).drop("_first")


def with_gap_session(df: DataFrame, name: str, keys: list[str], ts: str, order: list[str], gap_s: float, slice_s: int | None = None) -> DataFrame:
    """``df`` plus the number of its idle-timeout session: a new one begins when over ``gap_s`` seconds have passed. With ``slice_s``, a key's
    rows are sorted in slices of so many seconds, a task each, and only a row per slice is put in order to join them: for keys that hold much of the
    table. ``order`` must begin with the time. The numbers are the same."""
    if slice_s is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        idle = seconds(F.col(ts)) - seconds(F.lag(ts).over(w))
        fresh = F.when(idle.isNull() | (idle > gap_s), 1).otherwise(0)
        return df.withColumn("_new", fresh).withColumn(name, F.sum("_new").over(running(keys, order))).drop("_new")
    d = df.withColumn("_slice", bucket(F.col(ts), slice_s))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    idle = seconds(F.col(ts)) - seconds(F.lag(ts).over(local))
    d = d.withColumn("_new", F.when(idle > gap_s, 1).otherwise(0))  # a slice's first row is decided below
    per = d.groupBy(*keys, "_slice").agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.sum("_new").alias("_inside"))
    w = Window.partitionBy(*keys).orderBy("_slice")
    since = seconds(F.col("_from")) - seconds(F.lag("_to").over(w))
    per = per.withColumn("_opens", F.when(since.isNull() | (since > gap_s), 1).otherwise(0))
    before = F.coalesce(F.sum(F.col("_inside") + F.col("_opens")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_opens")
    per = per.select(*keys, "_slice", before.alias("_before"))
    per = per.withColumnsRenamed({k: f"_of_{k}" for k in (*keys, "_slice")})
    d = d.join(per, [d[k].eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "_slice")])
    return d.withColumn(name, F.sum("_new").over(local.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")).select(*df.columns, name)


def with_running_count(df: DataFrame, name: str, keys: list[str], ts: str, order: list[str], slice_s: int) -> DataFrame:
    """``df`` plus ``running_count`` by slices of time, as in ``with_gap_session``."""
    d = df.withColumn("_slice", bucket(F.col(ts), slice_s))
    per = d.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"_of_{k}") for k in (*keys, "_slice")], F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    d = d.join(per, [d[k].eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "_slice")])
    return d.withColumn(name, running_count([*keys, "_slice"], order) + F.col("_before")).select(*df.columns, name)


def with_running(df: DataFrame, sums: dict[str, Column], keys: list[str], ts: str, order: list[str], slice_s: int, latest: dict[str, Column] | None = None) -> DataFrame:
    """``df`` plus running sums per key, the current row included, and for each name in ``latest`` the greatest value of the key's rows that are earlier in
    time. A key's rows are sorted in slices of time, a task each; a row per slice carries the sums and the greatest values on. ``order`` must begin with the time."""
    latest = latest or {}
    d = df.withColumn("_slice", bucket(F.col(ts), slice_s)).withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumns({f"_of_{n}": c for n, c in (sums | latest).items()})
    per = d.groupBy(*keys, "_slice").agg(*[(F.sum if n in sums else F.max)(f"_of_{n}").alias(n) for n in (*sums, *latest)])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, "_slice")], *[(F.sum if n in sums else F.max)(n).over(before).alias(f"_before_{n}") for n in (*sums, *latest)])
    d = d.join(per, [d[k].eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_slice")])
    local = running([*keys, "_slice"], order)
    earlier = Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    out = {n: F.coalesce(F.sum(f"_of_{n}").over(local), F.lit(0)) + F.coalesce(f"_before_{n}", F.lit(0)) for n in sums}
    return d.withColumns(out | {n: F.greatest(F.max(f"_of_{n}").over(earlier), F.col(f"_before_{n}")) for n in latest}).select(*df.columns, *out, *latest)


def with_idle_counts(df: DataFrame, names: dict[str, int], keys: list[str], ts: str, order: list[str]) -> DataFrame:
    """``df`` plus, for each name, the value of a counter per key that is set back when it has been idle for so many seconds."""
    for name, gap in names.items():
        df = with_gap_session(df, "_idle", keys, ts, order, gap).withColumn(name, running_count([*keys, "_idle"], order)).drop("_idle")
    return df


def sliding_count(keys: list, ts: str, window_s: int) -> Column:
    """Rows with t > now - window, the current one (and its equals) included: the lower bound is exclusive."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.count("*").over(Window.partitionBy(*keys).orderBy(micros).rangeBetween(-window_s * 1_000_000 + 1, 0))


def history(fields: list[str], keys: list, order: list, n: int, include_current: bool = True) -> Column:
    """The last n rows as an array of structs, oldest first."""
    last = Window.currentRow if include_current else -1
    first = -(n - 1) if include_current else -n
    return F.collect_list(F.struct(*fields)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(first, last))


def history_within(fields: list[str], keys: list, ts: str, order: list, n: int, ttl_s: float) -> Column:
    """The last n rows that are at most ``ttl_s`` seconds older than the current one, oldest first; structs of the fields and their time in microseconds, ``_us``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), Window.currentRow)
    now = F.unix_micros(F.col(ts).cast("timestamp"))
    return F.filter(F.collect_list(F.struct(*fields, now.alias("_us"))).over(w), lambda x: x["_us"] >= now - F.lit(int(ttl_s * 1_000_000)))


def newest_times(df: DataFrame, keys: list[str], ts: str, n: int = 200, ttl_s: float = 3600) -> DataFrame:
    """A row for each key and time: the newest n distinct times that are at most ``ttl_s`` seconds old, in microseconds, oldest first. Rows of one time
    meet before the window, whose frame is n rows, so a busy key costs no more than n numbers a row."""
    per = df.select(*keys, F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).distinct()
    w = Window.partitionBy(*keys).orderBy("us").rowsBetween(-(n - 1), Window.currentRow)
    return per.withColumn("times", F.filter(F.collect_list("us").over(w), lambda t: t >= F.col("us") - F.lit(int(ttl_s * 1_000_000))))


def read_once(df: DataFrame, fields: list[str], reads: str, keys: list[str], ts: str, order: list[str], n: int = 200, ttl_s: float = 120) -> DataFrame:
    """The reading rows of ``df`` (``reads`` true) plus packets: the newest n rows put in since the key was last read, structs of the fields, oldest
    first; none once ``ttl_s`` seconds have passed since the last of them. A reading ends a stretch of rows, and so does an idle time, so what a reading
    takes is a frame of n rows of its own stretch."""
    w = Window.partitionBy(*keys).orderBy(*order)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    took = F.coalesce(F.lag(reads).over(w), F.lit(False))
    idle = us - F.lag(us).over(w) >= F.lit(int(ttl_s * 1_000_000))
    d = df.withColumn(reads, F.coalesce(F.col(reads), F.lit(False))).withColumn("_new", F.when(took | idle, 1).otherwise(0))
    d = d.withColumn("_stretch", F.sum("_new").over(running(keys, order)))
    held = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(-n, -1)
    return d.withColumn("packets", F.collect_list(F.struct(*fields)).over(held)).where(F.col(reads)).drop("_new", "_stretch")


def interval(ts: str, keys: list, order: list) -> Column:
    """Seconds since the key's last row."""
    return seconds(F.col(ts)) - seconds(F.lag(ts).over(Window.partitionBy(*keys).orderBy(*order)))


def with_latest(df: DataFrame, fields: dict[str, str], keys: list, order: list[str]) -> DataFrame:
    """``df`` plus, for each name, what the key's last row before this one had in a column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({name: F.lag(c).over(w) for name, c in fields.items()})


def with_first_seen(df: DataFrame, name: str, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` plus whether the value is new for the key while the key itself isn't."""
    new = F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order)) == 1
    known = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1
    return df.withColumn(name, new & known)


def timeline(df: DataFrame, ts: str, width_s: int, first: int, last: int) -> DataFrame:
    """bucket, n for each bucket from first to last, zero where there are no rows."""
    spine = df.sparkSession.range(first, last + 1).select(F.col("id").alias("bucket"))
    counted = df.groupBy(bucket(F.col(ts), width_s).alias("bucket")).agg(F.count("*").alias("n"))
    return spine.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def trailing_buckets(df: DataFrame, ts: str, now: Column, width_s: int = 300, buckets: int = 12) -> DataFrame:
    """start (epoch second), n for each of the last buckets before ``now``, oldest first; both ends of a bucket count, zero where there are no rows."""
    spine = df.sparkSession.range(buckets).select((F.col("id") - buckets).alias("k")).withColumn("start", seconds(now) + F.col("k") * width_s)
    # A row stands in the bucket that its second falls into, and on an edge in the one before as well.
    at = (seconds(F.col(ts)) - seconds(now)) / width_s
    slots = F.array_distinct(F.array(F.floor(at), F.ceil(at) - 1))
    counted = df.select(F.explode(slots).alias("k")).where(F.col("k").between(-buckets, -1)).groupBy("k").agg(F.count("*").alias("n"))
    return spine.join(F.broadcast(counted), "k", "left").select(F.floor("start").cast("long").alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


def trailing_rate(df: DataFrame, ts: str, width: int = 5) -> DataFrame:
    """second, rate: whole-number mean of the counts of the last ``width`` seconds, absent seconds being zero. Each count is
    given to the seconds that see it, so nothing is ordered over all time."""
    per = df.groupBy(bucket(F.col(ts), 1).alias("second")).agg(F.count("*").alias("n"))
    near = per.select("n", F.explode(F.sequence(F.col("second"), F.col("second") + (width - 1))).alias("second"))
    return near.groupBy("second").agg(F.floor(F.sum("n") / width).cast("long").alias("rate"))


def _next_times(times: DataFrame, ahead_us: int, slice_s: float) -> DataFrame:
    """``times`` (_k, us) plus nxt, the key's first time that is at least ``ahead_us`` later, and opens, whether none is less than ``ahead_us`` before it. Slices of
    a key are sorted by tasks of their own; a row per slice carries the nearest times over."""
    width = int(slice_s * 1_000_000)
    marks = F.array(F.struct(F.col("us").alias("t"), F.lit(True).alias("real")), F.struct((F.col("us") + ahead_us).alias("t"), F.lit(False).alias("real")))
    d = times.select("_k", "us", F.explode(marks).alias("m")).select("_k", "us", "m.*").withColumn("_slice", F.floor(F.col("t") / width))
    per = d.where("real").groupBy("_k", "_slice").agg(F.min("t").alias("_from"), F.max("t").alias("_to"))
    # The nearest slices that hold rows, for every slice that holds rows or marks.
    per = d.select("_k", "_slice").distinct().join(per, ["_k", "_slice"], "left")
    by_slice = Window.partitionBy("_k").orderBy("_slice")
    later = F.min("_from").over(Window.partitionBy("_k").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("_k", "_slice", later.alias("_later"), F.max("_to").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    d = d.join(per, ["_k", "_slice"])
    down = Window.partitionBy("_k", "_slice").orderBy(F.desc("t"), F.desc("real")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy("_k", "_slice").orderBy("t", "real").rowsBetween(Window.unboundedPreceding, -1)
    real = F.when(F.col("real"), F.col("t"))
    d = d.withColumns({"nxt": F.coalesce(F.min(real).over(down), F.col("_later")), "_last": F.coalesce(F.max(real).over(up), F.col("_earlier"))})
    return d.groupBy("_k", "us").agg(F.max(F.when(~F.col("real"), F.col("nxt"))).alias("nxt"), F.max(F.when(F.col("real"), F.col("_last"))).alias("_last")).select(
        "_k", "us", "nxt", (F.col("_last").isNull() | (F.col("us") - F.col("_last") >= ahead_us)).alias("opens")
    )


def dedup_ttl(df: DataFrame, key: str, ts: str, order: list[str], ttl_s: float, slice_s: float | None = None) -> DataFrame:
    """Rows that pass a set-if-absent key with a time to live that later rows don't refresh: greedy from the first row. A row that comes the time to live or more
    after all earlier ones always passes, which cuts a key into islands; in an island the row after a passing one is the first that is the time to live later, so rows
    are linked to that one, and the passing rows are those that an island's first row reaches. They are found by doubling the links' reach: log2 of an island's
    length joins, whatever the key. Of the rows of a key and time only the first by ``order`` can pass. Rows without a time don't pass; null is a key like others."""
    ttl = int(ttl_s * 1_000_000)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = df.where(F.col(ts).isNotNull()).groupBy(F.struct(F.col(key).alias("key")).alias("_k"), us.alias("us")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
    rows = written(rows, "times")
    times = written(_next_times(rows.select("_k", "us"), ttl, slice_s or 64 * ttl_s), "next")
    opens = times.where("opens").select("_k", "us")
    far = times.where("nxt is not null").select("_k", "us", F.col("nxt").alias("up")).join(opens.select(F.col("_k"), F.col("us").alias("up")), ["_k", "up"], "left_anti")
    levels = [written(far.select("_k", "us", "up"), "links")]
    while not levels[-1].isEmpty():
        over = levels[-1].select("_k", F.col("us").alias("up"), F.col("up").alias("_up"))
        levels.append(written(levels[-1].join(over, ["_k", "up"]).select("_k", "us", F.col("_up").alias("up")), "links"))
    passing = opens
    for level in reversed(levels[:-1]):
        passing = passing.join(level, ["_k", "us"], "left").select("_k", F.explode(F.array_compact(F.array("us", "up"))).alias("us"))
    return rows.join(passing, ["_k", "us"]).select("_row.*")
