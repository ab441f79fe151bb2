"""Structured Streaming twins of the batch state: the same results on event time, with a watermark that the batch form doesn't need.

A late row is one behind the watermark (ten minutes by default); it is dropped, which is a declared difference from the batch form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "10 minutes"


def _timed(stream: DataFrame, ts: str, late: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling_counts(stream: DataFrame, keys: list[str], ts: str = "ts", width: str = "60 seconds", late: str = LATE) -> DataFrame:
    """Rows, and distinct ports and hosts, of each key in each epoch-aligned window."""
    g = _timed(stream, ts, late).groupBy(F.window(ts, width), *keys)
    return g.agg(F.count("*").alias("n"), F.approx_count_distinct("dst_port").alias("ports"), F.approx_count_distinct("dst_ip").alias("hosts")).select(F.col("window.start").alias("start"), *keys, "n", "ports", "hosts")


def timeline(stream: DataFrame, ts: str = "ts", width: str = "5 minutes", late: str = LATE) -> DataFrame:
    return _timed(stream, ts, late).groupBy(F.window(ts, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def gap_sessions(stream: DataFrame, keys: list[str], ts: str = "ts", gap: str = "300 seconds", late: str = LATE) -> DataFrame:
    """Totals of each idle-timeout session."""
    g = _timed(stream, ts, late).groupBy(F.session_window(ts, gap), *keys)
    return g.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *keys, "n")


def dedup(stream: DataFrame, key: str, ts: str = "ts", ttl: str = "600 seconds") -> DataFrame:
    """First row of each key; later ones within the time to live go."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def running_alerts(stream: DataFrame, key: str, ts: str = "ts", width_s: int = 60, threshold: int = 10) -> DataFrame:
    """A row for every event whose key has reached the threshold in its window, that event included. State is one bucket number
    and count per key; it goes when the watermark (ten minutes behind) is two windows past the key's last one."""

    def step(k: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket, count = state.get if state.exists else (-1, 0)
        out = []
        rows = pd.concat(list(pages)).sort_values(["_us", "event_id"])
        for us, event in zip(rows["_us"].tolist(), rows["event_id"].tolist(), strict=True):
            b = us // (width_s * 1_000_000)
            if b > bucket:
                bucket, count = b, 0
            if b == bucket:
                count += 1
                if count >= threshold:
                    out.append((k[0], event, count))
        state.update((bucket, count))
        state.setTimeoutTimestamp(max((bucket + 2) * width_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "event_id", "n"])

    d = _timed(stream, ts, LATE).select(F.col(key).cast("string").alias("key"), "event_id", F.col(ts), F.unix_micros(ts).alias("_us"))
    return d.groupBy("key").applyInPandasWithState(step, "key string, event_id bigint, n bigint", "bucket bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def page_hinkley(stream: DataFrame, key: str, value: str, delta: float = 0.005, limit: float = 50.0) -> DataFrame:
    """Drift of a value's mean per key: fires when its cumulated rise over the running mean exceeds the limit, then begins anew."""

    def step(k: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, mean, total, low = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        out = []
        rows = pd.concat(list(pages)).sort_values("event_id")
        for event, x in zip(rows["event_id"].tolist(), rows["x"].tolist(), strict=True):
            n += 1
            mean += (x - mean) / n
            total += x - mean - delta
            low = min(low, total)
            if total - low > limit:
                out.append((k[0], event, total - low))
                n, mean, total, low = 0, 0.0, 0.0, 0.0
        state.update((n, mean, total, low))
        yield pd.DataFrame(out, columns=["key", "event_id", "rise"])

    d = stream.select(F.col(key).cast("string").alias("key"), "event_id", F.col(value).cast("double").alias("x"))
    return d.groupBy("key").applyInPandasWithState(step, "key string, event_id bigint, rise double", "n bigint, mean double, total double, low double", "append", GroupStateTimeout.NoTimeout)


class Adwin:
    """A window over values from 0 to 1 that drops its old part when the means of old and new differ by more than chance allows. Kept as buckets of
    2 ** k values, ``per`` of each size at most, so its size grows with the logarithm of the window."""

    def __init__(self, delta: float = 0.002, per: int = 5, buckets: list | None = None):
        self.delta, self.per, self.buckets = delta, per, [tuple(b) for b in buckets or []]  # (values, their sum), newest first

    def add(self, x: float) -> bool:
        self.buckets.insert(0, (1, x))
        at = size = 0
        while at < len(self.buckets):  # the two oldest of a size that has too many become one of the next
            same = [i for i in range(at, len(self.buckets)) if self.buckets[i][0] == 1 << size]
            if len(same) <= self.per:
                break
            a, b = same[-2:]
            self.buckets[a : b + 1] = [(self.buckets[a][0] * 2, self.buckets[a][1] + self.buckets[b][1])]
            at, size = a, size + 1
        return self._cut()

    def _cut(self) -> bool:
        found = False
        while len(self.buckets) > 1:
            n, total = sum(b[0] for b in self.buckets), sum(b[1] for b in self.buckets)
            mean = total / n
            spread, log = mean * (1 - mean), math.log(2 * math.log(max(n, 3)) / self.delta)
            new, new_sum = 0, 0.0
            for c, s in self.buckets[:-1]:
                new, new_sum = new + c, new_sum + s
                old = n - new
                if min(new, old) < 5:
                    continue
                m = 1 / (1 / new + 1 / old)
                if abs(new_sum / new - (total - new_sum) / old) > math.sqrt(2 / m * spread * log) + 2 / (3 * m) * log:
                    break
            else:
                return found
            self.buckets.pop()
            found = True
        return found


def adwin(stream: DataFrame, key: str, value: str, delta: float = 0.002) -> DataFrame:
    """Drift of an error rate per key: an event with the window's new mean where its old part was dropped."""

    def step(k: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        counts, sums = state.get if state.exists else ([], [])
        w, out = Adwin(delta, buckets=list(zip(counts, sums, strict=True))), []
        rows = pd.concat(list(pages)).sort_values("event_id")
        for event, x in zip(rows["event_id"].tolist(), rows["x"].tolist(), strict=True):
            if w.add(x):
                out.append((k[0], event, sum(b[1] for b in w.buckets) / sum(b[0] for b in w.buckets)))
        state.update(([b[0] for b in w.buckets], [b[1] for b in w.buckets]))
        yield pd.DataFrame(out, columns=["key", "event_id", "mean"])

    d = stream.select(F.col(key).cast("string").alias("key"), "event_id", F.col(value).cast("double").alias("x"))
    return d.groupBy("key").applyInPandasWithState(step, "key string, event_id bigint, mean double", "counts array<bigint>, sums array<double>", "append", GroupStateTimeout.NoTimeout)


def with_rules(stream: DataFrame, read_rules, apply, write) -> object:
    """A writer that reads the suppression rules anew for each micro-batch, so that changed rules hold from the next one on: ``write(apply(batch,
    rules), batch_id)``. Start it as any stream writer."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: write(apply(batch, read_rules(batch.sparkSession)), batch_id))


def kafka_flows(spark, servers: str, topic: str = "network-flows", schema=None, offsets: str = "latest", **options: str) -> DataFrame:
    """Flow records from a topic as canonical flows. ``options`` go to the source with their dots as underscores and ``kafka_`` before the client's own,
    as kafka_security_protocol="SSL"."""
    from ..sources.schema import FLOW, canonical_flows

    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", offsets)
    for name, value in options.items():
        source = source.option(name.replace("_", "."), value)
    raw = source.load()
    return canonical_flows(raw.select(F.from_json(F.col("value").cast("string"), schema or FLOW).alias("f")).select("f.*"))


def to_topic(messages: DataFrame, servers: str, checkpoint: str, **options: str) -> object:
    """A started stream that sends messages (see ``store.topic_rows``) to their topics; of a batch table, sends it at once. ``options`` as for ``kafka_flows``."""
    writer = (messages.writeStream.option("checkpointLocation", checkpoint) if messages.isStreaming else messages.write).format("kafka").option("kafka.bootstrap.servers", servers)
    for name, value in options.items():
        writer = writer.option(name.replace("_", "."), value)
    return writer.start() if messages.isStreaming else writer.save()
