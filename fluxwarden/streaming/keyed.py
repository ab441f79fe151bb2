"""Keyed state of streams that equals the batch windows, whatever the order in which rows arrive.

Each operator is a stateful processor. Rows wait in a list state of their key until the watermark has passed them; then they are taken in the order of time
and id, as the batch form sorts them, and only then touch the key's state. So the results are those of the batch form for every row that the
watermark has passed, with batches dealt in any way within the allowed lateness (later rows are dropped, as with every watermark). What is held of a
key is the rows of the lateness window and the state that its rule needs: the last n rows, the times of a window, the values seen. A timer clears a
key that has been idle for its time to live, so state shrinks again.

The processors need the RocksDB state store: ``use_rocksdb`` sets it for a session.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "10 minutes"
#: Rows of a page of a waiting list. A page is one value of the store: rows one by one cost a look-up and a conversion each, in and out.
PAGE = 1000
MICROS = 1_000_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Gives the rows of a key to ``step`` in order of (us, id), each when the watermark has passed it. Rows are (us, id, ...) as ``waits`` says; ``keeps`` is the schema
    of the state's rows, the first field its time; a key's state goes when it has been idle for ``idle_s`` seconds (None: never)."""

    def __init__(self, waits: str, keeps: str, idle_s: float | None):
        self.waits, self.keeps, self.idle_us = waits, keeps, None if idle_s is None else int(idle_s * MICROS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "page binary")
        self.last = handle.getValueState("last", "us bigint")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", self.keeps)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, page = None, []
        for r in rows:
            page.append(tuple(r)[1:])  # without the key
            first = page[-1][0] if first is None else min(first, page[-1][0])
            if len(page) == PAGE:
                self.waiting.appendValue((pickle.dumps(page),))
                page = []
        if page:
            self.waiting.appendValue((pickle.dumps(page),))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, left = [], []
        for (page,) in self.waiting.get():
            for r in pickle.loads(page):
                (due if r[0] < now else left).append(r)
        if due:
            due.sort(key=lambda r: r[:2])
            yield from self.steps(key[0], due)
            self.last.update((due[-1][0],))
            if left:
                self.waiting.put([(pickle.dumps(left[k : k + PAGE]),) for k in range(0, len(left), PAGE)])
                self.handle.registerTimer(min(r[0] for r in left) // 1000 + 1)
            else:
                self.waiting.clear()
            if self.idle_us is not None:
                self.handle.registerTimer((due[-1][0] + self.idle_us) // 1000 + 1)
        elif self.idle_us is not None and not left and self.last.exists() and self.last.get()[0] + self.idle_us < now:
            self.forget()
            self.last.clear()

    def steps(self, key: str, due: list[tuple]) -> Iterator[Row]:
        kept = [tuple(r) for r in self.kept.get()]
        for _, rows in groupby(due, key=lambda r: r[0]):
            kept, out = self.step(key, kept, list(rows))
            yield from out
        if kept:
            self.kept.put(kept)
        else:
            self.kept.clear()

    def step(self, key: str, kept: list[tuple], rows: list[tuple]) -> tuple[list[tuple], list[Row]]:
        """The state and the output after the rows of one time."""
        raise NotImplementedError

    def forget(self) -> None:
        self.kept.clear()

    def close(self) -> None:
        pass


class History(InOrder):
    """The last n rows, the current one included, of a list that is dropped when the key has been idle for its time to live."""

    def __init__(self, waits: str, fields: list[str], n: int, idle_s: float):
        super().__init__(waits, waits, idle_s)
        self.fields, self.n = fields, n

    def step(self, key, kept, rows):
        out = []
        for r in rows:
            if kept and r[0] - kept[-1][0] > self.idle_us:
                kept = []
            kept = [*kept, r][-self.n :]
            out.append(Row(key=key, id=r[1], history=[dict(zip(self.fields, x[2:], strict=True)) for x in kept]))
        return kept, out


class Sliding(InOrder):
    """Rows of the last ``window_s`` seconds, those of the current time included, the window's lower end not."""

    def __init__(self, window_s: float):
        super().__init__("us bigint, id bigint", "us bigint, n bigint", window_s)

    def step(self, key, kept, rows):
        now = rows[0][0]
        kept = [x for x in kept if x[0] > now - self.idle_us] + [(now, len(rows))]
        n = sum(x[1] for x in kept)
        return kept, [Row(key=key, id=r[1], n=n) for r in rows]


class Newest(InOrder):
    """The newest n distinct times that are at most ``ttl_s`` seconds old, oldest first."""

    def __init__(self, n: int, ttl_s: float):
        super().__init__("us bigint, id bigint", "us bigint", ttl_s)
        self.n = n

    def step(self, key, kept, rows):
        now = rows[0][0]
        kept = [x for x in kept if x[0] >= now - self.idle_us][-(self.n - 1) :] + [(now,)]
        return kept, [Row(key=key, id=r[1], times=[x[0] for x in kept]) for r in rows]


class Buffer(InOrder):
    """A list that rows are put into and that a reading row takes whole and empties: the newest n, none when ``ttl_s`` seconds have passed since the last one."""

    def __init__(self, waits: str, fields: list[str], n: int, ttl_s: float):
        super().__init__(waits, waits, ttl_s)
        self.fields, self.n = fields, n

    def step(self, key, kept, rows):
        out = []
        for r in rows:
            if kept and r[0] - kept[-1][0] >= self.idle_us:
                kept = []
            if r[2]:
                out.append(Row(key=key, id=r[1], packets=[dict(zip(self.fields, x[3:], strict=True)) for x in kept]))
                kept = []
            else:
                kept = [*kept, r][-self.n :]
        return kept, out


class FirstSeen(InOrder):
    """Whether a value is new for a key that isn't new itself. Values are keys of a map state; a value is looked up once for the rows that are due together,
    however many are known."""

    def __init__(self, idle_s: float | None):
        super().__init__("us bigint, id bigint, value string", "", idle_s)

    def open(self, handle):
        self.known = handle.getMapState("known", "value string", "us bigint")

    def steps(self, key, due):
        first, met = not self.last.exists(), set()
        fresh = first
        for us, at, value in due:
            # A key without a time before has no values either.
            new = value not in met and (fresh or not self.known.containsKey((value,)))
            met.add(value)
            if new:
                self.known.updateValue((value,), (us,))
            yield Row(key=key, id=at, new=new and not first)
            first = False

    def forget(self):
        self.known.clear()


def _run(stream: DataFrame, processor: InOrder, out: str, key: str, ts: str, order: str, late: str, *columns) -> DataFrame:
    d = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    d = d.select(F.col(key).cast("string").alias("key"), F.unix_micros("_ts").alias("us"), F.col(order).cast("bigint").alias("id"), *columns, "_ts")
    return d.groupBy("key").transformWithState(_Trimmed(processor), out, "append", "eventTime")


class _Trimmed(StatefulProcessor):
    """Takes the watermark's column off the rows before the processor sees them."""

    def __init__(self, inner: InOrder):
        self.inner = inner

    def init(self, handle):
        self.inner.init(handle)

    def handleInputRows(self, key, rows, timerValues):
        return self.inner.handleInputRows(key, (r[:-1] for r in rows), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        return self.inner.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def close(self):
        self.inner.close()


def _fields(stream: DataFrame, fields: list[str]) -> str:
    return ", ".join(f"`{f}` {stream.schema[f].dataType.simpleString()}" for f in fields)


def _struct(stream: DataFrame, fields: list[str]) -> str:
    return "array<struct<" + ", ".join(f"`{f}`: {stream.schema[f].dataType.simpleString()}" for f in fields) + ">>"


def history(stream: DataFrame, fields: list[str], key: str, ts: str = "ts", order: str = "flow_id", n: int = 15, idle_s: float = 3600, late: str = LATE) -> DataFrame:
    """(key, id, history): as ``state.history`` within ``state.with_gap_session``."""
    p = History(f"us bigint, id bigint, {_fields(stream, fields)}", fields, n, idle_s)
    return _run(stream, p, f"key string, id bigint, history {_struct(stream, fields)}", key, ts, order, late, *fields)


def first_seen(stream: DataFrame, value: str, key: str, ts: str = "ts", order: str = "flow_id", idle_s: float | None = None, late: str = LATE) -> DataFrame:
    """(key, id, new): as ``state.with_first_seen``."""
    return _run(stream, FirstSeen(idle_s), "key string, id bigint, new boolean", key, ts, order, late, F.col(value).cast("string").alias("value"))


def sliding_count(stream: DataFrame, key: str, ts: str = "ts", order: str = "flow_id", window_s: float = 300, late: str = LATE) -> DataFrame:
    """(key, id, n): as ``state.sliding_count``."""
    return _run(stream, Sliding(window_s), "key string, id bigint, n bigint", key, ts, order, late)


def newest_times(stream: DataFrame, key: str, ts: str = "ts", order: str = "flow_id", n: int = 200, ttl_s: float = 3600, late: str = LATE) -> DataFrame:
    """(key, id, times): as ``state.newest_times``."""
    return _run(stream, Newest(n, ttl_s), "key string, id bigint, times array<bigint>", key, ts, order, late)


def read_once(stream: DataFrame, fields: list[str], reads: str, key: str, ts: str = "ts", order: str = "packet_id", n: int = 200, ttl_s: float = 120, late: str = LATE) -> DataFrame:
    """(key, id, packets) for each row whose ``reads`` is true: as ``state.read_once``."""
    p = Buffer(f"us bigint, id bigint, reads boolean, {_fields(stream, fields)}", fields, n, ttl_s)
    return _run(stream, p, f"key string, id bigint, packets {_struct(stream, fields)}", key, ts, order, late, F.coalesce(F.col(reads), F.lit(False)).alias("reads"), *fields)
