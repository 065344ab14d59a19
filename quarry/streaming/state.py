"""Stateful stream operators on ``transformWithState``: constant work per row,
state in RocksDB, one entry per key or per element, never a list rewritten.

Rows behind the watermark reach these operators (the event-time column is passed
as a plain one, so Spark's late-row filter does not see it): each operator says
what becomes of them."""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Spark's own runner of the processors does not see files shipped to the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Requests of one key that are gathered before they go to the state.
GATHERED = 4096


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that transformWithState needs."""
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)


def _event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """The stream with a watermark on ``ts`` and plain microseconds in ``us``."""
    marked = df.withColumn("_event", F.col(ts).cast("timestamp")).withWatermark("_event", delay)
    return marked.withColumn("us", F.unix_micros("_event")).drop("_event")


# ------------------------------------------------------------- readiness

class Readiness(StatefulProcessor):
    """Per parent: a map entry for each child seen, and one row of progress that
    stays as a mark when the parent is done, so a repeated notification never
    reports it twice."""

    def __init__(self, timeout_ms: int | None):
        self.timeout_ms = timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "child string", "seen boolean")
        self.progress = handle.getValueState("progress", "n long, expected long, done boolean, alarm long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, expected, done, alarm = self.progress.get() if self.progress.exists() else (0, None, False, None)
        if done:
            return
        for row in rows:
            if row.expected is not None:
                expected = row.expected if expected is None else max(expected, row.expected)
            if row.child is not None and not self.seen.containsKey((row.child,)):
                self.seen.updateValue((row.child,), (True,))
                n += 1
        done = expected is not None and n >= expected
        if self.timeout_ms:
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            alarm = None if done else timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms
            if alarm is not None:
                self.handle.registerTimer(alarm)
        self.progress.update((n, expected, done, alarm))
        if done:
            self.seen.clear()
            yield Row(parent=key[0], ready=True, n_seen=n, n_expected=expected)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, expected, done, _ = self.progress.get()
        if not done:
            self.progress.update((n, expected, False, None))
            yield Row(parent=key[0], ready=False, n_seen=n, n_expected=expected)

    def close(self) -> None:
        pass


def readiness_stream(parsed: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """``parsed(parent, child, expected)`` notifications → one row per parent when
    all its expected children were seen.  With ``timeout_ms`` (for continuously
    running queries) a parent idle that long is reported as not ready, and again
    as ready should the rest arrive; its children stay known."""
    use_rocksdb(parsed.sparkSession)
    return parsed.groupBy("parent").transformWithState(Readiness(timeout_ms), "parent string, ready boolean, n_seen bigint, n_expected bigint",
                                                       "Append", "ProcessingTime" if timeout_ms else "None")


# -------------------------------------------------------------- throttle

class Throttle(StatefulProcessor):
    """Per key: requests wait, by millisecond, until the watermark has passed
    them, and are then decided in the order of their time; the last accepted
    time is the only other state."""

    def __init__(self, max_age_us: int):
        self.max_age_us = max_age_us

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")
        self.waiting = handle.getMapState("waiting", "ms long", "us array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark, gathered, size = timerValues.getCurrentWatermarkInMs(), {}, 0
        for row in rows:
            ms = -(-row.us // 1000)
            if ms <= mark:
                yield Row(url=key[0], us=row.us, accepted=None, late=True)
                continue
            gathered.setdefault(ms, []).append(row.us)
            size += 1
            if size >= GATHERED:
                self._wait(gathered)
                gathered, size = {}, 0
        self._wait(gathered)

    def _wait(self, gathered: dict) -> None:
        for ms, us in gathered.items():
            before = self.waiting.getValue((ms,)) if self.waiting.containsKey((ms,)) else None
            self.waiting.updateValue((ms,), ([*(before[0] if before else []), *us],))
            if before is None:
                self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        last = self.last.get()[0] if self.last.exists() else None
        for us in sorted(self.waiting.getValue((ms,))[0]):
            accepted = last is None or us - last >= self.max_age_us
            if accepted:
                last = us
            yield Row(url=key[0], us=us, accepted=accepted, late=False)
        self.last.update((last,))
        self.waiting.removeKey((ms,))

    def close(self) -> None:
        pass


def fetch_throttle(requests: DataFrame, max_age_s: int, url_col: str = "url", ts_col: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """Per URL: a request is accepted when no accepted fetch happened in the
    previous ``max_age_s`` seconds: (url, ts, accepted, late).

    Requests are decided in the order of their time once the watermark (the
    latest time seen less ``delay``) has passed them, so the result is the same
    however they are dealt over micro-batches.  Requests that arrive behind the
    watermark are not decided: they leave at once with ``late`` and null."""
    use_rocksdb(requests.sparkSession)
    r = _event_time(requests.select(F.col(url_col).alias("url"), F.col(ts_col).alias("ts")), "ts", delay).select("url", "us")
    out = r.groupBy("url").transformWithState(Throttle(max_age_s * 1_000_000), "url string, us bigint, accepted boolean, late boolean", "Append", "EventTime")
    return out.select("url", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "accepted", "late")


# ----------------------------------------------------------------- dedup

class FirstSeen(StatefulProcessor):
    """Per key: one mark, kept until the watermark has passed the key's latest
    row.  Rows behind the watermark pass unless the key is still marked."""

    def __init__(self, schema_names: list[str], delay_ms: int):
        self.names, self.delay_ms = schema_names, delay_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        until = self.mark.get()[0] if self.mark.exists() else None
        known, reach, first = until is not None, until, None
        for row in rows:
            if not known and (first is None or (row.us, *map(str, row)) < (first.us, *map(str, first))):
                first = row
            end = -(-row.us // 1000) + self.delay_ms
            reach = end if reach is None else max(reach, end)
        if first is not None:
            yield Row(**{n: first[n] for n in self.names})
        if reach is not None and reach > timerValues.getCurrentWatermarkInMs() and reach != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.mark.update((reach,))
            self.handle.registerTimer(reach)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.mark.clear()
        yield from ()

    def close(self) -> None:
        pass


def dedup_stream(events: DataFrame, key_expr, ts_col: str, delay: str) -> DataFrame:
    """Repeats within the watermark's ``delay`` are dropped by state that goes when
    the watermark passes; what comes later, rows that arrive behind the watermark
    included, goes on to the sink (``new_rows_sink``), whose anti join knows all
    that was written.  No payload is lost, however late its only copy is."""
    use_rocksdb(events.sparkSession)
    keyed = events.withColumn("sha256", key_expr)
    names = keyed.columns
    delay_ms = int(events.sparkSession.range(1).select((F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {delay})") / 1000).cast("long")).first()[0])
    marked = _event_time(keyed, ts_col, delay)
    return marked.groupBy("sha256").transformWithState(FirstSeen(names, delay_ms), keyed.schema, "Append", "EventTime")
