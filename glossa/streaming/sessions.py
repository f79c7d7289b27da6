"""Feedback sessions as keyed state with event-time timers."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import ArrayType, DataType, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BUCKETS = 1 << 14  # groups of keys that share a state value and a timer


@contextmanager
def timed_state(spark: SparkSession):
    """Queries started inside keep their state in the store that timers need; a query stays with the store it began with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


class _Sessions(StatefulProcessor):
    """Open sessions of the keys of one bucket: key, start, end, first event, number of events and of late ones. Times are microseconds.

    They are one state value with one timer, that of the session to end first: a call of the state store costs far
    more than a session, so a batch makes a few calls for each bucket, not for each key or session.
    """

    def __init__(self, gap: int, key: DataType) -> None:
        self.gap = gap
        one = StructType().add("key", key).add("start", "long").add("end", "long").add("event", "string").add("n", "long").add("late", "long")
        self.schema = StructType().add("held", ArrayType(one))

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.schema)

    def _close_at(self, end: int) -> int:
        """Watermark, in milliseconds, from which no event can join a session any more."""
        return -(-(end + self.gap) // 1000)

    def _first_close(self, held: list[tuple]) -> int | None:
        return self._close_at(min(s[2] for s in held)) if held else None

    def _held(self) -> list[tuple]:
        value = self.open.get()
        return [tuple(s) for s in value[0]] if value else []

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self._held()
        by_key: dict = {}  # the sessions of a key in order of time
        for k, *session in before:
            by_key.setdefault(k, []).append(tuple(session))
        for row in rows:
            held = by_key.setdefault(row["session_id"], [])
            start = end = us = row["us"]
            event, n, late = row["event"], 1, 0
            # sessions lie more than a gap apart, so an event joins the last one that starts before it, the next one, or both
            first = last = bisect_right(held, us, key=itemgetter(0))
            if first and us <= held[first - 1][1] + self.gap:
                first -= 1
            if last < len(held) and held[last][0] - self.gap <= us:
                last += 1
            if any(s[1] > us for s in held[first:last]):
                late = 1  # a later event of the session came first
            for s, e, earliest, m, k in held[first:last]:
                start, event = min((start, event), (s, earliest))
                end, n, late = max(end, e), n + m, late + k
            held[first:last] = [(start, end, event, n, late)]
        held = [(k, *s) for k, sessions in by_key.items() for s in sessions]
        self.open.update((held,))
        was, close = self._first_close(before), self._first_close(held)
        if close != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(close)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # all sessions that the watermark has passed end with the first of them
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        held = self._held()
        rest = [s for s in held if self._close_at(s[2]) > due]
        if rest:
            self.open.update((rest,))
            self.handle.registerTimer(self._first_close(rest))
        else:
            self.open.clear()
        for k, start, end, event, n, late in held:
            if self._close_at(end) <= due:
                yield Row(session_id=k, event_id=event, start_us=start, end_us=end, feedbacks=n, late=late)

    def close(self) -> None:
        pass


def feedback_sessions(events: DataFrame, gap_seconds: int, delay: str, session: str = "session_id", time: str = "ts",
                      event: str = "event_id", buckets: int = BUCKETS) -> DataFrame:
    """One row per finished session of a key: its first feedback, which counts, and what followed it.

    Events of one ``session`` key that lie at most ``gap_seconds`` apart are one session. A session ends by its own timer,
    when the watermark, ``delay`` behind the newest event, has passed its last event by the gap; then its
    state goes and a row comes out: session_id, event_id (of its first event by time and id), start, end, feedbacks (events),
    repeated (all but the first), and late: events that came after a later one of their session, yet in time to count.
    Events behind the watermark are dropped, and sessions still open at the end of the input give no row. Rows without a
    key or time are left out. Start the query inside ``timed_state``.

    Keys are held in ``buckets`` by their hash, and a batch reads and writes the open sessions of the buckets it meets: one
    bucket's must fit a task. A checkpoint stays with the number it began with.
    """
    rows = (events.where(F.col(session).isNotNull() & F.col(time).isNotNull())
            .select(F.col(session).alias("session_id"), F.col(time).alias("ts"), F.col(event).cast("string").alias("event"))
            .withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
            .withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")))
    schema = rows.select("session_id").schema
    for name, kind in (("event_id", "string"), ("start_us", "long"), ("end_us", "long"), ("feedbacks", "long"), ("late", "long")):
        schema = schema.add(name, kind)
    state = _Sessions(gap_seconds * 1_000_000, schema["session_id"].dataType)
    found = rows.groupBy("bucket").transformWithState(state, schema, "append", "eventTime")
    return found.select("session_id", "event_id", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"),
                        "feedbacks", (F.col("feedbacks") - 1).alias("repeated"), "late")
