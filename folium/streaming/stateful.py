"""Stream operators with keyed state, timers and state that goes.

Events may come out of order, in any files and micro-batches: a key's events wait in its state until the watermark has
passed them and are then folded in order of time and id, so that results do not depend on how they came. What the watermark
had passed before its micro-batch began is late and dropped; an event within the delay of all that came in earlier batches never is.
"""

from __future__ import annotations

import pickle
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folium.shared import scratch

#: The time of the row that ends a bounded stream: no event is so late.
END = datetime(9000, 1, 1)
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    """Set the state store that state with timers needs."""
    spark.conf.set(_STORE, _ROCKS)


def run_to_end(source: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Everything that ``build`` makes of a source that has ended, as a table.

    A second source, empty at first, joins the stream; once all else is read, a row of the far end of time comes by it to
    the restarted query, so that the watermark passes all events and timers, and state runs empty. That row has nothing
    but its time: ``build`` must not filter it out before the watermark is set.
    """
    spark = source.sparkSession
    folder = scratch(spark, "stream")
    nothing = spark.createDataFrame([], source.schema)
    nothing.write.parquet(f"{folder}/clock")
    out = build(source.unionByName(spark.readStream.schema(source.schema).parquet(f"{folder}/clock")))
    before = spark.conf.get(_STORE)
    with_timers(spark)
    try:
        for ended in (False, True):
            if ended:
                end = [END if f.name == "ts" else None for f in source.schema.fields]
                spark.createDataFrame([tuple(end)], source.schema).coalesce(1).write.mode("append").parquet(f"{folder}/clock")
            q = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withWatermark("ts", delay).where(F.col("ts") < F.lit(END))  # the end moves the watermark alone


Step = Callable[[tuple | None, tuple], tuple[tuple | None, tuple | None]]


#: Rows that a task groups by key at once, and rows of a key in one part.
GATHERED, PART = 500_000, 1_000
_END_MS = int(END.replace(tzinfo=timezone.utc).timestamp() * 1000)


def _values(column: pa.ChunkedArray) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows ``key, at, ...`` as parts ``key, last, part`` of a key's rows, pickled. Row by row they take most
    of a stream's time on their way to the state and back."""

    def parts(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(some).sort_by([("key", "ascending"), ("at", "ascending")])
        keys, *columns = [_values(c) for c in rows.columns]
        out = []
        for (key, _), group in groupby(zip(keys, zip(*columns)), lambda r: (r[0], r[1][0] >= _END_MS)):  # the end apart
            while part := [row for _, row in islice(group, PART)]:
                out.append((key, part[-1][0], pickle.dumps(part, pickle.HIGHEST_PROTOCOL)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["key", "last", "part"])

    some, n = [], 0
    for batch in batches:
        some, n = [*some, batch], n + batch.num_rows
        if n >= GATHERED:
            yield parts(some)
            some, n = [], 0
    if n:
        yield parts(some)


class InOrder(StatefulProcessor):
    """Folds a key's rows, in order, with ``step(state, row)``, which gives the new state, None for none, and a row to emit
    or None. ``until(state)`` is when a state is of no more use, None for never; it is then cleared. Rows come, wait and
    leave in parts: they come and wait pickled, and leave as columns."""

    def __init__(self, state: str, step: Step, names: list[str], until: Callable[[tuple], int | None] = lambda s: None) -> None:
        self.kept, self.step, self.told, self.until = state, step, Row("key", *names), until

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "part binary")
        self.state = handle.getValueState("state", self.kept)
        self.due = handle.getValueState("due", "at long")

    def _wake(self, at: int) -> None:
        """One timer a key, at the earliest time that anything is due."""
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, first = timerValues.getCurrentWatermarkInMs(), None
        new = (r for _, _, part in rows for r in pickle.loads(part) if r[0] > now)  # Spark drops a part only with its last row
        while part := list(islice(new, PART)):  # a call a key, not a call for each part that came
            self.waiting.appendValue((pickle.dumps(part, pickle.HIGHEST_PROTOCOL),))
            at = min(r[0] for r in part)
            first = at if first is None else min(first, at)
        if first is None:
            return iter(())
        due = self.due.get()
        if due is None or first < due[0]:
            if due is not None:
                self.handle.deleteTimer(due[0])
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(row for (part,) in self.waiting.get() for row in pickle.loads(part))
        n = bisect_right(rows, now, key=lambda r: r[0])
        before = self.state.get()
        state = before = None if before is None else tuple(before)
        out = []
        for row in islice(rows, n):
            state, told = self.step(state, row)
            if told is not None:
                out.append(told)
        end = None if state is None else self.until(state)
        if end is not None and end <= now:
            state, end = None, None
        if n < len(rows):
            if n:
                self.waiting.put([(pickle.dumps(rows[i : i + PART], pickle.HIGHEST_PROTOCOL),) for i in range(n, len(rows), PART)])
        elif n:
            self.waiting.clear()
        if state != before:
            self.state.clear() if state is None else self.state.update(state)
        dues = [r[0] for r in rows[n : n + 1]] + ([end] if end is not None else [])
        self._wake(min(dues)) if dues else self.due.clear()  # its timer was this one
        return (self.told(*key, *map(list, zip(*out[i : i + PART]))) for i in range(0, len(out), PART))


def _folded(stream: DataFrame, key: str, delay: str, columns: dict[str, Column], state: str, step: Step, out: str, until=lambda s: None) -> DataFrame:
    d = stream.where("ts IS NOT NULL").select(F.col(key).cast("long").alias("key"), F.unix_millis("ts").alias("at"), *[c.alias(n) for n, c in columns.items()])
    parts = d.repartition("key").mapInArrow(_packed, "key long, last long, part binary")
    timed = _timed(parts.withColumn("ts", F.timestamp_millis("last")), delay).select("ts", "key", "part")
    names = [c.split()[0] for c in out.split(", ")]
    told = ", ".join("{} array<{}>".format(*c.split()) for c in out.split(", "))
    folded = timed.groupBy("key").transformWithState(InOrder(state, step, names, until), f"key long, {told}", "append", "eventTime")
    return folded.select("key", F.inline(F.arrays_zip(*names)))


def failures(stream: DataFrame, failed: Column, key: str = "user_id", least: int = 3, hours: int = 24, delay: str = "1 hour") -> DataFrame:
    """Each check with its key's failures in a row so far, and until when a failing key rests (null if it is not failing).
    Only failing keys have state: a success takes it away."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple | None, tuple]:
        at, event, bad = row
        n = (state[0] if state else 0) + 1 if bad else 0
        return ((n,) if n else None), (event, n, at + hours * 3_600_000 if n >= least else None)

    columns = {"event_id": F.col("event_id").cast("long"), "failed": F.coalesce(failed, F.lit(False))}
    return _folded(stream, key, delay, columns, "n long", step, "event_id long, failures long, rests_until long")


def throttled(stream: DataFrame, key: str = "user_id", gap_ms: int = 250, last: Column | None = None, delay: str = "1 hour") -> DataFrame:
    """Per key, events at least ``gap_ms`` after the last one let through; those marked ``last`` always go. A key's state
    goes a gap after it: whatever comes then may go anyway."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        at, event, final = row
        if final or state is None or at - state[0] >= gap_ms:
            return (at,), (event, at)
        return state, None

    columns = {"event_id": F.col("event_id").cast("long"), "final": F.lit(False) if last is None else F.coalesce(last, F.lit(False))}
    return _folded(stream, key, delay, columns, "last long", step, "event_id long, at long", lambda s: s[0] + gap_ms)


PAUSE = Row("key", "paused_at", "paused_until", "answer")


class Pauses(StatefulProcessor):
    """A key's pauses that the watermark has not passed: ``start, until, answer``, disjoint and in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start long, until long, answer string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = list(map(tuple, self.open.get()))
        merged: list[tuple] = []
        for start, until, answer in sorted([*before, *((r.at, r.until, r.answer) for r in rows)], key=lambda p: (p[0], p[1], p[2] or "")):
            if merged and start < merged[-1][1]:  # while it lasts: extended, never shortened
                merged[-1] = (merged[-1][0], max(until, merged[-1][1]), merged[-1][2])
            elif start < until:
                merged.append((start, until, answer))
        if merged:
            self.open.put(merged)
            self._wake(before, merged)
        return iter(())

    def _wake(self, before: list[tuple], now: list[tuple]) -> None:
        """One timer a key, at the end of its first pause: pauses are in order, so it is the first to end."""
        if before and (not now or now[0][1] != before[0][1]):
            self.handle.deleteTimer(before[0][1])
        if now and (not before or now[0][1] != before[0][1]):
            self.handle.registerTimer(now[0][1])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()  # all that it has passed are told at once
        rows = list(map(tuple, self.open.get()))
        over, rest = [p for p in rows if p[1] <= now], [p for p in rows if p[1] > now]
        self.open.put(rest) if rest else self.open.clear()
        self._wake([], rest)  # its timer is this one
        return iter([PAUSE(*key, *p) for p in over])


def pauses(stream: DataFrame, key: str, pause_ms: Column, answer: Column, default_ms: int = 600_000, delay: str = "1 hour") -> DataFrame:
    """``key, paused_at, paused_until, answer``: the pauses that notices of a key start, each told once when it is over.

    A notice pauses its key for ``pause_ms``, ``default_ms`` where that is null; one of 0 is no notice. While a pause lasts, a notice can
    only extend it, and the answer that started it stays. A timer ends a pause and takes its state away.
    """
    ms = F.coalesce(pause_ms, F.lit(default_ms)).cast("long")
    d = _timed(stream, delay).select("ts", F.col(key).cast("string").alias("key"), F.unix_millis("ts").alias("at"), (F.unix_millis("ts") + ms).alias("until"), answer.cast("string").alias("answer"))
    d = d.where("at < until")  # others are no notices, and keys without one need no state
    return d.groupBy("key").transformWithState(Pauses(), "key string, paused_at long, paused_until long, answer string", "append", "eventTime")
