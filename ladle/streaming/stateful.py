"""Keyed state on Structured Streaming: rate limits, circuits, caches with a time to live, debounced values, progress."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ladle.operators import folds, jobs


#: The store that typed state variables and timers need.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_HELD = "until double, n long, last double"


class InOrder(StatefulProcessor):
    """A machine of operators.folds over each key's rows in the order of event time.

    Rows wait in a list until the watermark has passed them; then a timer takes them in order, so that rows which come late, but
    within the watermark's delay, are counted where they belong, and a stream gives what a batch gives. A key is
    forgotten when its next row comes more than `idle` ms (of event time) after its last one; never if None.
    """

    def __init__(self, machine, order: str, kind: str, idle: float | None):
        self.machine, self.order, self.kind, self.idle = machine, order, kind, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)
        self.waiting = handle.getListState("waiting", f"ms double, at {self.kind}, ok boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [(float(ms), at, bool(ok)) for pdf in rows for ms, at, ok in zip(pdf["ms"], pdf[self.order], pdf["ok"], strict=True)]
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(math.ceil(min(came)[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        *state, last = self.held.get() if self.held.exists() else (*self.machine.start, 0.0)
        if self.idle is not None and now > last + self.idle:
            self.held.clear()  # all that is to come is later
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= now]
        if not due:
            return
        out, state = [], tuple(state)
        ms, at, ok = map(np.array, zip(*due, strict=True))
        rests = np.diff(ms, prepend=last) > (math.inf if self.idle is None else self.idle)
        for a, b in itertools.pairwise([*np.unique([0, *np.flatnonzero(rests)]).tolist(), len(ms)]):
            found, state = self.machine.run({"ms": ms[a:b], "ok": ok[a:b]}, self.machine.start if rests[a] else state)
            out += found
        if state != self.machine.start:
            self.held.update((float(state[0]), int(state[1]), float(ms[-1])))
            if self.idle is not None:
                self.handle.registerTimer(max(math.ceil(ms[-1] + self.idle), now) + 1)
        else:
            self.held.clear()
        if len(rows) > len(due):
            self.waiting.put(rows[len(due) :])
            self.handle.registerTimer(math.ceil(rows[len(due)][0]))
        else:
            self.waiting.clear()
        yield pd.DataFrame({"key": key[0], self.order: at, self.machine.output.split()[0]: out})

    def close(self) -> None:
        pass


class Stored(StatefulProcessor):
    """The first row of a key stores it; the store's own clock removes it after ttl_ms."""

    def __init__(self, order: str, ttl_ms: int):
        self.order, self.ttl_ms = order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stored = handle.getValueState("stored", "at double", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf.sort_values(["ms", self.order], kind="stable")
            known = self.stored.exists()
            if not known:
                self.stored.update((float(pdf["ms"].iloc[0]),))
            yield pd.DataFrame({"key": key[0], self.order: pdf[self.order], "hit": [known or k > 0 for k in range(len(pdf))]})

    def close(self) -> None:
        pass


def _keyed(stream: DataFrame, key: str, ts: str, *columns: Column | str) -> DataFrame:
    at = F.col(ts).cast("timestamp")
    return stream.select(F.col(key).cast("string").alias("key"), *columns, at.alias("ts"), (F.unix_micros(at) / 1000).alias("ms")).filter("key IS NOT NULL AND ts IS NOT NULL")


def _in_order(rows: DataFrame, order: str, late: str, machine, idle: float | None) -> DataFrame:
    kind = rows.schema[order].dataType.simpleString()
    keyed = rows.withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(InOrder(machine, order, kind, idle), f"key string, {order} {kind}, {machine.output}", "append", "EventTime")


def rate_limit(stream: DataFrame, key: str, ts: str, order: str, window_ms: float = jobs.RATE_WINDOW_MS, most: int = jobs.RATE_LIMIT, late: str = "0 seconds") -> DataFrame:
    """key, order, allowed of each request, once the watermark (`late` behind the latest) has passed it. A key is forgotten when
    its window has ended, as the next request opens one anyway."""
    rows = _keyed(stream, key, ts, order, F.lit(True).alias("ok"))
    return _in_order(rows, order, late, folds.Windows(window_ms), window_ms).select("key", order, (F.col("place") < most).alias("allowed"))


def circuit_breaker(stream: DataFrame, key: str, ts: str, order: str, ok: str, limit: int = jobs.CIRCUIT_FAILURES, open_ms: float = jobs.CIRCUIT_MS, late: str = "0 seconds", idle_ms: float | None = None) -> DataFrame:
    """key, order, met of each call, once the watermark has passed it. Failures are forgotten idle_ms (of event time) after the last call; never if None."""
    rows = _keyed(stream, key, ts, order, F.coalesce(F.col(ok), F.lit(False)).alias("ok"))
    return _in_order(rows, order, late, folds.Circuit(limit, open_ms), idle_ms)


def cached(stream: DataFrame, key: str, ts: str, order: str, ttl_ms: int) -> DataFrame:
    """key, order, hit of each lookup as it comes: the first stores the key for ttl_ms of processing time."""
    rows = _keyed(stream, key, ts, order)
    kind = rows.schema[order].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(Stored(order, ttl_ms), f"key string, {order} {kind}, hit boolean", "update", "ProcessingTime")


def first_in_ttl(stream: DataFrame, key: str, ts: str, ttl: str) -> DataFrame:
    """The first row of each key within the time to live: what has to be computed, the rest are hits."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def debounce(stream: DataFrame, key: str, ts: str, value: str, gap: str, late: str = "1 minute") -> DataFrame:
    """The last value of each burst of events."""
    return jobs.debounce(stream.withWatermark(ts, late), key, ts, value, gap)


def _start(stream: DataFrame, writer, checkpoint: str):
    """Start a query that stops when all is read, with the store of typed state; the session's own setting stays as it was."""
    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start a query that writes Parquet as files come and stops when all are read."""
    return _start(stream, stream.writeStream.format("parquet").option("path", path).outputMode(mode), checkpoint)


def deliver(stream: DataFrame, sink, checkpoint: str, mode: str = "append"):
    """Hand each micro-batch of events to sink(DataFrame, batch id)."""
    return _start(stream, stream.writeStream.foreachBatch(sink).outputMode(mode), checkpoint)


def job_worker(jobs_stream: DataFrame, handle, checkpoint: str):
    """Process queued jobs as they come; handle(DataFrame) gets each batch's jobs, oldest first."""

    def run(batch: DataFrame, _: int) -> None:
        handle(batch.filter("status = 'queued'").orderBy("created_at"))

    return deliver(jobs_stream, run, checkpoint)
