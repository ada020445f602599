"""Streams with keyed state: counter growth and alerts with quiet periods.

State lives in the RocksDB state store, one entry per key, and changes only when the watermark
has passed a row's time, so rows count in the order of their times however they arrive. A task
holds one Arrow frame of one key at a time, and a key's pending rows, those of one step of the watermark, when they
fall due. Keys and row values travel as JSON text, so any column type may be a key and nulls
stay nulls.

A row that arrives when the watermark has passed its time isn't lost: it comes out marked
``is_late`` and changes no state. Rows without a time come out so, too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from watchloom.functions.times import ntz
from watchloom.operators.alerting import breaches, second_of, time_of

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EXACT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_STAMP = "_stamp"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streaming queries started inside keep their state in RocksDB; the session's setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _stamp(ts: str) -> Column:
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", ntz("1970-01-01 00:00:00"), F.col(ts)))


def _text(cols: list[str]) -> Column:
    return F.to_json(F.struct(*cols), _EXACT)


def _fields(text: str, like: DataFrame, cols: list[str]) -> list[Column]:
    schema = like.select(*cols).schema
    return [F.from_json(text, schema, _EXACT)[c].alias(c) for c in cols]


def _due(pending, passed: int) -> tuple[list, list]:
    """Pending rows up to a watermark in the order of their times (arrival, where equal), and the others."""
    rows = list(pending.get())
    return sorted((r for r in rows if r[0] <= passed), key=lambda r: r[0]), [r for r in rows if r[0] > passed]


def _wait(handle: StatefulProcessorHandle, pending, rows: list) -> None:
    if not rows:
        pending.clear()
        return
    pending.put(rows)
    handle.registerTimer(min(r[0] for r in rows))


class _Growth(StatefulProcessor):
    """Pending snapshots, and the last one that was counted. A timer stands at or before the first pending one."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ms long, snap string, counters string")
        self.last = handle.getValueState("last", "ms long, counters string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        last = self.last.get()
        if last is not None:
            passed = max(passed, last[0])
        for frame in rows:
            # Most keys have a row or two a batch: plain lists, and a frame only where rows are late.
            given = [(None if pd.isna(ms) else int(ms), snap, counters) for ms, snap, counters in zip(frame["ms"].tolist(), frame["snap"].tolist(), frame["counters"].tolist())]
            new = [x for x in given if x[0] is not None and x[0] > passed]
            if new:
                self.pending.appendList(new)
                self.handle.registerTimer(min(x[0] for x in new))
            if len(new) < len(given):
                late = [x[1] for x in given if x[0] is None or x[0] <= passed]
                yield pd.DataFrame({"key": key[0], "snap": late, "growth": None, "is_late": True})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due, waiting = _due(self.pending, passed)
        last = self.last.get()
        if last is not None and self.idle_ms is not None and not due and last[0] + self.idle_ms <= passed:
            self.last.clear()
        if not due:
            return
        out = []
        for ms, snap, counters in due:
            if last is not None and ms <= last[0]:
                out.append((key[0], snap, None, True))
                continue
            if last is not None and self.idle_ms is not None and last[0] + self.idle_ms <= ms:
                last = None
            new = json.loads(counters)
            old = json.loads(last[1]) if last is not None else [0] * len(new)
            grown = [None if n is None or o is None else n - o for n, o in zip(new, old)]
            out.append((key[0], snap, json.dumps(grown), False))
            last = (ms, counters)
        self.last.update(last)
        _wait(self.handle, self.pending, waiting)
        if self.idle_ms is not None:
            self.handle.registerTimer(last[0] + self.idle_ms)
        yield pd.DataFrame(out, columns=["key", "snap", "growth", "is_late"])

    def close(self) -> None:
        pass


def counter_growth(
    stream: DataFrame, keys: list[str], snapshot: str, ts: str, counters: list[str], lateness: str, idle_days: int | None = None
) -> DataFrame:
    """(keys, snapshot, counters as growth, is_reset, is_late) of a stream of absolute counters.

    A snapshot is counted once the watermark (``lateness`` behind the newest ``ts``) has passed it, against
    the entity's snapshot before; the first reports absolute values. Snapshots of an entity differ
    in their millisecond: a second row of one that is pending, or of one already counted, comes
    out late. Growth from or to a null counter is null. An entity that is silent for ``idle_days`` leaves the
    state, and its next snapshot is a first one again; with None it stays.
    """
    stamped = stream.select(_text(keys).alias("key"), _text([snapshot]).alias("snap"), F.to_json(F.array(*[F.col(c).cast("long") for c in counters])).alias("counters"), _stamp(ts).alias(_STAMP))
    # The stamp itself stays behind, or late rows would be dropped before the state sees them.
    rows = stamped.withWatermark(_STAMP, lateness).select("key", "snap", "counters", F.unix_millis(_STAMP).alias("ms"))
    idle_ms = None if idle_days is None else idle_days * 86_400_000
    out = rows.groupBy("key").transformWithStateInPandas(_Growth(idle_ms), "key string, snap string, growth string, is_late boolean", "append", "eventTime")
    grown = F.from_json("growth", "array<bigint>")
    reset = F.coalesce(F.exists(grown, lambda v: v < 0), F.lit(False))
    return out.select(*_fields("key", stream, keys), *_fields("snap", stream, [snapshot]), *[grown[i].alias(c) for i, c in enumerate(counters)], reset.alias("is_reset"), "is_late")


class _Quiet(StatefulProcessor):
    """Pending seconds of breaches, and the last fire until its quiet time is over. A timer stands at or before the first of them."""

    def __init__(self, quiet: dict[str, int]) -> None:
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "ms long")
        self.last = handle.getValueState("last", "sec long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        silent = self._silent(key)
        for frame in rows:
            secs = frame["sec"].drop_duplicates()
            early = (secs * 1000 > passed).fillna(False)
            new = [int(s) * 1000 for s in secs[early] if silent is None or s >= silent]
            if new:
                self.pending.appendList([(ms,) for ms in new])
                self.handle.registerTimer(min(new))
            late = secs[~early]
            yield pd.DataFrame({"key": key[0], "alert": key[1], "sec": late.astype("Int64"), "is_late": True}, index=late.index)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due, waiting = _due(self.pending, passed)
        silent, out = self._silent(key), []
        for (ms,) in due:
            if silent is None or ms >= silent * 1000:
                out.append((key[0], key[1], ms // 1000, False))
                silent = ms // 1000 + max(self.quiet[key[1]], 1)
        if out:
            self.last.update((out[-1][2],))
        if due:
            _wait(self.handle, self.pending, waiting)
        if silent is not None and silent * 1000 <= passed:
            self.last.clear()
        elif out:
            self.handle.registerTimer(silent * 1000)
        yield pd.DataFrame(out, columns=["key", "alert", "sec", "is_late"])

    def _silent(self, key) -> int | None:
        return self.last.get()[0] + max(self.quiet[key[1]], 1) if self.last.exists() else None

    def close(self) -> None:
        pass


def _distinct_seconds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield frame.drop_duplicates()


def quiet_period_alerts(
    samples: DataFrame, spec: list[tuple], lateness: str, metric: str = "metric", value: str = "value", ts: str = "ts", by: list[str] | None = None
) -> DataFrame:
    """(by, alert, fired_at, is_late): breaches that fire, each followed by its alert's quiet time.

    The rows with ``is_late`` false are those of the batch ``quiet_alerts`` over all samples that came in time. A
    late breach comes out too, once per second and Arrow frame, and neither fires nor silences.
    Repeated seconds go before the shuffle, frame by frame, so a busy alert sends few rows to its key. Expired quiet
    times leave the state by themselves.
    """
    by = list(by or [])
    quiet = {name: q for name, _, _, _, q in spec}
    # Watermarks follow all samples, breaching or not, or an alert would wait for the next breach.
    stamped = samples.withColumn(_STAMP, _stamp(ts)).withWatermark(_STAMP, lateness)
    hits = breaches(stamped, spec, metric, value, ts, by).select(_text(by).alias("key") if by else F.lit("{}").alias("key"), "alert", second_of("ts").alias("sec"))
    rows = hits.mapInPandas(_distinct_seconds, "key string, alert string, sec long")
    out = rows.groupBy("key", "alert").transformWithStateInPandas(_Quiet(quiet), "key string, alert string, sec long, is_late boolean", "append", "eventTime")
    return out.select(*(_fields("key", samples, by) if by else []), "alert", time_of("sec").alias("fired_at"), "is_late")
