"""Structured Streaming jobs: capture filter, KPI, history, de-duplication, deltas, alerts.

Each job is a stream transformation shared with, or equal to, its batch twin. Sinks are
idempotent per micro-batch, so a replay after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchloom.functions.times import ntz
from watchloom.operators.alerting import breaches, quiet_alerts, second_of, time_of
from watchloom.operators.filters import event_rules
from watchloom.session import materialize
from watchloom.sources.history import purge_expired, purge_stored, write_batch, write_dated_batch

STAMP = "event_time"


def event_stamp(ts: str = "ts") -> Column:
    """Instant of a zone-less timestamp read as UTC, whatever the session zone: watermarks
    need a timestamp with an instant."""
    epoch = ntz("1970-01-01 00:00:00")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(ts)))


def run_available(stream: DataFrame, checkpoint: str, out: str | None = None, mode: str = "append", each: Callable | None = None) -> None:
    """Process everything that has arrived, then stop; a later call goes on from the checkpoint."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if each is not None:
        query = writer.foreachBatch(each).start()
    else:
        query = writer.format("parquet").option("path", out).start()
    query.awaitTermination()


def stream_rules(stream: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Continuous capture filter: the batch rules applied to a stream."""
    return event_rules(stream, rules)


def stream_daily_kpi(stream: DataFrame, ts: str, category: str, lateness: str) -> DataFrame:
    """Events per UTC day and category; rows later than ``lateness`` are dropped.

    In append mode a day comes out once the watermark has passed it, in update mode on
    every change.
    """
    days = stream.withColumn(STAMP, event_stamp(ts)).withWatermark(STAMP, lateness)
    counts = days.groupBy(F.window(STAMP, "1 day"), F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("occurrence_per_day"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("window.start") / 86400).cast("int"))
    return counts.select(day.alias("log_date"), "category", "occurrence_per_day")


def stream_dedup(stream: DataFrame, ts: str, fingerprint: Column, within: str, salts: int = 32) -> DataFrame:
    """First event of each fingerprint within the watermark delay.

    Two steps: per (fingerprint, salt) first, so that a fingerprint holding a third of the
    stream is spread over ``salts`` tasks, then per fingerprint over what is left.
    """
    stamped = stream.withColumns({STAMP: event_stamp(ts), "incident_id": fingerprint}).withWatermark(STAMP, within)
    salted = stamped.withColumn("_salt", F.pmod(F.xxhash64(STAMP), F.lit(salts)))
    return salted.dropDuplicatesWithinWatermark(["incident_id", "_salt"]).dropDuplicatesWithinWatermark(["incident_id"]).drop("_salt")


def history_writer(path: str, ts: str, days: int, as_of: datetime | Callable[[], datetime]) -> Callable:
    """Micro-batch sink of a dated history: adds the rows inside retention, then deletes stored rows outside.

    ``as_of`` may be a function of no arguments, asked once per batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        now = as_of() if callable(as_of) else as_of
        write_dated_batch(purge_expired(batch, ts, days, now), path, batch_id, ts)
        purge_stored(batch.sparkSession, path, ts, days, now)

    return write


def batch_writer(path: str) -> Callable:
    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return write


def latest_update(spark: SparkSession, path: str, keys: list[str], value: str) -> DataFrame:
    """Final rows of an update-mode sink: per key the value of its last batch."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(value, "batch_id").alias(value))


def _state(spark: SparkSession, path: str, batch_id: int, first: DataFrame) -> DataFrame:
    """The state table that the batch before wrote, or ``first``."""
    return spark.read.schema(first.schema).parquet(f"{path}/batch_id={batch_id - 1}") if batch_id > 0 else first


def _forget(spark: SparkSession, path: str, batch_id: int) -> None:
    """Delete the state that no replay can ask for any more: a replay starts from the batch before its own."""
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id - 2}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def delta_writer(out_path: str, state_path: str, keys: list[str], snapshot: str, counters: list[str]) -> Callable:
    """Micro-batch sink of counter growth since each entity's previous snapshot, for streams without a
    watermark; with one, ``stateful.counter_growth`` keeps the state in the state store.

    The last snapshot of each entity is a table of its own, one version per batch, so a replayed
    batch starts from the same state and replaces its own output. An entity's first snapshot
    reports absolute values. A snapshot that isn't newer than the state comes out too, marked
    ``is_late``, without growth.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = materialize(batch.select(*keys, snapshot, *counters), "snapshots")
        last = _state(spark, state_path, batch_id, rows.limit(0))
        old = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(snapshot).alias("_at"), *[F.col(c).alias(f"_old_{c}") for c in counters])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & rows[k].eqNullSafe(old[f"_k{i}"])
        met = rows.join(old, same, "left").withColumn("is_late", F.coalesce(F.col(snapshot) <= F.col("_at"), F.lit(False)))
        order = Window.partitionBy(*keys, "is_late").orderBy(snapshot)
        grown = {c: F.col(c) - F.coalesce(F.lag(c).over(order), F.col(f"_old_{c}"), F.lit(0)) for c in counters}
        new = met.select(*keys, snapshot, *[F.when(~F.col("is_late"), g).cast("long").alias(c) for c, g in grown.items()], "is_late")
        reset = F.exists(F.array(*counters), lambda v: v < 0)
        write_batch(new.withColumn("is_reset", F.coalesce(reset, F.lit(False))), out_path, batch_id)
        newest = F.max_by(F.struct(snapshot, *counters), snapshot).alias("_s")
        state = last.unionByName(rows).groupBy(*keys).agg(newest).select(*keys, "_s.*")
        write_batch(state, state_path, batch_id)
        _forget(spark, state_path, batch_id)

    return write


def alert_writer(
    spec: list[tuple], fires_path: str, state_path: str, metric: str = "metric", value: str = "value", ts: str = "ts", by: list[str] | None = None
) -> Callable:
    """Micro-batch sink of threshold alerts with quiet periods, per ``by`` (the server), for streams
    without a watermark; with one, ``stateful.quiet_period_alerts`` counts late breaches too.

    The last fire per server and alert is a table of its own, one version per batch: a replayed
    batch sees the same state and replaces the same output. Inside a batch the distributed
    batch operator does the work.
    """
    keys = [*(by or []), "alert"]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hits = breaches(batch, spec, metric, value, ts, by)
        none = hits.select(*keys, F.lit(0).cast("long").alias("sec")).limit(0)
        last = _state(spark, state_path, batch_id, none)
        fired = materialize(quiet_alerts(hits, last, by), "fired")
        write_batch(fired, fires_path, batch_id)
        newest = last.unionByName(fired.select(*keys, second_of("fired_at").alias("sec"))).groupBy(*keys).agg(F.max("sec").alias("sec"))
        write_batch(newest, state_path, batch_id)
        _forget(spark, state_path, batch_id)

    return write


__all__ = [
    "alert_writer",
    "batch_writer",
    "delta_writer",
    "event_stamp",
    "history_writer",
    "latest_update",
    "run_available",
    "stream_daily_kpi",
    "stream_dedup",
    "stream_rules",
    "time_of",
]
