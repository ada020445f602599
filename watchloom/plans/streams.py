"""Streaming queries: the events arrive in time-ordered slices and each job catches up in turn."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from watchloom.functions.times import ntz
from watchloom.operators.alerting import breaches, code_alerts, quiet_alerts
from watchloom.operators.filters import capture_rules
from watchloom.plans.adapters import EVENTS_AS_OF, events_wide
from watchloom.plans.captures import RULES_SQL
from watchloom.plans.registry import query
from watchloom.session import load, scratch_path
from watchloom.streaming import jobs as J
from watchloom.streaming.stateful import counter_growth, quiet_period_alerts, rocksdb_state

# Slice bounds of the replayed feed.
CUTS = [datetime(2024, 1, 11), datetime(2024, 1, 21)]


def heartbeat(spark):
    """One row after all events: it moves the watermark past them and itself stays pending."""
    return spark.range(1).select(ntz(EVENTS_AS_OF + timedelta(days=2)).alias("ts"))


def replay(spark, df, run):
    """Append ``df`` slice by slice to a folder and let ``run`` catch up after each."""
    src = scratch_path(spark, "feed")
    bounds = [None, *CUTS, None]
    stream = None
    for lo, hi in zip(bounds, bounds[1:]):
        part = df
        if lo is not None:
            part = part.where(F.col("ts") >= ntz(lo))
        if hi is not None:
            part = part.where((F.col("ts") < ntz(hi)) | (F.lit(lo is None) & F.col("ts").isNull()))
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        run(stream)


@query("stream_event_rules", RULES_SQL)
def q_stream_event_rules(spark, sf):
    out, ckpt = scratch_path(spark, "rules"), scratch_path(spark, "rules-ckpt")
    rules = capture_rules("event_type", "duration", "client_app_name", "database_id", "error_number", "message", "APP1")

    def run(stream):
        J.run_available(J.stream_rules(stream, rules).select("event_id", "rule_name"), ckpt, out)

    replay(spark, events_wide(spark, sf), run)
    return spark.read.parquet(out)


@query(
    "code_alerts",
    """
    WITH e AS (SELECT *, 820 + event_id % 10 AS code, 15 + user_id % 8 AS sev FROM events)
    SELECT ts AS alert_time, a.alert AS alert_type,
           '<instance_name>srv1</instance_name>' || chr(13) || chr(10) || '<message>' || event_type || '</message>' AS alert_text
    FROM e JOIN (VALUES (825, 'c', 'ReadRetryRequired'), (19, 's', 'FatalErrorInResource'), (20, 's', 'FatalErrorInCurrentProcess'),
                        (21, 's', 'FatalErrorInDatabaseProcess'), (22, 's', 'TableIntegritySuspect')) a(n, k, alert)
      ON (a.k = 'c' AND a.n = e.code) OR (a.k = 's' AND a.n = e.sev)
    """,
)
def q_code_alerts(spark, sf):
    out, ckpt = scratch_path(spark, "alerts"), scratch_path(spark, "alerts-ckpt")
    e = load(spark, sf, "events").select(
        "ts", "event_type", (820 + F.col("event_id") % 10).alias("code"), (15 + F.col("user_id") % 8).alias("sev")
    )

    def run(stream):
        J.run_available(code_alerts(stream, "code", "sev", "event_type", "ts", "srv1"), ckpt, out)

    replay(spark, e, run)
    return spark.read.parquet(out)


@query(
    "stream_daily_kpi",
    "SELECT CAST(ts AS DATE) AS log_date, event_type AS category, count(*) AS occurrence_per_day FROM events GROUP BY ALL",
)
def q_stream_daily_kpi(spark, sf):
    out, ckpt = scratch_path(spark, "kpi"), scratch_path(spark, "kpi-ckpt")

    def run(stream):
        J.run_available(J.stream_daily_kpi(stream, "ts", "event_type", "1 day"), ckpt, mode="update", each=J.batch_writer(out))

    replay(spark, load(spark, sf, "events").select("ts", "event_type"), run)
    return J.latest_update(spark, out, ["log_date", "category"], "occurrence_per_day")


@query("stream_history", "SELECT event_id, ts, CAST(ts AS DATE) AS log_date FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 15 DAY + INTERVAL 7 HOUR")
def q_stream_history(spark, sf):
    """The stored folder after a purge with each slice, the last one in the middle of a day."""
    out, ckpt = scratch_path(spark, "history"), scratch_path(spark, "history-ckpt")
    moments = iter([*CUTS, EVENTS_AS_OF + timedelta(hours=7)])

    def run(stream):
        J.run_available(stream, ckpt, each=J.history_writer(out, "ts", 15, next(moments)))

    replay(spark, load(spark, sf, "events").select("event_id", "ts"), run)
    return spark.read.parquet(out).drop("batch_id")


@query("stream_dedup", "SELECT DISTINCT md5(event_type || '|' || (user_id % 10)) AS incident_id FROM events")
def q_stream_dedup(spark, sf):
    out, ckpt = scratch_path(spark, "dedup"), scratch_path(spark, "dedup-ckpt")
    key = F.md5(F.concat_ws("|", "event_type", (F.col("user_id") % 10).cast("string")).cast("binary"))

    def run(stream):
        J.run_available(J.stream_dedup(stream, "ts", key, "60 days").select("incident_id"), ckpt, out)

    replay(spark, load(spark, sf, "events").select("ts", "event_type", "user_id"), run)
    return spark.read.parquet(out)


@query(
    "stream_counter_delta",
    """
    WITH d AS (SELECT user_id, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS snapshot_id, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents
               FROM events GROUP BY ALL)
    SELECT user_id, snapshot_id, n - lag(n, 1, 0) OVER w AS n, cents - lag(cents, 1, 0) OVER w AS cents,
           n < lag(n, 1, 0) OVER w OR cents < lag(cents, 1, 0) OVER w AS is_reset, false AS is_late
    FROM d WINDOW w AS (PARTITION BY user_id ORDER BY snapshot_id)
    """,
)
def q_stream_counter_delta(spark, sf):
    """Snapshots of a day, counted against the entity's day before; a heartbeat at the end passes the last day."""
    out, ckpt = scratch_path(spark, "delta"), scratch_path(spark, "delta-ckpt")
    e = load(spark, sf, "events")
    snaps = e.groupBy("user_id", F.date_format("ts", "yyyyMMdd").cast("long").alias("snapshot_id")).agg(
        F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
    )

    def run(stream):
        with rocksdb_state(spark):
            J.run_available(counter_growth(stream, ["user_id"], "snapshot_id", "ts", ["n", "cents"], "1 hour"), ckpt, out)

    replay(spark, snaps.unionByName(heartbeat(spark), allowMissingColumns=True), run)
    return spark.read.parquet(out)


# Alerts over event values: (alert, metric, comparison, bound, quiet seconds).
VALUE_ALERTS = [
    ("HighError", "error", ">", 15.0, 7200),
    ("HighClick", "click", ">", 5.0, 3600),
    ("LowView", "view", "<", 20.0, 90000),
    ("AnyPurchase", "purchase", ">", 30.0, 0),
]

QUIET_SQL = """
    WITH RECURSIVE spec(alert, metric, lo, hi, quiet) AS (VALUES ('HighError', 'error', 15.0, NULL, 7200), ('HighClick', 'click', 5.0, NULL, 3600),
      ('LowView', 'view', NULL, 20.0, 90000), ('AnyPurchase', 'purchase', 30.0, NULL, 1)),
    b AS (SELECT DISTINCT 's' || (user_id % 2) AS server, alert, CAST(quiet AS BIGINT) AS quiet, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS sec FROM events JOIN spec ON metric = event_type
          AND (value > lo::DOUBLE OR value < hi::DOUBLE)),
    f AS (SELECT server, alert, quiet, min(sec) AS sec FROM b GROUP BY ALL
          UNION ALL SELECT b.server, b.alert, b.quiet, min(b.sec) FROM f JOIN b ON b.server = f.server AND b.alert = f.alert AND b.sec >= f.sec + f.quiet
          GROUP BY b.server, b.alert, b.quiet)
    SELECT server, alert, TIMESTAMP '1970-01-01' + INTERVAL 1 SECOND * sec AS fired_at FROM f
"""


def samples(spark, sf):
    """Samples of two servers that breach the same alerts at the same time."""
    server = F.concat(F.lit("s"), (F.col("user_id") % 2).cast("string"))
    return load(spark, sf, "events").select(server.alias("server"), "ts", "event_type", "value")


@query("quiet_alerts", QUIET_SQL)
def q_quiet_alerts(spark, sf):
    return quiet_alerts(breaches(samples(spark, sf), VALUE_ALERTS, "event_type", by=["server"]), by=["server"])


@query("stream_quiet_alerts", QUIET_SQL)
def q_stream_quiet_alerts(spark, sf):
    out, ckpt = scratch_path(spark, "fires"), scratch_path(spark, "fires-ckpt")

    def run(stream):
        with rocksdb_state(spark):
            J.run_available(quiet_period_alerts(stream, VALUE_ALERTS, "1 hour", "event_type", by=["server"]), ckpt, out)

    replay(spark, samples(spark, sf).unionByName(heartbeat(spark), allowMissingColumns=True), run)
    return spark.read.parquet(out).where("NOT is_late").drop("is_late")
