"""Reshape the driver tables into telemetry shapes; each has a SQL twin for the oracle."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.session import load

EVENTS_AS_OF = datetime(2024, 1, 31)
ORDERS_AS_OF = datetime(2001, 12, 1)


def orders_as_of(spark: SparkSession, sf: str) -> datetime:
    """Midnight after the newest order, so that the last days of the table are recent."""
    newest = load(spark, sf, "orders").agg(F.max("o_orderdate")).first()[0]
    return datetime(newest.year, newest.month, newest.day) + timedelta(days=1)


def on_two_servers(df: DataFrame, *dates: str, server: str = "server") -> DataFrame:
    """The rows once for server ``a`` and again, with the same ids, for ``b`` a day later."""
    later = df.withColumns({c: F.col(c) + F.expr("INTERVAL '1' DAY") for c in dates}) if dates else df
    return df.withColumn(server, F.lit("a")).unionByName(later.withColumn(server, F.lit("b")))


def micros(value: str = "value") -> F.Column:
    return F.round(F.col(value) * 100000).cast("long")


def events_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Event fields as plain columns; the XML adapter renders exactly these."""
    return wide(load(spark, sf, "events"))


def wide(events: DataFrame) -> DataFrame:
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1)
    uid, eid = F.col("user_id"), F.col("event_id")
    return events.select(
        "event_id",
        "ts",
        "event_type",
        micros().alias("duration"),
        (100 + eid % 10).cast("int").alias("error_number"),
        F.concat(F.when(eid % 4 == 0, "Permission denied on ").otherwise("Could not find "), k).alias("message"),
        (uid % 5).cast("int").alias("database_id"),
        uid.cast("int").alias("session_id"),
        F.when(eid % 17 != 0, F.concat(F.lit("db"), (uid % 7).cast("string"))).alias("database_name"),
        F.concat(F.lit("app"), (uid % 3).cast("string")).alias("client_app_name"),
        F.concat(F.lit("host"), (uid % 11).cast("string")).alias("client_hostname"),
        F.concat(F.lit("user"), uid.cast("string")).alias("username"),
    )


EVENTS_WIDE_SQL = """
ev AS (
  SELECT event_id, ts, event_type, CAST(round(value * 100000) AS BIGINT) AS duration,
         CAST(100 + event_id % 10 AS INTEGER) AS error_number,
         CASE WHEN event_id % 4 = 0 THEN 'Permission denied on ' ELSE 'Could not find ' END
           || regexp_extract(props, '"k": ([0-9]+)', 1) AS message,
         CAST(user_id % 5 AS INTEGER) AS database_id, CAST(user_id AS INTEGER) AS session_id,
         CASE WHEN event_id % 17 <> 0 THEN 'db' || (user_id % 7) END AS database_name,
         'app' || (user_id % 3) AS client_app_name, 'host' || (user_id % 11) AS client_hostname,
         'user' || user_id AS username
  FROM events)
"""


def _node(kind: str, name: str, value: F.Column) -> F.Column:
    """``<data name="…"><value>…</value></data>``, nothing at all for a null value."""
    text = F.concat(F.lit(f'<{kind} name="{name}"><value>'), value.cast("string"), F.lit(f"</value></{kind}>"))
    return F.coalesce(text, F.lit(""))


def ev_xml(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, xml): one captured event document per source event."""
    e = wide(load(spark, sf, "events").repartition(spark.sparkContext.defaultParallelism))
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    data = [_node("data", n, F.col(n)) for n in ("duration", "error_number", "message", "database_id")]
    severity = F.concat(F.lit('<data name="category"><value>2</value><text>'), F.col("event_type"), F.lit("</text></data>"))
    action = [_node("action", n, F.col(n)) for n in ("session_id", "database_name", "client_app_name", "client_hostname", "username")]
    head = F.concat(F.lit('<event name="'), F.col("event_type"), F.lit('" package="p" timestamp="'), stamp, F.lit('Z">'))
    return e.select("event_id", F.concat(head, *data, severity, *action, F.lit("</event>")).alias("xml"))


def report_xml(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, ts, report): a blocked-process report per event.

    Every fifth lacks the monitor loop, every seventh the blocking side.
    """
    e = load(spark, sf, "events").repartition(spark.sparkContext.defaultParallelism)
    eid, uid = F.col("event_id"), F.col("user_id")
    loop = F.when(eid % 5 != 0, F.concat(F.lit(' monitorLoop="'), F.dayofyear("ts").cast("string"), F.lit('"'))).otherwise("")

    def side(tag, spid, text):
        return F.concat(
            F.lit(f"<{tag}><process"), spid, F.lit(' ecid="0"><inputbuf>'), text, F.lit(f"</inputbuf></process></{tag}>")
        )

    blocked = F.concat(F.lit(' spid="'), uid.cast("string"), F.lit('"'))
    blocking = F.when(eid % 7 != 0, F.concat(F.lit(' spid="'), F.floor(uid / 2).cast("string"), F.lit('"'))).otherwise("")
    report = F.concat(
        F.lit("<blocked-process-report"),
        loop,
        F.lit(">"),
        side("blocked-process", blocked, F.concat(F.lit("update "), F.col("event_type"))),
        side("blocking-process", blocking, F.concat(F.lit("lock "), (uid % 10).cast("string"))),
        F.lit("</blocked-process-report>"),
    )
    return e.select("event_id", "ts", "event_type", micros().alias("duration"), report.alias("report"))


def block_event_xml(spark: SparkSession, sf: str) -> DataFrame:
    """(event_id, xml): captured blocked_process_report events around ``report_xml``."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    xml = F.concat(
        F.lit('<event name="blocked_process_report" timestamp="'), stamp, F.lit('Z"><data name="duration"><value>'),
        F.col("duration").cast("string"), F.lit('</value></data><data name="blocked_process"><value>'),
        F.col("report"), F.lit("</value></data></event>"),
    )
    return report_xml(spark, sf).select("event_id", xml.alias("xml"))
