"""Event-capture queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from watchloom.functions.events import action_field, data_field, event_fields, params_to_columns
from watchloom.operators import capture_reports as R
from watchloom.operators.aggregates import access_summary, daily_kpi
from watchloom.operators.filters import capture_rules, event_rules, in_window
from watchloom.plans.adapters import (
    EVENTS_AS_OF,
    EVENTS_WIDE_SQL,
    block_event_xml,
    ev_xml,
    events_wide,
    report_xml,
)
from watchloom.plans.registry import query
from watchloom.session import load, scratch_path
from watchloom.sources.captures import normalise_block_reports, read_event_capture

START, END = datetime(2024, 1, 10), datetime(2024, 1, 30, 23, 59, 59)


EVENTS_PER_FILE = 250_000
_files: dict[tuple, str] = {}


def written(docs, label="capture"):
    """Capture files of an (event_id, xml) frame, one event per document; the same frame is written once per application."""
    rows = docs.select("xml")
    key = (docs.sparkSession.sparkContext.applicationId, label, rows.semanticHash())
    if key not in _files:
        path = scratch_path(docs.sparkSession, label)
        # Packed, as tags repeat; such a file is read by one task, so each holds a bounded number of events.
        rows.write.option("maxRecordsPerFile", EVENTS_PER_FILE).text(path, compression="gzip")
        _files[key] = path
    return _files[key]


def parsed(spark, sf, categories=None):
    return read_event_capture(spark, written(ev_xml(spark, sf)), 0, categories)


@query(
    "event_capture",
    """
    SELECT strftime(ts + INTERVAL 210 MINUTE, '%Y-%m-%d') AS log_date, ts + INTERVAL 210 MINUTE AS log_ts,
           event_type AS category, CAST(round(value * 100000) AS BIGINT) AS duration, CAST(user_id AS INTEGER) AS session_id
    FROM events WHERE event_type IN ('error', 'purchase')
    """,
)
def q_event_capture(spark, sf):
    cap = read_event_capture(spark, written(ev_xml(spark, sf)), 210, ["error", "purchase"])
    return cap.select(
        F.col("log_date").cast("string").alias("log_date"),
        "log_ts",
        "category",
        data_field("event", "duration", "long").alias("duration"),
        action_field("event", "session_id", "int").alias("session_id"),
    )


@query(
    "block_reports",
    """
    WITH r AS (
      SELECT *, CASE WHEN event_id % 5 <> 0 THEN CAST(dayofyear(ts) AS VARCHAR) END AS loop FROM events WHERE event_id % 7 <> 0),
    k AS (
      SELECT 'table' AS kind, date_trunc('second', ts) AS end_time, * EXCLUDE (ts) FROM r
      UNION ALL SELECT 'file', date_trunc('second', ts), * EXCLUDE (ts) FROM r
      UNION ALL SELECT 'session', ts, * EXCLUDE (ts) FROM r
      UNION ALL SELECT 'document', date_trunc('second', ts), * EXCLUDE (ts) FROM r)
    SELECT kind, coalesce(loop, strftime(end_time, '%Y-%m-%d %H:%M:%S')) AS monitorloop, end_time,
           CAST(user_id AS INTEGER) AS blocked_spid, 0 AS blocked_ecid,
           CAST(user_id // 2 AS INTEGER) AS blocking_spid, 0 AS blocking_ecid
    FROM k
    """,
)
def q_block_reports(spark, sf):
    reports = report_xml(spark, sf)
    second = F.date_trunc("second", "ts").cast("timestamp_ntz")
    table = normalise_block_reports(reports.withColumn("end_time", second), "table", "report", "end_time")
    # the same reports as an exported trace file: one tab-separated line each
    path = scratch_path(spark, "reports")
    reports.select(F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "report")).write.text(path)
    cells = F.split("value", "\t", 2)
    exported = spark.read.text(path).select(cells[0].alias("end_time"), cells[1].alias("report"))
    file = normalise_block_reports(exported, "file", "report", "end_time")
    session = normalise_block_reports(block_event_xml(spark, sf), "session")
    escaped = F.replace(F.replace(F.col("report"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    doc = F.concat(
        F.lit('<Event name="Blocked process report"><Column name="EndTime">'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit('</Column><Column name="TextData">'),
        escaped,
        F.lit("</Column></Event>"),
    )
    document = normalise_block_reports(reports.select(doc.alias("xml")), "document")
    out = None
    for kind, df in (("table", table), ("file", file), ("session", session), ("document", document)):
        df = df.drop("report").withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df)
    return out


@query(
    "event_fields",
    f"""
    WITH {EVENTS_WIDE_SQL}
    SELECT event_id, event_type AS category, duration, error_number, message, session_id, database_name,
           client_app_name, client_hostname, username, CAST(NULL AS VARCHAR) AS missing
    FROM ev
    """,
)
def q_event_fields(spark, sf):
    from watchloom.functions.events import parse_event

    rows = ev_xml(spark, sf).select("event_id", parse_event("xml").alias("event"))
    spec = {
        "duration": ("data", "duration", "long"),
        "error_number": ("data", "error_number", "int"),
        "message": ("data", "message", "string"),
        "session_id": ("action", "session_id", "int"),
        "database_name": ("action", "database_name", "string"),
        "client_app_name": ("action", "client_app_name", "string"),
        "client_hostname": ("action", "client_hostname", "string"),
        "username": ("action", "username", "string"),
        "missing": ("data", "no_such_field", "string"),
    }
    return event_fields(rows, spec, keep=["event_id", F.col("event._name").alias("category")])


@query(
    "slow_ops",
    f"""
    WITH {EVENTS_WIDE_SQL}
    SELECT ts AS log_ts, duration / 1e6 AS duration_s, session_id, client_hostname AS client_host_name, client_app_name
    FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-30 23:59:59'
    """,
)
def q_slow_ops(spark, sf):
    out = R.slow_ops(parsed(spark, sf), EVENTS_AS_OF, START, END)
    return out.select("log_ts", "duration_s", "session_id", "client_host_name", "client_app_name")


@query(
    "contention",
    f"""
    WITH {EVENTS_WIDE_SQL}
    SELECT ts AS log_ts, database_id, CAST(duration AS INTEGER) AS duration, session_id, client_app_name,
           client_hostname AS client_host_name, CAST(NULL AS INTEGER) AS page_id
    FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-30 23:59:59' AND event_type = 'click'
    """,
)
def q_contention(spark, sf):
    out = R.contention(parsed(spark, sf, ["click"]), EVENTS_AS_OF, START, END)
    return out.select("log_ts", "database_id", "duration", "session_id", "client_app_name", "client_host_name", "page_id")


DAY_COLS = ", ".join(
    f"CAST(sum(CASE WHEN ago = {n} THEN n END) AS BIGINT) AS d{n}" for n in range(8)
)


@query(
    "day_pivot",
    f"""
    WITH {EVENTS_WIDE_SQL},
    g AS (SELECT CAST(error_number AS VARCHAR) AS error_number, message, database_name, client_app_name,
                 date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') AS ago, count(*) AS n
          FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-30 23:59:59' AND event_type = 'error'
          GROUP BY ALL)
    SELECT error_number, message, database_name, client_app_name, {DAY_COLS}
    FROM g GROUP BY error_number, message, database_name, client_app_name
    """,
)
def q_day_pivot(spark, sf):
    return R.suspicious_pivot(parsed(spark, sf, ["error"]), EVENTS_AS_OF, START, END)


@query(
    "suspicious_detail",
    f"""
    WITH {EVENTS_WIDE_SQL}
    SELECT ts AS log_ts, CAST(error_number AS VARCHAR) AS error_number, event_type AS severity, message, username,
           database_name, client_app_name
    FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-30 23:59:59' AND event_type = 'error'
    """,
)
def q_suspicious_detail(spark, sf):
    return R.suspicious_detail(parsed(spark, sf, ["error"]), EVENTS_AS_OF, START, END)


@query(
    "failover_history",
    f"""
    WITH {EVENTS_WIDE_SQL}
    SELECT ts AS log_ts, error_number, message FROM ev
    WHERE event_type = 'error' AND error_number = 104 AND ts BETWEEN TIMESTAMP '2023-01-31' AND TIMESTAMP '2024-01-31'
    """,
)
def q_failover_history(spark, sf):
    cap = parsed(spark, sf, ["error"]).withColumn("category", F.lit("error_reported"))
    return R.failover_history(cap, EVENTS_AS_OF, error_number=104)


@query(
    "group_incidents",
    """
    WITH r AS (
      SELECT 'update ' || event_type || '|' || 'lock ' || (user_id % 10) AS factors,
             CAST(round(value * 100000) AS BIGINT) AS duration,
             '<blocked-process-report' || CASE WHEN event_id % 5 <> 0 THEN ' monitorLoop="' || dayofyear(ts) || '"' ELSE '' END
             || '><blocked-process><process spid="' || user_id || '" ecid="0"><inputbuf>update ' || event_type
             || '</inputbuf></process></blocked-process><blocking-process><process'
             || CASE WHEN event_id % 7 <> 0 THEN ' spid="' || (user_id // 2) || '"' ELSE '' END
             || ' ecid="0"><inputbuf>lock ' || (user_id % 10) || '</inputbuf></process></blocking-process></blocked-process-report>' AS payload
      FROM events)
    SELECT md5(factors) AS incident_id, factors, count(*) AS occurrence,
           CAST(sum(duration) // 1000 AS BIGINT) AS total_ms,
           CAST((sum(duration) // count(*)) // 1000 AS BIGINT) AS average_ms,
           arg_min(payload, CAST('0x' || substring(md5(payload), 1, 15) AS BIGINT)) AS sample
    FROM r GROUP BY factors
    """,
)
def q_group_incidents(spark, sf):
    return R.block_incidents(read_event_capture(spark, written(block_event_xml(spark, sf), "blocks")))


@query(
    "deadlock_incidents",
    """
    WITH r AS (
      SELECT 'select ' || event_type || '|' || 'delete ' || (user_id % 4) AS factors, event_id FROM events WHERE event_id % 9 <> 0)
    SELECT md5(factors) AS incident_id, factors, count(*) AS occurrence FROM r GROUP BY factors
    """,
)
def q_deadlock_incidents(spark, sf):
    eid = F.col("event_id")

    def proc(text):
        return F.concat(F.lit("<process><inputbuf>"), text, F.lit("</inputbuf></process>"))

    both = F.concat(
        proc(F.concat(F.lit("select "), F.col("event_type"))),
        proc(F.concat(F.lit("delete "), (F.col("user_id") % 4).cast("string"))),
    )
    # every ninth report lists processes without statements and cannot be grouped
    listed = F.when(eid % 9 != 0, both).otherwise("<process></process>")
    xml = F.concat(
        F.lit('<event name="xml_deadlock_report" timestamp="'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.lit('Z"><data name="xml_report"><value><deadlock><process-list>'),
        listed,
        F.lit("</process-list></deadlock></value></data></event>"),
    )
    docs = load(spark, sf, "events").repartition(spark.sparkContext.defaultParallelism).select(xml.alias("xml"))
    return R.deadlock_incidents(read_event_capture(spark, written(docs, "deadlocks"))).drop("sample")


RULES_SQL = f"""
    WITH {EVENTS_WIDE_SQL},
    k AS (SELECT event_id, event_type AS category, duration, database_id, error_number, message, client_app_name AS statement FROM ev)
    SELECT event_id, 'slow' AS rule_name FROM k WHERE duration > 2000000 AND NOT starts_with(lower(statement), 'app1')
    UNION ALL SELECT event_id, 'contention' FROM k WHERE duration > 20 AND database_id = 2
    UNION ALL SELECT event_id, 'suspicious' FROM k
      WHERE error_number IN (102, 105, 205, 207, 208, 245, 2812, 18456) OR message ILIKE '%permission%' OR message ILIKE '%denied%'
"""


@query("event_rules", RULES_SQL)
def q_event_rules(spark, sf):
    rules = capture_rules("event_type", "duration", "client_app_name", "database_id", "error_number", "message", "APP1")
    return event_rules(events_wide(spark, sf), rules).select("event_id", "rule_name")


@query(
    "access_summary",
    f"""
    WITH {EVENTS_WIDE_SQL}
    SELECT username AS principal, client_hostname, client_app_name, max(ts) AS last_seen, count(*) AS login_count,
           CASE WHEN any_value(session_id) % 10 = 0 THEN 1 ELSE 0 END AS is_admin
    FROM ev WHERE event_type = 'signup' GROUP BY username, client_hostname, client_app_name
    """,
)
def q_access_summary(spark, sf):
    logins = R.successful_logins(parsed(spark, sf, ["signup"]))
    users = load(spark, sf, "events").where("user_id % 10 = 0")
    admins = users.select(F.concat(F.lit("user"), F.col("user_id").cast("string"))).distinct()
    return access_summary(logins, ["principal", "client_hostname", "client_app_name"], "log_ts", admins)


@query(
    "daily_kpi",
    """
    SELECT CAST(ts AS DATE) AS log_date, event_type AS category, count(*) AS occurrence_per_day
    FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-30 23:59:59'
    GROUP BY CAST(ts AS DATE), event_type
    """,
)
def q_daily_kpi(spark, sf):
    return daily_kpi(in_window(load(spark, sf, "events"), "ts", EVENTS_AS_OF, START, END), "ts", "event_type")


@query(
    "kv_columns",
    """
    SELECT c_custkey, 'ftp' AS protocol, 'host' || (c_custkey % 9) AS host, CAST(20 + c_nationkey AS INTEGER) AS port,
           CASE WHEN c_custkey % 3 = 0 THEN 'key' || c_custkey END AS sshhostkey, c_name AS username
    FROM customer
    """,
)
def q_kv_columns(spark, sf):
    def param(name, value):
        return F.coalesce(F.concat(F.lit(f'<param name="{name}">'), value, F.lit("</param>")), F.lit(""))

    key = F.col("c_custkey")
    doc = F.concat(
        F.lit("<root>"),
        param("protocol", F.lit("ftp")),
        param("host", F.concat(F.lit("host"), (key % 9).cast("string"))),
        param("port", (F.col("c_nationkey") + 20).cast("string")),
        param("sshhostkey", F.when(key % 3 == 0, F.concat(F.lit("key"), key.cast("string")))),
        param("username", F.col("c_name")),
        F.lit("</root>"),
    )
    docs = load(spark, sf, "customer").select("c_custkey", doc.alias("connection"))
    names = {"protocol": "string", "host": "string", "port": "int", "sshhostkey": "string", "username": "string"}
    return params_to_columns(docs, "connection", names).drop("connection")
