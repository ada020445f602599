"""Reports over captured events: slow work, contention, suspicious errors, failovers, incidents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.functions.events import action_field, data_field, event_fields, parsed_rows
from watchloom.operators.aggregates import day_pivot, group_incidents
from watchloom.operators.filters import in_window

SLOW_FIELDS = {
    "duration_us": ("data", "duration", "long"),
    "cpu_us": ("data", "cpu_time", "long"),
    "physical_reads": ("data", "physical_reads", "int"),
    "logical_reads": ("data", "logical_reads", "int"),
    "writes": ("data", "writes", "int"),
    "database_id": ("action", "database_id", "int"),
    "statement": ("action", "statement", "string"),
    "session_id": ("action", "session_id", "int"),
    "user_name": ("action", "session_nt_username", "string"),
    "sql_text": ("action", "sql_text", "string"),
    "client_host_name": ("action", "client_hostname", "string"),
    "client_app_name": ("action", "client_app_name", "string"),
    "plan_handle": ("action", "plan_handle", "string"),
}

CONTENTION_FIELDS = {
    "address": ("data", "address", "string"),
    "class": ("data", "class", "string"),
    "database_id": ("data", "database_id", "int"),
    "destroy_count": ("data", "destroy_count", "int"),
    "duration": ("data", "duration", "int"),
    "exclusive_count": ("data", "exclusive_count", "int"),
    "file_id": ("data", "file_id", "int"),
    "has_waiters": ("data", "has_waiters", "string"),
    "is_poisoned": ("data", "is_poisoned", "string"),
    "is_superlatch": ("data", "is_superlatch", "string"),
    "keep_count": ("data", "keep_count", "int"),
    "mode": ("data", "mode", "int"),
    "page_id": ("data", "page_id", "int"),
    "shared_count": ("data", "shared_count", "int"),
    "success": ("data", "success", "string"),
    "update_count": ("data", "update_count", "int"),
    "session_id": ("action", "session_id", "int"),
    "user_database_id": ("action", "database_id", "int"),
    "client_app_name": ("action", "client_app_name", "string"),
    "client_host_name": ("action", "client_hostname", "string"),
    "sql_text": ("action", "sql_text", "string"),
}

ERROR_FIELDS = {
    "error_number": ("data", "error_number", "string"),
    "severity": ("text", "category", "string"),
    "message": ("data", "message", "string"),
    "username": ("action", "username", "string"),
    "database_name": ("action", "database_name", "string"),
    "client_app_name": ("action", "client_app_name", "string"),
}


def slow_ops(events: DataFrame, as_of: datetime, start=None, end=None) -> DataFrame:
    """Typed slow-operation listing, longest first; times in seconds."""
    rows = event_fields(in_window(events, "log_ts", as_of, start, end), SLOW_FIELDS, keep=["log_ts"])
    return (
        rows.withColumns({"duration_s": F.col("duration_us") / 1e6, "cpu_s": F.col("cpu_us") / 1e6})
        .drop("duration_us", "cpu_us")
        .orderBy(F.col("duration_s").desc())
    )


def contention(events: DataFrame, as_of: datetime, start=None, end=None) -> DataFrame:
    return event_fields(in_window(events, "log_ts", as_of, start, end), CONTENTION_FIELDS, keep=["log_ts"])


def suspicious_pivot(events: DataFrame, as_of: datetime, start=None, end=None, days: int = 7) -> DataFrame:
    keys = ["error_number", "message", "database_name", "client_app_name"]
    spec = {k: ERROR_FIELDS[k] for k in keys}
    rows = event_fields(in_window(events, "log_ts", as_of, start, end), spec, keep=["log_ts"])
    return day_pivot(rows, keys, "log_ts", as_of, days)


def suspicious_detail(events: DataFrame, as_of: datetime, start=None, end=None) -> DataFrame:
    rows = event_fields(in_window(events, "log_ts", as_of, start, end), ERROR_FIELDS, keep=["log_ts"])
    return rows.orderBy(F.col("log_ts").desc())


def failover_history(events: DataFrame, as_of: datetime, start=None, end=None, error_number: int = 1480) -> DataFrame:
    """Role-change messages; default range is the last year."""
    if start is None:
        leap_day = (as_of.month, as_of.day) == (2, 29)
        start = as_of.replace(year=as_of.year - 1, day=28 if leap_day else as_of.day)
    rows = in_window(events.where(F.col("category") == "error_reported"), "log_ts", as_of, start, end or as_of)
    columns = {"error_number": data_field("event", "error_number", "int"), "message": data_field("event", "message")}
    return parsed_rows(rows, columns, lambda x: x["error_number"] == error_number, ["log_ts"])


def successful_logins(events: DataFrame) -> DataFrame:
    return events.select(
        "log_ts",
        action_field("event", "username").alias("principal"),
        action_field("event", "client_hostname").alias("client_hostname"),
        action_field("event", "client_app_name").alias("client_app_name"),
    )


BLOCK_SIDES = (
    "`blocked-process` struct<process: struct<inputbuf: string>>, "
    "`blocking-process` struct<process: struct<inputbuf: string>>"
)
DEADLOCK = "deadlock struct<`process-list`: struct<process: array<struct<inputbuf: string>>>>"


def block_incidents(events: DataFrame) -> DataFrame:
    """Blocking incidents grouped by the statements of both sides."""
    rows = parsed_rows(
        events.where(F.col("category") == "blocked_process_report"),
        {"duration": data_field("event", "duration", "long"), "payload": data_field("event", "blocked_process")},
        lambda x: x["payload"].isNotNull(),
    )
    rows = rows.withColumn("r", F.from_xml("payload", BLOCK_SIDES))
    sides = [F.coalesce(F.col(f"r.`{s}-process`.process.inputbuf"), F.lit("")) for s in ("blocked", "blocking")]
    return group_incidents(rows.withColumn("factors", F.concat_ws("|", *sides)), "factors", "duration", "payload")


def deadlock_incidents(events: DataFrame) -> DataFrame:
    """Deadlocks grouped by the participants' statements in listed order."""
    rows = events.where(F.col("category") == "xml_deadlock_report")
    rows = rows.select(F.get(F.col("event.data"), F.lit(0))["value"].alias("payload"))
    rows = rows.withColumn("d", F.from_xml(F.concat(F.lit("<v>"), F.col("payload"), F.lit("</v>")), DEADLOCK))
    parts = F.transform(F.col("d.deadlock.`process-list`.process"), lambda p: p["inputbuf"])
    factors = F.array_join(F.filter(parts, lambda x: x.isNotNull()), "|")
    rows = parsed_rows(rows, {"factors": factors, "payload": F.col("payload")}, lambda x: x["factors"] != "")
    return group_incidents(rows, "factors", None, "payload")
