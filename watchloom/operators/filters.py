"""Row filters."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.times import ntz

# Wait types that only say a background worker is idle.
BENIGN_WAITS = [
    "BROKER_EVENTHANDLER", "BROKER_RECEIVE_WAITFOR", "BROKER_TASK_STOP", "BROKER_TO_FLUSH",
    "BROKER_TRANSMITTER", "CHECKPOINT_QUEUE", "CHKPT", "CLR_AUTO_EVENT", "CLR_MANUAL_EVENT",
    "CLR_SEMAPHORE", "DBMIRROR_DBM_EVENT", "DBMIRROR_EVENTS_QUEUE", "DBMIRROR_WORKER_QUEUE",
    "DBMIRRORING_CMD", "DIRTY_PAGE_POLL", "DISPATCHER_QUEUE_SEMAPHORE", "EXECSYNC", "FSAGENT",
    "FT_IFTS_SCHEDULER_IDLE_WAIT", "FT_IFTSHC_MUTEX", "HADR_CLUSAPI_CALL",
    "HADR_FILESTREAM_IOMGR_IOCOMPLETION", "HADR_LOGCAPTURE_WAIT", "HADR_NOTIFICATION_DEQUEUE",
    "HADR_TIMER_TASK", "HADR_WORK_QUEUE", "KSOURCE_WAKEUP", "LAZYWRITER_SLEEP", "LOGMGR_QUEUE",
    "ONDEMAND_TASK_QUEUE", "PWAIT_ALL_COMPONENTS_INITIALIZED", "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP",
    "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP", "REQUEST_FOR_DEADLOCK_SEARCH", "RESOURCE_QUEUE",
    "SERVER_IDLE_CHECK", "SLEEP_BPOOL_FLUSH", "SLEEP_DBSTARTUP", "SLEEP_DCOMSTARTUP",
    "SLEEP_MASTERDBREADY", "SLEEP_MASTERMDREADY", "SLEEP_MASTERUPGRADED", "SLEEP_MSDBSTARTUP",
    "SLEEP_SYSTEMTASK", "SLEEP_TASK", "SLEEP_TEMPDBSTARTUP", "SNI_HTTP_ACCEPT",
    "SP_SERVER_DIAGNOSTICS_SLEEP", "SQLTRACE_BUFFER_FLUSH", "SQLTRACE_INCREMENTAL_FLUSH_SLEEP",
    "SQLTRACE_WAIT_ENTRIES", "WAIT_FOR_RESULTS", "WAITFOR", "WAITFOR_TASKSHUTDOWN",
    "WAIT_XTP_HOST_WAIT", "WAIT_XTP_OFFLINE_CKPT_NEW_LOG", "WAIT_XTP_CKPT_CLOSE",
    "XE_DISPATCHER_JOIN", "XE_DISPATCHER_WAIT", "XE_TIMER_EVENT", "SOS_WORK_DISPATCHER",
]

# Error numbers that point at probing or injection.
SUSPICIOUS_ERRORS = [102, 105, 205, 207, 208, 245, 2812, 18456]


def default_window(as_of: datetime, start: datetime | None = None, end: datetime | None = None) -> tuple[datetime, datetime]:
    """Yesterday 00:00:00 to today 23:59:59 around ``as_of`` where a bound is missing."""
    today = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    return start or today - timedelta(days=1), end or today + timedelta(days=1, seconds=-1)


def in_window(df: DataFrame, ts: str, as_of: datetime, start=None, end=None, partition: str | None = None) -> DataFrame:
    """Inclusive time window; bounds are literals, so they reach the scan.

    ``partition`` names a date partition column to prune with the same bounds.
    """
    lo, hi = default_window(as_of, start, end)
    out = df.where(F.col(ts).between(ntz(lo), ntz(hi)))
    if partition:
        out = out.where(F.col(partition).between(F.lit(lo.date()), F.lit(hi.date())))
    return out


def drop_benign(df: DataFrame, col: str, names: list[str] | None = None) -> DataFrame:
    return df.where(~F.col(col).isin(names if names is not None else BENIGN_WAITS))


def long_running(df: DataFrame, start: str, as_of: datetime, secs: int, state: str | None = None, is_user: str | None = None) -> DataFrame:
    """Active user work that started at least ``secs`` seconds before ``as_of``.

    Seconds are counted in crossed boundaries; the bound is a literal that reaches the scan.
    """
    limit = as_of.replace(microsecond=0) - timedelta(seconds=secs - 1)
    cond = F.col(start) < ntz(limit)
    if state:
        cond = cond & (F.col(state) != "sleeping")
    if is_user:
        cond = cond & F.col(is_user)
    return df.where(cond)


def idle_entities(
    df: DataFrame,
    minutes: int,
    as_of: datetime,
    last_start: str = "last_start",
    last_end: str = "last_end",
    state: str = "state",
    program: str = "program",
    login: str = "login",
    host: str = "host",
    except_active: bool = True,
    except_jobs: bool = True,
    except_tools: bool = True,
    admins: DataFrame | None = None,
    except_logins: list[str] = (),
    except_hosts: list[str] = (),
) -> DataFrame:
    """Sessions without activity for ``minutes``, less the switched-off groups.

    ``admins`` is a one-column table of logins to leave alone; name lists ignore case.
    """
    last = F.greatest(F.col(last_start), F.col(last_end)).cast("timestamp_ntz")
    # counted in crossed minute boundaries
    idle = F.timestamp_diff("MINUTE", F.date_trunc("minute", last).cast("timestamp_ntz"), ntz(as_of.replace(second=0, microsecond=0)))
    cond = idle >= minutes
    if except_active:
        cond &= F.col(state) == "sleeping"
    if except_jobs:
        for prefix in ("SQLAgent", "SQL Server Data Collector", "SSIS"):
            cond &= ~F.lower(F.col(program)).startswith(prefix.lower())
    if except_tools:
        cond &= ~F.lower(F.col(program)).startswith("microsoft sql server management studio")
    for col, names in ((login, [*except_logins, "NT AUTHORITY\\SYSTEM"]), (host, list(except_hosts))):
        if names:
            cond &= ~F.lower(F.col(col)).isin([n.lower() for n in names])
    out = df.where(cond).withColumn("idle_minutes", idle)
    if admins is not None:
        out = out.join(admins.toDF(login), login, "left_anti")
    return out


def event_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per (event, matching rule); the same call serves a stream."""
    hits = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("rule_name", F.explode(hits))


def capture_rules(category: str, duration: str, text: str, database_id: str, error_number: str, message: str, prefix: str) -> dict[str, Column]:
    """The capture sessions' predicates over parsed event columns."""
    low = F.lower(F.col(message))
    return {
        "slow": (F.col(duration) > 2_000_000) & ~F.lower(F.col(text)).startswith(prefix.lower()),
        "contention": (F.col(duration) > 20) & (F.col(database_id) == 2),
        "suspicious": F.col(error_number).isin(SUSPICIOUS_ERRORS) | low.contains("permission") | low.contains("denied"),
        "deprecated": F.col(category).isin("deprecation_announcement", "deprecation_final_support"),
        "memory_underestimate": F.col(category).isin("hash_warning", "sort_warning", "hash_spill_details", "exchange_spill"),
    }


def pattern_scan(df: DataFrame, text: str, patterns: list[str], out: str = "pattern") -> DataFrame:
    """One row per (row, distinct pattern found in its text), ignoring case.

    Each text is lowered and scanned in place; ``patterns`` is a short literal list, so no
    join is needed.
    """
    low = F.lower(F.col(text))
    hits = F.filter(F.array(*[F.when(low.contains(p.lower()), F.lit(p)) for p in dict.fromkeys(patterns)]), lambda x: x.isNotNull())
    return df.withColumn(out, F.explode(hits))


def only_issues(df: DataFrame, result: str = "result") -> DataFrame:
    return df.where(~F.col(result).isin("OK", "Info"))


# Base sets of the selector language: keyword -> condition over the catalog flags.
def _base_sets() -> dict[str, Column]:
    return {
        "ALL_USER_DATABASES": ~F.col("is_system") & (F.col("state") != "OFFLINE"),
        "AOAG_REPLICA_DATABASES": F.col("replica_role").isNotNull(),
        "ALL_SYSTEM_DATABASES": F.col("is_system"),
        "ALL_DATABASES": F.col("state") != "OFFLINE",
        "ALL_MIRROR_DATABASES": F.col("is_mirror"),
    }


def parse_selector(expr: str) -> tuple[str | None, list[str], list[str], list[str]]:
    """(base keyword, excluded, included, plain names) of a selector expression."""
    import re

    def names(text):
        return [n for n in text.split(",") if n.strip()]

    base = next((k for k in _base_sets() if expr.upper().startswith(f"<{k}>")), None)
    found = {k: re.search(rf"<{k}:([^>]*)>", expr, re.I) for k in ("EXCLUDE", "INCLUDE")}
    exclude, include = (names(m.group(1)) if m else [] for m in (found["EXCLUDE"], found["INCLUDE"]))
    return base, exclude, include, ([] if base else names(expr))


def select_entities(
    catalog: DataFrame,
    expr: str,
    validate: bool = True,
    drop_temp: bool = True,
    drop_snapshots: bool = True,
    drop_read_only: bool = True,
    drop_replicas: bool = True,
) -> DataFrame:
    """Names selected by ``<BASE><EXCLUDE:a,b><INCLUDE:c>`` or a plain list, then filtered.

    ``catalog`` has (name, is_system, is_mirror, state, is_snapshot, is_read_only,
    replica_role). One pass over the catalog; names match without case. With
    ``validate=False`` listed names missing from the catalog are kept.
    """
    base, exclude, include, plain = parse_selector(expr)
    key = F.lower(F.col("name"))

    def listed(values):
        return key.isin([v.lower() for v in values]) if values else F.lit(False)

    chosen = (_base_sets()[base] & ~listed(exclude)) | listed(include) if base else listed(plain)
    keep = chosen
    if base != "ALL_MIRROR_DATABASES":
        keep &= F.col("state") == "ONLINE"
    if drop_snapshots:
        keep &= ~F.col("is_snapshot")
    if drop_temp:
        keep &= key != "tempdb"
    if drop_read_only:
        keep &= ~F.col("is_read_only")
    if drop_replicas:
        keep &= ~F.coalesce(F.col("replica_role") == "SECONDARY", F.lit(False))
    out = catalog.where(keep).select("name")
    loose = include if base else plain
    if not validate and loose:
        spark = catalog.sparkSession
        asked = spark.createDataFrame([(n,) for n in loose], "name string")
        known = catalog.where(listed(loose)).select(key.alias("_k"))
        missing = asked.join(known, F.lower(asked["name"]) == known["_k"], "left_anti")
        out = out.unionByName(missing.where(key != "tempdb") if drop_temp else missing)
    return out
