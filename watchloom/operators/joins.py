"""Join-shaped operators."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.times import ntz
from watchloom.functions.numbers import pages_kb
from watchloom.functions.text import slice_statement
from watchloom.operators.filters import long_running
from watchloom.operators.ranking import first_per_key


def new_entities(current: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    return current.join(previous.select(*key).distinct(), key, "left_anti")


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows without a parent. Null keys on either side are not compared: a null parent
    key never hides an orphan and a null child key is not one."""
    keys = parent.where(F.col(pk).isNotNull()).select(F.col(pk).alias(fk)).distinct()
    return child.where(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def having_match(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    return df.join(other, on, "left_semi")


def only_kind_recently(df: DataFrame, key: str, kind: Column, ts: str, days: int, as_of: datetime, details: list[Column] = ()) -> DataFrame:
    """Groups whose records of the last ``days`` days are all of one kind.

    One conditional aggregate instead of a correlated NOT EXISTS.
    """
    since = ntz(as_of - timedelta(days=days))
    recent = df.where(F.col(ts) >= since)
    return (
        recent.groupBy(key)
        .agg(F.max(F.when(~kind, 1).otherwise(0)).alias("_other"), F.count(F.lit(1)).alias("record_count"), *details)
        .where("_other = 0")
        .drop("_other")
    )


def explode_nodes(df: DataFrame, col: str, outer: bool = False) -> DataFrame:
    """Rows of an array of structs beside their parent row; ``outer`` keeps childless parents."""
    fn = F.inline_outer if outer else F.inline
    return df.select(*[c for c in df.columns if c != col], fn(col))


def assign_range(df: DataFrame, col: str, bounds: list, right: bool = True, out: str = "partition_no") -> DataFrame:
    """1-based partition number of a value between sorted boundary values, open at both ends.

    ``right``: a boundary value belongs to the partition on its right. The boundaries are a
    literal array, so the whole thing is one codegen expression per row; ranges are
    half-open, without gap or overlap.
    """
    value, dtype = F.col(col), df.schema[col].dataType
    number = F.lit(1)
    for b in sorted(bounds):
        edge = ntz(b).cast(dtype) if isinstance(b, datetime) else F.lit(b).cast(dtype)
        number = number + (value >= edge if right else value > edge).cast("int")
    return df.withColumn(out, number)


def blocked_by(requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct sessions that block somebody on their server (``by``)."""
    return requests.where("blocking_session_id <> 0").select(*(by or []), F.col("blocking_session_id").alias("session_id")).distinct()


def activity_snapshot(
    sessions: DataFrame,
    connections: DataFrame,
    requests: DataFrame,
    waits: DataFrame,
    grants: DataFrame,
    as_of: datetime,
    secs: int,
    by: list[str] | None = None,
) -> DataFrame:
    """Wide rows of long-running user activity with waits, memory and a head-blocker flag.

    Session ids are local to a server: with ``by`` all tables meet on the server too. Requests
    are filtered before any join; the blocker flag comes from a distinct id list, so a session
    blocking many others still gives one row per request.
    """
    by = list(by or [])
    session = [*by, "session_id"]
    blockers = blocked_by(requests, by).withColumn("_blocks", F.lit(True))
    active = long_running(requests, "start_time", as_of, secs).withColumnRenamed("status", "request_status")
    users = sessions.where(F.col("is_user_process") & (F.col("status") != "sleeping"))
    out = (
        users.join(connections, session)
        .join(active, session)
        .join(waits, session, "left")
        .join(grants, [*session, "request_id"], "left")
        .join(blockers, session, "left")
    )
    head = F.when(F.col("_blocks") & (F.col("blocking_session_id") == 0), 1)
    return out.withColumns(
        {
            "reads_kb": pages_kb("reads"),
            "writes_kb": pages_kb("writes"),
            "logical_reads_kb": pages_kb("logical_reads"),
            "memory_usage_kb": pages_kb("memory_usage"),
            "statement_section": slice_statement("sql_text", "start_offset", "end_offset"),
            "head_blocker": head,
            "log_time": ntz(as_of),
        }
    ).drop("_blocks", "reads", "writes", "logical_reads", "memory_usage", "start_offset", "end_offset")


def late_entities(
    log: DataFrame, inventory: DataFrame, key: str, ts: str, hours: int, as_of: datetime, scan_days: int = 2
) -> DataFrame:
    """Entities whose newest log entry is older than ``hours`` hours, or that have none.

    Only the last ``scan_days`` days of the log are read.
    """
    now = ntz(as_of)
    since = ntz(as_of - timedelta(days=scan_days))
    recent = log.where(F.col(ts).between(since, now) & (F.length(key) > 0))
    latest = first_per_key(recent, [key], [F.col(ts).desc()])
    limit = ntz(as_of - timedelta(hours=hours))
    return inventory.join(latest, key, "left").where(F.col(ts).isNull() | (F.col(ts) < limit))


def late_alert(late: DataFrame, source: str, as_of: datetime) -> DataFrame:
    """One alert row with the number of late entities and whether to page somebody."""
    n = late.agg(F.count(F.lit(1)).alias("n"))
    return n.select(
        F.lit(source).alias("event_source"),
        F.lit("DisasterLatencies").alias("module"),
        ntz(as_of).alias("event_time"),
        F.lit("WRN").alias("severity"),
        F.concat(F.lit("Number of unsynced databases are: "), F.col("n").cast("string")).alias("description"),
        F.when(F.col("n") > 0, 1).otherwise(0).alias("is_sms"),
    )


def resolve_items(requests: DataFrame, items: DataFrame, updated: str = "update_date", numeric_versions: bool = False) -> DataFrame:
    """Best repository item per request.

    A request has (request_id, item_name, item_version, publisher_name); null, blank or
    LATEST versions and a null publisher match anything. The highest version wins, then the
    newest update. Versions compare as text unless ``numeric_versions``.

    The items are first reduced to one best row for every (name, version or any, publisher
    or any), so each request meets one row at most: a popular name with many versions and
    many requests never multiplies out.
    """
    version, publisher = F.col("item_version"), F.col("publisher_name")
    combos = [F.struct(v.alias("_v"), p.alias("_p")) for v in (version, F.lit(None)) for p in (publisher, F.lit(None))]
    rank = F.transform(F.split(version, r"\."), lambda p: p.try_cast("long")) if numeric_versions else version
    offered = items.withColumn("_k", F.explode(F.array(*combos))).select("*", "_k._v", "_k._p").drop("_k")
    best = first_per_key(offered, ["item_name", "_v", "_p"], [rank.desc(), F.col(updated).desc()])
    asked = F.col("item_version")
    any_version = asked.isNull() | (F.upper(asked) == "LATEST") | (F.length(F.trim(asked)) == 0)
    wanted = requests.select(
        "request_id",
        F.col("item_name").alias("_n"),
        F.when(~any_version, asked).alias("_rv"),
        F.col("publisher_name").alias("_rp"),
    )
    same = (F.col("_n") == F.col("item_name")) & F.col("_rv").eqNullSafe(F.col("_v")) & F.col("_rp").eqNullSafe(F.col("_p"))
    return wanted.join(best, same).drop("_n", "_rv", "_rp", "_v", "_p")
