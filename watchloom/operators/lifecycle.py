"""Backup and transfer history analytics."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchloom.functions.times import ntz
from watchloom.functions.text import file_name
from watchloom.operators.ranking import first_per_key, with_group_max

# Fixed value: ratio assumed for entities without history.
DEFAULT_RATIO = 2.499
GB = 1024**3
MAX_FILES = 64

# Requested kind names and their one-letter codes.
KINDS = {"FULL": "D", "LOG": "L", "DIFF": "I"}


def expired(sets: DataFrame, media: DataFrame, as_of: datetime, by: list[str] | None = None) -> DataFrame:
    """Media families whose newest expiry lies before today: their last path and expiry, newest first.

    Media set ids are local to a server: with ``by`` sets and media meet on the server too.
    A set expires on a day before today, that is before today's midnight; the bound is a
    literal that reaches the scan.
    """
    midnight = as_of.replace(hour=0, minute=0, second=0, microsecond=0)
    old = sets.where(F.col("expiration_date") < ntz(midnight))
    by = list(by or [])
    return (
        media.join(old.select(*by, "media_set_id", "expiration_date"), [*by, "media_set_id"])
        .groupBy(*by, "media_family_id")
        .agg(F.max("path").alias("path"), F.max("expiration_date").alias("expiration_date"))
        .orderBy(F.col("expiration_date").desc())
    )


def kinds_of(requested: str) -> list[str]:
    """Kind codes named in a request text; none or ALL means every kind."""
    found = [code for name, code in KINDS.items() if name in requested.upper()]
    return list(KINDS.values()) if "ALL" in requested.upper() or not found else found


def pending_transfers(
    sets: DataFrame, media: DataFrame, entities: DataFrame, kinds: str, hours: int, as_of: datetime, suffix: str, server: str | None = None, by: list[str] | None = None
) -> DataFrame:
    """Backup files still to be transferred, oldest first.

    Sets are filtered by entity, kind, completion, age and mark, reduced to one row each,
    then met by their media families; with ``by`` all three tables meet on the server too. ``sets`` without a description are not selectable,
    as in a plain NOT LIKE.
    """
    since = ntz(as_of - timedelta(hours=hours))
    s = sets.where(
        F.col("finish").isNotNull()
        & (F.col("start") >= since)
        & ~F.contains(F.col("description"), F.lit(suffix))
        & F.col("type").isin(kinds_of(kinds))
    )
    if server is not None:
        s = s.where(F.col("server_name") == server)
    by = list(by or [])
    place = [*by, "media_set_id"]
    s = s.join(entities.select(*by, "database").distinct(), [*by, "database"], "left_semi")
    one = s.groupBy(*place).agg(
        F.upper(F.max("machine_name")).alias("machine_name"),
        F.upper(F.max("server_name")).alias("instance_name"),
        F.max("database").alias("database"),
        F.max("start").alias("backup_start"),
        F.max("finish").alias("backup_finish"),
        F.max("expiration_date").alias("expiration_date"),
        F.upper(F.max("type")).alias("backup_type"),
        F.min("first_lsn").alias("first_lsn"),
        F.max("last_lsn").alias("last_lsn"),
    )
    files = media.where((F.col("mirror") == 0) & F.col("path").rlike("^.:"))
    files = files.join(one, place)
    files = with_group_max(files, place, "family", "max_family")
    return files.withColumn("file_name", file_name("path")).orderBy("backup_start", *place)


def schedule_deletes(ledger: DataFrame, as_of: datetime, days: int | None = None, instance: str | None = None) -> DataFrame:
    """Give a delete date to live rows without one: ``days`` ahead, or by kind (logs 2, others 1)."""
    span = F.lit(days) if days is not None else F.when(F.col("backup_type") == "L", 2).otherwise(1)
    due = ntz(as_of) + F.make_dt_interval(days=span)
    open_ = F.col("delete_date").isNull() & ~F.col("is_deleted")
    if instance is not None:
        open_ &= F.col("instance_name") == instance
    return ledger.withColumn("delete_date", F.when(open_, due).otherwise(F.col("delete_date")))


def due(ledger: DataFrame, as_of: datetime, instance: str | None = None) -> DataFrame:
    out = ledger.where((F.col("delete_date") <= ntz(as_of)) & ~F.col("is_deleted"))
    return out.where(F.col("instance_name") == instance) if instance is not None else out


def size_forecast(history: DataFrame, entities: DataFrame, split_gb: int, dests: int, runs: int = 30) -> DataFrame:
    """Estimated size and file count of the next run per entity and kind.

    ``history``: (entity, kind, size, compressed_size, finish, is_damaged, is_incomplete) in
    bytes; ``entities``: (entity, kind, row_gb, filestream_gb, log_gb, is_compressed). Sizes
    are whole GB, ratios have three decimals. The file count is the size over ``split_gb``,
    rounded up to a multiple of the destinations, at most 64; without a split size it is 1.
    """
    good = history.where("NOT is_damaged AND NOT is_incomplete")
    last = first_per_key(good, ["entity", "kind"], [F.col("finish").desc()], runs)
    stats = last.groupBy("entity", "kind").agg(
        F.floor(F.avg(F.col("size") / GB)).cast("long").alias("est_gb"),
        F.floor(F.avg(F.col("compressed_size") / GB)).cast("long").alias("est_compressed_gb"),
        F.round(F.avg(F.col("size") / F.col("compressed_size")), 3).alias("_ratio"),
    )
    out = entities.join(stats, ["entity", "kind"], "left").withColumn("ratio", F.coalesce("_ratio", F.lit(DEFAULT_RATIO))).drop("_ratio")
    rows, fs, ratio = (F.coalesce(F.col(c), F.lit(0)) for c in ("row_gb", "filestream_gb", "ratio"))
    assumed = F.col("ratio") == F.lit(DEFAULT_RATIO)
    squeezed = F.when(assumed, rows / ratio + fs).otherwise((rows + fs) / ratio)
    full = F.when(F.col("is_compressed"), squeezed).otherwise(rows + fs)
    history_gb = F.when(F.col("is_compressed"), F.col("est_compressed_gb")).otherwise(F.col("est_gb"))
    size = (
        F.when(F.col("kind") == "L", F.coalesce(F.col("log_gb"), F.lit(0)))
        .when(F.col("kind") == "D", full)
        .otherwise(F.coalesce(history_gb.cast("double"), full))
    )
    out = out.withColumn("file_gb", F.floor(size).cast("long"))
    if split_gb is None or split_gb <= 0:
        return out.withColumn("file_count", F.lit(1).cast("long"))
    # two decimals, kept as whole hundredths
    hundredths = f"((file_gb * 200 + {split_gb}) div {2 * split_gb})"
    per = dests * 100
    count = F.expr(
        f"""CASE WHEN {hundredths} = 0 THEN {per}L
                 WHEN {hundredths} % {per} = 0 THEN {hundredths}
                 ELSE ({hundredths} div {per} + 1) * {per} END div 100"""
    )
    return out.withColumn("file_count", F.least(count, F.lit(MAX_FILES)).cast("long"))
