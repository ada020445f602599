"""Synchronisation and slowly changing state.

Each operator is a pure function from the current table to its next version, built on one
full outer join; write the result as a new snapshot folder, never over the path being read.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.functions.numbers import fingerprint
from watchloom.functions.times import ntz
from watchloom.functions.text import has_any_tag
from watchloom.session import materialize


def merge_frames(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with both sides as structs ``t`` and ``s``; an absent side is null."""
    t = target.select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], F.struct("*").alias("t"))
    s = source.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], F.struct("*").alias("s"))
    cond = F.col("_t0") == F.col("_s0")
    for i in range(1, len(keys)):
        cond &= F.col(f"_t{i}") == F.col(f"_s{i}")
    return t.join(s, cond, "full").select("t", "s")


def _differs(a: Column, b: Column) -> Column:
    """SQL ``<>``: unknown counts as equal."""
    return F.coalesce(a != b, F.lit(False))


def sync_items(target: DataFrame, source: DataFrame, publisher: str, wanted_tags: list[str], strict_tags: bool = False) -> DataFrame:
    """Next subscriber table plus an ``action`` per row: INSERT, UPDATE, DELETE or KEEP.

    ``source`` rows carrying a wanted tag are matched to the publisher's own rows by item
    id. A changed checksum or row version replaces the row and resets its execution result.
    Rows gone from the source go when they carry a wanted tag; with ``strict_tags`` only
    when their whole tag list is one wanted tag. Rows of other publishers are not touched.
    The new table is everything but DELETE.
    """
    cols = [c for c in target.columns if c not in ("publisher_name", "execution_result")]
    offered = source.where(has_any_tag("tags", wanted_tags)).select(*cols)
    mine = target.where(F.col("publisher_name") == publisher)
    others = target.where(F.col("publisher_name").isNull() | (F.col("publisher_name") != publisher))
    m = merge_frames(mine, offered, ["item_id"])
    in_t, in_s = F.col("t").isNotNull(), F.col("s").isNotNull()
    changed = in_t & in_s & (_differs(F.col("t.checksum"), F.col("s.checksum")) | _differs(F.col("t.row_version"), F.col("s.row_version")))
    gone = F.col("t.tags").isin([w for w in wanted_tags if w.strip()]) if strict_tags else has_any_tag(F.col("t.tags"), wanted_tags)
    action = (
        F.when(in_s & ~in_t, "INSERT").when(changed, "UPDATE").when(in_t & ~in_s & gone, "DELETE").otherwise("KEEP")
    )
    m = m.withColumn("action", action)
    take = F.col("action").isin("INSERT", "UPDATE")
    new = [F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in cols]
    merged = m.select(
        *new,
        F.lit(publisher).alias("publisher_name"),
        F.when(take, "NOT EXECUTED").otherwise(F.col("t.execution_result")).alias("execution_result"),
        "action",
    )
    return merged.unionByName(others.withColumn("action", F.lit("KEEP")))


def update_watermarks(marks: DataFrame, tables: dict[str, tuple[DataFrame, str, int]], as_of: datetime) -> DataFrame:
    """Marks advanced to the highest version of each table.

    ``tables``: name -> (rows, version column, order). The marks table has one row per
    table, so it is read to the driver and each old mark becomes a pushed-down scan
    predicate. Tables without newer rows keep their mark.
    """
    spark = marks.sparkSession
    old = {r["table_name"]: r["last_version"] for r in marks.collect()}
    at = ntz(as_of)
    found = None
    for name, (rows, version, order) in tables.items():
        newer = rows.where(F.col(version) >= F.lit(old.get(name) or 0))
        one = newer.agg(F.max(version).cast("long").alias("version")).select(
            F.lit(name).alias("table_name"), "version", F.lit(order).alias("table_order")
        )
        found = one if found is None else found.unionByName(one)
    if found is None:
        return marks
    m = merge_frames(marks, found, ["table_name"])
    return m.select(
        F.coalesce("s.table_name", "t.table_name").alias("table_name"),
        F.coalesce("s.version", "t.last_version").alias("last_version"),
        F.coalesce("s.table_order", "t.table_order").alias("table_order"),
        F.when(F.col("s").isNotNull(), at).otherwise(F.col("t.updated")).alias("updated"),
    )


def incremental_pull(
    source: DataFrame, local: DataFrame, audiences: list[str], id_col: str, version_col: str, audience_col: str, use_version: bool = True
) -> DataFrame:
    """Source rows beyond the local high-water marks for the wanted audiences.

    The two marks are single values and reach the source scan as literals.
    """
    last = local.agg(F.max(id_col).alias("id"), F.max(version_col).alias("version")).first()
    cond = F.col(audience_col).isin([a for a in audiences if a.strip()])
    if last["id"] is not None:
        cond &= F.col(id_col) > last["id"]
    if use_version:
        cond &= F.col(version_col) > (last["version"] or 0)
    return source.where(cond)


def publish_items(target: DataFrame, incoming: DataFrame, as_of: datetime, replace: bool = True) -> DataFrame:
    """Next publisher table after uploading items, one incoming row per (name, version).

    A missing version means the latest existing one when ``replace`` allows it, else 1.0.
    Existing items take over only the given fields, new ones are inserted with tag TSX by
    default. Both creation and change time are kept.
    """
    latest = target.groupBy("item_name").agg(F.max("item_version").alias("_latest"))
    asked = incoming.join(latest, "item_name", "left") if replace else incoming.withColumn("_latest", F.lit(None).cast("string"))
    asked = asked.withColumn("item_version", F.coalesce("item_version", "_latest", F.lit("1.0"))).drop("_latest")
    m = merge_frames(target, asked, ["item_name", "item_version"])
    at = ntz(as_of)
    in_t, in_s = F.col("t").isNotNull(), F.col("s").isNotNull()
    cols = []
    for c in target.columns:
        if c in ("create_date", "update_date"):
            touched = in_s if c == "update_date" else ~in_t
            cols.append(F.when(touched, at).otherwise(F.col(f"t.{c}")).alias(c))
        elif c not in asked.columns:
            cols.append(F.col(f"t.{c}").alias(c))
        else:
            default = F.lit("TSX") if c == "tags" else F.lit(None)
            cols.append(F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}"), F.when(~in_t, default)).alias(c))
    return m.select(*cols)


def soft_delete(target: DataFrame, gone: DataFrame, keys: list[str], as_of: datetime, enabled: str = "is_enabled", updated: str = "update_date") -> DataFrame:
    """Deleted rows stay, disabled and touched."""
    hit = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
    out = target.join(hit, keys, "left")
    at = ntz(as_of)
    return out.withColumns(
        {
            enabled: F.when(F.col("_gone"), F.lit(False)).otherwise(F.col(enabled)),
            updated: F.when(F.col("_gone"), at).otherwise(F.col(updated)),
        }
    ).drop("_gone")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows replace target rows with the same keys; the rest of both stays."""
    m = merge_frames(target, batch.select(*target.columns), keys)
    return m.select(*[F.when(F.col("s").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns])


APPLIED = ("SUCCEED", "CANCELED")


def version_drift(log: DataFrame, declared: DataFrame) -> DataFrame:
    """Per database: declared version against what its script log has applied.

    ``log``: (database, record_id, record_ref, status, is_usable); ``declared``: (database,
    version). ``contiguous_version`` is the last applied record before the first gap.
    State: IN_SYNC, AHEAD, BEHIND, MISSING_DECLARATION or NOT_PARTICIPATING.
    ``has_base`` tells whether the declared record is in the log, which replay needs.
    """
    applied = F.col("is_usable") & F.coalesce(F.col("status").isin(*APPLIED), F.lit(False))
    pending = F.col("is_usable") & ~F.coalesce(F.col("status").isin(*APPLIED), F.lit(False))
    first_gap = log.where(pending).groupBy("database").agg(F.min("record_id").alias("_gap"))
    runs = log.join(first_gap, "database", "left").join(declared, "database", "left")
    before_gap = F.col("_gap").isNull() | (F.col("record_id") < F.col("_gap"))
    state = runs.groupBy("database").agg(
        F.max(F.when(applied & before_gap, F.col("record_id"))).alias("contiguous_version"),
        F.max(F.when(applied, F.col("record_id"))).alias("max_version"),
        F.max((F.col("record_id") == F.col("version")).cast("int")).alias("_base"),
    )
    lowest = F.lit(-(2**63)).cast("long")
    out = declared.join(state, "database", "full")
    run = F.coalesce("contiguous_version", lowest)
    label = (
        F.when(F.col("version").isNull() & F.col("max_version").isNotNull(), "MISSING_DECLARATION")
        .when(F.col("version").isNull(), "NOT_PARTICIPATING")
        .when(F.col("version") == run, "IN_SYNC")
        .when(F.col("version") > run, "AHEAD")
        .otherwise("BEHIND")
    )
    return out.withColumns({"state": label, "has_base": F.coalesce(F.col("_base") == 1, F.lit(False))}).drop("_base")


def checksum_drift(items: DataFrame, stored: str, columns: list[str], enabled: Column | None = None) -> DataFrame:
    """Each item's stored checksum against the one computed from its columns now.

    Adds ``computed``, ``state`` (MATCH, CHANGED, or MISSING for items without a stored one) and
    ``may_run``: enabled and unchanged since its checksum was stored.
    """
    state = F.when(F.col(stored).isNull(), "MISSING").when(F.col(stored) == F.col("computed"), "MATCH").otherwise("CHANGED")
    out = items.withColumn("computed", fingerprint(*columns)).withColumn("state", state)
    return out.withColumn("may_run", (enabled if enabled is not None else F.lit(True)) & (F.col("state") == "MATCH"))


def drift_actions(log: DataFrame, drift: DataFrame) -> DataFrame:
    """Records to CANCEL (database ahead) or REPLAY (database behind and its base present).

    Replay is all or nothing: one database lacking its base record stops every replay.
    """
    low = F.lit(-(2**63)).cast("long")
    drift = materialize(drift, "drift")
    blocked = drift.where("state = 'BEHIND' AND NOT has_base").agg(F.count(F.lit(1)).alias("n")).scalar()
    d = drift.where(F.col("state").isin("AHEAD", "BEHIND"))
    j = log.where("is_usable").join(d, "database")
    run = F.coalesce("contiguous_version", low)
    rid, version = F.col("record_id"), F.col("version")
    cancel = (F.col("state") == "AHEAD") & (rid > run) & (rid <= version)
    replay = (
        (F.col("state") == "BEHIND")
        & (rid > version)
        & (rid <= F.col("max_version"))
        & (F.col("record_ref").isNull() | (F.col("record_ref") > version))
        & (blocked == 0)
    )
    return j.withColumn("action", F.when(cancel, "CANCEL").when(replay, "REPLAY")).where("action IS NOT NULL").select("database", "record_id", "action")
