"""Aggregations: profiles, KPIs, incident grouping, pivots, flags and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchloom.operators.filters import drop_benign
from watchloom.session import materialize


def share_profile(
    df: DataFrame, key: str, total_ms: str, part_ms: str, count: str, benign: list[str] | None = None, by: list[str] | None = None
) -> DataFrame:
    """Per category: seconds in total / resource / signal, count, share of the grand total, averages.

    The share is taken over everything but the benign categories, before categories without
    occurrences are left out; with ``by`` (the server) each one has its own grand total.
    Totals are one row per group, so no task sees all categories. Sums have room for any number
    of rows: a total never turns into null.
    """
    by = list(by or [])
    wide = "decimal(20,0)"
    waits = drop_benign(df, key, benign)
    waits = waits.groupBy(*by, key).agg(
        F.sum(F.col(total_ms).cast(wide)).cast("decimal(30,0)").alias("_t"),
        F.sum(F.col(part_ms).cast(wide)).cast("decimal(30,0)").alias("_s"),
        F.sum(count).cast("long").alias("wait_count"),
    )
    # one row per category, kept so that the total and the rows share a single source scan
    waits = materialize(waits, "profile")
    if by:
        waits = waits.join(waits.groupBy(*by).agg(F.sum("_t").cast("decimal(30,0)").alias("_g")), by)
        grand = F.col("_g")
    else:
        grand = waits.select(F.sum("_t")).scalar().cast("decimal(30,0)")
    n = F.col("wait_count").cast(wide)

    def secs(ms: Column, scale: int, divide: Column | None = None) -> Column:
        value = ms.cast("decimal(30,0)") / F.lit(1000)
        return (value / divide if divide is not None else value).cast(f"decimal(30,{scale})")

    t, s = F.col("_t"), F.col("_s")
    return (
        waits.where("wait_count <> 0")
        .select(
            *by,
            key,
            secs(t, 2).alias("wait_sec"),
            secs(t - s, 2).alias("resource_sec"),
            secs(s, 2).alias("signal_sec"),
            "wait_count",
            F.try_divide(t * 100, grand).cast("decimal(5,2)").alias("percentage"),
            secs(t, 4, n).alias("avg_wait_sec"),
            secs(t - s, 4, n).alias("avg_res_sec"),
            secs(s, 4, n).alias("avg_sig_sec"),
        )
        .orderBy(*by, F.col("wait_sec").desc())
    )


def daily_kpi(df: DataFrame, ts: str, category: str) -> DataFrame:
    return df.groupBy(F.to_date(ts).alias("log_date"), F.col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("occurrence_per_day")
    )


def group_incidents(df: DataFrame, text: str, duration: str | None = None, payload: str | None = None) -> DataFrame:
    """Identical incidents (same participant text) grouped: count, durations (µs in, ms out), a sample.

    Rows shrink by hash aggregation over fixed-width values only. Text and sample of each
    incident are fetched afterwards from its row with the smallest payload hash.
    """
    rows = df.withColumn("incident_id", F.md5(F.col(text).cast("binary")))
    digest = F.conv(F.substring(F.md5(F.col(payload).cast("binary")), 1, 15), 16, 10).cast("long") if payload else F.xxhash64(*df.columns)
    rows = rows.withColumn("_pick", F.coalesce(digest, F.lit(2**62)))
    aggs = [F.min("_pick").alias("_pick"), F.count(F.lit(1)).alias("occurrence")]
    if duration:
        aggs.append(F.sum(duration).cast("long").alias("_us"))
        # absent durations do not count towards the mean
        aggs.append(F.count(duration).alias("_n"))
    groups = materialize(rows.groupBy("incident_id").agg(*aggs), "incidents")
    fetched = [F.col(text).alias("factors"), *([F.col(payload).alias("sample")] if payload else [])]
    wanted = rows.select("incident_id", "_pick", *fetched)
    # The rows of a pick are equal in text and sample: any of them will do.
    chosen = wanted.join(groups.select("incident_id", "_pick"), ["incident_id", "_pick"], "left_semi").dropDuplicates(["incident_id"])
    out = groups.drop("_pick").join(chosen.drop("_pick"), "incident_id", "left")
    order = [F.col("occurrence").desc()]
    if duration:
        mean = F.expr("CASE WHEN _n > 0 THEN (_us div _n) div 1000 END")
        out = out.withColumns({"total_ms": F.expr("_us div 1000"), "average_ms": mean}).drop("_us", "_n")
        order.insert(0, F.col("total_ms").desc())
    return out.orderBy(*order)


def access_summary(df: DataFrame, keys: list[str], ts: str, admins: DataFrame) -> DataFrame:
    """Per (principal, host, application): last seen, count, is-admin; busiest first.

    ``admins`` is a one-column lookup keyed like the first key.
    """
    seen = df.groupBy(*keys).agg(F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("login_count"))
    lookup = admins.toDF(keys[0]).distinct().withColumn("is_admin", F.lit(1))
    out = seen.join(lookup, keys[0], "left").withColumn("is_admin", F.coalesce("is_admin", F.lit(0)))
    return out.orderBy(F.col("login_count").desc())


def day_pivot(df: DataFrame, keys: list[str], ts: str, as_of: datetime, days: int = 7) -> DataFrame:
    """Occurrences per key by days ago; columns d0 … d<days>, null where there were none.

    Groups seen only outside the columns' days stay, all null.
    """
    ago = F.datediff(F.lit(as_of.date()), F.to_date(ts))
    cols = [F.nullif(F.count_if(ago == n), F.lit(0)).alias(f"d{n}") for n in range(days + 1)]
    return df.groupBy(*keys).agg(*cols)


def stale_having(
    entities: DataFrame, events: DataFrame, key: str, ts: str, days: int, as_of: datetime, created: Column, condition: Column | None = None
) -> DataFrame:
    """Entities whose newest event (or ``created`` when none) is more than ``days`` days old.

    Events are reduced to one row per key before the join.
    """
    if condition is not None:
        events = events.where(condition)
    newest = events.groupBy(key).agg(F.max(ts).alias("last_seen"))
    age = F.datediff(F.lit(as_of.date()), F.to_date(F.coalesce(F.col("last_seen"), created.cast("timestamp_ntz"))))
    return entities.join(newest, key, "left").withColumn("days_since", age).where(F.col("days_since") > days)


def non_uniform(df: DataFrame, key: str, val: str) -> DataFrame:
    """Groups whose values differ."""
    return (
        df.groupBy(key).agg(F.min(val).alias("min_value"), F.max(val).alias("max_value")).where("min_value <> max_value")
    )


def sum_by_type(df: DataFrame, keys: list[str], type_col: str, value: str, types: dict[str, list]) -> DataFrame:
    """One sum column per named set of type codes, in a single pass."""
    return df.groupBy(*keys).agg(
        *[F.sum(F.when(F.col(type_col).isin(codes), F.col(value)).otherwise(0)).alias(n) for n, codes in types.items()]
    )


def concat_rows(
    df: DataFrame, keys: list[str], col: str, delimiter: str, order: list[str], out: str, rows_per_chunk: int | None = None
) -> DataFrame:
    """Values of each key joined in order (null as empty text).

    The result is one value per key, so it is for keys of modest size. For unbounded keys
    give ``rows_per_chunk``: the same text then comes in numbered chunks, computed from
    distributed positions, and no task holds a whole key.
    """
    names = list(order)
    if rows_per_chunk:
        from watchloom.operators.ranking import ordinal

        df = ordinal(df, keys, order, "_pos")
        df = df.withColumn("chunk_no", F.ceil(F.col("_pos") / rows_per_chunk).cast("long"))
        keys, names = [*keys, "chunk_no"], ["_pos"]
    # Rows are dealt by key before they are listed: lists begun where keys are mixed would be sorted, spilled and sent for nothing.
    dealt = df.repartition(*keys) if keys else df
    return dealt.groupBy(*keys).agg(joined_values(col, delimiter, names).alias(out))


def joined_values(col: str, delimiter: str, order: list[str]) -> Column:
    """The aggregate behind ``concat_rows``: values of a group joined in order."""
    # sort_array compares whole structs, where array_sort would call a comparator per pair.
    listed = F.sort_array(F.collect_list(F.struct(*order, F.coalesce(F.col(col), F.lit("")).alias("_v"))))
    return F.array_join(F.transform(listed, lambda s: s["_v"]), delimiter)


def gauge(df: DataFrame, predicate: Column, name: str) -> DataFrame:
    """One row with the number of matching rows, 0 when there are none."""
    return df.agg(F.count(F.when(predicate, F.lit(1))).alias("value")).select(F.lit(name).alias("gauge"), "value")


def column_profile(columns: DataFrame, key: str | list[str], flags: list[str], name: str = "column_name") -> DataFrame:
    """Per entity: whether any column has each flag, and the (last by name) column that has it."""
    return columns.groupBy(*([key] if isinstance(key, str) else key)).agg(*profile_values(flags, name))


def profile_values(flags: list[str], name: str = "column_name") -> list[Column]:
    """The aggregates behind ``column_profile``."""
    aggs = []
    for f in flags:
        aggs += [F.max(F.col(f).cast("int")).alias(f"has_{f}"), F.max(F.when(F.col(f), F.col(name))).alias(f"{f}_column")]
    return aggs


def long_report(df: DataFrame, ids: list[str], items: dict[str, str | None]) -> DataFrame:
    """Wide metrics as (ids…, item_id, item, value, comment) rows; ``items`` maps column to comment."""
    entries = [
        F.struct(
            F.lit(i).alias("item_id"),
            F.lit(c).alias("item"),
            F.col(c).cast("string").alias("value"),
            F.lit(note).cast("string").alias("comment"),
        )
        for i, (c, note) in enumerate(items.items(), 1)
    ]
    return df.select(*ids, F.inline(F.array(*entries)))


def counter_delta(
    history: DataFrame,
    snapshot_id: str,
    ts: str,
    keys: list[str],
    counters: list[str],
    partition: str | None = None,
    by: list[str] | None = None,
) -> DataFrame:
    """Counter growth between the last two snapshots of each ``by`` (the server).

    Entities new in the last snapshot keep their absolute values; entities gone from it are
    left out, and so is a server with a single snapshot. ``is_reset`` marks a counter that went
    backwards. The two ids per server come from one aggregate over ids and times; joined
    back with them, a single aggregation per entity replaces the self joins. A ``partition`` column
    joins too, so that only the partitions of those snapshots are read.
    """
    from watchloom.operators.ranking import last_two

    by = list(by or [])
    place = [partition] if partition else []
    two = last_two(history, snapshot_id, ts, by, place)
    rows = history.join(two, [*by, snapshot_id, *place])
    is_last = F.col("_is_last")
    aggs = [F.max(F.when(is_last, 1)).alias("_now"), F.max("duration_sec").alias("duration_sec")]
    for c in counters:
        now = F.sum(F.when(is_last, F.col(c)))
        before = F.sum(F.when(~is_last, F.col(c)))
        aggs.append((now - F.coalesce(before, F.lit(0))).cast("long").alias(c))
    names = [*by, *[k for k in keys if k not in by]]
    out = rows.groupBy(*names).agg(*aggs).where("_now = 1").drop("_now")
    reset = F.greatest(*[F.col(c) < 0 for c in counters]) if len(counters) > 1 else F.col(counters[0]) < 0
    return out.select(*names, *counters, reset.alias("is_reset"), "duration_sec")


def io_latency(history: DataFrame, files: DataFrame, keys: list[str], partition: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Latency report over the last two snapshots of IO counters, slowest writes first.

    ``files`` are met by ``by`` (the server) and ``keys``.
    """
    from watchloom.functions.numbers import safe_ratio

    counters = ["num_reads", "stall_read_ms", "num_writes", "stall_write_ms", "stall_ms", "bytes_read", "bytes_written"]
    d = counter_delta(history, "snapshot_id", "log_time", keys, counters, partition, by)
    d = d.join(files, [*(by or []), *keys])
    return d.withColumns(
        {
            "read_latency_ms": safe_ratio("stall_read_ms", "num_reads"),
            "write_latency_ms": safe_ratio("stall_write_ms", "num_writes"),
            "latency_ms": safe_ratio("stall_ms", "num_reads + num_writes"),
            "avg_b_per_read": safe_ratio("bytes_read", "num_reads"),
            "avg_b_per_write": safe_ratio("bytes_written", "num_writes"),
            "avg_b_per_transfer": safe_ratio("bytes_read + bytes_written", "num_reads + num_writes"),
        }
    ).orderBy(F.col("write_latency_ms").desc())


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def union_distinct(*dfs: DataFrame) -> DataFrame:
    return union_all(*dfs).distinct()
