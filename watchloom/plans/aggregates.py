"""Aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.operators.aggregates import (
    column_profile,
    counter_delta,
    gauge,
    io_latency,
    long_report,
    non_uniform,
    share_profile,
    stale_having,
    sum_by_type,
    union_all,
    union_distinct,
)
from watchloom.functions.calendar import ts_key
from watchloom.plans.adapters import ORDERS_AS_OF
from watchloom.plans.registry import query
from watchloom.session import load


def waits(spark, sf):
    """(wait_type, wait_ms, signal_ms, tasks) sample rows; every ninth event counts no task."""
    ms = F.round(F.col("value") * 1000).cast("long")
    return load(spark, sf, "events").select(
        F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")).alias("server"),
        F.concat(F.upper("event_type"), F.lit("_"), (F.col("user_id") % 10).cast("string")).alias("wait_type"),
        ms.alias("wait_ms"),
        F.floor(ms / 10).alias("signal_ms"),
        F.when(F.col("user_id") % 10 == 9, 0).otherwise(1).alias("tasks"),
    )


@query(
    "share_profile",
    """
    WITH w AS (
      SELECT 's' || (event_id % 2) AS server, upper(event_type) || '_' || (user_id % 10) AS wait_type, sum(CAST(round(value * 1000) AS HUGEINT)) AS t,
             sum(CAST(round(value * 1000) AS HUGEINT) // 10) AS s, sum(CASE WHEN user_id % 10 = 9 THEN 0 ELSE 1 END) AS n
      FROM events WHERE upper(event_type) || '_' || (user_id % 10) NOT IN ('VIEW_0', 'CLICK_1') GROUP BY 1, 2),
    g AS (SELECT server, sum(t) AS g FROM w GROUP BY 1)
    SELECT server, wait_type, CAST((t + 5) // 10 AS DOUBLE) / 100 AS wait_sec, CAST((t - s + 5) // 10 AS DOUBLE) / 100 AS resource_sec,
           CAST((s + 5) // 10 AS DOUBLE) / 100 AS signal_sec, CAST(n AS BIGINT) AS wait_count,
           CAST((t * 20000 + g) // (2 * g) AS DOUBLE) / 100 AS percentage,
           CAST((t * 20 + n) // (2 * n) AS DOUBLE) / 10000 AS avg_wait_sec,
           CAST(((t - s) * 20 + n) // (2 * n) AS DOUBLE) / 10000 AS avg_res_sec,
           CAST((s * 20 + n) // (2 * n) AS DOUBLE) / 10000 AS avg_sig_sec
    FROM w JOIN g USING (server) WHERE n <> 0
    """,
)
def q_share_profile(spark, sf):
    out = share_profile(waits(spark, sf), "wait_type", "wait_ms", "signal_ms", "tasks", ["VIEW_0", "CLICK_1"], ["server"])
    kept = ("server", "wait_type", "wait_count")
    return out.select(*kept, *[F.col(c).cast("double").alias(c) for c in out.columns if c not in kept])


@query(
    "stale_customers",
    """
    SELECT c.c_custkey, max(o.o_orderdate) AS last_seen,
           CAST(date_diff('day', CAST(coalesce(max(o.o_orderdate), TIMESTAMP '1900-01-01') AS DATE), DATE '2001-12-01') AS INTEGER) AS days_since
    FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'
    GROUP BY c.c_custkey HAVING date_diff('day', CAST(coalesce(max(o.o_orderdate), TIMESTAMP '1900-01-01') AS DATE), DATE '2001-12-01') > 300
    """,
)
def q_stale_customers(spark, sf):
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderstatus")
    return stale_having(
        load(spark, sf, "customer").select("c_custkey"),
        orders,
        "c_custkey",
        "o_orderdate",
        300,
        ORDERS_AS_OF,
        F.lit("1900-01-01"),
        F.col("o_orderstatus") == "F",
    )


@query(
    "non_uniform",
    """
    SELECT l_orderkey, min(l_shipdate) AS min_value, max(l_shipdate) AS max_value
    FROM lineitem GROUP BY l_orderkey HAVING min(l_shipdate) <> max(l_shipdate)
    """,
)
def q_non_uniform(spark, sf):
    return non_uniform(load(spark, sf, "lineitem"), "l_orderkey", "l_shipdate")


@query(
    "gauge",
    """
    SELECT 'open_orders' AS gauge, count(*) FILTER (o_orderstatus = 'O') AS value FROM orders
    UNION ALL SELECT 'negative_accounts', count(*) FILTER (c_acctbal < 0) FROM customer
    UNION ALL SELECT 'impossible', count(*) FILTER (l_quantity < 0) FROM lineitem
    """,
)
def q_gauge(spark, sf):
    return union_all(
        gauge(load(spark, sf, "orders"), F.col("o_orderstatus") == "O", "open_orders"),
        gauge(load(spark, sf, "customer"), F.col("c_acctbal") < 0, "negative_accounts"),
        gauge(load(spark, sf, "lineitem"), F.col("l_quantity") < 0, "impossible"),
    )


@query(
    "column_profile",
    """
    SELECT p_brand, CAST(max(CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS has_identity,
           max(CASE WHEN p_size % 7 = 0 THEN p_name END) AS identity_column,
           CAST(max(CASE WHEN p_retailprice > 1500 THEN 1 ELSE 0 END) AS INTEGER) AS has_sparse,
           max(CASE WHEN p_retailprice > 1500 THEN p_name END) AS sparse_column
    FROM part GROUP BY p_brand
    """,
)
def q_column_profile(spark, sf):
    cols = load(spark, sf, "part").select(
        "p_brand", "p_name", (F.col("p_size") % 7 == 0).alias("identity"), (F.col("p_retailprice") > 1500).alias("sparse")
    )
    return column_profile(cols, "p_brand", ["identity", "sparse"], "p_name")


@query(
    "long_report",
    """
    WITH s AS (
      SELECT o_custkey AS database_id,
             CAST(sum(CASE WHEN o_orderstatus IN ('P') THEN o_orderkey ELSE 0 END) AS BIGINT) AS log_size,
             CAST(sum(CASE WHEN o_orderstatus IN ('O') THEN o_orderkey ELSE 0 END) AS BIGINT) AS row_size,
             CAST(sum(CASE WHEN o_orderstatus IN ('F') THEN o_orderkey ELSE 0 END) AS BIGINT) AS filestream_size
      FROM orders GROUP BY o_custkey)
    SELECT database_id, 1 AS item_id, 'log_size' AS item, CAST(log_size AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS comment FROM s
    UNION ALL SELECT database_id, 2, 'row_size', CAST(row_size AS VARCHAR), 'rows' FROM s
    UNION ALL SELECT database_id, 3, 'filestream_size', CAST(filestream_size AS VARCHAR), NULL FROM s
    """,
)
def q_long_report(spark, sf):
    orders = load(spark, sf, "orders").select(F.col("o_custkey").alias("database_id"), "o_orderstatus", "o_orderkey")
    sizes = sum_by_type(
        orders, ["database_id"], "o_orderstatus", "o_orderkey", {"log_size": ["P"], "row_size": ["O"], "filestream_size": ["F"]}
    )
    return long_report(sizes, ["database_id"], {"log_size": None, "row_size": "rows", "filestream_size": None})


def counters(spark, sf):
    """Cumulative IO counters per (day snapshot, user): totals of everything up to that day.

    Each daily sum is repeated for the later snapshots and summed: no window over a user's
    whole history.
    """
    cents = F.round(F.col("value") * 100).cast("long")
    e = load(spark, sf, "events").select(F.to_date("ts").alias("day"), "user_id", "event_type", cents.alias("c"))
    is_write = F.col("event_type").isin("purchase", "signup")
    daily = e.groupBy("day", "user_id").agg(
        F.count(F.when(~is_write, 1)).alias("num_reads"),
        F.sum(F.when(~is_write, F.col("c")).otherwise(0)).alias("stall_read_ms"),
        F.count(F.when(is_write, 1)).alias("num_writes"),
        F.sum(F.when(is_write, F.col("c")).otherwise(0)).alias("stall_write_ms"),
    )
    newest = e.agg(F.max("day")).scalar()
    upto = daily.withColumn("snap", F.explode(F.sequence(F.col("day"), newest)))
    total = upto.groupBy("snap", "user_id").agg(*[F.sum(c).alias(c) for c in daily.columns[2:]])
    # user 7 is only seen from the last snapshot on
    total = total.where((F.col("user_id") != 7) | (F.col("snap") == newest))
    return total.select(
        ts_key("snap", 14).alias("snapshot_id"),
        F.col("snap").cast("timestamp_ntz").alias("log_time"),
        "user_id",
        "num_reads",
        "stall_read_ms",
        "num_writes",
        "stall_write_ms",
        (F.col("stall_read_ms") + F.col("stall_write_ms")).alias("stall_ms"),
        (F.col("num_reads") * 8192).alias("bytes_read"),
        (F.col("num_writes") * 4096).alias("bytes_written"),
    )


# Growth of the last day, computed straight from the last day's events.
DELTA_SQL = """
d AS (SELECT CAST(max(ts) AS DATE) AS last FROM events),
delta AS (
  SELECT user_id, count(*) FILTER (hit AND NOT w) AS num_reads, CAST(coalesce(sum(c) FILTER (hit AND NOT w), 0) AS BIGINT) AS stall_read_ms,
         count(*) FILTER (hit AND w) AS num_writes, CAST(coalesce(sum(c) FILTER (hit AND w), 0) AS BIGINT) AS stall_write_ms
  FROM (SELECT user_id, event_type IN ('purchase', 'signup') AS w, CAST(round(value * 100) AS BIGINT) AS c,
               CAST(ts AS DATE) = last OR user_id = 7 AS hit FROM events, d)
  GROUP BY user_id)
"""


@query(
    "counter_delta",
    f"""
    WITH {DELTA_SQL}
    SELECT user_id, num_reads, stall_read_ms, num_writes, stall_write_ms, false AS is_reset, CAST(86400 AS BIGINT) AS duration_sec FROM delta
    """,
)
def q_counter_delta(spark, sf):
    cols = ["num_reads", "stall_read_ms", "num_writes", "stall_write_ms"]
    return counter_delta(counters(spark, sf), "snapshot_id", "log_time", ["user_id"], cols)


@query(
    "io_latency",
    f"""
    WITH {DELTA_SQL}
    SELECT user_id, c_name AS physical_name, num_reads, num_writes,
           CASE WHEN num_reads = 0 THEN 0 ELSE stall_read_ms // num_reads END AS read_latency_ms,
           CASE WHEN num_writes = 0 THEN 0 ELSE stall_write_ms // num_writes END AS write_latency_ms,
           CASE WHEN num_reads + num_writes = 0 THEN 0 ELSE (stall_read_ms + stall_write_ms) // (num_reads + num_writes) END AS latency_ms,
           CASE WHEN num_reads = 0 THEN 0 ELSE 8192 END AS avg_b_per_read, CASE WHEN num_writes = 0 THEN 0 ELSE 4096 END AS avg_b_per_write,
           CASE WHEN num_reads + num_writes = 0 THEN 0 ELSE (num_reads * 8192 + num_writes * 4096) // (num_reads + num_writes) END AS avg_b_per_transfer
    FROM delta JOIN customer ON c_custkey = user_id
    """,
)
def q_io_latency(spark, sf):
    files = load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("physical_name"))
    out = io_latency(counters(spark, sf), files, ["user_id"])
    return out.drop("stall_read_ms", "stall_write_ms", "stall_ms", "bytes_read", "bytes_written", "is_reset", "duration_sec")


@query(
    "union_distinct",
    "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_nationkey FROM nation",
)
def q_union_distinct(spark, sf):
    return union_distinct(
        load(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")),
        load(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")),
        load(spark, sf, "nation").select(F.col("n_nationkey").alias("nation")),
    )
