"""Backup and transfer history queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from watchloom.operators import lifecycle as L
from watchloom.plans.adapters import ORDERS_AS_OF, on_two_servers
from watchloom.plans.registry import query
from watchloom.session import load
from watchloom.sources.history import append_snapshot, purge_expired, purge_stored, read_history


def backup_sets(spark, sf):
    key = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "O", "I").otherwise("L")
    return load(spark, sf, "orders").select(
        key.alias("media_set_id"),
        F.col("o_custkey").alias("database"),
        kind.alias("type"),
        F.col("o_orderdate").alias("start"),
        F.when(key % 23 != 0, F.col("o_orderdate")).alias("finish"),
        (F.col("o_orderdate") + F.expr("INTERVAL '30' DAY")).alias("expiration_date"),
        F.when(key % 6 == 0, "copied_Transferred").otherwise("nightly").alias("description"),
        F.lit("srv1").alias("server_name"),
        F.lit("node1").alias("machine_name"),
        (key * 10).cast("decimal(25,0)").alias("first_lsn"),
        (key * 10 + 9).cast("decimal(25,0)").alias("last_lsn"),
    )


def media(spark, sf):
    path = F.concat(F.lit("D:\\b\\"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(".bak"))
    return load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("media_set_id"),
        F.col("l_linenumber").alias("family"),
        F.when(F.col("l_linenumber") == 7, F.lit(1)).otherwise(0).alias("mirror"),
        path.alias("path"),
    ).distinct()


@query(
    "expired_artifacts",
    """
    SELECT server, l_orderkey * 10 + l_linenumber AS media_family_id, 'D:\\b\\' || l_orderkey || '_' || l_linenumber || '.bak' AS path,
           max(o_orderdate) + INTERVAL 30 DAY + INTERVAL 1 DAY * d AS expiration_date
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey, (VALUES ('a', 0), ('b', 1)) v(server, d)
    WHERE CAST(o_orderdate + INTERVAL 30 DAY + INTERVAL 1 DAY * d AS DATE) < DATE '1999-06-01'
    GROUP BY server, d, l_orderkey, l_linenumber
    """,
)
def q_expired_artifacts(spark, sf):
    m = media(spark, sf).withColumn("media_family_id", F.col("media_set_id") * 10 + F.col("family"))
    sets = on_two_servers(backup_sets(spark, sf), "expiration_date")
    return L.expired(sets, on_two_servers(m), datetime(1999, 6, 1, 12), ["server"])


@query(
    "pending_transfers",
    """
    WITH o AS (SELECT * REPLACE (o_orderdate + INTERVAL 1 DAY * d AS o_orderdate) FROM orders, (VALUES ('a', 0), ('b', 1)) v(server, d)),
    s AS (SELECT * FROM o WHERE o_orderkey % 23 <> 0 AND o_orderdate >= TIMESTAMP '2001-12-01' - INTERVAL 20000 HOUR
                 AND o_orderkey % 6 <> 0 AND o_orderstatus IN ('F', 'P') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)),
    m AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 7)
    SELECT server, l_orderkey AS media_set_id, l_linenumber AS family, o_custkey AS database, 'SRV1' AS instance_name, 'NODE1' AS machine_name,
           o_orderdate AS backup_start, CASE o_orderstatus WHEN 'F' THEN 'D' ELSE 'L' END AS backup_type, o_orderkey * 10 AS first_lsn,
           o_orderkey * 10 + 9 AS last_lsn, l_orderkey || '_' || l_linenumber || '.bak' AS file_name,
           max(l_linenumber) OVER (PARTITION BY server, l_orderkey) AS max_family
    FROM m JOIN s ON o_orderkey = l_orderkey
    """,
)
def q_pending_transfers(spark, sf):
    entities = load(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("database"))
    sets = on_two_servers(backup_sets(spark, sf), "start", "finish")
    out = L.pending_transfers(
        sets, on_two_servers(media(spark, sf)), on_two_servers(entities), "FULL,LOG", 20000, ORDERS_AS_OF, "_Transferred", "srv1", ["server"]
    )
    return out.select(
        "server", "media_set_id", "family", "database", "instance_name", "machine_name", "backup_start", "backup_type",
        F.col("first_lsn").cast("long").alias("first_lsn"), F.col("last_lsn").cast("long").alias("last_lsn"), "file_name", "max_family",
    )


LEDGER_SQL = """
led AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'L' WHEN 'A' THEN 'D' ELSE 'I' END AS backup_type,
               CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS delete_date, l_suppkey % 9 = 0 AS is_deleted,
               'SRV' || (l_suppkey % 2) AS instance_name FROM lineitem),
sch AS (SELECT * REPLACE (CASE WHEN delete_date IS NULL AND NOT is_deleted AND instance_name = 'SRV1'
               THEN TIMESTAMP '2001-12-01' + INTERVAL 1 DAY * (CASE WHEN backup_type = 'L' THEN 2 ELSE 1 END) ELSE delete_date END AS delete_date) FROM led)
"""


def ledger(spark, sf):
    kind = F.when(F.col("l_returnflag") == "R", "L").when(F.col("l_returnflag") == "A", "D").otherwise("I")
    return load(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        kind.alias("backup_type"),
        F.when(F.col("l_linestatus") == "O", F.col("l_shipdate")).alias("delete_date"),
        (F.col("l_suppkey") % 9 == 0).alias("is_deleted"),
        F.concat(F.lit("SRV"), (F.col("l_suppkey") % 2).cast("string")).alias("instance_name"),
    )


@query("schedule_deletes", f"WITH {LEDGER_SQL} SELECT * FROM sch")
def q_schedule_deletes(spark, sf):
    return L.schedule_deletes(ledger(spark, sf), ORDERS_AS_OF, instance="SRV1")


@query(
    "due_deletes",
    f"WITH {LEDGER_SQL} SELECT * FROM sch WHERE delete_date <= TIMESTAMP '2001-12-02' AND NOT is_deleted AND instance_name = 'SRV1'",
)
def q_due_deletes(spark, sf):
    planned = L.schedule_deletes(ledger(spark, sf), ORDERS_AS_OF, instance="SRV1")
    return L.due(planned, datetime(2001, 12, 2), "SRV1")


@query(
    "size_forecast",
    """
    WITH h AS (SELECT o_custkey AS entity, CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'I' ELSE 'L' END AS kind,
                      round(o_totalprice * 100) / 100 * 1073741824 / 50 AS size, o_orderkey, o_orderdate FROM orders
               WHERE o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0),
    l AS (SELECT *, size / (2 + entity % 4) AS csize FROM h QUALIFY row_number() OVER (PARTITION BY entity, kind ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3),
    s AS (SELECT entity, kind, CAST(floor(avg(size / 1073741824)) AS BIGINT) AS est_gb, CAST(floor(avg(csize / 1073741824)) AS BIGINT) AS est_compressed_gb,
                 round(avg(size / csize), 3) AS ratio FROM l GROUP BY entity, kind),
    e AS (SELECT c_custkey AS entity, k AS kind, c_custkey % 900 AS row_gb, c_custkey % 50 AS filestream_gb, c_custkey % 300 AS log_gb,
                 c_custkey % 5 <> 0 AS is_compressed FROM customer, (VALUES ('D'), ('I'), ('L')) t(k)),
    f AS (SELECT e.*, s.est_gb, s.est_compressed_gb, coalesce(s.ratio, 2.499) AS ratio FROM e LEFT JOIN s USING (entity, kind)),
    g AS (SELECT *, CASE WHEN NOT is_compressed THEN row_gb + filestream_gb WHEN ratio = 2.499 THEN row_gb / 2.499 + filestream_gb
                         ELSE (row_gb + filestream_gb) / ratio END AS full_gb FROM f),
    z AS (SELECT *, CAST(floor(CASE kind WHEN 'L' THEN log_gb WHEN 'D' THEN full_gb
                   ELSE coalesce(CASE WHEN is_compressed THEN est_compressed_gb ELSE est_gb END, full_gb) END) AS BIGINT) AS file_gb FROM g),
    c AS (SELECT *, (file_gb * 200 + 80) // 160 AS x FROM z)
    SELECT entity, kind, est_gb, est_compressed_gb, file_gb,
           CAST(least(CASE WHEN x = 0 THEN 300 WHEN x % 300 = 0 THEN x ELSE (x // 300 + 1) * 300 END // 100, 64) AS BIGINT) AS file_count
    FROM c
    """,
)
def q_size_forecast(spark, sf):
    key = F.col("o_orderkey")
    kind = F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "O", "I").otherwise("L")
    size = F.round(F.col("o_totalprice") * 100) / 100 * 1073741824 / 50
    history = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity"),
        kind.alias("kind"),
        size.alias("size"),
        (size / (2 + F.col("o_custkey") % 4)).alias("compressed_size"),
        F.struct("o_orderdate", "o_orderkey").alias("finish"),
        (key % 17 == 0).alias("is_damaged"),
        (key % 19 == 0).alias("is_incomplete"),
    )
    cust = F.col("c_custkey")
    entities = load(spark, sf, "customer").select(
        cust.alias("entity"),
        F.explode(F.array(F.lit("D"), F.lit("I"), F.lit("L"))).alias("kind"),
        (cust % 900).alias("row_gb"),
        (cust % 50).alias("filestream_gb"),
        (cust % 300).alias("log_gb"),
        (cust % 5 != 0).alias("is_compressed"),
    )
    out = L.size_forecast(history, entities, split_gb=80, dests=3, runs=3)
    return out.select("entity", "kind", "est_gb", "est_compressed_gb", "file_gb", "file_count")


@query(
    "snapshot_append",
    """
    WITH s AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
    SELECT event_type, n, ts AS log_time, CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS snapshot_id, strftime(ts, '%Y-%m-%d') AS log_date
    FROM s, (VALUES (TIMESTAMP '2024-01-30 10:00:00'), (TIMESTAMP '2024-01-31 00:00:00')) t(ts)
    """,
)
def q_snapshot_append(spark, sf):
    from watchloom.session import scratch_path

    path = scratch_path(spark, "history")
    counts = load(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    for at in (datetime(2024, 1, 30, 10), datetime(2024, 1, 31)):
        append_snapshot(counts, path, at)
    return read_history(spark, path).withColumn("log_date", F.col("log_date").cast("string"))


@query(
    "retention",
    "SELECT event_id, ts, CAST(ts AS DATE) AS log_date FROM events WHERE ts >= TIMESTAMP '2024-01-31 10:30:00' - INTERVAL 5 DAY",
)
def q_retention(spark, sf):
    """What a stored history holds after two purges, the second one in the middle of a day."""
    from watchloom.session import scratch_path

    path = scratch_path(spark, "events")
    e = load(spark, sf, "events").select("event_id", "ts", F.to_date("ts").alias("log_date"))
    e.repartition("log_date").write.partitionBy("log_date").parquet(path)
    for at in (datetime(2024, 1, 20), datetime(2024, 1, 31, 10, 30)):
        purge_stored(spark, path, "ts", 5, at)
    return read_history(spark, path)


@query(
    "wait_history",
    """
    SELECT upper(event_type) || '_' || (user_id % 10) AS wait_type, count(*) AS samples FROM events
    WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1
    """,
)
def q_wait_history(spark, sf):
    e = load(spark, sf, "events").withColumn("wait_type", F.concat(F.upper("event_type"), F.lit("_"), (F.col("user_id") % 10).cast("string")))
    kept = purge_expired(e, "ts", 11, datetime(2024, 1, 31))
    return kept.groupBy("wait_type").agg(F.count(F.lit(1)).alias("samples"))
