"""Filter queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from watchloom.operators.filters import drop_benign, idle_entities, in_window, only_issues, pattern_scan, select_entities
from watchloom.operators.joins import activity_snapshot, having_match
from watchloom.operators.patterns import pattern_table_scan
from watchloom.plans.adapters import EVENTS_AS_OF, ORDERS_AS_OF, on_two_servers
from watchloom.plans.registry import query
from watchloom.session import load
from watchloom.functions.text import match_tags


@query(
    "report_window",
    """
    SELECT event_id, ts, user_id, event_type FROM events
    WHERE ts BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-30 23:59:59'
    """,
)
def q_report_window(spark, sf):
    # no bounds given: yesterday 00:00:00 to the end of the as-of day
    e = load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return in_window(e, "ts", datetime(2024, 1, 30, 9, 30))


@query("noise_filter", "SELECT event_id, event_type, value FROM events WHERE event_type NOT IN ('view', 'click')")
def q_noise_filter(spark, sf):
    return drop_benign(load(spark, sf, "events").select("event_id", "event_type", "value"), "event_type", ["view", "click"])


@query(
    "idle_users",
    """
    WITH s AS (
      SELECT user_id, min(ts) AS last_start, max(ts) AS last_end,
             CASE WHEN max(event_id) % 5 = 0 THEN 'running' ELSE 'sleeping' END AS state,
             CASE user_id % 6 WHEN 0 THEN 'SQLAgent - job' WHEN 1 THEN 'Microsoft SQL Server Management Studio' ELSE 'app' END AS program,
             'user' || user_id AS login, 'host' || (user_id % 11) AS host
      FROM events GROUP BY user_id)
    SELECT login, host, program, date_diff('minute', greatest(last_start, last_end), TIMESTAMP '2024-01-31') AS idle_minutes
    FROM s
    WHERE state = 'sleeping' AND program = 'app' AND login NOT IN ('user3', 'user14') AND host <> 'host5' AND user_id % 20 <> 0
      AND date_diff('minute', greatest(last_start, last_end), TIMESTAMP '2024-01-31') >= 1500
    """,
)
def q_idle_users(spark, sf):
    uid = F.col("user_id")
    program = (
        F.when(uid % 6 == 0, "SQLAgent - job").when(uid % 6 == 1, "Microsoft SQL Server Management Studio").otherwise("app")
    )
    events = load(spark, sf, "events")
    s = events.groupBy("user_id").agg(F.min("ts").alias("last_start"), F.max("ts").alias("last_end"), F.max("event_id").alias("e"))
    s = s.select(
        "last_start",
        "last_end",
        F.when(F.col("e") % 5 == 0, "running").otherwise("sleeping").alias("state"),
        program.alias("program"),
        F.concat(F.lit("user"), uid.cast("string")).alias("login"),
        F.concat(F.lit("host"), (uid % 11).cast("string")).alias("host"),
    )
    admins = events.where("user_id % 20 = 0").select(F.concat(F.lit("user"), uid.cast("string"))).distinct()
    out = idle_entities(s, 1500, EVENTS_AS_OF, admins=admins, except_logins=["USER3", "user14"], except_hosts=["Host5"])
    return out.select("login", "host", "program", F.col("idle_minutes").cast("long").alias("idle_minutes"))


def inventory(spark, sf):
    key = F.col("c_custkey")
    return load(spark, sf, "customer").select(
        F.col("c_name").alias("name"),
        (key <= 4).alias("is_system"),
        (key % 17 == 0).alias("is_mirror"),
        F.when(F.col("c_acctbal") < 0, "OFFLINE").when(key % 29 == 0, "SUSPECT").otherwise("ONLINE").alias("state"),
        (key % 19 == 0).alias("is_snapshot"),
        (key % 10 == 0).alias("is_read_only"),
        F.when(key % 13 == 0, "SECONDARY").when(key % 13 == 1, "PRIMARY").alias("replica_role"),
    )


@query(
    "entity_select",
    """
    SELECT c_name AS name FROM customer
    WHERE (c_custkey > 4 AND c_acctbal >= 0 AND c_name NOT IN ('Customer#000000011', 'Customer#000000012')
           OR c_name IN ('Customer#000000002', 'Customer#000000011'))
      AND c_acctbal >= 0 AND c_custkey % 29 <> 0 AND c_custkey % 19 <> 0 AND c_custkey % 10 <> 0 AND c_custkey % 13 <> 0
    """,
)
def q_entity_select(spark, sf):
    expr = (
        "<ALL_USER_DATABASES><EXCLUDE:CUSTOMER#000000011,Customer#000000012,>"
        "<INCLUDE:customer#000000002,Customer#000000011,NoSuchEntity>"
    )
    return select_entities(inventory(spark, sf), expr)


@query(
    "pattern_scan",
    """
    WITH p(pattern) AS (VALUES ('password'), ('License'), ('api_key'), ('http'), ('@')),
    d AS (SELECT d.doc_id, d.source, d.text FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))
    SELECT DISTINCT doc_id, source, pattern FROM d JOIN p ON contains(lower(d.text), lower(p.pattern))
    """,
)
def q_pattern_scan(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "source", "text")
    docs = having_match(docs, load(spark, sf, "labels").select("doc_id"), ["doc_id"])
    return pattern_scan(docs, "text", ["password", "License", "api_key", "http", "@"]).drop("text")


@query(
    "pattern_table",
    """
    WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z]+') AS a FROM benchmark),
    p AS (SELECT DISTINCT a[i] || ' ' || a[i + 1] AS pattern FROM (SELECT a, unnest(range(1, len(a))) AS i FROM w))
    SELECT d.doc_id, p.pattern FROM documents d JOIN p ON contains(lower(d.text), p.pattern)
    """,
)
def q_pattern_table(spark, sf):
    """Which word pairs of the benchmark each document holds: thousands of patterns as a table."""
    words = load(spark, sf, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    pairs = words.select(F.explode(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))).alias("pattern"))
    return pattern_table_scan(load(spark, sf, "documents"), ["doc_id"], "text", pairs)


@query(
    "tag_match",
    """
    SELECT p_partkey, p_name, p_brand || ',' || p_type AS tags FROM part
    WHERE p_brand IN ('Brand#11', 'Brand#5') OR p_type IN ('ECONOMY')
    """,
)
def q_tag_match(spark, sf):
    items = load(spark, sf, "part").select("p_partkey", "p_name", F.concat_ws(",", "p_brand", "p_type").alias("tags"))
    return match_tags(items, "tags", ["Brand#11", "", "Brand#5", "ECONOMY"])


@query(
    "activity_snapshot",
    """
    WITH req AS (
      SELECT o_custkey AS session_id, o_orderkey AS request_id, o_orderdate AS start_time, lower(o_orderstatus) AS request_status,
             CASE WHEN d = 0 THEN o_custkey // 7 ELSE 0 END AS blocking_session_id, o_orderkey % 50 AS reads, o_orderkey % 20 AS writes, server, d
      FROM orders, (VALUES ('a', 0), ('b', 1)) v(server, d)),
    blockers AS (SELECT DISTINCT server, blocking_session_id FROM req WHERE blocking_session_id <> 0),
    wt AS (SELECT l_orderkey, min(l_partkey) AS wait_ms FROM lineitem GROUP BY l_orderkey)
    SELECT r.server, c.c_custkey AS session_id, r.request_id, r.start_time + INTERVAL 1 DAY * r.d AS start_time, r.request_status, r.reads * 8 AS reads_kb,
           r.writes * 8 AS writes_kb, CAST(c.c_nationkey AS BIGINT) * 8 AS memory_usage_kb,
           substr(c.c_name, 2, 6) AS statement_section, w.wait_ms AS wait_duration_ms,
           r.blocking_session_id, CASE WHEN b.blocking_session_id IS NOT NULL AND r.blocking_session_id = 0 THEN 1 END AS head_blocker
    FROM customer c JOIN req r ON r.session_id = c.c_custkey
    LEFT JOIN wt w ON w.l_orderkey = r.request_id
    LEFT JOIN blockers b ON b.server = r.server AND b.blocking_session_id = c.c_custkey
    WHERE c.c_mktsegment <> 'HOUSEHOLD' AND c.c_acctbal >= 0 AND r.start_time + INTERVAL 1 DAY * r.d <= TIMESTAMP '2001-12-01' - INTERVAL 1000 DAY
    """,
)
def q_activity_snapshot(spark, sf):
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    sessions = c.select(
        F.col("c_custkey").alias("session_id"),
        (F.col("c_acctbal") >= 0).alias("is_user_process"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "sleeping").otherwise("running").alias("status"),
        F.col("c_nationkey").cast("long").alias("memory_usage"),
        F.col("c_name").alias("sql_text"),
    )
    connections = c.select(F.col("c_custkey").alias("session_id"))
    requests = o.select(
        F.col("o_custkey").alias("session_id"),
        F.col("o_orderkey").alias("request_id"),
        F.col("o_orderdate").alias("start_time"),
        F.lower("o_orderstatus").alias("status"),
        F.floor(F.col("o_custkey") / 7).alias("blocking_session_id"),
        (F.col("o_orderkey") % 50).alias("reads"),
        (F.col("o_orderkey") % 20).alias("writes"),
        F.lit(0).alias("logical_reads"),
        F.lit(2).alias("start_offset"),
        F.lit(12).alias("end_offset"),
    )
    # one waiting task per request
    tasks = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("request_id")).agg(F.min("l_partkey").alias("wait_duration_ms"))
    waits = o.select(F.col("o_custkey").alias("session_id")).distinct()
    # the same session ids on both servers; nobody waits on the second one
    idle = F.when(F.col("server") == "a", F.col("blocking_session_id")).otherwise(0)
    two = [on_two_servers(t) for t in (sessions, connections, waits, tasks_as_grants(tasks, o))]
    requests = on_two_servers(requests, "start_time").withColumn("blocking_session_id", idle)
    out = activity_snapshot(two[0], two[1], requests, two[2], two[3], ORDERS_AS_OF, 1000 * 86400, ["server"])
    return out.select(
        "server", "session_id", "request_id", "start_time", "request_status", "reads_kb", "writes_kb", "memory_usage_kb",
        "statement_section", "wait_duration_ms", "blocking_session_id", "head_blocker",
    )


def tasks_as_grants(tasks, orders):
    """Per-request rows keyed (session_id, request_id)."""
    keys = orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("request_id"))
    return keys.join(tasks, "request_id")


@query(
    "issue_filter",
    """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'Possible issue found' WHEN c_mktsegment = 'BUILDING' THEN 'Info' ELSE 'OK' END AS result
    FROM customer WHERE c_acctbal < 0
    """,
)
def q_issue_filter(spark, sf):
    result = F.when(F.col("c_acctbal") < 0, "Possible issue found").when(F.col("c_mktsegment") == "BUILDING", "Info").otherwise("OK")
    return only_issues(load(spark, sf, "customer").select("c_custkey", result.alias("result")))
