"""Join, ranking and set queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from watchloom.functions.times import ntz
from watchloom.operators.aggregates import union_all
from watchloom.operators.joins import (
    assign_range,
    explode_nodes,
    late_alert,
    late_entities,
    new_entities,
    only_kind_recently,
    orphans,
    resolve_items,
)
from watchloom.operators.ranking import choose_best, latest_per_key, ordinal, range_batches, top_n, with_group_max
from watchloom.functions.text import extract_log_fields
from watchloom.plans.adapters import EVENTS_AS_OF, ORDERS_AS_OF
from watchloom.operators.ranges import assign_boundaries
from watchloom.plans.registry import query
from watchloom.plans.text import LOGLINES_SQL, RESTORE_FIELDS, loglines
from watchloom.session import load


@query(
    "new_entities",
    """
    SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l
    WHERE l_shipdate >= TIMESTAMP '2001-01-01' AND NOT EXISTS (
      SELECT 1 FROM lineitem p WHERE p.l_partkey = l.l_partkey AND p.l_suppkey = l.l_suppkey AND p.l_shipdate < TIMESTAMP '2001-01-01')
    """,
)
def q_new_entities(spark, sf):
    lines = load(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate")
    cut = ntz(datetime(2001, 1, 1))
    now, before = lines.where(F.col("l_shipdate") >= cut), lines.where(F.col("l_shipdate") < cut)
    key = ["l_partkey", "l_suppkey"]
    return new_entities(now.select(*key).distinct(), before, key)


@query("orphans", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_orphans(spark, sf):
    return orphans(load(spark, sf, "documents").select("doc_id", "n_chars"), load(spark, sf, "labels"), "doc_id", "doc_id")


@query(
    "single_kind",
    """
    SELECT o_custkey, count(*) AS record_count, max(o_orderdate) AS last_start FROM orders a
    WHERE o_orderdate >= TIMESTAMP '2001-12-01' - INTERVAL 900 DAY AND o_orderstatus = 'O'
      AND NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderstatus <> 'O'
                      AND b.o_orderdate >= TIMESTAMP '2001-12-01' - INTERVAL 900 DAY)
    GROUP BY o_custkey
    """,
)
def q_single_kind(spark, sf):
    kind = F.col("o_orderstatus") == "O"
    details = [F.max("o_orderdate").alias("last_start")]
    return only_kind_recently(load(spark, sf, "orders"), "o_custkey", kind, "o_orderdate", 900, ORDERS_AS_OF, details)


@query(
    "range_assign",
    """
    SELECT o_orderkey, 1 + (o_orderdate >= TIMESTAMP '1996-01-01')::INT + (o_orderdate >= TIMESTAMP '1998-06-01')::INT
             + (o_orderdate >= TIMESTAMP '2000-01-01')::INT AS right_no,
           1 + (o_orderkey > 100)::INT + (o_orderkey > 5000)::INT AS left_no
    FROM orders
    """,
)
def q_range_assign(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    o = assign_range(o, "o_orderdate", [datetime(1996, 1, 1), datetime(1998, 6, 1), datetime(2000, 1, 1)], out="right_no")
    return assign_range(o, "o_orderkey", [100, 5000], right=False, out="left_no").drop("o_orderdate")


@query(
    "range_boundaries",
    """
    WITH b AS (SELECT DISTINCT o_custkey % 7 AS entity, o_orderdate AS edge FROM orders WHERE o_orderkey % 5 = 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY edge) AS k FROM b)
    SELECT l.l_orderkey, l.l_linenumber, coalesce(r.k, 0) + 1 AS right_no, coalesce(s.k, 0) + 1 AS left_no
    FROM (SELECT *, CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_linenumber END AS entity FROM lineitem) l
    ASOF LEFT JOIN n r ON l.entity = r.entity AND l.l_shipdate >= r.edge
    ASOF LEFT JOIN n s ON l.entity = s.entity AND l.l_shipdate > s.edge
    """,
)
def q_range_boundaries(spark, sf):
    """Boundaries of each entity from a table; a third of the rows belong to one entity."""
    entity = F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_linenumber")).cast("long").alias("entity")
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", entity, "l_shipdate")
    edges = load(spark, sf, "orders").where("o_orderkey % 5 = 0").select((F.col("o_custkey") % 7).alias("entity"), F.col("o_orderdate").alias("boundary"))
    rows = assign_boundaries(rows, "l_shipdate", edges, by=["entity"], out="right_no")
    return assign_boundaries(rows, "l_shipdate", edges, by=["entity"], right=False, out="left_no").drop("entity", "l_shipdate")


@query(
    "explode_nodes",
    """
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
    """,
)
def q_explode_nodes(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text")
    nodes = F.transform(F.split("text", "\n"), lambda s: F.struct(s.alias("line")))
    return explode_nodes(d.select("doc_id", nodes.alias("nodes")), "nodes", outer=True)


LATE_SQL = f"""
    {LOGLINES_SQL},
    r AS (SELECT trim(regexp_extract(text, '^[^:]*:([^,]*),', 1)) AS database_name, max(log_date) AS log_date FROM log
          WHERE process = 'Backup' AND log_date BETWEEN TIMESTAMP '2024-01-11' AND TIMESTAMP '2024-01-31' GROUP BY 1),
    inv AS (SELECT DISTINCT 'db' || user_id AS database_name FROM events),
    late AS (SELECT inv.database_name, r.log_date FROM inv LEFT JOIN r USING (database_name)
             WHERE r.log_date IS NULL OR r.log_date < TIMESTAMP '2024-01-26')
"""


def late(spark, sf):
    log = loglines(spark, sf).where((F.col("process") == "Backup") & F.col("text").startswith("Log was restored."))
    log = extract_log_fields(log, RESTORE_FIELDS).drop("text", "process")
    inv = load(spark, sf, "events").select(F.concat(F.lit("db"), F.col("user_id").cast("string")).alias("database_name")).distinct()
    return late_entities(log, inv, "database_name", "log_date", 120, EVENTS_AS_OF, scan_days=20)


@query("stale_entities", f"WITH {LATE_SQL} SELECT database_name, log_date FROM late")
def q_stale_entities(spark, sf):
    return late(spark, sf).select("database_name", "log_date")


@query(
    "late_alert",
    f"""
    WITH {LATE_SQL}
    SELECT 'srv1' AS event_source, 'DisasterLatencies' AS module, TIMESTAMP '2024-01-31' AS event_time, 'WRN' AS severity,
           'Number of unsynced databases are: ' || count(*) AS description, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS is_sms
    FROM late
    """,
)
def q_late_alert(spark, sf):
    return late_alert(late(spark, sf), "srv1", EVENTS_AS_OF)


@query(
    "latest_per_key",
    """
    SELECT user_id, event_id, ts, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def q_latest_per_key(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return latest_per_key(e, ["user_id"], ["ts", "event_id"])


@query(
    "last_n_per_key",
    """
    SELECT user_id, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5
    """,
)
def q_last_n_per_key(spark, sf):
    from watchloom.operators.ranking import first_per_key

    e = load(spark, sf, "events").select("user_id", "event_id", "ts")
    return first_per_key(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5).drop("ts")


@query(
    "backup_families",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS max_family FROM lineitem
    """,
)
def q_backup_families(spark, sf):
    l = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return with_group_max(l, ["l_orderkey"], "l_linenumber", "max_family")


@query(
    "best_candidate",
    """
    WITH g AS (
      SELECT l_orderkey AS object_id, l_suppkey AS group_id, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS cluster_columns,
             count(*) AS columns, CAST(sum(l_linenumber) AS BIGINT) AS total_length
      FROM lineitem GROUP BY l_orderkey, l_suppkey)
    SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY cluster_columns DESC, columns, total_length, group_id) = 1
    """,
)
def q_best_candidate(spark, sf):
    from watchloom.operators.tables import choose_keys

    cols = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("object_id"),
        F.col("l_suppkey").alias("group_id"),
        (F.col("l_returnflag") == "R").alias("in_cluster"),
        F.col("l_linenumber").alias("column_length"),
    )
    return choose_keys(cols)


@query(
    "ordinal",
    """
    SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS ordinal FROM events
    """,
)
def q_ordinal(spark, sf):
    e = load(spark, sf, "events").select("event_type", "ts", "event_id")
    return ordinal(e, ["event_type"], ["ts", "event_id"]).drop("ts")


@query(
    "range_batches",
    "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) + 999) // 1000 AS batch_no FROM orders",
)
def q_range_batches(spark, sf):
    return range_batches(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query(
    "top_unlabelled",
    """
    SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY n_chars DESC, doc_id LIMIT 50
    """,
)
def q_top_unlabelled(spark, sf):
    d = orphans(load(spark, sf, "documents").select("doc_id", "n_chars"), load(spark, sf, "labels"), "doc_id", "doc_id")
    return top_n(d, 50, [F.col("n_chars").desc(), F.col("doc_id").asc()])


@query(
    "resolve_items",
    """
    WITH items AS (SELECT p_partkey AS item_id, p_name AS item_name, p_size || '.0' AS item_version, p_brand AS publisher_name FROM part),
    req AS (
      SELECT l_orderkey * 10 + l_linenumber AS request_id, any_value(p_name) AS item_name,
             CASE l_orderkey % 4 WHEN 0 THEN 'LATEST' WHEN 1 THEN ' ' WHEN 2 THEN NULL ELSE (l_orderkey % 50) || '.0' END AS item_version,
             CASE WHEN l_linenumber % 2 = 0 THEN 'Brand#' || (l_orderkey % 25 + 1) END AS publisher_name
      FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) JOIN part ON p_partkey = l_partkey
      GROUP BY l_orderkey, l_linenumber)
    SELECT r.request_id, i.item_id, i.item_version FROM req r JOIN items i ON i.item_name = r.item_name
      AND (r.item_version IS NULL OR upper(r.item_version) = 'LATEST' OR trim(r.item_version) = '' OR r.item_version = i.item_version)
      AND (r.publisher_name IS NULL OR r.publisher_name = i.publisher_name)
    QUALIFY row_number() OVER (PARTITION BY r.request_id ORDER BY i.item_version DESC, i.item_id DESC) = 1
    """,
)
def q_resolve_items(spark, sf):
    part, key = load(spark, sf, "part"), F.col("l_orderkey")
    items = part.select(
        F.col("p_partkey").alias("item_id"),
        F.col("p_name").alias("item_name"),
        F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("item_version"),
        F.col("p_brand").alias("publisher_name"),
        F.col("p_partkey").alias("update_date"),
    )
    lines = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p_partkey"))
    version = (
        F.when(key % 4 == 0, "LATEST").when(key % 4 == 1, " ").when(key % 4 == 3, F.concat((key % 50).cast("string"), F.lit(".0")))
    )
    publisher = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string")))
    requests = lines.join(part.select("p_partkey", "p_name"), "p_partkey").select(
        (key * 10 + F.col("l_linenumber")).alias("request_id"),
        F.col("p_name").alias("item_name"),
        version.alias("item_version"),
        publisher.alias("publisher_name"),
    )
    return resolve_items(requests, items).select("request_id", "item_id", "item_version")


@query(
    "union_all",
    "SELECT c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, 'supplier' FROM supplier",
)
def q_union_all(spark, sf):
    return union_all(
        load(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("customer").alias("kind")),
        load(spark, sf, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")),
    )
