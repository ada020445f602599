"""Table-set, alert-row and parameterised queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.operators.tables import clear_partition, copy_tables, permission_report, table_inventory
from watchloom.plans.adapters import on_two_servers
from watchloom.plans.graphs import fk_edges
from watchloom.plans.registry import query
from watchloom.session import load, scratch_path
from watchloom.sources.alerts import alert_rows
from watchloom.sources.remote import run_query


@query(
    "copy_report",
    """
    SELECT 'customer' AS object_name, 'c_custkey,c_name,c_nationkey,c_mktsegment' AS columns, (SELECT count(*) FROM customer) AS row_count,
           (SELECT (count(*) + 999) // 1000 FROM customer) AS batch_count, (SELECT CAST(sum(c_custkey) AS BIGINT) FROM customer) AS key_sum
    UNION ALL SELECT 'orders', 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority', (SELECT count(*) FROM orders),
           (SELECT (count(*) + 999) // 1000 FROM orders), (SELECT CAST(sum(o_orderkey) AS BIGINT) FROM orders)
    UNION ALL SELECT 'part', 'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice', (SELECT count(*) FROM part),
           (SELECT (count(*) + 999) // 1000 FROM part), (SELECT CAST(sum(p_partkey) AS BIGINT) FROM part)
    """,
)
def q_copy_report(spark, sf):
    dst = scratch_path(spark, "copy")
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey"}
    sources = {t: load(spark, sf, t) for t in (*keys, "supplier")}
    report = copy_tables(
        spark,
        sources,
        dst,
        except_=("supplier",),
        skip_columns={"customer": ["c_acctbal"]},
        sort_keys={t: [k] for t, k in keys.items()},
        partition_by={"part": ["p_brand"]},
        batch_rows=1000,
        ledger=scratch_path(spark, "copy-ledger"),
    )
    sums = None
    for t, k in keys.items():
        one = spark.read.parquet(f"{dst}/{t}").agg(F.sum(k).alias("key_sum")).select(F.lit(t).alias("object_name"), "key_sum")
        sums = one if sums is None else sums.unionByName(one)
    return report.drop("size_kb").join(sums, "object_name")


@query(
    "clear_partition",
    """
    SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderpriority <> '2-HIGH' GROUP BY o_orderpriority
    """,
)
def q_clear_partition(spark, sf):
    path = scratch_path(spark, "parts")
    load(spark, sf, "orders").write.partitionBy("o_orderpriority").parquet(path)
    clear_partition(spark, path, "o_orderpriority=2-HIGH")
    return spark.read.parquet(path).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "table_inventory",
    """
    WITH RECURSIVE c AS (SELECT DISTINCT l_partkey AS object_id, l_orderkey * 10 + l_linenumber AS column_id, l_orderkey % 50 = 0 AS ident FROM lineitem),
    cols AS (SELECT object_id, string_agg('c' || column_id, ',' ORDER BY column_id) AS table_columns, CAST(max(CASE WHEN ident THEN 1 ELSE 0 END) AS INTEGER) AS has_identity,
                    max(CASE WHEN ident THEN 'c' || column_id END) AS identity_column FROM c GROUP BY object_id),
    ix AS (SELECT DISTINCT l_partkey AS object_id, CASE l_suppkey % 4 WHEN 0 THEN 'PK' WHEN 1 THEN 'UQ' ELSE 'UX' END AS kind, l_suppkey AS index_id, l_orderkey * 10 + l_linenumber AS ord FROM lineitem),
    sets AS (SELECT object_id, kind, index_id, string_agg('c' || ord, ',' ORDER BY ord) AS cols FROM ix GROUP BY ALL),
    keys AS (SELECT object_id, min(cols) FILTER (kind = 'PK') AS pk_columns, min(cols) FILTER (kind = 'UQ') AS uq_columns, min(cols) FILTER (kind = 'UX') AS ux_columns FROM sets GROUP BY object_id),
    fk AS (SELECT DISTINCT master, slave FROM (SELECT p_partkey // 10 AS master, p_partkey AS slave FROM part UNION ALL SELECT p_partkey // 3, p_partkey FROM part) WHERE master <> slave),
    lv AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey NOT IN (SELECT slave FROM fk) UNION SELECT fk.slave, lv.level + 1 FROM lv JOIN fk ON fk.master = lv.node)
    SELECT server, object_id, table_columns, has_identity, identity_column, pk_columns, uq_columns, ux_columns, pk_columns IS NOT NULL AS has_pk,
           CASE WHEN server = 'a' THEN (SELECT CAST(max(level) AS INTEGER) FROM lv WHERE node = object_id) ELSE 0 END AS table_order
    FROM cols JOIN keys USING (object_id), (VALUES ('a'), ('b')) v(server)
    """,
)
def q_table_inventory(spark, sf):
    line = load(spark, sf, "lineitem")
    column_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    name = F.concat(F.lit("c"), column_id.cast("string"))
    no = F.lit(False)
    columns = line.select(
        F.col("l_partkey").alias("object_id"), column_id.alias("column_id"), name.alias("column_name"),
        (F.col("l_orderkey") % 50 == 0).alias("is_identity"), no.alias("is_rowguid"), no.alias("is_filestream"), no.alias("is_sparse"), no.alias("is_lob"),
    ).distinct()
    which = F.col("l_suppkey") % 4
    indexes = line.select(
        F.col("l_partkey").alias("object_id"), F.when(which == 0, "PK").when(which == 1, "UQ").otherwise("UX").alias("kind"),
        F.col("l_suppkey").alias("index_id"), name.alias("column_name"), column_id.alias("key_ordinal"),
    ).distinct()
    # the same object ids on a second server, without foreign keys there
    keys = fk_edges(spark, sf).withColumn("server", F.lit("a"))
    out = table_inventory(on_two_servers(columns), on_two_servers(indexes), keys, ["server"])
    return out.select(
        "server", "object_id", "table_columns", "has_identity", "identity_column", "pk_columns", "uq_columns", "ux_columns", "has_pk", "table_order"
    )


@query(
    "permission_report",
    """
    WITH u AS (SELECT c_nationkey AS database, c_custkey AS id, c_name AS principal FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey <> 7)
    SELECT 'a' AS server, u.database, u.principal, 'ROLE' AS kind, 'role' || (o_orderkey % 3) AS name, 'MEMBER' AS state, CAST(NULL AS VARCHAR) AS object
    FROM orders JOIN u ON u.id = o_custkey WHERE o_orderstatus = 'F'
    UNION ALL
    SELECT 'a', c_nationkey, CASE WHEN c_custkey = 7 THEN 'dbo' ELSE c_name END, 'GRANT', 'SELECT', 'GRANT', 't' || (o_orderkey % 10)
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND c_custkey % 5 <> 0
    UNION ALL
    SELECT 'b', c_nationkey, CASE WHEN c_custkey = 7 THEN 'dbo' ELSE c_name END, 'GRANT', 'SELECT', 'GRANT', 't' || (o_orderkey % 10)
    FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' AND c_custkey % 5 = 0
    """,
)
def q_permission_report(spark, sf):
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    names = F.when(F.col("c_custkey") == 7, "dbo").otherwise(F.col("c_name"))
    users = c.select(
        F.col("c_nationkey").alias("database"), F.col("c_custkey").alias("principal_id"), names.alias("name"), F.lit("S").alias("type"), F.col("c_custkey").alias("sid")
    )
    dbs = c.select(F.col("c_nationkey").alias("database")).distinct()
    roles = dbs.select("database", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("n")).select(
        "database", (-1 - F.col("n")).cast("long").alias("principal_id"), F.concat(F.lit("role"), F.col("n").cast("string")).alias("name"),
        F.lit("R").alias("type"), F.lit(None).cast("long").alias("sid"),
    )
    home = o.join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("database")), "o_custkey")
    members = home.where("o_orderstatus = 'F'").select(
        "database", F.col("o_custkey").alias("member_id"), (-1 - F.col("o_orderkey") % 3).alias("role_id")
    )
    grants = home.where("o_orderstatus <> 'F'").select(
        "database", F.col("o_custkey").alias("grantee_id"), F.when(F.col("o_orderstatus") == "O", "SL").otherwise("CO").alias("type"),
        F.lit("SELECT").alias("permission"), F.lit("GRANT").alias("state"), F.concat(F.lit("t"), (F.col("o_orderkey") % 10).cast("string")).alias("object"),
    )
    logins = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("sid"))
    # the same databases and principals on a second server, where the other logins exist and no role has members
    there = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("sid"), F.lit("b").alias("server"))
    logins = logins.withColumn("server", F.lit("a")).unionByName(there)
    members = members.withColumn("server", F.lit("a"))
    return permission_report(members, on_two_servers(grants), on_two_servers(users.unionByName(roles)), logins, ["server"])


@query(
    "alert_rows",
    """
    SELECT ts AS alert_time, CASE WHEN event_type = 'view' THEN 'UNKNOWN' ELSE event_type END AS alert_type,
           '<instance_name>srv1</instance_name>' || chr(13) || chr(10) || CASE WHEN event_id % 6 = 0 THEN '<UNKNOWN/>' ELSE '<v>' || user_id || '</v>' END AS alert_text
    FROM events
    """,
)
def q_alert_rows(spark, sf):
    body = F.when(F.col("event_id") % 6 != 0, F.concat(F.lit("<v>"), F.col("user_id").cast("string"), F.lit("</v>")))
    kind = F.when(F.col("event_type") != "view", F.col("event_type"))
    e = load(spark, sf, "events").select("ts", kind.alias("kind"), body.alias("body"))
    return alert_rows(e, "kind", "body", "srv1", "ts")


@query(
    "param_query",
    "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000.5 AND c_name <> 'O''Brien'",
)
def q_param_query(spark, sf):
    load(spark, sf, "customer").createOrReplaceTempView("watchloom_customer")
    return run_query(
        spark,
        "SELECT c_custkey, c_name FROM watchloom_customer WHERE c_mktsegment = :segment AND c_acctbal >= :low AND c_name <> :skip",
        {"segment": "BUILDING", "low": 1000.5, "skip": "O'Brien"},
    )
