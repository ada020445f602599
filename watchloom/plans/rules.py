"""Rule-pack queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions.times import ntz
from watchloom.operators.aggregates import non_uniform
from watchloom.operators.rule_packs import policy_pack, posture_pack
from watchloom.operators.rules import Rule, constraint_rules, dictionary_match, rule_details, run_rules, secret_candidates, table_advisor
from watchloom.operators.rules import COMMON_SECRETS
from watchloom.operators.joins import orphans
from watchloom.plans.adapters import orders_as_of
from watchloom.plans.registry import query
from watchloom.session import load


def driver_tables(spark, sf):
    return {t: load(spark, sf, t) for t in ("customer", "supplier", "part", "orders", "lineitem", "documents", "labels")}


def data_rules():
    return [
        Rule(1, "Quality", "Negative balance", "customer", "c_acctbal < 0", detail=("c_custkey", "c_mktsegment")),
        Rule(2, "Quality", "Unknown segment", "customer", "c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE')", detail=("c_custkey",)),
        Rule(3, "Quality", "Negative supplier", "supplier", "s_acctbal < 0", detail=("s_suppkey",)),
        Rule(4, "Quality", "Discount over nine percent", "lineitem", "l_discount > 0.09", detail=("l_orderkey", "l_linenumber", "l_partkey")),
        Rule(5, "Integrity", "Documents without label", build=lambda t: orphans(t["documents"], t["labels"], "doc_id", "doc_id"), needs=("documents", "labels"), detail=("doc_id",)),
        Rule(6, "Uniformity", "Orders shipped on different days", build=lambda t: non_uniform(t["lineitem"], "l_orderkey", "l_shipdate"), needs=("lineitem",), detail=("l_orderkey",)),
        Rule(7, "Code", "Documents with mail addresses", "documents", "contains(text, '@')", detail=("doc_id", "source")),
        Rule(8, "Quality", "Needs a table nobody has", "no_such_table", "true"),
    ]


COUNTS_SQL = """
n AS (
  SELECT 1 AS code, 'Quality' AS category, 'Negative balance' AS title, count(*) AS issues FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 2, 'Quality', 'Unknown segment', count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE')
  UNION ALL SELECT 3, 'Quality', 'Negative supplier', count(*) FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT 4, 'Quality', 'Discount over nine percent', count(*) FROM lineitem WHERE l_discount > 0.09::DOUBLE
  UNION ALL SELECT 5, 'Integrity', 'Documents without label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 6, 'Uniformity', 'Orders shipped on different days', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_shipdate) <> max(l_shipdate))
  UNION ALL SELECT 7, 'Code', 'Documents with mail addresses', count(*) FROM documents WHERE contains(text, '@')
  UNION ALL SELECT 8, 'Quality', 'Needs a table nobody has', NULL),
rep AS (SELECT *, CASE WHEN issues IS NULL THEN 'Not supported' WHEN issues = 0 THEN 'OK' ELSE 'Possible issue found (' || issues || ')' END AS result FROM n)
"""


@query("rule_report", f"WITH {COUNTS_SQL} SELECT code, category, title, result, issues FROM rep")
def q_rule_report(spark, sf):
    return run_rules(driver_tables(spark, sf), data_rules(), issues_only=False).drop("how_to_fix")


@query("rule_issues", f"WITH {COUNTS_SQL} SELECT code, category, title, result, issues FROM rep WHERE result NOT IN ('OK', 'Info')")
def q_rule_issues(spark, sf):
    return run_rules(driver_tables(spark, sf), data_rules(), issues_only=True).drop("how_to_fix")


@query(
    "rule_details",
    """
    SELECT 1 AS code, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS detail FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT 2, '{"c_custkey":' || c_custkey || '}' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD', 'FURNITURE')
    UNION ALL SELECT 3, '{"s_suppkey":' || s_suppkey || '}' FROM supplier WHERE s_acctbal < 0
    UNION ALL SELECT 4, '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || '}' FROM lineitem WHERE l_discount > 0.09::DOUBLE
    UNION ALL SELECT 5, '{"doc_id":' || doc_id || '}' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 6, '{"l_orderkey":' || l_orderkey || '}' FROM lineitem GROUP BY l_orderkey HAVING min(l_shipdate) <> max(l_shipdate)
    UNION ALL SELECT 7, '{"doc_id":' || doc_id || ',"source":"' || source || '"}' FROM documents WHERE contains(text, '@')
    """,
)
def q_rule_details(spark, sf):
    return rule_details(driver_tables(spark, sf), data_rules())


# (code, setting, value that is an issue); the place sets the fixture's values.
SETTINGS = [
    (4, "Ad Hoc Distributed Queries", 1), (5, "cross db ownership chaining", 1), (8, "default trace enabled", 0), (9, "scan for startup procs", 1),
    (10, "Database Mail XPs", 1), (11, "SQL Mail XPs", 1), (12, "remote admin connections", 0), (13, "remote access", 1), (14, "SMO and DMO XPs", 0),
    (200, "xp_cmdshell", 1), (201, "Ole Automation Procedures", 1), (202, "clr enabled", 1), (204, "external scripts enabled", 1),
]


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def inventory(spark, sf):
    """A fleet's inventory made from the driver tables: servers share login, database and user names."""
    c, s, o, e, p, n, r = (load(spark, sf, t) for t in ("customer", "supplier", "orders", "events", "part", "nation", "region"))
    key, sup, order, nat = F.col("c_custkey"), F.col("s_suppkey"), F.col("o_orderkey"), F.col("n_nationkey")
    home, three, of_order, of_login = text("srv", F.col("c_nationkey")), text("srv", sup % 3), text("srv", order % 3), text("srv", key % 3)
    as_of = orders_as_of(spark, sf)
    login = F.when(key % 17 == 0, text("BUILTIN/", key)).when(key % 19 == 0, text(F.upper(of_login), "/", key)).otherwise(text("Login", key))
    secret = F.when(key % 7 == 0, "dragon").when(key % 7 == 1, F.reverse(login)).when(key % 7 == 2, F.upper(login)).when(key % 7 == 3, "7777")
    owned = o.join(c.select(F.col("c_custkey").alias("o_custkey"), home.alias("server")), "o_custkey")
    db, kind = text("db", F.col("o_custkey")), sup % 10
    settings = s.select(text("srv", sup).alias("server"), (sup % 2).alias("odd"), F.posexplode(F.array(*[F.lit(name) for _, name, _ in SETTINGS])).alias("i", "name"))
    server_roles = s.select(
        three.alias("server"), F.lit(None).cast("string").alias("database"), F.when(sup % 25 == 1, "sysadmin").otherwise("bulkadmin").alias("role"), text("Login", sup + 12).alias("member")
    )
    db_roles = o.select(
        of_order.alias("server"), db.alias("database"), F.when(order % 4 == 0, "db_owner").otherwise("db_datareader").alias("role"),
        F.when(order % 10 == 0, "dbo").otherwise(text("u", order - order % 2)).alias("member"),
    )
    marks = [(10, " Execute(@q)"), (13, " xp_cmdshell"), (17, " sp_OACreate"), (19, " GRANT x")]
    return {
        "settings": settings.select("server", "name", ((F.col("i") + F.col("odd")) % 2).cast("int").alias("value")),
        "servers": n.select(
            text("srv", nat).alias("server"), (10 + nat % 6).cast("int").alias("version"), (nat * 100).cast("int").alias("build"),
            F.when(nat % 3 != 0, nat.cast("int")).alias("error_logs"), (nat % 2 == 0).alias("windows_auth_only"), (nat % 4).cast("int").alias("audit_level"),
        ),
        "supported": r.select((10 + F.col("r_regionkey")).cast("int").alias("version"), F.lit(1000).alias("latest_build")),
        "server_objects": s.select(
            three.alias("server"), F.when(sup % 3 == 0, "TRIGGER").when(sup % 3 == 1, "TRACE").otherwise("EVENT_SESSION").alias("kind"),
            F.when(sup % 6 == 2, "system_health").otherwise(F.col("s_name")).alias("name"),
            (sup % 2 == 0).alias("is_default"), (sup % 5 == 0).alias("is_disabled"), (sup % 7 == 0).alias("is_shipped"),
        ),
        "databases": c.select(
            home.alias("server"), F.when(key % 31 == 0, "Northwind").otherwise(text("db", key)).alias("name"),
            F.when(F.col("c_acctbal") < 0, "OFFLINE").otherwise("ONLINE").alias("state"), (key % 8 == 0).alias("is_trustworthy"),
            F.when(key % 9 == 0, "NONE").otherwise("CHECKSUM").alias("page_verify"), (key % 6 % 2).cast("int").alias("containment"),
            (key % 4 == 1).alias("is_auto_close"), (key % 3 == 0).alias("is_encrypted"),
            F.when(key % 2 == 0, "FULL").otherwise("SIMPLE").alias("recovery_model"), ntz("1999-01-01").alias("created"),
        ),
        "logins": c.select(
            of_login.alias("server"), key.alias("login_id"), login.alias("name"), F.when(key % 5 == 0, "G").otherwise("S").alias("type"),
            (key % 11 == 0).alias("is_disabled"), (key % 2 == 0).alias("is_policy_checked"), (key % 3 == 0).alias("is_expiration_checked"),
            F.when(key % 13 == 0, 10).alias("days_until_expiration"), F.date_sub(F.lit(as_of.date()), (key * 7 % 400).cast("int")).alias("password_set"),
            F.sha2(F.coalesce(secret, text("s3cret!", key)), 256).alias("password_hash"), key.alias("sid"),
        ),
        "db_users": o.select(
            of_order.alias("server"), db.alias("database"), order.alias("user_id"), text("u", order).alias("name"), F.lit("S").alias("type"),
            F.when(order % 7 == 0, "DATABASE").otherwise("INSTANCE").alias("auth"), F.col("o_custkey").alias("sid"), (order % 11 == 0).alias("is_fixed_role"),
        ),
        "server_permissions": s.select(
            three.alias("server"), F.when(kind.isin(1, 9), "public").otherwise(text("Login", (sup * 7 + 36) % 90)).alias("grantee"),
            F.when(kind == 0, "Control Server").when(kind == 9, "VIEW ANY DATABASE").when(kind == 1, "ALTER TRACE").when(kind == 2, "IMPERSONATE ANY LOGIN")
            .when(kind == 3, "UNSAFE ASSEMBLY").otherwise("IMPERSONATE").alias("permission"),
            F.lit("G").alias("state"), F.when((kind < 4) | (kind == 9), "SERVER").otherwise("SERVER_PRINCIPAL").alias("class"), text("Login", sup).alias("target"),
        ),
        "role_members": server_roles.unionByName(db_roles),
        "db_permissions": o.select(
            of_order.alias("server"), F.when(order % 50 == 0, "master").otherwise(db).alias("database"),
            F.when(order % 20 == 0, "public").when(order % 20 == 1, "guest").when(order % 3 == 0, text("u", order)).otherwise(text("y", order)).alias("grantee"),
            F.when(order % 5 == 0, "CONNECT").when(order % 5 == 1, "IMPERSONATE").otherwise("SELECT").alias("permission"),
            F.when(order % 6 == 0, "D").otherwise("G").alias("state"),
            F.when(order % 100 == 0, "xp_cmd").when(order % 100 == 50, "xp_msver").otherwise("tbl").alias("object_name"),
        ),
        "modules": load(spark, sf, "documents").select(
            F.lit("srv1").alias("server"), F.col("source").alias("database"), text("p", F.col("doc_id")).alias("name"),
            F.concat("text", *[F.when(F.col("doc_id") % m == 0, t).otherwise("") for m, t in marks]).alias("definition"),
            (F.col("doc_id") % 20 == 0).alias("is_shipped"), (F.col("doc_id") % 100 == 3).alias("is_auto_executed"),
            F.when(F.col("doc_id") % 50 == 7, "dbo").when(F.col("doc_id") % 50 == 8, "owner").alias("execute_as"),
        ),
        "assemblies": p.select(
            F.lit("srv0").alias("server"), text("db", F.col("p_partkey") % 10).alias("database"), text("a", F.col("p_partkey")).alias("name"),
            (F.col("p_partkey") % 2 == 0).alias("is_user_defined"), F.when(F.col("p_partkey") % 3 == 0, "SAFE_ACCESS").otherwise("UNSAFE_ACCESS").alias("permission_set"),
        ),
        "files": p.select(
            F.lit("srv0").alias("server"), text("db", F.col("p_partkey") % 10).alias("database"),
            text("/d/", F.col("p_partkey"), F.element_at(F.array(*[F.lit(x) for x in (".mdf", ".LDF", ".dat", ".ndf")]), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("path"),
        ),
        "backups": owned.select(
            "server", db.alias("database"), F.when(F.col("o_orderstatus") == "P", "L").otherwise("D").alias("type"), F.col("o_orderdate").alias("start"),
            F.col("o_orderdate").alias("finish"), F.when(F.col("o_orderstatus") == "O", 7).otherwise(2).alias("device_type"),
            text(order, F.when(order % 2 == 0, ".bak").otherwise(".saf")).alias("path"), (order % 3 == 0).alias("is_encrypted"),
        ),
        "sessions": e.select(
            text("srv", F.col("user_id") % 3).alias("server"), text("L", F.col("user_id")).alias("login"),
            F.when(F.col("event_id") % 2 == 0, "WINDOWS_LOGIN").otherwise("SQL_LOGIN").alias("login_type"),
            F.when(F.col("event_id") % 3 == 0, "KERBEROS").otherwise("NTLM").alias("auth_scheme"), F.lit("TCP").alias("net_transport"),
        ),
        "linked_servers": s.select(three.alias("server"), F.col("s_name").alias("name"), (sup % 2 == 0).alias("is_linked"), (sup % 4 == 0).alias("uses_self_credential")),
        "proxies": s.select(three.alias("server"), F.col("s_name").alias("name"), F.when(sup % 9 == 0, "public").otherwise("svc").alias("principal")),
        "log": e.select(
            F.lit("srv1").alias("server"), F.col("ts").alias("log_date"), F.lit("Logon").alias("process"),
            F.when(F.col("event_type") == "error", "Login FAILED for user").otherwise("fine").alias("text"),
        ),
    }


POSTURE_CTES = f"""
    now AS (SELECT CAST(max(o_orderdate) AS DATE) + 1 AS d FROM orders),
    st AS (SELECT 'srv' || s_suppkey AS server, name, CAST((i + s_suppkey) % 2 AS INTEGER) AS value
           FROM supplier, (VALUES {", ".join(f"('{name}', {i})" for i, (_, name, _) in enumerate(SETTINGS))}) t(name, i)),
    sv AS (SELECT 'srv' || n_nationkey AS server, CAST(10 + n_nationkey % 6 AS INTEGER) AS version, CAST(n_nationkey * 100 AS INTEGER) AS build,
                  CASE WHEN n_nationkey % 3 <> 0 THEN CAST(n_nationkey AS INTEGER) END AS logs, n_nationkey AS n FROM nation),
    d AS (SELECT 'srv' || c_nationkey AS server, CASE WHEN c_custkey % 31 = 0 THEN 'Northwind' ELSE 'db' || c_custkey END AS name, c_custkey AS k, c_acctbal >= 0 AS online FROM customer),
    lg AS (SELECT 'srv' || (c_custkey % 3) AS server, c_custkey AS k, CASE WHEN c_custkey % 17 = 0 THEN 'BUILTIN/' || c_custkey WHEN c_custkey % 19 = 0 THEN 'SRV' || (c_custkey % 3) || '/' || c_custkey
                  ELSE 'Login' || c_custkey END AS name, c_custkey % 5 <> 0 AS sql_login, c_custkey % 11 <> 0 AS enabled FROM customer),
    live AS (SELECT server, name FROM lg WHERE k > 10 AND enabled),
    u AS (SELECT 'srv' || (o_orderkey % 3) AS server, 'db' || o_custkey AS database, 'u' || o_orderkey AS name, o_orderkey AS k, o_custkey AS sid FROM orders),
    g AS (SELECT 'srv' || (s_suppkey % 3) AS server, CASE WHEN s_suppkey % 10 IN (1, 9) THEN 'public' ELSE 'Login' || ((s_suppkey * 7 + 36) % 90) END AS grantee,
                 CASE WHEN s_suppkey % 10 = 0 THEN 'Control Server' WHEN s_suppkey % 10 = 9 THEN 'VIEW ANY DATABASE' WHEN s_suppkey % 10 = 1 THEN 'ALTER TRACE'
                      WHEN s_suppkey % 10 = 2 THEN 'IMPERSONATE ANY LOGIN' WHEN s_suppkey % 10 = 3 THEN 'UNSAFE ASSEMBLY' ELSE 'IMPERSONATE' END AS permission,
                 'Login' || s_suppkey AS target, s_suppkey AS k FROM supplier),
    sr AS (SELECT 'srv' || (s_suppkey % 3) AS server, 'Login' || (s_suppkey + 12) AS member FROM supplier WHERE s_suppkey % 25 = 1),
    dr AS (SELECT 'srv' || (o_orderkey % 3) AS server, 'db' || o_custkey AS database, CASE WHEN o_orderkey % 10 = 0 THEN 'dbo' ELSE 'u' || (o_orderkey - o_orderkey % 2) END AS member,
                  CASE WHEN o_orderkey % 4 = 0 THEN 'db_owner' ELSE 'db_datareader' END AS role FROM orders),
    dp AS (SELECT 'srv' || (o_orderkey % 3) AS server, CASE WHEN o_orderkey % 50 = 0 THEN 'master' ELSE 'db' || o_custkey END AS database,
                  CASE WHEN o_orderkey % 20 = 0 THEN 'public' WHEN o_orderkey % 20 = 1 THEN 'guest' WHEN o_orderkey % 3 = 0 THEN 'u' || o_orderkey ELSE 'y' || o_orderkey END AS grantee,
                  CASE WHEN o_orderkey % 5 = 0 THEN 'CONNECT' WHEN o_orderkey % 5 = 1 THEN 'IMPERSONATE' ELSE 'SELECT' END AS permission, o_orderkey % 6 <> 0 AS granted,
                  CASE WHEN o_orderkey % 100 = 0 THEN 'xp_cmd' WHEN o_orderkey % 100 = 50 THEN 'xp_msver' ELSE 'tbl' END AS object_name FROM orders),
    m AS (SELECT 'srv1' AS server, source AS database, 'p' || doc_id AS name, doc_id AS k, lower(text || CASE WHEN doc_id % 10 = 0 THEN ' Execute(@q)' ELSE '' END
                 || CASE WHEN doc_id % 13 = 0 THEN ' xp_cmdshell' ELSE '' END || CASE WHEN doc_id % 17 = 0 THEN ' sp_OACreate' ELSE '' END
                 || CASE WHEN doc_id % 19 = 0 THEN ' GRANT x' ELSE '' END) AS body FROM documents),
    b AS (SELECT 'srv' || c_nationkey AS server, 'db' || o_custkey AS database, o_orderkey AS k, o_orderdate AS at_, o_orderstatus AS status,
                 o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.bak' ELSE '.saf' END AS path FROM orders JOIN customer ON c_custkey = o_custkey),
    newest AS (SELECT server, database AS name, max(at_) AS seen, max(at_) FILTER (status = 'P') AS log_seen FROM b GROUP BY ALL),
    boss AS (SELECT server, grantee AS login FROM g WHERE k % 10 IN (0, 2) OR permission = 'ALTER TRACE' UNION SELECT server, member FROM sr
             UNION SELECT g.server, g.grantee FROM boss JOIN g ON g.server = boss.server AND g.target = boss.login AND g.permission = 'IMPERSONATE'),
    so AS (SELECT 'srv' || (s_suppkey % 3) AS server, s_name AS name, s_suppkey AS k FROM supplier),
    pt AS (SELECT 'srv0' AS server, 'db' || (p_partkey % 10) AS database, p_partkey AS k FROM part)
"""


def _j(*cols):
    return "json_object(" + ", ".join(f"'{c.split(' ')[-1]}', {c.rsplit(' AS ', 1)[0]}" for c in cols) + ")"


_SN, _SDN = _j("server", "name"), _j("server", "database", "name")
POSTURE = {code: f"SELECT {_j('server', 'name', 'value')} FROM st WHERE name = '{name}' AND value = {bad}" for code, name, bad in SETTINGS} | {
    1: f"SELECT {_SN} FROM d WHERE k % 8 = 0",
    2: f"SELECT {_j('server', 'n % 4 AS audit_level')} FROM sv WHERE n % 4 < 2",
    3: f"SELECT {_j('server')} FROM sv WHERE n % 2 = 1",
    7: f"SELECT {_SN} FROM d WHERE k % 9 = 0 AND online",
    15: f"SELECT {_SN} FROM so WHERE k % 3 = 0 AND k % 7 <> 0 AND k % 5 <> 0",
    16: f"SELECT {_SN} FROM so WHERE k % 3 = 1 AND k % 2 = 1",
    17: f"SELECT {_SN} FROM so WHERE k % 6 = 5",
    18: f"SELECT {_SN} FROM d WHERE k % 6 % 2 = 1 AND k % 4 = 1",
    19: f"SELECT CASE WHEN logs IS NULL THEN {_j('server')} ELSE {_j('server', 'logs AS error_logs')} END FROM sv WHERE coalesce(logs, 0) < 12",
    20: f"SELECT {_SDN} FROM u WHERE k % 7 = 0 AND EXISTS (SELECT 1 FROM d WHERE d.server = u.server AND d.name = u.database AND d.k % 6 % 2 = 1)",
    100: "SELECT json_object('server', 'srv1', 'log_date', strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), 'text', 'Login FAILED for user') FROM events WHERE event_type = 'error'",
    101: f"SELECT {_SN} FROM lg WHERE k = 1",
    102: f"SELECT {_SDN} FROM u WHERE k > 4 AND k % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM lg WHERE lg.server = u.server AND lg.k = u.sid)",
    103: f"SELECT {_SN} FROM lg WHERE sql_login AND enabled AND (k % 2 <> 0 OR k % 3 <> 0)",
    104: f"SELECT {_j('server', 'name', "strftime((SELECT d FROM now) - CAST(k * 7 % 400 AS INTEGER), '%Y-%m-%d') AS password_set")} FROM lg WHERE sql_login AND enabled AND k % 3 <> 0 AND k % 13 <> 0 AND k * 7 % 400 > 180",
    105: f"SELECT {_j('server', 'name', "CASE k % 7 WHEN 0 THEN 'dragon' WHEN 1 THEN reverse(name) WHEN 2 THEN upper(name) ELSE '7777' END AS word")} FROM lg WHERE sql_login AND k % 7 < 4",
    106: f"SELECT {_SDN} FROM u WHERE k > 4 AND k % 11 <> 0 AND NOT EXISTS (SELECT 1 FROM dr WHERE dr.server = u.server AND dr.database = u.database AND dr.member = u.name) "
    "AND NOT EXISTS (SELECT 1 FROM dp WHERE dp.server = u.server AND dp.database = u.database AND dp.grantee = u.name AND granted AND permission <> 'CONNECT')",
    107: "SELECT json_object('server', 'srv' || (user_id % 3), 'login', 'L' || user_id) FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0",
    108: f"SELECT {_j('server')} FROM g WHERE permission = 'VIEW ANY DATABASE'",
    109: f"SELECT {_SN} FROM lg WHERE k % 17 = 0",
    110: f"SELECT {_SN} FROM lg WHERE NOT sql_login AND k % 17 <> 0 AND k % 19 = 0",
    111: f"SELECT {_j('server', 'permission')} FROM g WHERE permission = 'ALTER TRACE'",
    112: f"SELECT {_SN} FROM so WHERE k % 9 = 0",
    203: f"SELECT {_j('server', 'database', "'a' || k AS name")} FROM pt WHERE k % 2 = 0 AND k % 3 <> 0",
    300: f"SELECT {_SN} FROM d WHERE k % 3 <> 0 AND online",
    301: f"SELECT {_j('server', 'name', 'age AS days_since')} FROM (SELECT d.server, d.name, CAST(date_diff('day', CAST(coalesce(seen, TIMESTAMP '1999-01-01') AS DATE), (SELECT d FROM now)) AS INTEGER) AS age "
    "FROM d LEFT JOIN newest USING (server, name) WHERE online) WHERE age > 7",
    302: f"SELECT {_j('server', 'database', 'path')} FROM b WHERE k % 3 <> 0",
    303: f"SELECT CASE WHEN log_seen IS NULL THEN {_j('d.server AS server', 'd.name AS name')} ELSE {_j('d.server AS server', 'd.name AS name', "strftime(log_seen, '%Y-%m-%dT%H:%M:%S.%g') AS last_seen")} END "
    "FROM d LEFT JOIN newest USING (server, name) WHERE online AND k % 2 = 0 AND (log_seen IS NULL OR date_diff('day', CAST(log_seen AS DATE), (SELECT d FROM now)) > 1)",
    304: f"SELECT {_j('server', 'database', "'/d/' || k || CASE k % 4 WHEN 0 THEN '.mdf' WHEN 1 THEN '.LDF' ELSE '.ndf' END AS path")} FROM pt WHERE k % 4 <> 2",
    305: f"SELECT {_j('server', 'path')} FROM b WHERE status <> 'O' AND k % 2 = 0 AND at_ >= (SELECT d - 7 FROM now)",
    306: f"SELECT {_j('server', 'database', 'count(*) AS record_count')} FROM b WHERE at_ >= (SELECT d - 7 FROM now) GROUP BY server, database HAVING count(*) FILTER (status = 'O') = 0",
    400: f"SELECT {_j('server', 'grantee', 'permission')} FROM g WHERE (k % 10 = 0 OR permission = 'ALTER TRACE') AND EXISTS (SELECT 1 FROM live WHERE live.server = g.server AND live.name = g.grantee)",
    401: f"SELECT {_j('server', 'member', "'sysadmin' AS role")} FROM sr WHERE EXISTS (SELECT 1 FROM live WHERE live.server = sr.server AND live.name = sr.member)",
    402: f"SELECT {_j('server', 'grantee')} FROM g WHERE k % 10 = 2",
    403: f"SELECT {_j('server', 'grantee', 'target')} FROM g WHERE permission = 'IMPERSONATE'",
    404: f"SELECT {_j('server', 'login')} FROM boss",
    405: f"SELECT {_j('server', 'database', 'member', 'role')} FROM dr WHERE role = 'db_owner' AND member <> 'dbo'",
    406: f"SELECT {_j('server', 'database', 'grantee')} FROM dp WHERE permission = 'IMPERSONATE' AND granted",
    407: f"SELECT {_j('server', 'database', 'permission')} FROM dp WHERE grantee = 'public' AND granted",
    408: f"SELECT {_j('server', 'database', 'permission')} FROM dp WHERE grantee = 'guest' AND granted",
    409: f"SELECT {_j('server', 'grantee')} FROM g WHERE k % 10 = 3",
    410: f"SELECT {_j('server', 'grantee', 'object_name')} FROM dp WHERE database = 'master' AND object_name = 'xp_cmd' AND granted",
    500: f"SELECT {_SDN} FROM m WHERE k % 50 = 8 AND k % 20 <> 0",
    501: f"SELECT {_SDN} FROM m WHERE k % 20 <> 0 AND (contains(body, 'exec (') OR contains(body, 'exec(') OR contains(body, 'execute (') OR contains(body, 'execute(') OR contains(body, 'sp_executesql'))",
    502: f"SELECT {_SDN} FROM m WHERE k % 20 <> 0 AND contains(body, 'xp_cmdshell')",
    503: f"SELECT {_SDN} FROM m WHERE k % 20 <> 0 AND (contains(body, 'sp_oacreate') OR contains(body, 'sp_oamethod') OR contains(body, 'sp_oagetproperty'))",
    504: f"SELECT {_SDN} FROM m WHERE k % 100 = 3",
    505: f"SELECT {_SDN} FROM m WHERE k % 20 <> 0 AND contains(body, 'grant ')",
    506: f"SELECT {_SN} FROM so WHERE k % 4 = 2",
    605: f"SELECT {_j('server', 'version')} FROM sv WHERE version NOT IN (SELECT 10 + r_regionkey FROM region)",
    606: f"SELECT {_j('server', 'build')} FROM sv WHERE version IN (SELECT 10 + r_regionkey FROM region) AND build < 1000",
    607: f"SELECT {_SN} FROM d WHERE k % 31 = 0",
}


@query(
    "posture_report",
    f"WITH RECURSIVE {POSTURE_CTES} " + " UNION ALL ".join(f"SELECT {c} AS code, (SELECT count(*) FROM ({q}) t) AS issues" for c, q in sorted(POSTURE.items())),
)
def q_posture_report(spark, sf):
    return run_rules(inventory(spark, sf), posture_pack(orders_as_of(spark, sf)), issues_only=False).select("code", "issues")


@query(
    "posture_details",
    f"WITH RECURSIVE {POSTURE_CTES} " + " UNION ALL ".join(f"SELECT {c} AS code, CAST(j AS VARCHAR) AS detail FROM ({q}) t(j)" for c, q in sorted(POSTURE.items())),
)
def q_posture_details(spark, sf):
    return rule_details(inventory(spark, sf), posture_pack(orders_as_of(spark, sf)))


@query(
    "policy_checks",
    """
    WITH f AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN -1 ELSE p_partkey * 50000 END AS m, CASE WHEN p_size % 6 = 0 THEN 'Percent' ELSE 'KB' END AS g, p_size * 30 AS mb FROM part)
    SELECT 1001 AS code, (SELECT count(*) FROM f WHERE m = -1 OR m > 83886080 OR g = 'Percent') AS issues
    UNION ALL SELECT 1002, (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT s_suppkey % 25 FROM supplier WHERE s_suppkey % 3 = 0 AND s_acctbal > 0))
    UNION ALL SELECT 1003, (SELECT count(*) FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey % 2 = 0))
    UNION ALL SELECT 1004, (SELECT count(*) FROM f WHERE mb < 64 OR mb > 1024)
    """,
)
def q_policy_checks(spark, sf):
    key, number = F.col("p_partkey"), F.col("s_suppkey")
    tables = {
        "servers": load(spark, sf, "nation").select(text("srv", F.col("n_nationkey")).alias("server")),
        "data_files": load(spark, sf, "part").select(
            F.lit("srv1").alias("server"),
            text("D:\\", key).alias("path"),
            F.when(key % 9 == 0, -1).otherwise(key * 50000).alias("max_size_kb"),
            F.when(F.col("p_size") % 6 == 0, "Percent").otherwise("KB").alias("growth_type"),
            (F.col("p_size") * 30).alias("growth_mb"),
        ),
        "trace_flags": load(spark, sf, "supplier").select(
            text("srv", number % 25).alias("server"), F.when(number % 3 == 0, 1118).otherwise(1204).alias("flag"), (F.col("s_acctbal") > 0).alias("is_global")
        ),
        "properties": load(spark, sf, "region").select(
            text("srv", F.col("r_regionkey")).alias("server"), F.when(F.col("r_regionkey") % 2 == 0, "version").otherwise("owner").alias("name")
        ),
    }
    return run_rules(tables, policy_pack(), issues_only=False).select("code", "issues")


@query(
    "dictionary_match",
    f"""
    WITH RECURSIVE common(word) AS (VALUES {", ".join(f"('{w}')" for w in COMMON_SECRETS)}),
    rep AS (SELECT repeat(chr(CAST(c AS INTEGER)), CAST(k AS INTEGER)) AS word FROM range(12, 126) a(c), range(1, 10) b(k)),
    runs AS (SELECT substr('01234567890', 1, CAST(n AS INTEGER)) AS word FROM range(1, 12) t(n)
             UNION ALL SELECT substr('1234567890', 1, CAST(n AS INTEGER)) FROM range(1, 11) t(n)),
    w AS (SELECT * FROM common UNION SELECT word FROM rep UNION SELECT word FROM runs UNION SELECT c_name FROM customer
          UNION SELECT lower(c_name) FROM customer UNION SELECT upper(c_name) FROM customer),
    cand AS (SELECT word FROM w UNION SELECT reverse(word) FROM w),
    s AS (SELECT c_custkey, c_name, CASE c_custkey % 8 WHEN 0 THEN 'dragon' WHEN 1 THEN reverse(upper(c_name)) WHEN 2 THEN lower(c_name) WHEN 3 THEN '99999'
             WHEN 4 THEN '987654321' WHEN 5 THEN 'nogard' ELSE 'Str0ng' || c_custkey END AS secret FROM customer)
    SELECT c_custkey, word FROM s JOIN cand ON word = secret
    """,
)
def q_dictionary_match(spark, sf):
    c, key = load(spark, sf, "customer"), F.col("c_custkey")
    secret = (
        F.when(key % 8 == 0, "dragon").when(key % 8 == 1, F.reverse(F.upper("c_name"))).when(key % 8 == 2, F.lower("c_name"))
        .when(key % 8 == 3, "99999").when(key % 8 == 4, "987654321").when(key % 8 == 5, "nogard")
        .otherwise(F.concat(F.lit("Str0ng"), key.cast("string")))
    )
    logins = c.select("c_custkey", F.sha2(secret, 256).alias("password_hash"))
    return dictionary_match(logins, "password_hash", secret_candidates(c.select("c_name"))).select("c_custkey", "word")


@query(
    "table_advisor",
    """
    WITH st AS (SELECT p_partkey, (p_partkey * 7 % 1000) / 10.0::DOUBLE AS f, p_partkey * 37 % 100000 AS pages, p_partkey * 60000 AS rows, p_partkey % 3 * 1000 AS modified,
                       CASE WHEN p_size % 10 = 0 THEN 'LOB_DATA' ELSE 'IN_ROW_DATA' END AS stored, p_size % 12 = 0 AS cs, p_size % 5 <> 0 AS locks FROM part),
    m AS (SELECT *, pages * 8 / 1024.0::DOUBLE AS mb FROM st WHERE pages >= 9),
    t AS (SELECT *, f BETWEEN 5 AND 30 OR (stored <> 'LOB_DATA' AND mb > 400 AND mb * f > 80 AND rows * f > 500000) AS tidy FROM m)
    SELECT p_partkey, CASE WHEN tidy AND (locks OR cs) THEN 'REORGANIZE' WHEN tidy THEN 'ATTENTION' WHEN f > 30 AND cs THEN 'REORGANIZE' WHEN f > 30 THEN 'REBUILD' ELSE 'NONE' END AS action,
           CASE WHEN f <= 30 THEN 100 WHEN f <= 50 THEN 90 ELSE 70 END AS fill_factor,
           CASE WHEN rows > 100 AND modified > 0 THEN CASE WHEN rows + modified < 500000 THEN '100 PERCENT' WHEN rows + modified < 1000000 THEN '50 PERCENT'
             WHEN rows + modified < 5000000 THEN '25 PERCENT' WHEN rows + modified < 10000000 THEN '10 PERCENT' WHEN rows + modified < 50000000 THEN '2 PERCENT'
             WHEN rows + modified < 100000000 THEN '1 PERCENT' ELSE '3000000 ROWS' END END AS sample
    FROM t
    """,
)
def q_table_advisor(spark, sf):
    key = F.col("p_partkey")
    stats = load(spark, sf, "part").select(
        "p_partkey",
        (key * 7 % 1000 / 10.0).alias("fragmentation"),
        (key * 37 % 100000).alias("pages"),
        (key * 60000).alias("rows"),
        (key % 3 * 1000).alias("modified"),
        F.when(F.col("p_size") % 10 == 0, "LOB_DATA").otherwise("IN_ROW_DATA").alias("stored_type"),
        (F.col("p_size") % 12 == 0).alias("is_columnstore"),
        (F.col("p_size") % 5 != 0).alias("allow_page_locks"),
    )
    return table_advisor(stats).select("p_partkey", "action", "fill_factor", "sample")


@query(
    "constraint_rules",
    """
    SELECT 'segments' AS rule, 'enum' AS kind, (SELECT count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS violations
    UNION ALL SELECT 'line_key', 'unique', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
    UNION ALL SELECT 'open_customer', 'unique', (SELECT count(*) FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey HAVING count(*) > 1))
    UNION ALL SELECT 'one_label', 'once', (SELECT count(*) FROM (SELECT 1 FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1))
    UNION ALL SELECT 'labelled', 'foreign_key', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
    """,
)
def q_constraint_rules(spark, sf):
    spec = [
        {"name": "segments", "kind": "enum", "table": "customer", "column": "c_mktsegment", "values": ["BUILDING", "MACHINERY"]},
        {"name": "line_key", "kind": "unique", "table": "lineitem", "columns": ["l_orderkey", "l_linenumber"]},
        {"name": "open_customer", "kind": "unique", "table": "orders", "columns": ["o_custkey"], "where": "o_orderstatus = 'O'"},
        {"name": "one_label", "kind": "once", "table": "labels", "columns": ["doc_id"]},
        {"name": "labelled", "kind": "foreign_key", "table": "documents", "column": "doc_id", "parent": "labels", "key": "doc_id"},
    ]
    return constraint_rules(driver_tables(spark, sf), spec)
