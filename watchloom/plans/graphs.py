"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.operators import graph as G
from watchloom.operators.aggregates import concat_rows
from watchloom.plans.registry import query
from watchloom.session import load


def chain_edges(spark, sf):
    """Every session waits for one other, each third one for a second one too."""
    key = F.col("c_custkey")
    e = load(spark, sf, "customer").select(key.alias("session_id"), F.explode(F.array(F.floor(key / 7), F.when(key % 3 == 0, F.floor(key / 5)))).alias("blocking_session_id"))
    e = e.where("blocking_session_id IS NOT NULL").withColumn("server", F.lit("a"))
    # the same sessions on another server wait for others
    return e.unionByName(e.select((F.col("session_id") + 1).alias("session_id"), "blocking_session_id", F.lit("b").alias("server")))


@query(
    "blocking_chain",
    """
    WITH RECURSIVE one AS (SELECT c_custkey AS s, c_custkey // 7 AS b FROM customer UNION SELECT c_custkey, c_custkey // 5 FROM customer WHERE c_custkey % 3 = 0),
    e AS (SELECT 'a' AS server, s, b FROM one UNION ALL SELECT 'b', s + 1, b FROM one),
    chain AS (
      SELECT server, s AS start_id, 0 AS level, s, b FROM e
      UNION SELECT e.server, c.start_id, c.level + 1, e.s, e.b FROM chain c JOIN e ON e.server = c.server AND e.s = c.b WHERE e.b <> 0),
    first AS (SELECT server, start_id, min(level) AS level, s, b FROM chain GROUP BY ALL)
    SELECT server, start_id, CAST(level AS INTEGER) AS level, s AS session_id, b AS blocking_session_id,
           EXISTS (SELECT 1 FROM first x WHERE x.server = first.server AND x.start_id = first.start_id AND x.s = first.b AND x.level <= first.level) AS closes_cycle
    FROM first
    """,
)
def q_blocking_chain(spark, sf):
    e = chain_edges(spark, sf)
    return G.chain_up(e, e.select("server", "session_id"), by=["server"])


def block_reports(spark, sf):
    return load(spark, sf, "events").groupBy(
        F.date_format("ts", "yyyy-MM-dd").alias("monitorloop"),
        (F.col("user_id") + 1).cast("int").alias("blocked_spid"),
        F.floor((F.col("user_id") + 1) / 2).cast("int").alias("blocking_spid"),
    ).agg(F.min("ts").alias("end_time")).withColumns({"blocked_ecid": F.lit(0), "blocking_ecid": F.lit(0)})


FOREST_SQL = """
r AS (SELECT strftime(ts, '%Y-%m-%d') AS monitorloop, CAST(user_id + 1 AS INTEGER) AS blocked, CAST((user_id + 1) // 2 AS INTEGER) AS blocking, min(ts) AS end_time
      FROM events GROUP BY 1, 2, 3),
heads AS (SELECT monitorloop, blocking AS spid FROM r EXCEPT SELECT monitorloop, blocked FROM r)
"""


@query("head_blockers", f"WITH {FOREST_SQL} SELECT monitorloop, spid AS blocking_spid, 0 AS blocking_ecid FROM heads")
def q_head_blockers(spark, sf):
    cols = [["blocked_spid", "blocked_ecid"], ["blocking_spid", "blocking_ecid"]]
    return G.heads(block_reports(spark, sf), *cols, ["monitorloop"])


@query(
    "blocking_forest",
    f"""
    WITH RECURSIVE {FOREST_SQL},
    tree AS (
      SELECT monitorloop, spid, 0 AS level, '/' || spid || '.0/' AS chain FROM heads
      UNION ALL SELECT r.monitorloop, r.blocked, t.level + 1, t.chain || r.blocked || '.0/' FROM tree t
        JOIN r ON r.monitorloop = t.monitorloop AND r.blocking = t.spid)
    SELECT t.monitorloop, t.spid, 0 AS ecid, CAST(level AS INTEGER) AS level, chain, repeat(' ', 4 * CAST(level AS INTEGER)) || t.spid AS blocking_tree,
           coalesce(strftime(r.end_time, '%Y-%m-%d %H:%M:%S'), 'Lead') AS trace_time
    FROM tree t LEFT JOIN r ON r.monitorloop = t.monitorloop AND r.blocked = t.spid
    """,
)
def q_blocking_forest(spark, sf):
    out = G.blocking_forest(block_reports(spark, sf))
    return out.select("monitorloop", "spid", "ecid", "level", "chain", "blocking_tree", "trace_time")


def fk_edges(spark, sf):
    """Two masters per part: its key divided by ten and by three."""
    p = F.col("p_partkey")
    return load(spark, sf, "part").select(
        F.explode(F.array(F.floor(p / 10), F.floor(p / 3))).alias("master"), p.alias("slave")
    )


FK_SQL = """
fk AS (SELECT DISTINCT master, slave FROM (SELECT p_partkey // 10 AS master, p_partkey AS slave FROM part
       UNION ALL SELECT p_partkey // 3, p_partkey FROM part) WHERE master <> slave)
"""


@query(
    "topo_levels",
    f"""
    WITH RECURSIVE {FK_SQL},
    lv AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey NOT IN (SELECT slave FROM fk)
           UNION SELECT fk.slave, lv.level + 1 FROM lv JOIN fk ON fk.master = lv.node)
    SELECT node, CAST(max(level) AS INTEGER) AS level, false AS in_cycle FROM lv GROUP BY node
    """,
)
def q_topo_levels(spark, sf):
    return G.topo_levels(fk_edges(spark, sf), load(spark, sf, "part").select("p_partkey"))


@query(
    "topo_cycles",
    """
    WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey AS master, (s_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS slave FROM supplier WHERE s_acctbal >= 0
                         UNION SELECT s_suppkey, s_suppkey // 3 FROM supplier),
    f AS (SELECT * FROM e WHERE master <> slave),
    back AS (SELECT slave AS node, master AS anc FROM f UNION SELECT b.node, f.master FROM back b JOIN f ON f.slave = b.anc),
    oncycle AS (SELECT DISTINCT node FROM back WHERE node = anc),
    bad AS (SELECT node FROM oncycle UNION SELECT node FROM back WHERE anc IN (SELECT node FROM oncycle)),
    lv AS (SELECT s_suppkey AS node, 0 AS level FROM supplier WHERE s_suppkey NOT IN (SELECT slave FROM f)
           UNION SELECT f.slave, lv.level + 1 FROM lv JOIN f ON f.master = lv.node WHERE f.slave NOT IN (SELECT node FROM bad))
    SELECT s_suppkey AS node, (SELECT CAST(max(level) AS INTEGER) FROM lv WHERE lv.node = s_suppkey) AS level,
           s_suppkey IN (SELECT node FROM bad) AS in_cycle FROM supplier
    """,
)
def q_topo_cycles(spark, sf):
    s = load(spark, sf, "supplier")
    n = s.agg(F.count(F.lit(1))).scalar()
    key = F.col("s_suppkey")
    slaves = F.explode(F.array(F.when(F.col("s_acctbal") >= 0, (key * 7 + 3) % n), F.floor(key / 3)))
    edges = s.select(key.alias("master"), slaves.alias("slave")).where("slave IS NOT NULL")
    return G.topo_levels(edges, s.select("s_suppkey"))


OBJECTS_SQL = """
obj AS (SELECT p_partkey AS object_id, p_name || '#' || p_partkey AS object_name, p_type AS object_type, p_partkey % 11 = 0 AS is_builtin
        FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'STANDARD', 'MEDIUM')),
dep AS (SELECT DISTINCT * FROM (SELECT p_partkey AS referencing, p_partkey // 10 AS referenced FROM part UNION ALL SELECT p_partkey, p_partkey // 3 FROM part) x
        WHERE referencing <> referenced AND referencing IN (SELECT object_id FROM obj) AND referenced IN (SELECT object_id FROM obj))
"""


def objects(spark, sf):
    key = F.col("p_partkey")
    return load(spark, sf, "part").select(
        key.alias("object_id"),
        F.concat_ws("#", "p_name", key.cast("string")).alias("object_name"),
        F.col("p_type").alias("object_type"),
        (key % 11 == 0).alias("is_builtin"),
    )


def object_edges(spark, sf):
    return fk_edges(spark, sf).select(F.col("slave").alias("referencing"), F.col("master").alias("referenced"))


@query(
    "dependency_levels",
    f"""
    WITH RECURSIVE {OBJECTS_SQL},
    lv AS (
      SELECT object_id, CASE WHEN is_builtin THEN 1 ELSE 0 END AS level FROM obj
      WHERE object_id NOT IN (SELECT referencing FROM dep) AND (NOT is_builtin OR object_id IN (SELECT referenced FROM dep))
      UNION SELECT dep.referencing, lv.level + 1 FROM lv JOIN dep ON dep.referenced = lv.object_id)
    SELECT object_id, object_name, object_type, CAST(max(level) AS INTEGER) AS dependency_level, false AS in_cycle
    FROM lv JOIN obj USING (object_id) GROUP BY ALL
    """,
)
def q_dependency_levels(spark, sf):
    return G.dependency_levels(object_edges(spark, sf), objects(spark, sf), ["ECONOMY", "SMALL", "STANDARD", "MEDIUM"])


@query(
    "dependent_objects",
    f"""
    WITH RECURSIVE {OBJECTS_SQL},
    c AS (SELECT referencing AS root, referenced AS node FROM dep UNION SELECT c.root, dep.referenced FROM c JOIN dep ON dep.referencing = c.node),
    n AS (SELECT root, node, (row_number() OVER (PARTITION BY root ORDER BY node) + 99) // 100 AS chunk_no FROM c)
    SELECT root AS object_id, chunk_no, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS dependent_objects FROM n GROUP BY root, chunk_no
    """,
)
def q_dependent_objects(spark, sf):
    ids = objects(spark, sf).where(F.col("object_type").isin("ECONOMY", "SMALL", "STANDARD", "MEDIUM")).select("object_id")
    e = object_edges(spark, sf).where("referencing <> referenced")
    for side in ("referencing", "referenced"):
        e = e.join(ids.withColumnRenamed("object_id", side), side, "left_semi")
    pairs = G.closure_pairs(e.select(F.col("referencing").alias("src"), F.col("referenced").alias("dst")), ids)
    pairs = pairs.select(F.col("root").alias("object_id"), "node", F.col("node").cast("string").alias("t"))
    return concat_rows(pairs, ["object_id"], "t", ",", ["node"], "dependent_objects", rows_per_chunk=100)


@query(
    "dependency_closure",
    """
    WITH RECURSIVE items AS (
      SELECT p.p_partkey AS item_id, p.p_name || (p.p_partkey % 40) AS item_name, p.p_size || '.0' AS item_version,
             d.p_name || (d.p_partkey % 40) AS dep_name
      FROM part p JOIN part d ON d.p_partkey = p.p_partkey // 10),
    best AS (SELECT item_name, item_id FROM items QUALIFY row_number() OVER (PARTITION BY item_name ORDER BY item_version DESC, item_id DESC) = 1),
    e AS (SELECT i.item_id AS src, b.item_id AS dst FROM items i JOIN best b ON b.item_name = i.dep_name),
    c AS (SELECT item_id AS root, item_id AS node FROM items UNION SELECT c.root, e.dst FROM c JOIN e ON e.src = c.node)
    SELECT root, node FROM c
    """,
)
def q_dependency_closure(spark, sf):
    part = load(spark, sf, "part")

    def name(p):
        return F.concat(F.col(f"{p}p_name"), (F.col(f"{p}p_partkey") % 40).cast("string"))

    d = part.select(F.col("p_partkey").alias("dep_key"), name("").alias("dep_name"))
    items = part.withColumn("dep_key", F.floor(F.col("p_partkey") / 10)).join(d, "dep_key")
    items = items.select(
        F.col("p_partkey").alias("item_id"),
        name("").alias("item_name"),
        F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("item_version"),
        F.lit("pub").alias("publisher_name"),
        F.col("p_partkey").alias("update_date"),
        F.array(F.struct(F.col("dep_name").alias("name"), F.lit("").alias("version"))).alias("depends_on"),
    )
    return G.dependency_closure(items, items.select("item_id")).select("root", "node")


@query(
    "collapse_chain",
    """
    WITH RECURSIVE s AS (SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 5 = 0 THEN o_orderkey - 100
                                WHEN o_orderkey % 7 = 0 THEN o_orderkey - 50 END AS record_ref, o_orderstatus AS status FROM orders),
    up AS (SELECT record_id, record_ref FROM s WHERE record_id % 13 <> 0 AND record_ref IN (SELECT record_id FROM s)),
    t AS (SELECT record_id, record_id AS top, 0 AS level FROM s WHERE record_id NOT IN (SELECT record_id FROM up)
          UNION ALL SELECT up.record_id, t.top, t.level + 1 FROM t JOIN up ON up.record_ref = t.record_id),
    last AS (SELECT top, record_id AS best FROM t QUALIFY row_number() OVER (PARTITION BY top ORDER BY level DESC, record_id DESC) = 1),
    f AS (SELECT t.record_id, CASE WHEN best <> t.record_id THEN best END AS replaced_by FROM t JOIN last USING (top))
    SELECT s.record_id, s.record_ref, CASE WHEN f.replaced_by IS NOT NULL THEN 'CANCELED' ELSE s.status END AS status, f.replaced_by
    FROM s LEFT JOIN f USING (record_id)
    """,
)
def q_collapse_chain(spark, sf):
    key = F.col("o_orderkey")
    log = load(spark, sf, "orders").select(
        key.alias("record_id"),
        F.when((key % 11 == 0) | (key % 5 == 0), key - 100).when(key % 7 == 0, key - 50).alias("record_ref"),
        F.col("o_orderstatus").alias("status"),
    )
    return G.collapse_chain(log, "record_id", "record_ref", usable=F.col("record_id") % 13 != 0)


@query(
    "escalation",
    """
    WITH RECURSIVE g AS (SELECT DISTINCT l_suppkey AS grantor, (l_suppkey * 7 + 3) % (SELECT count(*) FROM supplier) AS grantee FROM lineitem),
    c AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 0 UNION SELECT g.grantee FROM c JOIN g ON g.grantor = c.node)
    SELECT node, s_name FROM c JOIN supplier ON s_suppkey = node
    """,
)
def q_escalation(spark, sf):
    s = load(spark, sf, "supplier")
    n = s.agg(F.count(F.lit(1))).scalar()
    grants = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("grantor")).distinct()
    grants = grants.withColumn("grantee", (F.col("grantor") * 7 + 3) % n)
    out = G.reachable_to(grants, s.where("s_acctbal < 0").select("s_suppkey"), src="grantee", dst="grantor")
    return out.join(s.select(F.col("s_suppkey").alias("node"), "s_name"), "node")


@query(
    "affected_tables",
    f"""
    WITH RECURSIVE {FK_SQL},
    c AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey = 3 UNION SELECT fk.slave, c.level + 1 FROM c JOIN fk ON fk.master = c.node)
    SELECT node, CAST(min(level) AS INTEGER) AS level FROM c GROUP BY node
    """,
)
def q_affected_tables(spark, sf):
    root = load(spark, sf, "part").where("p_partkey = 3").select("p_partkey")
    return G.affected_by(fk_edges(spark, sf), root)


@query(
    "clear_plan",
    f"""
    WITH RECURSIVE {FK_SQL},
    c AS (SELECT p_partkey AS node, 0 AS level FROM part WHERE p_partkey = 3 UNION SELECT fk.slave, c.level + 1 FROM c JOIN fk ON fk.master = c.node),
    n AS (SELECT node, CAST(min(level) AS INTEGER) AS level FROM c GROUP BY node),
    k AS (SELECT master, slave FROM fk WHERE master IN (SELECT node FROM n))
    SELECT 1 AS step, 'DETACH' AS action, slave AS object, master AS parent, 0 AS level FROM k
    UNION ALL SELECT 2, 'CLEAR', node, NULL, level FROM n
    UNION ALL SELECT 3, 'ATTACH', slave, master, 0 FROM k
    """,
)
def q_clear_plan(spark, sf):
    return G.clear_plan(fk_edges(spark, sf), load(spark, sf, "part").where("p_partkey = 3").select("p_partkey"))


@query(
    "tree_paths",
    """
    WITH RECURSIVE t AS (SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 97 = 0 THEN p_partkey WHEN p_partkey % 50 = 1 THEN -1
                                WHEN p_partkey >= 4 THEN p_partkey // 4 END AS parent FROM part),
    p AS (SELECT id, name || '/' AS path, 1 AS depth, CASE WHEN parent IS NULL THEN 'rooted' ELSE 'dangling' END AS placed
          FROM t WHERE parent IS NULL OR parent NOT IN (SELECT id FROM t)
          UNION ALL SELECT t.id, p.path || t.name || '/', p.depth + 1, p.placed FROM t JOIN p ON t.parent = p.id)
    SELECT t.id, path, CAST(depth AS INTEGER) AS depth, coalesce(placed, 'cycle') AS placed FROM t LEFT JOIN p USING (id)
    """,
)
def q_tree_paths(spark, sf):
    key = F.col("p_partkey")
    parent = F.when(key % 97 == 0, key).when(key % 50 == 1, F.lit(-1)).when(key >= 4, F.floor(key / 4))
    t = load(spark, sf, "part").select(key.alias("id"), parent.alias("parent"), F.col("p_name").alias("name"))
    return G.tree_paths(t, "id", "parent", "name")
