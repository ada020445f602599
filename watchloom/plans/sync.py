"""Synchronisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions.numbers import fingerprint
from watchloom.functions.text import has_any_tag
from watchloom.functions.times import ntz
from watchloom.operators import sync as S
from watchloom.plans.adapters import ORDERS_AS_OF
from watchloom.plans.registry import ORACLES, query
from watchloom.session import load, scratch_path
from watchloom.sources.items import ingest_items
from watchloom.sources.store import create_table, publish_merge, read_table


def publisher_items(spark, sf):
    part = load(spark, sf, "part")
    return part.select(
        F.col("p_partkey").alias("item_id"),
        F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("item_name"),
        F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("item_version"),
        F.concat_ws(",", "p_brand", "p_type").alias("tags"),
        F.md5(F.concat_ws("|", "p_name", F.col("p_size").cast("string")).cast("binary")).alias("checksum"),
        F.col("p_partkey").alias("row_version"),
    )


def subscriber_items(spark, sf):
    """Items not divisible by five; every seventh is out of date, every third from elsewhere,
    plus items the publisher no longer has."""
    items = publisher_items(spark, sf)
    key = F.col("item_id")
    base = items.where(key % 5 != 0).withColumn("checksum", F.when(key % 7 == 0, "old").otherwise(F.col("checksum")))
    extra = items.where(key % 4 == 0).withColumn("item_id", -key - 1)
    both = base.unionByName(extra)
    publisher = F.when(F.col("item_id") % 3 == 1, "PUB2").otherwise("PUB1")
    return both.select("*", publisher.alias("publisher_name"), F.lit("SUCCEED").alias("execution_result"))


SYNC_SQL = """
pub AS (SELECT p_partkey AS item_id, p_name || '#' || p_partkey AS item_name, p_size || '.0' AS item_version, p_brand AS b, p_type AS t,
               p_brand || ',' || p_type AS tags, md5(p_name || '|' || p_size) AS checksum, p_partkey AS row_version FROM part),
sub0 AS (SELECT * REPLACE (CASE WHEN item_id % 7 = 0 THEN 'old' ELSE checksum END AS checksum) FROM pub WHERE item_id % 5 <> 0
         UNION ALL SELECT * REPLACE (-item_id - 1 AS item_id) FROM pub WHERE item_id % 4 = 0),
sub AS (SELECT *, CASE WHEN item_id % 3 = 1 THEN 'PUB2' ELSE 'PUB1' END AS publisher_name FROM sub0),
offered AS (SELECT * FROM pub WHERE b IN ('Brand#1', 'Brand#12', 'Brand#7') OR t IN ('SMALL')),
res AS (
  SELECT o.item_id, o.item_name, o.tags, o.checksum, 'PUB1' AS publisher_name, 'NOT EXECUTED' AS execution_result,
         CASE WHEN s.item_id IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS action
  FROM offered o LEFT JOIN (SELECT * FROM sub WHERE publisher_name = 'PUB1') s USING (item_id)
  WHERE s.item_id IS NULL OR s.checksum <> o.checksum OR s.row_version <> o.row_version
  UNION ALL
  SELECT s.item_id, s.item_name, s.tags, s.checksum, s.publisher_name, 'SUCCEED',
         CASE WHEN s.publisher_name = 'PUB1' AND o.item_id IS NULL AND (s.b IN ('Brand#1', 'Brand#12', 'Brand#7') OR s.t IN ('SMALL')) THEN 'DELETE' ELSE 'KEEP' END
  FROM sub s LEFT JOIN offered o USING (item_id)
  WHERE s.publisher_name = 'PUB2' OR o.item_id IS NULL OR NOT (s.checksum <> o.checksum OR s.row_version <> o.row_version))
"""

TAGS = ["Brand#1", "Brand#12", "", "Brand#7", "SMALL"]


def synced(spark, sf):
    return S.sync_items(subscriber_items(spark, sf), publisher_items(spark, sf), "PUB1", TAGS)


@query(
    "sync_items",
    f"WITH {SYNC_SQL} SELECT item_id, item_name, tags, checksum, publisher_name, execution_result FROM res WHERE action <> 'DELETE'",
)
def q_sync_items(spark, sf):
    return synced(spark, sf).where("action <> 'DELETE'").select(
        "item_id", "item_name", "tags", "checksum", "publisher_name", "execution_result"
    )


def stored(spark, target, batch, keys, merge, also=None):
    """``target`` published as a table of a few ranges, merged with ``batch`` twice, read back."""
    path = scratch_path(spark, "stored")
    create_table(target, path, keys, max(1, target.count() // 8))
    for _ in range(2):
        publish_merge(spark, path, batch, merge, also)
    return read_table(spark, path)


@query("stored_sync", ORACLES["sync_items"])
def q_stored_sync(spark, sf):
    wanted = has_any_tag(F.col("tags"), TAGS) & (F.col("publisher_name") == "PUB1")
    offered = publisher_items(spark, sf).where(has_any_tag(F.col("tags"), TAGS))

    def merge(target, source):
        return S.sync_items(target, source, "PUB1", TAGS).where("action <> 'DELETE'").drop("action")

    out = stored(spark, subscriber_items(spark, sf), offered, ["item_id"], merge, wanted)
    return out.select("item_id", "item_name", "tags", "checksum", "publisher_name", "execution_result")


@query("sync_actions", f"WITH {SYNC_SQL} SELECT action, publisher_name, count(*) AS items FROM res GROUP BY action, publisher_name")
def q_sync_actions(spark, sf):
    return synced(spark, sf).groupBy("action", "publisher_name").agg(F.count(F.lit(1)).alias("items"))


@query(
    "watermarks",
    """
    SELECT 'customer' AS table_name, (SELECT max(c_custkey) FROM customer) AS last_version, 0 AS table_order, TIMESTAMP '2001-12-01' AS updated
    UNION ALL SELECT 'orders', (SELECT max(o_orderkey) FROM orders), 1, TIMESTAMP '2001-12-01'
    UNION ALL SELECT 'lineitem', 10 * (SELECT max(l_orderkey) FROM lineitem), 2, TIMESTAMP '2001-12-01'
    UNION ALL SELECT 'retired', 42, 9, TIMESTAMP '2001-11-01'
    """,
)
def q_watermarks(spark, sf):
    orders, lines = load(spark, sf, "orders"), load(spark, sf, "lineitem")
    # the old marks: halfway through orders, already beyond every line item
    marks = (
        orders.agg(F.floor(F.max("o_orderkey") / 2).alias("v")).select(F.lit("orders").alias("table_name"), F.col("v").alias("last_version"))
        .unionByName(lines.agg((F.max("l_orderkey") * 10).alias("v")).select(F.lit("lineitem").alias("table_name"), F.col("v").alias("last_version")))
        .unionByName(spark.range(1).select(F.lit("retired").alias("table_name"), F.lit(42).cast("long").alias("last_version")))
        .withColumns({
            "table_order": F.when(F.col("table_name") == "retired", 9).otherwise(2),
            "updated": ntz("2001-11-01"),
        })
    )
    tables = {
        "customer": (load(spark, sf, "customer"), "c_custkey", 0),
        "orders": (orders, "o_orderkey", 1),
        "lineitem": (lines, "l_orderkey", 2),
    }
    return S.update_watermarks(marks, tables, ORDERS_AS_OF)


@query(
    "incremental_pull",
    """
    WITH mark AS (SELECT max(o_orderkey) AS id FROM orders WHERE o_orderkey % 4 = 0 AND o_orderdate < TIMESTAMP '1995-02-01')
    SELECT o_orderkey, o_orderpriority FROM orders, mark
    WHERE o_orderkey > mark.id AND o_custkey > 100 AND o_orderpriority IN ('1-URGENT', '2-HIGH')
    """,
)
def q_incremental_pull(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderdate")
    local = o.where("o_orderkey % 4 = 0 AND o_orderdate < '1995-02-01'").withColumn("o_custkey", F.lit(100).cast("long"))
    out = S.incremental_pull(o, local, ["1-URGENT", "", "2-HIGH"], "o_orderkey", "o_custkey", "o_orderpriority")
    return out.select("o_orderkey", "o_orderpriority")


@query(
    "publish_items",
    """
    WITH target AS (
      SELECT p_name || '#' || (p_partkey // 3) AS item_name, p_partkey % 3 || '.0' AS item_version, p_type AS item_type, p_brand AS tags,
             TIMESTAMP '2001-01-01' AS create_date, TIMESTAMP '2001-01-01' AS update_date FROM part WHERE p_partkey % 2 = 0),
    inc0 AS (
      SELECT p_name || '#' || (p_partkey // 3) AS item_name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 3 || '.0' END AS asked,
             CASE WHEN p_size % 2 = 0 THEN 'NEWTYPE' END AS item_type, CASE WHEN p_size % 3 = 0 THEN 'NEWTAG' END AS tags
      FROM part WHERE p_partkey % 3 = 2),
    inc AS (SELECT i.item_name, coalesce(asked, (SELECT max(item_version) FROM target t WHERE t.item_name = i.item_name), '1.0') AS item_version, item_type, tags FROM inc0 i)
    SELECT coalesce(i.item_name, t.item_name) AS item_name, coalesce(i.item_version, t.item_version) AS item_version,
           coalesce(i.item_type, t.item_type) AS item_type, coalesce(i.tags, t.tags, 'TSX') AS tags,
           coalesce(t.create_date, TIMESTAMP '2001-12-01') AS create_date,
           CASE WHEN i.item_name IS NOT NULL THEN TIMESTAMP '2001-12-01' ELSE t.update_date END AS update_date
    FROM target t FULL JOIN inc i ON t.item_name = i.item_name AND t.item_version = i.item_version
    """,
)
def q_publish_items(spark, sf):
    return S.publish_items(*publishing(spark, sf), ORDERS_AS_OF)


@query("stored_publish", ORACLES["publish_items"])
def q_stored_publish(spark, sf):
    # All versions of an item lie in one range, so the latest one is found there.
    return stored(spark, *publishing(spark, sf), ["item_name"], lambda target, asked: S.publish_items(target, asked, ORDERS_AS_OF))


def publishing(spark, sf):
    key = F.col("p_partkey")
    part = load(spark, sf, "part")
    name = F.concat(F.col("p_name"), F.lit("#"), F.floor(key / 3).cast("string")).alias("item_name")
    version = F.concat((key % 3).cast("string"), F.lit(".0"))
    old = ntz("2001-01-01")
    target = part.where("p_partkey % 2 = 0").select(
        name, version.alias("item_version"), F.col("p_type").alias("item_type"), F.col("p_brand").alias("tags"),
        old.alias("create_date"), old.alias("update_date"),
    )
    incoming = part.where("p_partkey % 3 = 2").select(
        name,
        F.when(key % 5 != 0, version).alias("item_version"),
        F.when(F.col("p_size") % 2 == 0, "NEWTYPE").alias("item_type"),
        F.when(F.col("p_size") % 3 == 0, "NEWTAG").alias("tags"),
    )
    return target, incoming


@query(
    "soft_delete",
    """
    SELECT p_partkey, NOT (p_brand IN ('Brand#3', 'Brand#4')) AS is_enabled,
           CASE WHEN p_brand IN ('Brand#3', 'Brand#4') THEN TIMESTAMP '2001-12-01' ELSE TIMESTAMP '2001-01-01' END AS update_date
    FROM part
    """,
)
def q_soft_delete(spark, sf):
    part = load(spark, sf, "part").select("p_partkey", "p_brand")
    target = part.select("p_partkey", F.lit(True).alias("is_enabled"), ntz("2001-01-01").alias("update_date"))
    return S.soft_delete(target, part.where(F.col("p_brand").isin("Brand#3", "Brand#4")), ["p_partkey"], ORDERS_AS_OF)


@query("stored_soft_delete", ORACLES["soft_delete"])
def q_stored_soft_delete(spark, sf):
    part = load(spark, sf, "part").select("p_partkey", "p_brand")
    target = part.select("p_partkey", F.lit(True).alias("is_enabled"), ntz("2001-01-01").alias("update_date"))
    gone = part.where(F.col("p_brand").isin("Brand#3", "Brand#4"))
    return stored(spark, target, gone, ["p_partkey"], lambda t, g: S.soft_delete(t, g, ["p_partkey"], ORDERS_AS_OF))


DRIFT_SQL = """
lg AS (SELECT o_custkey AS database, o_orderkey AS record_id, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey - 100 END AS record_ref,
              o_orderdate < TIMESTAMP '2001-06-01' AS applied, o_orderkey % 13 <> 0 AS usable FROM orders),
decl AS (SELECT c_custkey AS database, max(o_orderkey) + CASE WHEN c_custkey % 3 = 1 THEN 5 ELSE 0 END AS version
         FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderkey % 13 <> 0 AND (c_custkey % 3 < 2 OR o_orderkey % 4 = 0)
         WHERE c_custkey % 10 <> 0 GROUP BY c_custkey),
gap AS (SELECT database, min(record_id) AS gap FROM lg WHERE usable AND NOT applied GROUP BY database),
st AS (SELECT lg.database, max(record_id) FILTER (usable AND applied AND (gap IS NULL OR record_id < gap)) AS contiguous_version,
              max(record_id) FILTER (usable AND applied) AS max_version,
              max(CASE WHEN record_id = version THEN 1 ELSE 0 END) = 1 AS has_base
       FROM lg LEFT JOIN gap USING (database) LEFT JOIN decl USING (database) GROUP BY lg.database),
drift AS (SELECT database, version, contiguous_version, max_version,
            CASE WHEN version IS NULL AND max_version IS NOT NULL THEN 'MISSING_DECLARATION' WHEN version IS NULL THEN 'NOT_PARTICIPATING'
                 WHEN version = contiguous_version THEN 'IN_SYNC' WHEN contiguous_version IS NULL OR version > contiguous_version THEN 'AHEAD' ELSE 'BEHIND' END AS state,
            coalesce(has_base, false) AS has_base
          FROM decl FULL JOIN st USING (database))
"""


def drift_inputs(spark, sf):
    """Late records are not applied; declared versions run ahead, level or behind by customer."""
    o = load(spark, sf, "orders")
    key = F.col("o_orderkey")
    log = o.select(
        F.col("o_custkey").alias("database"),
        key.alias("record_id"),
        F.when(key % 11 == 0, key - 100).alias("record_ref"),
        F.when(F.col("o_orderdate") < "2001-06-01", "SUCCEED").alias("status"),
        (key % 13 != 0).alias("is_usable"),
    )
    kept = o.where((key % 13 != 0) & ((F.col("o_custkey") % 3 < 2) | (key % 4 == 0)) & (F.col("o_custkey") % 10 != 0))
    ahead = F.when(F.col("o_custkey") % 3 == 1, 5).otherwise(0)
    declared = kept.groupBy("o_custkey").agg(F.max(key).alias("m")).select(
        F.col("o_custkey").alias("database"), (F.col("m") + ahead).alias("version")
    )
    return log, declared


@query("version_drift", f"WITH {DRIFT_SQL} SELECT * FROM drift")
def q_version_drift(spark, sf):
    return S.version_drift(*drift_inputs(spark, sf))


@query(
    "checksum_drift",
    """
    WITH i AS (SELECT p_partkey, md5('v' || p_name || chr(1) || 'v' || p_type) AS stored,
                      md5('v' || p_name || CASE WHEN p_partkey % 7 = 0 THEN ' -- edited' ELSE '' END || chr(1) || 'v' || p_type) AS computed FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'MISSING' WHEN stored = computed THEN 'MATCH' ELSE 'CHANGED' END AS state,
           p_partkey % 2 = 0 AND p_partkey % 11 <> 0 AND stored = computed AS may_run FROM i
    """,
)
def q_checksum_drift(spark, sf):
    key = F.col("p_partkey")
    items = load(spark, sf, "part").withColumn("checksum", F.when(key % 11 != 0, fingerprint("p_name", "p_type")))
    items = items.withColumn("p_name", F.concat("p_name", F.when(key % 7 == 0, " -- edited").otherwise("")))
    return S.checksum_drift(items, "checksum", ["p_name", "p_type"], key % 2 == 0).select("p_partkey", "state", "may_run")


@query(
    "drift_actions",
    f"""
    WITH {DRIFT_SQL}, stop AS (SELECT count(*) AS n FROM drift WHERE state = 'BEHIND' AND NOT has_base)
    SELECT database, record_id, CASE WHEN state = 'AHEAD' THEN 'CANCEL' ELSE 'REPLAY' END AS action
    FROM lg JOIN drift USING (database), stop WHERE usable AND (
      (state = 'AHEAD' AND (contiguous_version IS NULL OR record_id > contiguous_version) AND record_id <= version)
      OR (state = 'BEHIND' AND n = 0 AND record_id > version AND record_id <= max_version AND (record_ref IS NULL OR record_ref > version)))
    """,
)
def q_drift_actions(spark, sf):
    log, declared = drift_inputs(spark, sf)
    return S.drift_actions(log, S.version_drift(log, declared))


@query(
    "ledger_upsert",
    """
    WITH led AS (SELECT DISTINCT l_orderkey AS media_set_id, l_linenumber AS family, 'NONE' AS transfer_status FROM lineitem WHERE l_orderkey % 3 <> 0),
    bat AS (SELECT DISTINCT l_orderkey AS media_set_id, l_linenumber AS family, 'COPIED' AS transfer_status FROM lineitem WHERE l_orderkey % 2 = 0)
    SELECT media_set_id, family, coalesce(b.transfer_status, l.transfer_status) AS transfer_status FROM led l FULL JOIN bat b USING (media_set_id, family)
    """,
)
def q_ledger_upsert(spark, sf):
    return S.upsert(*ledgers(spark, sf), ["media_set_id", "family"])


@query("stored_ledger", ORACLES["ledger_upsert"])
def q_stored_ledger(spark, sf):
    keys = ["media_set_id", "family"]
    return stored(spark, *ledgers(spark, sf), keys, lambda ledger, batch: S.upsert(ledger, batch, keys))


def ledgers(spark, sf):
    keys = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("media_set_id"), F.col("l_linenumber").alias("family")).distinct()
    ledger = keys.where("media_set_id % 3 <> 0").withColumn("transfer_status", F.lit("NONE"))
    batch = keys.where("media_set_id % 2 = 0").withColumn("transfer_status", F.lit("COPIED"))
    return ledger, batch


@query(
    "item_ingest",
    """
    SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS total_bytes, 'TEXT' AS item_type, true AS is_enabled FROM documents GROUP BY source
    """,
)
def q_item_ingest(spark, sf):
    path = scratch_path(spark, "items")
    docs = load(spark, sf, "documents").select("source", "text")
    docs.write.option("maxRecordsPerFile", 5000).partitionBy("source").text(path)
    items = ingest_items(spark, f"{path}/source=*", {"item_type": "TEXT"})
    # the folder of a file names its source
    files = items.withColumns({"source": F.regexp_extract("path", "source=([^/]*)/", 1), "bytes": F.octet_length("item_content")})
    return files.groupBy("source", "item_type", "is_enabled").agg(F.sum("bytes").cast("long").alias("total_bytes"))
