"""Text queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from watchloom.functions.numbers import fingerprint
from watchloom.functions.text import (
    code_label,
    extent_pages,
    extract_log_fields,
    extract_matches,
    extract_refs,
    file_extension,
    file_name,
    folder_name,
    render_template,
    split_rows,
    strip_chars,
)
from watchloom.functions.calendar import add_time_flags
from watchloom.operators.aggregates import concat_rows, group_incidents
from watchloom.plans.registry import query
from watchloom.session import load, scratch_path
from watchloom.sources.textlog import read_text_log

# The restore-log adapter: signups become restore lines, everything else noise.
LOGLINES_SQL = """
log AS (
  SELECT date_trunc('second', ts) AS log_date, CASE WHEN event_type = 'signup' THEN 'Backup' ELSE 'spid' || user_id END AS process,
         CASE WHEN event_type = 'signup'
              THEN 'Log was restored. Database: db' || user_id || ', creation date(time): 2024/01/01, dump id ' || event_id || ', device {X:\\b\\LOG_db' || user_id || '_' || strftime(ts, '%Y_%m_%d') || '.trn}'
              ELSE 'Noise about ' || event_type || ' ' || event_id END AS text
  FROM events)
"""


def loglines(spark, sf):
    uid, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    restored = F.concat(
        F.lit("Log was restored. Database: db"), uid, F.lit(", creation date(time): 2024/01/01, dump id "), eid,
        F.lit(", device {X:\\b\\LOG_db"), uid, F.lit("_"), F.date_format("ts", "yyyy_MM_dd"), F.lit(".trn}"),
    )
    is_restore = F.col("event_type") == "signup"
    return load(spark, sf, "events").select(
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("log_date"),
        F.when(is_restore, "Backup").otherwise(F.concat(F.lit("spid"), uid)).alias("process"),
        F.when(is_restore, restored).otherwise(F.concat(F.lit("Noise about "), F.col("event_type"), F.lit(" "), eid)).alias("text"),
    )


RESTORE_FIELDS = {
    "database_name": r"^[^:]*:([^,]*),",
    "restore_address": r"(\{[^}]*)\}",
    "restore_date": r"_(2024_[0-9]{2}_[0-9]{2})",
}


@query(
    "text_log",
    f"""
    WITH {LOGLINES_SQL}
    SELECT log_date, process, text FROM log
    WHERE log_date BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND process = 'Backup'
    """,
)
def q_text_log(spark, sf):
    path = scratch_path(spark, "log")
    line = F.concat_ws(" ", F.date_format("log_date", "yyyy-MM-dd HH:mm:ss.SS"), F.rpad("process", 10, " "), "text")
    loglines(spark, sf).select(line.alias("value")).write.text(path)
    return read_text_log(path, spark, "process = 'Backup'", datetime(2024, 1, 5), datetime(2024, 1, 20))


@query(
    "log_fields",
    f"""
    WITH {LOGLINES_SQL}
    SELECT log_date, trim(regexp_extract(text, '^[^:]*:([^,]*),', 1)) AS database_name,
           regexp_extract(text, '(\\{{[^}}]*)\\}}', 1) AS restore_address, regexp_extract(text, '_(2024_[0-9]{{2}}_[0-9]{{2}})', 1) AS restore_date
    FROM log WHERE process = 'Backup' AND text LIKE 'Log was restored.%'
    """,
)
def q_log_fields(spark, sf):
    log = loglines(spark, sf).where((F.col("process") == "Backup") & F.col("text").startswith("Log was restored."))
    return extract_log_fields(log, RESTORE_FIELDS).drop("text", "process")


@query(
    "strip_chars",
    """
    SELECT doc_id, regexp_replace(text, '[^a-z0-9]', '', 'gi') AS stripped,
           CAST(length(text) - length(regexp_replace(text, '[^a-z0-9]', '', 'gi')) AS INTEGER) AS removed
    FROM documents
    """,
)
def q_strip_chars(spark, sf):
    return strip_chars(load(spark, sf, "documents").select("doc_id", "text"), "text", "^a-z0-9").drop("text")


@query(
    "split_rows",
    """
    SELECT doc_id, unnest(string_split(text, '. ')) AS parameter, CAST(generate_subscripts(string_split(text, '. '), 1) AS INTEGER) AS position
    FROM documents
    """,
)
def q_split_rows(spark, sf):
    return split_rows(load(spark, sf, "documents").select("doc_id", "text"), "text", ". ").drop("text")


@query(
    "concat_rows",
    """
    SELECT p_brand, string_agg(p_name || '#' || p_partkey, '; ' ORDER BY p_partkey) AS names FROM part GROUP BY p_brand
    """,
)
def q_concat_rows(spark, sf):
    part = load(spark, sf, "part").select("p_brand", "p_partkey", F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("n"))
    return concat_rows(part, ["p_brand"], "n", "; ", ["p_partkey"], "names")


@query(
    "concat_chunks",
    """
    WITH n AS (
      SELECT o_orderpriority, o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) + 99) // 100 AS chunk_no FROM orders)
    SELECT o_orderpriority, chunk_no, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_keys
    FROM n GROUP BY o_orderpriority, chunk_no
    """,
)
def q_concat_chunks(spark, sf):
    o = load(spark, sf, "orders").select("o_orderpriority", "o_orderkey", F.col("o_orderkey").cast("string").alias("k"))
    return concat_rows(o, ["o_orderpriority"], "k", ",", ["o_orderkey"], "order_keys", rows_per_chunk=100)


@query(
    "extract_links",
    """
    WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a[^>]+href="([^"]*)"', 1)) AS href,
                      generate_subscripts(regexp_extract_all(html, '<a[^>]+href="([^"]*)"', 1), 1) - 1 AS n FROM pages)
    SELECT page_id, CAST(n AS INTEGER) AS ref_no, href FROM l
    """,
)
def q_extract_links(spark, sf):
    pages = load(spark, sf, "pages").select("page_id", "html")
    return extract_matches(pages, "html", '<a[^>]+href="([^"]*)"', "href").drop("html")


@query(
    "extract_refs",
    """
    WITH b AS (
      SELECT p_partkey, unnest(['using module .\\lib\\' || p_name || '.psm1' || chr(13), 'echo ' || p_type,
                                CASE WHEN p_size % 2 = 0 THEN 'Using Module C:\\m\\' || p_brand ELSE 'return' END]) AS line
      FROM part)
    SELECT p_partkey, replace(regexp_extract(line, '.*\\\\(.*)$', 1, 's'), chr(13), '') AS ref_name FROM b WHERE line ILIKE '%using module%'
    """,
)
def q_extract_refs(spark, sf):
    lines = [
        F.concat(F.lit("using module .\\lib\\"), F.col("p_name"), F.lit(".psm1\r")),
        F.concat(F.lit("echo "), F.col("p_type")),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Using Module C:\\m\\"), F.col("p_brand"))).otherwise("return"),
    ]
    body = load(spark, sf, "part").select("p_partkey", F.concat_ws("\n", *lines).alias("content"))
    return extract_refs(body, "content", "using module", r"(?s).*\\(.*)$").drop("content")


@query(
    "extent_ranges",
    """
    SELECT l_suppkey, CAST(sum(CASE WHEN l_linenumber % 2 = 0 THEN 8 ELSE CAST(l_quantity AS BIGINT) * 8 + 8 END) * 8 AS BIGINT) AS changed_kb
    FROM lineitem GROUP BY l_suppkey
    """,
)
def q_extent_ranges(spark, sf):
    first = (F.col("l_linenumber") * 8).cast("string")
    last = (F.col("l_linenumber") * 8 + F.col("l_quantity").cast("long") * 8).cast("string")
    one = F.concat(F.lit("(1:"), first, F.lit(")"))
    text = F.when(F.col("l_linenumber") % 2 == 0, one).otherwise(F.concat(one, F.lit(" - (1:"), last, F.lit(")")))
    ext = load(spark, sf, "lineitem").select("l_suppkey", text.alias("field"))
    return ext.groupBy("l_suppkey").agg((F.sum(extent_pages("field")) * 8).alias("changed_kb"))


TEMPLATE_VARS = [
    "BACKUP_TYPE", "DBNAME", "FILE_EXTENSION", "FILE_NAME", "GR_YEAR_NUM", "GR_MONTH_NUM", "GR_DAYOFMONTH_NUM",
    "JL_DATE", "SERVER_NAME", "NO_SUCH_SOURCE",
]


@query(
    "render_paths",
    """
    SELECT o_orderkey, 'D:/' || o_orderpriority || '/' || strftime(o_orderdate, '%Y') || '_' || strftime(o_orderdate, '%m') || '/'
           || strftime(o_orderdate, '%d') || '/' || o_orderstatus || '_db' || o_custkey || '_o' || o_orderkey || '.bak.bak__{%UNREGISTERED%}' AS path
    FROM orders
    """,
)
def q_render_paths(spark, sf):
    used = ["GR_YEAR_NUM", "GR_MONTH_NUM", "GR_DAYOFMONTH_NUM", "JL_DATE"]
    source = F.concat(F.lit("x:\\in\\o"), F.col("o_orderkey").cast("string"), F.lit(".bak"))
    values = {
        "BACKUP_TYPE": F.col("o_orderstatus"),
        "DBNAME": F.concat(F.lit("db"), F.col("o_custkey").cast("string")),
        "SERVER_NAME": F.col("o_orderpriority"),
        "FILE_NAME": file_name(source),
        "FILE_EXTENSION": file_extension(source),
        **{n: F.col(n.lower()) for n in used},
    }
    template = (
        "D:/{%SERVER_NAME%}/{%GR_YEAR_NUM%}_{%GR_MONTH_NUM%}/{%GR_DAYOFMONTH_NUM%}/"
        "{%BACKUP_TYPE%}_{%DBNAME%}_{%FILE_NAME%}.{%FILE_EXTENSION%}_{%NO_SUCH_SOURCE%}_{%UNREGISTERED%}"
    )
    orders = add_time_flags(load(spark, sf, "orders").withColumn("template", F.lit(template)), "o_orderdate", used)
    return render_template(orders, "template", values, TEMPLATE_VARS, "path").select("o_orderkey", "path")


@query(
    "code_labels",
    """
    SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'Returned' WHEN 'A' THEN 'Accepted' ELSE 'Other' END AS flag_label,
           l_orderkey || '_' || l_linenumber || '.bak' AS file_name, 'D:\\b\\' AS folder
    FROM lineitem
    """,
)
def q_code_labels(spark, sf):
    path = F.concat(F.lit("D:\\b\\"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(".bak"))
    return load(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        code_label("l_returnflag", {"R": "Returned", "A": "Accepted"}, "Other").alias("flag_label"),
        file_name(path).alias("file_name"),
        folder_name(path).alias("folder"),
    )


@query(
    "row_fingerprint",
    """
    SELECT c_custkey, md5('v' || c_name || chr(1) || CASE WHEN c_acctbal < 0 THEN 'n' ELSE 'v' || c_mktsegment END || chr(1) || 'v' || c_nationkey) AS checksum,
           md5(c_name) AS name_md5, lpad(lower(hex(c_custkey)), 8, '0') AS key_hex
    FROM customer
    """,
)
def q_row_fingerprint(spark, sf):
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    return load(spark, sf, "customer").select(
        "c_custkey",
        fingerprint("c_name", segment, "c_nationkey").alias("checksum"),
        F.md5(F.col("c_name").cast("binary")).alias("name_md5"),
        F.lpad(F.lower(F.hex("c_custkey")), 8, "0").alias("key_hex"),
    )


@query(
    "duplicate_texts",
    """
    SELECT md5(text) AS incident_id, count(*) AS occurrence, CAST(sum(n_chars * 1000) // 1000 AS BIGINT) AS total_ms
    FROM documents GROUP BY text HAVING count(*) > 1
    """,
)
def q_duplicate_texts(spark, sf):
    d = load(spark, sf, "documents").select("text", (F.col("n_chars") * 1000).alias("us"))
    return group_incidents(d, "text", "us").where("occurrence > 1").select("incident_id", "occurrence", "total_ms")
