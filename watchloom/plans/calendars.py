"""Calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchloom.functions.calendar import JALALI_MONTHS, JALALI_QUARTERS, JALALI_WEEKDAYS, add_jalali, add_time_flags, calendar_dim, from_jalali, ts_key
from watchloom.plans.registry import query
from watchloom.session import load


def names_sql(names):
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


# Jalali month starts counted by walking whole Jalali years from a known new year's day;
# an approach independent of the arithmetic under test.
JALALI_SQL = f"""
newyear AS (
  SELECT y, len, DATE '1992-03-21' + CAST(coalesce(sum(len) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start
  FROM (SELECT y, CASE WHEN y IN (1370, 1375, 1379, 1383, 1387, 1391, 1395, 1399, 1403) THEN 366 ELSE 365 END AS len FROM range(1371, 1404) t(y))),
months(m, off, len) AS (VALUES (1,0,31),(2,31,31),(3,62,31),(4,93,31),(5,124,31),(6,155,31),
  (7,186,30),(8,216,30),(9,246,30),(10,276,30),(11,306,30),(12,336,30))
"""


def jalali_join(alias, day):
    return f"""
    JOIN newyear ny ON {day} >= ny.start AND {day} < ny.start + CAST(ny.len AS INTEGER)
    JOIN months mo ON date_diff('day', ny.start, {day}) >= mo.off AND date_diff('day', ny.start, {day}) < mo.off + mo.len
"""


@query(
    "calendar_dim",
    f"""
    WITH {JALALI_SQL},
    days AS (SELECT CAST(unnest(range((SELECT min(o_orderdate) FROM orders), (SELECT max(o_orderdate) FROM orders) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day),
    j AS (
      SELECT d.day, ny.y AS jy, mo.m AS jm, date_diff('day', ny.start, d.day) - mo.off + 1 AS jd, date_diff('day', ny.start, d.day) AS jn,
             (dayofweek(d.day) + 1) % 7 AS sat
      FROM days d {jalali_join('d', 'd.day')})
    SELECT day, strftime(day, '%Y/%m/%d') AS gr_date, printf('%d/%02d/%02d', jy, jm, jd) AS jl_date,
      CAST(year(day) AS VARCHAR) AS gr_year_num, CAST(jy AS VARCHAR) AS jl_year_num,
      strftime(day, '%m') AS gr_month_num, printf('%02d', jm) AS jl_month_num,
      monthname(day) AS gr_month_name, {names_sql(JALALI_MONTHS)}[jm] AS jl_month_name,
      strftime(day, '%d') AS gr_dayofmonth_num, printf('%02d', jd) AS jl_dayofmonth_num,
      printf('%02d', dayofyear(day)) AS gr_dayofyear_num, printf('%02d', jn) AS jl_dayofyear_num,
      printf('%02d', CAST(strftime(day, '%U') AS INTEGER) + CASE WHEN dayofweek(make_date(year(day), 1, 1)) = 0 THEN 0 ELSE 1 END) AS gr_weekofyear_num,
      printf('%02d', jn // 7) AS jl_weekofyear_num,
      printf('%02d', dayofweek(day) + 1) AS gr_dayofweek_num, printf('%02d', sat + 1) AS jl_dayofweek_num,
      dayname(day) AS gr_dayofweek_name, {names_sql(JALALI_WEEKDAYS)}[sat + 1] AS jl_dayofweek_name,
      printf('%02d', quarter(day)) AS gr_quarter_num, printf('%02d', (jm + 2) // 3) AS jl_quarter_num,
      'Q' || quarter(day) AS gr_quarter_name, {names_sql(JALALI_QUARTERS)}[(jm + 2) // 3] AS jl_quarter_name,
      CASE WHEN dayofyear(make_date(year(day), 12, 31)) = 366 THEN '1' ELSE '0' END AS isleapyear,
      '00:00:00.0000000' AS time_full, '00:00:00' AS time_hhmmss, '00:00' AS time_hhmm, '00' AS hour, '00' AS minute, '00' AS second
    FROM j
    """,
)
def q_calendar_dim(spark, sf):
    span = load(spark, sf, "orders").agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    return calendar_dim(span, "first", "last")


@query(
    "time_flags",
    f"""
    WITH {JALALI_SQL}
    SELECT event_id, printf('%d/%02d/%02d', ny.y, mo.m, date_diff('day', ny.start, CAST(ts AS DATE)) - mo.off + 1) AS jl_date,
           strftime(ts, '%H:%M:%S.%f') || '0' AS time_full, strftime(ts, '%H:%M') AS time_hhmm, strftime(ts, '%H') AS hour,
           strftime(ts, '%M') AS minute, strftime(ts, '%S') AS second, strftime(ts, '%H:%M:%S') AS time_hhmmss
    FROM events {jalali_join('e', 'CAST(ts AS DATE)')}
    """,
)
def q_time_flags(spark, sf):
    e = load(spark, sf, "events").select("event_id", "ts")
    names = ["JL_DATE", "TIME_FULL", "TIME_HHMMSS", "TIME_HHMM", "HOUR", "MINUTE", "SECOND"]
    return add_time_flags(e, "ts", names).drop("ts")


@query(
    "orders_by_jalali_month",
    f"""
    WITH {JALALI_SQL}
    SELECT CAST(ny.y AS INTEGER) AS jalali_year, CAST(mo.m AS INTEGER) AS jalali_month, count(*) AS orders,
           CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
    FROM orders {jalali_join('o', 'CAST(o_orderdate AS DATE)')}
    GROUP BY ny.y, mo.m
    """,
)
def q_orders_by_jalali_month(spark, sf):
    o = add_jalali(load(spark, sf, "orders"), "o_orderdate")
    return o.groupBy("jalali_year", "jalali_month").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")
    )


@query(
    "jalali_roundtrip",
    f"""
    WITH {JALALI_SQL}
    SELECT o_orderkey, printf('%d-%02d-%02d', ny.y, mo.m, date_diff('day', ny.start, CAST(o_orderdate AS DATE)) - mo.off + 1) AS jalali,
           CAST(o_orderdate AS DATE) AS back, CAST(NULL AS DATE) AS year_last
    FROM orders {jalali_join('o', 'CAST(o_orderdate AS DATE)')}
    """,
)
def q_jalali_roundtrip(spark, sf):
    o = add_jalali(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "-", "j_")
    o = o.withColumn("j_last", F.concat_ws("-", F.col("j_day").cast("string"), F.col("j_month").cast("string"), F.col("j_year").cast("string")))
    return o.select(
        "o_orderkey",
        F.col("j_text").alias("jalali"),
        from_jalali("j_text", "-").alias("back"),
        from_jalali("j_last", "-").alias("year_last"),
    )


@query(
    "snapshot_key",
    """
    SELECT event_id, CAST(strftime(ts, '%Y%m%d%H%M%S%g') AS BIGINT) AS full_key,
           CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS snapshot_id, CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS day_key
    FROM events
    """,
)
def q_snapshot_key(spark, sf):
    return load(spark, sf, "events").select(
        "event_id", ts_key("ts").alias("full_key"), ts_key("ts", 14).alias("snapshot_id"), ts_key("ts", 8).alias("day_key")
    )
