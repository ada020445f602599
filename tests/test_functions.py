from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from watchloom.functions import calendar as C
from watchloom.functions import text as T
from watchloom.functions.events import event_fields, params_to_columns, parse_event
from watchloom.functions.numbers import fingerprint, safe_ratio, tier


@pytest.mark.parametrize(
    "cls, kept",
    [("^a-z", "asdf"), ("^0-9", "1234"), ("^a-z0-9", "a1s2d3f4"), ("a-z0-9", "!@#$")],
)
def test_strip_chars(spark, cls, kept):
    df = spark.createDataFrame([("a1!s2@d3#f4$",)], "t string")
    r = T.strip_chars(df, "t", cls).first()
    assert r["stripped"] == kept and r["removed"] == 12 - len(kept)


def test_split_keeps_empty_pieces(spark, rows):
    df = spark.createDataFrame([("a,,b,",)], "t string")
    assert rows(T.split_rows(df, "t", ",").select("position", "parameter"), "position") == [(1, "a"), (2, ""), (3, "b"), (4, "")]


def test_split_by_several_characters(spark, rows):
    df = spark.createDataFrame([("a||b|c",)], "t string")
    assert rows(T.split_rows(df, "t", "||").select("parameter")) == [("a",), ("b|c",)]


@pytest.mark.parametrize(
    "day, jalali",
    [
        ("2024-03-19", "1402/12/29"),
        ("2024-03-20", "1403/01/01"),
        ("2025-03-20", "1403/12/30"),
        ("2025-03-21", "1404/01/01"),
        ("2000-02-29", "1378/12/10"),
        ("1984-01-01", "1362/10/10"),
        ("1984-03-01", "1362/12/09"),
    ],
)
def test_jalali_goldens(spark, day, jalali):
    df = spark.createDataFrame([(day,)], "s string").select(F.col("s").cast("date").alias("d"))
    assert df.select(C.to_jalali("d")["text"]).first()[0] == jalali
    assert C.add_jalali(df, "d").first()["jalali_text"] == jalali


def test_both_calendar_directions_agree_in_the_safe_range(spark):
    days = spark.sql("select explode(sequence(date'1993-03-21', date'2025-03-20')) d")
    back = C.add_jalali(days, "d").withColumn("b", C.from_jalali("jalali_text"))
    assert back.where("d <> b OR b IS NULL").count() == 0


@pytest.mark.parametrize("text, expected", [("80/01/01", date(2001, 3, 21)), ("01/01/1380", None), ("99999/01/01", None), ("x/1/1", None), ("1380", None)])
def test_from_jalali_edges(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.from_jalali("t")).first()[0] == expected


@pytest.mark.parametrize("day, week", [("2024-01-01", 1), ("2024-01-07", 2), ("2024-12-31", 53), ("2023-01-01", 1)])
def test_us_week(spark, day, week):
    df = spark.createDataFrame([(day,)], "s string").select(F.col("s").cast("date").alias("d"))
    assert df.select(C.us_week(F.col("d"))).first()[0] == week


def test_flags_of_a_moment(spark):
    df = spark.sql("select timestamp_ntz'2024-01-07 13:04:05.123456' ts")
    r = C.add_time_flags(df, "ts").first()
    assert (r.gr_date, r.jl_date, r.gr_weekofyear_num, r.jl_dayofweek_num) == ("2024/01/07", "1402/10/17", "02", "02")
    assert (r.time_full, r.time_hhmm, r.gr_quarter_name, r.isleapyear) == ("13:04:05.1234560", "13:04", "Q1", "1")
    assert len(r) == 30
    assert C.time_flag(df, "ts", "{%GR_MONTH_NAME%}", "m").first().m == "January"
    assert C.time_flag(df, "ts", "{%NOPE%}", "m").first().m is None


def test_null_moment_gives_null_flags(spark):
    r = C.add_time_flags(spark.sql("select cast(null as timestamp_ntz) ts"), "ts").first()
    assert all(v is None for v in r)


def test_ts_key(spark):
    df = spark.sql("select timestamp_ntz'2024-01-07 13:04:05.123' ts")
    assert df.select(C.ts_key("ts"), C.ts_key("ts", 8)).first() == (20240107130405123, 20240107)


def test_template(spark):
    df = spark.createDataFrame([("{%A%}-{%B%}-{%C%}-{%D%}", "x", None), ("{%A%}", "x", None)], "t string, a string, b string")
    out = T.render_template(df, "t", {"A": F.col("a")}, ["A", "B", "C"])
    assert [r.rendered for r in out.collect()] == ["x---{%D%}", "x"]
    nulls = T.render_template(df, "t", {"A": F.col("a"), "B": F.col("b")}, ["A", "B"])
    assert [r.rendered for r in nulls.collect()] == [None, "x"]


def test_paths(spark):
    df = spark.createDataFrame([("d:\\x\\y.tar.gz",), ("plain",), ("/a/b",)], "p string")
    out = df.select(T.file_name("p"), T.file_extension("p"), T.folder_name("p")).collect()
    assert [tuple(r) for r in out] == [("y.tar.gz", "gz", "d:\\x\\"), ("plain", None, ""), ("b", None, "/a/")]


def test_statement_slice(spark):
    df = spark.createDataFrame([("select 1; select 2", 20, 34), ("abc", 0, -1)], "t string, s int, e int")
    assert [r[0] for r in df.select(T.slice_statement("t", "s", "e")).collect()] == ["select 2", "abc"]


def test_extents(spark):
    df = spark.createDataFrame([("(1:8) - (1:24)",), ("(1:40)        ",)], "f string")
    assert [r[0] for r in df.select(T.extent_pages("f")).collect()] == [24, 8]


def test_missing_xml_field_is_null(spark):
    xml = '<event name="e" timestamp="2024-01-01T00:00:00Z"><data name="n"><value>x</value></data></event>'
    df = spark.createDataFrame([(xml,)], "x string").select(parse_event("x").alias("event"))
    out = event_fields(df, {"bad": ("data", "n", "long"), "none": ("data", "m", "long"), "act": ("action", "m", "string")}).first()
    assert tuple(out) == (None, None, None)


def test_last_of_repeated_parameters_wins(spark):
    doc = '<root><param name="host">a</param><param name="host">b</param></root>'
    df = spark.createDataFrame([(doc,)], "c string")
    out = params_to_columns(df, "c", {"host": "string", "port": "int"}).first()
    assert (out.host, out.port) == ("b", None)


def test_fingerprint_tells_null_from_empty(spark):
    df = spark.createDataFrame([("", "a"), (None, "a"), ("a", "")], "x string, y string")
    assert df.select(fingerprint("x", "y")).distinct().count() == 3


def test_crc32_builtin(spark):
    assert spark.sql("select hex(crc32('123456789'))").first()[0] == "CBF43926"


def test_ratio_and_tier(spark):
    df = spark.createDataFrame([(7, 2), (7, 0)], "n long, d long")
    assert [r[0] for r in df.select(safe_ratio("n", "d")).collect()] == [3, 0]
    bands = [r[0] for r in spark.createDataFrame([(5,), (6,), (99,), (None,)], "v int").select(tier("v", [5, 30], ["a", "b", "c"])).collect()]
    assert bands == ["a", "b", "c", None]


def test_concat_chunks_rebuild_the_whole(spark):
    from watchloom.operators.aggregates import concat_rows

    df = spark.range(1000).select(F.lit("k").alias("k"), "id", F.col("id").cast("string").alias("v"))
    whole = concat_rows(df, ["k"], "v", ",", ["id"], "t").first().t
    parts = concat_rows(df, ["k"], "v", ",", ["id"], "t", rows_per_chunk=64).orderBy("chunk_no").collect()
    assert len(parts) == 16 and ",".join(p.t for p in parts) == whole


def test_concat_nulls_and_markup(spark):
    from watchloom.operators.aggregates import concat_rows

    df = spark.createDataFrame([("k", 1, "a&<b>"), ("k", 2, None), ("k", 3, "c")], "k string, o int, v string")
    assert concat_rows(df, ["k"], "v", "|", ["o"], "t").first().t == "a&<b>||c"


def test_moment_types_survive(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),)], "t timestamp_ntz")
    assert C.add_jalali(df, "t").schema["t"].dataType.simpleString() == "timestamp_ntz"
