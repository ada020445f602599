"""Gregorian and Jalali calendar arithmetic as Catalyst expressions, one pass per row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Persian names in the spelling downstream reports expect, month 1..12,
# weekday Saturday..Friday, quarter 1..4.
JALALI_MONTHS = [
    "فروردين", "ارديبهشت", "خرداد", "تير", "مرداد", "شهريور",
    "مهر", "آبان", "آذر", "دي", "بهمن", "اسفند",
]
JALALI_WEEKDAYS = ["شنبه", "یکشنبه", "دوشنبه", "سه شنبه", "چهارشنبه", "پنجشنبه", "جمعه"]
JALALI_QUARTERS = ["بهار", "تابستان", "پاييز", "زمستان"]


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _div(a: Column, b: int) -> Column:
    """Integer division of non-negative values."""
    return F.call_function("div", a, F.lit(b)).cast("int")


def _two(c: Column) -> Column:
    """A number below 100 as two digits."""
    return F.lpad(c.cast("string"), 2, "0")


def _pad2(c: Column) -> Column:
    """Zero-pad to two digits; longer numbers stay as they are."""
    return F.format_string("%02d", c)


def is_leap(year: str | Column) -> Column:
    y = _col(year)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def _counted_date(d: Column) -> Column:
    # In Gregorian years 384 mod 400 the forward rule runs one day late, and 1 March
    # falls back over 29 February.
    late = F.year(d) % 400 == 384
    leap_day = (F.month(d) == 3) & (F.dayofmonth(d) == 1)
    return F.date_sub(d, F.when(late & leap_day, 2).when(late, 1).otherwise(0))


def _year_offset(gy: Column, doy: Column) -> tuple[Column, Column]:
    """Jalali year and 0-based day in it.

    The Jalali year starts on Gregorian day-of-year 80; days before it count on from the
    previous year, whose length follows the plain four-year rule.
    """
    previous_length = F.when((gy - 1) % 4 == 0, 366).otherwise(365)
    year = gy - F.when(doy >= 80, 621).otherwise(622)
    return year, doy - 80 + F.when(doy >= 80, 0).otherwise(previous_length)


def _month_day(offset: Column) -> tuple[Column, Column]:
    """Six months of 31 days, then months of 30."""
    month = F.when(offset < 186, _div(offset, 31) + 1).otherwise(_div(offset - 186, 30) + 7)
    day = F.when(offset < 186, offset % 31 + 1).otherwise((offset - 186) % 30 + 1)
    return month, day


def _jalali_text(y: Column, m: Column, d: Column, delimiter: str) -> Column:
    return F.concat(y.cast("string"), F.lit(delimiter), _two(m), F.lit(delimiter), _two(d))


def add_jalali(df: DataFrame, col: str, delimiter: str = "/", prefix: str = "jalali_") -> DataFrame:
    """Columns <prefix>year, month, day and text of the Jalali date of a date or timestamp.

    Built in steps that Spark keeps apart, so each intermediate is computed once per row.
    """
    out = df.withColumn("_d", _counted_date(F.to_date(col)))
    out = out.withColumns({"_gy": F.year("_d"), "_doy": F.dayofyear("_d")})
    year, offset = _year_offset(F.col("_gy"), F.col("_doy"))
    out = out.withColumns({f"{prefix}year": year, "_off": offset})
    month, day = _month_day(F.col("_off"))
    out = out.withColumns({f"{prefix}month": month, f"{prefix}day": day})
    parts = [F.col(f"{prefix}{p}") for p in ("year", "month", "day")]
    return out.withColumn(f"{prefix}text", _jalali_text(*parts, delimiter)).drop("_d", "_gy", "_doy", "_off")


def to_jalali(col: str | Column, delimiter: str = "/") -> Column:
    """Struct (year, month, day, text) of the Jalali date; ``add_jalali`` is the faster form."""
    d = _counted_date(F.to_date(_col(col)))
    y, offset = _year_offset(F.year(d), F.dayofyear(d))
    m, dd = _month_day(offset)
    return F.struct(
        y.cast("int").alias("year"),
        m.cast("int").alias("month"),
        dd.cast("int").alias("day"),
        _jalali_text(y, m, dd, delimiter).alias("text"),
    )


def jalali_to_date(y: Column, m: Column, d: Column) -> Column:
    """Gregorian date of a Jalali date by the 2820-year cycle (Julian day arithmetic)."""
    base = y - 474
    cycle_year = base % 2820 + 474
    leaps = _div(cycle_year * 682 - 110, 2816)
    before_month = F.when(m <= 7, (m - 1) * 31).otherwise((m - 1) * 30 + 6)
    julian_day = d + before_month + leaps + (cycle_year - 1) * 365 + _div(base, 2820) * 1029983 + 1948320
    return F.date_add(F.lit("1970-01-01").cast("date"), (julian_day - 2440588).cast("int"))


def from_jalali(col: str | Column, delimiter: str = "/") -> Column:
    """Gregorian date of ``y/m/d`` text; null for year-last or unparsable text.

    Two- and three-digit years (below 1300) are taken as 13xx; years over 9999 give null.
    """
    text = _col(col)
    cut = re.escape(delimiter)
    ok = text.rlike(f"^[0-9]+{cut}[0-9]+{cut}([0-9]{{1,3}}|[0-9]{{5,}})$")
    y, m, d = (F.split_part(text, F.lit(delimiter), F.lit(i)).try_cast("int") for i in (1, 2, 3))
    y = y + F.when(y < 1300, 1300).otherwise(0)
    return F.when(ok & (y <= 9999), jalali_to_date(y, m, d))


def us_week(d: Column) -> Column:
    """Week number where week 1 holds 1 January and weeks start on Sunday."""
    first_weekday = F.dayofweek(F.trunc(d, "year"))
    return _div(F.dayofyear(d) + first_weekday - 2, 7) + 1


FLAGS = [
    "GR_DATE", "JL_DATE", "GR_YEAR_NUM", "JL_YEAR_NUM", "GR_MONTH_NUM", "JL_MONTH_NUM", "GR_MONTH_NAME",
    "JL_MONTH_NAME", "GR_DAYOFMONTH_NUM", "JL_DAYOFMONTH_NUM", "GR_DAYOFYEAR_NUM", "JL_DAYOFYEAR_NUM",
    "GR_WEEKOFYEAR_NUM", "JL_WEEKOFYEAR_NUM", "GR_DAYOFWEEK_NUM", "JL_DAYOFWEEK_NUM", "GR_DAYOFWEEK_NAME",
    "JL_DAYOFWEEK_NAME", "GR_QUARTER_NUM", "JL_QUARTER_NUM", "GR_QUARTER_NAME", "JL_QUARTER_NAME",
    "ISLEAPYEAR", "TIME_FULL", "TIME_HHMMSS", "TIME_HHMM", "HOUR", "MINUTE", "SECOND",
]


def _pick(names: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def add_time_flags(df: DataFrame, ts: str, names: list[str] | None = None) -> DataFrame:
    """Calendar and clock flags of a timestamp as text columns named in lower case.

    Steps are kept apart as in ``add_jalali``; a null timestamp gives null flags.
    """
    stamp = F.col(ts).cast("timestamp_ntz")
    out = add_jalali(df.withColumn("_g", F.to_date(ts)), "_g", prefix="_j")
    out = out.withColumns(
        {
            "_since": F.datediff("_g", jalali_to_date(F.col("_jyear"), F.lit(1), F.lit(1))),
            "_sat": F.dayofweek("_g") % 7,  # 0 = Saturday .. 6 = Friday
            "_jq": _div(F.col("_jmonth") - 1, 3),
            "_clock": F.date_format(stamp, "HH:mm:ss.SSSSSS"),
        }
    )
    g, jm, sat, jq, clock = (F.col(c) for c in ("_g", "_jmonth", "_sat", "_jq", "_clock"))
    known = g.isNotNull()
    values = {
        "GR_DATE": F.date_format(g, "yyyy/MM/dd"),
        "JL_DATE": F.col("_jtext"),
        "GR_YEAR_NUM": F.year(g).cast("string"),
        "JL_YEAR_NUM": F.col("_jyear").cast("string"),
        "GR_MONTH_NUM": _two(F.month(g)),
        "JL_MONTH_NUM": _two(jm),
        "GR_MONTH_NAME": F.date_format(g, "MMMM"),
        "JL_MONTH_NAME": _pick(JALALI_MONTHS, jm - 1),
        "GR_DAYOFMONTH_NUM": _two(F.dayofmonth(g)),
        "JL_DAYOFMONTH_NUM": _two(F.col("_jday")),
        "GR_DAYOFYEAR_NUM": F.when(known, _pad2(F.dayofyear(g))),
        "JL_DAYOFYEAR_NUM": F.when(known, _pad2(F.col("_since"))),
        "GR_WEEKOFYEAR_NUM": _two(us_week(g)),
        "JL_WEEKOFYEAR_NUM": _two(_div(F.abs("_since"), 7)),
        "GR_DAYOFWEEK_NUM": _two(F.dayofweek(g)),
        "JL_DAYOFWEEK_NUM": _two(sat + 1),
        "GR_DAYOFWEEK_NAME": F.date_format(g, "EEEE"),
        "JL_DAYOFWEEK_NAME": _pick(JALALI_WEEKDAYS, sat),
        "GR_QUARTER_NUM": _two(F.quarter(g)),
        "JL_QUARTER_NUM": _two(jq + 1),
        "GR_QUARTER_NAME": F.concat(F.lit("Q"), F.quarter(g).cast("string")),
        "JL_QUARTER_NAME": _pick(JALALI_QUARTERS, jq),
        "ISLEAPYEAR": F.when(known, is_leap(F.year(g)).cast("int").cast("string")),
        "TIME_FULL": F.concat(clock, F.lit("0")),
        "TIME_HHMMSS": F.substring(clock, 1, 8),
        "TIME_HHMM": F.substring(clock, 1, 5),
        "HOUR": F.substring(clock, 1, 2),
        "MINUTE": F.substring(clock, 4, 2),
        "SECOND": F.substring(clock, 7, 2),
    }
    wanted = [n for n in FLAGS if names is None or n in names]
    out = out.withColumns({n.lower(): values[n] for n in wanted})
    return out.drop("_g", "_since", "_sat", "_jq", "_clock", "_jyear", "_jmonth", "_jday", "_jtext")


def time_flag(df: DataFrame, ts: str, braced_name: str, out: str) -> DataFrame:
    """One flag by its braced name, for example ``{%JL_DATE%}``; unknown names give null."""
    name = braced_name.strip("{}%")
    if name not in FLAGS:
        return df.withColumn(out, F.lit(None).cast("string"))
    return add_time_flags(df, ts, [name]).withColumnRenamed(name.lower(), out)


def calendar_dim(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """One row per date between the bounds row's two dates, with every flag."""
    days = bounds.select(F.explode(F.sequence(F.to_date(first), F.to_date(last))).alias("day"))
    return add_time_flags(days, "day")


def ts_key(col: str | Column, digits: int = 17) -> Column:
    """First ``digits`` digits of yyyymmddhhmmssmmm as a sortable long."""
    return F.substring(F.date_format(_col(col).cast("timestamp_ntz"), "yyyyMMddHHmmssSSS"), 1, digits).cast("long")
