"""Reader for rotated text logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchloom.functions.times import ntz

# Fixed format: "2024-01-31 10:20:30.12 spid51      message"
LINE_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(\S+)\s+(.*)$"


def parse_log_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """(log_date, process, text); lines that do not start with a time stamp are dropped."""
    part = {i: F.regexp_extract(F.col(col), LINE_PATTERN, i) for i in (1, 2, 3)}
    return lines.where(F.col(col).rlike(LINE_PATTERN)).select(
        F.to_timestamp_ntz(part[1]).alias("log_date"), part[2].alias("process"), part[3].alias("text")
    )


def read_text_log(
    source: DataFrame | str,
    spark: SparkSession | None = None,
    where: Column | str | None = None,
    start=None,
    end=None,
    order: str | None = "desc",
) -> DataFrame:
    """Log entries between two times, filtered by any condition and ordered by time.

    A path may be a glob over every rotated file; a DataFrame must already carry
    (log_date, process, text).
    """
    df = parse_log_lines(spark.read.text(source)) if isinstance(source, str) else source
    if start is not None:
        df = df.where(F.col("log_date") >= ntz(start))
    if end is not None:
        df = df.where(F.col("log_date") <= ntz(end))
    if where is not None:
        df = df.where(where)
    if order is None:
        return df
    return df.orderBy(F.col("log_date").desc() if order == "desc" else F.col("log_date").asc())
