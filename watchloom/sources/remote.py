"""Parameterised queries against the session or a JDBC source."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def run_query(spark: SparkSession, sql: str, params: dict | None = None, source: dict | None = None) -> DataFrame:
    """Run ``sql`` with named ``:markers``.

    In the session values are bound, never spliced into the text. A JDBC ``source`` (reader
    options) takes query text only, so there literals are quoted first.
    """
    if source is None:
        return spark.sql(sql, args=params or {})
    return spark.read.format("jdbc").options(**source).option("query", fill_markers(sql, params or {})).load()


def fill_markers(sql: str, params: dict) -> str:
    """``sql`` with each ``:marker`` outside quotes replaced by its literal, in one pass.

    A value is never looked at again, so one that holds a marker stays text. A marker
    without a value is an error.
    """

    def put(m: re.Match) -> str:
        return m[0] if m["name"] is None else sql_literal(params[m["name"]])

    return re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|::|(?<!\w):(?P<name>[A-Za-z_]\w*)", put, sql)


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "1" if value else "0"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"
