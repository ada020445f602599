"""XML event parsing: one ``from_xml`` per event, then typed lookups of named fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed schema of one captured event; values stay text and are cast per field.
EVENT_SCHEMA = (
    "_name string, _timestamp string, "
    "data array<struct<_name: string, value: string, text: string>>, "
    "action array<struct<_name: string, _package: string, value: string>>"
)


def parse_event(xml: str | Column) -> Column:
    return F.from_xml(F.col(xml) if isinstance(xml, str) else xml, EVENT_SCHEMA)


def _named(items: Column, name: str) -> Column:
    return F.filter(items, lambda x: x["_name"] == name)


def _first(items: Column, name: str, part: str) -> Column:
    return F.get(_named(items, name), F.lit(0))[part]


def data_field(event: str, name: str, dtype: str = "string", part: str = "value") -> Column:
    """First ``data`` entry with the name, null when absent or not castable."""
    value = _first(F.col(f"{event}.data"), name, part)
    return value if dtype == "string" else value.try_cast(dtype)


def action_field(event: str, name: str, dtype: str = "string") -> Column:
    value = _first(F.col(f"{event}.action"), name, "value")
    return value if dtype == "string" else value.try_cast(dtype)


def event_fields(df: DataFrame, spec: dict[str, tuple], event: str = "event", keep: list[str] | None = None) -> DataFrame:
    """Columns from named fields.

    ``spec`` maps output name to ``(kind, field, type)`` with kind ``data``, ``text``
    (the data entry's text node) or ``action``.
    """
    cols = []
    for out, (kind, field, dtype) in spec.items():
        if kind == "action":
            c = action_field(event, field, dtype)
        else:
            c = data_field(event, field, dtype, "text" if kind == "text" else "value")
        cols.append(c.alias(out))
    return df.select(*(keep or []), *cols)


def parsed_rows(df: DataFrame, columns: dict[str, Column], keep: Callable[[Column], Column], carry: list[str] | None = None) -> DataFrame:
    """Columns taken from a parsed document, only for rows where ``keep`` holds.

    A plain filter on such columns would be pushed below the parse and repeat it; a filter
    inside the row array is applied to what has been parsed already.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*(carry or []), F.inline(F.filter(F.array(row), keep)))


def params_to_columns(df: DataFrame, col: str, names: dict[str, str]) -> DataFrame:
    """``/root/param[@name]`` entries of a connection document as typed columns."""
    parsed = F.from_xml(F.col(col), "param array<struct<_name: string, _VALUE: string>>")
    out = df.withColumn("_params", parsed)
    # when a name is repeated the last entry wins
    for name, dtype in names.items():
        value = F.try_element_at(_named(F.col("_params.param"), name), F.lit(-1))["_VALUE"]
        out = out.withColumn(name, value if dtype == "string" else value.try_cast(dtype))
    return out.drop("_params")
